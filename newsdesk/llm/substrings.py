"""Passages that repeat across documents: windows of words found through anchors at the places of a difference cover.

A window is ``WINDOW`` consecutive words. Hashes of ``ANCHOR`` words are taken only at places whose remainder modulo ``PERIOD`` is in a
difference cover: any two places have a common shift below the period that brings both to such remainders. So wherever two documents
share a window they share an anchor at places of the cover inside of it, however the window lies in each. Anchors of several documents,
found by their hashes alone (packed by range of hashes, three in seven words), extend to the windows around them; only these windows are
looked at as a whole. A window's first document is the smallest id that has it, and windows of later documents go: a word that one of
them covers is removed.

No pairs are made. Later copies of a whole text need no windows: the first one has all of theirs. Which documents have an anchor or a copy
is asked in filters of hashed keys, whose size follows the number of keys up to ``MOST_BITS``; beyond that they let pass more windows,
never fewer, and cost time, not results. A window is known by 96 bits of hashes over all of its words.

Defined results: words are split at ASCII white space and compared unchanged; null, empty and blank texts have none; a very long text or
word is looked at whole, in memory of several times its length; equal ids remove nothing from each other, and a null id isn't smaller
than any, so that documents without one keep all and remove nothing; repeated rows are each returned; an empty table gives an empty
result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import release
from .shared import discard, filter_column, join_hot, small_batches, stored

WINDOW, PERIOD = 13, 7
#: Bits for each key of a filter, and in all: 64 MB in each worker.
KEY_BITS, MOST_BITS = 32, 1 << 29
#: Bytes of anchors in a packed range, and anchors or windows that a task holds before it hands them on: memory bounds.
RANGE_BYTES, HELD = 16 << 20, 1 << 20
#: Longer words are hashed one by one, others in blocks of so many.
LONG, WORDS = 4096, 8192
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 13) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of remainders, two of which differ by any given number modulo the period; the first in order."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return chosen
    raise ValueError("no period")


COVER, ANCHOR = difference_cover(PERIOD), WINDOW - PERIOD + 1


def _factors(salt: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([k]), salt) | 1 for k in range(WINDOW)], np.uint64)


_FACTORS, _OTHERS = _factors(1), _factors(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, inverse))


_known = _powers(1 << 16)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, by differences of running sums over a block, mixed."""
    global _known
    out = np.empty(len(words), np.uint64)
    for k in range(0, len(words), WORDS):
        block = words[k : k + WORDS]
        long = [j for j, w in enumerate(block) if len(w) > LONG] if sum(map(len, block)) > LONG else []
        for j in long:
            out[k + j] = xxhash.xxh64_intdigest(block[j], 13)
            block[j] = b""
        raw = np.frombuffer(b" ".join(block) + b" ", np.uint8)
        if len(raw) > len(_known[0]):
            _known = _powers(2 * len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _known[0][: len(raw)], out=sums[1:])
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        found = _mixed((sums[ends] - sums[starts]) * _known[1][starts])
        if long:
            found[long] = out[k : k + len(block)][long]
        out[k : k + len(block)] = found
    return out


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cover, and the hashes of the words from there."""
    last = len(h) - ANCHOR + 1
    places, found = [], []
    for c in COVER:
        if c < last:
            n = (last - c + PERIOD - 1) // PERIOD
            total = np.zeros(n, np.uint64)
            for k in range(ANCHOR):
                total += h[c + k :: PERIOD][:n] * _FACTORS[k]
            places.append(np.arange(c, last, PERIOD))
            found.append(_mixed(total))
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def near_anchors(n: int, places: np.ndarray) -> np.ndarray:
    """Starts of the windows of n words that have one of the places in reach of their anchors."""
    step = np.zeros(n + 2, np.int64)
    np.add.at(step, np.maximum(places - PERIOD + 1, 0), 1)
    np.add.at(step, places + 1, -1)
    return np.flatnonzero(np.cumsum(step)[: max(0, n - WINDOW + 1)] > 0)


def windows(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash over the windows' words."""
    first, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(WINDOW):
        w = h[starts + k]
        first += w * _FACTORS[k]
        second += w * _OTHERS[k]
    return _mixed(first), (_mixed(second) >> np.uint64(32)).astype(np.uint32)


Holds = Callable[[np.ndarray], np.ndarray]


def key_filter(keys: DataFrame, key: str) -> Holds:
    """A function of hashes (unsigned longs) that is true for all of the keys (well mixed longs), and for few others.

    Two bits a key; the driver and each worker hold ``MOST_BITS`` at most, whatever the number of keys.
    """
    spark, n = keys.sparkSession, keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (n * KEY_BITS).bit_length()))
    mask = F.lit(bits - 1)
    places = F.array(F.col(key).bitwiseAND(mask), F.shiftrightunsigned(key, 33).bitwiseAND(mask))
    place = F.col("place") + 1  # Spark counts bits and buckets from 1
    spread = keys.select(F.explode(places).alias("place"))
    rows = spread.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    made = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        at = (r["b"] - 1) * 4096
        made[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(made)

    def holds(values: np.ndarray) -> np.ndarray:
        own = shared.value
        one, two = (p & np.uint64(bits - 1) for p in (values, values >> np.uint64(33)))
        bit = lambda p: own[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1
        return (bit(one) & bit(two)).astype(bool)

    return holds


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, tk (hash of the text) and dk (hash of both; rows are told apart by doc_id and dk)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"), F.xxhash64("doc_id", text).alias("dk"))


def later_copies(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and dk of the first document of each text, which have windows of their own, and of the later ones, whose windows all go."""
    keys = stored(keyed.where("doc_id IS NOT NULL").select("doc_id", "tk", "dk", F.xxhash64(F.lit(1), "text").alias("check")), "keys")
    least = stored(keys.groupBy(F.struct("tk", "check").alias("k")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    marked = stored(join_hot(keys.withColumn("k", F.struct("tk", "check")), least, "k", "n").select("doc_id", "dk", (F.col("doc_id") > F.col("least")).alias("later")), "copies")
    discard(keys, least)
    return marked.where("NOT later").select("doc_id", "dk"), marked.where("later").select("doc_id", "dk")


def repeated_anchors(keyed: DataFrame, first: Holds, ranges: int) -> DataFrame:
    """anchor: hashes of anchors that several documents have. ranges: a power of two, into so many the hashes are cut."""
    shift = np.uint64(64 - ranges.bit_length() + 1)
    edges = np.arange(1, ranges, dtype=np.uint64) << shift if ranges > 1 else np.zeros(0, np.uint64)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
        rows = [(r, found[a:b], n[a:b] > 1) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int32()), pa.array([h.tobytes() for _, h, _ in rows], pa.binary()), pa.array([h[m].tobytes() for _, h, m in rows], pa.binary())], ["range", "all", "several"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            mine = first(b.column("dk").to_numpy().view(np.uint64))
            for text in b.filter(pa.array(mine)).column("text"):
                words = split(text.as_py())
                if len(words) >= WINDOW:
                    held.append(np.unique(anchors(word_hashes(words))[1]))
                    size += len(held[-1])
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)
        release()

    def met(at: int, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        every = np.sort(np.frombuffer(b"".join(a for a, _ in rows), np.uint64))
        again = every[1:][every[1:] == every[:-1]]
        found = np.unique(np.concatenate([again, np.frombuffer(b"".join(s for _, s in rows), np.uint64)]))
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["anchor"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = -1, []
        for b in batches:
            for r, a, s in zip(b.column("range").to_pylist(), b.column("all"), b.column("several"), strict=True):
                if r != at and rows:
                    yield met(at, rows)
                    rows = []
                at = r
                rows.append((a.as_py(), s.as_py()))
        if rows:
            yield met(at, rows)
        release()

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.where("doc_id IS NOT NULL").select("text", "dk").mapInArrow(take, "range int, all binary, several binary").repartition(parts, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(gather, "anchor long")


def candidates(keyed: DataFrame, first: Holds, anchored: Holds) -> DataFrame:
    """hash, check, doc_id, dk, at: the windows around repeated anchors of the first document of each text."""

    def batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["hash", "check", "doc_id", "dk", "at"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            b = b.filter(pa.array(first(b.column("dk").to_numpy().view(np.uint64))))
            for doc_id, dk, text in zip(b.column("doc_id").to_pylist(), b.column("dk").to_pylist(), b.column("text"), strict=True):
                words = split(text.as_py())
                if len(words) < WINDOW:
                    continue
                h = word_hashes(words)
                places, found = anchors(h)
                starts = near_anchors(len(h), places[anchored(found)])
                for k in range(0, len(starts), HELD // 4):
                    part = starts[k : k + HELD // 4]
                    one, two = windows(h, part)
                    held.append((one.view(np.int64), two.view(np.int32), np.full(len(part), doc_id), np.full(len(part), dk), part.astype(np.int32)))
                    size += len(part)
                    if size >= HELD // 4:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)
        release()

    return keyed.where("doc_id IS NOT NULL").select("doc_id", "dk", "text").mapInArrow(each, "hash long, check int, doc_id long, dk long, at int")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        counts, gone, kept = [], [], []
        for text, at in zip(b.column("text"), b.column("at"), strict=True):
            words, starts = split(text.as_py()), at.values.to_numpy()
            n = len(words)
            if (starts < 0).any():  # a later copy
                left = words if n < WINDOW else []
            elif len(starts):
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + WINDOW, -1)
                left = [words[k] for k in np.flatnonzero(np.cumsum(step)[:n] == 0)]
            else:
                left = words
            counts.append(n)
            gone.append(n - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    release()


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every document."""
    keyed = _keyed(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ones, later = later_copies(keyed)
    first = key_filter(ones, "dk")
    # three anchors of eight bytes to seven words, which are hardly shorter than four bytes and a space
    size = keyed.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    ranges = 1 << max(0, max(4 * parts, size * 24 // 35 // RANGE_BYTES) - 1).bit_length()
    with small_batches(docs.sparkSession):
        repeated = stored(repeated_anchors(keyed, first, ranges), "anchors")
        anchored = key_filter(repeated, "anchor")
        found = stored(candidates(keyed, first, anchored), "windows")
    # stored, so that a window of very many documents is a skewed side of the join, which adaptive execution splits, and no group of it
    least = found.groupBy("hash", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "check", "least")
    least = stored(least, "least")
    marked = found.join(least, ["hash", "check"]).where("doc_id > least").select("doc_id", "dk", "at")
    marked = marked.unionByName(later.withColumn("at", F.lit(-1)))
    touched = stored(marked.groupBy("doc_id", "dk").agg(F.collect_set("at").alias("at")), "touched")
    discard(repeated, found, least)
    maybe = filter_rows(keyed, key_filter(touched, "dk"))
    plain = maybe.where("NOT maybe").select("doc_id", "text", F.array().cast("array<int>").alias("at"))
    met = maybe.where("maybe").join(touched, ["doc_id", "dk"], "left").select("doc_id", "text", F.coalesce("at", F.array().cast("array<int>")).alias("at"))
    return plain.unionByName(met).mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept string")


def filter_rows(keyed: DataFrame, holds: Holds) -> DataFrame:
    """keyed with maybe: whether the filter has its dk."""
    return keyed.withColumn("maybe", filter_column(lambda k: holds(k.view(np.uint64)), F.col("dk")))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), g AS (
    SELECT r, doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS gram FROM (SELECT *, unnest(generate_series(1, len(words) - 12)) AS i FROM d)
), m AS (
    SELECT gram, min(doc_id) AS least FROM g GROUP BY gram
), c AS (
    SELECT DISTINCT r, i + k AS i FROM g JOIN m USING (gram), (SELECT unnest(generate_series(0, 12)) AS k) WHERE doc_id > least
), n AS (
    SELECT r, count(*) AS n FROM c GROUP BY r
), w AS (
    SELECT r, i, words[i] AS word FROM (SELECT r, words, unnest(generate_series(1, len(words))) AS i FROM d)
), k AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (r, i) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
