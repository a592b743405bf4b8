"""Spelling variants: words one edit apart, found by two-dimensional range reporting in wavelet trees.

Words of one length T are points: their rank in forward order by their rank in the order of their reversed spellings. What differs from
a word at position i alone has its first i code points and its last T - 1 - i: an interval of the one order and an interval of the other,
so that a rectangle has exactly the words with one code point replaced there, or (for a query of T - 1 code points) one inserted. Every
edit position of every query is such a rectangle; a wavelet tree over the points reports what lies in it. Deletions are insertions seen
from the other word; of the equal insertions into a run of one letter the leftmost counts.

An edit leaves one half of a word as it is, so trees are dealt by length, half and the half's code points: a tree has whole groups of
words that share such a half, of about ``BLOCK`` code points together. A group that is larger than that is dealt by halves of the edit
positions again, down to a single position, where a group has one word for each letter at most.

Defined results: null and empty texts have no words; a very long text is looked at in memory of several times its length, a very long
word is a word like any other; a null id counts as an empty one in ``<doc_id>:<word>``; repeated rows count again; ties of n go to the
smallest word; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release
from .shared import discard, stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: One in so many words of a document loses a letter.
SLIP = 199
#: Code points of a word and occurrences that it has at least; a form is so many times as frequent as its variant.
SHORTEST, RAREST, TIMES = 6, 5, 5
#: Code points of a tree's words, and words that a task counts before it hands them on: memory bounds.
BLOCK, HELD = 1 << 20, 1 << 18
_RUN = re.compile(LETTERS)
_LOWER = {c: c + 32 for c in range(65, 91)}
_LONG = 1 << 20


def runs(text: str | None) -> Counter:
    """The maximal runs of letters, A-Z in lower case, and how often each occurs."""
    low = (text or "").translate(_LOWER)
    return Counter(_RUN.findall(low) if len(low) < _LONG else (m.group() for m in _RUN.finditer(low)))


def slipped(run: str, start: int) -> str:
    """The run without one code point where its checksum says so. start: the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def words(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """word and n (occurrences in all documents) of the words that are long and frequent enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                start = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for run, n in runs(text.as_py()).items():
                    if len(run) >= shortest:
                        word = slipped(run, start)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
        release()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(each, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


class Wavelet:
    """A wavelet tree over a permutation, its levels from the highest bit down, each with the zeros before every place."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.zeros: list[np.ndarray] = []
        for shift in range(max(0, self.n - 1).bit_length() - 1, -1, -1):
            one = (values >> shift & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries of places low <= p < high and values least <= v < most: (query, value) of all that there are."""
        query = np.flatnonzero((low < high) & (least < most))
        low, high, base = low[query], high[query], np.zeros(len(query), np.int64)
        for level, zeros in enumerate(self.zeros):
            span = 1 << (len(self.zeros) - 1 - level)
            left, right = zeros[low], zeros[high]
            ones = zeros[-1]
            low, high = np.concatenate([left, ones + low - left]), np.concatenate([right, ones + high - right])
            base, query = np.concatenate([base, base + span]), np.concatenate([query, query])
            there = (low < high) & (base < most[query]) & (base + span > least[query])
            query, low, high, base = query[there], low[there], high[there], base[there]
        there = (base >= least[query]) & (base < most[query])
        return query[there], base[there]


class _Order:
    """Spellings (rows of letters, 0 after the end) in order, with the interval of target ranks that shares the first i letters with each."""

    def __init__(self, letters: np.ndarray, target: np.ndarray) -> None:
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
        ranked = letters[self.order]
        self.shared = (ranked[1:] != ranked[:-1]).argmax(1) if len(ranked) > 1 else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(target[self.order])])
        self.longest = int(self.shared.max()) if len(self.shared) else 0

    def interval(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.order)
        cuts = np.concatenate([[0], np.flatnonzero(self.shared < i) + 1, [n]])
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        low, high = np.empty(n, np.int64), np.empty(n, np.int64)
        low[self.order], high[self.order] = self.before[cuts[group]], self.before[cuts[group + 1]]
        return low, high


def near(spelled: list[str], size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of indexes: b is a, of size or size - 1 code points, with one replaced or inserted at a place first <= i < last of b.

    Words of size - 1 code points are queries only.
    """
    lengths = np.array([len(w) for w in spelled])
    target = lengths == size
    if not target.any() or len(spelled) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer(b"".join(w.encode("latin-1").ljust(size, b"\0") for w in spelled), np.uint8).reshape(-1, size)
    mirrored = np.frombuffer(b"".join(w[::-1].encode("latin-1").ljust(size, b"\0") for w in spelled), np.uint8).reshape(-1, size)
    forward, reverse = _Order(letters, target), _Order(mirrored, target)
    ranked = reverse.order[target[reverse.order]]  # targets by their reversed spelling
    rank = np.empty(len(spelled), np.int64)
    rank[ranked] = np.arange(len(ranked))
    tree = Wavelet(rank[forward.order[target[forward.order]]])
    least = np.where(target, 2, 1)  # a word is in its own rectangles
    left, right = [], []
    for i in range(max(first, size - 1 - reverse.longest), min(last, forward.longest + 1)):
        low, high = forward.interval(i)
        under, over = reverse.interval(size - 1 - i)
        asked = np.flatnonzero((high - low >= least) & (over - under >= least))
        query, value = tree.report(low[asked], high[asked], under[asked], over[asked])
        a, b = asked[query], ranked[value]
        new = a != b
        if i:
            new &= target[a] | (letters[b, i - 1] != letters[b, i])
        left.append(a[new])
        right.append(b[new])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + left), np.concatenate(none + right)


SPOTS = "word string, n_near long, form_n long, form string"


def _group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of each word the near words of one tree: how many, and the most frequent."""
    size, first, last = (k.as_py() for k in key[:3])
    spelled, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    a, b = near(spelled, size, first, last)
    short = np.array([len(w) < size for w in spelled], bool)
    me, other = np.concatenate([a, b[short[a]]]), np.concatenate([b, a[short[a]]])
    place = np.empty(len(spelled), np.int64)
    place[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
    order = np.lexsort((place[other], -n[other], me))
    me, other = me[order], other[order]
    who, at, count = np.unique(me, return_index=True, return_counts=True)
    best = other[at]
    return pa.table({"word": pa.array([spelled[k] for k in who], pa.string()), "n_near": pa.array(count, pa.int64()), "form_n": pa.array(n[best], pa.int64()), "form": pa.array([spelled[k] for k in best], pa.string())})


def _kept() -> Column:
    """The hash of a group: what lies outside of the edit's places, of the size that the longer word has."""
    rest = F.when(F.length("word") == F.col("size"), F.expr("substring(word, last + 1)")).otherwise(F.expr("substring(word, last)"))
    return F.xxhash64("size", "first", "last", F.expr("substring(word, 1, first)"), rest)


def dealt(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n by size, first, last (places of the edit) and part: every two words near each other meet in one of these."""
    sized = found.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    halves = lambda low, high, cut: F.explode(F.array(F.struct(low.alias("first"), cut.alias("last")), F.struct(cut.alias("first"), high.alias("last"))))
    half = F.expr("size div 2").cast("int")
    open_ = stored(sized.withColumn("e", halves(F.lit(0), F.col("size"), half)).select("word", "n", "size", "e.*").withColumn("kept", _kept()), "halves")
    done, group = [], ["size", "first", "last", "kept"]
    while True:  # places are halved, so this ends after the logarithm of the longest word's length
        weights = open_.groupBy(*group).agg((F.count("*") * F.col("size")).alias("weight"))
        large = stored(weights.where((F.col("weight") > block) & (F.col("last") - F.col("first") > 1)).select(*group), "large")
        if large.isEmpty():
            done.append(open_)
            break
        done.append(open_.join(large, group, "left_anti"))
        middle = F.expr("(first + last) div 2").cast("int")
        split = open_.join(large, group, "left_semi").withColumn("e", halves(F.col("first"), F.col("last"), middle))
        open_ = stored(split.select("word", "n", "size", "e.*").withColumn("kept", _kept()), "halves")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    # as many parts of every kind as the largest needs, so that no kind is dealt as a whole first
    weights = rows.groupBy("size", "first", "last").agg((F.count("*") * F.col("size")).alias("weight"))
    parts = -(-(weights.agg(F.max("weight")).collect()[0][0] or 1) // block)
    return rows.select("word", "n", "size", "first", "last", F.pmod("kept", F.lit(parts)).alias("part"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root (the last of its forms) of words that have a form. Forms are more frequent than their words, so there are no rings."""
    links = stored(forms.select("word", F.col("form").alias("root")), "links")
    while True:  # each round doubles the steps taken
        on = links.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        new = stored(links.join(on, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "links")
        discard(links)
        links = new
        if new.where("moved").isEmpty():
            return links.select("word", "root")


def grouped(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that is long and frequent enough.

    Near words are one inserted, deleted or replaced code point apart. A form is the near word of largest n, if that is ``times`` the word's.
    """
    found = stored(words(docs, shortest, rarest), "words")
    spots = dealt(found, block).groupBy("size", "first", "last", "part").applyInArrow(_group, SPOTS)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w")))
    joined = found.join(spots.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")), "word", "left")
    fits = -F.col("best.n") >= times * F.col("n")
    placed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")), "forms")
    last = roots(placed.where("form IS NOT NULL"))
    return placed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB has no crc32, so its table is made here; near words meet by what is left without one letter.
ORACLE = r"""
WITH RECURSIVE tab AS (
    SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, generate_series(1, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(generate_series(0, 255)) AS b)
    )
), runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ) WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)) AS b FROM runs
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab
), slipped AS (
    SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
    SELECT word, n, length(word) AS size, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (size, i, rest) WHERE a.word <> b.word
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
), best AS (
    SELECT word, count(*) AS n_near, arg_max(other, m) FILTER (m = top AND other = first) AS other, max(m) AS m FROM (
        SELECT *, max(m) OVER (PARTITION BY word) AS top, first_value(other) OVER (PARTITION BY word ORDER BY m DESC, other) AS first FROM near
    ) GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS root FROM forms WHERE form IS NULL
    UNION ALL SELECT f.word, s.root FROM forms f JOIN steps s ON f.form = s.word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN steps USING (word)
"""
