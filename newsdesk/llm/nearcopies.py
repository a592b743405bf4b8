"""Near copies: SimHash's tiled comparison, and an exact set-similarity join of five-word shingles for what lies beyond its radius.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles (words split at ASCII white space, in lower case as
in SimHash) is at least 4/5. Rows of equal sets are one node. At that similarity fingerprints differ in some ten bits, where tiles part
hardly any pairs; so SimHash, at its own small radius, proposes the closest pairs, and a prefix filter all others: in any one order of all
shingles, two linked sets of n shingles each share one of the first n - ceil(4n/5) + 1 of their own, and the first that they share leaves
both enough shingles behind it. The order puts the shingles that most sets have last; it decides only how many candidates there are, never
which links are found.

Every candidate is compared exactly, first SimHash's and each set with its neighbours among the sets of a prefix shingle (which each
shingle puts in an order of its own, so that a set has many different ones), then all pairs that these links have not connected already,
so that a large group of copies needs few comparisons. Before whole sets are joined, pairs go that a bound on
their difference rules out for certain: bits that differ in the parities of two sets' shingles by residue are at most the shingles
in one of the sets only, and two alike sets have at most a ninth of their sizes' sum of these. Whole sets are made again from the texts of
candidates alone, which a filter of hashed keys finds before anything is shuffled.

Defined results: null and blank texts are one node without shingles; a text of one to four words has itself as its only shingle; a very
long text is looked at whole, in memory of several times its length; repeated rows are one node; of rows alike the first by id (rows
without one last), then by text, then by the other columns stays; an empty table gives an empty result; extra columns don't matter, but
names that begin with ``__nd_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .memory import release
from .shared import discard, filter_column, key_filter, stored
from .simhash import _LOWER, connected

WORDS = 5
#: The most frequent shingles that the order knows, and how many rows such a one has: a memory bound, no link depends on it.
FREQUENT, OFTEN = 500_000, 3
#: Longs of the parities that go with every prefix shingle.
SHORT = 4
#: Pairs of entries of one shingle that meet in one place: beyond that, these are dealt to several.
MEET = 100_000_000
#: Nodes whose whole sets a task holds at once, twice: a memory bound.
CELL = 250
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    mixed = sum(h[k : k + n] * _FACTORS[k] for k in range(WORDS))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _FACTORS[0]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes())


def prefix(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a set that is similar enough must share one, in their order; frequent: halves, ascending, rank: how late each comes."""
    n = len(grams)
    late = np.zeros(n, np.int64)
    if len(frequent):
        half = halves(grams)
        at = np.minimum(np.searchsorted(frequent, half), len(frequent) - 1)
        late = np.where(frequent[at] == half, rank[at], 0)
    return grams[np.lexsort((grams, late))[: n - (4 * n + 4) // 5 + 1]] if n else grams


def parity(grams: np.ndarray) -> np.ndarray:
    """Whether the number of shingles of each residue is odd, 64 residues a long; there are at least twice as many as shingles, a power of two."""
    size = max(64, 1 << max(0, 2 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """The same of ``SHORT`` longs at most, which rules out less for long sets, never more."""
    while len(bits) > SHORT:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _near(x: str, y: str) -> str:
    """SQL: whether the parities x and y of sets of n and m shingles allow that these are alike.

    A residue's parity is that of the two that the next finer division makes of it, so the longer one is folded; sizes that allow it
    at all make lengths of a factor of two at most.
    """
    folded = lambda a: f"zip_with(slice({a}, 1, size({a}) div 2), slice({a}, size({a}) div 2 + 1, size({a}) div 2), (p, q) -> p ^ q)"
    bits = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"9 * CASE WHEN size({x}) = size({y}) THEN {bits(x, y)} WHEN size({x}) > size({y}) THEN {bits(folded(x), y)} ELSE {bits(x, folded(y))} END <= n + m"


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 4/5 of two ascending sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def halves(grams: np.ndarray) -> np.ndarray:
    """The upper 32 bits, by which shingles are counted and joined: equal halves of different ones only make a candidate more."""
    return (grams >> np.uint64(32)).astype(np.uint32)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the shingles that most rows have, ascending, and how many rows have each."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [halves(g) for g in map(shingles, b.column("text").to_pylist())]
            found, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int32)), pa.array(n.astype(np.int64))], ["half", "n"])
        release()

    counts = stored(docs.select("text").mapInArrow(each, "half int, n long").groupBy("half").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "halves")
    # whole counts from the highest down, as far as they stay within the bound
    cut, size = 1 << 62, 0
    for step, n in sorted(((r["s"], r["n"]) for r in counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True):
        size += n
        if size > FREQUENT:
            break
        cut = step
    rows = counts.where(F.floor(F.log2("n") * 16) >= cut).toPandas()
    discard(counts)
    half, n = rows["half"].to_numpy(np.int32).view(np.uint32), rows["n"].to_numpy(np.int64)
    order = np.argsort(half)
    return half[order], n[order]


def sets(docs: DataFrame) -> DataFrame:
    """tk (key of the text), fp (node), sim (SimHash fingerprint), n, first (prefix), bits (parity) and short (the same, folded) of every row."""
    frequent, rank = _frequent(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            grams = list(map(shingles, texts))
            bits = list(map(parity, grams))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("tk"),
                    pa.array(np.fromiter(map(key, grams), np.uint64, len(grams)).view(np.int64)),
                    pa.array(np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(grams)).view(np.int64)),
                    pa.array([len(g) for g in grams], pa.int32()),
                    pa.array([halves(prefix(g, frequent, rank)).view(np.int32) for g in grams], pa.list_(pa.int32())),
                    pa.array(bits, pa.list_(pa.int64())),
                    pa.array(list(map(folded, bits)), pa.list_(pa.int64())),
                ],
                ["tk", "fp", "sim", "n", "first", "bits", "short"],
            )
        release()

    return docs.select(text_key(F.col("text")).alias("tk"), "text").mapInArrow(each, "tk long, fp long, sim long, n int, first array<int>, bits array<long>, short array<long>")


FITS = "5 * least(n, m) >= 4 * greatest(n, m)"
#: Sizes that allow it, and enough shingles left from the shared one on (true at the first that two linked sets share).
LEFT = f"{FITS} AND 9 * least(n - at, m - other_at) >= 4 * (n + m)"


def possible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out. signs: fp, n and bits, each node once."""
    left, right = signs.select(F.col("fp").alias("a"), "n", F.col("bits").alias("x")), signs.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(f"{FITS} AND {_near('x', 'y')}").select("a", "b")


def whole_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """fp and grams of texts that may have one of the needed nodes. needed: fp, tk (of one text that has the node)."""
    holds = key_filter(needed, "tk")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.filter(pa.array(holds(b.column("tk").to_numpy()))).column("text")
            if len(texts):
                grams = [shingles(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(key, grams), np.uint64, len(grams)).view(np.int64)), pa.array([g.tobytes() for g in grams], pa.binary())], ["fp", "grams"])
        release()

    return docs.select(text_key(F.col("text")).alias("tk"), "text").mapInArrow(each, "fp long, grams binary")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by place: each place's sets (a, grams), then its pairs (a, b). Pairs that earlier links connect are skipped."""
    place, sets, parent = None, {}, {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for batch in batches:
        left, right = [], []
        for p, a, b, grams in zip(*(batch.column(c) for c in ("place", "a", "b", "grams")), strict=True):
            p, a, b = p.as_py(), a.as_py(), b.as_py()
            if p != place:
                place, sets, parent = p, {}, {}
            if b is None:
                sets[a] = np.frombuffer(grams.as_py(), np.uint64)
            elif root(a) != root(b) and alike(sets[a], sets[b]):
                parent[root(a)] = root(b)
                left.append(a)
                right.append(b)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
    release()


def verified(pairs: DataFrame, docs: DataFrame, signs: DataFrame) -> DataFrame:
    """Links (a, b) among distinct, :func:`possible` pairs of nodes that connect all those of them that are alike; pairs is a stored table.

    Pairs meet by their component, so that a whole set goes to few places; a component's nodes are cut into cells of about ``CELL``,
    and each pair of cells is a place.
    """
    roots = stored(connected(pairs), "roots")
    cells = roots.groupBy("root").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    celled = roots.join(cells, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"))
    first, second = celled.toDF("a", "root", "x"), celled.select("node", "cell").toDF("b", "y")
    met = pairs.join(first, "a").join(second, "b").select("a", "b", F.concat_ws("-", "root", F.least("x", "y"), F.greatest("x", "y")).alias("place"))
    met = stored(met, "met")
    wanted = stored(met.select("place", F.col("a").alias("fp")).union(met.select("place", "b")).distinct(), "wanted")
    needed = signs.select("fp", "tk").join(wanted.select(F.col("fp").alias("k")).distinct(), F.col("fp") == F.col("k"), "left_semi")
    whole = whole_sets(docs, stored(needed, "needed")).groupBy("fp").agg(F.first("grams").alias("grams"))
    sets = whole.join(wanted, "fp").select("place", F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.unionByName(met.withColumn("grams", F.lit(None).cast("binary"))).repartition(n, "place").sortWithinPartitions("place", F.col("b").asc_nulls_first())
    out = stored(rows.select("place", "a", "b", "grams").mapInArrow(_verify, "a long, b long"), "links")
    discard(roots, met, wanted)
    return out


def near_pairs(table: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints SimHash links."""
    prints = table.select("sim", "fp").distinct()
    least = stored(prints.groupBy("sim").agg(F.min("fp").alias("rep")), "prints")
    equal = prints.join(least, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(least.select(F.col("sim").alias("fp")))
    named = lambda name: least.select(F.col("sim").alias(name), F.col("rep").alias(f"r{name}"))
    linked = near.join(named("a"), "a").join(named("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return equal.union(linked).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _longs(bits: str) -> list[Column]:
    """Parities of ``SHORT`` longs at most as a column for each, zero beyond their number, which is ``longs``: lambdas would be slow for every pair."""
    return [F.size(bits).alias("longs"), *(F.coalesce(F.get(bits, F.lit(k)), F.lit(0)).alias(f"p{k}") for k in range(SHORT))]


def _near_longs(other: str) -> str:
    """SQL: the same as :func:`_near` of two such parities, the second with the prefix ``other``."""
    folded = lambda size, k: " ^ ".join(f"{side}p{j}" for side in ("", other) for j in range(k, SHORT, size))
    bits = lambda size: " + ".join(f"bit_count({folded(size, k)})" for k in range(size))
    whens = " ".join(f"WHEN least(longs, {other}longs) = {1 << k} THEN {bits(1 << k)}" for k in reversed(range(SHORT.bit_length())))
    return f"9 * (CASE {whens} END) <= n + m"


def mains(rooted: DataFrame) -> DataFrame:
    """Of each shingle (gram) its largest root (main), and to how many places its entries are dealt."""
    counts = rooted.groupBy("gram", "root").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
    return counts.select("gram", "main", F.ceil((F.col("all") - F.col("most")) * F.col("all") / MEET).cast("int").alias("places"))


def across(rooted: DataFrame, mains: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes of different roots that share a shingle, so far as sizes, places and parities allow.

    Of each shingle, only entries outside of its largest root meet all others, so that pairs of one root that are looked at are never more
    than those of different ones; entries of a frequent shingle meet in several places. They are shuffled, not broadcast, as they are many
    times as large in memory as in their files, by whose size Spark would decide.
    """
    placed = rooted.join(mains, "gram")
    left = placed.where("root <> main").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    right = placed.select(
        F.col("gram").alias("g"), F.pmod(F.xxhash64("fp"), F.col("places")).cast("int").alias("other_place"), F.col("fp").alias("other"), F.col("n").alias("m"), F.col("at").alias("other_at"),
        F.col("root").alias("other_root"), *(F.col(c).alias(f"other_{c}") for c in ("longs", *(f"p{k}" for k in range(SHORT)))),
    )
    met = F.expr(f"root <> other_root AND (other_root = main OR fp < other) AND {LEFT} AND {_near_longs('other_')}")
    pairs = left.join(right.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("place") == F.col("other_place")) & met)
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def links(table: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes alike; table as :func:`sets` gives it, stored."""
    signs = stored(table.groupBy("fp").agg(F.min("tk").alias("tk"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("short").alias("short")), "signs")
    dealt = Window.partitionBy("gram").orderBy(F.xxhash64("fp", "gram"), "fp")
    entries = table.groupBy("fp").agg(F.first("n").alias("n"), F.first("first").alias("first")).select("fp", "n", F.posexplode("first").alias("at", "gram"))
    own = F.struct(F.col("fp").alias("other"), F.col("n").alias("m"), F.col("at").alias("other_at"))
    entries = entries.select("gram", "fp", "n", "at", F.lag(own, 1).over(dealt).alias("before"), F.lag(own, 2).over(dealt).alias("earlier"), F.lead("fp").over(dealt).alias("after"))
    # shingles of one node only have nothing to connect
    entries = stored(entries.where("before IS NOT NULL OR after IS NOT NULL").drop("after"), "entries")
    near = entries.where("before IS NOT NULL").select("fp", "n", "at", F.explode(F.array("before", "earlier")).alias("o")).select("fp", "n", "at", "o.*").where(LEFT)
    near = near.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    pairs = stored(possible(near.union(near_pairs(table)).distinct(), signs), "pairs")
    first = verified(pairs, docs, signs)
    roots = stored(connected(first), "roots")
    rooted = entries.join(roots, F.col("fp") == F.col("node"), "left").select("gram", "fp", "n", "at", F.coalesce("root", "fp").alias("root"))
    # shingles of one group only have nothing to connect
    several = rooted.groupBy("gram").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("gram")
    rooted = stored(rooted.join(several, "gram", "left_semi").join(signs.select("fp", *_longs("short")), "fp"), "rooted")
    largest = stored(mains(rooted), "mains")
    met = stored(across(rooted, largest), "across")
    rest = stored(possible(met.join(pairs, ["a", "b"], "left_anti"), signs), "pairs")
    out = first.union(verified(rest, docs, signs))
    discard(signs, entries, pairs, roots, rooted, largest, met, rest)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of texts alike, with the columns of docs.

    Texts decide, not ids. Only rows that may share their group are shuffled.
    """
    table = stored(sets(docs), "sets")
    edges = stored(links(table, docs), "links")
    grouped = table.groupBy("fp").agg(F.count("*").alias("rows"))
    roots = grouped.join(connected(edges), F.col("fp") == F.col("node"), "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    several = roots.groupBy("root").agg(F.sum("rows").alias("rows")).where("rows > 1").select(F.col("root").alias("several"))
    shared = roots.join(several, F.col("root") == F.col("several")).select(F.col("fp").alias("node"), "root")
    keys = stored(table.join(shared, F.col("fp") == F.col("node")).groupBy("tk").agg(F.min("root").alias("__nd_root")), "keys")
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__nd_tk", text_key(F.col("text")))
    marked = marked.withColumn("__nd_maybe", filter_column(key_filter(keys, "tk"), F.col("__nd_tk")))
    rows = marked.where("__nd_maybe").join(keys, F.col("__nd_tk") == F.col("tk"), "left")
    alone = marked.where("NOT __nd_maybe").select(*names).unionByName(rows.where("__nd_root IS NULL").select(*names))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit("")), *[c.cast("string") for c in names])
    first = rows.where("__nd_root IS NOT NULL").groupBy("__nd_root").agg(F.min_by(F.struct(*names), order).alias("__nd_row")).select("__nd_row.*")
    discard(table, edges, roots)
    return alone.unionByName(first)
