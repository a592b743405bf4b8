"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint takes the majority of each bit over the XXH64 values of its three-word shingles. Distinct fingerprints are put
in tiles by the population counts of their four 16-bit lanes. The Hamming distance of two fingerprints is never below the sum of
the differences of these counts, so only tile pairs within the radius are compared, and all of those exactly: numpy exclusive-or and
bit counts. Tiles are cut into chunks of about ``CHUNK`` fingerprints, so that no task gets an unbounded tile. From each pair of
chunks only a spanning forest of its links goes on, which connects what all its links would connect. Components are found with
the alternating large-star and small-star steps on a forest of each partition's edges, a stored table each round.

Defined results: a null or blank text has fingerprint zero and is linked like any other; ties of a bit's votes give 0; a very long text
is looked at whole, in memory of several times its length; repeated rows and equal texts share a fingerprint and each row is returned;
a row with a null id gets its component's smallest id, null if all its members' ids are null; an empty table gives an empty result;
extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release
from .shared import discard, join_hot, stored

RADIUS = 2
CHUNK = 2048
LANES = 4
WORDS = 3
#: Edges that a task contracts at once: a memory bound.
FOREST = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < WORDS else map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def _tile(fp: Column) -> Column:
    """The lanes' population counts (0 to 16 each), as one number of base 32."""
    out = F.lit(0)
    for k in range(LANES):
        out = out + F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) * (32**k)
    return out.cast("int")


def _steps(radius: int) -> list[int]:
    """Differences of tile numbers within the radius, one of each opposite pair, and zero."""
    near = [d for d in product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, d)) <= radius and d >= (0,) * LANES]
    return [sum(x * 32**k for k, x in enumerate(d)) for d in near]


def forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[list[int], list[int]]:
    """Indices (into a and b) of links that span all pairs within the radius; same: a and b are one chunk."""
    parent = list(range(len(a) if same else len(a) + len(b)))
    shift = 0 if same else len(a)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a), step):
        close = np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(close)), strict=True):
            i += k
            if same and i >= j:
                continue
            x, y = root(i), root(j + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(i)
                right.append(j)
    return left, right


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the radius. distinct: fp, each value once."""
    tiled = distinct.select("fp", _tile(F.col("fp")).alias("tile"))
    # at most 17**LANES tiles
    counts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = tiled.join(F.broadcast(counts), "tile").select("tile", "fp", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
    packed = stored(chunked.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps")), "tiles")
    there = F.broadcast(packed.groupBy("tile").agg(F.count("*").cast("int").alias("chunks")))
    left = (
        packed.select(F.col("tile").alias("from_tile"), F.col("chunk").alias("from_chunk"), F.col("fps").alias("left"), F.explode(F.array(*map(F.lit, _steps(radius)))).alias("step"))
        .withColumn("tile", F.col("from_tile") + F.col("step"))
        .join(there, "tile")
        .withColumn("chunk", F.explode(F.sequence(F.when(F.col("step") == 0, F.col("from_chunk")).otherwise(0), F.col("chunks") - 1)))
    )
    # each pair's arrays meet where they are compared, in as many tasks as asked for, however few bytes they are
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(n, "tile", "chunk"), packed.repartition(n, "tile", "chunk")
    pairs = left.join(right, ["tile", "chunk"]).select("left", F.col("fps").alias("right"), ((F.col("step") == 0) & (F.col("from_chunk") == F.col("chunk"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist(), strict=True):
                a, b = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                i, j = forest(a, b, same, radius)
                if i:
                    yield pa.RecordBatch.from_arrays([pa.array(a[i].view(np.int64)), pa.array(b[j].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, u) from each node to the smallest of its component in every ``FOREST`` edges."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        v, u = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("v", "u"))
        nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        a, b = at[: len(v)], at[len(v) :]
        label = np.arange(len(nodes))
        while True:  # labels fall to the neighbours' smallest, then to their label's label
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label < np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["v", "u"])

    for b in batches:
        if size + b.num_rows > FOREST and held:
            yield stars()
            held, size = [], 0
        held.append(b)
        size += b.num_rows
    if held:
        yield stars()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (smallest node of its component) for every node of an edge (a, b).

    As soon as ``FOREST`` edges are left at most, one task contracts them all.
    """
    star = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v")
    star = stored(star.mapInArrow(_forest, "v long, u long").distinct(), "star")
    before = None
    for _ in range(rounds):
        n = star.count()
        if n <= FOREST:
            last = stored(star.coalesce(1).mapInArrow(_forest, "v long, u long"), "star")
            discard(star)
            star = last
            break
        # large star: each node's larger neighbours move to its smallest neighbour
        both = star.select(F.col("u").alias("n"), F.col("v").alias("m")).union(star.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = stored(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"), F.count("*").alias("degree")), "least")
        large = stored(join_hot(both, least, "n", "degree").where("m > n").select(F.col("m").alias("v"), F.col("r").alias("u")).mapInArrow(_forest, "v long, u long").distinct(), "large")
        # small star: each node and its smaller neighbours move to the smallest of them
        near = stored(large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("r"), F.count("*").alias("degree")), "near")
        moved = join_hot(large.select(F.col("v").alias("n"), "u"), near, "n", "degree")
        new = stored(moved.where("u <> r").select(F.col("u").alias("v"), F.col("r").alias("u")).union(near.select(F.col("n").alias("v"), F.col("r").alias("u"))).distinct(), "star")
        discard(star, least, large, near)
        star = new
        now = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("v").alias("node"), F.col("u").alias("root")).union(star.select("u", "u").distinct())


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links) and root (the component's smallest fingerprint) of every row."""
    prints = stored(fingerprints(docs), "prints")
    smallest = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    edges = stored(links(smallest.select("fp"), radius), "links")
    roots = connected(edges)
    linked = smallest.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root")
    joint = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(joint, "root").select(F.col("fp").alias("linked_fp"), F.col("component_id").alias("joint_id"), "root")
    ids = smallest.join(moved, F.col("fp") == F.col("linked_fp"), "left").select("fp", "copies", F.coalesce("joint_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return join_hot(prints, stored(ids, "ids"), "fp", "copies").select("doc_id", "fp", "component_id", "root")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
