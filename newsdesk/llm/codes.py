"""Vector codes: product quantisation in whole numbers, each vector's parts assigned by partial-distance search.

Components become floor(1024 * x) and a vector is cut into equal parts, each with a codebook of its own. A part's nearest entry is sought
over the dimensions in descending variance of the codebook: distances are summed a dimension at a time for all parts of a batch and all
entries that are left, and an entry is dropped once its sum is strictly above the complete distance of the best entry known, so that ties
stay until the end and go to the lowest index. The entry that looks best after 1, 2, 4, ... dimensions is completed to tighten the bound.

Codebooks are learnt by Lloyd's rounds: tasks sum their parts by entry, Spark adds the sums up, and the driver has the codebooks alone.
All is whole-number arithmetic, so results don't depend on the table's layout.

Defined results: null vectors and vectors with null or non-finite components are left out, as are vectors of another length than that of
the smallest id; lengths that the number of parts doesn't divide give the first parts a component more; rows without an id come last, ties
of an id are ordered by vector, repeated rows count again; fewer rows than entries make smaller codebooks; an empty table gives an empty
result; extra columns don't matter. Components beyond 2 ** 14 are an error, as their sums leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import release
from .shared import join_hot, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: The largest component that 64 bits can add up the squares of.
LARGEST = 1 << 14
#: Distances that a task holds at once: a memory bound.
CELLS = 1 << 20

Books = list[np.ndarray]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (ties: the lowest) and the squared distance, of each row of ``x``; whole numbers."""
    step = max(1, CELLS // len(book))
    found = [_search(x[k : k + step], book) for k in range(0, len(x), step)]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, d = x.shape
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    # (row, entry, sum so far) of what is left, by row and entry
    row, entry, total = np.repeat(np.arange(n), len(book)), np.tile(np.arange(len(book)), n), np.zeros(n * len(book), np.int64)
    best = np.full(n, np.iinfo(np.int64).max)
    for k in range(d):
        total = total + (x[row, k] - book[entry, k]) ** 2
        if k & (k + 1) == 0 and k + 1 < d:
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])  # every row has an entry left
            least = np.minimum.reduceat(total, first)
            at = np.flatnonzero(total == least[row])
            at = at[np.concatenate([[True], np.diff(row[at]) > 0])]
            whole = total[at] + ((x[:, k + 1 :] - book[entry[at], k + 1 :]) ** 2).sum(1)
            best = np.minimum(best, whole)
        left = total <= best[row]
        row, entry, total = row[left], entry[left], total[left]
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    least = np.minimum.reduceat(total, first)
    at = np.flatnonzero(total == least[row])
    at = at[np.concatenate([[True], np.diff(row[at]) > 0])]
    return entry[at], least


def whole(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and v (whole numbers) of the rows that have all components."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fits = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = F.exists(x, lambda c: F.abs(c) > LARGEST)
    v = F.when(far, F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("array<long>")).otherwise(F.transform(x, lambda c: F.floor(c * SCALE)))
    return rows.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def started(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, Books]:
    """The rows of one length, and the codebooks of the first of them by id; the driver gets ``entries`` vectors."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).select("v").take(1)
    if not first:
        return kept, []
    alike = kept.where(F.size("v") == len(first[0]["v"]))
    rows = alike.orderBy(*order).select("v").take(entries)
    seed = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(first[0]["v"]))
    return alike, np.array_split(seed, parts, axis=1)


def _vectors(batch: pa.RecordBatch, books: Books) -> list[np.ndarray]:
    d = sum(b.shape[1] for b in books)
    flat = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, d)
    return np.split(flat, np.cumsum([b.shape[1] for b in books])[:-1], axis=1)


def improved(kept: DataFrame, books: Books) -> Books:
    """The codebooks after a round: each entry the floored mean of the parts nearest to it, as before if there are none."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums, counts = [np.zeros_like(b) for b in own], [np.zeros(len(b), np.int64) for b in own]
        for batch in batches:
            for p, x in enumerate(_vectors(batch, own)):
                at, _ = nearest(x, own[p])
                np.add.at(sums[p], at, x)
                counts[p] += np.bincount(at, minlength=len(own[p]))
        rows = [(p, e) for p in range(len(own)) for e in np.flatnonzero(counts[p])]
        columns = [pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()), pa.array([counts[p][e] for p, e in rows], pa.int64()), pa.array([sums[p][e] for p, e in rows], pa.list_(pa.int64()))]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])
        release()

    by_task = kept.select("v").mapInArrow(each, "part int, entry int, n long, sums array<long>")
    # the counts go first, as a component of their own
    spread = by_task.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
    out = [b.copy() for b in books]
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for r in spread.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # as many as the codebooks have components
        totals.setdefault((r["part"], r["entry"]), {})[r["at"]] = int(r["x"])
    for (p, e), x in totals.items():
        out[p][e] = [x[k + 1] // x[0] for k in range(out[p].shape[1])]
    return out


def trained(kept: DataFrame, books: Books, rounds: int = ROUNDS) -> Books:
    for _ in range(rounds):
        books = improved(kept, books)
    return books


def encoded(kept: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, codes (an entry's index for each part) and error (the squared distance from these entries)."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, book) for x, book in zip(_vectors(batch, shared.value), shared.value, strict=True)]
            codes = np.stack([at for at, _ in found], 1) if found else np.zeros((batch.num_rows, 0), np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), rows, pa.array(sum(far for _, far in found))], ["vec_id", "label", "codes", "error"])
        release()

    label = dict(kept.dtypes)["label"]
    return kept.mapInArrow(each, f"vec_id long, label {label}, codes array<int>, error long")


def digest(books: Books) -> str:
    """sha256 of all components by part, entry and place, in decimal, separated by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, Books]:
    """vec_id, label, codes, error and label_error (the sum over equal labels, nulls together) of every kept row, and the codebooks."""
    kept = stored(whole(rows, vector), "vectors")
    alike, books = started(kept)
    if not books:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    books = trained(alike, books)
    done = stored(encoded(alike, books).withColumn("__nd_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    errors = stored(done.groupBy("__nd_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__nd_n")), "errors")
    return join_hot(done, errors, "__nd_label", "__nd_n").select("vec_id", "label", "codes", "error", "label_error"), books


_PARTS = """
x{k} AS (
    SELECT r, p, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) ** 2))::BIGINT, 'e': e}}) AS m FROM parts JOIN c{k} USING (p) GROUP BY r, p
)"""
_ROUND = """
u{k} AS (
    SELECT p, m.e AS e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM x{k} JOIN parts USING (r, p), (SELECT unnest(generate_series(1, (SELECT any_value(dp) FROM size))) AS j) GROUP BY ALL
), w{k} AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM u{k} GROUP BY p, e
), c{k1} AS (
    SELECT p, e, coalesce(w{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN w{k} USING (p, e)
)"""

ORACLE = (
    """
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size AS (
    SELECT len(v) // 4 AS dp FROM kept LIMIT 1
), parts AS (
    SELECT r, p, v[p * dp + 1 : (p + 1) * dp] AS v FROM kept, size, (SELECT unnest([0, 1, 2, 3]) AS p)
), c0 AS (
    SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 256
),"""
    + ",".join(_PARTS.format(k=k) + "," + _ROUND.format(k=k, k1=k + 1) for k in range(ROUNDS))
    + ","
    + _PARTS.format(k=ROUNDS)
    + f""",
codes AS (
    SELECT r, string_agg(printf('%02x', m.e::INTEGER), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM x{ROUNDS} GROUP BY r
), books AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), books
"""
)
