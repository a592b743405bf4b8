"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A text's sketch holds every hash of its five-word shingles that lies below a threshold, and that threshold: a fixed fraction of the hash
range, raised only as far as needed for a sketch to hold ``LEAST`` hashes (up to the whole range, where a text has no more). All hashes
below the smaller of two sketches' thresholds are known in both, so the share of one found in the other estimates containment even between
very unequal texts, and :func:`merge` gives exactly the sketch of two shingle sets' union. An estimate c from n hashes has a
standard error of about sqrt(c (1 - c) / n), 6 % at most for two sketches of ``LEAST`` hashes. The hash is the first 32 bits of the
shingle's MD5 in hexadecimal, so its order is that of its digits.

Defined results: a null text counts as empty; a text without words has one empty shingle, fewer words than a shingle make one
shingle; equal texts have equal sketches; a very long text's sketch holds about a sixteenth of its shingles; the likeness of two sketches
that have no hash to compare is 0 (its basis is 0 as well); an empty table gives an empty result; repeated ids are ordered by the text's
hash and the text; null ids come first; extra columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = 5
#: Hashes below these digits are always kept: a sixteenth of the range.
BELOW = "10000000"
#: So many hashes a sketch holds at least, if its text has them.
LEAST = 64
#: The threshold above all hashes.
ALL = "g"
GAP = "[\\x20\\x09-\\x0D]+"


def _tight(hashes: Column, below: Column) -> Column:
    """The sketch from sorted distinct hashes of which all that lie below ``below`` are known."""
    bound = F.when(F.size(hashes) > LEAST, F.greatest(F.lit(BELOW), hashes[LEAST])).otherwise(below)
    return F.struct(bound.alias("below"), F.filter(hashes, lambda h: h < bound).alias("hashes"))


def sketch(text: Column) -> Column:
    """struct<below string, hashes array<string>>: the threshold, and the sorted distinct hashes below it."""

    def of_words(words: Column) -> Column:
        last = F.greatest(F.size(words) - (WORDS - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, WORDS), " ").cast("binary")), 1, 8))
        return F.transform(F.array(hashes), kept)[0]

    def kept(hashes: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < BELOW)))
        return F.transform(F.array(F.struct(hashes.alias("all"), low.alias("low"))), chosen)[0]

    def chosen(x: Column) -> Column:
        # with more hashes below the fraction than a sketch must have, the others needn't be sorted
        rest = F.transform(F.array(F.sort_array(F.array_distinct(x["all"]))), lambda h: _tight(h, F.lit(ALL)))[0]
        return F.when(F.size(x["low"]) > LEAST, F.struct(F.lit(BELOW).alias("below"), x["low"].alias("hashes"))).otherwise(rest)

    # a one-element array binds its element to a lambda variable, so that the words are split once and not for each shingle
    return F.transform(F.array(F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")), of_words)[0]


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sketches' shingle sets."""
    below = F.least(a["below"], b["below"])
    both = F.sort_array(F.array_union(F.filter(a["hashes"], lambda h: h < below), F.filter(b["hashes"], lambda h: h < below)))
    return F.transform(F.array(F.struct(both.alias("h"), below.alias("t"))), lambda x: _tight(x["h"], x["t"]))[0]


def compare(a: Column, b: Column) -> Column:
    """struct<basis long, near double>: hashes of the smaller side that can be compared, and the share of them that the other side has."""
    below = F.least(a["below"], b["below"])
    known = lambda x: F.filter(x["hashes"], lambda h: h < below)

    def of(x: Column) -> Column:
        n = F.least(F.size(x["a"]), F.size(x["b"]))
        return F.struct(n.cast("long").alias("basis"), F.when(n > 0, F.size(F.array_intersect(x["a"], x["b"])) / n).otherwise(0.0).alias("near"))

    return F.transform(F.array(F.struct(known(a).alias("a"), known(b).alias("b"))), of)[0]


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller of two sketches in the larger, 0 to 1."""
    return compare(a, b)["near"]


def fingerprint(kept: Column) -> Column:
    """The threshold and the hashes, eight hexadecimal digits each (the threshold above all hashes is ``ALL``)."""
    return F.concat(kept["below"], F.array_join(kept["hashes"], ""))


def _at_or_below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are at most x; two short searches instead of one long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= x))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(F.slice(F.lit(bounds), (coarse - 1) * step + 1, step), lambda b: b <= x)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text and sketch of every row, and next_text, next_sketch of the row after it by id (after the last: the first).

    Rows are dealt by ranges of ids, and each range also gets the first rows of the one after it, so only neighbours within a
    range are looked at. An id (or the lack of one) that many rows share is a range of its own, cut further by the texts' hashes. The
    ranges' bounds, some numbers a range, are all that reaches the driver.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ask = [k / parts for k in range(1, parts)]
    got = texts.agg(F.percentile_approx("doc_id", ask, 10_000).alias("p") if ask else F.lit(None).cast("array<bigint>").alias("p"), F.count("*").alias("n"), F.count("doc_id").alias("known")).collect()[0]
    quantiles = sorted(b for b in got["p"] or [] if b is not None)
    often = {b: quantiles.count(b) for b in quantiles if bisect_left(quantiles, b + 1) - bisect_left(quantiles, b) > 1}
    bounds = sorted({*quantiles, *(b + 1 for b in often)})
    # range 0: no id; range k + 1: ids from bounds[k - 1] up to below bounds[k]; each is cut into so many parts
    cuts = [max(1, -(-parts * (got["n"] - got["known"]) // max(1, got["n"]))), 1, *(often.get(b, 0) + 1 if b in often else 1 for b in bounds)]
    offsets = [sum(cuts[:k]) for k in range(len(cuts))]
    keyed = texts.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 33)).withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(1 + _at_or_below(bounds, F.col("doc_id"))))
    many = F.get(F.lit(cuts), F.col("range"))
    part = F.get(F.lit(offsets), F.col("range")) + F.when(many > 1, F.shiftright(F.col("h") * many, 31)).otherwise(0)
    ranged = keyed.withColumn("part", part.cast("int"))
    firsts = {r["part"]: r["low"] for r in ranged.groupBy("part").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "h")).alias("low")).collect()}
    order = sorted(firsts)
    before = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))
    by_part = lambda f: F.get(F.lit([f(k) for k in range(sum(cuts))]), F.col("part"))
    is_first = (F.coalesce("doc_id", F.lit(-(2**63))) == by_part(lambda k: firsts[k]["id"] if k in firsts else 0)) & (F.col("h") == by_part(lambda k: firsts[k]["h"] if k in firsts else -1))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("is_guest"))
    guest = F.struct(by_part(lambda k: before.get(k, 0)).cast("int").alias("part"), F.lit(True).alias("is_guest"))
    dealt = ranged.select("doc_id", "text", "h", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    rows = dealt.select("doc_id", "text", "h", "at.part", "at.is_guest").repartitionById(sum(cuts), F.col("part")).withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("part").orderBy("is_guest", "doc_id", "h", "text")
    return rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w)).where(~F.col("is_guest")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def compared(docs: DataFrame) -> DataFrame:
    """Each text's sketch beside that of its edited text (the last quarter replaced by the next text's start) and the next text's.

    near_edited_basis and near_next_basis are the numbers of hashes that the likenesses rest on.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = with_next(docs, parts).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    done = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    done = done.withColumn("e", compare(F.col("sketch"), F.col("edited_sketch"))).withColumn("x", compare(F.col("sketch"), F.col("next_sketch")))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("e.near").alias("near_edited"), F.col("x.near").alias("near_next"), F.col("e.basis").alias("near_edited_basis"), F.col("x.basis").alias("near_next_basis"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
    SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text,
        length(text) // 4 AS quarter FROM d
), e AS (
    SELECT doc_id, text, next_text, length(text) AS n_chars, substring(text, 1, length(text) - quarter) || substring(next_text, 1, quarter) AS edited FROM n
), texts AS (
    SELECT DISTINCT t FROM (SELECT text AS t FROM e UNION ALL SELECT edited FROM e)
), w AS (
    SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts
), h AS (
    SELECT t, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(words) - 4, 1)), lambda i: substring(md5(array_to_string(words[i:i + 4], ' ')), 1, 8)))) AS hashes FROM w
), s AS (
    SELECT t, hashes, CASE WHEN len(hashes) > 64 THEN greatest('10000000', hashes[65]) ELSE 'g' END AS below FROM h
), f AS (
    SELECT t, below, list_filter(hashes, lambda x: x < below) AS k FROM s
), p AS (
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a.below || array_to_string(a.k, '') AS fingerprint, b.below || array_to_string(b.k, '') AS edited_fingerprint,
        list_filter(a.k, lambda x: x < b.below) AS ab, list_filter(b.k, lambda x: x < a.below) AS ba, list_filter(a.k, lambda x: x < c.below) AS ac, list_filter(c.k, lambda x: x < a.below) AS ca
    FROM e JOIN f a ON e.text = a.t JOIN f b ON e.edited = b.t JOIN f c ON e.next_text = c.t
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, least(len(ab), len(ba)) AS near_edited_basis, least(len(ac), len(ca)) AS near_next_basis,
    CASE WHEN least(len(ab), len(ba)) > 0 THEN len(list_intersect(ab, ba))::DOUBLE / least(len(ab), len(ba)) ELSE 0 END AS near_edited,
    CASE WHEN least(len(ac), len(ca)) > 0 THEN len(list_intersect(ac, ca))::DOUBLE / least(len(ac), len(ca)) ELSE 0 END AS near_next
FROM p
"""
