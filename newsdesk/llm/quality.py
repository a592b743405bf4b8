"""Quality classifier by Bradley-Terry pairwise ranking.

Documents labelled good and bad are paired at random; logistic regression on the *differences* of their features learns the worth
of a text, so that a good text beats a bad one. The decision threshold is a quantile of the scores of the labelled sample, and the
worth is mapped to (0, 1) so that this quantile lies at ``CUT``. Only the text is looked at.

Features are shares of a few counts, and the square roots of the shares of word shapes (runs of letters, digits and of each other
character, hashed into ``SHAPES`` buckets), whose weights are learnt alone; shapes are the same in every language.

The labelled sample is bounded by ``MAX_LABELLED`` rows (those whose ids hash lowest, however many there are); every document is scored.

Defined results: a null text counts as empty and is scored like any other; labels that are null or whose document is missing are
ignored, and repeated labels of one document count once (the lowest); of documents that share a labelled id the one with the least
features is learnt from; without labels of both kinds every text scores ``CUT``; equal texts have equal scores; a very long text is
looked at whole, in memory of several times its length; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release
from .textstats import text_stats

MAX_LABELLED = 20_000
PAIRS = 60_000
CUT = 0.3
SHAPES = 64
_KINDS = bytes(b"a"[0] if chr(b).isalpha() or b > 127 else b"0"[0] if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def shapes(text: str | None) -> np.ndarray:
    """Square roots of the shares of word shapes by bucket."""
    out = np.zeros(SHAPES)
    found = Counter(_RUNS.sub(rb"\1", (text or "").encode("utf-8", "surrogatepass").translate(_KINDS)).split())
    for shape, n in found.items():
        out[zlib.crc32(shape) % SHAPES] += n
    return np.sqrt(out / max(1, found.total()))


def features(text: str | None) -> list[float]:
    s = text_stats(text)
    w, c = max(1, s["n_words"]), max(1, s["word_chars"])
    letters, lines = max(1, s["n_letters"]), max(1, s["n_lines"])
    ramp = lambda x, low, high: min(1.0, max(0.0, (x - low) / (high - low)))
    return [
        ramp(s["n_symbols"] / w, 0.02, 0.4),
        ramp(s["n_symbols"] / c, 0.005, 0.1),
        ramp(s["n_upper"] / letters, 0.15, 0.5),
        ramp(s["n_bangs"] / w, 0.02, 0.3),
        ramp(s["n_pipes"] / w, 0.01, 0.2),
        ramp(s["n_repeat_words"] / w, 0.1, 0.5),
        ramp(s["n_adjacent"] / w, 0.03, 0.25),
        ramp(s["n_dup_lines"] / lines, 0.1, 0.5),
        ramp(s["n_digits"] / c, 0.02, 0.3),
        ramp(abs(math.log(c / w / 5.5)), 0.3, 0.9),
        ramp(1 - s["n_ended_lines"] / lines, 0.5, 1.0),
        ramp(s["n_commas"] / w, 0.0, 0.1),
        1 - ramp(s["n_distinct"] / w ** 0.8, 0.2, 1.0),
        ramp(-math.log(w), -math.log(60), -math.log(3)),
        float(s["n_words"] == 0),
        *shapes(text),
    ]


@dataclass(frozen=True)
class Ranker:
    weights: list[float]
    threshold: float
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        worth = x @ np.array(self.weights) if len(x) else np.zeros(0)
        z = self.scale * (worth - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 11) -> Ranker:
    """Newton steps on the mean logistic loss of feature differences of (good, bad) pairs, with a ridge."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker([0.0] * (x.shape[1] if x.ndim == 2 else len(features(""))), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    worth = x @ w
    # the quantile that parts the labelled sample best, half-way between the two scores beside it
    levels = np.unique(np.quantile(worth, np.linspace(0, 1, 401)))
    cuts = (levels[:-1] + levels[1:]) / 2 if len(levels) > 1 else levels
    right = [((worth[good] >= t).mean() + (worth[bad] < t).mean()) for t in cuts]
    best = np.flatnonzero(np.isclose(right, max(right)))
    return Ranker([float(v) for v in w], float(cuts[best[len(best) // 2]]), 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield text.map(features, na_action=None)
    release()


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learn from the labelled documents that are not held out; at most ``MAX_LABELLED`` rows reach the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("__nd_quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    vector = F.pandas_udf(_vectors, "array<double>")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", vector("text").alias("x"), "__nd_quality")
    got = sorted((r["doc_id"], r["__nd_quality"], r["x"]) for r in rows.groupBy("doc_id", "__nd_quality").agg(F.min("x").alias("x")).collect())
    if not got:
        return fit(np.zeros((0, len(features("")))), np.zeros(0))
    return fit(np.array([r[2] for r in got]), np.array([r[1] for r in got]))


def score(text: Column, ranker: Ranker) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(ranker.scores(np.array([features(x) for x in t]).reshape(len(t), -1)) if len(t) else [], dtype=float)
        release()

    return F.pandas_udf(each, "double")(text)
