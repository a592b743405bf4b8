"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good, votes bad or abstains. Expectation-maximisation over the counts of
vote patterns (at most 3**rules, whatever the corpus) estimates, without labels, how often each rule votes what on good and on bad
texts; the posterior probability of *good* then replaces the usual demand that every rule passes.

The model takes rules as independent given the class. The two on symbols are not: they measure one kind of junk twice (by characters and
by words), so that it is corroborated; with one of them alone it would be outvoted by the rules that it passes.

Defined results: a null text counts as empty, has no words and fails the base checks; a posterior of exactly one half is good; a very long
text is looked at whole, in memory of several times its length; an empty table gives an empty result; repeated rows each get their own
(equal) result; extra columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release
from .textstats import text_stats

#: name, share to look at, bad above (None: the rule never votes bad), good below.
RULES = (
    ("symbols", lambda s: s["n_symbols"] / max(1, s["word_chars"]), 0.08, 0.02),
    ("symbols_per_word", lambda s: s["n_symbols"] / max(1, s["n_words"]), 0.35, 0.05),
    ("upper_case", lambda s: s["n_upper"] / max(1, s["n_letters"]), 0.5, 0.2),
    ("exclamations", lambda s: s["n_bangs"] / max(1, s["n_words"]), 0.3, 0.05),
    ("menu_bars", lambda s: s["n_pipes"] / max(1, s["n_words"]), 0.15, 0.02),
    ("repeated_windows", lambda s: s["n_repeat_words"] / max(1, s["n_words"]), 0.35, 0.1),
    ("same_word_twice", lambda s: s["n_adjacent"] / max(1, s["n_words"]), 0.2, 0.05),
    ("repeated_lines", lambda s: s["n_dup_lines"] / max(1, s["n_lines"]), 0.6, 0.1),
    ("word_length", lambda s: abs(math.log(max(1, s["word_chars"]) / max(1, s["n_words"]) / 5.5)), 0.75, 0.4),
    ("unended_lines", lambda s: 1 - s["n_ended_lines"] / max(1, s["n_lines"]), None, 0.5),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def votes(stats: dict[str, int]) -> str:
    """One letter a rule: g good, b bad, a abstains. A text without words makes every rule abstain."""
    if not stats["n_words"]:
        return "a" * len(RULES)
    out = []
    for _, share, bad, good in RULES:
        x = share(stats)
        out.append("b" if bad is not None and x > bad else "g" if x < good else "a")
    return "".join(out)


@dataclass(frozen=True)
class LabelModel:
    """prior: probability of good. table[rule][vote] = log odds that this vote adds for good."""

    prior: float
    table: list[dict[str, float]]
    accuracy: list[float]

    def posterior(self, pattern: str) -> float:
        x = math.log(self.prior / (1 - self.prior)) + sum(t[v] for t, v in zip(self.table, pattern, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def column(self, pattern: Column) -> Column:
        """The same posterior as a column expression."""
        x = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, t in enumerate(self.table):
            v = F.substring(pattern, k + 1, 1)
            x = x + F.when(v == "g", F.lit(t["g"])).when(v == "b", F.lit(t["b"])).otherwise(F.lit(t["a"]))
        return 1 / (1 + F.exp(-x))


def fit(counts: dict[str, int], rounds: int = 60, smooth: float = 1.0) -> LabelModel:
    """EM for two classes with rules that are independent given the class; starts from 'a bad vote means bad'.

    A rule's accuracy is how often its votes are right; abstaining says nothing about the text.
    """
    m = len(RULES)
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    is_vote = np.array([[[p[k] == v for v in "gb"] for k in range(m)] for p in patterns], float).reshape(-1, m, 2)
    good = np.array([0.02 if "b" in p else 0.98 for p in patterns])
    for _ in range(rounds):
        a, b = n * good, n * (1 - good)
        prior = float(np.clip((a.sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        on_good, on_bad = (np.einsum("p,pkv->kv", w, is_vote) + smooth for w in (a, b))
        right = (on_good[:, 0] + on_bad[:, 1]) / (on_good.sum(1) + on_bad.sum(1))
        odds = np.log(on_good / on_good.sum(1, keepdims=True)) - np.log(on_bad / on_bad.sum(1, keepdims=True))
        x = math.log(prior / (1 - prior)) + np.einsum("kv,pkv->p", odds, is_vote)
        good = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    return LabelModel(prior, [{"g": float(g), "b": float(b), "a": 0.0} for g, b in odds], list(map(float, right)))


def _examined(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in batches:
        rows = []
        for t in text:
            s = text_stats(t)
            rows.append((*(s[k] for k in BASE), votes(s)))
        yield pd.DataFrame(rows, columns=[*BASE, "pattern"])
    release()


def examine(text: Column) -> Column:
    """Struct of the base counts and the vote pattern of a whole text."""
    return F.pandas_udf(_examined, "struct<n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern string>")(text)


def pattern_counts(examined: DataFrame, column: str) -> dict[str, int]:
    """At most 3**rules rows, whatever the input."""
    rows = examined.groupBy(F.col(column).alias("p")).agg(F.count("*").alias("n")).collect()
    return {r["p"]: r["n"] for r in rows}


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
