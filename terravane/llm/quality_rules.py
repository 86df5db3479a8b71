"""Quality rules by weak supervision, in DataFrame operations only.

Ten rules look at counts of a text; each votes good (1), bad (-1) or abstains (0). Votes are counted by pattern
(at most 3**10 rows, whatever the corpus), and expectation-maximisation over that table estimates how each rule votes
on good texts and on each kind of junk: its accuracies. A kind of junk is what several rules ought to notice
(KINDS), so a rule whose bad votes the others share becomes trusted and one whose bad votes stand alone does not: a
lone weak vote is outweighed by the good ones, several together are not. Rules are taken to be better than chance, as
weak supervision needs it to tell classes apart: a rule's share of bad votes is half at least on its own kinds
and half at most on good texts; within that, the votes decide. An abstaining rule says nothing. A text is
kept if its posterior probability of being good reaches a threshold.

Edge cases: a null text counts as empty; an empty text has no words and fails the base rules; a null
doc_id stays null; repeated rows give repeated results; an empty table gives an empty result; further
columns of the input are ignored. Window counts compare 64-bit hashes of the three words.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, words

#: Kinds of junk, with the rules that ought to notice each.
KINDS = {
    "markup": ("symbols", "clean", "short", "ends"),
    "shouting": ("upper", "bangs", "clean"),
    "gibberish": ("length", "clean", "short"),
    "repetition": ("repeats", "dup_lines", "distinct"),
}
#: Before any text is seen: the share of good texts, and of bad votes on good texts, by a kind's own rules and by others.
GOOD, ALARMS, OWN, OTHER = 0.8, 0.02, 0.7, 0.1
#: A word of letters, with a mark behind it or not.
CLEAN = "^[\\p{L}\\p{M}][\\p{L}\\p{M}'’-]*[.,;:!?]?$"


def counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The counts that the rules read, one row per document; whole: with the document's row as struct doc."""
    keep = ["doc"] if whole else []
    t = docs.select("doc_id", *([F.struct("*").alias("doc")] if whole else []), F.coalesce("text", F.lit("")).alias("t"))
    t = t.select(
        "doc_id", *keep, "t", words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    ).withColumn("clean", F.filter("w", lambda x: x.rlike(CLEAN)))
    t = t.select(
        "doc_id", *keep, F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!")))).cast("long").alias("n_bangs"),
        (F.size(F.split("t", "[.?!](?=[\\x20\\x09-\\x0D]|$)", -1)) - 1).cast("long").alias("n_ends"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("clean").cast("long").alias("n_clean"),
        F.size(F.filter("clean", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        F.transform(
            F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        ).alias("g"),
    )
    # Most texts repeat no window; only the others sort theirs.
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    at = F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))
    t = t.withColumn("s", F.when(repeats, F.array_sort(at)).otherwise(F.slice(at, 1, 0))).drop("g")
    twice = F.filter(
        "s", lambda x, k: F.get("s", k - 1)["g"].eqNullSafe(x["g"]) | F.get("s", k + 1)["g"].eqNullSafe(x["g"])
    )
    t = t.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))),
        F.lit(0), lambda total, x: total + x,
    )
    return t.withColumn("n_repeat_words", covered.cast("long")).drop("p")


def rules() -> dict[str, Column]:
    """The votes. Limits: (bad from, good up to) or the reverse."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))

    def low(x: Column, good: float, bad: float) -> Column:
        return F.when(x >= bad, -1).when(x <= good, 1).otherwise(0)

    def high(x: Column, good: float, bad: float) -> Column:
        return F.when(x <= bad, -1).when(x >= good, 1).otherwise(0)

    length = F.col("word_chars") / n
    spaced = length <= 12  # else the script may have no spaces between words
    return {
        "symbols": low(F.col("n_symbols") / n, 0.02, 0.1),
        "clean": F.when(spaced, high(F.col("n_clean") / n, 0.9, 0.7)).otherwise(0),
        "short": F.when(spaced, high(F.col("n_short") / n, 0.12, 0.05)).otherwise(0),
        "ends": high(F.col("n_ends") / n, 0.03, 0.01),
        "upper": low(F.col("n_upper") / F.greatest("word_chars", F.lit(1)), 0.12, 0.3),
        "bangs": low(F.col("n_bangs") / n, 0.05, 0.2),
        "length": F.when((length < 3) | (length > 12), -1).when(length.between(3.5, 9), 1).otherwise(0),
        "repeats": low(F.col("n_repeat_words") / n, 0.1, 0.3),
        "dup_lines": low(F.col("n_dup_lines") / lines, 0.1, 0.3),
        "distinct": high(F.col("n_distinct") / F.sqrt(n), 4, 2.5),  # the words of long texts repeat more
    }


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"v_{k}": v.cast("byte") for k, v in rules().items()})


class Model(NamedTuple):
    """weight: the share of each class ("good" or a kind of junk); bad: of class and rule, the share of bad votes among its votes."""

    weight: dict[str, float]
    bad: dict[str, dict[str, float]]

    def posterior(self) -> Column:
        """The probability of being good, from the columns v_<rule>."""
        score = {}
        for c, w in self.weight.items():
            score[c] = F.lit(log(w))
            for k, p in self.bad[c].items():
                v = F.col(f"v_{k}")
                score[c] = score[c] + F.when(v == -1, log(p)).when(v == 1, log(1 - p)).otherwise(0.0)
        top = F.greatest(*score.values())
        return F.exp(score["good"] - top) / sum((F.exp(x - top) for x in score.values()), F.lit(0.0))


def start() -> Model:
    names = list(rules())
    junk = {c: {k: OWN if k in own else OTHER for k in names} for c, own in KINDS.items()}
    return Model({"good": GOOD} | dict.fromkeys(KINDS, (1 - GOOD) / len(KINDS)), {"good": dict.fromkeys(names, ALARMS)} | junk)


def fit(voted: DataFrame, rounds: int = 200, strength: float = 20.0) -> Model:
    """Expectation-maximisation over the counted vote patterns, of which the driver gets 3**10 rows at most.

    The start values count as so many texts of each class (strength), so that small tables stay near them and no
    probability is zero. An empty table leaves the start values.
    """
    first, names = start(), list(rules())
    pattern = sum(((F.col(f"v_{k}") + 1) * 3**i for i, k in enumerate(names)), F.lit(0).cast("long"))
    rows = sorted((r.pattern, r.n) for r in voted.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not rows:
        return first
    seen = np.array([[x // 3**i % 3 - 1 for i in range(len(names))] for x, _ in rows])
    n = np.array([float(m) for _, m in rows])
    bad, good = (seen == -1).astype(float), (seen == 1).astype(float)
    w0, p0 = np.array(list(first.weight.values())), np.array([list(x.values()) for x in first.bad.values()])
    own = np.array([[k in KINDS.get(c, ()) for k in names] for c in first.weight])
    w, p = w0, p0
    for _ in range(rounds):
        score = np.log(w) + bad @ np.log(p).T + good @ np.log(1 - p).T
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share *= (n / share.sum(axis=1))[:, None]
        sums, of = share.T @ bad, share.T @ (bad + good)
        new_p = (sums + strength * p0) / (of + strength)
        new_p[0] = np.minimum(new_p[0], 0.5)
        new_p[own] = np.maximum(new_p[own], 0.5)
        new_w = share.sum(axis=0) + strength * w0
        new_w /= new_w.sum()
        change = max(abs(new_w - w).max(), abs(new_p - p).max())
        w, p = new_w, new_p
        if change < 1e-9:
            break
    classes = list(first.weight)
    return Model(dict(zip(classes, w.tolist())), {c: dict(zip(names, x)) for c, x in zip(classes, p.tolist())})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(voted: DataFrame, least: float) -> DataFrame:
    scored = voted.withColumns({"base_failed": base_failed(), "quality": fit(voted).posterior()})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, the votes, base_failed, quality (posterior) and kept for every document."""
    return _judged(cut(votes(counts(docs))), least)


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that pass, with all their columns.

    Votes are taken twice, once to fit and once to filter: that moves and stores no text. The row number is not
    deterministic, which keeps the filter above the counts; within them it would have them computed again for each use.
    """
    voted = votes(counts(docs, whole=True)).withColumn("row", F.monotonically_increasing_id())
    return _judged(voted, least).filter(F.col("kept") & (F.col("row") >= 0)).select("doc.*")
