"""Quality rules whose cutoffs come from labelled holdouts with a guarantee on false rejection.

Each rule is a score of a text and rejects texts whose score is above a cutoff.  The cutoffs of a rule are tried from the
mildest to the strictest in every stratum (language).  A cutoff is certified if, of n labelled good documents of the
stratum, so few are rejected that a false rejection rate above the rule's share of ``alpha`` would show so few with a
probability of at most the rule's share of ``delta`` divided by the number of strata, by the exact binomial distribution.
Testing stops at the first cutoff that fails, so no further correction is needed inside a rule (fixed sequence); the
division by rules and strata corrects for testing many of them (weighted Bonferroni).  With probability 1 - delta all
certified cutoffs of all strata together keep false rejections within alpha.  As that holds for all of them at once, any
may be chosen: the one that rejects most labelled bad documents, each good one counting as ``GOOD_WEIGHT`` bad ones, and
the mildest of equals.  A rule without a certified cutoff, and a stratum without labels, rejects nothing.

Base checks come first: texts of fewer than 20 words, or of which more than 30 % of the words repeat, always fail.

Defined cases: a null or empty text has no words and fails the base check; a null language is a stratum of its own;
rows with equal doc_id are judged one by one; of repeated labels the lowest quality counts and null labels are ignored;
an empty table gives no rows; without labels only the base checks hold; other columns are ignored, or kept by
``keep_good``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, free_name, mix64, slices, tidied_call, utf8, written

ALPHA, DELTA = 0.05, 0.1
GOOD_WEIGHT = 5
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: Cutoffs of each rule, mildest first.
CUTOFFS = {
    "symbols": [round(0.5 * 0.85**k, 6) for k in range(28)],
    "repeats": [round(0.3 * 0.85**k, 6) for k in range(20)],
    "duplicate_lines": [round(0.9 * 0.85**k, 6) for k in range(20)],
    "long_words": [round(30 * 0.93**k, 6) for k in range(24)],
}
#: What part of alpha and of delta a rule may use up.
SHARE = {"symbols": 0.4, "repeats": 0.2, "duplicate_lines": 0.2, "long_words": 0.2}
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """FIELDS for each text."""
    words = Words(texts)
    bounds, first = words.text_starts, words.first
    n = len(texts)
    letters = (words.symbols & 0xC0) != 0x80
    in_word = np.zeros(len(words.symbols) + 1, dtype=np.int8)
    in_word[words.starts] = 1
    in_word[words.ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    owner = np.repeat(np.arange(n), np.diff(first))
    repeated = np.zeros(len(words.hashes), dtype=bool)
    windows = words.windows(WINDOW)
    whole = np.flatnonzero(owner[: len(windows)] == owner[WINDOW - 1 :]) if len(windows) else np.empty(0, dtype=np.int64)
    if len(whole):
        keys = mix64(windows[whole] + owner[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        found = whole[counts[inverse] > 1]
        cover = np.zeros(len(repeated) + 1, dtype=np.int64)
        cover[found] += 1
        np.subtract.at(cover, found + WINDOW, 1)
        repeated = np.cumsum(cover[:-1]) > 0
    lines = [[x for x in t.split(b"\n") if x.split(None, 1)] for t in texts]
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(letters & in_word, bounds),
        "n_symbols": _per_text(_SYMBOL[words.symbols], bounds),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": _per_text(repeated, first),
        "n_lines": np.array([len(x) for x in lines], dtype=np.int64),
    }


def _measured(texts: pa.Array) -> pa.Array:
    parts = [measure(some) for some in slices(utf8(texts))]
    none = np.empty(0, dtype=np.int64)
    columns = [pa.array(np.concatenate([none, *(p[f] for p in parts)]).astype(np.int64)) for f in FIELDS]
    return pa.StructArray.from_arrays(columns, names=list(FIELDS))


def measures(text: Column) -> Column:
    """A struct of FIELDS for a text column."""
    return F.arrow_udf(tidied_call(_measured), ", ".join(f"{f} long" for f in FIELDS))(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEAT_PERCENT)


def scores(m: Column) -> dict[str, Column]:
    """The rule scores; the larger, the worse."""
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "symbols": m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
        "repeats": m["n_repeat_words"] / words,
        "duplicate_lines": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "long_words": m["word_chars"] / words,
    }


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(n: int, rejected: list[int], alpha: float, level: float) -> int:
    """How many cutoffs from the mildest on are certified, given how many of n good documents each rejects."""
    for i, k in enumerate(rejected):
        # k only grows, and beyond the mean the test has failed without a sum over many terms
        if k > n * alpha or tail(k, n, alpha) > level:
            return i
    return len(rejected)


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, from the measures of labelled documents (stratum, m, good).

    What reaches the driver is one count per stratum, rule, cutoff and label.
    """
    def passed(name: str, score: Column) -> Column:
        return sum((F.when(score > c, 1).otherwise(0) for c in CUTOFFS[name]), F.lit(0))

    rules = F.array(*[F.struct(F.lit(name).alias("rule"), passed(name, score).alias("passed"))
                      for name, score in scores(F.col("m")).items()])
    counted = (labelled.where(~base_failed(F.col("m"))).select("stratum", "good", F.inline(rules))
               .groupBy("stratum", "rule", "passed", "good").agg(F.count("*").alias("n")).collect())
    strata = {r["stratum"] for r in counted}
    out: dict[str, dict[str, float]] = {s: {} for s in strata}
    for stratum, rule in {(r["stratum"], r["rule"]) for r in counted}:
        mine = [r for r in counted if (r["stratum"], r["rule"]) == (stratum, rule)]
        n = sum(r["n"] for r in mine if r["good"])
        # cutoffs fall, so a text that is above ``passed`` of them is above the last ones
        size = len(CUTOFFS[rule])
        rejected = {good: [sum(r["n"] for r in mine if r["good"] == good and r["passed"] >= size - k)
                           for k in range(size)] for good in (True, False)}
        k = certified(n, rejected[True], alpha * SHARE[rule], delta * SHARE[rule] / len(strata))
        worth = [bad - GOOD_WEIGHT * good for good, bad in zip(rejected[True], rejected[False], strict=True)][:k]
        if worth and max(worth) > 0:
            out[stratum][rule] = CUTOFFS[rule][worth.index(max(worth))]
    return out


def stratum_of(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def rejected_by(m: Column, stratum: Column, cutoffs: dict[str, dict[str, float]]) -> Column:
    """The names of the rules that reject a text."""
    named = []
    for name, score in scores(m).items():
        pairs = [x for s, by in cutoffs.items() if name in by for x in (F.lit(s), F.lit(by[name]))]
        if pairs:
            named.append(F.when(score > F.coalesce(F.create_map(*pairs)[stratum], F.lit(float("inf"))), F.lit(name)))
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def _holdout(labels: DataFrame) -> DataFrame:
    return (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
            .agg((F.min("quality") == 1).alias("good")))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, FIELDS, base_failed, rejected_by, kept) for every row."""
    m = F.col("m")
    rows = written(docs.select("doc_id", stratum_of(F.col("lang")).alias("stratum"), measures(F.col("text")).alias("m")),
                   "measures")
    cutoffs = choose_cutoffs(rows.join(_holdout(labels), "doc_id"), alpha, delta)
    out = rows.select("doc_id", *[m[f].alias(f) for f in FIELDS], base_failed(m).alias("base_failed"),
                      rejected_by(m, F.col("stratum"), cutoffs).alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns.

    One pass measures all texts for the cutoffs and a second one, which decides, measures them in place: rows and
    their texts are never shuffled (a join of labelled ids to texts before measuring would shuffle them).
    """
    rows = docs.select("doc_id", stratum_of(F.col("lang")).alias("stratum"), measures(F.col("text")).alias("m"))
    cutoffs = choose_cutoffs(rows.join(_holdout(labels), "doc_id"), alpha, delta)
    name = free_name(docs, "_measures")
    m = F.col(name)
    bad = base_failed(m) | (F.size(rejected_by(m, stratum_of(F.col("lang")), cutoffs)) > 0)
    return docs.withColumn(name, measures(F.col("text"))).where(~bad).drop(name)
