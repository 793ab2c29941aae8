"""How text filters interact: what each removes alone, after others, and on average over all orders.

Five filters are applied to whole texts (a null text is empty; words are runs of signs other than blank and \\x09-\\x0D):

    A  fewer than 100 words                         D  holds one of # $ % & * |
    B  fewer than 80 distinct words of 100          E  equal to the text of a document with a smaller id
    C  more than 10 capitals A-Z of 100 code points

Each document becomes a truth table over the 32 subsets of filters in one 32-bit word: bit s is set if the document
survives subset s, that is if it fails none of its filters.  How many documents survive each subset is the positional
popcount of the words of a part and label, taken by carry-save adders: three words become a sum and a carry of twice the
weight, by whole arrays, until two words a weight are left.  Counts of tasks are summed by Spark; the report of all 120
orders is arithmetic on 32 counts a part.

No group is ever gathered: a text's first document is the smallest id of its digest, which Spark combines before the
shuffle, and documents meet it by (digest, doc_id), which is as good as unique however many copies a text has.

Defined cases: a null language is the part ''; rows with a null doc_id have no smaller id and never fail E; rows with
equal doc_id count one by one and are no copies of each other; a document is good (toxic) if one of its label rows says
quality = 1 (toxic = 1), and may be both; labels of unknown documents are ignored; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SUBSETS = 1 << len(FILTERS)
GOOD, TOXIC = 1, 2
#: Counters a task holds before it hands them on.
MOST_KEYS = 4096


def text_fails(text: Column) -> list[Column]:
    """Whether a text fails A, B, C, D."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    return [n < MIN_WORDS, F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
            F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * CAPITAL_PERCENT,
            text.rlike("[#$%&*|]")]


def survival_word(fails: list[Column]) -> Column:
    """Bit s is set where no filter of the subset s fails."""
    word = F.lit(-1)
    for k, failed in enumerate(fails):
        without = sum(1 << s for s in range(SUBSETS) if not s >> k & 1)
        word = word.bitwiseAND(F.when(failed, F.lit(without).cast("long").cast("int")).otherwise(F.lit(-1)))
    return word


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, word) of every row; ``label`` adds GOOD and TOXIC."""
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.array(*text_fails(text)).alias("fails")), "filter-fails")
    first = (rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
             .withColumn("first", F.lit(True)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("bad"))
    met = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    label = F.coalesce("good", F.lit(0)) + F.coalesce("bad", F.lit(0))
    fails = [F.col("fails")[k] for k in range(len(FILTERS) - 1)]
    return met.select("part", label.alias("label"), survival_word([*fails, copied]).alias("word"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts = np.zeros(32, dtype=np.int64)
    bits = np.arange(32, dtype=np.uint32)
    weight = 1
    while len(words):
        carries = [words[:0]]
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * n :]])
        for word in words:
            counts += weight * ((word >> bits) & np.uint32(1)).astype(np.int64)
        words = np.concatenate(carries)
        weight *= 2
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], np.ndarray] = {}

    def told() -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in held for _ in range(SUBSETS)], type=pa.string()),
             pa.array(np.repeat(np.array([k for _, k in held], dtype=np.int32), SUBSETS)),
             pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), n)),
             pa.array(np.concatenate([np.empty(0, dtype=np.int64), *held.values()]))],
            names=["part", "label", "subset", "n"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        labels, words = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint32)
        keys = parts.indices.to_numpy().astype(np.int64) * 4 + labels
        order = np.argsort(keys, kind="stable")
        found, starts = np.unique(keys[order], return_index=True)
        names = parts.dictionary.to_pylist()
        for key, mine in zip(found.tolist(), np.split(words[order], starts[1:]), strict=True):
            name = names[key // 4], key % 4
            held[name] = held.get(name, 0) + positional_counts(mine)
        if len(held) > MOST_KEYS:
            yield told()
            held.clear()
    yield told()


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, subset, n): rows of each part and label that survive each subset, zeros included."""
    counted = survival_words(docs, labels).mapInArrow(_counted, "part string, label int, subset int, n long")
    return counted.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def _over_orders(total: Column, k: int) -> Column:
    """What filter k removes, summed over all orders: each subset stands before it in s! (4 - s)! of them."""
    others = len(FILTERS) - 1
    terms = []
    for s in range(SUBSETS):
        if not s >> k & 1:
            ahead = s.bit_count()
            terms.append((total[s] - total[s | 1 << k]) * F.lit(factorial(ahead) * factorial(others - ahead)))
    return sum(terms[1:], terms[0])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there."""
    def labelled(bit: int) -> Column:
        return F.sum(F.when(F.col("label").bitwiseAND(F.lit(bit)) > 0, F.col("n")).otherwise(0))

    by_subset = subset_survivors(docs, labels).groupBy("part", "subset").agg(
        F.sum("n").alias("n"), labelled(GOOD).alias("good"), labelled(TOXIC).alias("toxic"))
    # 32 counts a part
    packed = by_subset.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    arrays = packed.select("part", *[F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic")])
    arrays = arrays.withColumn("by_filter", F.array(*[_over_orders(F.col("n"), k) for k in range(len(FILTERS))]))

    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = (arrays.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))
    ahead = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(ahead.contains(x), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    place = F.instr(F.lit(FILTERS), letter) - 1
    steps = steps.withColumns({"before": before, "place": place}).withColumns(
        {"after": F.expr("before | shiftleft(1, place)"), "alone": F.expr("shiftleft(1, place)"),
         "others": F.expr(f"{SUBSETS - 1} ^ shiftleft(1, place)")})

    def survivors(which: str, subset: str) -> Column:
        return F.get(F.col(which), F.col(subset))

    def removed(which: str) -> Column:
        return survivors(which, "before") - survivors(which, "after")

    failing = F.col("n")[0] - survivors("n", "alone")
    return steps.select(
        "part", "filter_order", "step", letter.alias("filter"), survivors("n", "after").alias("kept"),
        removed("n").alias("removed"), (failing - removed("n")).alias("redundant"),
        (survivors("n", "others") - F.col("n")[SUBSETS - 1]).alias("unique_fails"), removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"), F.get("by_filter", F.col("place")).alias("shapley"))
