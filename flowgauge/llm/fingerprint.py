"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

The terms of a text are its words (A-Z count as a-z) weighted by how often they occur.  For each of ``SAMPLES`` samples k
and each term with weight w, a hash of (term, k) gives r and c from the Gamma(2, 1) distribution and b uniform in (0, 1);

    t = floor(ln w / r + b),    ln a = ln c - r * (t - b + 1)

and the term with the smallest a is the sample, named by (term, t).  Two texts have the same sample with a probability of
sum(min(w)) / sum(max(w)), their generalised Jaccard similarity, so the share of equal samples estimates it.

What keeps it cheap: a is exponential with rate w, so the smallest is far below 12 / sum(w) but for a chance of e^-12,
and the uniforms behind r and c give a bound of a without a logarithm.  Terms for which that is already above
12 / sum(w) are passed over before any logarithm; on long texts those are most of them.

Texts are shuffled once, by document.  Words are counted and sampled inside that partitioning, without a further
shuffle.  The next document is found on ids alone: they are dealt out by ranges, each range looks ahead in itself, and
one row per range tells where the next one begins.

Defined cases: a null text is empty; an empty text has one reserved term, so empty texts are alike and unlike others; a
null doc_id comes last; rows with equal doc_id are ordered by the hash of their text; equal rows give equal results, one
per row, and count once in the order; a document alone is its own next; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLES, GROUP = 64, 16
LEAST_CHANCE = 12.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW_32 = (1 << 32) - 1
KEY = ["key", "text_hash"]


def words_of(text: Column) -> Column:
    """Runs of signs other than blank and \\x09-\\x0D, A-Z as a-z."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+"), "")


def _seeded(term: Column, seed: int) -> Column:
    """One 64-bit hash of a term for each seed."""
    return F.xxhash64(term.bitwiseXOR(F.lit((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 63))))


def _bits(h: Column, start: int, count: int) -> Column:
    """``count`` bits of a hash from bit ``start`` on, as a double."""
    moved = F.shiftrightunsigned(h, start) if start else h
    return moved.bitwiseAND(F.lit((1 << count) - 1)).cast("double")


def sample(k: int, term: Column, weight: Column, log_weight: Column, total: Column) -> Column:
    """ln a in the upper and the name of (term, t) in the lower half of a number; null where a cannot be the smallest.

    One hash has b and the first 12 bits of the four uniforms behind r and c.  That is enough for a bound, as
    c >= q + q^2 / 2 with q = 1 - u3 u4, and exp(-r (t - b + 1)) >= u1 u2 / w, which for w = 1, where t is 0, is sharpened
    by x^s >= x / (x + s (1 - x)) for x = u1 u2 and s = 1 - b.  A second hash has 16 more bits of each uniform.
    """
    h = _seeded(term, 2 * k)
    first = [_bits(h, start, 12) for start in (52, 40, 28, 16)]
    b = (_bits(h, 0, 16) + 0.5) * F.lit(2.0**-16)
    more = _seeded(term, 2 * k + 1)
    u1, u2, u3, u4 = ((a + (_bits(more, 16 * i, 16) + 0.5) * F.lit(2.0**-16)) * F.lit(2.0**-12)
                      for i, a in enumerate(first))
    r, c = -F.log(u1 * u2), -F.log(u3 * u4)
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b + 1)
    place = F.floor((F.greatest(F.lit(-60.0), F.least(F.lit(60.0), log_a)) + 64) * F.lit(float(1 << 24)))
    name = F.xxhash64(term, t, F.lit(k)).bitwiseAND(F.lit(_LOW_32))
    a1, a2, a3, a4 = first
    x = a1 * a2 * F.lit(2.0**-24)
    q = 1 - (a3 + 1) * (a4 + 1) * F.lit(2.0**-24)
    x = F.when(weight == 1, x / (x + (1 - b) * (1 - x))).otherwise(x)
    return F.when((q + q * q * 0.5) * x * total <= LEAST_CHANCE * weight, F.shiftleft(place, 32).bitwiseOR(name))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def as_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, part, marks) for a table (keys, text) that is already partitioned by (some of) the keys."""
    words = texts.select(*keys, words_of(F.col("text")).alias("words"))
    terms = (words.select(*keys, F.greatest(F.size("words"), F.lit(1)).cast("double").alias("total"),
                          F.explode_outer("words").alias("word"))
             .select(*keys, "total", F.coalesce(F.xxhash64("word"), F.lit(0)).alias("term")))
    counted = (terms.groupBy(*keys, "total", "term").agg(F.count("*").cast("double").alias("weight"))
               .withColumn("log_weight", F.log("weight")))
    # sixteen samples are one aggregate of a size that is still compiled; each group has hashes of its own
    grouped = (counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(samples // GROUP - 1))))
               .withColumn("term", F.xxhash64("term", "part")))
    columns = [F.min(sample(k, *map(F.col, ("term", "weight", "log_weight", "total")))).alias(f"s{k}")
               for k in range(GROUP)]
    # a sample all of whose terms were passed over is named by the whole bag, so that only equal texts share it
    columns.append(F.bit_xor(F.xxhash64("term", "weight")).alias("bag"))
    # names of 32 bits, kept as signed numbers of that size
    marks = F.array(*[(F.coalesce(F.col(f"s{k}"), F.xxhash64("bag", F.lit(k))).bitwiseAND(F.lit(_LOW_32)) - F.lit(1 << 31))
                      .cast("int") for k in range(GROUP)])
    return grouped.groupBy(*keys, "part").agg(*columns).select(*keys, "part", marks.alias("marks"))


def joined(which: Column) -> Column:
    """The aggregate that puts the parts of the rows for which ``which`` holds together."""
    parts = F.array_sort(F.collect_list(F.when(which, F.struct("part", "marks"))))
    return F.flatten(F.transform(parts, lambda p: p["marks"]))


def _order() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("text_hash").asc()]


def followers(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, key, text_hash, ...) with next_key and next_hash, the next row in descending doc_id."""
    ranged = written(ids.repartitionByRange(*_order()).withColumn("range", F.spark_partition_id()), "id-ranges")
    inside = Window.partitionBy("range").orderBy(*_order())
    here = F.struct("key", "text_hash")
    ahead = ranged.withColumns({"ahead": F.lead(here).over(inside), "place": F.row_number().over(inside)})
    # one row per range
    heads = ahead.where("place = 1").select("range", here.alias("head"))
    after = Window.orderBy("range")
    everything = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding,
                                                                          Window.unboundedFollowing)
    heads = written(heads.select("range", F.coalesce(F.lead("head").over(after), F.first("head").over(everything))
                                 .alias("next_head")), "range-heads")
    found = F.coalesce("ahead", "next_head")
    return (ahead.join(heads, "range").withColumn("found", found)
            .withColumns({"next_key": F.col("found.key"), "next_hash": F.col("found.text_hash")})
            .drop("range", "ahead", "place", "next_head", "found"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The edited form has the last floor(n / 2) code points replaced by the first as many (or all) of the next document.
    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    ids = written(rows.groupBy("doc_id", *KEY, F.char_length("text").alias("n")).agg(F.count("*").alias("copies")), "ids")
    chain = written(followers(ids), "chain")

    # one shuffle of the texts, which both sides of the join below read; equal rows become one before they meet others, by
    # an aggregate that Spark knows to give the same each time, as otherwise it would not read one shuffle twice
    dealt = rows.select(*KEY, "text").repartition(parts, *KEY).groupBy(*KEY).agg(F.max("text").alias("text"))
    givers = chain.select(F.col("next_key").alias("key"), F.col("next_hash").alias("text_hash"),
                          F.col("key").alias("to_key"), F.col("text_hash").alias("to_hash"), "n")
    heads = (dealt.join(givers, KEY)
             .select(F.col("to_key").alias("key"), F.col("to_hash").alias("text_hash"), "n",
                     F.expr("substring(text, 1, n div 2)").alias("head"))
             .repartition(parts, *KEY))
    edited = F.concat(F.expr("substring(text, 1, cast(n - n div 2 as int))"), "head")
    both = dealt.join(heads, KEY).select(*KEY, "text", edited.alias("edited"))
    sides = both.select(*KEY, F.posexplode(F.array("text", "edited")).alias("side", "text"))
    marks = fingerprints(sides, [*KEY, "side"], samples)
    pairs = marks.groupBy(*KEY).agg(joined(F.col("side") == 0).alias("own"), joined(F.col("side") == 1).alias("changed"))
    digests = both.select(*KEY, F.unhex(F.sha2("edited", 256)).alias("edited_sha256"))
    # all rows of a key are in one partition here, so what the chain says of it is joined before anything is written
    found = written(pairs.join(digests, KEY).join(chain, KEY), "fingerprints")
    ahead = found.select(F.col("key").alias("next_key"), F.col("text_hash").alias("next_hash"), F.col("own").alias("next_own"))
    return (found.join(ahead, ["next_key", "next_hash"])
            .select("doc_id", F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
                    as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                    likeness(F.col("own"), F.col("next_own")).alias("near_next"), "copies")
            .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies"))
