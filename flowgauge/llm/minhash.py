"""Near-duplicate groups by MinHash: universal hash minima, banding, verification, connected components.

1. One pass over the texts gives, for each document, the size of its shingle set, a digest of the set and the minima of
   many universal hash functions over it.
2. Documents with the same set are one node (their smallest id); a group of exact copies costs one row per copy.
3. Minima are cut into bands; nodes that agree in a band meet in a bucket.  The members of a bucket are compared with its
   smallest one, and confirmed pairs are joined into components.
4. What is left are nodes that share a bucket with another component.  A node that has many shingles no other such node
   has cannot be linked with texts of the sizes it meets, whatever they hold, and leaves.  The others get many more minima
   in longer bands, which only pairs near the threshold share, and are put in groups of similar sets.  A node of another
   component than most of its band meets the groups of that band, up to 64 sets as one row, never pair by pair.
5. A pair is first compared by its signatures, with a margin of several standard deviations, then by the full sets.
6. Components are found by alternating large-star and small-star steps until nothing changes.

A pair at the threshold of 0.75 is missed by the 40 bands of 4 minima with probability 2.5e-7, and by the 440 bands of 12,
if it comes to them, with probability 7e-7; more similar pairs are missed far less often.

Defined cases: a null text is empty; a document without words is linked with nothing; rows with a null doc_id are linked
with nothing and kept; rows with equal doc_id and different texts are nodes of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Words, id_text, marked, mix64, slices, tidied, utf8, written
from .setgroups import grouped, met_links

SHINGLE = 5
BANDS, BAND_ROWS = 40, 4
FINE_BANDS, FINE_ROWS = 440, 12


def text_shingles(texts: Iterable[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z; a text of fewer words is one shingle."""
    out = []
    for some in slices(t.lower() for t in texts):
        words = Words(some)
        windows = words.windows(size)
        for a, b in zip(words.first, words.first[1:], strict=False):
            if b - a >= size:
                out.append(np.unique(windows[a : b - size + 1]))
            else:
                short = words.hashes[a:b]
                # the number of words is part of the hash, so short sequences never equal a shingle
                steps = np.arange(3, 2 * len(short) + 3, 2, dtype=np.uint64)
                out.append((short * steps).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)
                           if b > a else np.empty(0, dtype=np.uint64))
    return out


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    return (rng.integers(1, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, size=count, dtype=np.uint64))


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each set the minima of (a * x + b) mod 2^64, its upper 32 bits; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), count), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(*_functions(count), strict=True)):
        out[:, k] = np.minimum.reduceat(flat * a + b, starts)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles)


def signatures(docs: DataFrame, size: int, count: int) -> DataFrame:
    """(doc_id, n_shingles, digest, minima) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = text_shingles(utf8(part.column(1)), size)
                full = [s for s in sets if len(s)]
                found = minima(full, count) if full else np.empty((0, count), dtype=np.int32)
                ends = np.cumsum([0, *(count if len(s) else 0 for s in sets)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], type=pa.int64()),
                     pa.array([set_digest(s) for s in sets], type=pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(found.ravel()))],
                    names=["doc_id", "n_shingles", "digest", "minima"])

    return id_text(docs).mapInArrow(tidied(run), "doc_id long, n_shingles long, digest binary, minima array<int>")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))


def _similar(percent: int, least: int):
    """Whether two texts are similar enough: by at least ``least`` equal minima, and then by their full sets."""
    def run(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for one, other, left, right in zip(_lists(a), _lists(b), _lists(x), _lists(y), strict=True):
            if found := int((one == other).sum()) >= least:
                shared = len(np.intersect1d(left, right, assume_unique=True))
                found = 100 * shared >= percent * (len(left) + len(right) - shared)
            out.append(found)
        return pa.array(out, type=pa.bool_())

    return F.arrow_udf(run, "boolean")


def arrow_lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of long as an Arrow column."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.empty(0, dtype=np.int64), *parts])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """(digest, set) of each row of a table with the one column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = text_shingles(utf8(batch.column(0).slice(at, 256)), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_digest(s) for s in sets], type=pa.binary()), arrow_lists([s.view(np.int64) for s in sets])],
                    names=["digest", "set"])

    return texts.mapInArrow(tidied(run), "digest binary, set array<long>")


def _fine_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bucket, label, group) of the long bands of each (id, set, label, group)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            found = minima([x.view(np.uint64) for x in _lists(part.column(1))], FINE_BANDS * FINE_ROWS)
            keys = found.view(np.uint32).astype(np.uint64).reshape(part.num_rows, FINE_BANDS, FINE_ROWS)
            bucket = np.broadcast_to(np.arange(FINE_BANDS, dtype=np.uint64), keys.shape[:2]).copy()
            for k in range(FINE_ROWS):
                bucket = mix64(bucket + keys[:, :, k])
            each = pa.array(np.repeat(np.arange(part.num_rows), FINE_BANDS))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(each), pa.array(bucket.ravel().view(np.int64)), part.column(2).take(each),
                 part.column(3).take(each)], names=["id", "bucket", "label", "group"])


def _saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written out in a few files per core rather than one per shuffle partition: it is far smaller than the texts."""
    return written(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), name)


def _saved_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written out, and their number and checksum, which the same job counts."""
    seen = Observation()
    watched = edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum"))
    saved = _saved(watched, "components")
    return saved, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b): the smallest id it can reach.

    Large-star: each node points its larger neighbours to the smallest node it knows.  Small-star: likewise its smaller
    neighbours and itself.  Both only take a minimum per node and a join on the node, which adaptive execution splits.
    """
    edges, state = _saved_edges(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                                .where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _saved(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        before = state
        edges, state = _saved_edges(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if state == before:
            # every node now points at the root of its star
            roots = edges.select(F.col("b").alias("id")).distinct().withColumn("label", F.col("id"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots)


class NearDuplicates:
    """Linked documents of a table: 100 * shared shingles >= ``percent`` * all shingles of both.

    A node is a set, named by the row of the smallest document that has it.
    """

    def __init__(self, docs: DataFrame, percent: int = 75, size: int = SHINGLE, bands: int = BANDS,
                 band_rows: int = BAND_ROWS):
        self.docs, self.percent, self.size = docs, percent, size
        self.bands, self.band_rows = bands, band_rows
        self.count = bands * band_rows
        self.rows = written(signatures(docs, size, self.count).withColumn("row", F.monotonically_increasing_id()), "minima")

    def _usable(self) -> DataFrame:
        return self.rows.where("n_shingles > 0 and doc_id is not null")

    def _same_set(self) -> DataFrame:
        """(digest, id, doc_id, copies) of each set; empty sets and null ids have no node."""
        first = self._usable().groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
        return written(first.select("digest", F.col("first.row").alias("id"), F.col("first.doc_id").alias("doc_id"), "copies"),
                       "nodes")

    def _keys(self, nodes: DataFrame) -> DataFrame:
        """(id, buckets) of each node; a row whose set no other has is one, so only the rest is shuffled to find them."""
        keys = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda k: F.xxhash64(
            k, F.slice("minima", k * self.band_rows + 1, self.band_rows)))
        rows = marked(self._usable().select(F.col("row").alias("id"), "digest", "minima"), "digest", nodes.where("copies > 1"))
        keyed = rows.select("id", keys.alias("buckets"), "marked")
        several = keyed.where("marked").join(nodes.select("id"), "id")
        return keyed.where("not marked").unionByName(several).drop("marked")

    def _buckets(self, nodes: DataFrame) -> DataFrame:
        """(bucket, id) of all buckets with at least two nodes."""
        dealt = self._keys(nodes).select("id", F.explode("buckets").alias("bucket"))
        shared = written(dealt.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                         .where("low <> high").select("bucket", "low"), "shared-buckets")
        return written(dealt.join(shared, "bucket").select("bucket", "id", "low"), "buckets")

    def _confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough, by signature and then by full sets."""
        margin = max(0, int(self.count * (self.percent / 100 - 0.25)))
        left = sets.select(F.col("id").alias("a"), F.col("minima").alias("m"), F.col("set").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("minima").alias("n"), F.col("set").alias("y"))
        similar = _similar(self.percent, margin)
        return pairs.join(left, "a").join(right, "b").where(similar("m", "n", "x", "y")).select("a", "b")

    def _sets(self, nodes: DataFrame, ids: DataFrame) -> DataFrame:
        """(id, minima, set) of the nodes that share a bucket."""
        wanted = _saved(nodes.join(ids.distinct(), "id").select("id", "doc_id", "digest"), "wanted")
        near = marked(id_text(self.docs), "doc_id", wanted).where("marked")
        texts = near.join(wanted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
        # rows with equal doc_id can have other texts, so a node's set is known by its digest
        sets = whole_sets(texts.select("text"), self.size).dropDuplicates(["digest"])
        rows = marked(self.rows.select(F.col("row").alias("id"), "minima"), "id", wanted).where("marked")
        # sets are joined by the digest only, so that they are shuffled once
        found = sets.join(rows.join(wanted.select("id", "digest"), "id"), "digest")
        return written(found.select("id", "minima", "set"), "sets")

    def links(self, nodes: DataFrame) -> DataFrame | None:
        """Confirmed pairs of nodes whose components are those of all similar pairs."""
        members = self._buckets(nodes)
        if members.isEmpty():
            return None
        sets = self._sets(nodes, members.select("id"))
        pairs = members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
        found = _saved(self._confirm(pairs, sets), "links")
        labels = _saved(connected_components(found), "labels")
        return found.unionByName(self._across(members.select("bucket", "id"), labels, sets))

    def _limits(self, nodes: DataFrame) -> DataFrame:
        """(id, label, size, most): the largest set that each of the nodes can be linked with.

        |x & y| >= p / (100 + p) * (|x| + |y|) and |x & y| <= |x| - own, where own counts the shingles of x that no other
        of the nodes has, so |y| <= ((100 + p) * (|x| - own) - p |x|) / p.
        """
        own = (nodes.select("id", F.explode("set").alias("shingle")).groupBy("shingle")
               .agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
               .groupBy("id").agg(F.count("*").alias("own")))
        p = self.percent
        most = F.expr(f"({100 + p} * (size - own) - {p} * size) div {p}")
        return _saved(nodes.select("id", "label", F.size("set").cast("long").alias("size")).join(own, "id", "left")
                      .withColumn("own", F.coalesce("own", F.lit(0))).select("id", "label", "size", most.alias("most")),
                      "limits")

    def _in_reach(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """The ids of nodes that can be linked with a text as small as the smallest of one of their buckets."""
        sized = members.join(self._limits(nodes), "id")
        least = sized.groupBy("bucket").agg(F.min("size").alias("least"))
        return _saved(sized.join(least, "bucket").where("most >= least").select("id").distinct(), "left")

    def _across(self, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Confirmed pairs between components that share a bucket."""
        known = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
        split = (known.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other"))
                 .where("one <> other").select("bucket"))
        open_rows = _saved(known.join(split, "bucket"), "open")
        some = marked(sets.select("id", "set"), "id", open_rows).where("marked").drop("marked")
        mine = written(open_rows.select("id", "label").distinct().join(some, "id"), "open-sets")
        members = open_rows.select("bucket", "id")
        left = self._in_reach(members, mine)
        mine = marked(mine, "id", left).where("marked").drop("marked")
        # once more among those that are left, as what others had does not count any more
        limits = self._limits(mine.join(left, "id"))
        near = written(mine.select("id", F.col("set").alias("tokens")).join(limits, "id"), "near-sets")
        groups = grouped(near, self.percent)
        home = groups.select("group", F.explode("sets.id").alias("id"))
        fine = _saved(near.join(home, "id").select("id", "tokens", "label", "group").mapInArrow(
            tidied(_fine_bands), "id long, bucket long, label long, group long"), "fine-buckets")
        # a band with sets of one label has nothing to add; of two labels one has to ask, so the commonest need not
        mixed = (fine.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                 .where("low <> high").select("bucket"))
        fine = _saved(fine.join(mixed, "bucket"), "mixed-buckets")
        counted = fine.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.collect_set("group").alias("groups"))
        bands = (counted.groupBy("bucket").agg(
            F.max_by("label", F.struct("n", "label")).alias("common"),
            F.array_distinct(F.flatten(F.collect_list("groups"))).alias("met")))
        asking = fine.join(bands, "bucket").where("label <> common")
        pairs = (asking.groupBy("id", "group").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"))
                 .select("id", F.col("group").alias("home"), F.explode("met").alias("group")).where("group <> home")
                 .select("id", "group"))
        links = met_links(_saved(pairs, "near-pairs"), near, groups, self.percent)
        return _saved(links.unionByName(groups.select(F.inline("links"))), "links")

    def groups(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) for every row."""
        nodes = self._same_set()
        found = self.links(nodes)
        labelled = nodes.withColumn("label", F.col("id"))
        if found is not None:
            labels = _saved(connected_components(found), "labels")
            labelled = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        # only sets with copies or links need an owner
        several = labelled.groupBy("label").agg(F.min("doc_id").alias("component"), F.sum("copies").alias("n")).where("n > 1")
        owner = _saved(labelled.join(several, "label").select("digest", "component"), "owners")
        usable = F.col("n_shingles") > 0
        out = self.rows.select("doc_id", "n_shingles", F.when(usable, F.col("digest")).alias("digest")).join(
            owner, "digest", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"),
                          F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicate_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    return NearDuplicates(docs, percent).groups()


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without the documents whose group has one with a smaller id; all columns stay.

    Of rows with equal doc_id and different texts all go if one of them has to.
    """
    gone = _saved(near_duplicate_groups(docs, percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
