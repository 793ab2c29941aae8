"""Documents whose sets of word n-grams have a high Jaccard similarity, by a token-group matrix.

A token is the hash of an n-gram.  Two sets link when 100 * shared >= percent * (tokens of both).

1. Equal sets are one node, found by a digest; what follows is about different sets only.
2. A set that has more than (100 - percent) % of tokens no other set has cannot link.  That is counted first on a quarter
   of the token space, chosen by the token's hash: what is alone there is alone, so no link is lost, and most texts are out
   before their sets are shuffled.  Of the others all tokens are counted.
3. Nodes left are partitioned into groups of similar sets, those with the same smallest token, dealt out further where a
   group grows beyond a number of sets or tokens (see ``setgroups``).  A group is one row: its members' tokens with their
   owners, which together are its token union.  Links inside a group are found where the group is made.
4. The matrix says which groups have a token.  A set meets a group only if they share a token among the rarest
   of both that a link needs (fewer tokens than that cannot be missing), and if sizes are in reach.  First each set meets the
   first group of each of its tokens; sets that got linked share a label.  Then a set meets all groups of its tokens,
   unless the token's sets, or the group's and its own, have one label; of two labels in a token one has to do it, so
   sets of the token's commonest label need not.
5. A set and a group are bounded by the overlap of the set with the group's union, which no member can exceed.  Only
   groups whose bound reaches the threshold are opened: overlaps with each member are counted exactly.
6. Components of the links by alternating stars.

All of it is exact: no chance, no cap.  What can grow is step 4 where many sets share their rarest tokens and yet do not
link: such sets meet a group, that is up to 64 sets, as one row.

Defined cases: a null text is empty; a document without words is linked with nothing; rows with a null doc_id are linked
with nothing and have no component; rows with equal doc_id and different texts are sets of their own, each with the
smallest id it reaches; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, utf8, written
from .minhash import arrow_lists, connected_components, set_digest, text_shingles, whole_sets
from .setgroups import grouped, met_links

SHINGLE, PERCENT = 3, 90
#: One token of so many is counted in the first narrowing.
SPARSE = 4


def token_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, some): the set's size and digest and its tokens in the sparse part of the space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = text_shingles(utf8(part.column(1)), size)
                some = [s[s % np.uint64(SPARSE) == 0].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], type=pa.int64()),
                     pa.array([set_digest(s) for s in sets], type=pa.binary()), arrow_lists(some)],
                    names=["doc_id", "n_shingles", "digest", "some"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, some array<long>")


class NgramJoin:
    """Links between the distinct sets of a table and the components they form."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE):
        self.docs, self.percent, self.size = docs, percent, size
        self.rows = written(token_sets(docs, size), "token-sets")
        some = self.rows.where("n_shingles > 0 and doc_id is not null")
        self.nodes = written(some.groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.count("*").alias("copies"))
            .withColumn("id", F.monotonically_increasing_id()), "token-nodes")

    def _alone(self, size: str) -> str:
        """How many tokens of a set may be in no other set that it links with."""
        return f"(({100 - self.percent} * {size}) div 100)"

    def _candidates(self) -> DataFrame:
        """(id, doc_id, digest, size) of the nodes that the sparse part of the token space leaves.

        Nodes are told apart by 64 bits of the digest here, so that equal sets count as one.
        """
        short = F.xxhash64("digest")
        tokens = self.rows.where("n_shingles > 0 and doc_id is not null").select(short.alias("short"), F.explode("some").alias("token"))
        own = (tokens.groupBy("token").agg(F.min("short").alias("short"), F.max("short").alias("other"))
               .where("short = other").groupBy("short").agg(F.count("*").alias("own")))
        return written(self.nodes.withColumn("short", short).join(own, "short", "left")
                       .where(f"coalesce(own, 0) <= {self._alone('size')}").select("id", "doc_id", "digest", "size"),
                       "token-candidates")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(id, size, tokens, rare): the tokens that other sets have, too, and the rarest of them that decide a link."""
        texts = id_text(self.docs).join(wanted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
        whole = whole_sets(texts.select("text"), self.size).withColumnRenamed("set", "tokens")
        whole = written(whole.join(wanted.select("digest", "id", "size"), "digest").dropDuplicates(["id"])
                        .select("id", "size", "tokens"), "whole-sets")
        tokens = whole.select("id", "size", F.explode("tokens").alias("token"))
        often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
        packed = (tokens.join(often, "token").groupBy("id", "size")
                  .agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("found")))
        spare = F.expr(f"{self._alone('size')} - (size - size(found))")
        return written(packed.withColumn("spare", spare.cast("int")).where("spare >= 0").select(
            "id", "size", F.col("found.token").alias("tokens"),
            F.slice(F.col("found.token"), 1, F.col("spare") + 1).alias("rare")), "shared-sets")

    def links(self) -> DataFrame | None:
        """Pairs of nodes whose components are those of all linked pairs."""
        sets = self._sets(self._candidates())
        if sets.isEmpty():
            return None
        groups = grouped(sets, self.percent)
        links = groups.select(F.inline("links"))
        home = groups.select("group", F.explode("sets.id").alias("id"))
        # the columns of the matrix that decide a link: (token, id, size, group)
        matrix = written(sets.select("id", "size", F.explode("rare").alias("token")).join(home, "id"), "token-matrix")
        heads = matrix.groupBy("token").agg(F.min("group").alias("head"), F.max("group").alias("other")).where("head <> other")
        first = matrix.join(heads, "token").where("group <> head").select("id", F.col("head").alias("group")).distinct()
        links = written(links.unionByName(met_links(written(first, "first-pairs"), sets, groups, self.percent)), "links")

        labels = connected_components(links)
        known = written(matrix.join(heads.select("token"), "token").join(labels, "id", "left")
                        .withColumn("label", F.coalesce("label", "id")), "labelled-matrix")
        counted = known.groupBy("token", "label").agg(F.count("*").alias("n"))
        open_tokens = (counted.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("common"),
                                                    F.min("label").alias("low"), F.max("label").alias("high"))
                       .where("low <> high").select("token", "common"))
        left = written(known.join(open_tokens, "token"), "open-matrix")
        per_group = left.groupBy("token", "group").agg(
            F.min("size").alias("least"), F.max("size").alias("most"), F.min("label").alias("low"), F.max("label").alias("high"))
        asking = left.where("label <> common").select("token", "id", "size", "label", F.col("group").alias("home"))
        p = self.percent
        met = (asking.join(per_group, "token")
               .where(f"group <> home and (low <> label or high <> label) and 100 * most >= {p} * size and 100 * size >= {p} * least")
               .select("id", "group").distinct().join(first, ["id", "group"], "left_anti"))
        return links.unionByName(met_links(written(met, "more-pairs"), sets, groups, self.percent))

    def groups(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        links = self.links()
        if links is None:
            labelled = self.nodes.withColumn("label", F.col("id"))
        else:
            labels = written(connected_components(links), "labels")
            labelled = self.nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        # only sets that have copies or links need an owner
        several = labelled.groupBy("label").agg(F.min("doc_id").alias("component"), F.sum("copies").alias("n")).where("n > 1")
        owner = written(labelled.join(several, "label").select("digest", "component"), "owners")
        usable = F.col("n_shingles") > 0
        out = self.rows.select("doc_id", "n_shingles", F.when(usable, F.col("digest")).alias("digest")).join(
            owner, "digest", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
                          .alias("component_id"))


def join_similar(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    return NgramJoin(docs, percent, size).groups()
