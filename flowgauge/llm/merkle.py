"""A Merkle manifest of a table, and proofs from it, keeping only every few levels of the trees.

A row's leaf is the digest of its columns.  Per language the leaves, in order of doc_id, form a tree of ``ARITY`` children a
node; the subroots of the languages, in order, form one more on top.  Checkpoint-and-recompute: of the levels only every
``LEVELS``-th is stored, 512 nodes apart, as one row per aligned subtree with its stored descendants.  Proof extraction
goes down: a stored subtree makes its missing interior nodes again from its descendants, emits the siblings for each of
them, and forgets the nodes.  What a subtree's descendants have in common, the path above it, comes as one row.

Leaves are ordered by one range shuffle of ids and digests; a leaf's place in its tree is its place in the range plus the
rows of earlier ranges, of which there is one count per range and tree.  Every group has at most 512 rows, so no task
grows with the table, and texts are read once and never shuffled.

Defined cases: a null column is the mark - in the leaf; a null language is a tree of its own and comes first; null ids come
first in their tree and are never tampered with; rows with equal ids are leaves one by one, in order of their digests,
and equal rows get equal leaves; a tree of one leaf is that leaf; a leaf without siblings has the digest of nothing as
its proof; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY_BITS, LEVELS = 3, 3
ARITY = 1 << ARITY_BITS
SUBTREE_BITS = ARITY_BITS * LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<place:int,siblings:string>>"


def _digest(hexes: list[str]) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def _joined(values: dict[str, Column]) -> Column:
    text = {name: c.cast("string") for name, c in values.items()}
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                      for c in text.values()])


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of a row's columns, as hex."""
    return F.sha2(_joined(values), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, changed, tie): the leaf, and the one after tampering where that is another."""
    values = {c: F.col(c) for c in FIELDS}
    lowered = values | {"text": F.translate("text", _UPPER, _LOWER)}
    tree = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))
    has_capital = F.col("text").rlike("[A-Z]")
    changed = F.when(tampered(F.col("doc_id")) & has_capital, F.unhex(leaf_of(lowered)))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(leaf_of(values)).alias("node"), changed.alias("changed"),
                       F.monotonically_increasing_id().alias("tie"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their rank in their tree and its size ``n``; rows of a tree are ordered by ``order``."""
    columns = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = written(rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
                     .withColumn("place", F.monotonically_increasing_id()), "merkle-ranges")
    placed = placed.withColumns({"range": F.expr("place >> 33"), "inside": F.expr(f"place & {(1 << 33) - 1}")}).drop("place")
    counts = placed.groupBy("tree", "range").agg(F.count("*").alias("rows"), F.min("inside").alias("low"))
    # one row per range and tree that has rows there
    earlier, whole = Window.partitionBy("tree").orderBy("range"), Window.partitionBy("tree")
    offsets = written(counts.select("tree", "range", F.sum("rows").over(whole).alias("n"),
                                    (F.sum("rows").over(earlier) - F.col("rows") - F.col("low")).alias("offset")),
                      "merkle-offsets")
    return (placed.join(offsets, ["tree", "range"]).withColumn("rank", F.col("inside") + F.col("offset"))
            .drop("range", "inside", "offset"))


def subtrees(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(tree, at, n, nodes): aligned runs of the nodes of a level, ``nodes`` in order with the ``extra`` columns."""
    at = F.shiftright("rank", SUBTREE_BITS)
    packed = F.array_sort(F.collect_list(F.struct("rank", "node", *extra)))
    return nodes.groupBy("tree", at.alias("at")).agg(F.max("n").alias("n"), packed.alias("nodes"))


def interior(nodes: list[str], n: int) -> tuple[list[list[str]], str]:
    """The levels below the top of an aligned subtree and the top; ``n`` nodes has the whole tree at the lowest level."""
    levels = []
    for _ in range(LEVELS):
        if n <= 1:
            break
        levels.append(nodes)
        nodes = [_digest(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
        n = -(-n // ARITY)
    (top,) = nodes
    return levels, top


def siblings(levels: list[list[str]], k: int) -> list[tuple[int, str]]:
    """For node k of the lowest level its place and the others of its run, level by level."""
    path = []
    for nodes in levels:
        first = k & ~(ARITY - 1)
        path.append((k - first, "".join(nodes[first:k] + nodes[k + 1 : first + ARITY])))
        k >>= ARITY_BITS
    return path


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and its siblings give."""
    for place, others in path:
        at = 64 * place
        node = sha256((others[:at] + node + others[at:]).encode()).hexdigest()
    return node


def _tops(nodes: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([bytes.fromhex(interior([x["node"].hex() for x in some], size)[1])
                     for some, size in zip(nodes.to_pylist(), n.to_pylist(), strict=True)], type=pa.binary())


def _downward() -> Column:
    return F.arrow_udf(_paths, f"array<struct<at:long,path:{_PATH}>>")("nodes", "n", "path")


class Forest:
    """The stored levels of trees over (tree, rank, n, node, extra columns), lowest first, and their roots."""

    def __init__(self, nodes: DataFrame, extra: list[str] | None = None):
        self.stored = [written(subtrees(nodes, extra or []), "merkle-level")]
        size = self.stored[0].agg(F.max("n")).first()[0] or 0
        while True:
            level = self.stored[-1].select("tree", F.col("at").alias("rank"), F.arrow_udf(_tops, "binary")("nodes", "n").alias("node"),
                                           F.expr(f"(n + {(1 << SUBTREE_BITS) - 1}) >> {SUBTREE_BITS}").alias("n"))
            size = (size + (1 << SUBTREE_BITS) - 1) >> SUBTREE_BITS
            if size <= 1:
                break
            self.stored.append(written(subtrees(level, []), "merkle-level"))
        self.roots = written(level.select("tree", "node"), "merkle-roots")

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, at, path, subroot, root) for each lowest stored subtree, given those of the trees' roots."""
        found = above.withColumn("at", F.lit(0).cast("long"))
        for level in reversed(self.stored[1:]):
            found = written(level.join(found, ["tree", "at"])
                            .select("tree", F.inline(_downward()), "subroot", "root"), "merkle-paths")
        return found


def _paths(nodes: pa.Array, n: pa.Array, path: pa.Array) -> pa.Array:
    out = []
    for some, size, above in zip(nodes.to_pylist(), n.to_pylist(), path.to_pylist(), strict=True):
        levels, _ = interior([x["node"].hex() for x in some], size)
        out.append([{"at": x["rank"], "path": [{"place": p, "siblings": s} for p, s in siblings(levels, k)] + above}
                    for k, x in enumerate(some)])
    kind = pa.struct([("place", pa.int32()), ("siblings", pa.string())])
    return pa.array(out, type=pa.list_(pa.struct([("at", pa.int64()), ("path", pa.list_(kind))])))


def manifest(docs: DataFrame) -> tuple[Forest, Forest]:
    """The stored levels of the trees of the languages, and of the tree over their subroots."""
    rows = ranked(leaves(docs), ["doc_id", "node", "tie"])
    below = Forest(rows, ["doc_id", "changed"])
    names = below.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    return below, Forest(ranked(names, ["name"]), ["name"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored run of leaves the proofs and the roots that they and the (tampered) leaves give."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes = [x["node"].hex() for x in row["nodes"]]
            levels, top = interior(nodes, row["n"])
            above = [(x["place"], x["siblings"]) for x in row["path"]]
            common = "".join(s for _, s in above).encode()
            # the run's own leaves meet in its top, from where on they share the way
            way = {top: fold(top, above)}
            ids, proofs, folded = [], [], []
            for k, (x, leaf) in enumerate(zip(row["nodes"], nodes, strict=True)):
                path = siblings(levels, k)
                proof = sha256("".join(s for _, s in path).encode())
                proof.update(common)
                reached = fold(x["changed"].hex() if x["changed"] else leaf, path)
                ids.append(x["doc_id"])
                proofs.append(proof.hexdigest())
                folded.append(way[reached] if reached in way else fold(reached, above))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(nodes, type=pa.string()),
                 pa.array([row["subroot"]] * len(ids), type=pa.string()), pa.array([row["root"]] * len(ids), type=pa.string()),
                 pa.array(proofs, type=pa.string()), pa.array(folded, type=pa.string()),
                 pa.array([f == row["root"] for f in folded], type=pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def proofs(below: Forest, above: Forest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
    root = F.lower(F.hex("node"))
    none = F.array().cast(_PATH)
    tops = above.paths(above.roots.select("tree", none.alias("path"), F.lit("").alias("subroot"), root.alias("root")))
    # the tree over the subroots has one more step down, to the subroots themselves
    each = above.stored[0].join(tops, ["tree", "at"]).select(
        F.explode(F.arrays_zip(_downward().alias("down"), F.col("nodes").alias("nodes"))).alias("x"), "root")
    paths = written(each.select(F.col("x.nodes.name").alias("tree"), F.col("x.down.path").alias("path"),
                                F.lower(F.hex("x.nodes.node")).alias("subroot"), "root"), "merkle-tops")
    runs = below.stored[0].join(below.paths(paths), ["tree", "at"]).select("nodes", "n", "path", "subroot", "root")
    return runs.mapInArrow(_prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                   "folded_root string, verified boolean")
