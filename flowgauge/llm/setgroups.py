"""Sets of tokens in groups: which sets link with which members of a group, without pairs as rows.

A group is one row with a bounded number of sets; its members' tokens, in order and with their owners, are its token union.
A set meets a group as one row of a block: its overlap with the union bounds that with any member, and only groups whose
bound reaches the threshold are opened and counted member by member, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

GROUP_SETS, GROUP_TOKENS = 64, 1 << 16
#: Sets that meet a group are handed to it in blocks.
BLOCK_SETS, BLOCK_TOKENS = 64, 1 << 16


class Members:
    """The sets of a group: their sizes, and all their tokens in order with the owner of each."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, flat: np.ndarray):
        self.ids, self.sizes = ids, sizes
        owner = np.repeat(np.arange(len(ids)), lengths)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner = flat[order], owner[order]

    def overlaps(self, tokens: np.ndarray) -> tuple[int, np.ndarray | None]:
        """The overlap of a set with the union of all members."""
        low = np.searchsorted(self.tokens, tokens)
        at = np.minimum(low, len(self.tokens) - 1)
        return int((self.tokens[at] == tokens).sum()), low

    def shared(self, tokens: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The overlap of a set with each member."""
        n = np.searchsorted(self.tokens, tokens, side="right") - low
        stop = np.cumsum(n)
        places = np.repeat(low - (stop - n), n) + np.arange(int(stop[-1]))
        return np.bincount(self.owner[places], minlength=len(self.ids))

    def linked(self, size: int, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Which members link with a set of ``size`` tokens, of which ``tokens`` are those that others have, too."""
        bound, low = self.overlaps(tokens)
        # shared <= bound and the union has size tokens at least
        if 100 * bound < percent * size:
            return np.empty(0, dtype=np.int64)
        shared = self.shared(tokens, low)
        return np.flatnonzero(100 * shared >= percent * (self.sizes + size - shared))


def _members(row: dict) -> Members:
    sets = row["sets"]
    return Members(np.array([x["id"] for x in sets], dtype=np.int64), np.array([x["size"] for x in sets], dtype=np.int64),
                   np.array([len(x["tokens"]) for x in sets], dtype=np.int64),
                   np.concatenate([np.array(x["tokens"], dtype=np.int64) for x in sets]))


def _parts(members: Members, sets: list[dict], percent: int) -> np.ndarray:
    """For each member the first one of those it reaches by links inside the group."""
    label = np.arange(len(sets))
    for k, x in enumerate(sets):
        found = members.linked(x["size"], np.array(x["tokens"], dtype=np.int64), percent)
        met = np.unique(label[np.append(found, k)])
        label[np.isin(label, met)] = met[0]
    return label


def _inside(percent: int):
    @F.arrow_udf("array<struct<a:long,b:long>>")
    def run(sets: pa.Array) -> pa.Array:
        out = []
        for some in sets.to_pylist():
            if len(some) < 2:
                out.append([])
                continue
            members = _members({"sets": some})
            label = _parts(members, some, percent)
            out.append([{"a": int(members.ids[k]), "b": int(members.ids[label[k]])} for k in np.flatnonzero(label != np.arange(len(some)))])
        return pa.array(out, type=pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return run


def _across(percent: int):
    """Links between the sets of a block and the group they meet: of members with one label the first is enough."""

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def run(group: pa.Array, block: pa.Array) -> pa.Array:
        out = []
        for some, asking in zip(group.to_pylist(), block.to_pylist(), strict=True):
            members = _members({"sets": some})
            found = []
            for x in asking:
                near = members.linked(x["size"], np.array(x["tokens"], dtype=np.int64), percent)
                found += [{"a": x["id"], "b": int(members.ids[k])} for k in near]
            out.append(found)
        return pa.array(out, type=pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return run


def grouped(sets: DataFrame, percent: int) -> DataFrame:
    """(group, sets, links): sets (id, size, tokens) with the same smallest token, in groups, and the links inside."""
    keyed = sets.withColumn("key", F.array_min("tokens"))
    parts = F.greatest(F.ceil(F.count("*") / F.lit(GROUP_SETS)), F.ceil(F.sum(F.size("tokens")) / F.lit(GROUP_TOKENS)))
    dealt = keyed.join(keyed.groupBy("key").agg(parts.alias("parts")), "key")
    name = F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = (dealt.groupBy(name.alias("group"))
              .agg(F.collect_list(F.struct("id", "size", "tokens")).alias("sets")))
    return written(packed.withColumn("links", _inside(percent)("sets")), "token-groups")


def met_links(pairs: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of the pairs (id, group) of sets and groups, by bound and then by member."""
    asking = pairs.join(sets.select("id", "size", "tokens"), "id")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)))
    sized = pairs.join(sets.select("id", F.size("tokens").alias("n")), "id").groupBy("group").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    asked = (asking.join(sized, "group").groupBy("group", block.alias("block"))
             .agg(F.collect_list(F.struct("id", "size", "tokens")).alias("block_sets")))
    found = _across(percent)("sets", "block_sets")
    return written(asked.join(groups.select("group", "sets"), "group").select(F.inline(found)).distinct(), "group-links")
