"""Repeated lines and passages: hash windows of units, keep the earliest occurrence, cut the others out.

A text is cut into units: lines, and within a line sentences, which end at . ! ? before a blank or begin with a
capital, so that a passage is found wherever it stands in a line.  A unit alone tells nothing, as names and common short
sentences occur everywhere.  Compared are windows: the fewest units from each unit on, and those up to each unit, that
have ``min_words`` words together.  So that a passage is also found where it begins and ends inside of units or has none,
runs of exactly ``min_words`` words are compared too, of any ``RUNS`` neighbours the one with the smallest digest: two texts
that share ``min_words`` + ``RUNS`` - 1 words in order share a run that both choose.  Words are compared with A-Z as a-z and
without ASCII signs at their ends.  Digests are grouped over all documents; the earliest occurrence is the one in the document with the smallest id, and there the
first.  Any other occurrence is a repeat; of a line repeated at once the first one stays.  Words of repeats are cut out,
so each of them stands in a stretch of at least ``min_words`` words that one earlier place has in that order.

The table is grouped by (digest, smallest id), which Spark combines before it shuffles, and joined back on the digest,
which adaptive execution splits where one digest holds many rows.  Texts meet only the digests of their own repeats.

Defined cases: a null text stays null and counts as empty; rows with equal doc_id are one document, whose rows do not
count as repeats of each other; rows with a null doc_id rank last and among them repeats are not cut; an empty table
gives no rows; other columns are ignored by ``repeats`` and kept by ``cut_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, free_name, id_text, mix64, powers, slices, stretch_hashes, tidied, tidied_call, utf8, written

MIN_WORDS = 30
#: of so many neighbouring runs of words at least one is compared
RUNS = 16

_LINE_BREAK, _ENDS, _PLAIN, _CAPITAL = (np.zeros(256, dtype=bool) for _ in range(4))
_LINE_BREAK[ord("\n")] = True
_ENDS[list(b".!?")] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_PLAIN[128:] = True
_CAPITAL[list(range(ord("A"), ord("Z") + 1))] = True


class Windows:
    """The windows of several texts: digests, first words and ends, and the words' places as code points of their text."""

    def __init__(self, texts: list[bytes], min_words: int):
        raw = Words(texts)
        symbols, starts, ends, owner = raw.symbols, raw.starts, raw.ends, np.repeat(np.arange(len(texts)), np.diff(raw.first))
        plain = Words([t.lower() for t in texts])
        # a word's form goes without the signs at its ends; a word of signs alone has none
        low, high = starts.copy(), ends.copy()
        while (some := (low < high) & ~_PLAIN[plain.symbols[np.minimum(low, len(symbols) - 1)]]).any():
            low[some] += 1
        while (some := (low < high) & ~_PLAIN[plain.symbols[high - 1]]).any():
            high[some] -= 1
        has_form = low < high
        forms = np.zeros(len(starts), dtype=np.uint64)
        forms[has_form] = stretch_hashes(plain.symbols, low[has_form], high[has_form])
        # À to Þ are the bytes C3 80 to C3 9E
        second = symbols[np.minimum(starts + 1, len(symbols) - 1)]
        capital = _CAPITAL[symbols[starts]] | ((symbols[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        begins = np.ones(len(starts), dtype=bool)
        breaks = np.concatenate([[0], np.cumsum(_LINE_BREAK[symbols])])
        begins[1:] = (capital[1:] | _ENDS[symbols[ends[:-1] - 1]] | (breaks[starts[1:]] != breaks[ends[:-1]])
                      | (owner[1:] != owner[:-1]))
        # from here on words are those with a form, numbered over all texts; words without one leave no gap
        counts = np.concatenate([[0], np.cumsum(has_form)])
        self.first = counts[raw.first]
        forms, owner = forms[has_form], owner[has_form]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(forms * powers(len(forms))[0][: len(forms)])])
        low, high = _unit_windows(np.unique(np.append(counts[:-1][begins], counts[-1])), min_words)
        runs = self._chosen_runs(min_words)
        low, high = np.concatenate([low, runs]), np.concatenate([high, runs + min_words])
        keep = np.append(owner, -1)[low] == np.append(owner, -1)[high - 1]
        low, high = low[keep], high[keep]
        order = np.lexsort((high, low))
        self.low, self.high = low[order], high[order]
        self.digests = self._of(self.low, self.high)
        self.bounds = np.searchsorted(self.low, self.first)
        letters = np.concatenate([[0], np.cumsum((symbols & 0xC0) != 0x80)])
        origin = letters[raw.text_starts]
        # a word reaches to the next one, also one without a form, or to the end of the text
        at = np.flatnonzero(has_form)
        self.starts = letters[starts[at]] - origin[owner]
        self.ends = letters[np.append(starts, len(symbols))[at + 1]] - origin[owner]
        some = self.first[1:] > self.first[:-1]
        self.starts[self.first[:-1][some]] = (letters[np.append(starts, 0)[raw.first[:-1]]] - origin[:-1])[some]
        self.ends[self.first[1:][some] - 1] = (origin[1:] - origin[:-1] - 1)[some]

    def _of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A polynomial over the forms of words low to high - 1."""
        down = powers(len(self.sums) - 1)[1]
        return mix64((self.sums[high] - self.sums[low]) * down[low] + (high - low).astype(np.uint64))

    def _chosen_runs(self, size: int) -> np.ndarray:
        """First words of the runs of ``size`` words with the smallest digest of some RUNS neighbours in their text."""
        starts = np.arange(max(0, len(self.sums) - size))
        if len(starts) < RUNS:
            return starts[:0]
        keys = self._of(starts, starts + size)
        least = _over(keys, RUNS, np.minimum)
        text = np.searchsorted(self.first, starts[: len(least)], side="right")
        inside = starts[: len(least)] + RUNS - 1 + size <= np.append(self.first, self.first[-1])[text]
        # the neighbourhoods of a run are those that begin up to RUNS - 1 runs before it
        none = np.zeros(RUNS - 1, dtype=np.uint64)
        most = _over(np.concatenate([none, np.where(inside, least, np.uint64(0)), none]), RUNS, np.maximum)
        return starts[(keys == most) & (most > 0)]

    def passages(self, i: int, later: np.ndarray) -> list[tuple[int, int]]:
        """Spans of text i to cut; ``later`` has the digests whose earliest occurrence is in another document."""
        a, b = self.bounds[i], self.bounds[i + 1]
        if a == b:
            return []
        keys, low, high = self.digests[a:b], self.low[a:b], self.high[a:b]
        _, place, inverse = np.unique(keys, return_index=True, return_inverse=True)
        repeat = (low > low[place][inverse]) | np.isin(keys, later)
        begin, n = self.first[i], self.first[i + 1] - self.first[i]
        depth = np.bincount(low[repeat] - begin, minlength=n + 1) - np.bincount(high[repeat] - begin, minlength=n + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(depth)[:n] > 0, [False]])))
        return [(int(self.starts[begin + x]), int(self.ends[begin + y - 1]))
                for x, y in zip(edges[0::2], edges[1::2], strict=True)]


def _over(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over every ``size`` neighbours, a power of two."""
    step = 1
    while step < size:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _unit_windows(edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest windows of ``least`` words from each unit's begin and up to each unit's end, also across texts."""
    after = np.searchsorted(edges, edges + least)
    before = np.searchsorted(edges, edges - least, side="right") - 1
    has, had = after < len(edges), before >= 0
    low = np.concatenate([edges[has], edges[before[had]]])
    high = np.concatenate([edges[after[has]], edges[had]])
    return low, high


def window_digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest, doc_id): the distinct windows of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(utf8(batch.column(1))):
                found = Windows(some, min_words)
                each = [np.unique(found.digests[a:b]) for a, b in zip(found.bounds, found.bounds[1:], strict=False)]
                ids = batch.column(0).slice(at, len(some)).take(
                    pa.array(np.repeat(np.arange(len(some)), [len(x) for x in each])))
                flat = np.concatenate([np.empty(0, dtype=np.uint64), *each])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), ids], names=["digest", "doc_id"])
                at += len(some)

    return id_text(docs).where("doc_id is not null").mapInArrow(tidied(run), "digest long, doc_id long")


def repeated_digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, later): for each document the digests whose earliest occurrence is in another one."""
    rows = written(window_digests(docs, min_words), "windows")
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .where("first <> last").select("digest", "first"), "repeated-windows")
    return (rows.join(first, "digest").where("doc_id > first").groupBy("doc_id")
            .agg(F.collect_set("digest").alias("later")))


def _spans(min_words: int):
    none = np.empty(0, dtype=np.uint64)

    def run(texts: pa.Array, later: pa.Array) -> pa.Array:
        known = iter(later.to_pylist())
        spans = []
        for some in slices(utf8(texts)):
            found = Windows(some, min_words)
            for i in range(len(some)):
                mine = next(known)
                mine = np.array(mine, dtype=np.int64).view(np.uint64) if mine else none
                spans.append(found.passages(i, mine))
        ends = np.cumsum([0, *map(len, spans)])
        flat = [s for x in spans for s in x]
        pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], type=pa.int32()),
                                            pa.array([s[1] for s in flat], type=pa.int32())], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pairs)

    return F.arrow_udf(tidied_call(run), "array<struct<start:int,end:int>>")


def kept_text(text: Column, spans: Column) -> Column:
    """The text without the spans, which are in order and apart."""
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))),
                      F.array(F.char_length(text)))
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring(
        text, F.get(bounds, 2 * k) + 1, F.get(bounds, 2 * k + 1) - F.get(bounds, 2 * k)))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def with_spans(docs: DataFrame, min_words: int, name: str) -> DataFrame:
    """``docs`` with a column of the spans to cut."""
    owner, mine = free_name(docs, "_id"), free_name(docs, "_later")
    later = written(repeated_digests(docs, min_words), "later").select(F.col("doc_id").alias(owner), F.col("later").alias(mine))
    joined = docs.join(later.hint("shuffle_hash"), docs["doc_id"] == later[owner], "left")
    return joined.withColumn(name, _spans(min_words)(F.col("text"), F.col(mine))).drop(owner, mine)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text without repeats, spans in the original, code points cut) of every row."""
    rows = with_spans(docs.select("doc_id", "text"), min_words, "spans")
    cut = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", kept_text(F.col("text"), F.col("spans")).alias("text"), "spans", cut.alias("n_cut"))


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeats cut from the texts and n_chars, where there is one, counted anew; no row goes."""
    name = free_name(docs, "_spans")
    rows = with_spans(docs, min_words, name).withColumn("text", kept_text(F.col("text"), F.col(name))).drop(name)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
