"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan over chunks.

The model is a BPE model, so ids do not come from a sum of scores.  But a cut of a text into pieces is the model's own
exactly if every two pieces that follow each other are what the model makes of those two alone: a merge across their
border would otherwise have happened there too.  So encoding is a path problem with values 0 (the pieces go together)
and minus infinity, and it is solved as one:

* A giant document is cut into chunks at fixed places.  The state at a border is the piece that ends at or reaches
  across it; a chunk gives the max-plus matrix from the states at its left to those at its right border.
* Matrices are combined associatively, forwards from the text's start and backwards from its end.  Exactly one state of
  each border lies on a path from start to end.
* With the states at its borders known, each chunk is traced back on its own.

No piece has a blank sign after another sign, so a piece always ends before a word; inside a chunk only the words cut
by its borders need the path search and the words between are encoded by the library.  Text without blanks is searched
throughout.  Documents up to ``giant`` code points go to the library whole: the ids are the same either way.

Defined cases: a null or empty text has no ids; rows with equal doc_id are encoded one by one; an empty table gives no
rows; signs the model lacks become byte pieces; a model of another type than BPE is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, process_cache, slices, stretch_hashes, written
from .token_orc import checksums
from .tokens import Known, spread

GIANT, CHUNK = 1 << 16, 1 << 14
BLANK = "▁"
NEVER = float("-inf")
Piece = tuple[int, int]


BPE = 2


def _varint(blob: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (blob[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not blob[at - 1] & 0x80:
            return value, at


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0
    while at < len(blob):
        tag, at = _varint(blob, at)
        if tag & 7 == 0:
            value, at = _varint(blob, at)
        else:
            size, at = _varint(blob, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = blob[at : at + size], at + size
        yield tag >> 3, value


def model_type(blob: bytes) -> int:
    """The type that a serialized model states (trainer settings, field 3): 1 Unigram, the default, 2 BPE, 3 words, 4 signs."""
    settings = [dict(_fields(value)) for number, value in _fields(blob) if number == 2]
    return settings[-1].get(3, 1) if settings else 1


class Model:
    """The pieces of a BPE model and which of them go together; any other type of model is an error."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        if (kind := model_type(self.library.serialized_model_proto())) != BPE:
            raise ValueError(f"Not a BPE model (type {kind}): the cuts of other models are not decided pair by pair")
        n = self.library.get_piece_size()
        usable = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i)
                                              or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in usable}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.reach = max(map(len, self.ids))
        self.merge = lru_cache(200_000)(self._merge)
        self.cuts_before_blank = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        # texts of a model that changes nothing but blanks can be cut before they are normalised
        self.as_it_is = self.library.normalize(" x  ﬁ\n") == f"{BLANK}{BLANK}x{BLANK}{BLANK}ﬁ\n"
        self.known = Known(1_000_000)

    @classmethod
    def of(cls, path: str) -> Model:
        key = ("pieces", path)
        if key not in process_cache():
            process_cache()[key] = cls(path)
        return process_cache()[key]

    def _merge(self, text: str) -> tuple[str, ...]:
        """The model's pieces of a short text: merge the best pair, the first of equals, while there is one."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1], NEVER)
                if score > best:
                    best, at = score, k
            if at < 0:
                return tuple(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_piece(self, text: str) -> bool:
        return len(text) == 1 or (text in self.ids and self.merge(text) == (text,))

    def together(self, a: str, b: str) -> bool:
        return self.merge(a + b) == (a, b)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts; words with the blanks before them are encoded once each."""
        if not (self.cuts_before_blank and self.as_it_is):
            return [np.array(x, dtype=np.int32) for t in texts for x in self.library.encode([t], num_threads=1)]
        out: list[np.ndarray] = []
        for some in slices(texts):
            out += self._encode_words(some)
        return out

    def _encode_words(self, texts: list[str]) -> list[np.ndarray]:
        # the blank sign that the library puts before a text is a blank here, and so is one that stands in a text
        data = "".join(" " + t.replace(BLANK, " ") if t else "" for t in texts)
        points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        blank = points == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1][lengths > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        low, middle, high = (stretch_hashes(x, starts, ends) for x in (points & 0xFF, (points >> 8) & 0x1FF, points >> 17))
        hashes = low ^ mix64(middle) ^ mix64(high + np.uint64(1))
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)

        def encode(places: np.ndarray) -> Iterator[bytes]:
            at = place[places]
            words = [data[a + 1 : b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            for k in range(0, len(words), 20_000):
                for word, ids in zip(words[k : k + 20_000], self.library.encode(words[k : k + 20_000], num_threads=1),
                                     strict=True):
                    # a blank alone has no word for the library to put it before
                    yield np.array(ids if word else [self.ids[BLANK]], dtype=np.uint32).tobytes()

        flat, begin, sizes = self.known.ids_of(distinct, encode)
        size = sizes[inverse]
        ids = flat[spread(begin[inverse], size)].view(np.int32)
        stop = np.concatenate([[0], np.cumsum(size)])
        cut = stop[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.library.piece_to_id(f"<0x{x:02X}>") for x in piece.encode()]


class Chunk:
    """A stretch [left, right) of a normal text, seen with ``reach`` code points on both sides.

    Places are those of the whole text; ``text`` begins at place ``origin``.
    """

    def __init__(self, model: Model, text: str, origin: int, left: int, right: int, end: int):
        self.model, self.text, self.origin, self.left, self.right, self.end = model, text, origin, left, right, end

    def at(self, piece: Piece) -> str:
        return self.text[piece[0] - self.origin : piece[1] - self.origin]

    def states(self, border: int) -> list[Piece]:
        """Pieces that end at or reach across a border; the text's start is a piece of no length."""
        if border == 0:
            return [(0, 0)]
        reach = self.model.reach
        return [(i, j) for i in range(max(0, border - reach), border)
                for j in range(border, min(self.end, i + reach) + 1)
                if (border < self.end or j == border) and self.model.is_piece(self.at((i, j)))]

    def cut(self, place: int) -> bool:
        """True if a piece surely ends before this place, whatever the pieces are."""
        k = place - self.origin
        return self.model.cuts_before_blank and 0 < k < len(self.text) and self.text[k] == BLANK != self.text[k - 1]

    def _search(self, begin: dict[Piece, set], stop: int, last: int) -> dict[Piece, set]:
        """Spread marks from pieces to those that may follow, for pieces that start before ``stop``.

        A mark names where a path began; the result has the marks of pieces that end at or beyond ``stop``, up to ``last``.
        """
        ending: dict[int, dict[Piece, set]] = {}
        for piece, marks in begin.items():
            ending.setdefault(piece[1], {})[piece] = set(marks)
        found: dict[Piece, set] = {}
        place = min(ending, default=stop)
        while place < stop:
            here = ending.pop(place, {})
            for j in range(place + 1, min(last, place + self.model.reach) + 1) if here else ():
                after = self.at((place, j))
                if not self.model.is_piece(after):
                    continue
                marks: set = set()
                for before, known in here.items():
                    if before[0] == before[1] or self.cut(place) or self.model.together(self.at(before), after):
                        marks |= known
                if marks:
                    ending.setdefault(j, {}).setdefault((place, j), set()).update(marks)
            place += 1
        for pieces in ending.values():
            found.update(pieces)
        return found

    def cuts(self) -> tuple[int, int] | None:
        """The first and the last sure cut that all entering pieces are before."""
        inner = [p for p in range(self.left + self.model.reach, self.right) if self.cut(p)]
        return (inner[0], inner[-1]) if inner else None

    def transfer(self) -> np.ndarray:
        """The max-plus matrix from the states at the left to those at the right border."""
        enter, leave = self.states(self.left), self.states(self.right)
        matrix = np.full((len(enter), len(leave)), NEVER)
        column = {piece: k for k, piece in enumerate(leave)}
        between = self.cuts()
        if between is None:
            reached = self._search({e: {k} for k, e in enumerate(enter)}, self.right, self.end)
            for piece, marks in reached.items():
                if piece in column:
                    matrix[list(marks), column[piece]] = 0.0
            return matrix
        first, last = between
        rows = set().union(*[m for p, m in self._search({e: {k} for k, e in enumerate(enter)}, first, first).items()
                             if p[1] == first])
        columns = [column[p] for p in self._search({(last, last): {0}}, self.right, self.end) if p in column]
        matrix[np.ix_(sorted(rows), columns)] = 0.0
        return matrix

    def _trace(self, begin: Piece, stop: int, goal) -> list[Piece]:
        """The one path of pieces from ``begin`` to a piece for which ``goal`` holds, without ``begin``."""
        levels: dict[int, dict[Piece, Piece | None]] = {begin[1]: {begin: None}}
        last = stop if goal is None else goal[1]
        for place in range(begin[1], stop):
            here = levels.get(place, {})
            for j in range(place + 1, min(last, place + self.model.reach) + 1) if here else ():
                after = self.at((place, j))
                if self.model.is_piece(after):
                    for before in here:
                        if before[0] == before[1] or self.cut(place) or self.model.together(self.at(before), after):
                            levels.setdefault(j, {})[place, j] = before
        ends = [goal] if goal is not None else list(levels.get(stop, {}))
        # of the pieces that end at a sure cut, one alone goes with what comes before it: all that were reached do
        piece, path = ends[0], []
        while piece != begin:
            path.append(piece)
            piece = levels[piece[1]][piece]
        return path[::-1]

    def trace(self, enter: Piece, leave: Piece) -> list[int]:
        """The ids of this chunk: of the pieces after ``enter`` up to ``leave``."""
        ids = lambda path: [i for p in path for i in self.model.piece_ids(self.at(p))]
        between = self.cuts()
        if between is None:
            return ids(self._trace(enter, self.right, leave)) if leave != enter else []
        first, last = between
        # the library puts a blank sign before a text, which stands for the one at the first cut
        middle = self.text[first + 1 - self.origin : last - self.origin]
        inner = self.model.library.encode(middle.replace(BLANK, " ")) if last > first else []
        return ids(self._trace(enter, first, None)) + inner + ids(self._trace((last, last), self.right, leave))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NEVER)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halving: products of neighbours first, then what lies between."""
    if len(matrices) < 2:
        return list(matrices)
    halves = scan([combine(a, b) for a, b in zip(matrices[0::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(halves[k // 2] if k % 2 else combine(halves[k // 2 - 1], matrices[k]))
    return out


def states_on_path(matrices: list[np.ndarray]) -> list[int]:
    """For each border after the start, the state that lies on a path from the start to the end."""
    forward = scan(matrices)
    backward = [m.T for m in scan([m.T for m in matrices[::-1]])][::-1]
    out = []
    for k in range(len(matrices)):
        value = forward[k].max(axis=0)
        if k + 1 < len(matrices):
            value = value + backward[k + 1].max(axis=1)
        out.append(int(np.argmax(value)))
    return out


def _normal(model: Model, text: str) -> str:
    return model.library.normalize(text)


CHUNKS = "row long, doc_id long, k int, text string, origin long, begin long, stop long, size long"


def _chunk_rows(path: str, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.of(path)
        for batch in batches:
            for row, doc, text in batch.itertuples(index=False):
                text = _normal(model, text)
                borders = [*range(0, len(text), chunk), len(text)]
                if len(borders) > 2 and borders[-1] - borders[-2] <= 2 * model.reach:
                    del borders[-2]
                out = []
                for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                    low = max(0, a - model.reach - 1)
                    out.append((row, doc, k, text[low : b + model.reach + 1], low, a, b, len(text)))
                yield pd.DataFrame(out, columns=["row", "doc_id", "k", "text", "origin", "begin", "stop", "size"])

    return run


def _transfers(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.of(path)
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                matrix = Chunk(model, x.text, x.origin, x.begin, x.stop, x.size).transfer()
                out.append((x.row, x.k, matrix.shape[1], (matrix == 0).tobytes()))
            yield pd.DataFrame(out, columns=["row", "k", "n_states", "matrix"])

    return run


def _states(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("k")
    marks = [np.frombuffer(m, dtype=bool).reshape(-1, n) if n else np.zeros((1, 0), dtype=bool)
             for m, n in zip(rows["matrix"], rows["n_states"], strict=True)]
    found = states_on_path([np.where(m, 0.0, NEVER) for m in marks])
    return pd.DataFrame({"row": rows["row"], "k": rows["k"], "enter": [0, *found[:-1]], "leave": found})


def _traced(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.of(path)
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                chunk = Chunk(model, x.text, x.origin, x.begin, x.stop, x.size)
                enter, leave = chunk.states(x.begin)[x.enter], chunk.states(x.stop)[x.leave]
                out.append((x.row, x.doc_id, x.k, chunk.trace(enter, leave)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "k", "ids"])

    return run


def _whole(path: str):
    def run(texts: pa.Array) -> pa.Array:
        found = Model.of(path).encode([t or "" for t in texts.to_pylist()])
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([np.empty(0, dtype=np.int32), *found])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))

    return F.arrow_udf(run, "array<int>")


def encode_giants(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """(doc_id, ids) by chunks; a task never holds more than a document's matrices or one chunk at work."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = written(texts.mapInPandas(_chunk_rows(model, chunk), CHUNKS), "chunks")
    dealt = chunks.repartition(parts, "row", "k")
    matrices = dealt.mapInPandas(_transfers(model), "row long, k int, n_states int, matrix binary")
    states = written(matrices.groupBy("row").applyInPandas(_states, "row long, k int, enter int, leave int"), "states")
    traced = dealt.join(states, ["row", "k"]).mapInPandas(_traced(model), "row long, doc_id long, k int, ids array<int>")
    return traced.groupBy("row", "doc_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids")
    ).select("doc_id", "ids")


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > giant
    whole = rows.where(~long).select("doc_id", _whole(model)(F.col("text")).alias("ids"))
    return whole.unionByName(encode_giants(rows.where(long), model, chunk))


def _texts(lists: pa.Array, model: str) -> pa.Array:
    library, out = Model.of(model).library, []
    for at in range(0, len(lists), 200):  # lists of Python numbers are large, so few at a time
        out += library.decode([x or [] for x in lists.slice(at, 200).to_pylist()], num_threads=1)
    return pa.array(out, type=pa.string())


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids."""
    return F.arrow_udf(lambda lists: _texts(lists, model), "string")(ids)


def read_back(ids: Column, model: str) -> Column:
    """What a round trip is judged by: the ids' number and checksum, and their text.

    One function, as Spark puts ``encode`` into every function of its ids and so runs it once for each of them.
    """
    def run(lists: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(lists.offsets.to_numpy()), type=pa.int64()), checksums(lists), _texts(lists, model)],
            names=["n_ids", "ids_crc32", "text"])

    return F.arrow_udf(run, "struct<n_ids:long,ids_crc32:long,text:string>")(ids)
