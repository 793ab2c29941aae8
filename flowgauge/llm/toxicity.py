"""Toxic sentences learned from document labels: multiple-instance learning with a noisy-or.

A document is a bag of sentences.  A sentence is toxic with the probability of a logistic model over hashed features
(its words and the first four and five bytes of each word), and a document is toxic unless all its sentences are clean:
P = 1 - prod(1 - p).  Only documents are labelled; the gradient of the noisy-or shares a document's label among its
sentences.  The model is fitted on a bounded sample of labelled documents (``max_docs``, half of them toxic if there are
enough; rows are weighted back to the labels' true shares), as full-batch steps over arrays of at most that many
documents.  Scoring is one pass over all texts that shuffles nothing, and tells where the worst sentence stands.

Defined cases: a null or empty text has no sentence and scores 0; rows with equal doc_id are scored one by one; of
repeated labels the highest counts and null labels are ignored; without labels of both kinds every score is 0; an empty
table gives no rows; other columns are ignored, or kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, stretch_hashes, tidied, tidied_call, utf8, written

BITS = 18
MAX_DOCS = 5000
PREFIXES = (4, 5)
STEPS, RATE = 120, 0.15
DECAY, SPARSE = 1e-4, 4e-4  # pulls on a weight: in proportion to it, and the same for all
THRESHOLD = 0.3

_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


class Sentences:
    """Features of the sentences of several texts; sentences end at . ! ? and line breaks."""

    def __init__(self, texts: list[bytes]):
        self.words = words = Words([t.lower() for t in texts])
        starts, ends = words.starts, words.ends
        stops = np.concatenate([[0], np.cumsum(_STOP[words.symbols])])
        # a sentence is known by its text and the number of stops before its words
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        number = stops[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
        self.first_word = np.flatnonzero(new)  # of each sentence
        self.owner = owner[self.first_word]
        self.n_texts = len(texts)
        # the words' own signs count, not the signs after them
        tail = ends - np.where(_PLAIN[words.symbols[ends - 1]], 0, 1)
        tail = np.where((tail > starts) & ~_PLAIN[words.symbols[np.maximum(tail - 1, 0)]], tail - 1, tail)
        tail = np.maximum(tail, starts + 1)
        columns = [stretch_hashes(words.symbols, starts, tail)]
        for size in PREFIXES:
            columns.append(stretch_hashes(words.symbols, starts, np.minimum(starts + size, tail)) + np.uint64(size))
        shift = np.uint64(64 - BITS)
        self.features = np.stack([(c >> shift).astype(np.int32) for c in columns], axis=1)

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.first_word):
            return np.empty(0)
        return np.add.reduceat(weights[self.features].sum(axis=1), self.first_word).astype(float) + bias

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of each sentence in the joined texts."""
        last = np.append(self.first_word[1:], len(self.words.starts)) - 1
        return self.words.starts[self.first_word], self.words.ends[last]


_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_PLAIN[128:] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: Iterable[bytes]) -> list[tuple[float, float | None, int | None, int | None]]:
        """For each text: its score, and the score, start and end (in code points) of its worst sentence."""
        out = []
        for some in slices(texts):
            found = Sentences(some)
            p = 1 / (1 + np.exp(-np.clip(found.logits(self.weights, self.bias), -30, 30)))
            clean = np.bincount(found.owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(some))
            begins, ends = found.spans()
            bounds = np.searchsorted(found.owner, np.arange(len(some) + 1))
            letters = np.concatenate([[0], np.cumsum((found.words.symbols & 0xC0) != 0x80)])
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if a == b:
                    out.append((0.0, None, None, None))
                    continue
                worst = a + int(np.argmax(p[a:b]))
                at = letters[found.words.text_starts[i]]
                out.append((float(-np.expm1(clean[i])), float(p[worst]), int(letters[begins[worst]] - at),
                            int(letters[ends[worst]] - at)))
        return out


def held_out(doc_id: Column) -> Column:
    """True for the rows from whose labels nothing is learned: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[DataFrame, dict[int, float]]:
    """(features, sentence ends, label) of at most ``max_docs`` labelled documents, and the weight of each label."""
    known = (labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    known = written(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known-labels")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = max_docs // 2
    take = {1: min(totals.get(1, 0), max(half, max_docs - totals.get(0, 0)))}
    take[0] = min(totals.get(0, 0), max_docs - take[1])
    some = None
    for label, n in take.items():
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        some = part if some is None else some.unionByName(part)
    weights = {k: totals[k] / take[k] for k in take if take[k]}
    scale = sum(totals.values()) / max(1, sum(take.values()))
    # at most max_docs ids: a proven bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return rows.select("text", "toxic"), {k: w / scale for k, w in weights.items()}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample as arrays: of each text the features of its words, and where its sentences begin."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text, label in zip(utf8(part.column(0)), part.column(1).to_pylist(), strict=True):
                found = Sentences([text])
                rows.append((label, found.first_word.astype(np.int32).tobytes(), found.features.tobytes()))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["toxic", "begins", "features"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """None without labels of both kinds."""
    rows, weight = sample(docs, labels, max_docs)
    bags = rows.mapInArrow(tidied(_bags), "toxic int, begins binary, features binary").toArrow()
    labels_ = bags.column("toxic").to_pylist()
    if len(set(labels_)) < 2:
        return None
    features, begins, owner, y, n_words, n_docs = [], [], [], [], 0, 0
    for label, begin, feature in zip(labels_, bags.column("begins"), bags.column("features"), strict=True):
        begin = np.frombuffer(begin.as_py(), dtype=np.int32)
        if len(begin):
            rows_ = np.frombuffer(feature.as_py(), dtype=np.int32).reshape(-1, 1 + len(PREFIXES))
            features.append(rows_)
            begins.append(begin.astype(np.int64) + n_words)
            owner.append(np.full(len(begin), n_docs))
            y.append(label)
            n_words += len(rows_)
            n_docs += 1
    whole = np.concatenate(features)
    del bags, features
    return train(whole, np.concatenate(begins), np.concatenate(owner), np.array(y), weight)


def train(features: np.ndarray, begins: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: dict[int, float]) -> Model:
    """Adam steps on the likelihood of the labels under the noisy-or."""
    size, width = 1 << BITS, features.shape[1]
    # features that at most one toxic document has cannot be told from chance: they stay at zero and are left out
    lengths = np.diff(np.append(begins, len(features)))
    word_owner = np.repeat(owner.astype(np.int32), lengths)
    toxic = y[word_owner] == 1
    used = np.zeros(size, dtype=np.int32)
    for k in range(width):
        pairs = np.unique(features[toxic, k].astype(np.int64) * len(y) + word_owner[toxic])
        used += np.bincount(pairs // len(y), minlength=size).astype(np.int32)
    used = used > 1
    del word_owner, toxic, pairs
    sentence = np.repeat(np.arange(len(begins), dtype=np.int32), lengths)
    keep = used[features].ravel()
    place, column = np.repeat(sentence, width)[keep], features.ravel()[keep]
    del sentence, keep, features
    # a feature that a sentence has several times counts as often
    w, bias = np.zeros(size), np.array([-4.0])
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    cost = np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
    for step in range(1, STEPS + 1):
        z = np.bincount(place, w[column], minlength=len(begins)) + bias[0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_q = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        q = np.exp(log_q)
        pull = np.where(y == 1, q / np.maximum(1 - q, 1e-9), -1.0) * cost
        slope = pull[owner] * p  # of the log-likelihood by the logit of each sentence
        pulls = DECAY * w + SPARSE * np.tanh(w / 0.05)
        gradient = np.append(np.bincount(column, slope[place], minlength=size) / len(y) - pulls, slope.sum() / len(y))
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        rate = RATE * (1 - (step - 1) / STEPS)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += np.where(used, move[:-1], 0)
        bias += move[-1]
    return Model(w.astype(np.float32), float(bias[0]))


RESULT = "score double, worst_score double, worst_start int, worst_end int"


def scored(text: Column, model: Model | None) -> Column:
    """A struct of RESULT for a text column."""
    def run(texts: pa.Array) -> pa.Array:
        rows = model.score(utf8(texts)) if model else [(0.0, None, None, None)] * len(texts)
        kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int32())
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                                          names=["score", "worst_score", "worst_start", "worst_end"])

    return F.arrow_udf(tidied_call(run), RESULT)(text)


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst sentence) of every row."""
    rows = docs.select("doc_id", scored(F.col("text"), fit(docs, labels, max_docs)).alias("s"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                       F.col("s.score").alias("score"), (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"),
                       "s.worst_score", "s.worst_start", "s.worst_end")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all columns."""
    return docs.where(scored(F.col("text"), fit(docs, labels, max_docs))["score"] < threshold)
