"""Operator 13, quality classifier: supervised subword embeddings.

A document is the bag of its words. Every word has a learned vector, the sum of rows of one table that the word itself
and its character n-grams are hashed to; a document's vector is the mean of its words' vectors, and a softmax over the
classes gives the score. Table and output are trained together by stochastic gradient descent in numpy.

Words are told apart as they stand (case, symbols): ``<`` and ``>`` are put around a word, and its n-grams are runs of
``GRAMS`` bytes. A word that equals the one before it, or the one ``BACK`` places before, also has the vector of this
relation, whatever the word: so repetition is learned from other words than those of the training texts.

Training uses a bounded sample, as parameters: about ``ROWS`` labelled documents, fewer if they hold more than
``BYTES`` of text, chosen by hash of the id. Each is a row of hashed features with their shares (whole texts, no more
entries than the table has rows), made in Spark tasks; the descent runs over these rows on the driver. Scoring is one
pass over whole texts without a shuffle: a task computes the logit of every distinct word of a slice once, and the
texts average them. The model (``BUCKETS`` x ``DIMENSIONS`` numbers) is folded into one number per table row before it
is sent.

Defined cases: null, empty and blank texts have no words and get the score of the output's bias; without labels of
both classes every score is 0; repeated rows give repeated rows; repeated labels of one document count by the largest;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written
from .text import SPACED, Words, mix, slices, words

#: Rows of the table, and length of a vector.
BUCKETS = 1 << 16
DIMENSIONS = 16
#: Bytes of a character n-gram.
GRAMS = (3, 4, 5)
#: A word may be equal to those so many places before it.
BACK = (1, 2, 3)
#: Bounds of the training sample: labelled documents, and bytes of their texts.
ROWS = 8_000
BYTES = 16 << 20
#: Descent, a document a step: passes over the sample, first step size (falls to 0 in a line).
EPOCHS = 5
RATE = 0.5
#: A document with at least this score is of good quality.
LIMIT = 0.3
#: Labels up to this many rows (16 bytes each) are broadcast to the documents; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Model:
    """Share of every table row in the logit of class 1, and the bias."""

    logits: np.ndarray
    bias: float


def word_features(w: Words, pick: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words ``pick``: (number of the word in ``pick``, row), the word itself first."""
    size = w.ends[pick] - w.starts[pick] + 2
    end = np.cumsum(size)
    first = end - size
    flat = np.empty(int(end[-1]) if len(end) else 0, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[first] = inner[end - 1] = False
    owner = np.repeat(np.arange(len(pick)), size)
    at = np.arange(len(flat)) - first[owner] - 1 + w.starts[pick][owner]
    flat[inner] = w.data[at[inner]]
    flat[first], flat[end - 1] = ord("<"), ord(">")
    who, rows = [np.arange(len(pick))], [w.hashes_of(pick)]
    for g in GRAMS:
        n = len(flat) - g + 1
        if n <= 0:
            continue
        h = np.full(n, g, np.uint64)
        for j in range(g):
            h = h * np.uint64(0x100000001B3) + flat[j:j + n]
        ok = owner[:n] == owner[g - 1:]
        who.append(owner[:n][ok])
        rows.append(mix(h[ok]))
    return np.concatenate(who), (np.concatenate(rows) % np.uint64(buckets)).astype(np.int64)


class _Texts(Words):
    """Words of texts, and which of them are equal."""

    def hashes_of(self, pick: np.ndarray) -> np.ndarray:
        return self._h[pick]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of every distinct word, and the number of each word's distinct word."""
        self._h = self.hashes()
        _, place, number = np.unique(self._h, return_index=True, return_inverse=True)
        return place, number


    def repeats(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, relation) of words that are equal to one before them in their text."""
        owner, who, what = self.owner(), [], []
        for k in BACK:
            same = np.flatnonzero((number[k:] == number[:-k]) & (owner[k:] == owner[:-k])) + k
            who.append(same)
            what.append(np.full(len(same), k))
        return np.concatenate(who), np.concatenate(what)


def _relation(k: np.ndarray, buckets: int) -> np.ndarray:
    """Table rows of the relations."""
    return (mix(k.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _texts(column: pa.Array) -> _Texts:
    w = words(column, SPACED, lower=False)
    return _Texts(w.data, w.offsets, w.starts, w.ends, w.first)


def _features(buckets: int):
    """Task: label, and a document's table rows with their shares in the mean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = _texts(batch.column("text"))
            place, number = w.distinct()
            who, rows = word_features(w, place, buckets)
            order = np.argsort(who, kind="stable")
            who, rows = who[order], rows[order]
            cut = np.searchsorted(who, np.arange(len(place) + 1))
            ids, shares = [], []
            again, back = w.repeats(number)
            of, back = w.owner()[again], _relation(back, buckets)
            for d in range(batch.num_rows):
                a, b = int(w.first[d]), int(w.first[d + 1])
                own, times = np.unique(number[a:b], return_counts=True)
                per = cut[own + 1] - cut[own]
                take = np.repeat(cut[own], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                total = (np.bincount(rows[take], np.repeat(times, per), buckets) + np.bincount(back[of == d], minlength=buckets)) / max(b - a, 1)
                kept = np.flatnonzero(total)
                ids.append(kept.astype(np.int32).tobytes())
                shares.append(total[kept].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["label", "order", "ids", "shares"])
    return run


def descend(ids: list[np.ndarray], shares: list[np.ndarray], label: np.ndarray, buckets: int = BUCKETS, dimensions: int = DIMENSIONS,
            epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Train on documents, each a row of table rows and shares."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((buckets, dimensions)) - 0.5) / dimensions).astype(np.float32)
    out, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    truth = np.eye(2, dtype=np.float32)[label]
    steps, done = epochs * len(label), 0
    for _ in range(epochs):
        for d in rng.permutation(len(label)):
            rows, share = ids[d], shares[d]
            mean = share @ table[rows]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            error = (truth[d] - p / p.sum()) * np.float32(rate * (1 - done / steps))
            table[rows] += share[:, None] * (error @ out)  # a document's rows are distinct
            out += error[:, None] * mean
            bias += error
            done += 1
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", buckets: int = BUCKETS) -> Model | None:
    """Model of the labelled documents (label 1: good); None unless both classes occur in the sample."""
    rows = rows.where(F.col(label_col).isin(0, 1)).select(
        F.xxhash64(F.lit("quality"), F.col(id_col)).alias("order"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    share = min(1.0, ROWS / max(size["n"], 1), BYTES / max(size["b"] or 0, 1))
    sample = rows if share >= 1 else rows.where(F.pmod("order", F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by ROWS and BYTES; in one order, whatever the partitions
    got = written(sample.mapInArrow(_features(buckets), "label int, order bigint, ids binary, shares binary"), "quality-sample").orderBy("order", "ids").toArrow()
    label = got.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    read = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in got.column(c)]
    return descend(read("ids", np.int32), read("shares", np.float32), label, buckets)


def _scores(model: Model):
    """Task: doc_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = _texts(batch.column("text"))
            place, number = w.distinct()
            who, rows = word_features(w, place, len(model.logits))
            own = np.bincount(who, model.logits[rows], len(place))
            again, back = w.repeats(number)
            total = np.bincount(w.owner(), own[number], batch.num_rows) + np.bincount(w.owner()[again], model.logits[_relation(back, len(model.logits))], batch.num_rows)
            z = total / np.maximum(w.counts, 1) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, score, predicted of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.select("doc_id", F.lit(0.0).alias("score")) if model is None else rows.mapInArrow(_scores(model), f"doc_id {kind}, score double")
    return found.select("doc_id", "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"))


def fold(id_col: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the id as text modulo ``by``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of the labelled documents outside the held-out fold."""
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("label")).where(fold("_id") != 0)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
