"""Operator 7, toxicity by compression distance.

Method: two zstandard dictionaries, one for toxic and one for ordinary text. Both hold the same content trained on
ordinary windows, and each ends with the substrings that its own class's windows hold much more often than the
other's; these tails are equally long, so that ordinary words compress alike with both. Every window of a document
is compressed with both; what the toxic dictionary saves over the ordinary one is the window's distance. Counts of
windows by distance, the largest and the sum go through a logistic calibration fitted on labelled documents, which
gives the score and makes its threshold comparable between corpora.

Training uses bounded samples, as parameters: ``WINDOWS`` windows per class for the dictionaries (those with the
smallest hashes, kept so by every task) and about ``ROWS`` labelled documents for the calibration (by hash of the
id). Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has no window and gets the calibrated score of no evidence; without labels of
both classes every score is 0; repeated rows give repeated rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written
from .text import SPACED, Words, mix, slices, words

#: Words of a window.
WINDOW = 8
#: Training windows per class, and labelled rows of the calibration.
WINDOWS = 20_000
ROWS = 20_000
#: Bytes of the shared content and of a class's own tail.
SHARED, OWN = 7_000, 1_024
#: Windows are counted by these savings in bytes.
STEPS = (1, 2, 3, 5)
#: A document with at least this score is toxic.
LIMIT = 0.7
#: Labels up to this many rows (16 bytes each) are broadcast to the documents; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_TEXT, _SEEN = "__compression_text", "__compression_evidence"


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the calibration's weights of the evidence."""

    toxic: bytes
    plain: bytes
    weights: tuple[float, ...] = ()


def _windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of consecutive runs of ``size`` words, their byte ranges' ends, and the text of each run;
    a text's last run may be shorter."""
    counts = -(-w.counts // size)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = w.first[:-1][owner] + number * size
    last = np.minimum(first + size, w.first[1:][owner]) - 1
    return first, w.starts[first], w.ends[last], owner


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=15, hash_log=14, chain_log=14, min_match=3, search_log=4,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def _lengths(c: zstandard.ZstdCompressor, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Compressed length of each window, with one call for all of them."""
    segments = np.empty((len(starts), 2), np.uint64)
    segments[:, 0], segments[:, 1] = starts, ends - starts
    got = c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
    return np.fromiter((len(x) for x in got), np.int64, len(got))


def evidence(w: Words, toxic: zstandard.ZstdCompressor, plain: zstandard.ZstdCompressor) -> np.ndarray:
    """Row per text: 1, largest saving, log counts and shares of windows by saving, scaled sum, log of windows."""
    n = len(w.first) - 1
    most, total, of = np.zeros(n), np.zeros(n), np.ones(n)
    counts = np.zeros((len(STEPS), n))
    if len(w.starts):
        _, starts, ends, owner = _windows(w, WINDOW)
        data = w.data.tobytes()
        saved = _lengths(plain, data, starts, ends) - _lengths(toxic, data, starts, ends)
        np.maximum.at(most, owner, saved)
        total = np.bincount(owner, saved, n)
        of = np.maximum(np.bincount(owner, minlength=n), 1)
        counts = np.array([np.bincount(owner, saved >= s, n) for s in STEPS])
    return np.column_stack([np.ones(n), most, np.log1p(counts).T, (counts / of).T, total / np.sqrt(of), np.log(of)])


def _with_evidence(model: Model):
    """Task: all columns but the text copy, and the evidence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, plain = _compressor(model.toxic), _compressor(model.plain)
        for batch in slices(batches, _TEXT):
            x = evidence(words(batch.column(_TEXT), SPACED), toxic, plain)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            names = [f.name for f in batch.schema if f.name != _TEXT]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, _SEEN])
    return run


def _sample_windows(rows: DataFrame) -> dict[int, list[bytes]]:
    """The ``WINDOWS`` distinct windows of each class with the smallest hashes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        bound = {0: np.uint64(2**64 - 1), 1: np.uint64(2**64 - 1)}
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), SPACED)
            if not len(w.starts):
                continue
            first, starts, ends, owner = _windows(w, WINDOW)
            place = np.arange(len(w.starts)) - np.repeat(first, np.diff(np.append(first, len(w.starts))))
            h = mix(np.add.reduceat(w.hashes() * (2 * place + 1).astype(np.uint64), first))
            label, raw = np.asarray(batch.column("label"))[owner], w.data.tobytes()
            for k, have in kept.items():
                for i in np.flatnonzero((label == k) & (h < bound[k]) & (ends - starts <= 400)).tolist():
                    have[int(h[i])] = raw[starts[i]:ends[i]]
                if len(have) > 2 * WINDOWS:
                    kept[k] = {x: have[x] for x in sorted(have)[:WINDOWS]}
                    bound[k] = np.uint64(max(kept[k]))
        for k, have in kept.items():
            best = sorted(have)[:WINDOWS]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(best), pa.int32()), pa.array([x >> 1 for x in best], pa.int64()),
                                              pa.array([have[x] for x in best], pa.binary())], ["label", "h", "w"])
    cutup = written(rows.select("label", "text").mapInArrow(cut, "label int, h bigint, w binary").dropDuplicates(["label", "h"]), "toxic-windows")
    # a window has at most 400 bytes, so the samples are a few megabytes
    return {k: [bytes(r.w) for r in cutup.where(F.col("label") == k).orderBy("h").limit(WINDOWS).collect()] for k in (0, 1)}


def _grams(windows: list[bytes]) -> Counter:
    """Substrings of 4 to 10 bytes of words (with the spaces around them): windows that hold them."""
    out: Counter = Counter()
    for w in windows:
        held = set()
        for x in w.split():
            x = b" " + x + b" "
            for n in range(4, 11):
                held.update(x[i:i + n] for i in range(len(x) - n + 1))
        out.update(held)
    return out


def _marks(own: Counter, n_own: int, other: Counter, n_other: int) -> bytes:
    """Substrings that a class holds at least four times as often as the other, the most telling ones last."""
    found = []
    for g, n in own.items():
        p, q = n / n_own, (other.get(g, 0) + 1) / n_other
        if n >= 8 and p > 4 * q:
            found.append((n * math.log(p / q) * (len(g) - 2), g))
    tail = b""
    for _, g in sorted(found, reverse=True):
        if len(tail) + len(g) > OWN:
            break
        if g not in tail:
            tail = g + tail
    return tail


def dictionaries(toxic: list[bytes], plain: list[bytes]) -> Model:
    """The two dictionaries from windows of each class."""
    try:
        shared = zstandard.train_dictionary(SHARED + 1024, plain, k=32, d=6).as_bytes()[-SHARED:]
    except zstandard.ZstdError:  # too little to train on: the windows themselves
        shared = b" ".join(plain)[-SHARED:]
    t, p = _grams(toxic), _grams(plain)
    tails = _marks(t, len(toxic), p, len(plain)), _marks(p, len(plain), t, len(toxic))
    size = max(map(len, tails))
    return Model(*(shared + x.rjust(size, b"\n") for x in tails))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> Model | None:
    """Model of the labelled documents (label 1: toxic); None unless both classes occur."""
    rows = rows.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    windows = _sample_windows(rows)
    if not windows[0] or not windows[1]:
        return None
    model = dictionaries(windows[1], windows[0])
    share = ROWS / max(rows.count(), 1)
    sample = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = sample.select("label", F.col("text").alias(_TEXT)).mapInArrow(_with_evidence(model), f"label int, {_SEEN} array<double>").collect()
    x, y = np.array([r[1] for r in got]).reshape(len(got), -1), np.array([float(r[0]) for r in got])
    return Model(model.toxic, model.plain, tuple(_logistic(x, y).tolist())) if len(got) else None


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with the score in the column ``_SEEN``."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    seen = docs.withColumn(_TEXT, F.col(text_col)).mapInArrow(_with_evidence(model), ", ".join([*fields, f"{_SEEN} array<double>"]))
    z = sum((F.lit(b) * F.get(_SEEN, F.lit(i)) for i, b in enumerate(model.weights)), F.lit(0.0))
    return seen.withColumn(_SEEN, 1 / (1 + F.exp(-z)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    narrow = rows.select("doc_id", "text")
    return _scored(narrow, model, "text").select("doc_id", F.col(_SEEN).alias("score"), F.when(F.col(_SEEN) >= LIMIT, 1).otherwise(0).alias("predicted"))


def remainder(id_col: str = "doc_id", by: int = 3) -> Column:
    """crc32 of the id as text modulo ``by``: the fold of a document."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of the labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(remainder("_id") != 1)
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic by the model of their labelled rows."""
    model = fit(learning_rows(docs, labels, id_col, text_col))
    return docs if model is None else _scored(docs, model, text_col).where(F.col(_SEEN) < LIMIT).drop(_SEEN)
