"""Operator 10, language identification of spans.

Method: each word's script (from the ranges of its UTF-8 lead bytes) narrows the candidate languages to those that
are learned with that script. Candidates get a score per word, the log probability of the word's hashed byte
trigrams. A Viterbi pass over the words of a text, with a penalty for every switch, labels spans. The text's language
is the one with the most words.

The model is a table of 65,536 trigram buckets and 16 scripts per learned language (256 KB a language), counted over
all learning texts. Scoring is one pass over whole texts without a shuffle; texts of about ``GROUP_BYTES`` go through
the Viterbi pass together.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing was
learned; ties go to the language that sorts first; repeated rows give repeated rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Words, slices, words

BUCKETS = 1 << 16
SCRIPTS = 16
#: Log probability that a change of language costs.
SWITCH = 10.0
#: A language is a candidate for a script that makes up this share of its words.
SCRIPT_SHARE = 0.001
#: Charge for languages that are no candidates of a word's script.
FOREIGN = 50.0
GROUP_BYTES = 8 << 20

LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

# Script numbers of UTF-8 lead bytes (0 Latin, 1 Greek, 2 Cyrillic, 3 Armenian and Hebrew, 4 Arabic,
# 5 Indic and Thai, 6 Georgian and further, 7 punctuation and symbols, 8 kana and CJK marks, 9 Han, 10 Hangul,
# 11 private and forms, 12 supplementary planes).
SCRIPT_OF = np.zeros(256, np.uint8)
for first, last, script in [(0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD5, 0xD7, 3), (0xD8, 0xDF, 4), (0xE0, 0xE0, 5),
                            (0xE1, 0xE1, 6), (0xE2, 0xE2, 7), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10),
                            (0xEE, 0xEF, 11), (0xF0, 0xF4, 12)]:
    SCRIPT_OF[first:last + 1] = script
del first, last, script


@dataclass(frozen=True)
class Model:
    """Languages, log probabilities (BUCKETS x languages) and candidates (SCRIPTS x languages)."""

    langs: tuple[str, ...]
    logp: np.ndarray
    candidates: np.ndarray


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket at every byte inside a word (its neighbours outside read as space), and each word's script."""
    inside = LETTERS[w.data]
    d = np.where(inside, w.data, np.uint8(0x20)).astype(np.uint32)
    left, right = np.roll(d, 1), np.roll(d, -1)
    left[w.starts] = 0x20
    right[w.ends - 1] = 0x20
    code = (left << np.uint32(16)) | (d << np.uint32(8)) | right
    code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    script = np.maximum.reduceat(SCRIPT_OF[w.data], w.starts) if len(w.starts) else np.zeros(0, np.uint8)
    return code, script


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of texts with a known language; None if there is none."""
    rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), LETTERS)
            code, script = _features(w)
            owner = w.owner()
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                into = totals.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                mine = langs == lang
                bytes_of = np.repeat(mine, np.diff(w.offsets)) & LETTERS[w.data]
                into[:BUCKETS] += np.bincount(code[bytes_of], minlength=BUCKETS)
                into[BUCKETS:] += np.bincount(script[mine[owner]], minlength=SCRIPTS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                                             ["lang", "bucket", "n"])
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most BUCKETS + SCRIPTS rows a language
    langs = sorted(set(got["lang"].to_pylist()))
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    n = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    n[got["bucket"].to_numpy(), np.array([number[x] for x in got["lang"].to_pylist()])] = got["n"].to_numpy()
    grams, scripts = n[:BUCKETS] + 0.2, n[BUCKETS:]
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True
    return Model(tuple(langs), np.log(grams / grams.sum(0)).astype(np.float32), candidates)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Score of every word (row) in every language (column)."""
    code, script = _features(w)
    out = np.empty((len(w.starts), len(model.langs)), np.float32)
    inside = np.flatnonzero(LETTERS[w.data])
    at = np.concatenate([[0], np.cumsum(w.ends - w.starts)[:-1]]) if len(w.starts) else np.zeros(0, np.int64)
    code = code[inside]
    for k in range(len(model.langs)):
        if len(at):
            out[:, k] = np.add.reduceat(model.logp[:, k][code], at)
    out[~model.candidates[script]] -= FOREIGN
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; text d has the words first[d] .. first[d+1]. All texts advance together."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    active = len(counts) - np.searchsorted(counts[::-1], np.arange(steps), side="right")
    change = np.zeros(scores.shape, bool)
    come_from = np.zeros(len(scores), np.uint8 if scores.shape[1] < 256 else np.int32)
    v = np.zeros((len(counts), scores.shape[1]), np.float32)
    for t in range(steps):
        k = active[t]
        at = begin[:k] + t
        held = v[:k]
        if t:
            best = held.argmax(1)
            top = np.take_along_axis(held, best[:, None], 1) - switch
            moved = held < top
            change[at], come_from[at] = moved, best
            held = np.where(moved, top, held)
        held = held + scores[at]
        v[:k] = held - held.max(1, keepdims=True)  # a sum over a long text would lose the differences to rounding
    label = np.zeros(len(scores), np.int64)
    state = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        s = state[:k]
        label[at] = s
        state[:k] = np.where(change[at, s], come_from[at], s)
    return label


def _grouped(batches: Iterator[pa.RecordBatch], model: Model):
    """(slices, words per text, labels) of runs of slices that make up about GROUP_BYTES."""
    held, size = [], 0

    def out():
        counts = np.concatenate([c for _, c, _ in held])
        scores = np.concatenate([s for _, _, s in held])
        first = np.concatenate([[0], np.cumsum(counts)])
        return [b for b, _, _ in held], first, viterbi(scores, first)
    for batch in slices(batches, "text"):
        w = words(batch.column("text"), LETTERS)
        held.append((batch, w.counts, word_scores(w, model)))
        size += len(w.data)
        if size >= GROUP_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language with the most words and its share of the text's words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        n = len(m.langs)
        names = np.array([*m.langs, "und"], dtype=object)
        for parts, first, label in _grouped(batches, m):
            docs_n = len(first) - 1
            owner = np.repeat(np.arange(docs_n), np.diff(first))
            votes = np.bincount(owner * n + label, minlength=docs_n * n).reshape(docs_n, n)
            best = votes.argmax(1)
            letters = np.concatenate([np.asarray(b.column("letters").to_numpy(zero_copy_only=False)) for b in parts])
            share = np.where(letters, votes.max(1) / np.maximum(votes.sum(1), 1), 0.0)
            ids = pa.chunked_array([b.column("doc_id") for b in parts]).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(names[np.where(letters, best, n)], pa.string()), pa.array(share)],
                                             ["doc_id", "lang_pred", "score"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: runs of words [start, stop) of one language, in text order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for parts, first, label in _grouped(batches, m):
            new = np.ones(len(label), bool)
            new[1:] = label[1:] != label[:-1]
            new[first[:-1][np.diff(first) > 0]] = True
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(label))
            owner = np.searchsorted(first, start, side="right") - 1
            offsets = np.searchsorted(owner, np.arange(len(first))).astype(np.int32)
            base = first[owner]
            items = pa.StructArray.from_arrays([pa.array([m.langs[x] for x in label[start]], pa.string()),
                                                pa.array(start - base, pa.int64()), pa.array(stop - base, pa.int64())], ["lang", "start", "stop"])
            ids = pa.chunked_array([b.column("doc_id") for b in parts]).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), items)], ["doc_id", "spans"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<lang:string,start:bigint,stop:bigint>>")
