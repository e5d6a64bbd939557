"""Operator 2, licence scan.

Method: a positional rare-token index over licence templates. The inverse document frequency of every template
word is counted over all documents; each template is indexed under its ``RARE`` highest-IDF words with their
positions. A file's occurrences of indexed words look up their postings; each posting votes for a template at the
start that its position implies, and votes meet by that relative position. A place with enough of its template's
indexed words is a candidate, and it counts only if the template's mandatory key phrase stands there word for
word. Templates that are phrases ask for all their words, so every place of a phrase is found.

Defined cases: a null or empty text has no words: n_words and n_base 0, empty labels, score 0; repeated rows give repeated rows;
further columns are ignored. The vocabulary, postings and templates are fixed lists of a few hundred words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import ALNUM, slices, words

#: Indexed words of a template.
RARE = 3
#: Share of a template's IDF weight that must stand in place, beside the key phrase.
IN_PLACE = 0.6

# Phrases that a scan must find at every place, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Common licence notices: label, notice, mandatory key phrase in it.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
]


@dataclass(frozen=True)
class Template:
    """Words of a licence template; ``key`` is the word range of its mandatory phrase; base: counted in n_base."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool


def templates(phrases: dict[str, str] = PHRASES, notices: list = NOTICES) -> list[Template]:
    out = [Template(label, tuple(p.split()), (0, len(p.split())), True) for p, label in phrases.items()]
    for label, notice, key in notices:
        w, k = notice.split(), key.split()
        at = next(i for i in range(len(w)) if w[i:i + len(k)] == k)
        out.append(Template(label, tuple(w), (at, at + len(k)), False))
    return out


def vocabulary(ts: list[Template]) -> list[str]:
    return sorted({w for t in ts for w in t.words})


def _lookup(vocab: list[str]):
    """Hash table of the vocabulary: word number of each word of a run, -1 for other words."""
    h = words(pa.array(vocab), ALNUM).hashes()
    order = np.argsort(h)
    keys = h[order]
    seen = np.zeros(1 << 16, bool)
    seen[keys & np.uint64(0xFFFF)] = True

    def find(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(seen[hashes & np.uint64(0xFFFF)])
        slot = np.searchsorted(keys, hashes[at])
        slot[slot == len(keys)] = 0
        ok = keys[slot] == hashes[at]
        return at[ok], order[slot[ok]]
    return find


def idf(docs: DataFrame, text_col: str = "text", ts: list[Template] | None = None) -> dict[str, float]:
    """Inverse document frequency of each template word, counted over all documents (null texts are empty)."""
    vocab = vocabulary(ts or templates())

    def count(batches):
        find, n, df = _lookup(vocab), 0, np.zeros(len(vocab), np.int64)
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), ALNUM)
            at, number = find(w.hashes())
            pairs = np.unique(w.owner()[at] * len(vocab) + number)
            df += np.bincount(pairs % len(vocab), minlength=len(vocab))
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array([*range(len(vocab)), -1], pa.int32()),
                                          "n": pa.array([*df.tolist(), n], pa.int64())})
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word int, n bigint")
    counts = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # |vocabulary| + 1 rows
    total = counts.get(-1, 0)
    return {w: float(np.log((total + 1) / (counts.get(i, 0) + 1))) for i, w in enumerate(vocab)}


def _scan(ts: list[Template], weights: dict[str, float], rare: int, in_place: float):
    vocab = vocabulary(ts)
    number = {w: i for i, w in enumerate(vocab)}
    weight = np.array([weights.get(w, 0.0) for w in vocab])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _lookup(vocab)
        # postings: indexed word -> (template, position); a template's rarest words, ties to the earlier one
        postings: dict[int, list[tuple[int, int]]] = {}
        needed, rarest = [], []
        for k, t in enumerate(ts):
            best = sorted(range(len(t.words)), key=lambda i: (-weight[number[t.words[i]]], i))[:rare]
            rarest.append(best)
            needed.append(max(1, (len(best) + 1) // 2) if not t.base else len(best))
            for i in best:
                postings.setdefault(number[t.words[i]], []).append((k, i))
        indexed = np.isin(np.arange(len(vocab)), list(postings))
        codes = [np.array([number[x] for x in t.words]) for t in ts]
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), ALNUM)
            at, num = find(w.hashes())
            code = np.full(len(w.starts) + 1, -1, np.int64)
            code[at] = num
            rows: list[list[tuple[int, int, float]]] = [[] for _ in range(batch.num_rows)]
            votes: dict[tuple[int, int], int] = {}
            hot = indexed[num]
            for p, v in zip(at[hot].tolist(), num[hot].tolist()):
                for k, i in postings[v]:
                    votes[k, p - i] = votes.get((k, p - i), 0) + 1
            for (k, start), n in votes.items():
                t = ts[k]
                a, b = t.key
                if n < needed[k] or start + a < 0 or start + b > len(w.starts):
                    continue
                d = int(np.searchsorted(w.first, start + a, side="right")) - 1
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                if start + b > hi or not np.array_equal(code[start + a:start + b], codes[k][a:b]):
                    continue
                held = np.array([lo <= start + i < hi and code[start + i] == codes[k][i] for i in range(len(codes[k]))])
                if held[rarest[k]].sum() < needed[k]:  # some votes came from a neighbouring text
                    continue
                total = weight[codes[k]].sum()
                share = float(weight[codes[k]][held].sum() / total) if total else float(held.mean())
                if t.base or share >= in_place:
                    rows[d].append((k, start + (0 if t.base else a) - lo, share))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(w.counts, pa.int64()),
                pa.array([[{"label": ts[k].label, "word": s, "base": ts[k].base, "share": f}
                           for k, s, f in sorted(r, key=lambda x: (x[1], x[0]))] for r in rows],
                         pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())])))],
                ["doc_id", "n_words", "places"])
    return run


def scan(docs: DataFrame, weights: dict[str, float] | None = None, ts: list[Template] | None = None,
         rare: int = RARE, in_place: float = IN_PLACE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and places: array of (label, word, base, share) for every verified template place."""
    ts = ts or templates()
    weights = weights if weights is not None else idf(docs, text_col, ts)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(ts, weights, rare, in_place), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, "
                           "places array<struct<label:string,word:bigint,base:boolean,share:double>>")


def _joined(places: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`scan`."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _joined(base).alias("base_labels"), _joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
