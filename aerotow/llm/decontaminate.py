"""Operator 1, benchmark decontamination.

Method: the benchmark's word n-grams (windows of ``n`` words; a shorter item is one window) are a broadcast hash
set. Tasks roll a hash over the word windows of whole texts, look the hashes up, verify each hit on the words
themselves, and mark the words of verified windows. Spans or documents can then be removed.

Size: the set is broadcast in blocks of at most ``BLOCK_BYTES`` of item text, read from the benchmark through an
iterator. One block is the usual case; a larger benchmark takes one pass over the documents per block, and the
blocks' spans are merged by document. No step holds more than a block on the driver or in a task.

Defined cases: a null or empty text has no words and is clean; a null or empty item has no window; an item with a
null id marks words but is not listed; repeated item ids count once; repeated document rows give repeated rows;
further columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import ALNUM, Words, slices, window_hashes, window_ok, words

N = 10
BLOCK_BYTES = 8 << 20
_BITS = 22


def _item_windows(ids: list, texts: list, n: int) -> dict:
    """{length: (sorted hashes, {window bytes: ids})} of one block of items."""
    found: dict[int, dict[bytes, set]] = {}
    hashes: dict[int, list] = {}
    w = words(pa.array(texts, pa.string()), ALNUM)
    h, raw = w.hashes(), w.data.tobytes()
    for d, item in enumerate(ids):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if a == b:
            continue
        size = min(n, b - a)
        hashes.setdefault(size, []).append(window_hashes(h[a:b], size))
        own = found.setdefault(size, {})
        for i in range(a, b - size + 1):
            own.setdefault(_key(w, raw, i, size), set()).update(() if item is None else (str(item),))
    return {s: (np.unique(np.concatenate(hashes[s])), found[s]) for s in found}


def _key(w: Words, raw: bytes, i: int, size: int) -> bytes:
    return b" ".join(raw[s:e] for s, e in zip(w.starts[i:i + size].tolist(), w.ends[i:i + size].tolist()))


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        if held and held + len(r.t) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        held += len(r.t)
    yield ids, texts


def _scan(block):
    """Task: mark the windows of one block in whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = block.value
        seen = {}
        for size, (hashes, _) in table.items():
            seen[size] = np.zeros(1 << _BITS, bool)
            seen[size][hashes & np.uint64((1 << _BITS) - 1)] = True
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), ALNUM)
            h, raw = w.hashes(), None
            cover = np.zeros(len(w.starts) + 1, np.int64)
            owner = w.owner()
            listed: dict[int, set] = {}
            for size, (hashes, windows) in table.items():
                win = window_hashes(h, size)
                at = np.flatnonzero(seen[size][win & np.uint64((1 << _BITS) - 1)])
                at = at[window_ok(w, size)[at]]
                at = at[np.isin(win[at], hashes)]
                for i in at.tolist():
                    raw = raw if raw is not None else w.data.tobytes()
                    ids = windows.get(_key(w, raw, i, size))
                    if ids is not None:
                        cover[i] += 1
                        cover[i + size] -= 1
                        listed.setdefault(int(owner[i]), set()).update(ids)
            hit = np.cumsum(cover[:-1]) > 0
            heads = w.first[:-1][w.counts > 0]
            before, after = np.roll(hit, 1), np.roll(hit, -1)
            before[heads] = False
            after[w.first[1:][w.counts > 0] - 1] = False
            starts, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            of = owner[starts]
            base = w.first[of]
            offsets = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(starts - base, pa.int64()), pa.array(last - base, pa.int64())], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array(w.counts, pa.int64()), spans,
                pa.array([sorted(listed.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "spans", "items"])
    return run


def find_contamination(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit word ranges [start, stop)), items (sorted ids)."""
    return _found(docs, items, n, id_col, text_col, item_col, item_text).drop("text_hash")


def _found(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_col: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """Rows of :func:`find_contamination` with the hash of their text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, text_hash bigint, n_words bigint, "
              "spans array<struct<start:bigint,stop:bigint>>, items array<string>")
    parts = []
    for ids, texts in _blocks(items, item_col, item_text):
        block = spark.sparkContext.broadcast(_item_windows(ids, texts, n))
        parts.append(rows.mapInArrow(_scan(block), schema))
    if len(parts) == 1:
        return parts[0]
    every = parts[0].withColumn("_first", F.lit(1))
    for p in parts[1:]:
        every = every.unionByName(p.where(F.size("spans") > 0).withColumn("_first", F.lit(0)))
    merged = every.groupBy("doc_id", "text_hash").agg(
        F.sum("_first").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(s))))
    return (merged.withColumn("spans", joined)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "text_hash", "n_words", "spans", "items"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`find_contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark.

    A row goes by its own text: rows without an id, or of one id, stay where their text is clean.
    """
    bad = _found(docs, items, n, id_col, text_col).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text_col)) == F.col("_bad_hash")), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id",
                 text_col: str = "text", clean_col: str = "clean_text") -> DataFrame:
    """doc_id and the text without the hit words (each hit span is cut from its first to its last byte)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_contamination(rows, items, n).where(F.size("spans") > 0).select("doc_id", "spans").dropDuplicates(["doc_id", "spans"])
    joined = rows.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")

    def cut(batches):
        for batch in slices(batches, "text"):
            w = words(batch.column("text"), ALNUM, lower=True)
            out = []
            for d, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                if text is None or not spans:
                    out.append(text)
                    continue
                raw, a, o, keep, at = text.encode(), int(w.first[d]), int(w.offsets[d]), [], 0
                for s in spans:
                    keep.append(raw[at:int(w.starts[a + s["start"]]) - o])
                    at = int(w.ends[a + s["stop"] - 1]) - o
                out.append(b"".join([*keep, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", clean_col])
    return joined.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, `{clean_col}` string")

