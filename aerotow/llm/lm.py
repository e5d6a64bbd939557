"""Operator 6, LM scoring by prediction by partial matching (PPM).

Model: a byte-context trie of order ``ORDER``, pretrained on the learning documents. A text is its lower-cased words
and an end mark; a word is its bytes and a closing space, and contexts reach back to the space before the word, so a
word's code length does not depend on its neighbours. A symbol is coded in its longest seen context with the escape
estimate d / (T + d) (T symbols, d of them distinct); every escape goes one order down, where the symbols of the
longer context are excluded from T and d; below order 0, the unseen symbols share the rest evenly. The code lengths
are those of a proper distribution over texts.

The trie is a set of tables keyed by context and symbol (40-bit numbers), made by grouped sums over the distinct words
of all learning documents; it grows with the corpus and is never broadcast. Every distinct word is scored once
(:mod:`blocks`): a shard of words asks for the trie rows of its byte strings by an equi-join, and the words' code
lengths go back to the texts by position, along with the word counts for the unigram base score.

Contexts across words (``across``): each text is cut from its own start, so contexts run over the spaces and word order
counts. Texts are gathered into blocks; a block's distinct keys are dealt to shards, which count them, and the shards'
answers go back to the blocks, where every text's symbols are looked up. Shuffled are distinct keys of blocks, not texts.

Defined cases: a null or empty text is the end mark alone; with nothing to learn from every symbol is equally likely;
repeated rows count, and are scored, as often as they stand there; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks
from .blocks import pack, unpack  # by name: tasks carry the functions, and workers need no copy of the package
from .scratch import written, written_by
from .text import SPACED, mix, slices, words

ORDER = 4
SYMBOLS = 256
#: The end mark in the place of a word's first byte; no UTF-8 text holds this byte.
END = 0xFF
#: Key of the end mark after the context that opens a word.
END_KEY = (0x20 << 8) | END
#: About so much text makes a block of contexts across words.
CONTEXT_BYTES = 6 << 20


def word_keys(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ORDER context bytes, symbol) of all symbols of the words, and the first key of each word."""
    lead = b"\0" * (ORDER - 1) + b" "
    a = np.frombuffer(b"".join([lead + w + b" " for w in items]), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in items], np.int64)
    ends = np.cumsum(sizes + ORDER)
    at = np.ones(len(a), bool)
    for j in range(ORDER):
        at[ends - sizes - ORDER + j] = False
    place = np.flatnonzero(at)
    keys = a[place]
    for j in range(1, ORDER + 1):
        keys = keys | (a[place - j] << (8 * j))
    return keys, np.cumsum(sizes) - sizes


def _counts(shard: int, items: list[bytes], seen: np.ndarray) -> pa.Table:
    """Distinct keys of a shard's words with their counts; key -1: distinct seen words; key -2: seen words."""
    keys, first = word_keys(items)
    weight = np.repeat(seen, np.diff(np.append(first, len(keys))))
    distinct, code = np.unique(keys, return_inverse=True)
    n = np.zeros(len(distinct), np.int64)
    np.add.at(n, code, weight)
    keys_out = np.concatenate([distinct, [-1, -2]])
    n_out = np.concatenate([n, [int((seen > 0).sum()), int(seen.sum())]])
    return pa.table({"shard": pa.array(np.full(len(keys_out), shard), pa.int32()), "key": pa.array(keys_out, pa.int64()), "n": pa.array(n_out, pa.int64())})


def _totals(shard: int, items: list[bytes], seen: np.ndarray) -> pa.Table:
    """The last two rows of :func:`_counts`."""
    return pa.table({"shard": pa.array([shard, shard], pa.int32()), "key": pa.array([-1, -2], pa.int64()),
                     "n": pa.array([int((seen > 0).sum()), int(seen.sum())], pa.int64())})


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and their sizes: each is the opening context, its words with a space after each, the end mark."""
    w = words(texts, SPACED)
    length = w.ends - w.starts
    before = np.concatenate([[0], np.cumsum(length + 1)])
    sizes = before[w.first[1:]] - before[w.first[:-1]] + ORDER + 1
    begin = np.cumsum(sizes) - sizes
    owner = w.owner()
    to = begin[owner] + ORDER + before[:-1] - before[w.first[:-1]][owner]
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    out[np.repeat(to - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = w.data[SPACED[w.data]]
    for j in range(ORDER - 1):
        out[begin + j] = 0
    out[begin + sizes - 1] = END
    return out, sizes


def text_keys(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of all symbols of texts laid out one after the other; ``sizes - ORDER`` keys a text."""
    keys = data.astype(np.int64)
    for j in range(1, ORDER + 1):
        keys[j:] |= data[:-j].astype(np.int64) << (8 * j)
    at = np.ones(len(data), bool)
    begin = np.cumsum(sizes) - sizes
    for j in range(ORDER):
        at[begin + j] = False
    return keys[at]


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(20)) % np.uint64(shards)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their steps."""
    planes = np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").reshape(-1))


def _across(rows: DataFrame, text_bytes: int) -> DataFrame:
    """The columns of ``rows`` but the text, and ``score``: PPM with contexts that run over the whole text."""
    shards = max(8, -(-text_bytes // blocks.SHARD_BYTES))
    press = lambda x: zstandard.ZstdCompressor(level=3).compress(x)

    def flush(data: list, sizes: list, held: list) -> Iterator[pa.RecordBatch]:
        a, n, table = np.concatenate(data), np.concatenate(sizes), pa.Table.from_batches(held)
        keys = text_keys(a, n)
        use = np.asarray(table.column("learned").to_numpy(zero_copy_only=False), bool)
        distinct = np.unique(keys)
        learned, count = np.unique(keys[np.repeat(use, n - ORDER)], return_counts=True)
        seen = np.zeros(len(distinct), np.int64)
        seen[np.searchsorted(distinct, learned)] = count
        del keys
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        block = uuid.uuid4().int >> 65
        rec = [(block, -1, press(sink.getvalue().to_pybytes()), pack(n), press(a.tobytes()))]
        shard = _shard_of(distinct, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            at = order[cuts[s]:cuts[s + 1]]
            if len(at):
                rec.append((block, s, _pack_keys(distinct[at]), pack(seen[at]), None))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rec), kinds)], ["block", "shard", "a", "b", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes, held, size = [], [], [], 0
        for batch in slices(batches, "text"):
            a, n = laid_out(batch.column("text"))
            data.append(a)
            sizes.append(n)
            held.append(batch.drop_columns(["text"]))
            size += len(a)
            if size >= CONTEXT_BYTES:
                yield from flush(data, sizes, held)
                data, sizes, held, size = [], [], [], 0
        if held:
            yield from flush(data, sizes, held)

    buckets = max(8, -(-text_bytes // CONTEXT_BYTES))
    table = written_by(rows.mapInArrow(cut, "block bigint, shard int, a binary, b binary, data binary"), "contexts", "block", buckets)
    texts = table.where("shard < 0").select("block", "a", "b", "data")
    asked = table.where("shard >= 0").select("block", "shard", "a", "b")

    def gather(t: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack_keys(x) for x in t.column("a").to_pylist()])
        seen = np.concatenate([unpack(x) for x in t.column("b").to_pylist()])
        distinct, code = np.unique(keys, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, code, seen)
        shard = np.full(len(distinct), t.column("shard")[0].as_py(), np.int32)
        return pa.table({"shard": shard, "key": distinct, "n": n})
    counts = written(asked.groupBy("shard").applyInArrow(lambda t: gather(t), "shard int, key bigint, n bigint"), "lm-contexts")
    lp = written(trie(counts.select("key", "n")), "lm-trie")
    given = counts.select("shard", "key").join(lp, "key")

    def reply(t: pa.Table, rows_: pa.Table) -> pa.Table:
        have, value = rows_.column("key").to_numpy(), rows_.column("lp").to_numpy()
        order = np.argsort(have)
        have, value = have[order], value[order]
        out = [press(value[np.searchsorted(have, _unpack_keys(x))].tobytes()) for x in t.column("a").to_pylist()]
        return pa.table({"block": t.column("block"), "shard": t.column("shard"), "answer": pa.array(out, pa.binary())})
    answers = asked.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(
        lambda x, y: reply(x, y), "block bigint, shard int, answer binary")

    def total(t: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for i in range(t.num_rows):
            own = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(t.column("a")[i].as_py())).read_all()
            n = unpack(t.column("b")[i].as_py())
            keys = text_keys(np.frombuffer(zstandard.ZstdDecompressor().decompress(t.column("data")[i].as_py()), np.uint8), n)
            distinct = np.unique(keys)
            shard, value = _shard_of(distinct, shards), np.empty(len(distinct))
            for s, raw in zip(found.column("shard").to_pylist(), found.column("answer").to_pylist()):
                value[shard == s] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.float64)
            each = value[np.searchsorted(distinct, keys)]
            first = np.cumsum(n - ORDER) - (n - ORDER)
            out.append(own.append_column("score", pa.array(np.add.reduceat(each, first))))
        return pa.concat_tables(out)
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != "text") + ", score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: total(x, y), schema)


def trie(counts: DataFrame) -> DataFrame:
    """(key, lp): log10 probability of every key (context and symbol) of ``counts`` (key, n), n 0 for keys to be scored only."""
    mask = lambda j: F.lit((1 << (8 * (j + 1))) - 1)
    level: dict[int, DataFrame] = {ORDER: counts.where("n > 0").select("key", F.col("n").cast("double").alias("n"))}
    for j in range(ORDER - 1, -1, -1):
        level[j] = level[j + 1].groupBy(F.col("key").bitwiseAND(mask(j)).alias("key")).agg(F.sum("n").alias("n"))
    out = counts.select("key").distinct()
    for j in range(ORDER, -1, -1):
        own = level[j].select(F.col("key").alias("k"), "n", F.shiftright("key", 8).alias("context"))
        if j:
            below = level[j - 1].select(F.col("key").alias("kb"), F.col("n").alias("m"))
            own = own.join(below, F.col("k").bitwiseAND(mask(j - 1)) == F.col("kb"))
        else:
            own = own.withColumn("m", F.lit(0.0))
        # of each context: symbols, distinct symbols, and what its symbols count in the context one shorter
        context = own.groupBy("context").agg(F.sum("n").alias(f"t{j}"), F.count(F.lit(1)).cast("double").alias(f"d{j}"), F.sum("m").alias(f"x{j}"))
        node = level[j].select(F.col("key").alias(f"k{j}"), F.col("n").alias(f"n{j}"))
        out = (out.join(node, F.col("key").bitwiseAND(mask(j)) == F.col(f"k{j}"), "left").drop(f"k{j}")
               .join(context.withColumnRenamed("context", f"c{j}"), F.shiftright(F.col("key").bitwiseAND(mask(j)), 8) == F.col(f"c{j}"), "left").drop(f"c{j}"))
    out = out.withColumn("lp", -F.log10(F.greatest(F.lit(float(SYMBOLS)) - F.coalesce("d0", F.lit(0.0)), F.lit(1.0))))
    for j in range(ORDER + 1):
        t, d, lower = F.col(f"t{j}"), F.col(f"d{j}"), F.col("lp")
        if j < ORDER:
            t, d = t - F.coalesce(f"x{j + 1}", F.lit(0.0)), d - F.coalesce(f"d{j + 1}", F.lit(0.0))
        # with all symbols seen at order 0 there is nothing to escape to
        room = t + d if j else F.when(F.col("d0") < SYMBOLS, t + d).otherwise(t)
        out = out.withColumn("lp", F.when(F.col(f"t{j}").isNull(), lower).when(F.col(f"n{j}") > 0, F.log10(F.try_divide(F.col(f"n{j}"), room)))
                             .when(t + d <= 0, lower).otherwise(F.log10(F.try_divide(d, t + d)) + lower))
    return out.select("key", "lp")


def _with_base(rows: DataFrame, corpus: blocks.Corpus, text_bytes: int, n_all: int, norm: float, end_base: float,
               texts: int) -> DataFrame:
    """Rows of :func:`score` with contexts across words; the word figures depend on the text and are joined by its hash."""
    def lookup(items: list[bytes], seen: np.ndarray) -> list[bytes]:
        return [x.tobytes() for x in seen.astype(np.float64)]

    def use(table: pa.Table, counts_: np.ndarray, code: np.ndarray, found: list[bytes]) -> pa.Table:
        seen = np.frombuffer(b"".join(found), np.float64)
        edge = np.cumsum(counts_) - counts_
        known, base = np.zeros(len(counts_)), np.zeros(len(counts_))
        if len(code):
            some = counts_ > 0
            known[some] = np.add.reduceat((seen > 0).astype(float)[code], edge[some])
            base[some] = np.add.reduceat((np.log10(seen + 1) - norm)[code], edge[some])
        return pa.table({"_id": table.column("doc_id"), "_hash": table.column("text_hash"), "n_tokens": pa.array(counts_ + 1, pa.int64()),
                         "n_known": pa.array(known.astype(np.int64) + (texts > 0), pa.int64()), "base_score": pa.array(base + end_base)})
    schema = f"_id {dict(rows.dtypes)['doc_id']}, _hash bigint, n_tokens bigint, n_known bigint, base_score double"
    base = blocks.join_back(corpus, blocks.answer(corpus, lookup), use, schema).dropDuplicates(["_id", "_hash"])
    return (_across(rows, text_bytes).join(base, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
            .select("doc_id", "learned", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score"))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", across: bool = False) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score (unigram) and score (PPM), both log10.

    ``learn`` marks the rows to learn from. ``across``: the PPM contexts run over the whole text, not from the space
    before each word.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    if across:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learned").cast("bigint")).alias("texts")).first()
    texts = int(total.texts or 0)
    corpus = blocks.build(rows, int(total.bytes or 0), SPACED, lower=True, learn="learned")
    per_shard = blocks.per_shard(corpus, _totals if across else _counts, "shard int, key bigint, n bigint")
    keys = written(per_shard, "lm-keys")
    stats = {r.key: r.n for r in keys.where("key < 0").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    n_all = int(stats.get(-2, 0)) + texts
    distinct = int(stats.get(-1, 0)) + (texts > 0)
    norm = math.log10(n_all + distinct + 1)
    end_base = math.log10(texts + 1) - norm
    if across:
        return _with_base(rows, corpus, int(total.bytes or 0), n_all, norm, end_base, texts)
    ends = spark.createDataFrame([(END_KEY, texts)], "key bigint, n bigint")
    counts = written(keys.where("key >= 0").select("key", "n").unionByName(ends).groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    lp = written(trie(counts), "lm-trie")
    end_lp = float(lp.where(F.col("key") == END_KEY).first().lp)
    given = keys.where("key >= 0").select("shard", "key").join(lp, "key")

    def lookup(items: list[bytes], seen: np.ndarray, table: pa.Table) -> list[bytes]:
        have, value = table.column("key").to_numpy(), table.column("lp").to_numpy()
        order = np.argsort(have)
        want, first = word_keys(items)
        each = np.add.reduceat(value[order][np.searchsorted(have[order], want)], first)
        out = np.empty((len(items), 2))
        out[:, 0], out[:, 1] = seen, each
        raw = out.tobytes()
        return [raw[i:i + 16] for i in range(0, len(raw), 16)]

    def use(table: pa.Table, counts_: np.ndarray, code: np.ndarray, found: list[bytes]) -> pa.Table:
        value = np.frombuffer(b"".join(found), np.float64).reshape(-1, 2)
        first = np.cumsum(counts_) - counts_

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(counts_))
            if len(code):
                out[counts_ > 0] = np.add.reduceat(x[code], first[counts_ > 0])
            return out
        known = sums((value[:, 0] > 0).astype(float)) if len(code) else np.zeros(len(counts_))
        base = sums(np.log10(value[:, 0] + 1) - norm) if len(code) else np.zeros(len(counts_))
        ppm = sums(value[:, 1]) if len(code) else np.zeros(len(counts_))
        n = len(counts_)
        return pa.table({
            "doc_id": table.column("doc_id"), "learned": table.column("learned"), "n_tokens": pa.array(counts_ + 1, pa.int64()),
            "n_known": pa.array(known.astype(np.int64) + (texts > 0), pa.int64()), "train_tokens": pa.array(np.full(n, n_all), pa.int64()),
            "base_score": pa.array(base + end_base), "score": pa.array(ppm + end_lp)})
    schema = f"doc_id {kind}, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.join_back(corpus, blocks.answer(corpus, lookup, given), use, schema)
