"""Distinct-word tables: look every word of a corpus up once, and join the answers back by position.

A corpus is cut into blocks of about ``BLOCK_BYTES`` of text, written once to the shared folder:

* ``codes``: the words of the block's texts as numbers, most frequent word 0, in text order (byte planes, zstd);
* ``words``: the block's distinct words, dealt to shards by hash, with their numbers.

A shard gathers one copy of each word per block, so a word that makes up a third of the corpus costs a shard one
entry per block. The shard looks its distinct words up, and its answers go back to the blocks by an equi-join on
the block. What is shuffled is one row per (block, shard), and the blocks' codes; never one row per word occurrence.
The number of shards grows with the input. Blocks are read from the written table, never made twice; the table is
bucketed by block, so that only the answers are shuffled for the join back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .scratch import written_by
from .text import slices, words

BLOCK_BYTES = 10 << 20
SHARD_BYTES = 24 << 20


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(items: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(items))


def unpack_words(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


class _Block:
    """Texts gathered for one block."""

    def __init__(self):
        self.data, self.hashes, self.starts, self.lengths, self.counts, self.rows, self.size = [], [], [], [], [], [], 0

    def add(self, batch: pa.RecordBatch, kind: np.ndarray, lower: bool) -> None:
        w = words(batch.column("text"), kind, lower)
        self.data.append(w.data)
        self.hashes.append(w.hashes())
        self.starts.append((w.starts + self.size).astype(np.uint32))
        self.lengths.append((w.ends - w.starts).astype(np.uint32))
        self.counts.append(w.counts)
        self.rows.append(batch.drop_columns(["text"]))
        self.size += len(w.data)

    def coded(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by falling frequency, their hashes, the number of every word, words per text."""
        def joined(parts: list) -> np.ndarray:
            whole = np.concatenate(parts)
            parts.clear()  # the slices are not needed beside the whole
            return whole
        keys, at, code, n = np.unique(joined(self.hashes), return_index=True, return_inverse=True, return_counts=True)
        code = code.astype(np.int32)
        data, starts, length = joined(self.data), joined(self.starts), joined(self.lengths)
        # equal hashes must be equal words; compared in runs of words, as positions take more room than bytes
        same = bool((length == length[at][code]).all())
        for i in range(0, len(length) if same else 0, 1 << 16):
            n_bytes = length[i:i + (1 << 16)].astype(np.int64)
            inside = np.arange(int(n_bytes.sum())) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
            same &= bool((data[np.repeat(starts[i:i + (1 << 16)], n_bytes) + inside]
                          == data[np.repeat(starts[at][code[i:i + (1 << 16)]], n_bytes) + inside]).all())
        raw = data.tobytes()
        del data
        if not same:
            number: dict[bytes, int] = {}
            code = np.array([number.setdefault(raw[a:a + b], len(number)) for a, b in zip(starts.tolist(), length.tolist())])
            # a word that shares its hash goes to the shard of that hash, like every other copy of it
            n, at = np.bincount(code), np.unique(code, return_index=True)[1]
            keys = words(pa.array([raw[a:a + b].decode() for a, b in zip(starts[at].tolist(), length[at].tolist())]), np.ones(256, bool), lower=False).hashes()
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        distinct = [raw[a:a + b] for a, b in zip(starts[at][order].tolist(), length[at][order].tolist())]
        return distinct, keys[order], rank[code], np.concatenate(self.counts)


@dataclass(frozen=True)
class Corpus:
    """The written blocks: rows of codes (block, rows, counts, codes) and rows of words (block, shard, words, numbers, seen)."""

    codes: DataFrame
    words: DataFrame
    shards: int


_SCHEMA = "block bigint, shard int, words binary, numbers binary, seen binary, rows binary, counts binary, codes binary"


def build(rows: DataFrame, text_bytes: int, kind: np.ndarray, lower: bool, learn: str | None = None) -> Corpus:
    """Cut ``rows`` (text and further small columns) into blocks and write them.

    ``text_bytes``: about the size of all texts, which sets the number of shards. ``learn``: a boolean column; the
    words' occurrences in rows where it is true are counted as ``seen`` (without it, in all rows).
    """
    shards = max(8, -(-text_bytes // SHARD_BYTES))

    def flush(b: _Block) -> Iterator[pa.RecordBatch]:
        distinct, h, code, counts = b.coded()
        block = uuid.uuid4().int >> 65  # the table is written once, so any number that no other block has will do
        table = pa.Table.from_batches(b.rows)
        of = code
        if learn is not None:
            use = np.asarray(table.column(learn).to_numpy(zero_copy_only=False), bool)
            of = code[np.repeat(use, counts)]
        seen = np.bincount(of, minlength=len(distinct))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        held = {"block": [block], "shard": [-1], "words": [None], "numbers": [None], "seen": [None],
                "rows": [zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes())], "counts": [pack(counts)], "codes": [pack(code)]}
        shard = (h >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            at = order[cuts[s]:cuts[s + 1]]
            if len(at):
                for name, value in (("block", block), ("shard", s), ("words", pack_words([distinct[i] for i in at.tolist()])),
                                    ("numbers", pack(np.diff(at, prepend=0))), ("seen", pack(seen[at])), ("rows", None), ("counts", None), ("codes", None)):
                    held[name].append(value)
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held.values(), kinds)], list(held))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Block()
        for batch in slices(batches, "text"):
            b.add(batch, kind, lower)
            if b.size >= BLOCK_BYTES:
                yield from flush(b)
                b = _Block()
        if b.rows:
            yield from flush(b)

    buckets = max(8, -(-text_bytes // BLOCK_BYTES))
    table = written_by(rows.mapInArrow(cut, _SCHEMA), "blocks", "block", buckets)
    return Corpus(table.where("shard < 0").select("block", "rows", "counts", "codes"),
                  table.where("shard >= 0").select("block", "shard", "words", "numbers", "seen"), shards)


def _gathered(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Distinct words of a shard, how often each was seen, and their numbers in every row (block) of the shard."""
    number: dict[bytes, int] = {}
    codes = [np.array([number.setdefault(w, len(number)) for w in unpack_words(x)]) for x in table.column("words").to_pylist()]
    seen = np.zeros(len(number), np.int64)
    for c, x in zip(codes, table.column("seen").to_pylist()):
        seen[c] += unpack(x)
    return list(number), seen, codes


def per_shard(corpus: Corpus, make: Callable[[int, list[bytes], np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``make`` turns a shard's number, distinct words and counts into a table."""
    def run(table: pa.Table) -> pa.Table:
        distinct, seen, _ = _gathered(table)
        return make(table.column("shard")[0].as_py(), distinct, seen)
    return corpus.words.groupBy("shard").applyInArrow(lambda t: run(t), schema)


def answer(corpus: Corpus, lookup: Callable[..., list[bytes]], given: DataFrame | None = None) -> DataFrame:
    """(block, numbers, answer) for every (block, shard): ``lookup`` maps a shard's distinct words, and how often each
    was seen, to bytes per word. With ``given`` (shard, ...), it gets the shard's rows of that table as well."""
    def run(table: pa.Table, rows: pa.Table | None = None) -> pa.Table:
        distinct, seen, codes = _gathered(table)
        found = lookup(distinct, seen) if rows is None else lookup(distinct, seen, rows)
        out = []
        for c in codes:
            mine = [found[i] for i in c.tolist()]
            sizes = pack(np.array([len(x) for x in mine]))
            out.append(len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(mine)))
        return pa.table({"block": table.column("block"), "numbers": table.column("numbers"), "answer": pa.array(out, pa.binary())})
    schema = "block bigint, numbers binary, answer binary"
    if given is None:
        return corpus.words.groupBy("shard").applyInArrow(lambda t: run(t), schema)
    return corpus.words.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(lambda a, b: run(a, b), schema)


def join_back(corpus: Corpus, answers: DataFrame, use: Callable[[pa.Table, np.ndarray, np.ndarray, list[bytes]], pa.Table],
              schema: str) -> DataFrame:
    """Run ``use`` on every block: its rows, words per text, word numbers in text order, and the answer to each number."""
    def run(codes: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for i in range(codes.num_rows):
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(codes.column("rows")[i].as_py())).read_all()
            code = unpack(codes.column("codes")[i].as_py())
            answers_: list[bytes] = [b""] * (int(code.max()) + 1 if len(code) else 0)
            for numbers, raw in zip(found.column("numbers").to_pylist(), found.column("answer").to_pylist()):
                n = int.from_bytes(raw[:4], "little")
                stops = np.cumsum(unpack(raw[4:4 + n])).tolist()
                data = zstandard.ZstdDecompressor().decompress(raw[4 + n:])
                at = 0
                for k, stop in zip(np.cumsum(unpack(numbers)).tolist(), stops):
                    answers_[k] = data[at:stop]
                    at = stop
            out.append(use(rows, unpack(codes.column("counts")[i].as_py()), code, answers_))
        return pa.concat_tables(out)
    return corpus.codes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: run(a, b), schema)


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all texts, from one pass over the column."""
    return int(rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0)
