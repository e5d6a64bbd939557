"""Operator 9, BPE encoding and decoding by a distinct-word table.

Method: Spark cuts the texts into words at white space, every distinct word is encoded once, and the ids are joined
back by position (:mod:`blocks`). White space never lies inside a piece of the tokenizer, so the ids of a text are
those of its words in order. Decoding joins ids to pieces: the vocabulary is a table of fixed size (under 100,000
pieces), which every task reads from the tokenizer file.

The tokenizer file is a parameter; it is read on the driver and broadcast, as executors need not have it.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows give repeated rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import blocks
from .text import SPACED


def _pieces(tokenizer) -> list[str]:
    table = tokenizer.get_vocab(with_added_tokens=True)
    out = [""] * (max(table.values()) + 1)
    for piece, i in table.items():
        out[i] = piece
    return out


def _kind(tokenizer) -> str:
    """The smallest number type that holds every id."""
    return "<u2" if max(tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str):
    with open(path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    corpus = blocks.build(rows, blocks.text_bytes(rows), SPACED, lower=False)

    def encode(words: list[bytes], seen: np.ndarray) -> list[bytes]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.value)
        t.no_truncation()
        t.no_padding()
        out: list[bytes] = []
        kind = _kind(t)
        for at in range(0, len(words), 4096):
            got = t.encode_batch_fast([w.decode() for w in words[at:at + 4096]], add_special_tokens=False)
            out += [np.array(e.ids, kind).tobytes() for e in got]
        return out
    return model, corpus, blocks.answer(corpus, encode), dict(rows.dtypes)["doc_id"]


def _each(model, corpus, answers, schema: str, make) -> DataFrame:
    """``make`` turns the word numbers of each text, and the strings of the words' ids or pieces, into columns."""
    def use(rows: pa.Table, counts: np.ndarray, code: np.ndarray, found: list[bytes]) -> pa.Table:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.value)
        kind = _kind(t)
        pieces = [p.encode() for p in _pieces(t)]
        sizes = np.array([len(x) for x in found], np.int64) // np.dtype(kind).itemsize
        flat = np.frombuffer(b"".join(found), kind)
        stops = np.cumsum(sizes).tolist()
        del found[:]

        def strings(of: list[bytes]) -> list[bytes]:
            """The string of each word's ids, with ``of`` for each id."""
            out, at = [], 0
            for stop in stops:
                out.append(b" ".join([of[i] for i in flat[at:stop].tolist()]))
                at = stop
            return out
        ends = np.cumsum(counts)
        return make(rows.column("doc_id"), list(zip((ends - counts).tolist(), ends.tolist())), code, sizes, strings, pieces)
    return blocks.join_back(corpus, answers, use, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every text."""
    model, corpus, answers, kind = _coded(docs, path, id_col, text_col)

    def make(doc_id, ranges, code, sizes, strings, pieces):
        names = strings([b"%d" % i for i in range(len(pieces))])
        lists = [[int(i) for i in b" ".join([names[c] for c in code[a:b].tolist() if names[c]]).split()] for a, b in ranges]
        return pa.table({"doc_id": doc_id, "ids": pa.array(lists, pa.list_(pa.int32()))})
    return _each(model, corpus, answers, f"doc_id {kind}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the pieces of the ids in order, joined by a space, as a tokenizer without a decoder gives them."""
    from tokenizers import Tokenizer

    pieces = encoded.sparkSession.sparkContext.broadcast(_pieces(Tokenizer.from_file(path)))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def join(batches):
        names = pa.array(pieces.value, pa.string())
        for batch in batches:
            ids = batch.column("ids")
            flat = names.take(ids.flatten())
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_join(lists, " ")], ["doc_id", "decoded"])
    return rows.mapInArrow(join, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: its ids, and the text decoded from them."""
    model, corpus, answers, kind = _coded(docs, path, id_col, text_col)

    def make(doc_id, ranges, code, sizes, strings, pieces):
        def digests(of: list[bytes]) -> list[str]:
            words = strings(of)
            return [hashlib.sha256(b" ".join([words[c] for c in code[a:b].tolist() if words[c]])).hexdigest() for a, b in ranges]
        n = [int(sizes[code[a:b]].sum()) for a, b in ranges]
        ids = digests([b"%d" % i for i in range(len(pieces))])
        decoded = digests(pieces)
        return pa.table({"doc_id": doc_id, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
                         "decoded_sha256": pa.array(decoded, pa.string())})
    return _each(model, corpus, answers, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
