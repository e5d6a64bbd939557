"""Operator 12, spelling variants by blocked Gram matrices.

Words are maximal runs of Latin letters, counted over all documents. Two words are near if they differ by exactly one
inserted, deleted or replaced letter. A word's form is its near word with the most occurrences, if it has ``RATIO``
times as many; its root is the last of the forms that follow.

Method: a word is the vector of its letter counts. One edit changes a length by at most one and the squared distance of
two vectors is then at most two (one letter more: one; one letter for another: two). All squared distances between two
blocks of words come from one matrix product, as |x|^2 + |y|^2 - 2 x.y; pairs at most two apart are verified letter by
letter, for whole blocks at once.

Blocks: words of equal length with equal counts in ``GROUPS`` groups of letters. An edit moves at most one letter
between two groups or adds one to a group, so a block meets itself and only those blocks of its own and the next
length whose group counts say so; the meetings are found on the table of blocks, by an equijoin. Of two blocks the
later one is home: its words are dealt to tiles of bounded size, and the other block's words visit every tile. A task
holds a tile and a batch of visitors. Every near pair meets exactly once; what leaves a tile are each word's number of
near words and best form there, not pairs.

Nothing of the vocabulary reaches the driver or is broadcast by this code. A frequent word is counted in the tasks
before the shuffle. A block with a large share of all words costs the square of its size in products, but is spread
over its tiles; groups of letters keep blocks small.

Defined cases: null and empty texts have no words; repeated rows count again; a row without an id is hashed with the
empty id; ties for the form go to the first word in code-point order; an empty table gives no rows; words of any length
are handled (a tile holds fewer of them); further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .scratch import written
from .text import LOWER, buffers, slices

#: Least code points and occurrences of a word.
LENGTH = 6
OCCURRENCES = 5
#: A form has at least so many times the occurrences of its word.
RATIO = 5
#: A run loses a letter where this divides its hash.
DAMAGE = 199
#: Groups of letters (code point modulo this) that name a block.
GROUPS = 8
#: Words of a tile, and its letters; a task emits its counts when it holds so many distinct words.
TILE = 2048
TILE_LETTERS = 1 << 22
HELD = 1_000_000
#: Coordinates of a word's vector: a-z, and the other letters by code point modulo the rest.
LETTERS = 26
COORDINATES = 40

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with A-Z lower-cased, first and last byte (exclusive) of every run, and its text."""
    data, offsets = buffers(texts)
    data, n = LOWER[data], len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return data, none, none, none
    # U+00C0 to U+00FF are 0xC3 and one more byte
    inside = ((data >= 97) & (data <= 122)) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    edges = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges] = after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _crc(seeds: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges that go on from ``seeds``, all of them a byte at a time."""
    crc, size = ~seeds, ends - starts
    order = np.argsort(-size, kind="stable")
    crc, at, size = crc[order], starts[order], size[order]
    live = len(size)
    for j in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size[:live], -j, side="left"))  # ranges longer than j
        crc[:live] = _CRC[(crc[:live] ^ data[at[:live] + j]) & 0xFF] ^ (crc[:live] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _strings(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def damaged(batch: pa.RecordBatch, damage: int) -> pa.Array:
    """All runs of a batch (doc_id, text), where the hash says so without one letter."""
    data, starts, ends, owner = runs(batch.column("text"))
    ids = batch.column("doc_id").cast(pa.string()).fill_null("").to_pylist()
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = _crc(seeds[owner], data, starts, ends)
    hit = np.flatnonzero(h % damage == 0)
    changed = []
    for i in hit.tolist():
        w = data[starts[i]:ends[i]].tobytes().decode()
        k = int(h[i]) % len(w)
        changed.append(w[:k] + w[k + 1:])
    inside = np.zeros(len(data) + 1, np.int8)
    whole = np.ones(len(starts), bool)
    whole[hit] = False
    # runs of different texts may touch, so ends and starts can be one byte
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole], -1)
    kept = _strings(data[np.cumsum(inside[:-1]) > 0], (ends - starts)[whole])
    return pa.concat_arrays([kept, pa.array(changed, pa.large_string())])


def _counts(length: int, damage: int):
    """Task: word, n of its runs, summed before they leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in slices(batches, "text"):
            words = damaged(batch, damage)
            words = words.filter(pc.greater_equal(pc.utf8_length(words), length))
            counted = pc.value_counts(words)
            held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
            size += len(counted)
            if size > HELD:
                held = [summed()]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from (b for b in _plain(held[0]))
                    held, size = [], 0
        if held:
            yield from _plain(summed())
    return run


def _plain(t: pa.Table) -> list[pa.RecordBatch]:
    return t.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=50_000)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, damage: int = DAMAGE) -> DataFrame:
    """word, n of all words of enough letters and occurrences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counts(length, damage), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Letters:
    """Words of a batch: their code points (below 256) in one array, and the first of each word."""

    def __init__(self, words: pa.Array):
        raw = words.cast(pa.large_string()).to_pylist()
        self.flat = np.frombuffer("".join(raw).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.size) - self.size

    def groups(self, count: int) -> np.ndarray:
        """Row per word: letters in each group."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(owner * count + self.flat % count, minlength=len(self.size) * count).reshape(-1, count).astype(np.int32)

    def vectors(self) -> np.ndarray:
        """Row per word: letter counts, exact in products up to 2^53."""
        place = np.where((self.flat >= 97) & (self.flat <= 122), self.flat - 97, LETTERS + self.flat % (COORDINATES - LETTERS)).astype(np.int64)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        n = np.bincount(owner * COORDINATES + place, minlength=len(self.size) * COORDINATES).reshape(-1, COORDINATES)
        return n.astype(np.float32 if len(self.size) and self.size.max() < 1000 else np.float64)

    def padded(self, width: int, right: bool) -> np.ndarray:
        """Row per word: its letters, zeros after (or before) them."""
        out = np.zeros((len(self.size), width), np.uint8)
        shift = width - self.size if right else np.zeros(len(self.size), np.int64)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        out[owner, np.arange(len(self.flat)) - np.repeat(self.first - shift, self.size)] = self.flat
        return out


def one_edit(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Whether words a[i] differ from words b[j], of the same or of one more letter, by exactly one edit."""
    if not len(i):
        return np.zeros(0, bool)
    width = int(b.size[j].max())
    la, lb = a.padded(width, False), b.padded(width, False)
    out = np.empty(len(i), bool)
    step = max(1, TILE_LETTERS // width)
    ra = rb = None
    for at in range(0, len(i), step):
        x, y = i[at:at + step], j[at:at + step]
        off = la[x] != lb[y]
        same = a.size[x] == b.size[y]
        ok = off.sum(1) == 1
        if not same.all():
            if ra is None:
                ra, rb = a.padded(width, True), b.padded(width, True)
            ahead = np.where(off.any(1), off.argmax(1), width)  # equal letters from the left, and from the right
            end = (ra[x] != rb[y])[:, ::-1]
            behind = np.where(end.any(1), end.argmax(1), width)
            ok = np.where(same, ok, ahead + behind >= a.size[x])
        out[at:at + step] = ok
    return out


def _keys(groups: int):
    """Task: adds the block ``key`` (bytes of the group counts) and the word's letters to word, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            x = Letters(batch.column("word"))
            yield pa.RecordBatch.from_arrays([*batch.columns, _fixed(x.groups(groups)), pa.array(x.size)], [*batch.schema.names, "key", "length"])
    return run


def _fixed(counts: np.ndarray) -> pa.Array:
    counts = np.ascontiguousarray(counts, "<i4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * counts.shape[1]), len(counts), [None, pa.py_buffer(counts.tobytes())]).cast(pa.binary())


def _meetings(groups: int):
    """Task: for every block its own key and those of the blocks that one edit can reach and that are their home: one
    letter more in a group, or a letter that moved to an earlier group."""
    moves = [np.zeros(groups, np.int32)] + [np.eye(groups, dtype=np.int32)[g] for g in range(groups)]
    moves += [np.eye(groups, dtype=np.int32)[j] - np.eye(groups, dtype=np.int32)[i] for i in range(groups) for j in range(i)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.frombuffer(b"".join(batch.column("key").to_pylist()), "<i4").reshape(-1, groups)
            for m in moves:
                to = counts + m
                ok = (to >= 0).all(1)
                yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(ok)), _fixed(to[ok])], ["key", "home"])
    return run


class _Tile:
    """Home words of a tile."""

    def __init__(self, rows: pa.Table):
        self.word, self.n = rows.column("word").combine_chunks(), rows.column("n").to_numpy()
        self.key = rows.column("key")[0].as_py()
        self.letters = Letters(self.word)
        self.vec = self.letters.vectors()
        self.norm = (self.vec * self.vec).sum(1)

    def near(self, rows: pa.RecordBatch, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (visitor, home word) that are one edit apart; among words of the home block the smaller one visits."""
        x = Letters(rows.column("word"))
        v = x.vectors()
        norm = (v * v).sum(1)
        own = np.fromiter((k == self.key for k in rows.column("key").to_pylist()), bool, rows.num_rows)
        i, j = [], []
        step = max(1, (1 << 22) // len(self.norm))
        for at in range(0, len(norm), step):
            gram = v[at:at + step] @ self.vec.T
            a, b = np.nonzero(norm[at:at + step, None] + self.norm[None, :] - 2 * gram <= distance)
            i.append(a + at)
            j.append(b)
        i, j = np.concatenate(i), np.concatenate(j)
        ok = one_edit(x, i, self.letters, j)
        i, j = i[ok], j[ok]
        if own.any():
            less = pc.less(rows.column("word").take(pa.array(i)), self.word.take(pa.array(j))).to_numpy(zero_copy_only=False) if len(i) else np.zeros(0, bool)
            i, j = i[~own[i] | less], j[~own[i] | less]
        return i, j


def _best(word: pa.Array, n: np.ndarray, i: np.ndarray, other: pa.Array, m: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Row per word[i]: its near words j, their number and the best of them (most occurrences, first in order)."""
    rank = np.empty(len(other), np.int64)
    rank[pc.array_sort_indices(other).to_numpy()] = np.arange(len(other))
    order = np.lexsort((rank[j], -m[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([word.take(pa.array(i[first])), pa.array(np.diff(np.append(first, len(i)))), pa.array(m[j[first]]), other.take(pa.array(j[first]))],
                                      ["word", "n_near", "best_n", "best"])


def _gram():
    """Task over rows sorted by tile, home words (visit 0) before visitors: what every word finds in every tile."""
    def found(tile: _Tile, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        i, j = tile.near(rows)
        if len(i):
            word, n = rows.column("word"), rows.column("n").to_numpy()
            yield _best(word, n, i, tile.word, tile.n, j)
            yield _best(tile.word, tile.n, j, word, n, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, tile, at = [], None, None
        for batch in batches:
            key, number, visit = batch.column("home"), batch.column("tile").to_numpy(), batch.column("visit").to_numpy()
            codes = key.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (number[1:] != number[:-1]) | (visit[1:] != visit[:-1])])) if len(key) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
                here = (key[int(lo)].as_py(), int(number[lo]))
                rows = batch.slice(lo, hi - lo)
                if here != at:
                    home, tile, at = [], None, here
                if visit[lo] == 0:
                    home.append(rows)
                    continue
                if not home:  # no word of the block was dealt to this tile
                    continue
                tile = tile or _Tile(pa.Table.from_batches(home))
                for part in slices([rows], "word", TILE_LETTERS // 4):
                    yield from found(tile, part)
    return run


def near(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n; each once) that have near words."""
    keyed = written(words.mapInArrow(_keys(groups), "word string, n bigint, key binary, length bigint"), "spelling-words")
    per_tile = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_LETTERS) / F.col("length"))))
    blocks = written(keyed.groupBy("key", "length").agg(F.count(F.lit(1)).alias("c")).select("key", F.ceil(F.col("c") / per_tile).cast("int").alias("tiles")), "spelling-blocks")
    # the tables of blocks are small files but many rows in memory, and grow with the vocabulary: no broadcast
    meet = blocks.select("key").mapInArrow(_meetings(groups), "key binary, home binary").join(blocks.withColumnRenamed("key", "home").hint("merge"), "home")
    own = keyed.join(blocks.hint("merge"), "key").select("word", "n", "key", F.col("key").alias("home"), F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("tile"), F.lit(0).alias("visit"))
    visitors = keyed.drop("length").join(meet.hint("merge"), "key").select("word", "n", "key", "home", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("visit"))
    dealt = own.unionByName(visitors).repartition("home", "tile").sortWithinPartitions("home", "tile", "visit")
    found = dealt.mapInArrow(_gram(), "word string, n_near bigint, best_n bigint, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("x")).select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form: forms of forms, twice as far every round. Occurrences rise by ``RATIO``
    from form to form, so the rounds are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        step = written(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, groups: int = GROUPS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(vocabulary(docs, id_col, text_col), "spelling-vocabulary")
    best = words.join(near(words, groups), "word", "left")
    found = F.col("best_n") >= ratio * F.col("n")
    rows = written(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(found, F.col("best")).alias("form"), F.when(found, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
