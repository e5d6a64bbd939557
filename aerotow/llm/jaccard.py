"""Operator 4, n-gram Jaccard join with count-vector R-trees.

Documents are sets of distinct ``SHINGLE``-word shingles; two are linked when their Jaccard similarity is at least
``PERCENT`` percent.

Method: a set's shingles are hashed into groups, and its group counts are a point. The overlap of two sets is at most
the sum of their coordinates' minima, and the overlap of two boxes of points at most the sum of the minima of their
upper corners. Points are packed by size into leaves and these into nodes up to a root; the tree is joined with itself
from the root down, pairs of nodes and then of points are kept whose bound allows the threshold, and surviving pairs
are verified on the whole sets.

One tree over all points does not prune: sets of different texts are nearly equidistant in their counts, boxes of
them overlap everywhere, and the join degenerates to all pairs. The points are therefore dealt into many small trees,
without losing a pair: two linked sets share one of the first n - ceil(0.85 n) + 1 of their shingles in any fixed
order, so there is a tree for every such shingle. The order puts frequent shingles last, by doubling frequency; the
frequencies are counted over all documents, and the most frequent ``ORDERED`` shingles are broadcast. Any order
gives the same links; this one keeps the trees small.

Steps, each a Spark job over whole tables:

1. equal sets become one class, represented by its least id;
2. in every tree, points are compared with the tree's least id of the same size band (a star, never all pairs), and
   verified links give first components;
3. where a tree still holds several components, one id of each is compared with one of the largest (a star again);
4. only trees that then hold several components are searched, each band of sizes with itself and the one below, and
   only between components. A large tree is dealt into tiles of its largest component and of the rest, so that no task
   holds more than two tiles. A pair that several trees hold is emitted in the least of them;
5. verified links of all steps give the components.

Linking within a component is settled by step 2, so a group of thousands of near copies costs its size and not its
square. No document leaves the comparison on account of a group's size.

Defined cases: a text without words (null, empty, white space) has no shingles and links with nothing; a text of
fewer words has one shingle, its whole word sequence; rows of one id are one node of the graph; a row without an id
has no component; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .scratch import written
from .text import SPACED, mix, slices, window_hashes, window_ok, words

SHINGLE = 4
PERCENT = 85
#: Groups (coordinates) of a set's count vector; sets of ``LARGE`` shingles or more have four times as many. Trees are
#: searched on ``COARSE`` coordinates, each the sum of every so many groups, and their finds held against all groups.
GROUPS = 512
COARSE = 64
LARGE = 2048
#: Shingles of known frequency in the order of prefixes (8 bytes each, broadcast), and the least frequency of them.
ORDERED = 500_000
FREQUENT = 3
#: Points of a leaf, nodes of a node above, and points of a tile of a large tree.
LEAF = 32
FAN = 4
TILE = 512
#: Least searched trees of a point that it carries, to tell in which one a pair is emitted.
KNOWN = 32
#: Ids up to this many (8 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a batch."""
    w = words(batch.column("text"), SPACED)
    h = w.hashes()
    shingles = window_hashes(h, k)
    ok = window_ok(w, k)
    place = np.flatnonzero(ok)
    cut = np.searchsorted(place, w.first)
    shingles = shingles[place]
    out = []
    for d in range(batch.num_rows):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if b - a >= k:
            s = np.sort(shingles[cut[d]:cut[d + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:  # the whole sequence; its length keeps it apart from longer windows
            out.append(mix(window_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def vector(s: np.ndarray) -> np.ndarray:
    """Group counts of a set, in as many bytes as the largest needs."""
    groups = GROUPS if len(s) < LARGE else 4 * GROUPS
    n = np.bincount((s >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)
    return n.astype(np.uint8 if n.max() <= 255 else np.uint16 if n.max() <= 65535 else np.uint32)


def _parsed(raw: bytes) -> np.ndarray:
    """The vector of the bytes; small sets have no count of four bytes."""
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint8, 8 * GROUPS: np.uint16, 16 * GROUPS: np.uint32}
    return np.frombuffer(raw, kinds[len(raw)])


def _folded(v: np.ndarray, groups: int) -> np.ndarray:
    """A vector (or rows of them) in a smaller number of groups."""
    return v.reshape(*v.shape[:-1], -1, groups).sum(-2, dtype=np.int64)


def overlap_bound(a: bytes, b: bytes) -> int:
    """Sum of the coordinates' minima."""
    x, y = _parsed(a), _parsed(b)
    if len(x) != len(y):
        x, y = _folded(x, GROUPS), _folded(y, GROUPS)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch, k)
            with np.errstate(over="ignore"):
                one = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                two = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64))],
                ["doc_id", "n", "h1", "h2"])
    return run


def _prefixes(k: int, percent: int):
    """Task: the shingles of the prefixes in plain hash order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = [s[:prefix_length(len(s), percent)] for s in shingle_sets(batch, k) if len(s)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["shingle"])
    return run


def _points(k: int, percent: int, frequent):
    """Task: doc_id, n, the prefix in the order of frequency classes, and the count vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes = (np.frombuffer(x, t) for x, t in zip(frequent.value, (np.uint64, np.uint8)))
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch, k)
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            cls = np.zeros(len(flat), np.uint8)
            if len(keys) and len(flat):
                at = np.searchsorted(keys, flat)
                at[at == len(keys)] = 0
                cls = np.where(keys[at] == flat, classes[at], 0).astype(np.uint8)
            ends = np.cumsum(sizes)
            prefix, ids, n, vec = [], [], [], []
            for d, s in enumerate(sets):
                if not len(s):
                    continue
                own = cls[ends[d] - len(s):ends[d]]
                p = prefix_length(len(s), percent)
                prefix.append(s[np.argsort(own, kind="stable")[:p]] if own.any() else s[:p])
                ids.append(d)
                n.append(len(s))
                vec.append(vector(s).tobytes())
            if ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(ids)), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix).view(np.int64))),
                    pa.array(vec, pa.binary())], ["doc_id", "n", "prefix", "vec"])
    return run


def _with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of texts with a table of ids; the ids are broadcast only while they are few."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _bounded(percent: int):
    """Task: pairs whose overlap bound allows the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            bound = np.array([overlap_bound(a, b) for a, b in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())], np.int64)
            ok = 100 * bound >= percent * (na + nb - bound)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])
    return run


def _links(rows: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, verified on the whole sets."""
    kind = dict(rows.dtypes)["doc_id"]
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch, k)], pa.binary())], ["doc_id", "s"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("u", "v")], ["u", "v"])
    held = _with_ids(rows, ids, "left_semi").mapInArrow(sets, f"doc_id {kind}, s binary")
    joined = (pairs.join(held.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
              .join(held.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))
    return joined.select(F.col("a").alias("u"), F.col("b").alias("v"), "sa", "sb").mapInArrow(verify, f"u {kind}, v {kind}").distinct()


def _allowed(n1, n2, meet, percent: int):
    return 100 * meet >= percent * (n1 + n2 - meet)


class _Points:
    """Points of some tiles, in coarse and in all groups."""

    def __init__(self, n: np.ndarray, vec: pa.Array, percent: int):
        self.n, self.percent, self.raw = n, percent, vec
        sizes = pa.compute.binary_length(vec).to_numpy()
        same = bool((sizes == sizes[0]).all())
        self.fine = None
        if same:
            kind = _parsed(vec[0].as_py()).dtype
            self.fine = np.frombuffer(b"".join(vec.to_pylist()), kind).reshape(len(vec), -1)
            self.coarse = _folded(self.fine, COARSE)
        else:
            self.coarse = np.stack([_folded(_parsed(x), COARSE) for x in vec.to_pylist()])
        self.coarse = self.coarse.astype(np.int32)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs the bound over all groups allows."""
        out = np.empty(len(i), bool)
        for at in range(0, len(i), 8192):
            x, y = i[at:at + 8192], j[at:at + 8192]
            if self.fine is not None:
                meet = np.minimum(self.fine[x], self.fine[y]).sum(1, dtype=np.int64)
            else:
                meet = np.array([overlap_bound(self.raw[a].as_py(), self.raw[b].as_py()) for a, b in zip(x.tolist(), y.tolist())])
            out[at:at + 8192] = _allowed(self.n[x], self.n[y], meet, self.percent)
        return out


class _Tree:
    """R-tree of points packed by size: leaves of ``LEAF`` points, nodes of ``FAN`` nodes up to a root."""

    def __init__(self, order: np.ndarray, n: np.ndarray, vec: np.ndarray, percent: int):
        self.order, self.percent, self.compared = order, percent, 0
        first = np.arange(0, len(order), LEAF)
        # a node's upper corner and its least and largest set
        self.levels = [(np.maximum.reduceat(vec[order], first, 0), np.minimum.reduceat(n[order], first), np.maximum.reduceat(n[order], first))]
        while len(self.levels[-1][1]) > 1:
            upper, least, most = self.levels[-1]
            first = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(upper, first, 0), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (x <= y) of leaves whose boxes allow a link, by descent from the root joined with itself."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[depth]
            if depth < len(self.levels) - 1:
                k = np.arange(FAN)
                x, y = (np.repeat(x * FAN, FAN * FAN) + np.tile(np.repeat(k, FAN), len(x)), np.repeat(y * FAN, FAN * FAN) + np.tile(np.tile(k, FAN), len(y)))
                inside = (x <= y) & (y < len(least))
                x, y = x[inside], y[inside]
            self.compared += len(x)
            ok = 100 * most[x] >= self.percent * least[y]  # sizes ascend
            x, y = x[ok], y[ok]
            meet = np.concatenate([np.minimum(upper[x[i:i + 4096]], upper[y[i:i + 4096]]).sum(1, dtype=np.int64) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
            ok = _allowed(least[x], least[y], meet, self.percent)
            x, y = x[ok], y[ok]
        return x, y


def _first_trees(shingle: np.ndarray, known: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs belong to the tree that finds them: the least tree that both points are searched in. A point
    knows its ``KNOWN`` least trees, in order; if two points share one of these, the least such is the least of all. Else
    the pair is emitted wherever it is found."""
    flat, size = known.flatten().to_numpy(), known.value_lengths().to_numpy()
    place = np.arange(KNOWN)
    first = np.cumsum(size) - size
    held = np.where(place < size[:, None], flat[np.minimum(first[:, None] + place, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 4096):
        x, y = i[at:at + 4096], j[at:at + 4096]
        both = ((held[x][:, :, None] == held[y][:, None, :]) & (place < size[y][:, None])[:, None, :]).any(2) & (place < size[x][:, None])
        least = held[x, both.argmax(1)]
        out[at:at + 4096] = ~both.any(1) | (least == shingle[x])
    return out


def _search(percent: int):
    """Task: pairs of different components in every tile (``part``) of rows that are sorted by it."""
    def small(p: _Points, part, comp, rest, own, size) -> np.ndarray:
        """Pairs of rows of the tiles that fit in a leaf, for all tiles at once."""
        found = []
        for d in range(1, min(LEAF, int(size.max()))):
            i = np.flatnonzero((part[:-d] == part[d:]) & (size[:-d] <= LEAF) & (comp[:-d] != comp[d:]) & (rest[:-d] | rest[d:]) & (own[:-d] | own[d:])
                               & (100 * np.minimum(p.n[:-d], p.n[d:]) >= percent * np.maximum(p.n[:-d], p.n[d:])))
            for at in range(0, len(i), 50_000):
                k = i[at:at + 50_000]
                k = k[_allowed(p.n[k], p.n[k + d], np.minimum(p.coarse[k], p.coarse[k + d]).sum(1, dtype=np.int64), percent)]
                found.append(np.column_stack([k, k + d]))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def large(p: _Points, lo, hi, comp, rest, own) -> list:
        """Pairs of rows lo .. hi of one tile, by their tree."""
        tree = _Tree(lo + np.argsort(p.n[lo:hi], kind="stable"), p.n, p.coarse, percent)
        found = []
        for x, y in zip(*(z.tolist() for z in tree.leaf_pairs())):
            a, b = tree.order[x * LEAF:(x + 1) * LEAF], tree.order[y * LEAF:(y + 1) * LEAF]
            may = (comp[a][:, None] != comp[b][None, :]) & (rest[a][:, None] | rest[b][None, :]) & (own[a][:, None] | own[b][None, :])
            if not may.any():
                continue
            meet = np.minimum(p.coarse[a][:, None, :], p.coarse[b][None, :, :]).sum(2, dtype=np.int64)
            ok = _allowed(p.n[a][:, None], p.n[b][None, :], meet, percent) & may
            i, j = np.nonzero(np.triu(ok, 1) if x == y else ok)
            found.append(np.column_stack([a[i], b[j]]))
        return found

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        part, n, comp, rest, own = (rows.column(c).to_numpy() for c in ("part", "n", "component", "rest", "own"))
        p = _Points(n, rows.column("vec").combine_chunks(), percent)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        found = [small(p, part, comp, rest, own, size)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > LEAF:
                found += large(p, lo, hi, comp, rest, own)
        at = np.concatenate(found)
        at = at[_first_trees(rows.column("shingle").to_numpy(), rows.column("known").combine_chunks(), at[:, 0], at[:, 1])]
        at = at[p.near(at[:, 0], at[:, 1])]
        ids = rows.column("doc_id").to_numpy()
        least, most = np.minimum(ids[at[:, 0]], ids[at[:, 1]]), np.maximum(ids[at[:, 0]], ids[at[:, 1]])
        once = np.unique(np.column_stack([least, most]), axis=0) if len(at) else np.zeros((0, 2), ids.dtype)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0], rows.schema.field("doc_id").type), pa.array(once[:, 1], rows.schema.field("doc_id").type)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))[-1])
            same = held and held[-1].column("part")[0].as_py() == int(part[-1])
            if same and last == 0:  # a tile goes on through the whole batch
                held.append(batch)
                continue
            if held or last:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield pairs(pa.Table.from_batches(held))
    return run


def _in_components(trees: DataFrame, found: DataFrame) -> DataFrame:
    """The trees' rows with the component of each."""
    return written(trees.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "tree-rows")


def _in_units(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (shingle, band, doc_id, component, own) of the units that are searched: the points of a tree in a band of
    sizes (``own``) and in the band below. Two sizes that allow a link are in one band or in neighbours."""
    band = F.floor(F.log("n") / (-math.log(percent / 100) * (1 + 1e-9))).cast("int")
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    return (rows.select("shingle", band.alias("_band"), "doc_id", "component", step.alias("_step"))
            .select("shingle", (F.col("_band") + F.col("_step")).alias("band"), "doc_id", "component", (F.col("_step") == 0).alias("own")))


def _mixed(rows: DataFrame) -> DataFrame:
    """shingle, band, component, rep (one of its ids), c, and of the unit: all, most, largest, centre (the rep of the
    largest component); only units of several components."""
    parts = rows.groupBy("shingle", "band", "component").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"), F.max("own").alias("own"))
    units = parts.groupBy("shingle", "band").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component", "rep")).alias("top"), F.count(F.lit(1)).alias("parts"), F.max("own").alias("own")).where("parts > 1 and own")
    return parts.join(units, ["shingle", "band"]).select("shingle", "band", "component", "rep", "c", "all", F.col("top.c").alias("most"), F.col("top.component").alias("largest"), F.col("top.rep").alias("centre"))


def _between_components(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components in the units that hold several."""
    kind = dict(points.dtypes)["doc_id"]
    tiles = lambda c: F.ceil(c / F.lit(TILE)).cast("int")
    units = _mixed(rows).select("shingle", "band", "all", "most", "largest").distinct()
    rows = rows.join(units, ["shingle", "band"])
    # of every pair that shares a tree, the units of that tree that hold both are searched, so both points know it
    known = rows.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("shingle")), 1, KNOWN).alias("known"))
    rows = rows.withColumn("side", F.when(F.col("component") == F.col("largest"), "G").otherwise("O"))
    rows = rows.withColumn("mg", tiles(F.col("most"))).withColumn("mo", tiles(F.col("all") - F.col("most")))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == "G", F.col("mg")).otherwise(F.col("mo"))).cast("int")
    span = lambda m: F.sequence(F.lit(0), m - 1)
    # a tile of the largest component meets every tile of the rest; tiles of the rest meet each other
    go = F.when(F.col("side") == "G", F.transform(span(F.col("mo")), lambda j: F.concat_ws(".", F.lit("g"), F.col("tile_no"), j))).otherwise(
        F.concat(F.transform(span(F.col("mg")), lambda i: F.concat_ws(".", F.lit("g"), i, F.col("tile_no"))),
                 F.transform(span(F.col("mo")), lambda j: F.concat_ws(".", F.lit("o"), F.least(j, F.col("tile_no")), F.greatest(j, F.col("tile_no"))))))
    # ``part`` names the tile; should two tiles get one name, they are searched together
    dealt = (rows.withColumn("tile_no", own).withColumn("tile", F.explode(go))
             .select(F.xxhash64("shingle", "band", "tile").alias("part"), "shingle", "doc_id", "component", (F.col("side") == "O").alias("rest"), "own")
             .join(points.select("doc_id", "n", "vec").join(known, "doc_id"), "doc_id"))
    sorted_ = dealt.repartition("part").sortWithinPartitions("part")
    return sorted_.mapInArrow(_search(percent), f"a {kind}, b {kind}").distinct()


def _allowed_pairs(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose count vectors allow a link."""
    kind = dict(points.dtypes)["doc_id"]
    vecs = points.select("doc_id", "n", "vec")
    return (pairs.join(vecs.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a")
            .join(vecs.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b")
            .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
            .mapInArrow(_bounded(percent), f"a {kind}, b {kind}"))


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark, kind = docs.sparkSession, dict(rows.dtypes)["doc_id"]
    sets = written(rows.mapInArrow(_describe(k), f"doc_id {kind}, n bigint, h1 bigint, h2 bigint"), "shingle-sets")
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1 and rep is not null")
    copies = written(sets.join(classes, ["n", "h1", "h2"]).select("doc_id", "rep").where("doc_id <> rep"), "copies")
    # an id is left out only where all its rows are copies of another id's
    alone = sets.join(classes, ["n", "h1", "h2"], "left").where("rep is null or doc_id = rep").select("doc_id").where("doc_id is not null")
    left_out = copies.select("doc_id").distinct().join(alone, "doc_id", "left_anti")
    texts = _with_ids(rows.where("doc_id is not null"), written(left_out, "left-out"), "left_anti")

    counted = texts.mapInArrow(_prefixes(k, percent), "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
    top = counted.orderBy(F.desc("c"), "shingle").limit(ORDERED).toArrow()
    keys = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order].tobytes(), np.floor(np.log2(np.maximum(top.column("c").to_numpy(), 2))).astype(np.uint8)[order].tobytes()))

    points = written(texts.mapInArrow(_points(k, percent, frequent), f"doc_id {kind}, n bigint, prefix array<bigint>, vec binary"), "points")
    # one shuffle by shingle serves the count of a tree's points and the trees themselves
    entries = points.select(F.explode("prefix").alias("shingle"), "doc_id", "n").repartition("shingle")
    shared = entries.groupBy("shingle").agg(F.count_distinct("doc_id").alias("c")).where("c > 1").select("shingle")
    trees = written(entries.join(shared, "shingle").select("shingle", "doc_id", "n").distinct(), "trees")

    # a star in every tree and band of sizes, then one between what is left apart, then the search
    band = F.floor(F.log(F.col("n")) / -math.log(percent / 100)).alias("band")
    banded = trees.select("shingle", "doc_id", "n", band)
    centre = banded.groupBy("shingle", "band").agg(F.min(F.struct("doc_id", "n")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle", "band", "m")
    star = (banded.join(centre, ["shingle", "band"]).where("m.doc_id <> doc_id").select(F.col("m.doc_id").alias("a"), F.col("doc_id").alias("b"))
            .distinct())
    links = written(_links(texts, written(_allowed_pairs(star, points, percent), "star-pairs"), k, percent), "star-links")
    rows = _in_units(_in_components(trees, components(links)), percent)
    between = _mixed(rows).where("component <> largest").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    again = _links(texts, written(_allowed_pairs(between, points, percent), "again-pairs"), k, percent)
    links = written(links.unionByName(again), "merged-links")
    rows = _in_units(_in_components(trees, components(links)), percent)
    more = written(_between_components(rows, points, percent), "tree-pairs")
    every = links.unionByName(_links(texts, more, k, percent)).unionByName(copies.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    found = components(every)
    return (sets.select("doc_id", F.col("n").alias("n_shingles"))
            .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: those whose id is not the least of its component go.

    Ids are the nodes, so rows of one id with different texts stay or go together. Of rows with the same id and the
    same text one stays. Rows without an id are in no component: one of each text stays, and none if a row with an id
    that stays has the text.
    """
    found = join(docs, id_col=id_col, text_col=text_col)
    others = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_other_id")).distinct(), "others")
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    kept = docs.join(few(others), F.col(id_col) == F.col("_other_id"), "left_anti")
    return _once(kept, id_col, text_col, few)


def _once(docs: DataFrame, id_col: str, text_col: str, few) -> DataFrame:
    """``docs`` without repeated (id, text) rows; only rows that repeat are shuffled with their texts."""
    taken = max(len(c) for c in docs.columns) * "_"  # longer than any column's name
    own_id, own_text = f"id{taken}", f"text{taken}"
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("-"))
    keys = docs.select(F.col(id_col).alias(own_id), text.alias(own_text))
    often = few(written(keys.groupBy(own_id, own_text).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "repeated"))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (text == F.col(own_text))
    repeated = docs.join(often, same, "left_semi").withColumn(own_text, text).dropDuplicates([id_col, own_text]).drop(own_text)
    once = docs.join(often, same, "left_anti").unionByName(repeated)
    alone = keys.where(F.col(own_id).isNull()).select(own_text).distinct()
    named = few(written(keys.where(F.col(own_id).isNotNull()).select(own_text).join(alone, own_text, "left_semi").distinct(), "named"))
    return once.join(named, F.col(id_col).isNull() & (text == F.col(own_text)), "left_anti")
