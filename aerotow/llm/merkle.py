"""Operator 11, Merkle dataset manifest by sibling-shift self-joins.

Every row is a leaf, the SHA-256 of its columns. The leaves of a group (``source``), in order of their id, are the
bottom level of the group's tree; consecutive runs of ``ARITY`` nodes become their parent, the SHA-256 of their
digests, until one node remains, the group's subroot. The subroots, in the order of their groups, are the bottom level
of a last tree, whose root stands for the dataset.

Method: a node knows its place in its level. One equijoin per other slot of a run brings each node the sibling whose
place it computes (place XOR 1 for pairs, else the slot shifted around the run), and the rows of slot zero then emit
the parents. No run, group or level is ever gathered: (tree, place) is unique, so a source with a third of all rows is
spread like any other. Levels are written to the shared folder and shrink by the arity. Proofs go the other way: each
node hands its path to the root down to its children by an equijoin on the parent's place, and a leaf's path is hashed
and folded in the row that carries it.

Places: the leaves are range-partitioned by (group, id), numbered inside each partition, and shifted by what the
partitions before hold of the same group and of other groups. These offsets are three numbers per partition; nothing
else but the root, the number of levels and these numbers reaches the driver.

Defined cases: a null is ``-``, another value its UTF-8 byte count, ``:`` and itself, so null and empty text differ;
null groups are one group and come first; rows without an id come first in their group; rows of one id are leaves of
their own, in the order of their digests; an empty table has no nodes and no root; a lone leaf is its subroot, and a
lone subroot the root; further columns do not enter the leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written

#: Nodes of a run.
ARITY = 3
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(*(encoded(v) for v in values))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over rows sorted by group: adds the partition, the number of the row's group in it (``run``), and the row's
    place in that group."""
    part, run, at, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = batch.column("grp").dictionary_encode(null_encoding="encode")
        code = codes.indices.to_numpy()
        new = np.concatenate([[True], code[1:] != code[:-1]])
        first = codes.dictionary[int(code[0])].as_py()
        new[0] = run < 0 or first != last
        runs = run + np.cumsum(new)
        starts = np.flatnonzero(new)
        begin = np.full(n, -at)
        if len(starts):
            begin[starts[0]:] = np.repeat(starts, np.diff(np.append(starts, n)))
        place = np.arange(n) - begin
        run, at, last = int(runs[-1]), int(place[-1]) + 1, codes.dictionary[int(code[-1])].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(runs), pa.array(place)], [*batch.schema.names, "part", "run", "place"])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``tree``, the rank of ``grp`` among the groups (null first), and ``idx``, the rank of the row in its
    group by ``order``; both from 0. The rows must come from a written table."""
    # the last key tells equal rows apart, so that even they can be cut between partitions
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange("grp", *order, "_row").sortWithinPartitions("grp", *order, "_row").drop("_row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    table = written(ranged.mapInArrow(_numbered, f"{fields}, part bigint, run bigint, place bigint"), "merkle-places")
    # one row per partition: its groups, its first and last group, and how many rows of the last group end it
    ends = table.groupBy("part").agg(F.max("run").alias("runs"), F.min_by(F.struct("grp"), F.col("run")).alias("first"),
                                     F.max_by(F.struct("grp", "place"), F.struct("run", "place")).alias("last")).orderBy("part").collect()
    offsets, trees, held, last = [], 0, 0, None
    for r in ends:
        goes_on = last is not None and last == r["first"]["grp"] if trees and last is not None else bool(trees) and r["first"]["grp"] is None
        base, shift = (trees - 1, held) if goes_on else (trees, 0)
        offsets.append((r["part"], base, shift))
        held = r["last"]["place"] + 1 + (shift if r["runs"] == 0 else 0)
        trees, last = base + r["runs"] + 1, r["last"]["grp"]
    known = rows.sparkSession.createDataFrame(offsets, "part bigint, base bigint, shift bigint")
    return table.join(F.broadcast(known), "part").select(  # a row per partition
        *rows.columns, (F.col("base") + F.col("run")).alias("tree"),
        (F.col("place") + F.when(F.col("run") == 0, F.col("shift")).otherwise(0)).alias("idx"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes (tree, idx, h) of one level with the digests to the ``left`` and ``right`` of each in its run, and ``lone``:
    the only node of its tree."""
    out = nodes.select("tree", "idx", "h")
    for i in range(1, arity):
        there = "idx ^ 1" if arity == 2 else f"idx - idx % {arity} + (idx + {i}) % {arity}"
        other = nodes.selectExpr("tree AS _tree", "idx AS _idx", f"h AS s{i}")
        out = out.join(other, F.expr(f"tree = _tree AND {there} = _idx"), "left").drop("_tree", "_idx")

    def beside(slots) -> str:
        """The digests in the slots that ``slots`` names for each own slot; from slot s, slot j is j - s steps around."""
        of = [[f"coalesce(s{(j - s) % arity}, '')" for j in slots(s)] for s in range(arity)]
        return f"CASE idx % {arity} " + " ".join(f"WHEN {s} THEN concat({', '.join(x)})" for s, x in enumerate(of) if x) + " ELSE '' END"
    return out.selectExpr("tree", "idx", "h", f"{beside(range)} AS left", f"{beside(lambda s: range(s + 1, arity))} AS right", "idx = 0 AND s1 IS NULL AS lone")


@dataclass(frozen=True)
class Forest:
    """Levels from the leaves up, each (tree, idx, h, left, right, lone); the lone nodes are the trees' roots."""

    levels: list[DataFrame]
    arity: int

    def nodes(self) -> DataFrame:
        """tree, level, idx, h of every node."""
        out = [x.select("tree", F.lit(i).alias("level"), "idx", "h") for i, x in enumerate(self.levels)]
        every = out[0]
        for x in out[1:]:
            every = every.unionByName(x)
        return every

    def roots(self) -> DataFrame:
        """tree, h, height of every tree's root."""
        every = None
        for i, x in enumerate(self.levels):
            own = x.where("lone").select("tree", "h", F.lit(i).alias("height"))
            every = own if every is None else every.unionByName(own)
        return every

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, idx, path of every leaf, and the further columns of ``above`` (tree, height, path from the tree's root
        upwards). A path lists the digests to the left and right of the node on every level."""
        more = [c for c in above.columns if c not in ("tree", "height", "path")]
        up = None
        for i in reversed(range(len(self.levels))):
            # a tree's root takes its path from ``above``, as place -1
            own = above.where(f"height = {i}").selectExpr("tree AS _tree", "-1L AS _idx", "path", *more)
            up = own if up is None else up.unionByName(own)
            up = (self.levels[i].join(up, F.expr(f"tree = _tree AND if(lone, -1L, idx div {self.arity}) = _idx"))
                  .selectExpr("tree AS _tree", "idx AS _idx", "if(lone, path, concat(array(struct(left, right)), path)) AS path", *more))
        up = up.withColumnsRenamed({"_tree": "tree", "_idx": "idx"})
        return up


def build(leaves: DataFrame, arity: int = ARITY) -> Forest:
    """All levels above ``leaves`` (tree, idx from 0 without gaps, h)."""
    most = (leaves.agg(F.max("idx")).first()[0] or 0) + 1  # nodes of the largest tree
    levels, now = [], leaves
    while True:
        levels.append(written(with_siblings(now, arity), "merkle-level"))
        if most <= 1:
            return Forest(levels, arity)
        most = -(-most // arity)
        now = (levels[-1].where(f"idx % {arity} = 0 AND NOT lone")
               .selectExpr("tree", f"idx div {arity} AS idx", "sha2(concat(h, right), 256) AS h"))


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, the tree over their subroots, the root, and the leaves (the table's columns but those
    that only enter the digest, and ``leaf``, ``tree``, ``idx``)."""

    groups: Forest
    top: Forest
    root: str | None
    leaves: DataFrame


def manifest(docs: DataFrame, leaf: Column | None = None, group: str = "source", order: str = "doc_id", arity: int = ARITY, **more: Column) -> Manifest:
    """Manifest of ``docs``; ``leaf`` is a row's digest (default: of ``COLUMNS``), ``more`` are columns to keep."""
    leaf = leaf_digest([F.col(c) for c in COLUMNS]) if leaf is None else leaf
    rows = written(docs.select(F.col(group).alias("grp"), F.col(order).alias("id"), leaf.alias("leaf"), *(v.alias(k) for k, v in more.items())), "merkle-leaves")
    leaves = written(placed(rows, "id", "leaf"), "merkle-placed")
    groups = build(leaves.select("tree", "idx", F.col("leaf").alias("h")), arity)
    subroots = groups.roots().select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "h")
    top = build(written(subroots, "merkle-subroots"), arity)
    root = top.roots().select("h").first()
    return Manifest(groups, top, root and root["h"], leaves)


def proofs(m: Manifest) -> DataFrame:
    """The leaves with ``subroot``, ``root`` and ``path``, the siblings from the leaf's level to the root's."""
    start = m.top.roots().select("tree", "height", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    over = m.top.paths(start).select(F.col("idx").alias("tree"), "path")
    above = written(m.groups.roots().withColumnRenamed("h", "subroot").join(over, "tree"), "merkle-above")
    found = m.groups.paths(above).withColumnsRenamed({"tree": "_tree", "idx": "_idx"})
    return (m.leaves.join(found, (F.col("tree") == F.col("_tree")) & (F.col("idx") == F.col("_idx")))
            .select(*m.leaves.columns, "subroot", F.lit(m.root).alias("root"), "path"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verify(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and whether its proof holds for the tampered row."""
    values = {c: F.col(c) for c in COLUMNS}
    changed = {**values, "text": tampered_text(values["doc_id"], values["text"])}
    m = manifest(docs, arity=arity, now=leaf_digest(list(changed.values())))
    again = folded(F.col("now"), F.col("path"))
    return proofs(m).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                            again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
