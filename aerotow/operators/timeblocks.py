"""Time blocks: per-flight sequence operators with bounded tasks, whatever a flight's size.

A flight's points are cut by time into blocks of about ``BLOCK_POINTS``. Every window runs inside a (flight, block);
what it needs from other blocks is a small carry that is made from one summary row per block and scanned over the
flight's blocks:

* ``previous``: the last row of the block before;
* ``following``: the first rows of the blocks behind;
* ``running_sum``: the sums of the blocks before;
* ``flight_values``: a flight's aggregates, from the aggregates of its blocks;
* ``sticky_labels``: the block's label changes as a map of states, composed over the blocks.

One plan serves all sizes. Points carry the block (``blk``) and whether their flight has several (``split``) only if a
flight exceeds a block; without these columns, block 0 and "not split" are literals, every carry is the join with an
empty table, and the optimizer leaves it out.

Points without a flight id are no flight: they stay, with their own labels and block 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import written
from .sequence import KEY, ORDER, epoch_micros

#: Points of a block (about 100 bytes each).
BLOCK_POINTS = 1_000_000
BLK, SPLIT = "blk", "split"
LOCAL = (KEY, SPLIT, BLK)
#: The grid that blocks are cut on, in microseconds; a null timestamp has the cell before all others.
CELL_MICROS = 60_000_000


def point_counts(points: DataFrame) -> tuple[int, int]:
    """Points of all flights, and of the largest one."""
    n = points.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max(F.when(F.col(KEY).isNotNull(), F.col("n"))).alias("most")).first()
    return n["all"] or 0, n["most"] or 0


def with_blocks(points: DataFrame, size: int | None = None, most: int | None = None) -> DataFrame:
    """``points`` with ``blk`` and ``split`` if a flight has more than ``size`` points, else as they are.

    Large flights are counted per minute, and whole minutes make a block, so equal timestamps share one. The table of
    minutes is written; its join with the points is a broadcast while it is small. ``most``: points of the largest
    flight, where the caller knows them.
    """
    size = size or BLOCK_POINTS
    if (point_counts(points)[1] if most is None else most) <= size:
        return points
    cell = F.coalesce(F.floor(epoch_micros() / CELL_MICROS), F.lit(-(1 << 60)).cast("bigint"))
    large = points.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select(KEY)
    cells = points.select(KEY, cell.alias("_cell")).join(large, KEY, "left_semi").groupBy(KEY, "_cell").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.select(KEY, "_cell", F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) / size).cast("int").alias(BLK)), "time-blocks")
    return (points.withColumn("_cell", cell).join(cells, [KEY, "_cell"], "left").drop("_cell")
            .withColumns({SPLIT: F.col(BLK).isNotNull(), BLK: F.coalesce(BLK, F.lit(0))}))


def blocked(df: DataFrame) -> DataFrame:
    """``df`` with ``blk`` and ``split``; where no flight is split they are literals."""
    return df if BLK in df.columns else df.withColumns({SPLIT: F.lit(False), BLK: F.lit(0)})


def block_keys(df: DataFrame) -> list[str]:
    """Columns to deal the points by."""
    return [KEY, BLK] if BLK in df.columns else [KEY]


def in_order(within: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*LOCAL, *within).orderBy(*ORDER)


def in_block(within: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*LOCAL, *within)


def _over_blocks(within: Sequence[str] = ()) -> WindowSpec:
    """A flight's blocks in order; runs over tables of one row per block."""
    return Window.partitionBy(KEY, *within).orderBy(BLK)


def previous(df: DataFrame, cols: Sequence[str], within: Sequence[str] = (), prefix: str = "_lag_") -> DataFrame:
    """``<prefix><col>``: values on the row before, in the flight (or in the flight and ``within``)."""
    row = F.struct(*cols)
    tails = df.where(SPLIT).groupBy(*LOCAL, *within).agg(F.max_by(row, F.struct(*ORDER)).alias("_tail"))
    carry = (tails.select(KEY, BLK, *within, F.lag("_tail").over(_over_blocks(within)).alias("_carry"))
             .where(F.col("_carry").isNotNull()))
    d = df.withColumn("_row", F.lag(row).over(in_order(within))).join(carry, [KEY, BLK, *within], "left")
    value = F.coalesce("_row", "_carry")  # only the first row of a block has none of its own
    return d.withColumns({f"{prefix}{c}": value[c] for c in cols}).drop("_row", "_carry")


def following(df: DataFrame, cols: Sequence[str], n: int = 1, prefix: str = "_nx_") -> DataFrame:
    """``<prefix><col>``: values ``n`` rows behind in the flight."""
    row, w = F.struct(*cols), in_order()
    heads = (df.where(SPLIT).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
             .groupBy(*LOCAL).agg(F.array_sort(F.collect_list(F.struct("_rn", row.alias("r")))).alias("_heads")))
    # every block has a row, so the next n blocks hold the next n rows
    ahead = F.flatten(F.collect_list(F.col("_heads.r")).over(_over_blocks().rowsBetween(1, n)))
    carry = heads.select(KEY, BLK, ahead.alias("_ahead")).where(F.size("_ahead") > 0)
    after = F.count(F.lit(1)).over(in_block()) - F.row_number().over(w)
    d = df.withColumns({"_row": F.lead(row, n).over(w), "_after": after.cast("int")}).join(carry, [KEY, BLK], "left")
    value = F.coalesce("_row", F.get("_ahead", F.lit(n - 1) - F.col("_after")))
    return d.withColumns({f"{prefix}{c}": value[c] for c in cols}).drop("_row", "_after", "_ahead")


def running_sum(df: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and with the row, in the flight."""
    totals = df.where(SPLIT).groupBy(*LOCAL).agg(F.sum(value).alias("_total"))
    before = _over_blocks().rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(KEY, BLK, F.sum("_total").over(before).alias("_carry")).where(F.col("_carry").isNotNull())
    own = F.sum(value).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = df.withColumn(out, own).join(carry, [KEY, BLK], "left")
    total = F.coalesce(out, F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return d.withColumn(out, F.when(F.col(out).isNull() & F.col("_carry").isNull(), F.lit(None)).otherwise(total)).drop("_carry")


def flight_values(df: DataFrame, **values: Column) -> DataFrame:
    """Aggregates of all rows of the flight, on each of them, under the names of ``values``."""
    whole = df.where(SPLIT).groupBy(KEY).agg(*(v.alias(f"_{k}") for k, v in values.items())).select(KEY, F.struct(*(F.col(f"_{k}").alias(k) for k in values)).alias("_whole"))
    d = df.withColumns({k: v.over(in_block()) for k, v in values.items()}).join(whole, KEY, "left")
    return d.withColumns({k: F.when(F.col("_whole").isNotNull(), F.col("_whole")[k]).otherwise(F.col(k)) for k in values}).drop("_whole")


class StickyStates:
    """States of sticky labels (of up to six pairs): bit i says that pair i (from, to) is armed, i.e. that a ``to`` row was followed by a
    ``from`` row in the labels that the pairs before it leave; its later ``from`` rows are ``to``.

    A row changes the state as a function of the state, its own label and the label before. Labels have codes; all
    that stand in no pair (and null) share the last one.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]]):
        self.pairs = list(pairs)
        self.labels = list(dict.fromkeys(x for p in pairs for x in p))
        self.codes, self.states = len(self.labels) + 1, 1 << len(self.pairs)

    def shown(self, state: int, label: str | None, stages: int | None = None) -> str | None:
        """A row's label after the first ``stages`` pairs."""
        for i, (frm, to) in enumerate(self.pairs[:stages]):
            if state >> i & 1 and label == frm:
                label = to
        return label

    def after(self, state: int, before: str | None, label: str | None) -> int:
        """The state that a row leaves."""
        new = state
        for i, (frm, to) in enumerate(self.pairs):
            if self.shown(state, before, i) == to and self.shown(new, label, i) == frm:
                new |= 1 << i
        return new

    @staticmethod
    def _entry(values, at: str) -> str:
        """values[at] in SQL; the numbers (below 80) are the bytes of one literal, which the planner passes on as it is."""
        return f"(ascii(cast(substring(X'{bytes(v + 48 for v in values).hex()}', {at} + 1, 1) AS string)) - 48)"

    def code(self, label: str) -> str:
        return f"CASE {label} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(self.labels)) + f" ELSE {self.codes - 1} END"

    def step(self, state: str, before: str, label: str) -> str:
        names = [*self.labels, None]
        return self._entry((self.after(s, a, b) for s in range(self.states) for a in names for b in names), f"({state} * {self.codes} + {before}) * {self.codes} + {label}")

    def show(self, state: str, code: str, label: str) -> str:
        shown = self._entry((self.labels.index(self.shown(s, x)) for s in range(self.states) for x in self.labels), f"{state} * {len(self.labels)} + {code}")
        names = ", ".join(f"'{x}'" for x in self.labels)
        return f"if({code} = {self.codes - 1}, {label}, get(array({names}), {shown}))"


def sticky_labels(df: DataFrame, pairs: Sequence[tuple[str, str]], col: str = "phase") -> DataFrame:
    """Once a ``to`` row is followed by a ``from`` row, every later ``from`` row of the flight becomes ``to``; pairs
    apply in order, each on the result of those before.

    Only label changes matter, and armed pairs stay armed: a block's changes are folded into the at most
    ``len(pairs)`` rows where its state grows, and points between them take the state of the last one. For a split
    flight, each block's changes also give a map of all states to the states they lead to; composed over the blocks,
    the maps say which blocks change the state, and so the state that each block begins with.
    """
    st = StickyStates(pairs)
    order = ", ".join(ORDER)
    d = previous(df.withColumn("_code", F.expr(st.code(col))), ["_code"], prefix="_prev")
    d = d.withColumn("_prev_code", F.expr(f"coalesce(_prev_code, {st.codes - 1})"))
    changes = (d.where("_code != _prev_code").groupBy(*LOCAL)
               .agg(F.expr(f"array_sort(collect_list(struct({order}, _prev_code AS a, _code AS b)))").alias("_changes")))

    def grown(new: str, entry: str) -> str:
        """A fold's next state, and the list of the places where the state grew."""
        return f"named_struct('s', {new}, 'seen', if({new} != acc.s, concat(acc.seen, array(struct({entry}, {new} AS s))), acc.seen))"

    # the blocks that change a split flight's state, and the state after them
    maps = changes.where(SPLIT).selectExpr(KEY, BLK, f"transform(sequence(0, {st.states - 1}), t -> aggregate(_changes, t, (s, x) -> {st.step('s', 'x.a', 'x.b')})) AS map")
    turns = (maps.groupBy(KEY).agg(F.expr(f"array_sort(collect_list(struct({BLK}, map)))").alias("maps"))
             .selectExpr(KEY, f"aggregate(maps, named_struct('s', 0, 'seen', cast(array() AS array<struct<blk:int,s:int>>)), (acc, x) -> {grown('get(x.map, acc.s)', f'x.{BLK} AS blk')}).seen AS _turns")
             .where("size(_turns) > 0"))
    # the state that a block begins with
    entry = f"if(_turns IS NULL, 0, aggregate(_turns, 0, (s, x) -> if(x.blk < {BLK}, x.s, s)))"
    kinds = dict(d.dtypes)
    none = f"cast(array() AS array<struct<{', '.join(f'{c}:{kinds[c]}' for c in ORDER)}, s:int>>)"
    place = ", ".join(f"x.{c} AS {c}" for c in ORDER)
    folded = (changes.join(turns, KEY, "left").selectExpr(KEY, BLK, "_changes", f"{entry} AS _s")
              .selectExpr(KEY, BLK, f"aggregate(_changes, named_struct('s', _s, 'seen', {none}), (acc, x) -> {grown(st.step('acc.s', 'x.a', 'x.b'), place)}).seen AS _events")
              .where("size(_events) > 0"))
    out = d.join(folded, [KEY, BLK], "left").join(turns, KEY, "left")
    state = f"if(_events IS NULL, {entry}, aggregate(_events, {entry}, (s, e) -> if(struct({', '.join(f'e.{c} AS {c}' for c in ORDER)}) <= struct({order}), e.s, s)))"
    shown = F.expr(f"if(_events IS NULL AND _turns IS NULL, {col}, {st.show(state, '_code', col)})")
    return out.withColumn(col, shown).drop("_code", "_prev_code", "_events", "_turns")
