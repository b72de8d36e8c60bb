"""Joins of two tables by nearness in time, swept in order.

Both sides are cut into slices of about ``SLICE`` rows in the order of time and a hash, so that even rows of one instant
spread over slices. A row enters a tile for every slice of the other side that its window touches: a pair meets in the
tile of its two slices and nowhere else. A tile is one sorted sweep in one task: it holds one slice of the right side
and streams the left, finding the window of each row by binary search; nothing is compared that does not match.

Cut points are rows on a hash grid, one in ``SLICE``, and go to the driver and into the tasks: at ten billion rows
150,000 of them. The grid only places the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 16
# Pairs of one batch passed on.
BATCH_PAIRS = 1 << 16


def cut_points(df: DataFrame, step: int) -> np.ndarray:
    """(at, tie) of the rows on the grid, in order, as two rows of one array."""
    on_grid = F.pmod(F.xxhash64("at", "tie"), F.lit(step)) == 0
    found = sorted(tuple(r) for r in df.where(on_grid).select("at", "tie").distinct().collect())
    return np.array(found, np.int64).reshape(-1, 2).T


def own_slice(cuts: np.ndarray, at: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of cut points at or before each (at, tie)."""
    first, last = np.searchsorted(cuts[0], at, "left"), np.searchsorted(cuts[0], at, "right")
    place = last.copy()
    # Instants that hold cut points themselves are told apart by the tie.
    for i in np.flatnonzero(last > first):
        place[i] = first[i] + np.searchsorted(cuts[1][first[i] : last[i]], tie[i], "right")
    return place


def _dealt(df: DataFrame, own: np.ndarray, other: np.ndarray, before: int, after: int, left: bool) -> DataFrame:
    """Rows with their tiles: (l, r), the slices of the left and the right side."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tie = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("at", "tie"))
            mine = own_slice(own, at, tie)
            # Slices of the other side that can hold rows from at - before to at + after.
            low, high = np.searchsorted(other[0], at - before, "left"), np.searchsorted(other[0], at + after, "right")
            many = high - low + 1
            row = np.repeat(np.arange(len(at)), many)
            theirs = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            tiles = (mine[row], theirs) if left else (theirs, mine[row])
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(row)).columns, *(pa.array(t, pa.int64()) for t in tiles)], names=[*batch.schema.names, "l", "r"]
            )

    return df.mapInArrow(work, f"{schema}, l bigint, r bigint")


def window_pairs(
    left: DataFrame, right: DataFrame, at: tuple[str, str], before: int, after: int, step: int = SLICE
) -> DataFrame:
    """All pairs of rows whose right time lies from ``before`` ahead of to ``after`` behind the left one, both included.

    ``at`` names the time of each side as a long. Columns of both sides are returned and must differ in name. Rows
    without a time match nothing; repeated rows match each.
    """
    spark = left.sparkSession
    names = (left.columns, right.columns)
    sides = []
    for df, time in zip((left, right), at):
        kept = df.where(F.col(time).isNotNull())
        packed = F.struct(*(F.col(c) for c in kept.columns))
        sides.append(kept.select(F.col(time).cast("long").alias("at"), F.xxhash64(*kept.columns).alias("tie"), packed.alias("row")))
    cuts = [cut_points(s, step) for s in sides]
    null = F.lit(None)
    one = _dealt(sides[0], cuts[0], cuts[1], before, after, True)
    two = _dealt(sides[1], cuts[1], cuts[0], after, before, False)
    kinds = [s.schema["row"].dataType for s in sides]
    both = one.select("l", "r", F.lit(1).alias("side"), "at", F.col("row").alias("a"), null.cast(kinds[1]).alias("b")).unionByName(
        two.select("l", "r", F.lit(0).alias("side"), "at", null.cast(kinds[0]).alias("a"), F.col("row").alias("b"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = both.repartition(parts, "l", "r").sortWithinPartitions("l", "r", "side", "at")
    schema = f"a {kinds[0].simpleString()}, b {kinds[1].simpleString()}"
    pairs = tiles.mapInArrow(_Sweep(before, after), schema)
    return pairs.select(*(F.col(f"a.`{c}`").alias(c) for c in names[0]), *(F.col(f"b.`{c}`").alias(c) for c in names[1]))


class _Sweep:
    """Sweeps the tiles of one partition: right rows of a tile come first and are kept, left rows pass by."""

    def __init__(self, before: int, after: int) -> None:
        self.before, self.after = before, after

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, times = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("l", "r", "side")])
            at = batch.column("at").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                here = (keys[0, a], keys[1, a])
                if here != tile:
                    tile, held, times = here, [], []
                if keys[2, a] == 0:
                    held.append(batch.column("b").slice(a, b - a))
                    times.append(at[a:b])
                elif held:
                    if len(held) > 1:
                        held, times = [pa.concat_arrays(held)], [np.concatenate(times)]
                    yield from self.matches(batch.column("a").slice(a, b - a), at[a:b], held[0], times[0])

    def matches(self, rows: pa.Array, at: np.ndarray, held: pa.Array, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = np.searchsorted(times, at - self.before, "left")
        many = np.searchsorted(times, at + self.after, "right") - low
        ends = np.cumsum(many)
        for start in range(0, int(ends[-1]), BATCH_PAIRS):
            n = np.arange(start, min(start + BATCH_PAIRS, int(ends[-1])))
            row = np.searchsorted(ends, n, "right")
            other = low[row] + n - (ends[row] - many[row])
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(row)), held.take(pa.array(other))], names=["a", "b"])


def latest_before(left: DataFrame, right: DataFrame, at: tuple[str, str], tie: str, step: int = SLICE) -> DataFrame:
    """Every left row with the right row at or before its time, nulls where there is none: an as-of join.

    Both sides are ranged by time into slices cut on the grid of the right side; a slice is one sorted pass, and a slice
    that begins before its first right row takes over the last one of the slices ahead, one row a slice. Of right rows
    of one time the one with the greatest ``tie`` counts. Columns of both sides must differ in name.
    """
    right_row, left_row = F.struct(*right.columns), F.struct(*left.columns)
    # One row an instant on the right, so that a slice never divides an instant.
    heads = right.where(F.col(at[1]).isNotNull()).groupBy(F.col(at[1]).cast("long").alias("at")).agg(F.max_by(right_row, F.col(tie)).alias("b"))
    cuts = cut_points(heads.select("at", F.lit(0).cast("long").alias("tie")), step)[0].tolist()
    timed = left.select(F.col(at[0]).cast("long").alias("at"), left_row.alias("a"))
    kinds = (heads.schema["b"].dataType, timed.schema["a"].dataType)
    events = heads.select("at", F.lit(0).alias("side"), F.lit(None).cast(kinds[1]).alias("a"), "b").unionByName(
        timed.where("at is not null").select("at", F.lit(1).alias("side"), "a", F.lit(None).cast(kinds[0]).alias("b"))
    )
    # A busy instant of the left side is dealt over lanes, each of which is given the slice's right rows.
    lanes = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    busy = timed.where("at is not null").groupBy(_slice_of(cuts).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    width = F.least(F.lit(lanes), F.ceil(F.col("n") / step).cast("int"))
    events = events.withColumn("slice", _slice_of(cuts)).join(F.broadcast(busy), "slice", "left").withColumn("lanes", F.coalesce(width, F.lit(1)))
    drawn = F.when(F.col("side") == 1, F.array(F.pmod(F.xxhash64("a"), F.col("lanes")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("lanes") - 1)
    )
    dealt = events.select("slice", "at", "side", "a", "b", F.explode(drawn).alias("lane"))
    before = Window.partitionBy("slice", "lane").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("b", F.last("b", ignorenulls=True).over(before)).where("side = 1")
    ends = heads.withColumn("slice", _slice_of(cuts)).groupBy("slice").agg(F.max_by("b", "at").alias("end"))
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row a slice: the last right row of the slices ahead, for slices without right rows as well.
    slices = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("slice")).join(ends, "slice", "left")
    carried = slices.select("slice", F.last("end", ignorenulls=True).over(ahead).alias("carried"))
    whole = found.join(carried, "slice").select("a", F.coalesce("b", "carried").alias("b"))
    untimed = timed.where("at is null").select("a", F.lit(None).cast(kinds[0]).alias("b"))
    return whole.unionByName(untimed).select(*(F.col(f"a.`{c}`").alias(c) for c in left.columns), *(F.col(f"b.`{c}`").alias(c) for c in right.columns))


def _slice_of(cuts: list[int]) -> Column:
    """Number of cut points at or before ``at``, by halving."""
    points = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")

    def halve(box: Column, _: Column) -> Column:
        mid = F.floor((box["lo"] + box["hi"]) / 2).cast("int")
        open_ = box["lo"] < box["hi"]
        right = open_ & (F.get(box["cuts"], mid) <= F.col("at"))
        return F.struct(
            box["cuts"].alias("cuts"),
            F.when(right, mid + 1).otherwise(box["lo"]).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(box["hi"]).alias("hi"),
        )

    start = F.struct(points.alias("cuts"), F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length() + 1)), start, halve, lambda b: b["lo"])
