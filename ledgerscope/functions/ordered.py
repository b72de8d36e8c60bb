"""Ordered scans over groups of any size.

A window over one key sorts the whole group in one task. The helpers here keep that plan while the
table is known to be small enough, and otherwise cut each large group into ordered slices: rows whose
hash falls on a 1-in-``split_rows`` grid give the cut points, every slice is scanned by its own task, and
one carried value per slice joins the pieces. The grid only places the cuts; no row is left out.

``order`` must be non-null columns that, with the keys, tell rows apart (aggregate duplicates first).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import cut, materialize, split_rows

# Above this many cut points the cut table is left for the optimizer to join instead of being broadcast.
BROADCAST_CUTS = 1_000_000


def fits(df: DataFrame, rows: int | None) -> bool:
    """True when a bound on the table's rows proves that no group exceeds one task's share."""
    return rows is not None and rows <= split_rows(df.sparkSession)


def _slice(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """df with ``_slice`` and ``_cuts``, or None when no row falls on the grid."""
    limit = split_rows(df.sparkSession)
    on_grid = F.pmod(F.xxhash64(*keys, *order), F.lit(limit)) == 0
    sample = cut(df.where(on_grid).select(*keys, F.struct(*order).alias("_at")).distinct())
    found = sample.count()
    if not found:
        return None
    cuts = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    if found <= BROADCAST_CUTS:
        cuts = F.broadcast(cuts)
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(found + 1)) + 1))
    here = F.struct(*order)

    def halve(box: Column, _: Column) -> Column:
        mid = F.floor((box["lo"] + box["hi"]) / 2).cast("int")
        open_ = box["lo"] < box["hi"]
        right = open_ & (F.get("_cuts", mid) <= here)
        return F.struct(
            F.when(right, mid + 1).otherwise(box["lo"]).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(box["hi"]).alias("hi"),
        )

    box = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.size("_cuts").alias("hi")), halve, lambda b: b["lo"]
    )
    return df.join(cuts, list(keys), "left").withColumn(
        "_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(box)
    )


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    out: str,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the earlier rows of the same key."""
    before = (Window.unboundedPreceding, -1)
    base, by = _with_key(df.withColumn("_w", weight), keys)
    sliced = None if fits(df, rows) else _slice(base, by, order)
    if sliced is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*before)
        done = base.withColumn(out, F.coalesce(F.sum("_w").over(w), F.lit(0)))
    else:
        w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(*before)
        local = sliced.withColumn("_here", F.coalesce(F.sum("_w").over(w), F.lit(0))).drop("_cuts")
        across = Window.partitionBy(*by).orderBy("_slice").rowsBetween(*before)
        carry = (
            sliced.where(F.col("_cuts").isNotNull())
            .groupBy(*by, "_slice")
            .agg(F.sum("_w").alias("_t"))
            .select(*by, "_slice", F.sum("_t").over(across).alias("_carry"))
        )
        done = local.join(carry, [*by, "_slice"], "left").withColumn(
            out, F.col("_here") + F.coalesce("_carry", F.lit(0))
        )
    return done.select(*df.columns, out)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int | None = None
) -> DataFrame:
    """Zero-based position of each row within its key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, rows)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``out``: ``value`` of the row just before within the same key, null for the first."""
    base, by = _with_key(df, keys)
    sliced = None if fits(df, rows) else _slice(base, by, order)
    if sliced is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return base.withColumn(out, F.lag(value).over(w)).select(*df.columns, out)
    w = Window.partitionBy(*by, "_slice").orderBy(*order)
    local = sliced.withColumn("_n", F.row_number().over(w)).withColumn("_here", F.lag(value).over(w))
    across = Window.partitionBy(*by).orderBy("_slice")
    carry = (
        sliced.where(F.col("_cuts").isNotNull())
        .groupBy(*by, "_slice")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .select(*by, "_slice", F.lag("_last").over(across).alias("_carry"))
    )
    done = local.drop("_cuts").join(carry, [*by, "_slice"], "left")
    pick = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_here"))
    return done.withColumn(out, pick).select(*df.columns, out)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    weight: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per key, nulls ignored."""
    src = df.where(F.col(value).isNotNull())
    if fits(df, rows):
        base, by = _with_key(src, keys)
        w = Window.partitionBy(*by)
        count = F.col(weight) if weight else F.lit(1)
        earlier = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ranked = base.withColumn("_c", count.cast("long")).withColumns(
            {"_b": F.coalesce(F.sum("_c").over(earlier), F.lit(0)), "_total": F.sum("_c").over(w)}
        )
    else:
        w = F.sum(weight) if weight else F.count(F.lit(1))
        runs = src.groupBy(*keys, value).agg(w.cast("long").alias("_c")).where("_c > 0")
        ranked = running_total(runs, keys, [value], F.col("_c"), "_b", rows)
        whole = runs.groupBy(*keys).agg(F.sum("_c").alias("_total"))
        if keys:
            ranked = ranked.join(whole, list(keys))
        else:
            ranked = ranked.withColumn("_total", whole.select("_total").scalar())
    aggs = []
    for name, q in quantiles.items():
        pos = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.floor(pos), F.ceil(pos)

        def at(index: Column) -> Column:
            inside = (F.col("_b") <= index) & (index < F.col("_b") + F.col("_c"))
            return F.max(F.when(inside, F.col(value).cast("double")))

        part = F.max(pos - low)
        aggs.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def percent_ranks(df: DataFrame, columns: dict[str, str], rows: int | None = None) -> DataFrame:
    """Rank of each value scaled to [0, 1], ties sharing their mean rank, 0.5 for a single row."""

    def scaled(first: Column, peers: Column, n: Column) -> Column:
        mean_rank = first + (peers - 1) / 2.0
        return F.when(n <= 1, F.lit(0.5)).otherwise((mean_rank - 1.0) / (n - 1.0))

    # Ranks are made over the distinct values with their counts, so no task sorts the table itself. The rows are written
    # once, as every column reads them.
    df = materialize(df, "to-rank")
    n = df.count()
    result = df
    for col, out in columns.items():
        values = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
        ranked = running_total(values, [], [col], F.col("_c"), "_b", rows)
        ranks = ranked.select(F.col(col).alias("_v"), scaled(F.col("_b") + 1, F.col("_c"), F.lit(n)).alias(out))
        result = result.join(ranks, result[col].eqNullSafe(F.col("_v"))).drop("_v")
    return result.select(*df.columns, *columns.values())


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows of each key; Spark trims every map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
