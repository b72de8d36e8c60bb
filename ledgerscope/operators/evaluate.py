"""Model evaluation over a table of (id, y, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.ordered import running_total


def confusion(scored: DataFrame, by: list[str] | None = None, threshold: Column | float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 at a threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    flagged, bad = F.col("score") >= limit, F.col("y") == 1
    counted = scored.groupBy(*(by or [])).agg(
        F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counted.withColumns(
        {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}
    )


def _by_score(scored: DataFrame, rows: int | None) -> DataFrame:
    """One row per distinct score, highest first, with positives and rows above it."""
    runs = scored.groupBy("score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c")).withColumn("down", -F.col("score"))
    with_p = running_total(runs, [], ["down"], F.col("p"), "p_above", rows)
    return running_total(with_p, [], ["down"], F.col("c"), "c_above", rows)


def areas(scored: DataFrame, rows: int | None = None) -> DataFrame:
    """(roc_auc, pr_auc): rank statistic with ties halved, and average precision over distinct scores."""
    ranked = _by_score(scored, rows)
    p, n = F.col("p"), F.col("c") - F.col("p")
    reached = (F.col("p_above") + p) / (F.col("c_above") + F.col("c"))
    sums = ranked.agg(
        F.sum(n * (F.col("p_above") + p / 2.0)).alias("won"),
        F.sum(p).alias("pos"),
        F.sum(n).alias("neg"),
        F.sum(p * reached).alias("area"),
    )
    return sums.select(
        (F.col("won") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), (F.col("area") / F.col("pos")).alias("pr_auc")
    )


def at_k(scored: DataFrame, ks: tuple[int, ...] = (100, 500, 1000)) -> DataFrame:
    """(k, precision, recall) among the k highest scores, ids breaking ties."""
    kept = scored.orderBy(F.desc("score"), "id").limit(max(ks))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "y")))
    # At most max(ks) rows are left here.
    placed = kept.agg(order.alias("rows")).select(F.posexplode("rows").alias("place", "row"))
    positives = scored.agg(F.sum("y")).scalar()
    hits = placed.select("place", "row.y", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("place < k")
    return hits.groupBy("k").agg(
        (F.sum("y") / F.count(F.lit(1))).alias("precision"), (F.sum("y") / positives).alias("recall")
    )


def best_threshold(scored: DataFrame, steps: int = 40) -> DataFrame:
    """The grid threshold with the best F1, the lowest on a tie.

    Scores are counted by grid cell first, so the grid meets at most steps + 1 rows.
    """
    cell = F.least(F.lit(steps), F.floor(F.col("score") * steps)).cast("int").alias("cell")
    cells = scored.groupBy(cell).agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    grid = cells.select("cell", "p", "c", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    above = F.col("cell") >= F.col("step")
    counted = grid.groupBy("step").agg(
        F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("c") - F.col("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("p"))).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    best = counted.withColumn("f1", f1).agg(F.max(F.struct("f1", (-F.col("step")).alias("down"), "tp", "fp", "fn")).alias("b"))
    return best.select((-F.col("b.down") / F.lit(float(steps))).alias("threshold"), "b.f1", "b.tp", "b.fp", "b.fn")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(brier, ece): mean squared error, and the gap of mean score and outcome averaged over bins."""
    cell = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))
    err = F.sum(F.pow(F.col("score") - F.col("y"), 2))
    by_bin = scored.groupBy(cell.alias("bin")).agg(
        err.alias("err"), F.count(F.lit(1)).alias("c"), F.sum("score").alias("s"), F.sum("y").alias("p")
    )
    return by_bin.agg(
        (F.sum("err") / F.sum("c")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("c")).alias("ece")
    )


def tier_table(scored: DataFrame, tier: Column) -> DataFrame:
    """(tier, rows, share, positive_rate)."""
    n = scored.agg(F.count(F.lit(1))).scalar()
    by_tier = scored.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y").alias("positive_rate"))
    return by_tier.select("tier", "n_rows", (F.col("n_rows") / n).alias("share"), "positive_rate")


def unique_catches(anomaly: DataFrame, flagged: DataFrame, k: int) -> DataFrame:
    """The k most anomalous ids that the supervised model did not flag."""
    return anomaly.orderBy(F.desc("anomaly_score"), "id").limit(k).join(flagged.select("id"), "id", "left_anti")


def detection(alerts: DataFrame, planted: DataFrame) -> DataFrame:
    """(kind, planted, found, extra): alerts against planted entities; planted is (entity_id, kind)."""
    a = alerts.select("entity_id", F.lit(1).alias("alerted")).distinct()
    p = planted.select("entity_id", "kind", F.lit(1).alias("is_planted"))
    joined = a.join(p, "entity_id", "full")
    kind = F.coalesce("kind", F.substring_index("entity_id", ":", 1))
    hit, real = F.col("alerted").isNotNull(), F.col("is_planted").isNotNull()
    return joined.groupBy(kind.alias("kind")).agg(
        F.count_if(real).alias("planted"), F.count_if(real & hit).alias("found"), F.count_if(hit & ~real).alias("extra")
    )
