"""Graph and network signals, score fusion and severity tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.maths import clip, half_even
from ledgerscope.functions.ordered import percent_ranks

# Stream weights without and with a supervised probability.
FUSION = {"anomaly": 0.40, "behavior": 0.30, "graph": 0.20, "network": 0.10}
FUSION_SUPERVISED = {"supervised": 0.35, "anomaly": 0.25, "behavior": 0.20, "graph": 0.12, "network": 0.08}

# Lower bounds of CRITICAL, HIGH and MEDIUM.
TIERS = {"main": (85.0, 65.0, 40.0), "leads": (80.0, 60.0, 40.0), "calibration": (85.0, 60.0, 30.0)}


def severity(score: Column, tiers: str = "main") -> Column:
    critical, high, medium = TIERS[tiers]
    return (
        F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")
    )


def graph_signals(wallets: DataFrame, graph_features: DataFrame, rows: int | None = None) -> DataFrame:
    """(entity_id, five percentiles, cycle_signal, graph_score); the fan-out percentile ranks fan_out."""
    cols = ["degree", "community_size", "community_density", "short_cycle_count", "betweenness_centrality"]
    joined = wallets.select("entity_id", "fan_out").join(graph_features.select("entity_id", *cols), "entity_id", "left")
    filled = joined.na.fill({"degree": 0, "community_size": 1, "community_density": 0.0, "short_cycle_count": 0, "betweenness_centrality": 0.0})
    ranked = percent_ranks(
        filled,
        {
            "degree": "degree_percentile",
            "fan_out": "fanout_percentile",
            "community_size": "community_size_percentile",
            "community_density": "community_density_percentile",
            "betweenness_centrality": "betweenness_percentile",
        },
        rows,
    )
    c = F.col
    cycle = F.when(c("short_cycle_count") > 0, 1.0).otherwise(0.0)
    score = (
        0.20 * c("degree_percentile")
        + 0.20 * c("fanout_percentile")
        + 0.20 * c("community_size_percentile")
        + 0.20 * c("community_density_percentile")
        + 0.10 * cycle
        + 0.10 * c("betweenness_percentile")
    )
    parts = ["degree", "fanout", "community_size", "community_density", "betweenness"]
    return ranked.select(
        "entity_id",
        *[half_even(f"{p}_percentile", 4).alias(f"{p}_percentile") for p in parts],
        cycle.alias("cycle_signal"),
        half_even(score, 4).alias("graph_score"),
    )


def network_signals(wallets: DataFrame, rows: int | None = None) -> DataFrame:
    """(entity_id, percentiles, relay_burst_signal, network_score, correlation_strength)."""
    kept = wallets.select("entity_id", "connected_ip_count", "unique_country_count", "unique_asn_count", "transaction_count")
    ranked = percent_ranks(
        kept, {"connected_ip_count": "ip_p", "unique_country_count": "country_p", "unique_asn_count": "asn_p"}, rows
    )
    c = F.col
    burst = F.least(F.lit(1.0), c("connected_ip_count") / 3.0)
    score = 0.35 * c("ip_p") + 0.25 * c("country_p") + 0.20 * c("asn_p") + 0.20 * burst
    strength = clip(c("connected_ip_count") / F.greatest(c("transaction_count"), F.lit(1)), 0.0, 1.0)
    return ranked.select(
        "entity_id",
        half_even("ip_p", 4).alias("unique_ip_percentile"),
        half_even("country_p", 4).alias("unique_country_percentile"),
        half_even(burst, 4).alias("relay_burst_signal"),
        half_even(score, 4).alias("network_score"),
        half_even(strength, 4).alias("correlation_strength"),
    )


def _unit(name: str) -> Column:
    return clip(F.coalesce(F.col(name), F.lit(0.0)), 0.0, 1.0)


def fuse(df: DataFrame, tiers: str = "main") -> DataFrame:
    """Adds priority_score (0-100) and severity from the five streams and the investigator rule score.

    A null or zero supervised score means no model, and the other weights carry the whole.
    """
    parts = {n: _unit(f"{n}_score") for n in FUSION}
    plain = sum((w / sum(FUSION.values()) * parts[n] for n, w in FUSION.items()), F.lit(0.0))
    sup = _unit("supervised_score")
    with_model = sum((w * (sup if n == "supervised" else parts[n]) for n, w in FUSION_SUPERVISED.items()), F.lit(0.0))
    return _finish(df, F.when(sup > 0, with_model).otherwise(plain), tiers)


def fuse_leads(df: DataFrame) -> DataFrame:
    """The alternative fusion: model weights, rescaled when there is no model, its own tiers and advice."""
    w = FUSION_SUPERVISED
    parts = {n: _unit(f"{n}_score") for n in w}
    rest = 1.0 - w["supervised"]
    with_model = sum((w[n] * parts[n] for n in w), F.lit(0.0))
    without = sum((w[n] / rest * parts[n] for n in w if n != "supervised"), F.lit(0.0))
    scored = _finish(df, F.when(F.col("supervised_score").isNull(), without).otherwise(with_model), "leads")
    advice = {
        "CRITICAL": "Look into it first.",
        "HIGH": "Follow its counterparties.",
        "MEDIUM": "Keep in view.",
    }
    first = F.lit("Nothing stands out.")
    for tier, said in advice.items():
        first = F.when(F.col("severity") == tier, said).otherwise(first)
    model = F.when(
        parts["supervised"] >= 0.675, "Model at or over 0.675."
    )
    ruled = F.when(
        F.size("rules") > 0,
        F.concat(F.lit("Rules met: "), F.concat_ws(", ", F.slice("rules", 1, 3)), F.lit(".")),
    )
    return scored.withColumn("recommendation", F.concat_ws(" ", first, model, ruled))


def _finish(df: DataFrame, unit_score: Column, tiers: str) -> DataFrame:
    points = unit_score * 100.0
    rule = clip(F.coalesce("rule_score", F.lit(0.0)), 0.0, 100.0)
    blended = F.when(rule > 0, 0.85 * points + 0.15 * rule).otherwise(points)
    scored = df.withColumn("priority_score", half_even(clip(blended, 0.0, 100.0), 2))
    return scored.withColumn("severity", severity(F.col("priority_score"), tiers))


def calibrated_anomaly(decision: Column) -> Column:
    """A reference-period forest's decision brought to [0, 1]."""
    return clip((0.15 - decision) / 0.30, 0.0, 1.0)


def blended_anomaly(case_rank: Column, calibrated: Column) -> Column:
    return half_even(0.5 * case_rank + 0.5 * calibrated, 4)
