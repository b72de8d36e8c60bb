"""Linking relay observations to transactions by id and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.functions.sweep import latest_before, window_pairs


def _delta_ms(a: str, b: str) -> Column:
    return F.coalesce(F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1000), F.lit(0)).cast("long")


def exact_links(case: Case) -> DataFrame:
    txs = case.transactions.select(
        "txid", F.col("record_id").alias("transaction_record_id"), F.col("timestamp").alias("tx_time")
    )
    net = case.network.where("txid is not null").withColumnRenamed("record_id", "network_record_id")
    return net.join(txs, "txid").select(
        "network_record_id",
        "txid",
        "transaction_record_id",
        F.lit("exact_txid").alias("method"),
        _delta_ms("timestamp", "tx_time").alias("time_delta_ms"),
        F.lit("shared_txid").alias("basis"),
        "src_ip",
        "dst_ip",
    )


def unmatched(case: Case) -> DataFrame:
    """Observations whose txid is absent or names no transaction of the case."""
    return case.network.join(case.transactions.select("txid"), "txid", "left_anti")


def _bucket(micros: Column, window: int) -> Column:
    return F.floor(micros / F.lit(window * 1_000_000)).cast("long")


def temporal_links(case: Case, window_seconds: int = 30) -> DataFrame:
    """All unmatched observations within the window of a transaction, both ends included: a sweep in time order, so
    that neither a busy half minute nor a busy instant is one task's."""
    net = unmatched(case).select(
        F.col("record_id").alias("network_record_id"), "src_ip", "dst_ip", F.unix_micros("timestamp").alias("net_at")
    )
    txs = case.transactions.select(
        "txid", F.col("record_id").alias("transaction_record_id"), F.unix_micros("timestamp").alias("tx_at")
    )
    width = window_seconds * 1_000_000
    return window_pairs(net, txs, ("net_at", "tx_at"), width, width).select(
        "network_record_id",
        "txid",
        "transaction_record_id",
        F.lit("temporal_window").alias("method"),
        F.floor(F.abs(F.col("net_at") - F.col("tx_at")) / 1000).cast("long").alias("time_delta_ms"),
        F.lit("heuristic").alias("basis"),
        "src_ip",
        "dst_ip",
    )


def propagation_latency(case: Case) -> DataFrame:
    """(record_id, txid, src_ip, propagation_latency_ms) of every observation, as of the latest transaction at or before it.

    An observation that names a transaction of the case is measured against it; any other against the last
    transaction before it in the whole ledger (of equal times the one of the greatest txid), with null where none is.
    """
    own = case.network.join(case.transactions.select("txid", F.col("timestamp").alias("tx_time")), "txid").select(
        "record_id", "txid", "src_ip", F.floor((F.unix_micros("timestamp") - F.unix_micros("tx_time")) / 1000).alias("propagation_latency_ms")
    )
    seen = unmatched(case).select("record_id", "src_ip", F.unix_micros("timestamp").alias("seen_at"))
    txs = case.transactions.select("txid", F.unix_micros("timestamp").alias("tx_at"))
    loose = latest_before(seen, txs, ("seen_at", "tx_at"), "txid")
    return own.unionByName(
        loose.select("record_id", "txid", "src_ip", F.floor((F.col("seen_at") - F.col("tx_at")) / 1000).alias("propagation_latency_ms"))
    )


def correlation_links(case: Case, allow_temporal: bool = False, window_seconds: int = 30) -> DataFrame:
    links = exact_links(case)
    return links.unionByName(temporal_links(case, window_seconds)) if allow_temporal else links


def correlation_status(case: Case, allow_temporal: bool = False, window_seconds: int = 30) -> DataFrame:
    """exactly / partially / uncorrelated per transaction, without listing the temporal pairs.

    Whether any observation lies within the window needs only the first and last instant of each
    window-wide bucket, so the observations shrink to one row per bucket before they meet the transactions.
    """
    seen = case.network.where("txid is not null").groupBy("txid").agg(F.lit(1).alias("exact"))
    base = case.transactions.select("txid", "timestamp").join(seen, "txid", "left")
    near = F.lit(False)
    if allow_temporal:
        at = F.unix_micros("timestamp")
        size = window_seconds * 1_000_000
        spans = (
            unmatched(case)
            .where("timestamp is not null")
            .groupBy(_bucket(at, window_seconds).alias("b"))
            .agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
        )
        void = F.lit(None).cast("long")
        around = (
            spans.select(
                F.inline(
                    F.array(
                        F.struct(F.col("b").alias("bucket"), F.lit(1).alias("own"), void.alias("prev"), void.alias("next")),
                        F.struct((F.col("b") + 1).alias("bucket"), F.lit(0).alias("own"), F.col("hi").alias("prev"), void.alias("next")),
                        F.struct((F.col("b") - 1).alias("bucket"), F.lit(0).alias("own"), void.alias("prev"), F.col("lo").alias("next")),
                    )
                )
            )
            .groupBy("bucket")
            .agg(F.max("own").alias("own"), F.max("prev").alias("prev"), F.max("next").alias("next"))
        )
        base = base.withColumn("bucket", _bucket(at, window_seconds)).join(around, "bucket", "left")
        near = (
            (F.col("own") == 1)
            | (at - F.col("prev") <= size)
            | (F.col("next") - at <= size)
        )
    status = (
        F.when(F.col("exact") == 1, "exactly_correlated")
        .when(near, "partially_correlated")
        .otherwise("uncorrelated")
    )
    return base.select("txid", status.alias("status"))


def correlation_strength(matched: Column, transactions: Column) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), matched / F.greatest(transactions, F.lit(1))))
    return F.when(transactions <= 0, F.lit(0.0)).otherwise(share)


def relay_latency(case: Case) -> DataFrame:
    """Per transaction: milliseconds to the first observation at or after it, and that observation."""
    links = case.network.select("txid", F.col("record_id"), F.col("timestamp").alias("seen"))
    later = case.transactions.select("txid", "timestamp").join(links, "txid").where("seen >= timestamp")
    first = later.groupBy("txid").agg(
        F.min(F.struct("seen", "record_id")).alias("first"), F.min("timestamp").alias("timestamp")
    )
    return first.select(
        "txid", F.col("first.record_id").alias("record_id"), _delta_ms("first.seen", "timestamp").alias("latency_ms")
    )


def relay_bursts(case: Case, threshold: int = 3) -> DataFrame:
    """Transactions relayed by at least ``threshold`` distinct IPs; the IPs are in ``relay_ips``."""
    return (
        relay_ips(case)
        .groupBy("txid")
        .agg(F.count(F.lit(1)).alias("unique_ip_count"), F.sum("observations").alias("observations"))
        .where(F.col("unique_ip_count") >= threshold)
        .select(
            F.lit("RULE_MULTI_IP_RELAY_BURST").alias("rule_id"),
            "txid",
            F.concat(F.lit("transaction:"), "txid").alias("entity_id"),
            "unique_ip_count",
            "observations",
            F.lit("high").alias("severity"),
            F.format_string(
                "%s came from %d different addresses",
                F.substring("txid", 1, 10),
                "unique_ip_count",
            ).alias("description"),
        )
    )


def relay_ips(case: Case) -> DataFrame:
    """(txid, src_ip, observations): who relayed what."""
    kept = case.network.where("txid is not null and txid <> '' and src_ip is not null and src_ip <> ''")
    return kept.groupBy("txid", "src_ip").agg(F.count_distinct("record_id").alias("observations"))
