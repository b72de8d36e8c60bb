"""Transaction, wallet and network features of the analysis run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.functions.maths import entropy_bits, half_even, ratio
from ledgerscope.functions.ordered import first_k, fits, group_quantiles, previous
from ledgerscope.session import materialize
from ledgerscope.operators.participation import Members, network_context, participation

DUST_BTC = 0.0001


def transaction_features(case: Case, dust: float = DUST_BTC) -> DataFrame:
    ins = case.inputs.groupBy("txid").agg(
        F.count(F.lit(1)).alias("input_count"), F.sum("amount").alias("total_input")
    )
    outs = case.outputs.groupBy("txid").agg(
        F.count(F.lit(1)).alias("output_count"),
        F.sum("amount").alias("total_output"),
        F.count("amount").alias("output_amounts"),
        entropy_bits(F.col("amount")).alias("bits"),
        F.count_if(F.col("amount") < dust).alias("dust_outputs_count"),
    )
    joined = case.transactions.join(ins, "txid", "left").join(outs, "txid", "left")
    filled = joined.na.fill(
        0, ["input_count", "output_count", "output_amounts", "dust_outputs_count"]
    ).na.fill(0.0, ["total_input", "total_output", "bits", "fee"])
    n_in, n_out = F.col("input_count"), F.col("output_count")
    return filled.select(
        "txid",
        "record_id",
        "timestamp",
        "input_count",
        "output_count",
        n_in.alias("in_degree"),
        n_out.alias("out_degree"),
        "total_input",
        "total_output",
        F.col("total_output").alias("transaction_value"),
        "fee",
        ratio(F.col("fee"), F.col("total_input")).alias("fee_ratio"),
        ratio(n_out.cast("double"), n_in, n_out.cast("double")).alias("input_output_ratio"),
        half_even(
            F.when((F.col("total_output") > 0) & (F.col("output_amounts") > 1), F.col("bits")).otherwise(0.0), 4
        ).alias("output_entropy"),
        "dust_outputs_count",
    )


def time_gaps(times: DataFrame, key: str, rows: int | None) -> DataFrame:
    """(key, gap, n): gaps in seconds between consecutive sightings, equal instants giving gaps of 0.

    ``times`` holds one row per (key, at, n) with ``at`` in microseconds and n sightings at that instant.
    """
    linked = previous(times, [key], ["at"], "at", "before", rows)
    found = F.array(
        F.struct(((F.col("at") - F.col("before")) / 1e6).alias("gap"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("n")),
    )
    return linked.select(key, F.inline(found)).where("gap is not null and n > 0")


def pace(times: DataFrame, key: str, rows: int | None, gap: str, rate: str, life: str) -> DataFrame:
    """Per key: sightings, lifetime in seconds, sightings per second and the median gap."""
    spans = times.groupBy(key).agg(
        F.sum("n").alias("sightings"), ((F.max("at") - F.min("at")) / 1e6).alias(life)
    )
    medians = group_quantiles(time_gaps(times, key, rows), [key], "gap", {gap: 0.5}, "n", rows)
    n = F.col("sightings").cast("double")
    return spans.join(medians, key, "left").select(
        key,
        "sightings",
        life,
        F.when(F.col(life) > 0, n / F.col(life)).otherwise(n).alias(rate),
        F.coalesce(gap, F.lit(0.0)).alias(gap),
    )


def repeated_values(sent: DataFrame) -> DataFrame:
    """Per address: how often its most frequent amount, at four decimals, occurs in ``sent``, (address, amount)."""
    return (
        sent.groupBy("address", half_even("amount", 4).alias("value"))
        .count()
        .groupBy("address")
        .agg(F.max("count").alias("max_repeated_value_count"))
    )


def wallet_members(case: Case) -> Members:
    """All that wallet features and cycles read of the flows, written once."""
    return Members(case)


def wallet_features(case: Case, dust: float = DUST_BTC, members: Members | None = None) -> DataFrame:
    """Wallet features keyed by address. Source records stay in ``wallet_sources``, one row each.

    ``members`` may hand in the case's ``wallet_members``.
    """
    held = wallet_members(case) if members is None else members
    members = held.rows
    flows = F.col("sent_rows") + F.col("received_rows")
    # A record of one transaction is met once by an address; only if records are shared are they made distinct.
    told = F.struct("txid", "timestamp")
    shared = case.transactions.groupBy("record_id").agg(F.min(told).alias("a"), F.max(told).alias("b")).where("not a <=> b")
    records = F.count("record_id") if shared.isEmpty() else F.count_distinct("record_id")
    sums = materialize(
        members.groupBy("address").agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.count_if(F.col("received_rows") > 0).alias("incoming_transaction_count"),
            F.count_if(F.col("sent_rows") > 0).alias("outgoing_transaction_count"),
            F.sum("received_amount").alias("total_incoming"),
            F.sum("sent_amount").alias("total_outgoing"),
            F.sum(flows).alias("flows"),
            records.alias("source_record_count"),
            F.sum(F.size(F.filter("received_amounts", lambda a: a < dust))).alias("dust_incoming_count"),
        ),
        "wallet-sums",
    )
    # The busiest address bounds every group below: only beyond a task's share are groups cut into slices.
    rows = sums.agg(F.max("flows")).first()[0] or 0
    amounts = members.select("address", F.explode(F.concat("sent_amounts", "received_amounts")).alias("amount"))
    seen = members.where("timestamp is not null").select("address", F.unix_micros("timestamp").alias("at"), flows.alias("n"))
    if fits(members, rows):
        # One shuffle by address serves instants, spans and gaps.
        seen = seen.repartition("address")
    times = seen.groupBy("address", "at").agg(F.sum("n").alias("n"))
    parts = [
        group_quantiles(amounts, ["address"], "amount", {"median_transaction_value": 0.5}, None, rows),
        held.partners.drop("mutual_partners"),
        repeated_values(members.select("address", F.explode("sent_amounts").alias("amount"))),
        pace(times, "address", rows, "median_time_gap", "transaction_rate", "wallet_lifetime_seconds"),
        network_context(held.packs, case.network),
    ]
    joined = sums
    for extra in parts:
        joined = joined.join(extra, "address", "left")
    joined = joined.na.fill(0)
    n_in, n_out = F.col("incoming_transaction_count"), F.col("outgoing_transaction_count")
    got, paid = F.col("total_incoming"), F.col("total_outgoing")
    return joined.select(
        F.col("address").alias("wallet_address"),
        F.concat(F.lit("wallet:"), "address").alias("entity_id"),
        "transaction_count",
        n_in.alias("incoming_transaction_count"),
        n_out.alias("outgoing_transaction_count"),
        n_in.alias("in_degree"),
        n_out.alias("out_degree"),
        F.greatest("incoming_counterparties", n_in).alias("fan_in"),
        F.greatest("outgoing_counterparties", n_out).alias("fan_out"),
        ratio(n_out.cast("double"), n_in, n_out.cast("double")).alias("fan_out_ratio"),
        got.alias("total_incoming"),
        paid.alias("total_outgoing"),
        (got + paid).alias("total_volume"),
        (got - paid).alias("net_balance_change"),
        (F.col("transaction_count") > 1).cast("int").alias("address_reuse"),
        ((got + paid) / F.col("flows")).alias("average_transaction_value"),
        "median_transaction_value",
        "unique_counterparties",
        "max_repeated_value_count",
        "dust_incoming_count",
        "transaction_rate",
        "median_time_gap",
        "wallet_lifetime_seconds",
        "connected_ip_count",
        "unique_country_count",
        "unique_asn_count",
        "source_record_count",
        F.col("flows").alias("flow_count"),
    )


def wallet_sources(case: Case) -> DataFrame:
    """(entity_id, record_id): every source record of every wallet, one row each."""
    return (
        participation(case)
        .where("record_id is not null")
        .select(F.concat(F.lit("wallet:"), "address").alias("entity_id"), "record_id")
        .distinct()
    )


def first_sources(sources: DataFrame, k: int = 20) -> DataFrame:
    """(entity_id, source_record_ids): the first k record ids in order, as rules and evidence cite them."""
    kept = first_k(sources, ["entity_id"], ["record_id"], k)
    return kept.groupBy("entity_id").agg(F.array_sort(F.collect_list("record_id")).alias("source_record_ids"))


def network_features(case: Case) -> DataFrame:
    """Per source IP; observations without a timestamp count towards the distinct counts only."""
    net = case.network.where("src_ip is not null and src_ip <> ''")
    times = (
        net.where("timestamp is not null")
        .groupBy("src_ip", F.unix_micros("timestamp").alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = net.groupBy("src_ip").agg(
        F.count_distinct("dst_ip").alias("unique_dst_ip_count"),
        F.count_distinct("src_port").alias("unique_src_port_count"),
        F.count_distinct("dst_port").alias("unique_dst_port_count"),
        F.count_distinct("geo_country").alias("unique_country_count"),
        F.count_distinct("asn").alias("unique_asn_count"),
        F.count_distinct("txid").alias("associated_tx_count"),
        F.count_distinct("record_id").alias("source_record_count"),
    )
    speed = pace(times, "src_ip", case.net_rows, "median_network_time_gap", "observation_rate", "lifetime")
    return (
        counts.join(speed, "src_ip", "left")
        .na.fill(0)
        .select(
            F.col("src_ip").alias("ip"),
            F.concat(F.lit("ip:"), "src_ip").alias("entity_id"),
            F.col("sightings").alias("network_observation_count"),
            "unique_dst_ip_count",
            "unique_src_port_count",
            "unique_dst_port_count",
            "unique_country_count",
            "unique_asn_count",
            "associated_tx_count",
            "observation_rate",
            "median_network_time_gap",
            "source_record_count",
        )
    )


def network_sources(case: Case) -> DataFrame:
    """(entity_id, record_id): every observation of every source IP."""
    kept = case.network.where("src_ip is not null and record_id is not null")
    return kept.select(F.concat(F.lit("ip:"), "src_ip").alias("entity_id"), "record_id").distinct()
