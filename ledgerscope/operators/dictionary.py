"""Features the dictionary defines beyond the run's own: telemetry, pace, peeling depth and local structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerscope.case import Case
from ledgerscope.functions.maths import ratio
from ledgerscope.functions.ordered import group_quantiles, previous
from ledgerscope.operators import entity_graph as graph
from ledgerscope.operators.features import time_gaps
from ledgerscope.operators.rules import P2P_PORTS, TOR_VPN_PORTS
from ledgerscope.session import materialize


def telemetry_features(case: Case, burst_ms: int = 500) -> DataFrame:
    """Per transaction: relaying peers, their diversity, port flags, and the share of relays soon after the first."""
    net = case.network.where("txid is not null")
    first = net.groupBy("txid").agg(F.min("timestamp").alias("first_seen"))
    soon = F.unix_micros("timestamp") - F.unix_micros("first_seen") < burst_ms * 1000
    tor = F.col("dst_port").isin(*TOR_VPN_PORTS) | F.col("src_port").isin(*TOR_VPN_PORTS)
    return (
        net.join(first, "txid")
        .groupBy("txid")
        .agg(
            F.count_distinct("src_ip").alias("originator_peer_count"),
            F.count_distinct("geo_country").alias("originator_country_diversity"),
            F.count_distinct("asn").alias("originator_asn_diversity"),
            F.max(F.coalesce(tor, F.lit(False)).cast("int")).alias("originator_tor_or_vpn_flag"),
            F.max((~F.col("dst_port").isin(*P2P_PORTS)).cast("int")).alias("originator_port_flag"),
            F.avg(soon.cast("double")).alias("originator_relay_burst_score"),
        )
    )


def observation_gaps(case: Case) -> DataFrame:
    """(txid, record_id, delta_t): seconds since the previous observation of the same transaction."""
    net = case.network.where("txid is not null and timestamp is not null").select(
        "txid", "record_id", F.unix_micros("timestamp").alias("at")
    )
    linked = previous(net, ["txid"], ["at", "record_id"], "at", "before", case.net_rows)
    return linked.select("txid", "record_id", ((F.col("at") - F.col("before")) / 1e6).alias("delta_t"))


def arrival_features(visits: DataFrame, rows: int | None = None, window_seconds: int = 30) -> DataFrame:
    """Per address: gap statistics between its transactions and its busiest window.

    ``visits`` is (address, at) in microseconds. For the window counts a visit enters its own
    window-wide bucket and, as context, the next, so a scan never holds more than two windows of one address.
    """
    moments = visits.groupBy("address", "at").agg(F.count(F.lit(1)).alias("n"))
    gaps = time_gaps(moments, "address", rows)
    g, n = F.col("gap"), F.col("n")
    total, count = F.sum(g * n), F.sum(n)
    square = F.sum(g * g * n)
    var = (square - total * total / count) / (count - 1)
    stats = gaps.groupBy("address").agg(
        F.min("gap").alias("inter_arrival_time_min"),
        F.max("gap").alias("inter_arrival_time_max"),
        (total / count).alias("inter_arrival_time_mean"),
        F.when(count > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias("inter_arrival_time_std"),
    )
    medians = group_quantiles(gaps, ["address"], "gap", {"inter_arrival_time_median": 0.5}, "n", rows)
    width = window_seconds * 1_000_000
    bucket = F.floor(F.col("at") / width)
    placed = moments.select(
        "address", "at", "n",
        F.inline(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))),
    )
    w = Window.partitionBy("address", "b").orderBy("at").rangeBetween(-width, 0)
    bursts = placed.withColumn("c", F.sum("n").over(w)).where("own").groupBy("address").agg(F.max("c").alias("burst_event_count"))
    return bursts.join(stats, "address", "left").join(medians, "address", "left").na.fill(0.0)


def peeling_depth(case: Case) -> DataFrame:
    """(txid, depth): length of the longest run of one-in two-out transactions starting here."""
    ones = case.inputs.groupBy("txid").count().where("count = 1").select("txid")
    twos = case.outputs.groupBy("txid").count().where("count = 2").select("txid")
    shaped = materialize(ones.join(twos, "txid", "left_semi").distinct(), "shaped")
    arcs = graph.spend_graph(case).join(shaped.withColumnRenamed("txid", "src"), "src", "left_semi")
    return chain_depths(shaped, arcs.join(shaped.withColumnRenamed("txid", "dst"), "dst", "left_semi"))


def chain_depths(shaped: DataFrame, arcs: DataFrame) -> DataFrame:
    """(txid, depth): most transactions on a way from each along ``arcs`` (src, dst), each dst having one src at most.

    Pointer doubling: a transaction knows the one ``step`` ahead of it and the longest way of up to ``step``
    transactions behind it, the greatest over all forks; each round doubles the step. Ways that lead back to their
    start have no depth and are an error.
    """
    ahead = arcs.select(F.col("dst").alias("txid"), F.col("src").alias("up"))
    state = materialize(shaped.join(ahead, "txid", "left").select("txid", "up", F.lit(1).cast("long").alias("depth")), "chains")
    step, n = 1, state.count()
    while state.where("up is not null").limit(1).count():
        if step > n:
            raise ValueError("transactions spend each other in a circle")
        behind = state.where("up is not null").groupBy(F.col("up").alias("txid")).agg((F.max("depth") + step).alias("longer"))
        over = state.select(F.col("txid").alias("up"), F.col("up").alias("over"))
        state = materialize(
            state.join(behind, "txid", "left").join(over, "up", "left").select(
                "txid", F.col("over").alias("up"), F.greatest("depth", "longer").alias("depth")
            ),
            "chains",
        )
        step *= 2
    return state.select("txid", F.col("depth").cast("int").alias("depth"))


def local_structure(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per node: clustering coefficient of the undirected view and reciprocity of its outgoing edges."""
    tri = graph.triangles(edges)
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("o")).union(pairs.select("dst", "src")).distinct()
    deg = both.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
    back = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
    returned = back.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("returned"))
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    df = deg.join(tri, "id", "left").join(out, "id", "left").join(returned, "id", "left").na.fill(0)
    k = F.col("neighbours")
    return df.select(
        "id",
        F.when(k > 1, 2.0 * F.col("triangle_count") / (k * (k - 1))).otherwise(0.0).alias("clustering_coefficient"),
        ratio(F.col("returned").cast("double"), F.col("out_degree")).alias("reciprocity"),
    )


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """(id, weighted_in, weighted_out, weighted_total) from (src, dst, amount)."""
    zero = F.lit(0.0)
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("amount").alias("o"), zero.alias("i")),
                F.struct(F.col("dst").alias("id"), zero.alias("o"), F.col("amount").alias("i")),
            )
        )
    )
    sums = ends.groupBy("id").agg(F.coalesce(F.sum("i"), zero).alias("weighted_in"), F.coalesce(F.sum("o"), zero).alias("weighted_out"))
    return sums.withColumn("weighted_total", F.col("weighted_in") + F.col("weighted_out"))


def wallet_timeline(case: Case, window_hours: int = 1) -> DataFrame:
    """(address, first_seen, last_seen, active_steps): when each wallet was active, in time steps."""
    steps = graph.time_steps(case, window_hours)
    flows = case.inputs.select("txid", "address").union(case.outputs.select("txid", "address"))
    return flows.join(steps, "txid").groupBy("address").agg(
        F.min("timestamp_epoch").alias("first_seen"),
        F.max("timestamp_epoch").alias("last_seen"),
        F.count_distinct("time_step").alias("active_steps"),
    )
