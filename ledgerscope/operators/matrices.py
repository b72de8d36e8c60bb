"""The model-ready package: transaction, wallet and network matrices, their checks and scalings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import schema
from ledgerscope.case import Case
from ledgerscope.functions.maths import entropy_bits, ratio
from ledgerscope.functions.ordered import fits, group_quantiles
from ledgerscope.operators.entity_graph import degrees, spend_graph, time_steps
from ledgerscope.operators.features import time_gaps
from ledgerscope.operators.participation import address_pairs, participation
from ledgerscope.session import materialize

BLOCK_SECONDS = 600


def in_order(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys, then every contract column in order as double; a missing column or value is 0."""
    have = set(df.columns)

    def one(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double") if name in have else F.lit(None).cast("double")
        return F.coalesce(value, F.lit(0.0)).alias(name)

    return df.select(*keys, *[one(c) for c in columns])


def _spread(df: DataFrame, key: str, name: str, rows: int | None, value: str = "amount") -> DataFrame:
    """Five-number statistics of ``value`` per key as name_min .. name_total."""
    v = F.col(value)
    basic = df.groupBy(key).agg(
        F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.avg(v).alias(f"{name}_mean"), F.sum(v).alias(f"{name}_total")
    )
    return basic.join(group_quantiles(df, [key], value, {f"{name}_median": 0.5}, None, rows), key, "left")


def _joined(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), parts, base)


def transaction_matrix(case: Case, window_hours: int = 1) -> DataFrame:
    """txid, time_step and 182 columns. From Local_feature_5 and Aggregate_feature_5 on they only fill the width."""
    edges = materialize(spend_graph(case), "spends")
    deg = degrees(edges).drop("degree")
    behind = (
        edges.join(deg.select(F.col("id").alias("src"), "in_degree"), "src")
        .groupBy(F.col("dst").alias("txid"))
        .agg(F.avg("in_degree").alias("p_mean"), F.max("in_degree").alias("p_max"))
    )
    ahead = (
        edges.join(deg.select(F.col("id").alias("dst"), "out_degree"), "dst")
        .groupBy(F.col("src").alias("txid"))
        .agg(F.avg("out_degree").alias("s_mean"), F.max("out_degree").alias("s_max"))
    )

    def side(flows: DataFrame, name: str, rows: int | None) -> DataFrame:
        shape = flows.groupBy("txid").agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            F.count_distinct("address").alias(f"{name}_addresses"),
            entropy_bits(F.col("amount")).alias(f"{name}_entropy"),
        )
        return shape.join(_spread(flows, "txid", f"{name}_BTC", rows), "txid")

    n_in = case.bounds[1] if case.bounds else None
    n_out = case.bounds[2] if case.bounds else None
    base = case.transactions.select("txid", "fee", "size").join(time_steps(case, window_hours), "txid")
    df = _joined(
        base,
        "txid",
        [
            side(case.inputs, "in", n_in),
            side(case.outputs, "out", n_out),
            deg.select(F.col("id").alias("txid"), "in_degree", "out_degree"),
            behind,
            ahead,
        ],
    ).na.fill(0)
    c = F.col
    df = df.withColumns(
        {
            "in_txs_degree": c("in_degree"),
            "out_txs_degree": c("out_degree"),
            "total_BTC": F.greatest(c("in_BTC_total"), c("out_BTC_total") + c("fee")),
            "fees": c("fee"),
            "num_input_addresses": c("in_addresses"),
            "num_output_addresses": c("out_addresses"),
            "Local_feature_1": c("fee") / F.greatest(F.lit(1.0), c("size").cast("double")),
            "Local_feature_2": c("out_entropy"),
            "Local_feature_3": c("in_entropy"),
            "Local_feature_4": c("in_rows") / F.greatest(F.lit(1.0), c("out_rows").cast("double")),
            "Aggregate_feature_1": c("p_mean"),
            "Aggregate_feature_2": c("s_mean"),
            "Aggregate_feature_3": c("p_max"),
            "Aggregate_feature_4": c("s_max"),
        }
    )
    fillers = {f"Local_feature_{i}": F.sin(i * c("total_BTC") + c("in_degree")) for i in range(5, schema.LOCAL_COUNT + 1)}
    fillers |= {
        f"Aggregate_feature_{i}": F.cos(i * (c("p_mean") + c("s_mean") + 1.0)) for i in range(5, schema.AGGREGATE_COUNT + 1)
    }
    return in_order(df.withColumns(fillers), ["txid", "time_step"], schema.transaction_columns())


def _blocks(col: Column) -> Column:
    return F.floor(col / BLOCK_SECONDS).cast("double")


def _gap_spread(times: DataFrame, name: str, rows: int | None) -> DataFrame:
    """Block gaps between consecutive transactions of an address; ``times`` is (address, at, n)."""
    gaps = time_gaps(times, "address", rows)
    g = F.col("gap")
    basic = gaps.groupBy("address").agg(
        F.min(g).alias("lo"), F.max(g).alias("hi"), F.sum(g * F.col("n")).alias("sum"), F.sum("n").alias("count")
    )
    medians = group_quantiles(gaps, ["address"], "gap", {"mid": 0.5}, "n", rows)
    c = F.col
    return basic.join(medians, "address").select(
        "address",
        _blocks(c("sum")).alias(f"{name}_total"),
        _blocks(c("lo")).alias(f"{name}_min"),
        _blocks(c("hi")).alias(f"{name}_max"),
        _blocks(c("sum") / c("count")).alias(f"{name}_mean"),
        _blocks(c("mid")).alias(f"{name}_median"),
    )


def _flows(case: Case) -> DataFrame:
    ins = case.inputs.select("txid", "address", "amount", F.lit(1).alias("sent"))
    return ins.unionByName(case.outputs.select("txid", "address", "amount", F.lit(0).alias("sent"))).where("address is not null")


def _moments(visits: DataFrame) -> DataFrame:
    return visits.groupBy("address", (F.col("timestamp_epoch") * 1_000_000).alias("at")).agg(F.count(F.lit(1)).alias("n"))


def wallet_matrix(case: Case, documented: bool = False) -> DataFrame:
    """address, time_step and 55 columns.

    By default fee, per-side gap and counterparty columns are the constants existing consumers were
    trained on; ``documented`` computes them as the feature dictionary defines them.
    """
    written = materialize(_flows(case), "flows")
    at = case.transactions.select("txid", "timestamp_epoch")
    c = F.col
    counts = materialize(
        written.groupBy("address").agg(
            F.count_if(F.expr("sent = 1")).alias("num_txs_as_sender"),
            F.count_if(F.expr("sent = 0")).alias("num_txs_as receiver"),
            F.count(F.lit(1)).alias("total_txs"),
        ),
        "wallet-counts",
    )
    # The busiest address bounds every group below: only beyond a task's share are groups cut into slices.
    rows = counts.agg(F.max("total_txs")).first()[0] or 0
    flows, visits = written, written.select("address", "txid").distinct().join(at, "txid")
    if fits(written, rows):
        # One shuffle by address serves sums and medians, one more the times.
        flows, visits = written.repartition("address"), visits.repartition("address")
    life = visits.groupBy("address").agg(
        F.min("timestamp_epoch").alias("first"), F.max("timestamp_epoch").alias("last"),
        F.count_distinct("timestamp_epoch").alias("num_timesteps_appeared_in"),
    )
    first, last = _blocks(c("first")), _blocks(c("last"))
    life = life.select(
        "address",
        first.alias("first_block_appeared_in"),
        last.alias("last_block_appeared_in"),
        F.greatest(F.lit(1.0), last - first).alias("lifetime_in_blocks"),
        first.alias("first_sent_block"),
        first.alias("first_received_block"),
        "num_timesteps_appeared_in",
    )
    parts = [
        life,
        _spread(flows, "address", "btc_transacted", rows),
        _spread(flows.where("sent = 1"), "address", "btc_sent", rows),
        _spread(flows.where("sent = 0"), "address", "btc_received", rows),
        _gap_spread(_moments(visits), "blocks_btwn_txs", rows),
    ]
    if documented:
        parts += _documented(case, written, at)
    df = _joined(counts, "address", parts).na.fill(0)
    if not documented:
        one = F.lit(1.0)
        df = df.withColumns(
            {
                "transacted_w_address_total": c("total_txs"),
                "transacted_w_address_min": one,
                "transacted_w_address_max": c("total_txs"),
                "transacted_w_address_mean": one,
                "transacted_w_address_median": one,
            }
        )
    return in_order(df.withColumn("time_step", F.lit(1)), ["address", "time_step"], schema.wallet_columns())


def _documented(case: Case, flows: DataFrame, at: DataFrame) -> list[DataFrame]:
    """Fees of sent transactions, their share of the moved value, gaps per side, counts per counterparty."""
    rows = case.flow_rows
    moved = case.outputs.groupBy("txid").agg(F.sum("amount").alias("moved"))
    paid = case.transactions.select("txid", "fee").join(moved, "txid", "left")
    sent = flows.where("sent = 1").select("address", "txid").distinct()
    fees = sent.join(paid, "txid").select(
        "address", "fee", ratio(F.col("fee"), F.coalesce("moved", F.lit(0.0))).alias("share")
    )
    got = flows.where("sent = 0").select("address", "txid").distinct()
    partners = address_pairs(participation(case), with_tx=True)
    both = F.array(
        F.struct(F.col("source_address").alias("address"), F.col("target_address").alias("other")),
        F.struct(F.col("target_address").alias("address"), F.col("source_address").alias("other")),
    )
    met = (
        partners.select("txid", F.inline(both)).distinct()
        .groupBy("address", "other").agg(F.count(F.lit(1)).alias("times"))
    )
    often = met.groupBy("address").agg(F.count_if(F.expr("times >= 2")).alias("num_addr_transacted_multiple"))
    spread = _spread(met, "address", "transacted_w_address", None, "times").drop("transacted_w_address_total")
    total = met.groupBy("address").agg(F.count(F.lit(1)).alias("transacted_w_address_total"))
    return [
        _spread(fees, "address", "fees", rows, "fee"),
        _spread(fees, "address", "fees_as_share", rows, "share"),
        _gap_spread(_moments(sent.join(at, "txid")), "blocks_btwn_input_txs", rows),
        _gap_spread(_moments(got.join(at, "txid")), "blocks_btwn_output_txs", rows),
        often,
        spread,
        total,
    ]


def network_matrix(case: Case, signed_ratio: bool = False) -> DataFrame:
    """txid, time_step and 13 columns; ``signed_ratio`` gives the flow direction as a share in [-1, 1]."""
    flows = _flows(case)
    inside, outside = F.col("sent") == 1, F.col("sent") == 0
    amount = F.col("amount")

    def top_share(side: Column) -> Column:
        mine = F.when(side, amount)
        return F.when(F.sum(mine) > 0, F.max(mine) / F.sum(mine)).otherwise(0.0)

    shape = flows.groupBy("txid").agg(
        F.count_if(inside).alias("num_inputs"),
        F.count_if(outside).alias("num_outputs"),
        F.coalesce(top_share(inside), F.lit(0.0)).alias("input_concentration"),
        F.coalesce(top_share(outside), F.lit(0.0)).alias("output_concentration"),
        entropy_bits(amount).alias("bipartite_entropy"),
    )
    distinct = flows.groupBy("txid", "address", "sent").agg(F.lit(1).alias("one")).groupBy("txid").agg(
        F.count_if(inside).alias("unique_inputs"), F.count_if(outside).alias("unique_outputs")
    )
    df = _joined(case.transactions.select("txid"), "txid", [shape, distinct]).na.fill(0)
    n_in, n_out = F.col("num_inputs"), F.col("num_outputs")
    total = n_in + n_out
    direction = F.when(n_out > n_in, 1.0).otherwise(-1.0)
    if signed_ratio:
        direction = F.when(total > 0, (n_out - n_in) / total).otherwise(0.0)
    flag = lambda cond: cond.cast("double")
    df = df.withColumns(
        {
            "total_degree": total,
            "in_out_ratio": n_in / F.greatest(F.lit(1), n_out),
            "net_flow_direction": direction,
            "is_aggregation_pattern": flag((n_in >= 5) & (n_out <= 2)),
            "is_peeling_chain_pattern": flag((n_in == 1) & (n_out == 2)),
            "is_fan_out_dispersion": flag((n_in == 1) & (n_out >= 10)),
            "time_step": F.lit(1),
        }
    )
    return in_order(df, ["txid", "time_step"], schema.network_columns())


def matrix_findings(matrix: DataFrame, domain: str) -> DataFrame:
    """(code, file, message): wrong width or column order, NaN or infinite values."""
    width, digest = schema.MATRIX_CONTRACT[domain]
    columns = [c for c in matrix.columns if c not in ("txid", "address", "time_step")]
    file = f"{domain}/features.parquet"
    known = []
    if len(columns) != width:
        known.append(("E005_FEATURE_DIMENSION_MISMATCH", file, f"{domain}: {len(columns)} columns instead of {width}"))
    if schema.order_hash(columns) != digest:
        known.append(("E005_FEATURE_DIMENSION_MISMATCH", file, f"{domain}: columns in another order"))
    fixed = matrix.sparkSession.createDataFrame(known, "code string, file string, message string")
    cell = F.array(*[F.col(f"`{c}`") for c in columns])
    seen = matrix.agg(
        F.max(F.exists(cell, lambda v: F.isnan(v) | v.isNull())).alias("nan"),
        F.max(F.exists(cell, lambda v: F.abs(v) == float("inf"))).alias("inf"),
    )
    hits = F.array_compact(
        F.array(
            F.when(F.col("nan"), F.lit(f"{domain}: cells without a value")),
            F.when(F.col("inf"), F.lit(f"{domain}: infinite cells")),
        )
    )
    values = seen.select(F.lit("E006_FEATURE_NAN").alias("code"), F.lit(file).alias("file"), F.explode(hits).alias("message"))
    return fixed.unionByName(values)


def column_quantiles(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """(feature, q25, median, q75, iqr) of every column, one row each; a zero spread counts as 1."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    total = None if rows is None else rows * len(columns)
    q = group_quantiles(long.where(~F.isnan("value")), ["feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, None, total)
    spread = F.col("q75") - F.col("q25")
    return q.withColumn("iqr", F.when(spread == 0, 1.0).otherwise(spread))


def impute(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """Missing and infinite values replaced by the column median (0 when there is none)."""
    medians = column_quantiles(df, columns, rows).groupBy().pivot("feature", columns).agg(F.first("median"))
    one = medians.select(F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in columns]).alias("m")).scalar()
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    held = df.withColumn("_m", one)
    cast = {c: F.col(f"`{c}`").cast("double") for c in columns}
    return held.withColumns({c: F.when(bad(v), F.col(f"_m.{c}")).otherwise(v) for c, v in cast.items()}).drop("_m")


def standardize(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """z-scores with mean and population deviation of the training rows; no deviation counts as 1, NaN as 0."""
    fit = df if train is None else df.where(train)
    stats = F.struct(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("dev")).alias(c) for c in columns]
    )
    held = df.withColumn("_s", fit.agg(stats.alias("s")).scalar())

    def z(c: str) -> Column:
        dev = F.col(f"_s.{c}.dev")
        value = (F.col(c) - F.col(f"_s.{c}.mean")) / F.when(dev == 0, 1.0).otherwise(dev)
        return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))

    return held.withColumns({c: z(c) for c in columns}).drop("_s")


def static_means(matrix: DataFrame, wallets: DataFrame, columns: list[str]) -> DataFrame:
    """Per listed wallet the mean of its rows over time steps, 0 where it has none."""
    means = matrix.groupBy("address").agg(*[F.avg(f"`{c}`").alias(c) for c in columns])
    return wallets.select("address").join(means, "address", "left").na.fill(0.0)


def fold_borders(last: int, folds: int = 4, warm_up: float = 1 / 3) -> tuple[list[int], int]:
    """(last step trained on in each fold, steps predicted after it): the folds share what follows the warm-up, so every
    later step is predicted once, however long the ledger is."""
    first = int(last * warm_up)
    ahead = max(1, math.ceil((last - first) / folds))
    return list(range(first, last, ahead)), ahead


def walk_forward(matrix: DataFrame, folds: int = 4, warm_up: float = 1 / 3) -> DataFrame:
    """(fold, part, time_step, txid): train on steps up to each border, predict those up to the next."""
    starts, ahead = fold_borders(matrix.agg(F.max("time_step")).first()[0] or 0, folds, warm_up)
    if not starts:
        return matrix.select(F.lit(0).alias("fold"), F.lit("").alias("part"), "time_step", "txid").limit(0)
    folds = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.lit(s).alias("until")) for i, s in enumerate(starts)])
    rows = matrix.select("txid", "time_step", F.inline(folds))
    part = F.when(F.col("time_step") <= F.col("until"), "train").when(F.col("time_step") <= F.col("until") + ahead, "predict")
    return rows.withColumn("part", part).where("part is not null").select("fold", "part", "time_step", "txid")


def leakage(folds: DataFrame) -> DataFrame:
    """(check, violations), each expected to be 0."""
    sides = folds.groupBy("fold").agg(
        F.max(F.when(F.col("part") == "train", F.col("time_step"))).alias("t"),
        F.min(F.when(F.col("part") == "predict", F.col("time_step"))).alias("p"),
    )
    late = sides.agg(F.count_if(F.col("t") >= F.col("p")).alias("violations")).select(F.lit("time_direction").alias("check"), "violations")
    both = folds.groupBy("fold", "txid").agg(F.count_distinct("part").alias("n"))
    shared = both.agg(F.count_if(F.expr("n > 1")).alias("violations")).select(F.lit("disjoint_ids").alias("check"), "violations")
    repeat = folds.where("part = 'predict'").groupBy("txid").count()
    many = repeat.agg(F.count_if(F.expr("count > 1")).alias("violations")).select(F.lit("one_prediction").alias("check"), "violations")
    return late.unionByName(shared).unionByName(many)


def package_manifest(case: Case, window_hours: int = 1) -> DataFrame:
    """(item, value): nodes, edges, source IPs and snapshots of the package."""
    from ledgerscope.operators.entity_graph import spend_edges

    n = F.count(F.lit(1)).alias("value")
    items = {
        "transaction_nodes": case.transactions.agg(n),
        "transaction_edges": spend_edges(case).agg(n),
        "wallet_nodes": _flows(case).agg(F.count_distinct("address").alias("value")),
        "network_nodes": case.network.agg(F.count_distinct("src_ip").alias("value")),
        "temporal_snapshots": time_steps(case, window_hours).agg(F.max("time_step").alias("value")),
    }
    rows = [df.select(F.lit(k).alias("item"), "value") for k, df in items.items()]
    return reduce(DataFrame.unionByName, rows)
