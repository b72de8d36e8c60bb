"""The driver's star-schema tables read as a case: transactions, inputs, outputs, network.

The mapping is fixed arithmetic on the keys, stated once here and once in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.functions.ordered import previous, row_numbers

EPOCH_2024 = 1_704_067_200


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def star_case(spark: SparkSession, sf_dir: str) -> Case:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem")
    events = read(spark, sf_dir, "events")
    n_orders, n_lines, n_events = orders.count(), lines.count(), events.count()

    stamp = F.lit(EPOCH_2024) + F.pmod(F.col("o_orderkey") * 7919, F.lit(2_592_000))
    keyed = orders.select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.concat(F.lit("tx_"), F.col("o_orderkey")).alias("txid"),
        stamp.cast("long").alias("timestamp_epoch"),
    )
    transactions = keyed.select(
        F.format_string("tx-rec-%06d", "o_orderkey").alias("record_id"),
        "txid",
        F.timestamp_seconds("timestamp_epoch").alias("timestamp"),
        "timestamp_epoch",
        ((F.col("o_orderkey") % 100) / 400.0 * F.col("o_totalprice") / 1e4).alias("fee"),
        (180 + F.col("o_orderkey") % 400).cast("long").alias("size"),
        F.lit(1).alias("version"),
        F.lit(0).cast("long").alias("locktime"),
    )

    chain = previous(
        keyed, ["o_custkey"], ["timestamp_epoch", "o_orderkey"], "txid", "prev_txid", n_orders
    )
    first = chain.select(
        "txid",
        F.lit(0).alias("input_index"),
        "prev_txid",
        F.lit(0).alias("prev_vout"),
        F.concat(F.lit("W"), F.col("o_custkey")).alias("address"),
        (F.col("o_totalprice") / 1e4).alias("amount"),
    )
    payers = orders.agg(F.count_distinct("o_custkey")).scalar()
    second = keyed.where(F.col("o_orderkey") % 3 == 0).select(
        "txid",
        F.lit(1).alias("input_index"),
        F.concat(F.lit("tx_"), F.col("o_orderkey") - 11).alias("prev_txid"),
        F.lit(0).alias("prev_vout"),
        F.concat(F.lit("W"), (F.col("o_custkey") * 7 + 3) % payers).alias("address"),
        (F.col("o_totalprice") / 2e4).alias("amount"),
    )
    inputs = first.unionByName(second)

    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e4
    placed = row_numbers(
        lines.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"
        ),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"],
        "at",
        n_lines,
    )
    outputs = placed.select(
        F.concat(F.lit("tx_"), F.col("l_orderkey")).alias("txid"),
        F.col("at").cast("int").alias("output_index"),
        F.concat(F.lit("W"), F.col("l_partkey")).alias("address"),
        F.when(F.col("l_quantity") <= 5, amount * 1e-6).otherwise(amount).alias("amount"),
    )

    user = F.col("user_id")
    tx_key = F.pmod(F.col("event_id") * 7, F.lit(max(1, n_orders // 4)))
    country = F.element_at(
        F.array(*[F.lit(c) for c in ("US", "DE", "SG", "NL", "IN", "GB")]), (user % 6 + 1).cast("int")
    )
    network = events.select(
        F.concat(F.lit("net_"), F.col("event_id")).alias("record_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_id") % 4 != 3, F.concat(F.lit("tx_"), tx_key)).alias("txid"),
        F.concat(F.lit("10.0."), F.floor(user / 256), F.lit("."), user % 256).alias("src_ip"),
        F.concat(F.lit("192.0.2."), F.col("event_id") % 250).alias("dst_ip"),
        (40000 + F.col("event_id") % 1000).cast("int").alias("src_port"),
        F.when(F.col("event_type") == "signup", 9050)
        .when(F.col("event_type") == "error", 9999)
        .otherwise(8333)
        .alias("dst_port"),
        F.concat(F.lit("AS"), 15000 + user % 20).alias("asn"),
        country.alias("geo_country"),
    )
    # Two inputs per order at most; the other bounds are the table counts themselves.
    return Case(transactions, inputs, outputs, network, (n_orders, 2 * n_orders, n_lines, n_events))


# Untidy text derived from the orders by fixed expressions: k the order key, c the customer, p whole units.
DIRTY = {
    "record_id": "'r' || k",
    "time": """CASE k % 5 WHEN 0 THEN '' || (1704067200 + k) WHEN 1 THEN '' || (1704067200000 + k * 1000)
                WHEN 2 THEN iso || 'Z' WHEN 3 THEN slashed
                ELSE CASE WHEN k % 35 = 4 THEN 'not-a-date' WHEN k % 55 = 9 THEN '' ELSE iso END END""",
    "tx_hash": "CASE WHEN k % 97 = 0 THEN '' ELSE ' tx_' || k || ' ' END",
    "senders": """CASE k % 4 WHEN 0 THEN 'W' || c || '|W' || k WHEN 1 THEN 'W' || c || '; W' || k
                   WHEN 2 THEN '["W' || c || '","W' || k || '"]' ELSE 'W' || c END""",
    "input_value": """CASE WHEN k % 41 = 0 THEN '' || p WHEN k % 50 = 7 THEN '-5|3' WHEN k % 60 = 8 THEN 'abc,3'
                       WHEN k % 4 = 3 THEN '' || p ELSE p || '|' || (p + 1) END""",
    "recipients": "'W' || (k % 1000)",
    "output_value": "CASE WHEN k % 2 = 0 THEN '' || (2 * p + 1 - k % 100) ELSE '' || p END",
    "tx_fee": "CASE WHEN k % 45 = 1 THEN 'x' WHEN k % 46 = 2 THEN '-1' ELSE '' || (k % 100) END",
    "client_ip": """CASE WHEN k % 6 = 5 THEN ' 2001:0DB8:0000:0:1:0:0:' || (k % 10)
                     ELSE '10.0.0.' || (k % 300) END""",
    "server_ip": "'192.0.2.' || (k % 250) || ' '",
    "source_port": "'' || ((k * 7) % 70000)",
    "dest_port": "'8333'",
    "country": "' us '",
    "as_number": "' AS' || (k % 20)",
}


def dirty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    when = "timestamp_seconds(1704067200 + o_orderkey)"
    base = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "cast(floor(o_totalprice) AS bigint) AS p",
        f"date_format({when}, \"yyyy-MM-dd'T'HH:mm:ss\") AS iso",
        f"date_format({when}, 'yyyy/MM/dd HH:mm:ss') AS slashed",
    )
    return base.selectExpr(*[f"{text} AS {name}" for name, text in DIRTY.items()])
