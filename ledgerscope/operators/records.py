"""Mapping, validating and normalising array-style records, each one pass of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.case import Case
from ledgerscope.functions import text
from ledgerscope.operators.participation import arrays_to_flows
from ledgerscope.schema import ALIASES, LIST_COLUMNS

MONEY_EPSILON = 1e-8
TX_FIELDS = (*LIST_COLUMNS, "fee")
NET_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port")


def as_list(field: T.StructField) -> Column:
    """array<string> of a list column in any of the shapes the readers deliver."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        return F.when(col.isNull(), None).otherwise(F.filter(col.cast("array<string>"), lambda x: x.isNotNull()))
    if isinstance(field.dataType, T.StructType):
        parts = []
        for sub in field.dataType:
            inner = col.getField(sub.name)
            many = isinstance(sub.dataType, T.ArrayType)
            parts.append(inner.cast("array<string>") if many else F.array(inner.cast("string")))
        flat = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
        return F.when(col.isNull(), None).otherwise(F.filter(flat, lambda x: x.isNotNull()))
    return F.when(col.isNull(), None).otherwise(text.parse_list(col.cast("string")))


def map_columns(raw: DataFrame) -> DataFrame:
    """Canonical names for every known alias, in any letter case; unknown columns are kept.

    When several aliases of one column are present the last non-null one wins.
    """
    lookup = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    found: dict[str, list[T.StructField]] = {}
    kept: list[Column] = []
    for field in raw.schema:
        name = lookup.get(field.name.strip().lower())
        if name:
            found.setdefault(name, []).insert(0, field)
        else:
            kept.append(F.col(f"`{field.name}`").alias(field.name.strip()))
    mapped = []
    for name, fields in found.items():
        if name in LIST_COLUMNS:
            cols = [as_list(f) for f in fields]
        else:
            cols = [F.col(f"`{f.name}`").cast("string") for f in fields]
        mapped.append(F.coalesce(*cols).alias(name))
    return raw.select(*kept, *mapped)


def _complete(mapped: DataFrame) -> DataFrame:
    """Every canonical column present, null where the source has none."""
    missing = {}
    for name in (*ALIASES, "record_id"):
        if name not in mapped.columns:
            kind = "array<string>" if name in LIST_COLUMNS else "string"
            missing[name] = F.lit(None).cast(kind)
    return mapped.withColumns(missing) if missing else mapped


def _issue(kind: str, code: str, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(kind).alias("issue_type"), F.lit(code).alias("code"), said.alias("message"))


def _shown(col: Column | str) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.coalesce(value.cast("string"), F.lit("None"))


def _amount_issues(side: str) -> Column:
    label, code = side.capitalize(), side.upper()

    def check(item: Column, index: Column) -> Column:
        number = text.number(item)
        where = F.concat(F.lit(f"{label} amount at index "), index.cast("string"))
        return (
            F.when(number < 0, _issue("error", f"NEGATIVE_{code}_AMOUNT", F.concat(where, F.lit(" below zero: "), item)))
            .when(number.isNull(), _issue("error", f"INVALID_{code}_AMOUNT", F.concat(where, F.lit(" is no number: "), item)))
        )

    return F.array_compact(F.transform(F.col(f"{side}_amounts"), check))


def validate(mapped: DataFrame, kind: str = "auto", epsilon: float = MONEY_EPSILON) -> DataFrame:
    """Adds ``issues`` (array of issue_type, code, message) and ``is_valid``."""
    df = _complete(mapped)
    col = F.col
    # Parsed once here, read several times below.
    parsed = {
        "_at": text.parse_timestamp(col("timestamp")),
        "_fee": text.number(col("fee")),
        "_input": text.parse_numbers(col("input_amounts")),
        "_output": text.parse_numbers(col("output_amounts")),
    }
    df = df.withColumns(parsed)

    def given(*names: str) -> Column:
        flags = [col(n).isNotNull() for n in names]
        out = flags[0]
        for flag in flags[1:]:
            out = out | flag
        return out

    as_tx = F.lit(kind in ("transaction", "combined")) | (F.lit(kind == "auto") & given(*TX_FIELDS))
    as_net = F.lit(kind in ("network", "combined")) | (F.lit(kind == "auto") & given(*NET_FIELDS))
    time_text = F.trim("timestamp")
    no_time = F.coalesce(time_text, F.lit("")) == ""
    fee = col("_fee")

    def parity(side: str) -> Column:
        a, m = F.size(f"{side}_addresses"), F.size(f"{side}_amounts")
        text_ = F.format_string(
            f"{side}: %d addresses beside %d amounts", a, m
        )
        return F.when(
            as_tx & (a > 0) & (m > 0) & (a != m), _issue("error", f"ARRAY_PARITY_{side.upper()}_MISMATCH", text_)
        )

    def total(side: str) -> Column:
        return F.aggregate(f"_{side}", F.lit(0.0), lambda acc, x: acc + x)

    def numeric(side: str) -> Column:
        items = col(f"{side}_amounts")
        return (F.size(items) > 0) & (F.size(f"_{side}") == F.size(items))

    df = df.withColumns({"_paid": total("input"), "_due": total("output") + F.coalesce(fee, F.lit(0.0))})
    expected = col("_due")
    delta = F.abs(col("_paid") - expected)
    summable = numeric("input") & numeric("output") & (col("fee").isNull() | fee.isNotNull())

    def address(name: str) -> Column:
        bad = ~text.ip_ok(col(name))
        blank = F.coalesce(F.trim(name), F.lit("")) == ""
        code = f"INVALID_{name.upper()}"
        if kind == "network":
            return F.when(bad, _issue("error", code, F.concat(F.lit(f"{name} is no address: "), _shown(name))))
        return F.when(
            as_net & ~blank & bad, _issue("error", code, F.concat(F.lit(f"{name} is no address: "), _shown(name)))
        )

    def port(name: str) -> Column:
        said = F.concat(F.lit(f"{name} is no port: "), _shown(name))
        return F.when(as_net & ~text.port_ok(col(name)), _issue("error", f"INVALID_{name.upper()}", said))

    none = F.array().cast("array<struct<issue_type:string,code:string,message:string>>")
    single = F.array_compact(
        F.array(
            F.when(no_time, _issue("error", "MISSING_TIMESTAMP", "no time given")).when(
                col("_at").isNull(),
                _issue("error", "INVALID_TIMESTAMP", F.concat(F.lit("not a time: "), _shown("timestamp"))),
            ),
            F.when(
                as_tx & (F.coalesce(F.trim("txid"), F.lit("")) == ""),
                _issue("error", "MISSING_TXID", "no txid given"),
            ),
            parity("input"),
            parity("output"),
            F.when(as_tx & (fee < 0), _issue("error", "NEGATIVE_FEE", F.concat(F.lit("fee below zero: "), _shown("fee")))),
            F.when(
                as_tx & col("fee").isNotNull() & fee.isNull(),
                _issue("error", "INVALID_FEE", F.concat(F.lit("fee is no number: "), _shown("fee"))),
            ),
            F.when(
                as_tx & summable & (delta > epsilon),
                _issue(
                    "warning",
                    "MONETARY_DISCREPANCY",
                    F.concat(
                        F.lit("inputs of "), _shown("_paid"),
                        F.lit(" against outputs and fee of "), _shown(expected),
                        F.lit(", apart by "), F.format_string("%.8f", delta),
                    ),
                ),
            ),
            address("src_ip"),
            address("dst_ip"),
            port("src_port"),
            port("dst_port"),
        )
    )

    def amounts(side: str) -> Column:
        return F.when(as_tx & col(f"{side}_amounts").isNotNull(), _amount_issues(side)).otherwise(none)

    checked = df.withColumn("issues", F.concat(single, amounts("input"), amounts("output")))
    # A later filter on is_valid would be pushed below these projections, every parsed column copied into
    # it over and over. The scan's row number is not deterministic, so a filter on it stays above them.
    numbered = F.monotonically_increasing_id() >= 0
    done = checked.withColumn("is_valid", ~F.exists("issues", lambda i: i["issue_type"] == "error") & numbered)
    return done.drop(*parsed, "_paid", "_due")


def issue_rows(validated: DataFrame) -> DataFrame:
    return validated.select("record_id", F.inline("issues"))


def counters(validated: DataFrame) -> DataFrame:
    """total, accepted and rejected rows, and warnings, as one row."""
    warnings = F.size(F.filter("issues", lambda i: i["issue_type"] == "warning"))
    return validated.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("is_valid")).alias("accepted_rows"),
        F.count_if(~F.col("is_valid")).alias("rejected_rows"),
        F.coalesce(F.sum(warnings), F.lit(0)).alias("warning_count"),
    )


def normalize(validated: DataFrame) -> DataFrame:
    """Typed canonical columns of the accepted rows, and ``is_transaction`` for routing."""
    col = F.col
    rows = _complete(validated)
    if "is_valid" in rows.columns:
        rows = rows.where("is_valid").drop("is_valid", "issues")
    flows = col("input_addresses").isNotNull() | col("output_addresses").isNotNull() | col("input_amounts").isNotNull()
    net = col("src_ip").isNotNull() | col("dst_ip").isNotNull() | col("src_port").isNotNull()
    routed = (col("txid").isNotNull() & flows) | ~net
    return rows.withColumns(
        {
            "is_transaction": routed,
            "timestamp": text.parse_timestamp(col("timestamp")),
            "txid": F.trim("txid"),
            "src_ip": text.normalize_ip(col("src_ip")),
            "dst_ip": text.normalize_ip(col("dst_ip")),
            "src_port": text.parse_port(col("src_port")),
            "dst_port": text.parse_port(col("dst_port")),
            "input_amounts": text.parse_numbers(col("input_amounts")),
            "output_amounts": text.parse_numbers(col("output_amounts")),
            "fee": F.when(col("fee").isNotNull(), F.coalesce(text.number(col("fee")), F.lit(0.0))),
            "geo_country": F.upper(F.trim("geo_country")),
            "asn": F.trim("asn"),
        }
    )


def to_case(normalized: DataFrame) -> Case:
    """Array-style records to the four case tables; combined rows feed both sides."""
    txs = normalized.where("is_transaction and txid is not null and txid <> ''")
    ins = arrays_to_flows(txs, "input")
    outs = arrays_to_flows(txs, "output")
    no_text = F.lit(None).cast("string")
    transactions = txs.select(
        "record_id",
        "txid",
        "timestamp",
        F.unix_seconds("timestamp").alias("timestamp_epoch"),
        F.coalesce("fee", F.lit(0.0)).alias("fee"),
        F.lit(0).cast("long").alias("size"),
        F.lit(1).alias("version"),
        F.lit(0).cast("long").alias("locktime"),
    )
    network = normalized.where("not is_transaction or src_ip is not null").select(
        "record_id", "timestamp", "txid", "src_ip", "dst_ip", "src_port", "dst_port", "asn", "geo_country"
    )
    return Case(
        transactions,
        ins.select(
            "txid",
            F.col("position").alias("input_index"),
            no_text.alias("prev_txid"),
            F.lit(None).cast("int").alias("prev_vout"),
            "address",
            "amount",
        ),
        outs.select("txid", F.col("position").alias("output_index"), "address", "amount"),
        network,
    )
