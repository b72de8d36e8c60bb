"""Long tables every wallet-level operator shares: one row per address appearance in a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.functions.ordered import first_k
from ledgerscope.session import materialize


def arrays_to_flows(records: DataFrame, side: str) -> DataFrame:
    """(txid, position, address, amount) from the parallel arrays of one side; a missing amount is 0."""
    zipped = F.arrays_zip(
        F.col(f"{side}_addresses").alias("address"), F.col(f"{side}_amounts").alias("amount")
    )
    return (
        records.select("txid", F.posexplode(zipped).alias("position", "flow"))
        .where(F.col("flow.address").isNotNull())
        .select("txid", "position", "flow.address", F.coalesce("flow.amount", F.lit(0.0)).alias("amount"))
    )


def flows_to_arrays(case: Case, limit: int | None = None) -> DataFrame:
    """Transactions with parallel address and amount arrays, ordered by position, empty when none.

    A transaction row carries its whole arrays, so without ``limit`` every transaction must fit a row;
    ``limit`` keeps the first positions only, for previews.
    """

    def packed(flows: DataFrame, index: str, side: str) -> DataFrame:
        items = flows if limit is None else first_k(flows, ["txid"], [index, "address"], limit)
        item = F.struct(F.col(index).alias("i"), "address", "amount")
        grouped = items.groupBy("txid").agg(F.array_sort(F.collect_list(item)).alias("items"))
        return grouped.select(
            "txid",
            F.col("items.address").alias(f"{side}_addresses"),
            F.col("items.amount").alias(f"{side}_amounts"),
        )

    joined = case.transactions.join(packed(case.inputs, "input_index", "input"), "txid", "left").join(
        packed(case.outputs, "output_index", "output"), "txid", "left"
    )
    empty_text, empty_num = F.array().cast("array<string>"), F.array().cast("array<double>")
    return joined.withColumns(
        {
            "input_addresses": F.coalesce("input_addresses", empty_text),
            "input_amounts": F.coalesce("input_amounts", empty_num),
            "output_addresses": F.coalesce("output_addresses", empty_text),
            "output_amounts": F.coalesce("output_amounts", empty_num),
        }
    )


def participation(case: Case) -> DataFrame:
    """(txid, address, sent, position, amount, record_id, timestamp): sent is 1 for inputs, 0 for outputs."""

    def side(flows: DataFrame, index: str, sent: int) -> DataFrame:
        return flows.where(F.col("address").isNotNull()).select(
            "txid",
            "address",
            F.lit(sent).alias("sent"),
            F.col(index).alias("position"),
            F.coalesce("amount", F.lit(0.0)).alias("amount"),
        )

    rows = side(case.inputs, "input_index", 1).unionByName(side(case.outputs, "output_index", 0))
    return rows.join(case.transactions.select("txid", "record_id", "timestamp"), "txid")


def memberships(part: DataFrame, with_amounts: bool = False) -> DataFrame:
    """One row per (address, txid): the grain at which wallet counts are additive.

    Taken straight from ``participation`` it needs no shuffle of its own, as that is laid out by txid already.
    ``with_amounts`` adds the single amounts of the address in the transaction, which the transaction's size bounds.
    """
    sent, got = F.col("sent") == 1, F.col("sent") == 0
    zero = F.lit(0.0)
    single = [
        F.collect_list(F.when(sent, F.col("amount"))).alias("sent_amounts"),
        F.collect_list(F.when(got, F.col("amount"))).alias("received_amounts"),
    ]
    return part.groupBy("address", "txid", "record_id", "timestamp").agg(
        F.count_if(sent).alias("sent_rows"),
        F.count_if(got).alias("received_rows"),
        F.sum(F.when(sent, F.col("amount")).otherwise(zero)).alias("sent_amount"),
        F.sum(F.when(got, F.col("amount")).otherwise(zero)).alias("received_amount"),
        *(single if with_amounts else []),
    )


def address_pairs(part: DataFrame, with_tx: bool = False) -> DataFrame:
    """Distinct payer-payee pairs, per transaction when ``with_tx``; an address never pays itself.

    Takes participation rows or memberships; memberships are distinct per (address, txid) already. Without ``with_tx``
    the two sides of participation rows come out of one row a transaction, as in ``transaction_packs``.
    """
    if not with_tx and "sent_rows" not in part.columns:
        side = lambda sent: F.collect_set(F.when(F.col("sent") == sent, F.col("address")))
        sides = part.where("txid is not null").groupBy("txid").agg(side(1).alias("payers"), side(0).alias("payees"))
        met = sides.select("payees", F.explode("payers").alias("source_address")).select(
            "source_address", F.explode("payees").alias("target_address")
        )
        return met.where("source_address <> target_address").distinct()
    members = part if "sent_rows" in part.columns else memberships(part)
    payers = members.where("sent_rows > 0").select("txid", F.col("address").alias("source_address"))
    payees = members.where("received_rows > 0").select("txid", F.col("address").alias("target_address"))
    pairs = payers.join(payees, "txid").where("source_address <> target_address")
    if with_tx:
        return pairs.select("source_address", "target_address", "txid")
    return pairs.select("source_address", "target_address").distinct()


def transaction_packs(case: Case) -> DataFrame:
    """(txid, records, sides): one row per transaction with flows, holding what ``memberships`` tells of it.

    ``records`` are its distinct (record_id, timestamp, copies); ``sides`` its addresses with their single amounts,
    (address, sent, received). A row is as large as its transaction. Flows are shuffled once, by txid; pairs, wallets and
    relay context are then taken out of the rows without meeting by txid again.
    """

    def side(flows: DataFrame, sent: bool) -> DataFrame:
        return flows.where("address is not null and txid is not null").select(
            "txid", "address", F.lit(sent).alias("pays"), F.coalesce("amount", F.lit(0.0)).alias("amount")
        )

    pays, amount = F.col("pays"), F.col("amount")
    flows = side(case.inputs, True).unionByName(side(case.outputs, False)).repartition("txid")
    single = flows.groupBy("txid", "address").agg(
        F.collect_list(F.when(pays, amount)).alias("sent"), F.collect_list(F.when(~pays, amount)).alias("received")
    )
    sides = single.groupBy("txid").agg(F.collect_list(F.struct("address", "sent", "received")).alias("sides"))
    told = case.transactions.where("txid is not null").select("txid", "record_id", "timestamp").repartition("txid")
    copies = told.groupBy("txid", "record_id", "timestamp").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    records = copies.groupBy("txid").agg(F.collect_list(F.struct("record_id", "timestamp", "copies")).alias("records"))
    return sides.join(records, "txid")


def packed_members(packs: DataFrame) -> DataFrame:
    """``memberships`` with amounts, from packs."""
    each = packs.select("txid", F.explode("records").alias("r"), "sides").select("txid", "r", F.explode("sides").alias("m"))
    copies = F.col("r.copies")
    listed = {f"{n}_amounts": F.when(copies == 1, F.col(f"m.{n}")).otherwise(F.flatten(F.array_repeat(F.col(f"m.{n}"), copies))) for n in ("sent", "received")}
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    rows = each.select(
        F.col("m.address").alias("address"), "txid", F.col("r.record_id").alias("record_id"), F.col("r.timestamp").alias("timestamp"),
        *[c.alias(n) for n, c in listed.items()],
    )
    return rows.select(
        "address", "txid", "record_id", "timestamp",
        F.size("sent_amounts").cast("long").alias("sent_rows"), F.size("received_amounts").cast("long").alias("received_rows"),
        total("sent_amounts").alias("sent_amount"), total("received_amounts").alias("received_amount"),
        "sent_amounts", "received_amounts",
    )


def packed_pairs(packs: DataFrame) -> DataFrame:
    """(w, v, txid, f, b, both) for every payer and payee of a transaction, w before v: f ways ahead or b back.

    ``both`` is f * b of the transaction, told once. A transaction of several records counts a way for every two of them.
    """
    def some(kind: str, other: str):
        kept = F.filter("sides", lambda m: F.size(m[kind]) > 0)
        return F.transform(kept, lambda m: F.struct(m["address"].alias("a"), (F.size(m[other]) > 0).alias("too")))

    k = F.size("records").cast("long")
    ways = packs.select("txid", (k * k).alias("k"), some("received", "sent").alias("payees"), F.explode(some("sent", "received")).alias("s"))
    met = ways.select("txid", "k", "s", F.explode("payees").alias("t")).where("s.a <> t.a")
    ahead, none = F.col("s.a") < F.col("t.a"), F.lit(0).cast("long")
    return met.select(
        F.least("s.a", "t.a").alias("w"), F.greatest("s.a", "t.a").alias("v"), "txid",
        F.when(ahead, F.col("k")).otherwise(none).alias("f"), F.when(ahead, none).otherwise(F.col("k")).alias("b"),
        F.when(ahead & F.col("s.too") & F.col("t.too"), F.col("k") * F.col("k")).otherwise(none).alias("both"),
    )


def pair_sums(pairs: DataFrame) -> DataFrame:
    """(w, v, nf, nb, ns) of ``packed_pairs``: transactions ahead, back, and products within one transaction."""
    return pairs.groupBy("w", "v").agg(F.sum("f").alias("nf"), F.sum("b").alias("nb"), F.sum("both").alias("ns"))


# A pair whose two wallets pay each other in different transactions.
MUTUAL = "nf > 0 and nb > 0 and nf * nb > ns"


def counterparties(packs: DataFrame) -> DataFrame:
    """Per address: distinct payers to it, distinct payees of it, distinct partners either way, and partners on cycles."""
    pairs = pair_sums(packed_pairs(packs)).select(
        "w", "v", (F.col("nf") > 0).cast("int").alias("wv"), (F.col("nb") > 0).cast("int").alias("vw"), F.expr(MUTUAL).cast("int").alias("turn")
    )

    def end(address: str, paid: str, paid_by: str):
        return F.struct(F.col(address).alias("address"), F.col(paid).alias("paid"), F.col(paid_by).alias("paid_by"), F.col("turn"))

    return pairs.select(F.inline(F.array(end("w", "wv", "vw"), end("v", "vw", "wv")))).groupBy("address").agg(
        F.sum("paid_by").alias("incoming_counterparties"),
        F.sum("paid").alias("outgoing_counterparties"),
        F.count(F.lit(1)).alias("unique_counterparties"),
        F.sum("turn").alias("mutual_partners"),
    )


def network_context(packs: DataFrame, network: DataFrame) -> DataFrame:
    """Per address: distinct relay IPs, countries and ASNs seen on its transactions."""
    seen = network.where("txid is not null").select("txid", "src_ip", "geo_country", "asn").distinct()
    kinds = ["src_ip", "geo_country", "asn"]
    named = [F.struct(F.lit(i).alias("kind"), F.col(name).cast("string").alias("value")) for i, name in enumerate(kinds)]
    # Distinct values are counted one a row: whole observations need not be made distinct per address before.
    met = packs.select("txid", F.col("sides.address").alias("addresses")).join(seen, "txid").select(F.explode("addresses").alias("address"), *kinds)
    found = met.select("address", F.inline(F.array(*named))).distinct()
    counted = [F.count(F.when(F.col("kind") == i, F.col("value"))) for i in range(len(kinds))]
    names = ("connected_ip_count", "unique_country_count", "unique_asn_count")
    return found.groupBy("address").agg(*[n.alias(name) for n, name in zip(counted, names, strict=True)])


class Members:
    """The flows of a case by transaction, written once, and the partners of every address, written when first asked for."""

    def __init__(self, case: Case):
        self.packs = materialize(transaction_packs(case), "packs")
        self._partners = None

    @property
    def rows(self) -> DataFrame:
        return packed_members(self.packs)

    @property
    def partners(self) -> DataFrame:
        if self._partners is None:
            self._partners = materialize(counterparties(self.packs), "partners")
        return self._partners
