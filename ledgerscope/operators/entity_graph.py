"""The typed entity graph: wallets, transactions, IPs, ASNs and countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.functions.ordered import first_k
from ledgerscope.operators.correlate import temporal_links
from ledgerscope.operators.participation import MUTUAL, Members, address_pairs, packed_pairs, pair_sums
from ledgerscope.session import cut, materialize

RELAY_TYPES = ("OBSERVED", "RELAYED_BY")

# Up to this many numbers are broadcast.
BROADCAST_KEYS = 2_000_000


def _node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


def edge_sightings(case: Case, part: DataFrame, allow_temporal: bool = False, window_seconds: int = 30) -> DataFrame:
    """One row per record that supports an edge, before aggregation."""
    none, when = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    wallet, tx = _node("wallet", F.col("address")), _node("transaction", F.col("txid"))
    ip = _node("ip", F.col("src_ip"))

    def rows(df, src, dst, kind, basis, rank, amount=none, at=when, record=None):
        return df.select(
            src.alias("src"),
            dst.alias("dst"),
            F.lit(kind).alias("type"),
            F.lit(basis).alias("basis"),
            F.lit(rank).alias("rank"),
            amount.alias("amount"),
            at.alias("seen"),
            (F.lit(None).cast("string") if record is None else F.col(record)).alias("record_id"),
        )

    amount, at = F.col("amount"), F.col("timestamp")
    net = case.network.where("src_ip is not null and src_ip <> ''")
    known = net.join(case.transactions.select("txid"), "txid", "left_semi")
    sources = [
        rows(part.where("sent = 1"), wallet, tx, "SPENT_FROM", "tx_input", 0, amount, at, "record_id"),
        rows(part.where("sent = 0"), tx, wallet, "SENT_TO", "tx_output", 0, amount, at, "record_id"),
        rows(known, ip, tx, "RELAYED_BY", "exact_txid", 1, none, at, "record_id"),
        rows(net.where("asn is not null"), ip, _node("asn", F.col("asn")), "HOSTED_IN", "asn_lookup", 1),
        rows(net.where("geo_country is not null"), ip, _node("country", F.col("geo_country")), "LOCATED_IN", "geoip", 1),
    ]
    if allow_temporal:
        links = temporal_links(case, window_seconds).where("src_ip is not null")
        sources.append(rows(links, ip, tx, "RELAYED_BY", "heuristic", 2, record="network_record_id"))
    return reduce(DataFrame.unionByName, sources)


def entity_edges(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("src", "dst", "type").agg(
        F.min_by("basis", "rank").alias("basis"),
        F.count(F.lit(1)).cast("double").alias("weight"),
        F.sum("amount").alias("amount"),
        F.min("seen").alias("first_seen"),
        F.max("seen").alias("last_seen"),
        F.count("record_id").alias("records"),
    )


def edge_sources(sightings: DataFrame) -> DataFrame:
    """(src, dst, type, record_id): the records behind every edge, one row each."""
    return sightings.where("record_id is not null").select("src", "dst", "type", "record_id").distinct()


def entity_nodes(case: Case, part: DataFrame) -> DataFrame:
    """(id, type, label, and the attributes of the node's type, null elsewhere)."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def shaped(df, kind, key, label=None, **attrs):
        return df.select(
            _node(kind, F.col(key)).alias("id"),
            F.lit(kind).alias("type"),
            (F.col(key) if label is None else label).alias("label"),
            attrs.get("timestamp", F.lit(None).cast("timestamp")).alias("timestamp"),
            attrs.get("fee", number).alias("fee"),
            attrs.get("total_input", number).alias("total_input"),
            attrs.get("total_output", number).alias("total_output"),
            attrs.get("asn", text).alias("asn"),
            attrs.get("country", text).alias("country"),
            attrs.get("source_record_id", text).alias("source_record_id"),
        )

    totals = part.groupBy("txid").agg(
        F.sum(F.when(F.col("sent") == 1, F.col("amount"))).alias("total_input"),
        F.sum(F.when(F.col("sent") == 0, F.col("amount"))).alias("total_output"),
    )
    txs = case.transactions.join(totals, "txid", "left").na.fill(0.0, ["total_input", "total_output"])
    short = F.when(F.length("txid") > 12, F.concat(F.substring("txid", 1, 8), F.lit("..."))).otherwise(F.col("txid"))
    net = case.network.where("src_ip is not null and src_ip <> ''")
    # Attributes merge to the newest non-null value.
    newest = F.struct(F.coalesce("timestamp", F.timestamp_seconds(F.lit(0))), "record_id")
    ips = net.groupBy("src_ip").agg(
        F.max_by("asn", F.when(F.col("asn").isNotNull(), newest)).alias("asn"),
        F.max_by("geo_country", F.when(F.col("geo_country").isNotNull(), newest)).alias("country"),
    )
    tables = [
        shaped(part.select("address").distinct(), "wallet", "address"),
        shaped(
            txs, "transaction", "txid", short,
            timestamp=F.col("timestamp"), fee=F.col("fee"), total_input=F.col("total_input"),
            total_output=F.col("total_output"), source_record_id=F.col("record_id"),
        ),
        shaped(ips, "ip", "src_ip", asn=F.col("asn"), country=F.col("country")),
        shaped(net.where("asn is not null").select("asn").distinct(), "asn", "asn", asn=F.col("asn")),
        shaped(
            net.where("geo_country is not null").select(F.col("geo_country").alias("code")).distinct(),
            "country", "code", country=F.col("code"),
        ),
    ]
    return reduce(DataFrame.unionByName, tables)


def bare_participation(part: DataFrame) -> DataFrame:
    """Participation rows that know who took part in what: all that ends, types and weights of edges rest on."""
    null = F.lit(None)
    bare = materialize(part.select("txid", "address", "sent"), "bare")
    return bare.withColumns(
        {"amount": null.cast("double"), "record_id": null.cast("string"), "timestamp": null.cast("timestamp")}
    )


def node_types(case: Case, part: DataFrame) -> DataFrame:
    """(id, type): the rows of ``entity_nodes`` without attributes."""
    net = case.network.where("src_ip is not null and src_ip <> ''")
    kinds = {
        "wallet": part.select("address").distinct(),
        "transaction": case.transactions.select("txid"),
        "ip": net.select("src_ip").distinct(),
        "asn": net.where("asn is not null").select("asn").distinct(),
        "country": net.where("geo_country is not null").select("geo_country").distinct(),
    }
    tables = [keys.select(_node(kind, F.col(keys.columns[0])).alias("id"), F.lit(kind).alias("type")) for kind, keys in kinds.items()]
    return reduce(DataFrame.unionByName, tables)


def spend_edges(case: Case) -> DataFrame:
    """Transaction-to-transaction edges of spent outputs; repeated spends keep their rows."""
    spent = case.outputs.select(F.col("txid").alias("source_txid"), F.col("output_index").alias("prev_vout")).distinct()
    spends = case.inputs.where("prev_txid is not null").select(
        F.col("prev_txid").alias("source_txid"), "prev_vout", F.col("txid").alias("target_txid")
    )
    joined = spends.join(spent, ["source_txid", "prev_vout"])
    return joined.where("source_txid <> target_txid").select("source_txid", "target_txid")


def spend_graph(case: Case) -> DataFrame:
    return spend_edges(case).select(F.col("source_txid").alias("src"), F.col("target_txid").alias("dst")).distinct()


def wallet_graph(part: DataFrame) -> DataFrame:
    pairs = address_pairs(part)
    return pairs.select(F.col("source_address").alias("src"), F.col("target_address").alias("dst"))


def address_tx_edges(case: Case) -> DataFrame:
    return case.inputs.where("address is not null").select("address", "txid").distinct()


def tx_address_edges(case: Case) -> DataFrame:
    """Only for transactions that have inputs."""
    paid = case.outputs.where("address is not null").select("txid", "address").distinct()
    return paid.join(case.inputs.select("txid"), "txid", "left_semi")


def originator_edges(case: Case) -> DataFrame:
    """One row per observation of a known transaction."""
    seen = case.network.join(case.transactions.select("txid"), "txid", "left_semi")
    return seen.select(
        F.concat(F.lit("ip:"), "src_ip").alias("originator_id"), "txid", F.unix_seconds("timestamp").alias("timestamp_epoch")
    )


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree) over distinct edges; all ``nodes`` when given."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return counted.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_centrality(degree_table: DataFrame) -> DataFrame:
    n = degree_table.agg(F.count(F.lit(1))).scalar()
    return degree_table.withColumn("degree_centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(1.0))


def hubs(degree_table: DataFrame, k: int = 10) -> DataFrame:
    return degree_table.orderBy(F.desc("degree"), "id").limit(k)


def roles(degree_table: DataFrame) -> DataFrame:
    role = (
        F.when((F.col("in_degree") == 0) & (F.col("out_degree") > 0), "source")
        .when((F.col("out_degree") == 0) & (F.col("in_degree") > 0), "sink")
        .otherwise("intermediate")
    )
    return degree_table.withColumn("role", role)


def two_hop_counts(edges: DataFrame) -> DataFrame:
    """Distinct nodes two steps ahead and behind, the start itself not counted."""
    a = edges.select(F.col("src").alias("start"), F.col("dst").alias("mid"))
    b = edges.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    reach = a.join(b, "mid").where("start <> end").select("start", "end").distinct()
    ahead = reach.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("forward_2hop_count"))
    behind = reach.groupBy(F.col("end").alias("id")).agg(F.count(F.lit(1)).alias("backward_2hop_count"))
    return ahead.join(behind, "id", "full").na.fill(0)


def _numbered_sides(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, d) and (lo, hi, out, back): nodes numbered by degree and with it, undirected sides between numbers.

    Sides point from the lower to the higher number; ``out`` and ``back`` say which directions are present. Ways
    over two sides are many, so they carry numbers and never ids.
    """
    ahead = F.col("src") < F.col("dst")
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(ahead.cast("byte")).alias("ab"), F.max((~ahead).cast("byte")).alias("ba")
    )
    pairs = materialize(pairs, "pairs")
    deg = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    # Sorted by range, so the numbers rise with the degree.
    nodes = materialize(deg.orderBy("d", "id").withColumn("n", F.monotonically_increasing_id()), "numbered")
    sized = pairs.join(nodes.select(F.col("id").alias("a"), F.col("d").alias("da"), F.col("n").alias("na")), "a").join(
        nodes.select(F.col("id").alias("b"), F.col("d").alias("db"), F.col("n").alias("nb")), "b"
    )
    up = F.col("na") < F.col("nb")
    pick = lambda yes, no: F.when(up, F.col(yes)).otherwise(F.col(no))
    sides = sized.select(
        pick("na", "nb").alias("lo"), pick("nb", "na").alias("hi"), pick("da", "db").alias("dlo"), pick("db", "da").alias("dhi"),
        pick("ab", "ba").alias("out"), pick("ba", "ab").alias("back"),
    )
    return nodes, materialize(sides, "sides")


def _closed_wedges(sides: DataFrame, turning: bool = False) -> DataFrame:
    """(lo, x, y) of every triangle of the undirected graph, with the directions present on its three sides.

    No node has more than about sqrt(2m) sides to higher nodes, however many neighbours it has, and wedges stay few.
    ``turning`` keeps only wedges that one can walk through, before they are shuffled to the third side.
    """
    first = sides.select("lo", F.col("hi").alias("x"), F.col("out").alias("lx"), F.col("back").alias("xl"))
    second = sides.select("lo", F.col("hi").alias("y"), F.col("out").alias("ly"), F.col("back").alias("yl"))
    wedges = first.join(second, "lo").where("x < y")
    if turning:
        wedges = wedges.where("lx * yl + ly * xl > 0")
    up = F.col("lo") < F.col("hi")
    closing = sides.select(
        F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"),
        F.when(up, F.col("out")).otherwise(F.col("back")).alias("xy"), F.when(up, F.col("back")).otherwise(F.col("out")).alias("yx"),
    )
    return wedges.join(closing, ["x", "y"])


def _named(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by number, by id again."""
    return nodes.select("id", "n").join(counts, "n").drop("n")


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per node of the undirected graph.

    Every side carries the higher neighbours of its lower node to its higher one, as one list of numbers; what the two
    have in common closes triangles. A list holds about sqrt(2m) numbers at most, and no wedge is a row.
    """
    nodes, sides = _numbered_sides(edges)
    above = sides.groupBy("lo").agg(F.sort_array(F.collect_list("hi")).alias("his"))
    later = F.expr("slice(his, at + 2, size(his))")
    asked = above.select("lo", "his", F.posexplode("his").alias("at", "hi")).select("lo", "hi", later.alias("later")).where("size(later) > 0")
    met = asked.join(above.select(F.col("lo").alias("hi"), "his"), "hi").select(
        "lo", "hi", F.array_intersect("later", "his").alias("third")
    ).where("size(third) > 0")
    each = lambda n, c: F.struct(n.alias("n"), c.cast("long").alias("c"))
    size = F.size("third")
    ends = F.concat(F.array(each(F.col("lo"), size), each(F.col("hi"), size)), F.transform("third", lambda z: each(z, F.lit(1))))
    return _named(nodes, met.select(F.inline(ends)).groupBy("n").agg(F.sum("c").alias("triangle_count")))


def three_cycles(edges: DataFrame) -> DataFrame:
    """Directed cycles of three nodes, counted per node."""
    nodes, sides = _numbered_sides(edges)
    turns = F.col("lx") * F.col("xy") * F.col("yl") + F.col("ly") * F.col("yx") * F.col("xl")
    closed = _closed_wedges(sides, turning=True).select("lo", "x", "y", turns.cast("long").alias("turns")).where("turns > 0")
    met = closed.select(F.explode(F.array("lo", "x", "y")).alias("n"), "turns")
    return _named(nodes, met.groupBy("n").agg(F.sum("turns").alias("cycles")))


# Ways that may end at a node for them to be held as lists in one row.
LISTED_WAYS = 1 << 18
# Neighbours in one row of a node's neighbours.
LISTED_NEAR = 1 << 10


def four_cycles(edges: DataFrame, listed: int = LISTED_WAYS) -> DataFrame:
    """Simple directed cycles of four nodes, counted per node.

    A cycle is counted at its highest node and the node opposite: with f ways over one node in one
    direction, b in the other and s nodes on both, the pair closes f*b - s cycles, so no two ways are listed together.
    A way starts on a side down from the highest node, hence a hub's neighbours are walked and never its pairs of them.
    Ways come to their highest node as lists of numbers, once, and only those of an opposite node met in both directions
    become rows. Nodes with more than ``listed`` ways have each way as a row, spread by both ends.
    """
    nodes, sides = _numbered_sides(edges)
    down = sides.select(F.col("lo").alias("v"), F.col("hi").alias("u"), F.col("out").alias("vu"), F.col("back").alias("uv"))
    near = sides.select(
        F.inline(
            F.array(
                F.struct(F.col("lo").alias("v"), F.col("dlo").alias("d"), F.col("hi").alias("w"), F.col("out").alias("vw"), F.col("back").alias("wv")),
                F.struct(F.col("hi").alias("v"), F.col("dhi").alias("d"), F.col("lo").alias("w"), F.col("back").alias("vw"), F.col("out").alias("wv")),
            )
        )
    )
    busy = materialize(sides.groupBy(F.col("hi").alias("u")).agg(F.sum("dlo").alias("ways")).where(F.col("ways") > listed).select("u"), "busy")
    calm = down
    found = None
    if not busy.isEmpty():
        calm = down.join(busy, "u", "left_anti")
        found = _opposite_rows(down.join(busy, "u", "left_semi"), near)
    lists = _opposite_lists(calm, near)
    found = lists if found is None else found.unionByName(lists)
    return _named(nodes, found.groupBy("n").agg((F.sum("twice") / 2).cast("long").alias("cycles")))


def _opposite_lists(down: DataFrame, near: DataFrame) -> DataFrame:
    """(n, twice): twice the cycles over each node, from ways gathered as lists at their highest node."""
    part = F.pmod(F.col("w"), F.floor((F.col("d") + LISTED_NEAR - 1) / LISTED_NEAR))
    lists = near.groupBy("v", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.when(F.col("vw") > 0, F.col("w")))).alias("outs"),
        F.sort_array(F.collect_list(F.when(F.col("wv") > 0, F.col("w")))).alias("ins"),
    )
    none = F.array().cast("array<bigint>")
    lower = lambda on, c: F.when(F.col(on) > 0, F.filter(c, lambda w: w < F.col("u"))).otherwise(none)
    ways = down.join(lists, "v").select("u", "v", lower("uv", "outs").alias("fs"), lower("vu", "ins").alias("bs"))
    held = ways.where("size(fs) + size(bs) > 0").repartition("u").groupBy("u").agg(F.collect_list(F.struct("v", "fs", "bs")).alias("ways"))
    held = held.select("u", "ways", F.array_intersect(F.flatten("ways.fs"), F.flatten("ways.bs")).alias("both")).where("size(both) > 0")
    kept = held.select("u", "both", F.explode("ways").alias("way")).select(
        "u", F.col("way.v").alias("v"), F.array_intersect("way.fs", "both").alias("fs"), F.array_intersect("way.bs", "both").alias("bs")
    )
    met = kept.select("u", "v", "fs", "bs", F.explode(F.array_union("fs", "bs")).alias("w")).select(
        "u", "v", "w", F.array_contains("fs", F.col("w")).cast("long").alias("f"), F.array_contains("bs", F.col("w")).cast("long").alias("b")
    )
    pair = Window.partitionBy("u", "w")
    sums = met.withColumns({"nf": F.sum("f").over(pair), "nb": F.sum("b").over(pair)})
    through = F.col("f") * (F.col("nb") - F.col("b")) + F.col("b") * (F.col("nf") - F.col("f"))
    # Every cycle of a pair goes over two nodes between: the sum over them is twice the pair's cycles.
    each = lambda n, c: F.struct(F.col(n).alias("n"), c.alias("twice"))
    cycles = sums.select("u", "v", "w", through.alias("c")).where("c > 0")
    return cycles.select(F.inline(F.array(each("u", F.col("c")), each("w", F.col("c")), each("v", 2 * F.col("c")))))


def _opposite_rows(down: DataFrame, near: DataFrame) -> DataFrame:
    """The same from one row a way, for nodes with too many ways for one row."""
    ways = down.join(near, "v").where("w < u").select(
        "u", "v", "w", (F.col("uv") * F.col("vw")).cast("long").alias("f"), (F.col("wv") * F.col("vu")).cast("long").alias("b")
    ).where("f + b > 0")
    sums = materialize(
        ways.groupBy("u", "w").agg(F.sum("f").alias("nf"), F.sum("b").alias("nb"), F.sum(F.col("f") * F.col("b")).alias("ns"))
        .where("nf > 0 and nb > 0 and nf * nb > ns"),
        "opposite",
    )
    ends = sums.select(F.explode(F.array("u", "w")).alias("n"), (2 * (F.col("nf") * F.col("nb") - F.col("ns"))).alias("twice"))
    through = ways.join(sums, ["u", "w"]).select(
        F.col("v").alias("n"), (2 * (F.col("f") * (F.col("nb") - F.col("b")) + F.col("b") * (F.col("nf") - F.col("f")))).alias("twice")
    )
    return ends.union(through).where("twice > 0")


def _between(pairs: DataFrame, addresses: DataFrame) -> DataFrame:
    """``pairs`` whose two ends are among ``addresses``, and a few more: ends meet by a number that two may share.

    Beyond ``BROADCAST_KEYS`` addresses the ends are shuffled to them.
    """
    for end in ("w", "v"):
        if addresses.count() <= BROADCAST_KEYS:
            keys = addresses.select(F.xxhash64("address").alias("key")).distinct()
            pairs = pairs.join(F.broadcast(keys), F.xxhash64(end) == F.col("key"), "left_semi")
        else:
            pairs = pairs.join(addresses.select(F.col("address").alias(end)), end, "left_semi")
    return pairs


def short_cycles(members: Members) -> DataFrame:
    """Simple directed cycles of length 2 and 4 through each wallet and transaction node.

    Between wallets and transactions only these lengths exist up to 4. Length 2: a wallet pays itself in
    one transaction. Length 4: w pays v in one transaction and v pays w in another, so a wallet pair with
    f forward, b backward and s shared transactions closes f*b - s cycles; no pair of rows is listed.
    """
    # Wallets on such a cycle are few and known from the partners: only transactions between them are looked at again.
    turning = members.partners.where("mutual_partners > 0").select("address")
    between = materialize(_between(packed_pairs(members.packs), turning), "between-turning")
    per_pair = materialize(pair_sums(between).where(MUTUAL), "cycle-pairs")
    by_tx = between.join(per_pair, ["w", "v"]).groupBy("w", "v", "nf", "nb", "txid").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    tx_hits = by_tx.select(
        _node("transaction", F.col("txid")).alias("id"),
        (F.col("f") * (F.col("nb") - F.col("b")) + F.col("b") * (F.col("nf") - F.col("f"))).alias("n"),
    )
    pair_hits = per_pair.select(
        F.explode(F.array("w", "v")).alias("address"), (F.col("nf") * F.col("nb") - F.col("ns")).alias("n")
    ).select(_node("wallet", F.col("address")).alias("id"), "n")
    own = members.rows.where("sent_rows > 0 and received_rows > 0").select("address", "txid")
    own_hits = own.select(
        F.explode(F.array(_node("wallet", F.col("address")), _node("transaction", F.col("txid")))).alias("id"),
        F.lit(1).cast("long").alias("n"),
    )
    hits = pair_hits.unionByName(tx_hits).unionByName(own_hits)
    return hits.groupBy("id").agg(F.sum("n").alias("short_cycle_count"))


def time_steps(case: Case, window_hours: int = 1) -> DataFrame:
    """(txid, timestamp_epoch, time_step): fixed windows counted from the case's first transaction."""
    width = max(3600, window_hours * 3600)
    first = case.transactions.agg(F.min("timestamp_epoch")).scalar()
    step = F.floor((F.col("timestamp_epoch") - first) / width) + 1
    return case.transactions.select("txid", "timestamp_epoch", step.cast("long").alias("time_step"))


def snapshot_edges(case: Case, window_hours: int = 1) -> DataFrame:
    """Spend edges active in each time step, dated by the spending transaction."""
    steps = time_steps(case, window_hours).select(F.col("txid").alias("target_txid"), "time_step")
    return spend_edges(case).join(steps, "target_txid").select("time_step", "source_txid", "target_txid")


def visible_graph(
    nodes: DataFrame, edges: DataFrame, node_type: str | None = None, include_ips: bool = True, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and induced edges a viewer asked for; ``limit`` keeps the first ids as the view's size."""
    if not include_ips:
        nodes = nodes.where("type <> 'ip'")
        edges = edges.where(~F.col("type").isin(*RELAY_TYPES))
    if node_type:
        nodes = nodes.where(F.col("type") == node_type)
    if limit is not None:
        nodes = nodes.orderBy("id").limit(limit)
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return nodes, kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def find_nodes(nodes: DataFrame, term: str) -> DataFrame:
    wanted = term.lower()
    return nodes.where(F.lower("id").contains(wanted) | F.lower("label").contains(wanted))


def flagged_nodes(nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    return nodes.join(alerts.select(F.col("entity_id").alias("id")), "id", "left_semi")


def node_links(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Incoming and outgoing edges of one node with the node at the other end."""
    other = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"), "label")
    leaving = edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "type", "weight")
    arriving = edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "type", "weight")
    return leaving.unionByName(arriving).join(other, "other", "left")


def match_node(nodes: DataFrame, wanted: str) -> DataFrame:
    """The node an investigator means: by id, else by id suffix, else by label."""
    order = (
        F.when(F.col("id") == wanted, 0)
        .when(F.col("id").endswith(f":{wanted}"), 1)
        .when(F.col("label") == wanted, 2)
    )
    ranked = nodes.select("id", order.alias("rank"), F.lit(0).alias("g")).where("rank is not null")
    return first_k(ranked, ["g"], ["rank", "id"], 1).select("id")


def ego_network(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` undirected steps with their distance, and the edges met on the way."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct()
    seen = seeds.select("id", F.lit(0).alias("hop"))
    if hops > 1:
        both, seen = cut(both), cut(seen)
    frontier = seen.select("id")
    for hop in range(1, hops + 1):
        reached = both.join(frontier.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti")
        if hops > 1:
            # Read by every later hop, so it is computed once.
            frontier = cut(frontier)
        seen = seen.unionByName(frontier.select("id", F.lit(hop).alias("hop")))
    inner = seen.where(F.col("hop") < hops).select("id")
    touching = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").union(
        edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    )
    return seen, touching.distinct()


def neighbour_means(edges: DataFrame, features: DataFrame, columns: list[str], layers: int = 1) -> DataFrame:
    """Mean of each column over a node's undirected neighbours, ``layers`` times."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()
    current = features.select("id", *columns)
    for _ in range(layers):
        met = both.join(current.withColumnRenamed("id", "src"), "src")
        means = met.groupBy(F.col("dst").alias("id")).agg(*[F.avg(c).alias(c) for c in columns])
        current = features.select("id").join(means, "id", "left").na.fill(0.0)
    return current


def normalised_sums(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Neighbour sums along edges with weight 1/sqrt(d_i d_j), d the out-degree; rows are edge sources."""
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    di = deg.withColumnRenamed("d", "di")
    dj = deg.select(F.col("src").alias("dst"), F.col("d").alias("dj"))
    weighted = edges.select("src", "dst").join(di, "src").join(dj, "dst").join(features.withColumnRenamed("id", "dst"), "dst")
    w = 1.0 / F.sqrt(F.col("di") * F.col("dj"))
    return weighted.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col(c) * w).alias(c) for c in columns])


def time_encoding(df: DataFrame, at: str, dims: int = 16) -> DataFrame:
    """dims/2 sines then dims/2 cosines of ``at`` at geometrically spaced frequencies."""
    half = range(0, dims, 2)
    waves = {f"time_sin_{i // 2}": F.sin(F.col(at) / (10000 ** (i / dims))) for i in half}
    waves |= {f"time_cos_{i // 2}": F.cos(F.col(at) / (10000 ** (i / dims))) for i in half}
    return df.withColumns(waves)
