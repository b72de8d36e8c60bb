"""The registered queries: every one reads the given tables through ``star_case``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions.maths import half_even
from ledgerscope.operators import correlate, features, participation as parts
from ledgerscope.operators import (
    alerts,
    case_files,
    dictionary,
    entity_graph as graph,
    evaluate,
    geo,
    graph_walks as walks,
    tree_walks as trees,
    investigate,
    isolation_forest as iforest,
    matrices,
    modularity,
    records,
    rules,
    scoring,
    signals,
    supervised,
)
from ledgerscope.functions import text
from ledgerscope.plans.star_case import dirty_records, star_case
from ledgerscope.session import cut, materialize, work_path
from ledgerscope import schema
from ledgerscope.sources import readers, reports, tables as tables_io
from ledgerscope.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles whose last bits depend on summation order, brought to a fixed number of digits."""
    return df.withColumns({c: half_even(c, d) for c, d in digits.items()})


@query
def case_tables(spark, sf):
    case = star_case(spark, sf)

    def line(name, df, key, total):
        return df.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), half_even(total, 8).alias("total")
        ).select(F.lit(name).alias("tbl"), "n", "keys", "total")

    return (
        line("transactions", case.transactions, F.col("txid"), F.sum("fee"))
        .unionByName(line("inputs", case.inputs, F.coalesce("prev_txid", F.lit("-")), F.sum("amount")))
        .unionByName(
            line("outputs", case.outputs, F.concat_ws("/", "txid", "output_index"), F.sum("amount"))
        )
        .unionByName(line("network", case.network, F.col("txid"), F.sum("src_port").cast("double")))
    )


@query
def transaction_features(spark, sf):
    out = features.transaction_features(star_case(spark, sf))
    out = out.withColumn("timestamp_epoch", F.unix_seconds("timestamp")).drop("timestamp")
    return rounded(out, total_input=8, total_output=8, transaction_value=8, fee=8, fee_ratio=8)


def _wallets(case, members: parts.Members | None = None) -> DataFrame:
    w = rounded(features.wallet_features(case, members=members), total_incoming=8, total_outgoing=8)
    got, paid = F.col("total_incoming"), F.col("total_outgoing")
    return w.withColumns(
        {
            "total_volume": got + paid,
            "net_balance_change": got - paid,
            "average_transaction_value": (got + paid) / F.col("flow_count"),
        }
    )


@query
def wallet_features(spark, sf):
    return rounded(
        _wallets(star_case(spark, sf)),
        transaction_rate=10,
        median_transaction_value=10,
    )


@query
def wallet_sources(spark, sf):
    return (
        features.wallet_sources(star_case(spark, sf))
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.min("record_id").alias("first_record"),
            F.max("record_id").alias("last_record"),
        )
    )


@query
def wallet_first_sources(spark, sf):
    kept = features.first_sources(features.wallet_sources(star_case(spark, sf)))
    return kept.select("entity_id", F.concat_ws(",", "source_record_ids").alias("records"))


@query
def network_features(spark, sf):
    return rounded(
        features.network_features(star_case(spark, sf)), observation_rate=10, median_network_time_gap=7
    )


@query
def address_edges(spark, sf):
    return parts.address_pairs(parts.participation(star_case(spark, sf)), with_tx=True)


@query
def exact_links(spark, sf):
    return correlate.exact_links(star_case(spark, sf))


@query
def temporal_links(spark, sf):
    return correlate.temporal_links(star_case(spark, sf))


@query
def propagation_latency(spark, sf):
    return correlate.propagation_latency(star_case(spark, sf))


@query
def correlation_status(spark, sf):
    return correlate.correlation_status(star_case(spark, sf), allow_temporal=True)


@query
def relay_latency(spark, sf):
    return correlate.relay_latency(star_case(spark, sf))


@query
def relay_bursts(spark, sf):
    return correlate.relay_bursts(star_case(spark, sf))


# --- mapping, validation, normalisation and the text sources


def _checked(raw: DataFrame) -> DataFrame:
    return records.validate(records.map_columns(raw))


@query
def validate_issues(spark, sf):
    rows = records.issue_rows(_checked(dirty_records(spark, sf)))
    said = F.when(F.col("code") == "MONETARY_DISCREPANCY", "").otherwise(F.col("message"))
    return rows.withColumn("message", said)


@query
def validate_counters(spark, sf):
    return records.counters(_checked(dirty_records(spark, sf)))


def _clean(checked: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return records.normalize(checked).where("is_transaction").select(
        "record_id",
        "txid",
        F.unix_seconds("timestamp").alias("timestamp_epoch"),
        "fee",
        F.concat_ws("+", "input_addresses").alias("input_addresses"),
        total(F.col("input_amounts")).alias("total_input"),
        F.concat_ws("+", "output_addresses").alias("output_addresses"),
        total(F.col("output_amounts")).alias("total_output"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "geo_country",
        "asn",
    )


@query
def normalize_records(spark, sf):
    return _clean(_checked(dirty_records(spark, sf)))


@query
def source_csv(spark, sf):
    path = work_path(spark, "csv")
    dirty_records(spark, sf).write.option("escape", '"').csv(path, header=True, emptyValue="")
    return _clean(records.validate(readers.read_records(spark, path, "csv")))


@query
def source_json(spark, sf):
    path = work_path(spark, "ndjson")
    raw = dirty_records(spark, sf)
    bare = F.translate("senders", '[]" ', "")
    raw.withColumn("senders", F.split(bare, "[|;,]")).write.json(path)
    return _clean(records.validate(readers.read_records(spark, path, "ndjson")))


@query
def source_json_wrapped(spark, sf):
    """A folder of one-document files, each {"records": [...]} with one record."""
    path = work_path(spark, "json")
    dirty_records(spark, sf).select(F.array(F.struct("*")).alias("records")).write.json(path)
    return _clean(records.validate(readers.read_records(spark, path, "json")))


@query
def source_xml(spark, sf):
    path = work_path(spark, "xml")
    dirty_records(spark, sf).write.option("rootTag", "records").option("rowTag", "record").xml(path)
    return _clean(records.validate(readers.read_records(spark, path, "xml")))


def _documents(rows, path: str, make, rows_each: int = 2000) -> str:
    """Writes one text file a bucket of rows, made by ``make`` from the bucket's list; six files at least."""
    documents = max(6, -(-rows.count() // rows_each))
    held = rows.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(documents)).cast("int"))
    grouped = held.groupBy("bucket").agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    grouped.select("bucket", make(F.col("rows")).alias("value")).repartition(documents, "bucket").write.partitionBy("bucket").text(path)
    return path


@query
def source_json_document(spark, sf):
    """Files of one document over many lines: arrays with items that are no objects, and both wrappers."""

    def make(rows):
        pretty = {"pretty": "true"}
        listed = F.concat(F.lit("[1,\n"), F.substring(F.to_json(rows, pretty), 2, 1 << 30))
        boxed = F.to_json(F.struct(rows.alias("records")), pretty)
        return F.when(F.col("bucket") % 3 == 0, listed).when(F.col("bucket") % 3 == 1, boxed).otherwise(
            F.to_json(F.struct(rows.alias("data")), pretty)
        )

    path = _documents(dirty_records(spark, sf), work_path(spark, "json-documents"), make)
    return _clean(records.validate(readers.read_records(spark, path, "json")))


@query
def source_ndjson_broken(spark, sf):
    """Lines that are no objects, the first of a file among them, beside good ones."""
    rows = dirty_records(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    spoilt = F.when(F.crc32("record_id") % 50 == 0, F.concat(F.lit('{"cut": \n["no object"]\n'), line)).otherwise(line)
    path = work_path(spark, "ndjson-broken")
    rows.select(F.crc32("record_id").alias("at"), spoilt.alias("value")).orderBy(F.col("at") % 50, "at").select("value").write.text(path)
    return _clean(records.validate(readers.read_records(spark, path, "ndjson")))


@query
def source_xml_mixed(spark, sf):
    """Records of two tags side by side under one root."""

    def make(rows):
        tagged = lambda r, tag: F.to_xml(r, {"rowTag": tag})
        each = F.transform(rows, lambda r, i: F.when(i % 2 == 0, tagged(r, "transaction")).otherwise(tagged(r, "observation")))
        return F.concat(F.lit("<dataset>\n"), F.array_join(each, "\n"), F.lit("\n</dataset>"))

    path = _documents(dirty_records(spark, sf), work_path(spark, "xml-mixed"), make)
    return _clean(records.validate(readers.read_records(spark, path, "xml")))


@query
def source_folder(spark, sf):
    """One folder with CSV files of two layouts, lines of JSON and XML, read together."""
    rows = dirty_records(spark, sf).withColumn("_kind", F.crc32("record_id") % 4)
    folder = work_path(spark, "mixed-folder")
    part = lambda k: rows.where(F.col("_kind") == k).drop("_kind")
    part(0).write.option("escape", '"').csv(f"{folder}/a", header=True, emptyValue="")
    turned = part(1).select(*reversed(part(1).columns))
    turned.write.option("escape", '"').option("sep", "\t").csv(f"{folder}/b", header=True, emptyValue="")
    part(2).write.json(f"{folder}/c")
    part(3).write.option("rootTag", "records").option("rowTag", "record").xml(f"{folder}/d")
    return _clean(readers.read_folder(spark, folder))


@query
def records_to_case(spark, sf):
    case = records.to_case(records.normalize(_checked(dirty_records(spark, sf))))
    ins = case.inputs.select("txid", F.lit("in").alias("side"), F.col("input_index").alias("position"), "address", "amount")
    outs = case.outputs.select("txid", F.lit("out").alias("side"), F.col("output_index").alias("position"), "address", "amount")
    return ins.unionByName(outs)


# --- the four case files


def _raw_case(case):
    """The case as it might be delivered: text columns, some of them wrong."""
    key = F.substring("txid", 4, 20).cast("long")
    transactions = case.transactions.select(
        F.when(key % 10 == 9, F.concat(F.lit("zz_"), key)).otherwise(F.col("txid")).alias("txid"),
        F.when(key % 1000 == 6, "bad").otherwise(F.col("timestamp_epoch").cast("string")).alias("timestamp"),
        F.when(key % 1000 == 5, -1.0).otherwise(F.col("fee")).cast("string").alias("fee"),
        F.col("size").cast("string").alias("size"),
    )
    amount = F.when(key % 1000 == 7, "n/a").otherwise(F.col("amount").cast("string"))
    return {
        "transactions": transactions,
        "inputs": case.inputs.withColumn("amount", amount),
        "outputs": case.outputs,
        "network": case.network,
    }


@query
def case_findings(spark, sf):
    found = case_files.case_findings(_raw_case(star_case(spark, sf)), spark)
    return found.withColumnRenamed("column", "column_name")


@query
def case_row_counts(spark, sf):
    case = star_case(spark, sf)
    return case_files.row_counts(
        {"transactions": case.transactions, "inputs": case.inputs, "outputs": case.outputs, "network": case.network}
    )


@query
def orphan_flows(spark, sf):
    case = star_case(spark, sf)
    return case_files.orphans(case.inputs.select(F.col("prev_txid").alias("txid")), case.transactions)


@query
def duplicate_ids(spark, sf):
    return case_files.duplicate_ids(star_case(spark, sf).network.where("txid is not null"))


@query
def missing_endpoints(spark, sf):
    case = star_case(spark, sf)
    spends = case.inputs.where("prev_txid is not null").select("prev_txid", "txid")
    nodes = case.outputs.select("txid").distinct()
    return case_files.missing_endpoints(spends, nodes, "prev_txid", "txid", "txid")


@query
def time_inversions(spark, sf):
    return case_files.time_inversions(star_case(spark, sf))


@query
def canonical_transactions(spark, sf):
    case = star_case(spark, sf)
    key = F.substring("txid", 4, 20).cast("long")
    raw = case.transactions.select(
        F.concat(F.lit(" "), F.upper("txid")).alias("txid"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(key % 7 == 3, "n/a").otherwise(half_even("fee", 8).cast("string")).alias("fee"),
        F.col("size").cast("string").alias("size"),
    )
    return case_files.canonical_transactions(raw).drop("timestamp")


@query
def canonical_flows(spark, sf):
    case = star_case(spark, sf)
    ins = case_files.canonical_inputs(case.inputs.withColumn("script_type", F.lit(" P2WPKH")))
    outs = case_files.canonical_outputs(case.outputs)
    none = F.lit(None).cast("string")
    both = ins.select("txid", F.col("input_index").alias("at_index"), "prev_txid", "address", "amount", "script_type").unionByName(
        outs.select("txid", F.col("output_index").alias("at_index"), none.alias("prev_txid"), "address", "amount", "script_type")
    )
    return rounded(both, amount=8)


@query
def canonical_network(spark, sf):
    net = star_case(spark, sf).network
    key = F.substring("record_id", 5, 20).cast("long")
    raw = net.select(
        "txid",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(key % 11 == 5, "n.a.").when(key % 2 == 0, F.concat("src_ip", F.lit(":8333"))).otherwise(F.col("src_ip")).alias("src_ip"),
        F.concat(F.lit(" "), "dst_ip").alias("dst_ip"),
        F.when(key % 13 == 2, "?").otherwise(F.col("src_port").cast("string")).alias("src_port"),
        "dst_port",
        F.lower("asn").alias("asn"),
        F.when(key % 6 == 1, "nan").otherwise(F.lower("geo_country")).alias("country"),
    )
    return case_files.canonical_network(raw).drop("timestamp", "timestamp_iso")


@query
def record_ids(spark, sf):
    case = star_case(spark, sf)
    bare = case.transactions.select("txid", "timestamp_epoch")
    named = readers.synthesize_ids(bare, "tx-rec", ["timestamp_epoch", "txid"], case.tx_rows)
    return named.select("txid", "record_id")


@query
def entity_types(spark, sf):
    case = star_case(spark, sf)
    forms = [
        case.transactions.select("txid"),
        case.transactions.select(F.concat(F.lit("transaction:"), "txid")),
        case.transactions.select(F.sha2("txid", 256)),
        case.outputs.select("address"),
        case.outputs.select(F.concat(F.lit("wallet:"), "address")),
        case.outputs.select(F.concat(F.lit("bc1"), "address")),
        case.network.select("src_ip"),
        case.network.select(F.concat(F.lit("ip:"), "src_ip")),
        case.network.select("asn"),
        case.network.select(F.concat(F.lit("asn:"), "asn")),
        case.network.select(F.concat(F.lit("country:"), "geo_country")),
    ]
    ids = forms[0].toDF("id")
    for form in forms[1:]:
        ids = ids.union(form.toDF("id"))
    return ids.distinct().select("id", text.entity_type(F.col("id")).alias("entity_type"))


# --- entity graph


class Graph:
    """Nodes and edges of a case, written once to the shared folder because many steps read them.

    ``keep=False`` is for queries that read one of them once, ``bare`` for those that ask for ends, types and weights
    of edges and types of nodes only: nothing else is read, shuffled and written.
    """

    def __init__(self, spark, sf, case=None, keep: bool = True, bare: bool = False):
        self.keep, self.bare = keep, bare
        self.case = case or (_stored(star_case(spark, sf)) if keep and not bare else star_case(spark, sf))
        self.part = parts.participation(self.case)
        if bare:
            self.part = graph.bare_participation(self.part)
        self.sightings = graph.edge_sightings(self.case, self.part)
        self._edges = self._nodes = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            found = graph.entity_edges(self.sightings)
            self._edges = materialize(found.select("src", "dst", "type", "weight") if self.bare else found, "edges")
        return self._edges

    @property
    def nodes(self) -> DataFrame:
        if self._nodes is None:
            found = (graph.node_types if self.bare else graph.entity_nodes)(self.case, self.part)
            self._nodes = materialize(found, "nodes") if self.keep else found
        return self._nodes


def _us(name: str, out: str):
    return F.unix_micros(name).alias(out)


@query
def entity_nodes(spark, sf):
    return Graph(spark, sf, keep=False).nodes.select("id", "type", "label")


@query
def ip_attributes(spark, sf):
    return Graph(spark, sf, keep=False).nodes.where("type = 'ip'").select("id", "asn", "country")


@query
def entity_edges(spark, sf):
    edges = graph.entity_edges(Graph(spark, sf, keep=False).sightings)
    out = edges.select("src", "dst", "type", "basis", "weight", "amount", _us("first_seen", "first_us"), _us("last_seen", "last_us"), "records")
    return rounded(out, amount=8)


@query
def edge_sources(spark, sf):
    sources = graph.edge_sources(Graph(spark, sf, keep=False).sightings)
    return sources.groupBy("src", "dst", "type").agg(
        F.count(F.lit(1)).alias("records"), F.min("record_id").alias("first_record")
    )


@query
def graph_summary(spark, sf):
    g = Graph(spark, sf, bare=True)
    return reports.graph_summary(g.nodes, g.edges)


@query
def entity_degrees(spark, sf):
    g = Graph(spark, sf)
    return graph.roles(graph.degree_centrality(graph.degrees(g.edges, g.nodes)))


@query
def graph_hubs(spark, sf):
    g = Graph(spark, sf)
    top = graph.hubs(graph.degrees(g.edges))
    return top.join(g.nodes.select("id", "type"), "id").select("id", "degree", "type")


@query
def entity_components(spark, sf):
    g = Graph(spark, sf, bare=True)
    return walks.component_sizes(walks.components(g.edges, g.nodes))


def _txs(case) -> DataFrame:
    return case.transactions.select(F.col("txid").alias("id"))


@query
def spend_components(spark, sf):
    case = star_case(spark, sf)
    return walks.component_sizes(walks.components(graph.spend_graph(case), _txs(case)))


@query
def short_cycles(spark, sf):
    return graph.short_cycles(features.wallet_members(star_case(spark, sf)))


@query
def wallet_cycles_3(spark, sf):
    found = graph.three_cycles(graph.wallet_graph(parts.participation(star_case(spark, sf))))
    return found.withColumnRenamed("id", "address")


@query
def wallet_cycles_4(spark, sf):
    found = graph.four_cycles(graph.wallet_graph(parts.participation(star_case(spark, sf))))
    return found.withColumnRenamed("id", "address")


@query
def spend_edges(spark, sf):
    return graph.spend_edges(star_case(spark, sf))


@query
def spend_degrees(spark, sf):
    case = star_case(spark, sf)
    return graph.degrees(graph.spend_graph(case), _txs(case))


@query
def wallet_triangles(spark, sf):
    case = star_case(spark, sf)
    return graph.triangles(graph.wallet_graph(parts.participation(case)))


@query
def spend_two_hops(spark, sf):
    return graph.two_hop_counts(graph.spend_graph(star_case(spark, sf)))


@query
def spend_cores(spark, sf):
    case = star_case(spark, sf)
    return walks.core_numbers(graph.spend_graph(case), _txs(case))


@query
def entity_pagerank(spark, sf):
    g = Graph(spark, sf, bare=True)
    return rounded(walks.pagerank(g.edges, g.nodes, max_rounds=8, tolerance=None), pagerank=10)


@query
def entity_communities(spark, sf):
    g = Graph(spark, sf, bare=True)
    return walks.community_table(g.edges, g.nodes).select("community", "id", "community_size", "community_density")


@query
def community_quality(spark, sf):
    """Modularity and conductance of the label-propagation communities of the entity graph."""
    g = Graph(spark, sf, bare=True)
    names, arcs = walks.numbered(g.edges.select("src", "dst"), g.nodes)
    members = materialize(walks.communities(arcs, walks.points(names)), "members")
    quality = walks.named(names, modularity.community_quality(modularity.weighted_pairs(arcs), members), "community")
    return rounded(quality, conductance=9, modularity=9)


@query
def address_tx_edges(spark, sf):
    case = star_case(spark, sf)
    ins, outs = graph.address_tx_edges(case), graph.tx_address_edges(case)
    return ins.select(F.lit("addr_tx").alias("edge"), "address", "txid").unionByName(
        outs.select(F.lit("tx_addr").alias("edge"), "address", "txid")
    )


@query
def originator_edges(spark, sf):
    return graph.originator_edges(star_case(spark, sf))


@query
def snapshot_edges(spark, sf):
    return graph.snapshot_edges(star_case(spark, sf))


@query
def ego_network(spark, sf):
    g = Graph(spark, sf)
    nodes = g.nodes.select("id", "type", "label")
    near, _ = graph.ego_network(g.edges, graph.match_node(nodes, "W1"), 3)
    return near.join(nodes.drop("label"), "id")


@query
def ego_edges(spark, sf):
    g = Graph(spark, sf)
    _, edges = graph.ego_network(g.edges.select("src", "dst", "type"), graph.match_node(g.nodes, "wallet:W1"), 2)
    return edges


@query
def spend_neighbourhood(spark, sf):
    case = star_case(spark, sf)
    near, _ = graph.ego_network(cut(graph.spend_graph(case)), _txs(case).where("id = 'tx_77'"), 5)
    return near


@query
def cospend_clusters(spark, sf):
    case = star_case(spark, sf)
    links = case.inputs.select(F.concat(F.lit("a:"), "address").alias("src"), F.concat(F.lit("t:"), "txid").alias("dst"))
    found = walks.components(links).where("id like 'a:%'")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    return found.join(sizes, "component").select(F.expr("substr(id, 3)").alias("address"), "component", "cluster_size")


def _tx_numbers(case) -> DataFrame:
    deg = graph.degrees(graph.spend_graph(case), _txs(case)).select("id", F.col("in_degree").cast("double").alias("in_degree"))
    return deg.join(case.transactions.select(F.col("txid").alias("id"), "fee", F.col("size").cast("double").alias("size")), "id")


@query
def neighbour_means(spark, sf):
    case = star_case(spark, sf)
    return graph.neighbour_means(graph.spend_graph(case), _tx_numbers(case), ["in_degree", "size"])


@query
def normalised_sums(spark, sf):
    case = star_case(spark, sf)
    return rounded(graph.normalised_sums(graph.spend_graph(case), _tx_numbers(case), ["fee"]), fee=8)


@query
def visible_graph(spark, sf):
    g = Graph(spark, sf)
    _, edges = graph.visible_graph(g.nodes, g.edges, include_ips=False, limit=16000)
    return edges.select("src", "dst", "type")


@query
def find_nodes(spark, sf):
    return graph.find_nodes(Graph(spark, sf, keep=False).nodes, "W17").select("id", "type")


@query
def node_links(spark, sf):
    g = Graph(spark, sf)
    return graph.node_links(g.nodes, g.edges, "wallet:W1")


# --- rules, signals and fusion


def _stored(case):
    """The case with its inputs and outputs written once, for steps that read them several times."""
    return replace(case, inputs=materialize(case.inputs, "inputs"), outputs=materialize(case.outputs, "outputs"))


def _rule_inputs(spark, sf):
    """Case, memberships, wallet features and rule hits, each written once."""
    case = _stored(star_case(spark, sf))
    members = features.wallet_members(case)
    wallets = materialize(_wallets(case, members), "wallets")
    hits = materialize(rules.wallet_rules(wallets, graph.short_cycles(members), rules.peel_transactions(case)), "hits")
    return case, members, wallets, hits


def _wallet_table(case, members: parts.Members | None = None) -> DataFrame:
    return materialize(_wallets(case, members), "wallets")


@query
def wallet_rules(spark, sf):
    return _rule_inputs(spark, sf)[3].drop("description")


@query
def behaviour_scores(spark, sf):
    return rules.behaviour_scores(_rule_inputs(spark, sf)[3])


@query
def transaction_rules(spark, sf):
    return rules.transaction_rules(features.transaction_features(star_case(spark, sf))).drop("description")


@query
def peel_transactions(spark, sf):
    return rounded(rules.peel_transactions(star_case(spark, sf)), small=8, large=8)


@query
def port_anomalies(spark, sf):
    return rules.port_anomalies(star_case(spark, sf).network)


CUSTOM_SCHEMA = (
    "rule_id string, name string, target_entity string, field string, operator string, threshold double, "
    "severity string, weight double, enabled int, case_id string"
)


def _custom_rules(spark) -> DataFrame:
    """Investigator rules as a case would hold them, among them ones that must not fire."""
    table = [
        ("c1", "Wide sender", "wallet", "fan_out", ">=", 12.0, "high", 1.0, 1, None),
        ("c2", "Few partners", "wallet", "unique_counterparties", "<", 30.0, "medium", 0.5, 1, None),
        ("c3", "Busy receiver", "wallet", "incoming_transaction_count", ">", 25.0, "critical", 2.0, 1, "star"),
        ("c4", "No network", "wallet", "connected_ip_count", "==", 0.0, "low", 1.0, 1, "star"),
        ("c5", "Switched off", "wallet", "fan_in", ">", 0.0, "high", 1.0, 0, None),
        ("c6", "Other case", "wallet", "fan_in", ">", 0.0, "high", 1.0, 1, "other"),
        ("c7", "Not evaluable", "wallet", "fan_in", "contains", 1.0, "high", 1.0, 1, None),
        ("t1", "Costly", "transaction", "fee_ratio", ">", 0.15, "high", 1.0, 1, None),
        ("t2", "Odd outputs", "transaction", "output_count", "!=", 4.0, "low", 1.0, 1, None),
    ]
    return rules.usable_rules(spark.createDataFrame(table, CUSTOM_SCHEMA), "star")


@query
def custom_rule_hits(spark, sf):
    hits = rules.custom_rule_hits(_wallets(star_case(spark, sf)), _custom_rules(spark), "wallet")
    return hits.drop("code", "description")


@query
def custom_rule_scores(spark, sf):
    return rules.custom_scores(rules.custom_rule_hits(_wallets(star_case(spark, sf)), _custom_rules(spark), "wallet"))


@query
def custom_transaction_rules(spark, sf):
    keyed = features.transaction_features(star_case(spark, sf)).withColumn("entity_id", F.concat(F.lit("transaction:"), "txid"))
    return rules.custom_rule_hits(keyed, _custom_rules(spark), "transaction").select("entity_id", "rule_id", "observed_value")


@query
def network_signals(spark, sf):
    case = star_case(spark, sf)
    return scoring.network_signals(_wallet_table(case), case.flow_rows)


def _graph_features(g: Graph, members: parts.Members, betweenness: DataFrame | None = None) -> DataFrame:
    """Graph features of every node; without a betweenness table the column is 0."""
    return signals.node_features(g.edges, g.nodes.select("id", "type"), graph.short_cycles(members), betweenness)


@query
def graph_signals(spark, sf):
    case = _stored(star_case(spark, sf))
    g = Graph(spark, sf, case, bare=True)
    members = features.wallet_members(case)
    return scoring.graph_signals(_wallet_table(case, members), _graph_features(g, members), case.flow_rows)


def _alerts(spark, sf, inputs=None) -> DataFrame:
    """Alerts from the streams that need no model: rules and network for wallets, fee anomalies for transactions."""
    case, _, wallets, hits = inputs or _rule_inputs(spark, sf)
    streams = (
        wallets.select("entity_id")
        .join(scoring.network_signals(wallets, case.flow_rows).select("entity_id", "network_score"), "entity_id")
        .join(rules.behaviour_scores(hits), "entity_id", "left")
        .na.fill(0)
    )
    blank = {f"{n}_score": F.lit(0.0) for n in ("anomaly", "graph", "supervised", "rule")}
    fused = scoring.fuse(streams.withColumns(blank))
    tx = features.transaction_features(case)
    cols = ["entity_id", "entity_type", "behavior_score", "network_score", "rule_count", "priority_score", "severity"]
    return (
        fused.withColumn("entity_type", F.lit("wallet")).select(*cols)
        .unionByName(
            alerts.transaction_alerts(rules.transaction_rules(tx))
            .withColumns({"entity_type": F.lit("transaction"), "rule_count": F.lit(1).cast("long")})
            .select(*cols)
        )
    )


@query
def riskiest_wallets(spark, sf):
    return _alerts(spark, sf).where("entity_type = 'wallet'").orderBy(F.desc("priority_score"), "entity_id").limit(100)


@query
def streams_alerts(spark, sf):
    return _alerts(spark, sf)


@query
def tier_counts(spark, sf):
    return alerts.tier_counts(_alerts(spark, sf))


@query
def lead_fusion(spark, sf):
    base = _alerts(spark, sf).where("entity_type = 'wallet'").drop("priority_score", "severity")
    n = F.col("rule_count")
    shaped = base.withColumns(
        {
            "supervised_score": F.when(n > 1, (n % 5) / 4.0),
            "anomaly_score": (n % 3) / 2.0,
            "graph_score": F.lit(0.0),
            "rule_score": n * 10.0,
            "rules": F.array().cast("array<string>"),
        }
    )
    fused = scoring.fuse_leads(shaped)
    flag = F.col("recommendation").contains("Model at or over").cast("int")
    return fused.select("entity_id", "priority_score", "severity", flag.alias("model_flag"))


# --- model package


@query
def transaction_matrix(spark, sf):
    m = matrices.transaction_matrix(star_case(spark, sf))
    width = F.lit(len(m.columns)).cast("long").alias("width")
    named = [c for c in m.columns if not c.startswith(("Local", "Aggregate")) and not c.endswith("_mean")]
    named += ["Local_feature_2", "Local_feature_3", "Local_feature_4", "Local_feature_7"]
    named += [f"Aggregate_feature_{i}" for i in (1, 2, 3, 4, 9)]
    out = m.select(*named, width)
    eight = [c for c in named if "_BTC_" in c and not c.endswith("median")] + ["fees"]
    five = ["Local_feature_2", "Local_feature_3", "Local_feature_7", "Aggregate_feature_9"]
    return rounded(out, **{c: 8 for c in eight}, **{c: 5 for c in five}, in_BTC_median=10, out_BTC_median=10, total_BTC=10)


@query
def wallet_matrix(spark, sf):
    m = matrices.wallet_matrix(star_case(spark, sf))
    kept = ["address", "time_step", "num_txs_as_sender", "num_txs_as receiver", "first_block_appeared_in", "last_block_appeared_in"]
    kept += ["lifetime_in_blocks", "total_txs", "num_timesteps_appeared_in", "btc_transacted_total", "btc_transacted_min", "btc_transacted_max"]
    kept += ["btc_transacted_median", "btc_sent_total", "btc_sent_median", "btc_received_median", "fees_total"]
    kept += [f"blocks_btwn_txs_{s}" for s in ("total", "min", "max", "mean", "median")]
    kept += ["transacted_w_address_max", "transacted_w_address_mean"]
    out = m.select(*[f"`{c}`" for c in kept], F.lit(len(m.columns)).cast("long").alias("width"))
    digits = {c: 8 for c in ("btc_transacted_total", "btc_transacted_min", "btc_transacted_max", "btc_sent_total")}
    return rounded(out, **digits, btc_transacted_median=10, btc_sent_median=10, btc_received_median=10)


@query
def wallet_matrix_documented(spark, sf):
    m = matrices.wallet_matrix(star_case(spark, sf), documented=True)
    kept = ["address", "fees_total", "fees_max", "fees_median", "blocks_btwn_input_txs_total", "blocks_btwn_output_txs_max"]
    kept += ["num_addr_transacted_multiple"] + [f"transacted_w_address_{s}" for s in ("total", "max", "median")]
    return rounded(m.select(*kept), fees_total=11, fees_max=11, fees_median=12)


@query
def network_matrix(spark, sf):
    m = matrices.network_matrix(star_case(spark, sf))
    return rounded(m, input_concentration=9, output_concentration=9, bipartite_entropy=5)


@query
def time_steps(spark, sf):
    return graph.time_steps(star_case(spark, sf))


@query
def package_manifest(spark, sf):
    return matrices.package_manifest(star_case(spark, sf))


@query
def matrix_findings(spark, sf):
    """A damaged network matrix: two columns swapped, one ratio divided by zero."""
    m = matrices.network_matrix(star_case(spark, sf))
    cols = m.columns[:2] + [m.columns[3], m.columns[2]] + m.columns[4:]
    broken = F.when(F.col("num_outputs") == 2, F.lit(float("inf"))).otherwise(F.col("in_out_ratio"))
    return matrices.matrix_findings(m.withColumn("in_out_ratio", broken).select(*cols), "network")


@query
def walk_forward(spark, sf):
    folds = matrices.walk_forward(graph.time_steps(star_case(spark, sf)))
    return folds.groupBy("fold", "part", "time_step").agg(F.count(F.lit(1)).alias("txs"))


@query
def leakage(spark, sf):
    folds = matrices.walk_forward(graph.time_steps(star_case(spark, sf)))
    return matrices.leakage(folds).withColumnRenamed("check", "check_name")


FEW = ["fan_in", "fan_out", "median_time_gap", "dust_incoming_count", "unique_counterparties"]


@query
def feature_quantiles(spark, sf):
    case = star_case(spark, sf)
    return matrices.column_quantiles(_wallet_table(case), FEW, case.flow_rows).drop("iqr")


@query
def top_deviations(spark, sf):
    case = star_case(spark, sf)
    wallets = _wallet_table(case)
    base = matrices.column_quantiles(wallets, FEW, case.flow_rows)
    return iforest.top_deviations(wallets, "entity_id", FEW, base, 3).drop("ordinal", "place")


@query
def imputed_columns(spark, sf):
    case = star_case(spark, sf)
    w = _wallet_table(case).select("entity_id", "fan_in", "fan_out")
    holes = w.withColumns(
        {
            "fan_in": F.when(F.col("fan_in") % 7 != 3, F.col("fan_in").cast("double")),
            "fan_out": F.when(F.col("fan_out") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("fan_out").cast("double")),
        }
    )
    return matrices.impute(holes, ["fan_in", "fan_out"], case.flow_rows)


@query
def standardized_columns(spark, sf):
    tx = features.transaction_features(star_case(spark, sf))
    kept = tx.select("txid", "timestamp", "input_count", "output_count")
    early = F.unix_seconds("timestamp") < 1_705_000_000
    out = matrices.standardize(kept, ["input_count", "output_count"], early).drop("timestamp")
    return rounded(out, input_count=7, output_count=7)


@query
def static_means(spark, sf):
    case = star_case(spark, sf)
    shape = matrices.network_matrix(case).select("txid", "num_outputs", "num_inputs")
    rows = case.inputs.select("address", "txid").join(shape, "txid")
    wallets = parts.participation(case).select("address").distinct()
    return matrices.static_means(rows, wallets, ["num_outputs", "num_inputs"])


@query
def time_encoding(spark, sf):
    out = graph.time_encoding(star_case(spark, sf).network.select("record_id", "src_port"), "src_port").drop("src_port")
    return rounded(out, **{c: 6 for c in out.columns if c != "record_id"})


# --- anomaly detection, supervised stages, evaluation


@query
def anomaly_scores(spark, sf):
    """Isolation forest over wallet features; no SQL counterpart."""
    case = star_case(spark, sf)
    wallets = _wallet_table(case)
    columns = signals.WALLET_ANOMALY_COLUMNS
    filled = materialize(matrices.impute(wallets.select("entity_id", *columns), columns, case.flow_rows), "matrix")
    return iforest.anomaly_scores(filled, "entity_id", columns, rows=case.flow_rows)


def _out_of_fold(spark, sf) -> DataFrame:
    """Forest probabilities of three domains by walk-forward folds of days.

    The label is no feature: whether the next transaction of one of the payers pays an unusual fee.
    """
    case = star_case(spark, sf)
    tx = materialize(matrices.transaction_matrix(case), "tx_matrix")
    net = materialize(matrices.network_matrix(case), "net_matrix")
    wallet = matrices.wallet_matrix(case)
    feats = features.transaction_features(case).select(
        "txid", F.unix_seconds("timestamp").alias("timestamp_epoch"), (F.col("fee_ratio") >= 0.15).alias("odd")
    )
    paid = case.inputs.select("txid", "address").distinct().join(feats, "txid")
    following = Window.partitionBy("address").orderBy("timestamp_epoch", "txid")
    label = F.max(F.coalesce(F.col("next_odd"), F.lit(False)).cast("double"))
    labels = materialize(
        paid.withColumn("next_odd", F.lead("odd").over(following)).groupBy("txid").agg(label.alias("label")), "labels"
    )
    senders = case.inputs.select("txid", "address").distinct()
    wallet_rows = materialize(senders.join(wallet.drop("time_step"), "address"), "wallet_rows")
    folds = materialize(matrices.walk_forward(graph.time_steps(case, 24)), "folds")
    domains = {
        "rf_tx": (tx, schema.transaction_columns()),
        "rf_wallet": (wallet_rows, schema.wallet_columns()),
        "rf_network": (net, schema.network_columns()),
    }
    return materialize(supervised.out_of_fold(domains, folds, labels, 10), "out-of-fold")


@query
def supervised_scores(spark, sf):
    """Three domain forests on earlier days, and a stack fitted on the folds before, per transaction."""
    return supervised.stacked_forward(_out_of_fold(spark, sf), ["rf_tx", "rf_wallet", "rf_network"])


def _scored(spark, sf) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.select(
        F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("y"), (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("score")
    )


@query
def confusion(spark, sf):
    return evaluate.confusion(_scored(spark, sf), threshold=0.675)


@query
def model_areas(spark, sf):
    return rounded(evaluate.areas(_scored(spark, sf)), roc_auc=9, pr_auc=9)


@query
def precision_at_k(spark, sf):
    return evaluate.at_k(_scored(spark, sf), (10, 50, 100))


@query
def best_threshold(spark, sf):
    return evaluate.best_threshold(_scored(spark, sf))


@query
def calibration(spark, sf):
    return rounded(evaluate.calibration(_scored(spark, sf)), brier=9, ece=9)


@query
def tier_table(spark, sf):
    return evaluate.tier_table(_scored(spark, sf), scoring.severity(F.col("score") * 100, "calibration"))


@query
def unique_catches(spark, sf):
    scored = _scored(spark, sf)
    flagged = scored.where(((F.col("id") * 104729) % 1000) >= 500)
    return evaluate.unique_catches(scored.withColumnRenamed("score", "anomaly_score"), flagged, 100).select("id", "anomaly_score")


@query
def detection_recall(spark, sf):
    """Fee-anomaly alerts against transactions whose fee was set high when the case was made."""
    case = star_case(spark, sf)
    found = rules.transaction_rules(features.transaction_features(case)).select("entity_id")
    key = F.substring("txid", 4, 20).cast("long")
    planted = case.transactions.where(key % 100 >= 80).select(
        F.concat(F.lit("transaction:"), "txid").alias("entity_id"), F.lit("transaction").alias("kind")
    )
    return evaluate.detection(found, planted)


# --- investigation


@query
def wallet_profiles(spark, sf):
    inputs = _rule_inputs(spark, sf)
    return investigate.wallet_profiles(inputs[2], _runs(_alerts(spark, sf, inputs)))


def _runs(found: DataFrame) -> DataFrame:
    """The same alerts under two runs, the second scored a little lower."""
    found = materialize(found, "found")
    first = found.withColumn("run_id", F.lit("run-1"))
    second = found.withColumns({"run_id": F.lit("run-2"), "priority_score": F.col("priority_score") - 1.0})
    return first.unionByName(second)


def _run_table(spark) -> DataFrame:
    rows = [("run-1", "star", 1), ("run-2", "star", 2)]
    return spark.createDataFrame(rows, "run_id string, case_id string, created_at int")


@query
def selected_alerts(spark, sf):
    found = investigate.select_alerts(_runs(_alerts(spark, sf)), _run_table(spark), severity="high", min_score=66.0, entity_type="transaction")
    return found.select("entity_id", "run_id", "priority_score")


@query
def alert_page(spark, sf):
    kept = investigate.select_alerts(_runs(_alerts(spark, sf)), _run_table(spark))
    return investigate.page(kept, 3, 25).select("entity_id", "priority_score", "total")


@query
def replaced_run(spark, sf):
    """Two runs written, the second rewritten with fewer rows; the first stays."""
    path = work_path(spark, "alerts")
    found = materialize(_alerts(spark, sf), "found")
    tables_io.replace_partition(_runs(found), path)
    again = found.where("entity_type = 'transaction'").withColumn("run_id", F.lit("run-2"))
    tables_io.replace_partition(again, path)
    back = tables_io.read_table(spark, path)
    return back.groupBy("run_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query
def sorted_table(spark, sf):
    """Transactions laid out by time, read back: order within and between files, and a day's rows from the files that hold it."""
    txs = star_case(spark, sf).transactions
    path = work_path(spark, "sorted-transactions")
    tables_io.write_sorted(txs, path, ["timestamp", "txid"], 1000)
    back = spark.read.parquet(path).select("timestamp", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    turned = back.withColumn("ahead", F.lag("timestamp").over(Window.partitionBy("file").orderBy("at"))).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ahead") > F.col("timestamp")).alias("out_of_order")
    )
    ranges = spark.read.parquet(f"{path}.ranges")
    crossed = ranges.withColumn("ahead", F.max("highest").over(Window.orderBy("lowest", "highest").rowsBetween(Window.unboundedPreceding, -1)))
    files = crossed.agg(
        F.count_if(F.col("ahead") > F.col("lowest")).alias("overlapping_files"), F.sum("rows").alias("listed"), F.count(F.lit(1)).alias("files"),
        F.min("lowest").alias("start"),
    )
    start = files.first()["start"]
    low, high = F.lit(start) + F.expr("interval 1 day"), F.lit(start) + F.expr("interval 2 days")
    day = tables_io.read_range(spark, path, "timestamp", low, high)
    found = day.agg(F.count(F.lit(1)).alias("rows_in_range"))
    read = len(day.inputFiles())
    facts = turned.join(files, F.lit(True)).join(found, F.lit(True)).select(
        F.inline(
            F.array(
                *(F.struct(F.lit(n).alias("item"), v.cast("long").alias("value")) for n, v in (
                    ("rows", F.col("rows")), ("out_of_order", F.col("out_of_order")), ("overlapping_files", F.col("overlapping_files")),
                    ("unlisted_rows", F.col("rows") - F.col("listed")), ("skips_files", (F.lit(read) < F.col("files")).cast("int")),
                    ("rows_in_range", F.col("rows_in_range")),
                ))
            )
        )
    )
    return facts


@query
def flagged_nodes(spark, sf):
    g = Graph(spark, sf)
    hits = rules.transaction_rules(features.transaction_features(g.case))
    return graph.flagged_nodes(g.nodes, hits).select("id", "type")


@query
def wallet_transactions(spark, sf):
    out = investigate.wallet_transactions(star_case(spark, sf))
    return rounded(out.withColumn("timestamp", F.unix_seconds("timestamp")), fee=8)


@query
def wallet_observations(spark, sf):
    out = investigate.wallet_observations(star_case(spark, sf), "W1")
    return out.withColumn("timestamp", F.unix_micros("timestamp"))


@query
def transaction_inspector(spark, sf):
    out = investigate.inspect_transactions(star_case(spark, sf))
    ips = F.transform("relays", lambda r: r["src_ip"])
    shown = out.select(
        "txid",
        F.concat_ws(",", "input_addresses").alias("inputs"),
        F.concat_ws(",", "output_addresses").alias("outputs"),
        "total_input",
        "total_output",
        F.concat_ws(",", ips).alias("relays"),
    )
    return rounded(shown, total_input=8, total_output=8)


@query
def ip_inspector(spark, sf):
    out = investigate.inspect_ips(star_case(spark, sf))
    ports = F.transform("ports", lambda p: p.cast("string"))
    return out.withColumns({"sample_txids": F.concat_ws(",", "sample_txids"), "ports": F.concat_ws(",", ports)})


@query
def located_network(spark, sf):
    """Observations whose country was lost, located from ranges made of the nation table."""
    case = star_case(spark, sf)
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    base = (10 << 24) + F.col("n_nationkey").cast("long") * 8
    ranges = nation.select(
        base.alias("start"), (base + 5).alias("end"), F.col("n_name").alias("country"), F.concat(F.lit("AS"), F.col("n_nationkey")).alias("asn")
    )
    key = F.substring("record_id", 5, 20).cast("long")
    bare = case.network.withColumn("geo_country", F.when(key % 3 != 0, F.col("geo_country")))
    return geo.locate(bare, ranges).select("record_id", "src_ip", "geo_country", "asn")


def _evidence(spark, sf):
    case, _, wallets, hits = _rule_inputs(spark, sf)
    base = matrices.column_quantiles(wallets, FEW, case.flow_rows)
    devs = iforest.top_deviations(wallets, "entity_id", FEW, base, 5)
    return case, wallets, hits, devs


@query
def evidence_items(spark, sf):
    case, wallets, hits, devs = _evidence(spark, sf)
    items = alerts.evidence_items(wallets, hits, devs, features.first_sources(features.wallet_sources(case)))
    return items.select("entity_id", "class", "feature", "value", F.size("source_record_ids").cast("long").alias("cited"))


@query
def alert_reasons(spark, sf):
    case, wallets, hits, devs = _evidence(spark, sf)
    net = scoring.network_signals(wallets, case.flow_rows)
    fused = alerts.wallet_alerts(wallets, rules.behaviour_scores(hits), network_scores=net)
    items = alerts.evidence_items(wallets, hits, devs, features.first_sources(features.wallet_sources(case)))
    rows = alerts.reason_rows(fused, hits, devs, items)
    seen = investigate.reason_view(rows)
    return seen.select("entity_id", "rule_code", "headline", "reason_id", F.size("source_evidence_ids").cast("long").alias("cited"))


@query
def full_alerts(spark, sf):
    """Wallet alerts fused from the rule, graph, network and investigator streams."""
    case, members, wallets, hits = _rule_inputs(spark, sf)
    g = Graph(spark, sf, case, bare=True)
    custom = rules.custom_scores(rules.custom_rule_hits(wallets, _custom_rules(spark), "wallet"))
    signal = scoring.graph_signals(wallets, _graph_features(g, members), case.flow_rows)
    net = scoring.network_signals(wallets, case.flow_rows)
    fused = alerts.wallet_alerts(wallets, rules.behaviour_scores(hits), signal, net, custom=custom)
    return fused.drop("wallet_address", "supervised_score", "unsupervised_score", "anomaly_score", "source_record_count")


@query
def alert_narratives(spark, sf):
    """Explained alerts with packs; a count of what each cites."""
    case, wallets, hits, devs = _evidence(spark, sf)
    fused = alerts.wallet_alerts(wallets, rules.behaviour_scores(hits))
    packs = alerts.evidence_packs(
        alerts.evidence_items(wallets, hits, devs, features.first_sources(features.wallet_sources(case)))
    )
    told = alerts.explained(fused, alerts.reason_rows(fused, hits, devs))
    seen = investigate.evidence_view(told, packs, features.wallet_sources(case))
    return seen.select(
        "entity_id", "summary_text", F.size("evidence_pack").cast("long").alias("items"), "evidence_coverage",
        F.size("source_records").cast("long").alias("records"),
    )


@query
def feedback_counts(spark, sf):
    found = materialize(_alerts(spark, sf), "found")
    label = F.element_at(F.array(F.lit("relevant"), F.lit("benign"), F.lit("needs_review")), (F.length("entity_id") % 3 + 1).cast("int"))
    return investigate.feedback_counts(found.select("entity_id", label.alias("label")), found)


@query
def upserted_nodes(spark, sf):
    """Transaction nodes of an earlier load merged with a later one that changes a third of them."""
    case = star_case(spark, sf)
    key = F.substring("txid", 4, 20).cast("long")
    old = case.transactions.select(F.lit("star").alias("case_id"), "txid", "size", F.lit("old").alias("source"))
    new = case.transactions.where(key % 3 == 0).select(
        F.lit("star").alias("case_id"), "txid", (F.col("size") + 1).alias("size"), F.lit("new").alias("source")
    )
    return tables_io.upsert(old, new, ["case_id", "txid"])


@query
def graph_export(spark, sf):
    g = Graph(spark, sf)
    path = work_path(spark, "graph")
    reports.export_graph(g.nodes, g.edges, reports.graph_summary(g.nodes, g.edges), path)
    back = spark.read.json(f"{path}/edges")
    return rounded(back.select("id", "source", "target", "type", "basis", "weight", "amount"), amount=8)


@query
def package_written(spark, sf):
    case = star_case(spark, sf)
    path = work_path(spark, "package")
    reports.write_package(case, path)
    names = ("transaction/features", "transaction/edgelist", "wallet/features", "network/features", "network/edgelist")
    sizes = {n: tables_io.read_table(spark, f"{path}/{n}") for n in names}
    return case_files.row_counts(sizes)


@query
def content_hashes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


@query
def altered_artifacts(spark, sf):
    """Fingerprints of written artifacts against a record in which one in seven was changed."""
    path = work_path(spark, "artifacts")
    events = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.col("n_name").alias("value"))
    events.write.partitionBy("n_nationkey").text(path)
    now = tables_io.fingerprints(spark, path)
    key = F.regexp_extract("relative_path", "n_nationkey=([0-9]+)", 1).cast("long")
    then = now.withColumn("sha256", F.when(key % 7 == 3, F.lit("changed")).otherwise(F.upper("sha256")))
    return tables_io.altered(then, now).select(key.alias("n_nationkey"))


@query
def report_lines(spark, sf):
    """Markdown report of the rule-based alerts."""
    case, wallets, hits, devs = _evidence(spark, sf)
    g = Graph(spark, sf, case, bare=True)
    fused = alerts.wallet_alerts(wallets, rules.behaviour_scores(hits), network_scores=scoring.network_signals(wallets, case.flow_rows))
    packs = alerts.evidence_packs(
        alerts.evidence_items(wallets, hits, devs, features.first_sources(features.wallet_sources(case)))
    )
    told = alerts.explained(fused, alerts.reason_rows(fused, hits, devs)).join(packs, "entity_id", "left")
    summary = materialize(reports.graph_summary(g.nodes, g.edges), "summary")
    return reports.markdown_lines(materialize(told, "told"), summary, "star", "run-1")


# --- dictionary features


@query
def telemetry_features(spark, sf):
    return rounded(dictionary.telemetry_features(star_case(spark, sf)), originator_relay_burst_score=9)


@query
def observation_gaps(spark, sf):
    return dictionary.observation_gaps(star_case(spark, sf))


@query
def arrival_features(spark, sf):
    case = star_case(spark, sf)
    visits = parts.memberships(parts.participation(case)).select("address", F.unix_micros("timestamp").alias("at"))
    out = dictionary.arrival_features(visits, case.flow_rows)
    return rounded(out, inter_arrival_time_std=3)


@query
def peeling_depth(spark, sf):
    return dictionary.peeling_depth(star_case(spark, sf))


@query
def local_structure(spark, sf):
    return dictionary.local_structure(graph.wallet_graph(parts.participation(star_case(spark, sf))))


@query
def weighted_degrees(spark, sf):
    out = dictionary.weighted_degrees(Graph(spark, sf).edges.where("amount is not null"))
    return rounded(out, weighted_in=8, weighted_out=8, weighted_total=8)


@query
def wallet_timeline(spark, sf):
    return dictionary.wallet_timeline(star_case(spark, sf))


@query
def investigation_table(spark, sf):
    """The 17 investigation columns; betweenness and full PageRank have no short SQL."""
    case = star_case(spark, sf)
    part = materialize(parts.participation(case), "participation")
    wallet_edges = materialize(graph.wallet_graph(part), "wallet_edges")
    wallets = part.select(F.col("address").alias("id")).distinct()
    return signals.investigation_table("star", materialize(graph.spend_graph(case), "spends"), _txs(case), wallet_edges, wallets, pivots=8)


@query
def betweenness(spark, sf):
    """Entity-graph betweenness over the shortest paths from all nodes; no SQL counterpart."""
    g = Graph(spark, sf, bare=True)
    return walks.betweenness(g.edges, g.nodes, k=None)


@query
def weak_points(spark, sf):
    """Edges and nodes whose loss splits the entity graph."""
    names, arcs = walks.numbered(Graph(spark, sf, bare=True).edges.select("src", "dst"))
    blocks = materialize(trees.biconnected(arcs), "blocks")
    cuts = walks.named(names, trees.cut_nodes(blocks)).select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit("").alias("target"))
    ends = walks.named(names, walks.named(names, trees.bridges(blocks), "source"), "target")
    return ends.select(F.lit("edge").alias("kind"), "source", "target").unionByName(cuts)


@query
def flow_paths(spark, sf):
    case = star_case(spark, sf)
    return walks.flow_paths(materialize(graph.wallet_graph(parts.participation(case)), "wallet_edges"), "W1", "W170", 4)


# --- streaming


def _stream(spark, sf, table: str) -> DataFrame:
    static = spark.read.parquet(f"{sf}/{table}.parquet")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _stream_network(spark, sf) -> DataFrame:
    e = _stream(spark, sf, "events")
    return e.select(
        F.concat(F.lit("net_"), F.col("event_id")).alias("record_id"),
        F.concat(F.lit("ip_"), F.col("user_id")).alias("src_ip"),
        F.concat(F.lit("tx_"), F.col("event_id") % 50).alias("txid"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def _closing_network(spark, sf) -> DataFrame:
    """The observations as a stream of several files, then one far later: it moves the watermark past every window
    of theirs, and its own window stays open and is never given out."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(
        F.concat(F.lit("net_"), F.col("event_id")).alias("record_id"),
        F.concat(F.lit("ip_"), F.col("user_id")).alias("src_ip"),
        F.concat(F.lit("tx_"), F.col("event_id") % 50).alias("txid"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    path = work_path(spark, "arrivals")
    rows.repartition(4, "record_id").write.parquet(path)
    far = rows.agg((F.max("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("timestamp"))
    closing = far.select(F.lit("end").alias("record_id"), F.lit("end").alias("src_ip"), F.lit("end").alias("txid"), "timestamp")
    closing.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query
def stream_relay_windows(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = work_path(spark, "relays")
    jobs.drain(jobs.relay_windows(_closing_network(spark, sf)), path, work_path(spark, "cp"))
    return spark.read.parquet(path).select("txid", "window_start", "observations")


@query
def stream_wallet_bursts(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = work_path(spark, "bursts")
    visits = _closing_network(spark, sf).select(F.col("src_ip").alias("address"), "timestamp")
    jobs.drain(jobs.wallet_bursts(visits, "1 hour", "30 minutes", "0 seconds"), path, work_path(spark, "cp"))
    return spark.read.parquet(path)


@query
def stream_ingest(spark, sf):
    """Records arriving as a stream, split into accepted and rejected."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = work_path(spark, "raw")
    rows = dirty_records(spark, sf)
    rows.write.json(raw)
    good, bad = work_path(spark, "accepted"), work_path(spark, "rejected")
    live = spark.readStream.schema(rows.schema).json(raw)
    jobs.ingest(live, good, bad, work_path(spark, "cp")).awaitTermination()
    return case_files.row_counts({"accepted": spark.read.parquet(good), "rejected": spark.read.parquet(bad)})


@query
def stream_links(spark, sf):
    """Observations joined to transactions of the same id seen within an hour, both as streams."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o = _stream(spark, sf, "orders")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("o_orderkey") * 7919, F.lit(2_592_000)))
    txs = o.select(
        F.concat(F.lit("tx_"), F.col("o_orderkey") % 50).alias("txid"), at.alias("timestamp"),
        F.concat(F.lit("rec_"), F.col("o_orderkey")).alias("record_id"),
    )
    net = _stream_network(spark, sf).withColumn("dst_ip", F.lit("0.0.0.0"))
    path = work_path(spark, "links")
    jobs.drain(jobs.correlate(txs, net, 3600, "40 days"), path, work_path(spark, "cp"))
    return spark.read.parquet(path)
