"""The analysis run: every stage of a case as tables, from correlation to explained alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.operators import (
    alerts,
    correlate,
    entity_graph as graph,
    features,
    geo,
    graph_walks as walks,
    isolation_forest as forest,
    matrices,
    rules,
    scoring,
    signals,
)
from ledgerscope.operators.participation import participation
from ledgerscope.session import materialize
from ledgerscope.sources import reports
from ledgerscope.sources.tables import replace_partition, write_table


@dataclass(frozen=True)
class RunConfig:
    """Which stages run, and how. A stage switched off leaves its score at 0."""

    case_id: str = "case"
    run_id: str = "run"
    allow_temporal: bool = False
    window_seconds: int = 30
    anomaly: bool = True
    trees: int = 300
    seed: int = 42
    graph: bool = True
    network: bool = True
    pivots: int = 16
    rank_rounds: int = 200
    thresholds: rules.Thresholds = field(default_factory=rules.Thresholds)


def run_case(
    case: Case,
    config: RunConfig = RunConfig(),
    ranges: DataFrame | None = None,
    custom_rules: DataFrame | None = None,
    supervised: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of the run by name. Tables read by several stages are written to the shared folder once."""
    if ranges is not None:
        case = Case(case.transactions, case.inputs, case.outputs, geo.locate(case.network, ranges), case.bounds)
    part = materialize(participation(case), "participation")
    members = features.wallet_members(case)
    wallets = materialize(features.wallet_features(case, members=members), "wallets")
    tx = features.transaction_features(case)
    sources = features.wallet_sources(case)
    cited = features.first_sources(sources)
    cycles = graph.short_cycles(members)

    sightings = graph.edge_sightings(case, part, config.allow_temporal, config.window_seconds)
    edges = materialize(graph.entity_edges(sightings), "edges")
    nodes = graph.entity_nodes(case, part)
    ids = nodes.select("id", "type")

    node_table = graph_scores = network_scores = anomaly = deviations = None
    if config.graph or config.anomaly:
        between = walks.betweenness(edges, ids, config.pivots)
        ranks = walks.pagerank(edges, ids, max_rounds=config.rank_rounds)
        node_table = materialize(signals.node_features(edges, ids, cycles, between, ranks), "node_features")
    if config.graph:
        graph_scores = scoring.graph_signals(wallets, node_table, case.flow_rows)
    if config.network:
        network_scores = scoring.network_signals(wallets, case.flow_rows)
    if config.anomaly:
        columns = signals.WALLET_ANOMALY_COLUMNS + signals.GRAPH_ANOMALY_COLUMNS
        matrix = materialize(matrices.impute(signals.anomaly_matrix(wallets, node_table), columns, case.flow_rows), "matrix")
        anomaly = forest.anomaly_scores(matrix, "entity_id", columns, config.trees, 256, config.seed, case.flow_rows)
        baselines = matrices.column_quantiles(matrix, columns, case.flow_rows)
        deviations = materialize(forest.top_deviations(matrix, "entity_id", columns, baselines), "deviations")
    else:
        deviations = case.spark.createDataFrame(
            [], "entity_id string, feature string, value double, baseline double, deviation double, ordinal int, place int"
        )

    hits = materialize(rules.wallet_rules(wallets, cycles, rules.peel_transactions(case), config.thresholds), "hits")
    behaviour = rules.behaviour_scores(hits)
    custom_hits = custom_scores = None
    all_hits = hits
    if custom_rules is not None:
        usable = rules.usable_rules(custom_rules, config.case_id)
        custom_hits = rules.custom_rule_hits(wallets, usable, "wallet")
        custom_scores = rules.custom_scores(custom_hits)
        all_hits = hits.unionByName(
            custom_hits.select("entity_id", "rule_id", "code", "severity", "observed_value", "threshold", "description"),
            allowMissingColumns=True,
        )

    fused = alerts.wallet_alerts(wallets, behaviour, graph_scores, network_scores, anomaly, supervised, custom_scores)
    items = alerts.evidence_items(wallets, all_hits, deviations, cited)
    packs = alerts.evidence_packs(items)
    reasons = alerts.reason_rows(fused, all_hits, deviations, items)
    explained = alerts.explained(fused, reasons).join(packs, "entity_id", "left").na.fill(0.0, ["evidence_coverage"])
    tx_alerts = alerts.transaction_alerts(rules.transaction_rules(tx, config.thresholds))
    reason = F.struct(
        F.lit("rule").alias("type"), F.col("rule_id").alias("feature"), F.col("observed_value").alias("value"),
        F.col("threshold").alias("baseline"), F.col("unit"), F.col("description").alias("text"),
        F.lit("reason-rule-1").alias("reason_id"), F.array().cast("array<string>").alias("source_evidence_ids"),
    )
    tx_rows = tx_alerts.withColumns(
        {
            "summary_text": F.col("description"),
            "top_reasons": F.array(reason),
            "rule_count": F.lit(1).cast("long"),
            "source_record_count": F.lit(1).cast("long"),
        }
    ).drop("rule_id", "observed_value", "threshold", "unit", "description", "record_id")
    out = {
        "links": correlate.correlation_links(case, config.allow_temporal, config.window_seconds),
        "status": correlate.correlation_status(case, config.allow_temporal, config.window_seconds),
        "nodes": nodes,
        "edges": edges,
        "edge_sources": graph.edge_sources(sightings),
        "transaction_features": tx,
        "wallet_features": wallets,
        "wallet_sources": sources,
        "network_features": features.network_features(case),
        "rule_hits": all_hits,
        "port_anomalies": rules.port_anomalies(case.network),
        "relay_bursts": correlate.relay_bursts(case),
        "evidence": items,
        "reasons": reasons,
        "alerts": materialize(
            explained.unionByName(tx_rows, allowMissingColumns=True).withColumn("run_id", F.lit(config.run_id)), "alerts"
        ),
    }
    if node_table is not None:
        out["graph_features"] = node_table
    return out


# Stage folder of every table of a run.
FOLDERS = {
    "links": "correlated",
    "status": "correlated",
    "nodes": "graph",
    "edges": "graph",
    "edge_sources": "graph",
    "evidence": "reports",
    "reasons": "reports",
    "rule_hits": "reports",
    "port_anomalies": "reports",
    "relay_bursts": "reports",
}


def save_run(tables: dict[str, DataFrame], paths: dict[str, str], config: RunConfig) -> None:
    """Writes a run below its case folder: stage tables, alerts by run, graph, JSON and Markdown reports."""
    for name, df in tables.items():
        if name != "alerts":
            write_table(df, f"{paths[FOLDERS.get(name, 'features')]}/{name}")
    replace_partition(tables["alerts"], f"{paths['reports']}/alerts")
    summary = materialize(reports.graph_summary(tables["nodes"], tables["edges"]), "summary")
    reports.export_graph(tables["nodes"], tables["edges"], summary, f"{paths['graph']}/export")
    reports.json_report(tables["alerts"], summary, f"{paths['reports']}/{config.run_id}_json", config.case_id, config.run_id)
    lines = reports.markdown_lines(tables["alerts"], summary, config.case_id, config.run_id)
    reports.write_markdown(lines, f"{paths['reports']}/{config.run_id}_md")
