"""Correlation, rules, fusion and a whole run on small literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.operators import correlate, rules, scoring
from ledgerscope.plans.case_run import RunConfig, run_case, save_run
from ledgerscope.sources.tables import case_paths

T0 = dt.datetime(2024, 1, 1)
NET = "record_id string, timestamp timestamp, txid string, src_ip string, dst_ip string, src_port int, dst_port int, asn string, geo_country string"
TX = "record_id string, txid string, timestamp timestamp, timestamp_epoch long, fee double, size long, version int, locktime long"
IN = "txid string, input_index int, prev_txid string, prev_vout int, address string, amount double"
OUT = "txid string, output_index int, address string, amount double"


def tx(i, seconds, fee=0.001):
    at = T0 + dt.timedelta(seconds=seconds)
    return (f"rec{i}", f"t{i}", at, int(at.replace(tzinfo=dt.timezone.utc).timestamp()), fee, 200, 1, 0)


def make(spark, txs, ins, outs, net):
    return Case.counted(
        spark.createDataFrame(txs, TX), spark.createDataFrame(ins, IN), spark.createDataFrame(outs, OUT), spark.createDataFrame(net, NET)
    )


def seen(i, seconds, txid, port=8333, ip="10.0.0.1"):
    return (f"n{i}", T0 + dt.timedelta(seconds=seconds), txid, ip, "10.9.9.9", 40000, port, "AS1", "US")


def test_links_and_status(spark):
    txs = [tx(1, 0), tx(2, 100), tx(3, 5000)]
    net = [seen(1, 2, "t1"), seen(2, 115, None), seen(3, 130, None), seen(4, 131, "gone"), seen(5, 70, None)]
    case = make(spark, txs, [("t1", 0, None, None, "A", 1.0)], [("t1", 0, "B", 1.0)], net)
    exact = correlate.exact_links(case).collect()
    assert [(r["txid"], r["time_delta_ms"]) for r in exact] == [("t1", 2000)]
    near = {(r["network_record_id"], r["txid"], r["time_delta_ms"]) for r in correlate.temporal_links(case).collect()}
    assert near == {("n2", "t2", 15000), ("n3", "t2", 30000), ("n5", "t2", 30000)}
    status = {r["txid"]: r["status"] for r in correlate.correlation_status(case, True).collect()}
    assert status == {"t1": "exactly_correlated", "t2": "partially_correlated", "t3": "uncorrelated"}


def test_fusion_and_tiers(spark):
    row = spark.createDataFrame([(0.9, 0.8, 0.5, 0.4)], "anomaly_score double, behavior_score double, graph_score double, network_score double")
    plain = row.withColumns({"supervised_score": F.lit(None).cast("double"), "rule_score": F.lit(0.0)})
    got = scoring.fuse(plain).first()
    assert (got["priority_score"], got["severity"]) == (74.0, "HIGH")
    ruled = scoring.fuse(plain.withColumn("rule_score", F.lit(100.0))).first()
    assert ruled["priority_score"] == pytest.approx(77.9)


def test_custom_rules(spark):
    wallet = spark.createDataFrame([("wallet:A", 12, 3.5)], "entity_id string, fan_out int, total_incoming double")
    table = [
        ("r1", "a", "wallet", "fan_out", ">=", 10.0, "high", 1.0, 1, None),
        ("r2", "b", "wallet", "total_incoming", "<", 5.0, "medium", 2.0, 1, None),
        ("r3", "c", "wallet", "fan_out", "==", 1.0, "critical", 1.0, 1, None),
        ("r4", "d", "wallet", "fan_out", "contains", 1.0, "critical", 1.0, 1, None),
    ]
    schema = "rule_id string, name string, target_entity string, field string, operator string, threshold double, severity string, weight double, enabled int, case_id string"
    hits = rules.custom_rule_hits(wallet, rules.usable_rules(spark.createDataFrame(table, schema)), "wallet")
    assert {r["rule_id"] for r in hits.collect()} == {"r1", "r2"}
    assert rules.custom_scores(hits).first()["rule_score"] == 55.0


def test_whole_run(spark, tmp_path):
    """A fan-out wallet, a peel, a payment circle and a costly transaction are found and reported."""
    txs = [tx(1, 0), tx(2, 600), tx(3, 900), tx(4, 1200), tx(5, 1500, fee=0.9)]
    ins = [
        ("t1", 0, None, None, "FAN", 20.0), ("t2", 0, "t1", 0, "PEEL", 5.0), ("t3", 0, None, None, "LOOP1", 2.0),
        ("t4", 0, "t3", 0, "LOOP2", 2.0), ("t5", 0, None, None, "RICH", 1.0),
    ]
    outs = [("t1", i, f"D{i:02d}", 0.9) for i in range(21)]
    outs += [("t2", 0, "P1", 0.1), ("t2", 1, "P2", 4.8), ("t3", 0, "LOOP2", 1.9), ("t4", 0, "LOOP1", 1.8), ("t5", 0, "R1", 0.1)]
    net = [seen(1, 1, "t1"), seen(2, 2, "t1", ip="10.0.0.2"), seen(3, 3, "t1", ip="10.0.0.3"), seen(4, 601, "t2", port=9999)]
    case = make(spark, txs, ins, outs, net)
    config = RunConfig(case_id="c1", run_id="r1", trees=20)
    tables = run_case(case, config)
    hits = {(r["entity_id"], r["rule_id"]) for r in tables["rule_hits"].collect()}
    assert hits == {
        ("wallet:FAN", "RULE_HIGH_FAN_OUT"), ("wallet:PEEL", "RULE_PEELING_CHAIN"),
        ("wallet:LOOP1", "RULE_SHORT_CYCLE"), ("wallet:LOOP2", "RULE_SHORT_CYCLE"),
    }
    found = {r["entity_id"]: r for r in tables["alerts"].collect()}
    assert len(found) == len({a for _, _, _, _, a, _ in ins} | {o[2] for o in outs}) + 1
    assert found["transaction:t5"]["severity"] == "HIGH"
    assert all(0 <= r["anomaly_score"] <= 1 and 0 <= r["priority_score"] <= 100 for r in found.values())
    assert found["wallet:FAN"]["evidence_pack"][1]["source_record_ids"] == ["rec1"]
    assert {r["txid"] for r in tables["relay_bursts"].collect()} == {"t1"}
    paths = case_paths(str(tmp_path), "c1")
    save_run(tables, paths, config)
    report = "\n".join(r[0] for r in spark.read.text(f"{paths['reports']}/r1_md").collect())
    assert "## 3. High & Critical Priority Entities" in report and "transaction:t5" in report
    assert spark.read.parquet(f"{paths['reports']}/alerts").where("run_id = 'r1'").count() == len(found)
