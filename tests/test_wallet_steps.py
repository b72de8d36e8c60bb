"""Steps that many wallet and graph queries share: what they shuffle, write and look at."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerscope.case import Case
from ledgerscope.functions import ordered
from ledgerscope.operators import entity_graph as graph
from ledgerscope.operators import features, graph_walks as walks, matrices
from ledgerscope.operators.participation import address_pairs, memberships, participation
from ledgerscope.session import cut


def case_of(spark, txs, ins, outs, net=()):
    return Case.counted(
        spark.createDataFrame(txs, "record_id string, txid string, timestamp timestamp, timestamp_epoch long, fee double, size long, version int, locktime long"),
        spark.createDataFrame(ins, "txid string, input_index int, prev_txid string, prev_vout int, address string, amount double"),
        spark.createDataFrame(outs, "txid string, output_index int, address string, amount double"),
        spark.createDataFrame(list(net), "record_id string, timestamp timestamp, txid string, src_ip string, dst_ip string, src_port int, dst_port int, asn string, geo_country string"),
    )


def small_case(spark, records=lambda i: f"r{i}"):
    import datetime

    at = lambda i: datetime.datetime(2024, 1, 1, 0, 0, i % 60)
    txs = [(records(i), f"t{i}", at(i), i, 0.1, 1, 1, 0) for i in range(40)]
    ins = [(f"t{i}", 0, None, 0, f"a{i % 8}", 1.0 + i % 3) for i in range(40)]
    outs = [(f"t{i}", j, f"a{(i + j + 1) % 8}" if j else f"b{i % 5}", 0.00001 if j else 2.0) for i in range(40) for j in range(2)]
    net = [("n1", at(1), "t1", "ip1", "d", 1, 2, "AS1", None), ("n2", at(1), "t1", "ip1", "d", 1, 2, "AS2", "DE")]
    return case_of(spark, txs, ins, outs, net)


def test_small_groups_are_not_sliced_whatever_the_rows(spark, monkeypatch):
    sliced = []
    plain = ordered._slice
    monkeypatch.setattr(ordered, "_slice", lambda df, keys, order: sliced.append(list(keys)) or plain(df, keys, order))
    want = {r["wallet_address"]: r for r in features.wallet_features(small_case(spark)).collect()}
    spark.conf.set("spark.ledgerscope.splitRows", "50")  # fewer than the flows, more than those of any address
    try:
        got = {r["wallet_address"]: r for r in features.wallet_features(small_case(spark)).collect()}
        assert not sliced
        spark.conf.set("spark.ledgerscope.splitRows", "4")
        cuts = {r["wallet_address"]: r for r in features.wallet_features(small_case(spark)).collect()}
        assert sliced
    finally:
        spark.conf.unset("spark.ledgerscope.splitRows")
    assert got == want and cuts == want
    assert want["a1"]["connected_ip_count"] == 1 and want["a1"]["unique_asn_count"] == 2 and want["a1"]["unique_country_count"] == 1


@pytest.mark.parametrize("records, most", [(lambda i: f"r{i}", None), (lambda i: "same", 1), (lambda i: None, 0)])
def test_records_are_counted_once(spark, records, most):
    for r in features.wallet_features(small_case(spark, records)).collect():
        assert r["source_record_count"] == (r["transaction_count"] if most is None else most)


def test_memberships_of_participation_need_no_shuffle_of_their_own(spark):
    case = small_case(spark)
    joined = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert count(memberships(participation(case), with_amounts=True)) == count(participation(case))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)


def test_a_cut_is_a_table_in_columns(spark):
    done = cut(spark.range(10).selectExpr("id", "id % 3 AS k"))
    assert done.inputFiles() and all(f.endswith(".parquet") for f in done.inputFiles())
    assert sorted(r["id"] for r in done.collect()) == list(range(10))


def random_edges(seed, nodes=14, n=60):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_three_cycles_and_triangles_against_all_triples(spark, seed):
    pairs = random_edges(seed)
    e = spark.createDataFrame(pairs, "src string, dst string")
    arcs = {p for p in pairs if p[0] != p[1]}
    ids = {x for p in arcs for x in p}
    turns, flat = Counter(), Counter()
    for t in permutations(sorted(ids), 3):
        closed = {(t[0], t[1]), (t[1], t[2]), (t[2], t[0])} <= arcs
        if closed and t[0] == min(t):
            turns.update(t)
        if t == tuple(sorted(t)) and all((a, b) in arcs or (b, a) in arcs for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))):
            flat.update(t)
    assert {r["id"]: r["cycles"] for r in graph.three_cycles(e).collect()} == turns
    assert {r["id"]: r["triangle_count"] for r in graph.triangles(e).collect()} == flat


def test_ways_over_two_sides_carry_numbers(spark):
    _, sides = graph._numbered_sides(spark.createDataFrame(random_edges(3), "src string, dst string"))
    kinds = dict(graph._closed_wedges(sides, turning=True).dtypes)
    assert kinds["lo"] == kinds["x"] == kinds["y"] == "bigint"


def test_cores_of_a_long_tail(spark):
    """A clique with a path: later rounds look only at what still changes."""
    clique = [(f"c{i}", f"c{j}") for i in range(5) for j in range(i)]
    path = [(f"p{i}", f"p{i + 1}") for i in range(8)] + [("p0", "c0")]
    got = {r["id"]: r["core"] for r in walks.core_numbers(spark.createDataFrame(clique + path, "src string, dst string")).collect()}
    assert got == {f"c{i}": 4 for i in range(5)} | {f"p{i}": 1 for i in range(9)}


def repeated_case(spark):
    """Flows of unknown and null transactions, null addresses and amounts, repeated flows and transactions of two records."""
    import datetime

    rng, at = random.Random(5), datetime.datetime(2024, 1, 1)
    txs = [(f"r{i}", f"t{i}", at, 0, 0.1, 1, 1, 0) for i in range(30)]
    txs += [("r0", "t0", at, 0, 0.1, 1, 1, 0), ("again", "t1", at, 0, 0.1, 1, 1, 0), ("r2", "t2", None, 0, 0.1, 1, 1, 0), ("rx", None, at, 0, 0.1, 1, 1, 0)]
    pick = lambda: rng.choice(["a", "b", "c", "d", "e", None])
    ids = [f"t{i % 32}" for i in range(70)] + [None]
    ins = [(t, 0, None, 0, pick(), rng.choice([None, 1.0, 2.0])) for t in ids for _ in range(2)]
    outs = [(t, 0, pick(), rng.choice([None, 0.5, 3.0])) for t in ids]
    net = [("n1", at, "t1", "ip1", "d", 1, 2, "AS1", None), ("n2", at, "t2", "ip2", "d", 1, 2, None, "DE")]
    return case_of(spark, txs, ins, outs, net)


def as_rows(df):
    told = [{k: sorted(v) if isinstance(v, list) else v for k, v in r.asDict().items()} for r in df.collect()]
    return sorted(repr(sorted(r.items())) for r in told)


def test_packs_tell_the_memberships(spark):
    case = repeated_case(spark)
    want = memberships(participation(case), with_amounts=True)
    assert as_rows(features.wallet_members(case).rows) == as_rows(want) and want.count()


@pytest.mark.parametrize("most", [None, 0])
def test_short_cycles_of_packs_against_plain_python(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(graph, "BROADCAST_KEYS", most)
    case = repeated_case(spark)
    ways, got, members = Counter(), Counter(), memberships(participation(case)).collect()
    for p in members:
        if p["sent_rows"] and p["received_rows"]:
            got.update([f"wallet:{p['address']}", f"transaction:{p['txid']}"])
        for q in members:
            if p["txid"] == q["txid"] and p["address"] != q["address"] and p["sent_rows"] and q["received_rows"]:
                ways[p["address"], q["address"], p["txid"]] += 1
    for (w, v, there), f in ways.items():
        for (x, y, back), b in ways.items():
            if (x, y) == (v, w) and there != back:
                got.update({f"transaction:{there}": f * b, f"transaction:{back}": f * b} if w < v else {})
                got.update({f"wallet:{w}": f * b, f"wallet:{v}": f * b} if w < v else {})
    found = graph.short_cycles(features.wallet_members(case)).collect()
    assert {r["id"]: r["short_cycle_count"] for r in found} == got


def test_pairs_and_partners_need_no_meeting_by_transaction(spark):
    """Payers and payees come out of one row: the only shuffles left are by pair and by address."""
    held = features.wallet_members(small_case(spark))
    plan = graph.pair_sums(graph.packed_pairs(held.packs))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_pairs_come_from_one_row_a_transaction(spark):
    part = participation(small_case(spark)).union(participation(small_case(spark)))
    odd = part.unionByName(part.withColumn("txid", F.lit(None).cast("string")))
    pairs = address_pairs(odd)
    want = address_pairs(part, with_tx=True).select("source_address", "target_address").distinct()
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    # The two sides no longer meet by txid: the only joins left are those of participation itself.
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins(pairs) <= joins(odd)


def test_wallet_matrix_slices_by_the_busiest_address(spark, monkeypatch):
    sliced = []
    plain = ordered._slice
    monkeypatch.setattr(ordered, "_slice", lambda df, keys, order: sliced.append(list(keys)) or plain(df, keys, order))
    rows = lambda: sorted(map(tuple, matrices.wallet_matrix(small_case(spark)).collect()))
    want = rows()
    spark.conf.set("spark.ledgerscope.splitRows", "50")  # fewer than the flows, more than those of any address
    try:
        got = rows()
        assert not sliced
        spark.conf.set("spark.ledgerscope.splitRows", "4")
        cuts = rows()
        assert sliced
    finally:
        spark.conf.unset("spark.ledgerscope.splitRows")
    assert got == want and all(a == pytest.approx(b) for x, y in zip(cuts, want, strict=True) for a, b in zip(x[1:], y[1:]))
