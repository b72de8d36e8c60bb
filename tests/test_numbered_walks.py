"""Graph walks over numbers in place of ids, the graph without attributes, and betweenness over all nodes."""

import pytest

from ledgerscope.operators import graph_walks as walks
from ledgerscope.plans.queries import QUERIES, Graph
from test_graph_walks import brute_betweenness


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few orders with lines and events; one line and one event lack their partner, one order comes twice."""
    at = str(tmp_path_factory.mktemp("star"))
    orders = [(k, k % 5, 100.0 * k) for k in range(1, 15)] + [(3, 3, 300.0)]
    lines = [(k, j, None if (k, j) == (4, 1) else (k * 3 + j) % 9, j, 10.0 * k, 6.0, 0.1) for k in range(1, 15) for j in (1, 2)]
    events = [(k, f"2024-01-01 00:0{k}:00", None if k == 5 else k % 3, "click") for k in range(1, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"
    ).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").selectExpr(
        "event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type"
    ).write.parquet(f"{at}/events.parquet")
    return at


def test_betweenness_query_walks_from_all_nodes(spark, tables):
    g = Graph(spark, tables)
    edges = {(r["src"], r["dst"]) for r in g.edges.collect()}
    want = brute_betweenness(edges, [r["id"] for r in g.nodes.select("id").distinct().collect()])
    got = {r["id"]: r["betweenness"] for r in QUERIES["betweenness"](spark, tables).collect()}
    assert len(got) > 8 and max(want.values()) > 0
    assert got == pytest.approx(want)


def test_betweenness_by_joins_in_several_runs(spark):
    edges = [(f"n{i}", f"n{j}") for i, j in [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (3, 5), (5, 0), (2, 6), (1, 1)]]
    e = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(8)], "id string")
    want = brute_betweenness(edges, [f"n{i}" for i in range(8)])
    for held, rows in ((100, 1), (0, 1000), (0, 20)):
        got = {r["id"]: r["betweenness"] for r in walks.betweenness(e, nodes, None, held, rows).collect()}
        assert got == pytest.approx(want)


def test_bare_graph_has_the_rows_of_the_full_one(spark, tables):
    full, bare = Graph(spark, tables), Graph(spark, tables, bare=True)
    ends = ("src", "dst", "type", "weight")
    assert sorted(bare.edges.select(*ends).collect()) == sorted(full.edges.select(*ends).collect())
    assert sorted(bare.nodes.collect()) == sorted(full.nodes.select("id", "type").collect())
    assert bare.edges.columns == list(ends)


def test_numbers_rise_with_ids_and_nulls_stay(spark):
    e = spark.createDataFrame([("n9", "n10"), ("n10", "n1"), (None, "n2"), ("n2", "n2")], "src string, dst string")
    nodes = spark.createDataFrame([("n1",), ("n1",), ("n9",), (None,), ("x",)], "id string")
    names, arcs = walks.numbered(e, nodes)
    known = names.orderBy("n").collect()
    assert [r["id"] for r in known] == [None, "n1", "n10", "n2", "n9", "x"]
    assert {r["id"] for r in known if r["own"]} == {None, "n1", "n9", "x"}
    of = {r["n"]: r["id"] for r in known} | {None: None}
    assert sorted((of[a] or "", of[b]) for a, b in arcs.collect()) == sorted((a or "", b) for a, b in e.collect())
    parts = {r["id"]: r["component"] for r in walks.components(e, nodes).collect()}
    assert parts == {"n9": "n1", "n10": "n1", "n1": "n1", "n2": "n2", "x": "x", None: None}


def test_communities_by_number_are_those_by_id(spark):
    edges = [("a10", "a9"), ("a9", "a2"), ("a2", "a10"), ("b1", "b2"), ("b2", "a2"), ("b1", "out")]
    e = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(i,) for i in ("a10", "a9", "a2", "b1", "b2", "alone")], "id string")
    plain = {i: i for i in ("a10", "a9", "a2", "b1", "b2", "alone")}
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for _ in range(5):
        fresh = {}
        for i in plain.keys() | near.keys():
            votes = [plain[j] for j in [i, *near.get(i, ())] if j in plain]
            if votes:
                fresh[i] = min(set(votes), key=lambda x: (-votes.count(x), x))
        plain = fresh
    want = {i: min(j for j in plain if plain[j] == label) for i, label in plain.items()}
    assert {r["id"]: r["community"] for r in walks.communities(e, nodes).collect()} == want
    table = {r["id"]: (r["community"], r["community_size"]) for r in walks.community_table(e, nodes).collect()}
    assert table == {i: (c, list(want.values()).count(c)) for i, c in want.items()}
