"""Iterative graph operators against brute force on small graphs."""

import itertools
import random

import pytest

from ledgerscope.operators import dictionary
from ledgerscope.operators import entity_graph as graph
from ledgerscope.operators import graph_walks as walks
from ledgerscope.operators import modularity
from ledgerscope.operators import tree_walks as trees
from ledgerscope.session import cut


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def frames(spark, edges, n):
    e = spark.createDataFrame(edges, "src string, dst string")
    return e, spark.createDataFrame([(f"n{i:02d}",) for i in range(n)], "id string")


def neighbours(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def count_parts(nodes, nb, without=None, gone=None):
    seen, parts = set(), 0
    for s in nodes:
        if s == without or s in seen:
            continue
        parts += 1
        todo = [s]
        seen.add(s)
        while todo:
            u = todo.pop()
            for v in nb.get(u, ()):
                if v != without and {u, v} != gone and v not in seen:
                    seen.add(v)
                    todo.append(v)
    return parts


GRAPHS = [(1, 14, 15), (2, 20, 24), (7, 40, 46), (8, 60, 58)]


@pytest.mark.parametrize("seed,n,m", GRAPHS)
def test_bridges_and_cut_nodes(spark, seed, n, m):
    edges = random_graph(seed, n, m)
    nb = neighbours(edges)
    nodes = sorted(nb)
    whole = count_parts(nodes, nb)
    want_bridges = {tuple(sorted(e)) for e in edges if count_parts(nodes, nb, gone=set(e)) > whole}
    want_nodes = {v for v in nodes if count_parts(nodes, nb, without=v) > whole}
    e, _ = frames(spark, edges, n)
    blocks = trees.biconnected(e)
    assert {(r[0], r[1]) for r in trees.bridges(blocks).collect()} == want_bridges
    assert {r["id"] for r in trees.cut_nodes(blocks).collect()} == want_nodes


def rounds_of(monkeypatch):
    """Counts the written rounds of all graph loops."""
    done = []

    def counting(real):
        def counted(*args):
            done.append(1)
            return real(*args)

        return counted

    monkeypatch.setattr(walks, "cut", counting(walks.cut))
    monkeypatch.setattr(trees, "materialize", counting(trees.materialize))
    return done


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    done = rounds_of(monkeypatch)
    order = list(range(5000))
    random.Random(3).shuffle(order)
    path = spark.createDataFrame([(f"p{a:04d}", f"p{b:04d}") for a, b in itertools.pairwise(order)], "src string, dst string")
    blocks = cut(trees.biconnected(path))
    assert len(done) < 60
    assert trees.bridges(blocks).count() == 4999
    assert trees.cut_nodes(blocks).count() == 4998


def test_a_long_ring_is_one_block(spark):
    n = 600
    ring = spark.createDataFrame([(f"p{i:04d}", f"p{(i + 1) % n:04d}") for i in range(n)], "src string, dst string")
    blocks = cut(trees.biconnected(ring))
    assert blocks.count() == n - 1 and blocks.select("block").distinct().count() == 1


def test_forest_and_tour(spark):
    edges = random_graph(9, 50, 52)
    e, _ = frames(spark, edges, 50)
    forest, named = trees.spanning_forest(walks.undirected(e))
    parts = {r["id"]: r["component"] for r in walks.components(e).collect()}
    roots = {r["id"]: r["root"] for r in named.collect()}
    assert set(roots) == set(parts)
    assert all((roots[a] == roots[b]) == (parts[a] == parts[b]) for a in parts for b in parts)
    assert forest.count() == len(parts) - len(set(parts.values()))
    rows = {r["id"]: r for r in trees.euler_tour(forest, named).collect()}
    kids = {(r["parent"], r["id"]) for r in rows.values() if r["parent"]}
    assert {tuple(sorted(k)) for k in kids} == {tuple(r) for r in forest.collect()}
    for v, r in rows.items():
        below, todo = set(), [v]
        while todo:
            u = todo.pop()
            below.add(u)
            todo += [c for p, c in kids if p == u]
        same = {w for w, s in rows.items() if s["tree"] == r["tree"] and r["last"] <= s["first"] <= r["first"]}
        assert same == below


def test_no_edges_no_blocks(spark):
    e = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert trees.biconnected(e).count() == 0


def brute_betweenness(edges, nodes):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    score = dict.fromkeys(nodes, 0.0)
    info = {}
    for s in nodes:
        dist, paths, level = {s: 0}, {s: 1}, [s]
        while level:
            nxt = []
            for u in level:
                for v in out.get(u, ()):
                    if v not in dist:
                        dist[v], paths[v] = dist[u] + 1, 0
                        nxt.append(v)
                    if dist[v] == dist[u] + 1:
                        paths[v] += paths[u]
            level = nxt
        info[s] = (dist, paths)
    for s, t in itertools.permutations(nodes, 2):
        ds, ps = info[s]
        if t not in ds:
            continue
        for v in nodes:
            if v not in (s, t) and v in ds and t in info[v][0] and ds[v] + info[v][0][t] == ds[t]:
                score[v] += ps[v] * info[v][1][t] / ps[t]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_matches_brute_force(spark):
    edges = random_graph(3, 12, 30)
    e, nodes = frames(spark, edges, 12)
    want = brute_betweenness(edges, [f"n{i:02d}" for i in range(12)])
    got = {r["id"]: r["betweenness"] for r in walks.betweenness(e, nodes).collect()}
    assert got == pytest.approx(want)


def test_components_on_a_chain_and_cores(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    e, nodes = frames(spark, chain, 44)
    got = {r["id"]: r["component"] for r in walks.components(e, nodes).collect()}
    assert all(got[f"n{i:02d}"] == "n00" for i in range(41)) and got["n42"] == "n42"
    clique = [(a, b) for a, b in itertools.combinations(["n00", "n01", "n02", "n03"], 2)] + [("n03", "n04"), ("n04", "n05")]
    e, nodes = frames(spark, clique, 7)
    cores = {r["id"]: r["core"] for r in walks.core_numbers(e, nodes).collect()}
    assert cores == {"n00": 3, "n01": 3, "n02": 3, "n03": 3, "n04": 1, "n05": 1, "n06": 0}
    tri = {r["id"]: r["triangle_count"] for r in graph.triangles(e).collect()}
    assert tri == {"n00": 3, "n01": 3, "n02": 3, "n03": 3}


def test_pagerank_sums_to_one(spark):
    edges = random_graph(5, 15, 30)
    e, nodes = frames(spark, edges, 16)
    ranks = walks.pagerank(e.selectExpr("*", "1.0D AS weight"), nodes).collect()
    assert sum(r["pagerank"] for r in ranks) == pytest.approx(1.0)
    assert len(ranks) == 16


def plain_ranks(edges, nodes, moved_below, alpha=0.85):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    while True:
        lost = sum(rank[v] for v in nodes if v not in out)
        fresh = dict.fromkeys(nodes, (alpha * lost + 1 - alpha) / len(nodes))
        for a, found in out.items():
            for b in found:
                fresh[b] += alpha * rank[a] / len(found)
        moved = sum(abs(fresh[v] - rank[v]) for v in nodes)
        rank = fresh
        if moved < moved_below:
            return rank


@pytest.mark.parametrize("tolerance", [1e-6, 0.1])
def test_pagerank_stops_by_moved_rank_and_not_by_size(spark, tolerance):
    # 40 nodes: with the larger tolerance nodes * tolerance exceeds all rank there is.
    edges = random_graph(5, 30, 60)
    e, nodes = frames(spark, edges, 40)
    want = plain_ranks(edges, [f"n{i:02d}" for i in range(40)], tolerance)
    got = {r["id"]: r["pagerank"] for r in walks.pagerank(e.selectExpr("*", "1.0D AS weight"), nodes, tolerance=tolerance).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_ranks_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    with pytest.raises(RuntimeError):
        walks.pagerank(edges, nodes, max_rounds=2)
    assert walks.pagerank(edges, nodes, max_rounds=2, tolerance=None).count() == 3


def test_depths_of_long_and_forked_chains(spark):
    order = list(range(3000))
    random.Random(4).shuffle(order)
    arcs = [(f"c{a}", f"c{b}") for a, b in itertools.pairwise(order)]
    # A fork of 1,000 halfway and one of a single transaction at the start; one alone.
    arcs += [(f"c{order[1500]}", "f0")] + [(f"f{i}", f"f{i + 1}") for i in range(999)] + [(f"c{order[0]}", "g")]
    names = sorted({x for e in arcs for x in e} | {"alone"})
    shaped = spark.createDataFrame([(x,) for x in names], "txid string")
    got = {r["txid"]: r["depth"] for r in dictionary.chain_depths(shaped, spark.createDataFrame(arcs, "src string, dst string")).collect()}
    want = {f"c{x}": 3000 - k for k, x in enumerate(order)} | {f"f{i}": 1000 - i for i in range(1000)} | {"g": 1, "alone": 1}
    assert got == want


def test_a_circle_of_spends_is_an_error(spark):
    shaped = spark.createDataFrame([("a",), ("b",)], "txid string")
    with pytest.raises(ValueError):
        dictionary.chain_depths(shaped, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def plain_quality(edges, of):
    """Modularity and each community's (size, inside, volume, conductance) by the definitions."""
    whole = 2.0 * sum(w for _, _, w in edges)
    out, total = {}, 0.0
    for c in set(of.values()):
        inside = sum(w for a, b, w in edges if of[a] == of[b] == c)
        volume = sum(w * ((of[a] == c) + (of[b] == c)) for a, b, w in edges)
        small = min(volume, whole - volume)
        out[c] = (sum(x == c for x in of.values()), inside, volume, (volume - 2 * inside) / small if small > 0 else 0.0)
        total += 2 * inside / whole - (volume / whole) ** 2
    return total, out


def planted(seed, groups, size, inside, between):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(groups * size)]
    edges = [
        (a, b, float(rng.randint(1, 3)))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i < j and rng.random() < (inside if i // size == j // size else between)
    ]
    return names, edges


@pytest.mark.parametrize("seed,groups,size,inside,between", [(1, 5, 8, 0.7, 0.03), (2, 4, 10, 0.4, 0.1)])
def test_communities_by_modularity(spark, seed, groups, size, inside, between):
    names, edges = planted(seed, groups, size, inside, between)
    edges += [(names[0], names[0], 2.0)]
    nodes = spark.createDataFrame([(x,) for x in [*names, "alone"]], "id string")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    found = modularity.louvain(e, nodes)
    of = {r["id"]: r["community"] for r in found.collect()}
    assert set(of) == {*names, "alone"} and of["alone"] == "alone"
    q, parts = plain_quality(edges, of)
    rows = {r["community"]: r for r in modularity.community_quality(modularity.weighted_pairs(e), found).collect()}
    assert {c: (r["community_size"], r["internal_weight"], r["volume"], r["conductance"]) for c, r in rows.items()} == {
        c: pytest.approx(v) for c, v in parts.items()
    }
    assert sum(r["modularity"] for r in rows.values()) == pytest.approx(q)
    spread = {r["id"]: r["community"] for r in walks.communities(e, nodes).collect()}
    assert q >= plain_quality(edges, spread)[0] - 1e-12
    assert q >= plain_quality(edges, {x: str(int(x[1:]) // size) if x != "alone" else x for x in of})[0] - 0.02
    # Connected, and named by the smallest member.
    nb = neighbours([(a, b) for a, b, _ in edges if a != b and of[a] == of[b]])
    for c in set(of.values()):
        mine = sorted(x for x in of if of[x] == c)
        assert mine[0] == c and count_parts(mine, nb) == 1


def test_communities_without_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    none = spark.createDataFrame([], "src string, dst string")
    assert {tuple(r) for r in modularity.louvain(none, nodes).collect()} == {("a", "a"), ("b", "b")}


@pytest.mark.parametrize("seed,n,m", [(11, 9, 30), (12, 14, 60)])
def test_cycles_of_four(spark, seed, n, m):
    edges = random_graph(seed, n, m)
    e, _ = frames(spark, edges + [("n00", "n00")], n)
    have, want = set(edges), {}
    for a, b, c, d in itertools.permutations([f"n{i:02d}" for i in range(n)], 4):
        if a < min(b, c, d) and {(a, b), (b, c), (c, d), (d, a)} <= have:
            for x in (a, b, c, d):
                want[x] = want.get(x, 0) + 1
    assert {r["id"]: r["cycles"] for r in graph.four_cycles(e).collect()} == want


@pytest.mark.parametrize("listed", [0, 25, 1 << 18])
def test_cycles_of_four_by_lists_and_by_rows(spark, listed):
    edges = random_graph(13, 14, 70)
    e, _ = frames(spark, edges, 14)
    have, want = set(edges), {}
    for a, b, c, d in itertools.permutations([f"n{i:02d}" for i in range(14)], 4):
        if a < min(b, c, d) and {(a, b), (b, c), (c, d), (d, a)} <= have:
            for x in (a, b, c, d):
                want[x] = want.get(x, 0) + 1
    assert {r["id"]: r["cycles"] for r in graph.four_cycles(e, listed).collect()} == want


@pytest.mark.parametrize("seed,n,m", [(14, 10, 40), (15, 25, 90)])
def test_triangles_without_a_row_a_wedge(spark, seed, n, m):
    edges = random_graph(seed, n, m)
    e, _ = frames(spark, edges + [("n00", "n00")], n)
    either, want = {frozenset(p) for p in edges}, {}
    for three in itertools.combinations([f"n{i:02d}" for i in range(n)], 3):
        if all(frozenset(p) in either for p in itertools.combinations(three, 2)):
            for x in three:
                want[x] = want.get(x, 0) + 1
    got = graph.triangles(e)
    assert {r["id"]: r["triangle_count"] for r in got.collect()} == want
    assert "array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()
