"""Iterative graph operators. Every round is one DataFrame job, cut by a reliable checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.ordered import running_total
from ledgerscope.session import cut, laid_out, materialize


def numbered(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, n, own) of all ends and nodes, the edges between numbers): rounds carry numbers and never ids.

    Numbers rise with the ids, so the least number is the least id. ``own`` tells the given nodes, all without them.
    An end that is null stays null.
    """
    given = nodes is None
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(given).alias("own"))
    if not given:
        ids = ids.union(nodes.select("id", F.lit(True)))
    known = ids.groupBy("id").agg(F.max("own").alias("own"))
    # Sorted by range, so the numbers rise with the id.
    names = materialize(known.orderBy("id").select("id", F.monotonically_increasing_id().alias("n"), "own"), "names")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ahead = edges.join(names.select(F.col("id").alias("src"), F.col("n").alias("a")), "src", "left").drop("src")
    arcs = ahead.join(names.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst", "left")
    return names, materialize(arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest), "arcs")


def named(names: DataFrame, df: DataFrame, column: str = "id") -> DataFrame:
    """``df`` with the ids of its numbers in ``column``."""
    return df.join(names.select(F.col("id").alias("_id"), F.col("n").alias(column)), column).withColumn(column, F.col("_id")).drop("_id")


def _worded(edges: DataFrame) -> bool:
    return dict(edges.dtypes)["src"] == "string"


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, without loops or repeats."""
    return _both_ways(edges).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): weakly connected components named by their smallest member.

    Alternating large-star and small-star contraction: a logarithmic number of rounds even on long
    chains, and the smallest neighbour is a combinable minimum, so hubs cost no more than others.
    """
    if _worded(edges):
        names, arcs = numbered(edges.select("src", "dst"), nodes)
        stars = _stars(arcs)
        # Components of one node have no link; of the others the names are looked up once a component.
        roots = named(names, stars.select(F.col("v").alias("id")).distinct().withColumn("v", F.col("id"))).select(F.col("id").alias("component"), "v")
        of = stars.join(roots, "v").select(F.col("u").alias("n"), "component")
        return names.join(of, "n", "left").select("id", F.coalesce("component", "id").alias("component"))
    links = _stars(edges)
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = found.union(found.select("component", "component")).distinct()
    everyone = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if nodes is not None:
        everyone = everyone.union(nodes.select("id"))
    return everyone.distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node of a component but the smallest, with the smallest."""
    pairs = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    links = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", "m"))
            .where("u <> v")
            .distinct()
        )
        links = cut(small)
        # Order-free fingerprint of the links: equal twice in a row means a fixpoint.
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == mark:
            return links
        mark = now


def component_sizes(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return parts.join(sizes, "component").select("id", "component", "component_size")


def pagerank(
    edges: DataFrame,
    nodes: DataFrame,
    alpha: float = 0.85,
    max_rounds: int = 200,
    tolerance: float | None = 1e-6,
) -> DataFrame:
    """(id, pagerank) over (src, dst, weight); dangling mass is spread evenly.

    With a tolerance the rounds end when a round moves less than that share of all rank, whatever the number of nodes;
    ranks that do not settle are an error. None runs all rounds.
    """
    if _worded(edges):
        names, arcs = numbered(edges.select("src", "dst", "weight"), nodes)
        points = names.where("own").select(F.col("n").alias("id"))
        return named(names, pagerank(arcs, points, alpha, max_rounds, tolerance))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = laid_out(cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))), "src")
    base = cut(
        nodes.select(F.col("id")).distinct().join(out.select(F.col("src").alias("id"), F.lit(1).alias("live")), "id", "left")
        .select("id", F.col("live").isNull().alias("dangling"))
    )
    n, idle = base.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    ranks = base.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    lost = idle / n if n else 0.0
    for _ in range(max_rounds):
        passed = (
            shares.join(ranks.select(F.col("id").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        )
        fresh = ranks.join(passed, "id", "left").select(
            "id",
            "dangling",
            (alpha * (F.coalesce("got", F.lit(0.0)) + lost / n) + (1.0 - alpha) / n).alias("rank"),
            F.col("rank").alias("was"),
        )
        fresh = cut(fresh)
        lost, moved = fresh.agg(
            F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)),
            F.sum(F.abs(F.col("rank") - F.col("was"))),
        ).first()
        ranks = fresh.drop("was")
        if tolerance is not None and moved < tolerance:
            break
    else:
        if tolerance is not None and n:
            shares.unpersist()
            raise RuntimeError(f"ranks still move by {moved} after {max_rounds} rounds")
    shares.unpersist()
    return ranks.select("id", F.col("rank").alias("pagerank"))


def core_numbers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, core): repeated h-index of the neighbours' values, which settles at the k-core number.

    A node needs only how many neighbours hold each value up to its own, so its neighbours are counted
    by value before they are ordered. From the second round on only neighbours of changed nodes are looked at:
    a node whose neighbours kept their values keeps its own.
    """
    if _worded(edges):
        names, arcs = numbered(edges.select("src", "dst"), nodes)
        points = None if nodes is None else names.where("own").select(F.col("n").alias("id"))
        return named(names, core_numbers(arcs, points))
    both = laid_out(_both_ways(edges), "u", unique=True)
    size = both.count()
    current = cut(both.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("core")))
    asked = both
    while True:
        held = (
            asked.join(current.select(F.col("id").alias("u"), F.col("core").alias("cu")), "u")
            .join(current.select(F.col("id").alias("v"), F.col("core").alias("cv")), "v")
            .groupBy("u", "cu", F.least("cv", "cu").alias("value"))
            .agg(F.count(F.lit(1)).alias("c"))
            .withColumn("down", -F.col("value"))
        )
        ranked = running_total(held, ["u"], ["down"], F.col("c"), "above", size)
        h = F.max(F.least(F.col("value"), F.col("above") + F.col("c")))
        fresh = ranked.groupBy(F.col("u").alias("id"), F.col("cu").alias("was")).agg(h.alias("lower"))
        changed = cut(fresh.where("lower <> was").select("id", "lower"))
        if changed.isEmpty():
            break
        current = cut(current.join(changed, "id", "left").select("id", F.coalesce("lower", "core").alias("core")))
        # Pairs are there both ways, so neighbours are found at the changed node's own side.
        near = both.join(changed.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("u")).distinct()
        asked = both.join(near, "u", "left_semi")
    both.unpersist()
    if nodes is None:
        return current
    return nodes.select("id").distinct().join(current, "id", "left").na.fill(0)


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): synchronous label propagation on the undirected view.

    A node takes the label most of its neighbours and itself hold, the smallest on a tie; communities are
    named by their smallest member. Votes are counted per label before they meet at the node.
    """
    if _worded(edges):
        names, arcs = numbered(edges.select("src", "dst"), nodes)
        members = communities(arcs, points(names), rounds)
        return named(names, named(names, members, "community")).select("id", "community")
    both = laid_out(_both_ways(edges), "v", unique=True)
    labels = cut(nodes.select("id", F.col("id").alias("label")).distinct())
    for _ in range(rounds):
        votes = (
            both.join(labels.select(F.col("id").alias("v"), "label"), "v").select(F.col("u").alias("id"), "label")
            .union(labels.select("id", "label"))
            .groupBy("id", "label")
            .agg((-F.count(F.lit(1))).alias("votes"))
        )
        labels = cut(votes.groupBy("id").agg(F.min(F.struct("votes", "label")).alias("best")).select("id", "best.label"))
    both.unpersist()
    least = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(least, "label").select("id", "community")


def points(names: DataFrame) -> DataFrame:
    """(id): the numbers of the given nodes that have an id."""
    return names.where("own and id is not null").select(F.col("n").alias("id"))


def community_table(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community, community_size, community_density): ``communities`` with their ``community_stats``."""
    names, arcs = numbered(edges.select("src", "dst"), nodes)
    members = cut(communities(arcs, points(names), rounds))
    stats = community_stats(arcs, members)
    called = named(names, stats.withColumn("name", F.col("community")), "name")
    met = members.join(called, "community").select("id", F.col("name").alias("community"), "community_size", "community_density")
    return named(names, met)


def community_stats(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: size and directed density m/(n(n-1)), 0 for a single node."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("community_size"))
    a = members.select(F.col("id").alias("src"), F.col("community"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inner = edges.join(a, "src").join(b, "dst").where("community = other").groupBy("community").agg(F.count(F.lit(1)).alias("m"))
    n = F.col("community_size")
    density = F.when(n > 1, F.coalesce("m", F.lit(0)) / (n * (n - 1))).otherwise(0.0)
    return sizes.join(inner, "community", "left").select("community", "community_size", density.alias("community_density"))


def pivots(names: DataFrame, k: int) -> DataFrame:
    """The rows of k nodes in the order of a hash of their ids: the same ones on every run and partitioning."""
    return names.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(k)


# Arcs that a task holds when it walks the whole graph by itself.
HELD_ARCS = 4_000_000
# Rows (pivot, node) of one run of searches beyond that.
STATE_ROWS = 100_000_000


def betweenness(edges: DataFrame, nodes: DataFrame, k: int | None = 100, held: int = HELD_ARCS, rows: int = STATE_ROWS) -> DataFrame:
    """(id, betweenness) on directed edges, normalised; from k pivots, or from all nodes when k is None.

    Brandes: searches count shortest paths outwards, then dependencies are summed level by level inwards. Up to ``held``
    arcs every task keeps the graph and walks it from its own pivots. Beyond, all pivots of a run are searched together, a
    level a job, and a run has no more than about ``rows`` rows.
    """
    names, arcs = numbered(edges.where("src <> dst").select("src", "dst").distinct(), nodes)
    everyone = names.where("own").select("id", "n")
    n = everyone.count()
    starts = everyone.select("n")
    if k is not None:
        starts = cut(pivots(everyone, k).select("n"))
    used = starts.count()
    if arcs.count() <= held:
        sums = _held_sums(arcs, starts)
    else:
        runs, sums = max(1, -(-used * n // rows)), None
        for run in range(runs):
            part = cut(starts.where(F.pmod(F.xxhash64("n"), F.lit(runs)) == run))
            found = _level_sums(arcs, part)
            if sums is not None:
                found = sums.union(found).groupBy("n").agg(F.sum("d").alias("d"))
            sums = cut(found)
    scale = (n / used) / ((n - 1) * (n - 2)) if n > 2 and used else 0.0
    return everyone.join(sums, "n", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def _held_sums(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """(n, d): dependencies on each node summed over the starts; the arcs are sent to every task."""
    table = arcs.toArrow()
    numbers, ends = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
    tails, heads = np.split(ends.astype(np.int32), 2)
    order = np.argsort(tails, kind="stable")
    begins = np.searchsorted(tails[order], np.arange(len(numbers) + 1))
    graph = arcs.sparkSession.sparkContext.broadcast((numbers, begins, heads[order]))
    width = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, to = graph.value
        asked = np.concatenate([np.empty(0, np.int64), *[b.column(0).to_numpy() for b in batches]])
        at = np.searchsorted(known, asked)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == asked)] if len(known) else at[:0]
        sums = dependencies(first, to, at)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(known[hit]), pa.array(sums[hit])], names=["n", "d"])

    each = starts.repartition(width).mapInArrow(walked, "n long, d double")
    return cut(each.groupBy("n").agg(F.sum("d").alias("d")))


def dependencies(first: np.ndarray, heads: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Brandes' dependencies on each node summed over the starts; node i's arcs go to ``heads[first[i]:first[i + 1]]``."""
    n = len(first) - 1
    sums, drawn, paths = np.zeros(n), np.zeros(n), np.zeros(n)
    level, slot = np.full(n, -1, np.int32), np.zeros(n, np.int64)
    for start in starts:
        level[start], paths[start] = 0, 1.0
        front, fronts, steps = np.array([start]), [], []
        while len(front):
            fronts.append(front)
            counts = first[front + 1] - first[front]
            tails = np.repeat(front, counts)
            places = np.arange(len(tails)) + np.repeat(first[front] - np.cumsum(counts) + counts, counts)
            to = heads[places]
            fresh = level[to] < 0
            tails, to = tails[fresh], to[fresh]
            level[to] = len(fronts)
            np.add.at(paths, to, paths[tails])
            steps.append((tails, to))
            # Each reached node once, where it was written last.
            place = np.arange(len(to))
            slot[to] = place
            front = to[slot[to] == place]
        for tails, to in reversed(steps):
            np.add.at(drawn, tails, paths[tails] / paths[to] * (1.0 + drawn[to]))
        seen = np.concatenate(fronts)
        drawn[start] = 0.0
        sums[seen] += drawn[seen]
        level[seen], paths[seen], drawn[seen] = -1, 0.0, 0.0
    return sums


def _level_sums(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """The same by joins: a level of all searches at once is one table."""
    width = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cut(starts.select(F.col("n").alias("pivot"), "n", F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    depth = 0
    while True:
        ahead = (
            state.where(F.col("level") == depth).join(arcs, F.col("n") == F.col("src"))
            .groupBy("pivot", F.col("dst").alias("n"))
            .agg(F.sum("paths").alias("paths"))
            .join(state.select("pivot", "n"), ["pivot", "n"], "left_anti")
            .select("pivot", "n", F.lit(depth + 1).alias("level"), "paths")
        )
        ahead = cut(ahead)
        if ahead.isEmpty():
            break
        # Without the coalesce every level would add its own partitions to all later scans.
        state = cut(state.unionByName(ahead).coalesce(width))
        depth += 1
    empty = F.lit(0.0)
    below = state.where(F.col("level") == depth).select("pivot", "n", "paths", empty.alias("dependency"))
    total = below.select("n", "pivot", "dependency")
    for level in range(depth - 1, -1, -1):
        child = below.select(
            "pivot", F.col("n").alias("dst"), ((1.0 + F.col("dependency")) / F.col("paths")).alias("pull")
        )
        drawn = (
            arcs.join(child, "dst")
            .select("pivot", F.col("src").alias("n"), "pull")
            .groupBy("pivot", "n")
            .agg(F.sum("pull").alias("pull"))
        )
        below = cut(
            state.where(F.col("level") == level).join(drawn, ["pivot", "n"], "left").select(
                "pivot", "n", "paths", (F.col("paths") * F.coalesce("pull", empty)).alias("dependency")
            )
        )
        total = total.union(below.select("n", "pivot", "dependency"))
    return total.where("n <> pivot").groupBy("n").agg(F.sum("dependency").alias("d"))


def distances(edges: DataFrame, start: str, max_hops: int, backwards: bool = False) -> DataFrame:
    """(id, hop) from one node along directed edges, up to ``max_hops``."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    arcs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hop int")
    frontier = seen.select("id")
    for hop in range(1, max_hops + 1):
        reached = arcs.join(frontier.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti"))
        seen = seen.union(frontier.select("id", F.lit(hop)))
    return seen


def flow_paths(edges: DataFrame, start: str, end: str, max_hops: int = 6) -> DataFrame:
    """Edges on the shortest directed flows between two nodes of at most ``max_hops`` steps."""
    ahead = distances(edges, start, max_hops)
    back = distances(edges, end, max_hops, backwards=True)
    on = edges.select("src", "dst").distinct().join(
        ahead.select(F.col("id").alias("src"), F.col("hop").alias("from_start")), "src"
    ).join(back.select(F.col("id").alias("dst"), F.col("hop").alias("to_end")), "dst")
    length = ahead.where(F.col("id") == end).agg(F.min("hop")).scalar()
    return on.where(F.col("from_start") + 1 + F.col("to_end") == length).select("src", "dst", "from_start")
