"""Communities of high modularity, and how good a partition is.

Nodes move to the neighbouring community that gains most modularity, a set of nodes without neighbours among it at a
time; when no move is left, communities become the nodes of a smaller weighted graph and the same begins anew. A round
counts only if it raises modularity, so the result is never worse than any state before it. Weights are summed per
(node, community) before they meet at the node, so a hub costs its communities and not its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.graph_walks import components
from ledgerscope.session import materialize

# A move must raise modularity by this much.
LEAST_GAIN = 1e-9
# Rounds and levels go on as long as they raise it by this much.
WORTH_A_ROUND = 1e-3


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """(u, v, w) with u <= v: undirected weights, parallel and opposite edges summed; without ``weight`` each counts 1."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(w).alias("w"))


def _ends(pairs: DataFrame) -> Column:
    return F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other"), "w"), F.struct(F.col("v").alias("id"), F.col("u").alias("other"), "w")))


def community_quality(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(community, community_size, internal_weight, volume, conductance, modularity) of a partition (id, community).

    volume: weighted degrees of the members, loops twice. conductance: the weight that leaves, over the smaller of the
    volumes inside and outside, 0 where one of them is. modularity: the community's share of the partition's.
    """
    of = members.select("id", "community")
    placed = pairs.join(of.toDF("u", "cu"), "u").join(of.toDF("v", "cv"), "v")
    parts = placed.select(
        F.inline(
            F.array(
                F.struct(F.col("cu").alias("community"), F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0).alias("inside"), "w"),
                F.struct(F.col("cv").alias("community"), F.lit(0.0).alias("inside"), "w"),
            )
        )
    )
    sums = parts.groupBy("community").agg(F.sum("inside").alias("internal_weight"), F.sum("w").alias("volume"))
    sizes = of.groupBy("community").agg(F.count(F.lit(1)).alias("community_size"))
    all_ = pairs.agg((2.0 * F.sum("w")).alias("whole")).select("whole").scalar()
    known = sizes.join(sums, "community", "left").na.fill(0.0, ["internal_weight", "volume"]).withColumn("whole", all_)
    inner, volume, whole = F.col("internal_weight"), F.col("volume"), F.col("whole")
    smaller = F.least(volume, whole - volume)
    return known.select(
        "community", "community_size", "internal_weight", "volume",
        F.when(smaller > 0, (volume - 2.0 * inner) / smaller).otherwise(0.0).alias("conductance"),
        F.when(whole > 0, 2.0 * inner / whole - (volume / whole) * (volume / whole)).otherwise(0.0).alias("modularity"),
    )


def _degrees(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    sums = pairs.select(_ends(pairs)).groupBy("id").agg(F.sum("w").alias("k"))
    return nodes.select("id").distinct().join(sums, "id", "left").na.fill(0.0, ["k"])


def _modularity(links: DataFrame, state: DataFrame, loops: float, whole: float) -> float:
    """links: (id, other, w) both ways without loops."""
    of = state.select("id", "c")
    inside = links.join(of, "id").join(of.toDF("other", "d"), "other").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    spread = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return (inside + 2.0 * loops) / whole - spread / (whole * whole)


def _moved(links: DataFrame, state: DataFrame, whole: float, turn: int) -> DataFrame:
    """The state after one round of moves of nodes that are not neighbours."""
    totals = state.groupBy("c").agg(F.sum("k").alias("t"))
    near = links.join(state.select(F.col("id").alias("other"), F.col("c").alias("d")), "other").groupBy("id", "d").agg(F.sum("w").alias("to"))
    known = state.join(totals, "c").select("id", "k", "c", (F.col("t") - F.col("k")).alias("rest"))
    own = near.select("id", F.col("d").alias("c"), F.col("to").alias("stay"))
    offers = near.join(known, "id").where("d <> c").join(totals.select(F.col("c").alias("d"), F.col("t").alias("there")), "d")
    gain = 2.0 * (F.col("to") - F.coalesce("stay", F.lit(0.0))) / whole - 2.0 * F.col("k") * (F.col("there") - F.col("rest")) / (whole * whole)
    best = (
        offers.join(own, ["id", "c"], "left").withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
        .groupBy("id").agg(F.max_by("d", F.struct(F.round("gain", 12), "d")).alias("d"))
    )
    wish = materialize(best.withColumn("turn", F.xxhash64("id", F.lit(turn))), "wishes")
    # Of neighbours that wish to move the one with the greater number does.
    rival = wish.select(F.col("id").alias("other"), F.col("turn").alias("theirs"))
    kept_back = links.join(wish.select("id", "turn"), "id").join(rival, "other").where("theirs > turn or (theirs = turn and other > id)")
    free = wish.join(kept_back.select("id").distinct(), "id", "left_anti").select("id", "d")
    return materialize(state.join(free, "id", "left").select("id", "k", F.coalesce("d", "c").alias("c")), "moved")


def louvain(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, community): local moves level by level; every community is connected and named by its smallest member.

    ``rounds`` bounds the rounds of one level; levels end when one brings no gain. Nodes without edges are communities
    of their own. The same graph gives the same communities as long as sums of its weights are exact.
    """
    pairs = materialize(weighted_pairs(edges), "pairs")
    total = pairs.agg(F.sum("w")).first()[0] or 0.0
    members = materialize(nodes.select("id", F.col("id").alias("community")).distinct(), "members")
    if total <= 0:
        return members
    whole, level, at = 2.0 * total, pairs, materialize(_degrees(pairs, nodes), "degrees")
    turn = 0
    while True:
        links = materialize(level.where("u <> v").select(_ends(level)), "links")
        loops = level.where("u = v").agg(F.sum("w")).first()[0] or 0.0
        state = at.select("id", "k", F.col("id").alias("c"))
        first = now = _modularity(links, state, loops, whole)
        quiet = 0
        for _ in range(rounds):
            turn += 1
            fresh = _moved(links, state, whole, turn)
            then = _modularity(links, fresh, loops, whole)
            quiet = 0 if then > now + WORTH_A_ROUND else quiet + 1
            if then > now:
                state, now = fresh, then
            # Another draw of who may move can still help once, not for ever.
            if quiet == 2:
                break
        settled = now <= first + WORTH_A_ROUND
        if now <= first + LEAST_GAIN:
            break
        of = state.select("id", "c")
        members = materialize(
            members.join(of.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")), "members"
        )
        joined = level.join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v")
        level = materialize(
            joined.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "coarse"
        )
        if settled:
            break
        at = materialize(state.groupBy("c").agg(F.sum("k").alias("k")).withColumnRenamed("c", "id"), "degrees")
    return _connected(pairs, members)


def _connected(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Communities in pieces are taken apart, which never lowers modularity."""
    inside = (
        pairs.where("u <> v").join(members.toDF("u", "a"), "u").join(members.toDF("v", "b"), "v").where("a = b")
        .select(F.col("u").alias("src"), F.col("v").alias("dst"))
    )
    return components(materialize(inside, "inside"), members).withColumnRenamed("component", "community")
