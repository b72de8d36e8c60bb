"""Mixing sources to target weights by a min-cost flow (op6).

1. Documents fold into membership patterns: the set of sources a document belongs to, with the total size. There is
   one row a pattern.
2. Targets: the weights share ``share`` of all sizes; no target exceeds ``repeats`` times its source's size, and the
   excess is shared again by weight until none does.
3. Flow network: pattern -> source edges for every repetition, with capacity the pattern's size and a cost that
   grows with the repetition (convex, so a further copy is used only when fresher text is used up), then source ->
   sink with the target as quota. Successive cheapest paths fill it.
4. Documents of a pattern are laid in a seeded order; a repetition's flow takes the first documents of the order, up
   to the one that brings the sum nearest to the flow. The order is by a digest of seed and doc_id. Sums are first
   made over the first hexadecimal digits of the digest (at most 16^3 rows a pattern), and only documents under the
   one prefix where the flow ends are ordered singly, so no task orders a whole source.

The driver holds patterns, never documents; ``max_patterns`` states the bound and a larger number is refused.

Rows: null text has size 0; very long texts are taken whole and not cut. A null source is a source, last in order; with
lists of sources an empty or null list is the null source. Rows of equal digest (repeated doc_ids) move
together. Documents of size 0 take 0. An empty table gives an empty result. Other columns are kept by ``mixed_rows``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 6
PREFIX = 3


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII spaces."""
    one_gap = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        one_gap = F.replace(one_gap, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(one_gap, " "), "")).cast("long")


def targets(sizes: list[int], weights: list[int], share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Shares of ``share`` times the total by weight, capped at ``repeats`` times each size, the rest shared again."""
    whole = share * sum(sizes)
    open_ = set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        left = whole - sum(float(repeats * sizes[i]) for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / weight
        above = {i for i in open_ if out[i] > repeats * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = float(repeats * sizes[i])
        open_ -= above
    return out


def min_cost_flow(
    patterns: list[tuple[frozenset[int], int]], quotas: list[int], repeats: int = REPEATS
) -> dict[tuple[int, int, int], int]:
    """{(pattern, repetition, source): words}. Successive cheapest augmenting paths with potentials."""
    np_, ns = len(patterns), len(quotas)
    sink, source = np_ + ns + 1, np_ + ns
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(np_ + ns + 2)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for u, v, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[u].append(len(to))
            to.append(v)
            cap.append(cc)
            cost.append(ww)
        return len(to) - 2

    use: dict[tuple[int, int], int] = {}
    for p, (members, size) in enumerate(patterns):
        for r in range(repeats):
            # Repetition r of any word of the pattern costs r squared, whichever source it serves.
            edge(source, p, size, r * r)
        for s in sorted(members):
            use[p, s] = edge(p, np_ + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        edge(np_ + s, sink, quota, 0)
    potential = [0] * len(out)
    while True:
        far = [None] * len(out)
        came = [-1] * len(out)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e]:
                    step = d + cost[e] + potential[u] - potential[to[e]]
                    if far[to[e]] is None or step < far[to[e]]:
                        far[to[e]], came[to[e]] = step, e
                        heapq.heappush(heap, (step, to[e]))
        if far[sink] is None:
            break
        for v, d in enumerate(far):
            if d is not None:
                potential[v] += d
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = to[came[v] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    flows: dict[tuple[int, int, int], int] = {}
    for p, (members, size) in enumerate(patterns):
        level, room = 0, size
        for s in sorted(members):
            left = cap[use[p, s] ^ 1]
            while left:
                part = min(left, room)
                flows[p, level, s] = flows.get((p, level, s), 0) + part
                left -= part
                room -= part
                if room == 0:
                    level, room = level + 1, size
    return flows


def plan_mix(sized: DataFrame, weights: tuple[int, ...], share: float, repeats: int, max_patterns: int):
    """Rows of (pattern, source, target, source_size) and of (pattern, rep, low, high): the words of a pattern's
    seeded order that a repetition gives to a source are those from low to high."""
    folded = sized.groupBy("sources").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(folded) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns")
    names = sorted({s for row in folded for s in row["sources"]}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    patterns = [(frozenset(place[s] for s in row["sources"]), int(row["size"])) for row in folded]
    sizes = [sum(size for members, size in patterns if i in members) for i in range(len(names))]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    flows = min_cost_flow(patterns, [round(t) for t in wanted], repeats)
    per_source = [(s, sizes[i], wanted[i]) for s, i in place.items()]
    spans, reached = [], {}
    for (p, r, s), words in sorted(flows.items()):
        low = reached.get((p, r), 0)
        spans.append((folded[p]["sources"], r, names[s], low, low + words))
        reached[p, r] = low + words
    return per_source, spans


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = SEED,
    max_patterns: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep_row: bool = False,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies[, row]) per document.

    ``source`` names a string column, or an array column for documents of several sources; size and target are then
    those of the first source in order. A document of no source, its list null or empty, is one of the null source.
    """
    spark = docs.sparkSession
    is_list = dict(docs.dtypes)[source].startswith("array")
    if is_list:
        listed = F.array_sort(F.array_distinct(F.col(source)))
        members = F.when(F.size(F.coalesce(listed, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(listed)
    else:
        members = F.array(F.col(source).cast("string"))
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    columns = [
        F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("size"), members.alias("sources"), F.md5(own).alias("mark")
    ]
    if keep_row:
        columns.append(F.struct("*").alias("row"))
    sized = materialize(docs.select(*columns).withColumn("head", F.substring("mark", 1, PREFIX)), "sized-documents")
    per_source, spans = plan_mix(sized, weights, share, repeats, max_patterns)

    known = spark.createDataFrame(per_source, "source string, source_size long, target double")
    cuts = spark.createDataFrame(spans, "sources array<string>, rep int, source string, low long, high long")
    # Position of each digest prefix in its pattern's order.
    heads = sized.groupBy("sources", "head").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sources").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    # A null source is a member like any other, so patterns are compared as text with nulls marked.
    name = lambda c: F.to_json(F.struct(F.col(c).alias("s")), {"ignoreNullFields": "false"})
    heads = heads.withColumn("pattern", name("sources"))
    ends = cuts.withColumn("pattern", name("sources")).drop("sources")
    # Per prefix and cut: taken whole, not at all, or decided document by document.
    placed = heads.join(ends, "pattern").select(
        "pattern", "head", "base", "rep", "low", "high",
        F.when((F.col("base") >= F.col("low")) & (F.col("base") + F.col("words") <= F.col("high")), "whole")
        .when((F.col("base") + F.col("words") <= F.col("low")) | (F.col("base") >= F.col("high")), "none")
        .otherwise("split").alias("how"),
    )
    per_head = placed.groupBy("pattern", "head").agg(
        F.min("base").alias("base"),
        F.count_if(F.col("how") == "whole").alias("whole"),
        F.collect_list(F.when(F.col("how") == "split", F.struct("rep", "low", "high"))).alias("splits"),
    )
    rows = sized.withColumn("pattern", name("sources"))
    at_ends = per_head.where(F.size("splits") > 0)
    # Documents under a prefix where a cut falls: equal digests first become one row.
    groups = (
        rows.join(at_ends, ["pattern", "head"])
        .groupBy("pattern", "head", "mark", "base", "splits")
        .agg(F.sum("size").alias("words"))
    )
    inside = Window.partitionBy("pattern", "head").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    # A document belongs to a cut when its middle does: the sum then ends nearest to the flow.
    middle = F.col("start") + F.col("words") / 2
    decided = groups.withColumn("start", start).select(
        "pattern", "head", "mark",
        F.size(F.filter("splits", lambda c: (middle >= c["low"]) & (middle < c["high"]))).alias("partly"),
    )
    copies = F.coalesce("whole", F.lit(0)) + F.coalesce("partly", F.lit(0))
    first = F.get(F.col("sources"), F.lit(0))
    out = (
        rows.join(per_head.select("pattern", "head", "whole"), ["pattern", "head"], "left")
        .join(decided, ["pattern", "head", "mark"], "left")
        .withColumn("copies", copies.cast("int"))
        .withColumn("source", first)
        .withColumn("named", F.coalesce(F.col("source"), F.lit("")))
        .withColumn("no_source", F.col("source").isNull())
    )
    facts = known.select(
        F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNull().alias("no_source"), "source_size", "target"
    )
    return out.join(facts, ["named", "no_source"]).select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        *(["row"] if keep_row else []),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The given columns of every document, once for each time the mix takes it."""
    mixed = mix(docs, keep_row=True, **options)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
