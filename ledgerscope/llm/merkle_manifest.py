"""Merkle manifest of a table with a proof for every row (op12).

A row's leaf is the digest of its fields. Per key the leaves, in order, form a tree in which every two consecutive
nodes become the digest of their digests and a last odd one the digest of its own, until one is left, the subroot; the
subroots, in the order of their keys, form a tree of the same kind, whose top is the root.

The rank of a leaf is written in binary digits. Within a block of ``BLOCK_LEVELS`` digits the digit columns are grouped
away one after another, each group nesting the structs of its (at most two) children, so one shuffle by (key, block)
serves all levels of a block and a row never holds more than 2 ** ``BLOCK_LEVELS`` leaves. Block tops are the leaves of
the next stage. On the way down each stage's rows take the path above their block, hand a path to every child by one
transform a level, and are exploded; only block tops, a 256th of the rows below them, ever meet by key.

A group of the key's first node with a single child passes it on unchanged: a tree ends when one node is left.

Rows: null fields are written ``-``. Leaves ascend by doc_id, nulls first, and among equal ids by their digest;
repeated rows are leaves each, equal ones interchangeable. The null key comes before all others. Texts of any length
are digested inside the JVM. An empty table gives an empty table. doc_id and key keep their types; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.ordered import row_numbers
from ledgerscope.session import materialize

BLOCK_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written(value: Column) -> Column:
    """A field with its length in bytes ahead."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, altered: dict[str, Column] | None = None) -> Column:
    """Digest of a row's fields, some of them replaced by other columns."""
    return digest(*(written((altered or {}).get(name, F.col(name))) for name in fields))


def _roll_up(nodes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, block, top) of nodes (keys, rank, hash, item): nested structs of hash and kids over one block each."""
    block = F.shiftright("rank", BLOCK_LEVELS)
    rest = F.col("rank").bitwiseAND((1 << BLOCK_LEVELS) - 1).cast("int")
    level = nodes.select(*keys, block.alias("block"), rest.alias("rest"), F.struct("hash", "item").alias("node"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = level.repartition(parts, *keys, "block")
    for _ in range(BLOCK_LEVELS):
        child = F.struct(F.col("rest").bitwiseAND(1).alias("digit"), "node")
        grouped = level.groupBy(*keys, "block", F.shiftright("rest", 1).alias("rest")).agg(
            F.transform(F.array_sort(F.collect_list(child)), lambda c: c["node"]).alias("kids")
        )
        one, two = F.get("kids", F.lit(0))["hash"], F.get("kids", F.lit(1))["hash"]
        ended = (F.col("block") == 0) & (F.col("rest") == 0) & two.isNull()
        top = F.when(ended, one).otherwise(digest(one, F.coalesce(two, F.lit(""))))
        level = grouped.select(*keys, "block", "rest", F.struct(top.alias("hash"), "kids").alias("node"))
    return materialize(level.select(*keys, "block", F.col("node").alias("top")), name)


def _hand_down(blocks: DataFrame, above: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, item, hash, path, and what else ``above`` tells of a block) of every node under the blocks.

    ``above``: (keys, block, path, ...). A path lists, from the bottom, what stands left and right of the node."""
    rest = [c for c in above.columns if c not in (*keys, "block", "path")]
    other = above.select(*(F.col(c).alias(f"above_{c}") for c in above.columns))
    match = F.col("block") == F.col("above_block")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"above_{k}"))
    top = F.array(F.struct(F.col("top").alias("node"), F.col("above_path").alias("path")))
    rows = blocks.join(other, match).select(*keys, *(F.col(f"above_{c}").alias(c) for c in rest), top.alias("open"))

    def kids_of(p: Column) -> Column:
        kids, passed = p["node"]["kids"], (F.size(p["node"]["kids"]) == 1) & (p["node"]["hash"] == p["node"]["kids"][0]["hash"])

        def kid(c: Column, i: Column) -> Column:
            left = F.when(i == 1, kids[0]["hash"]).otherwise(F.lit(""))
            right = F.when(i == 0, F.coalesce(F.get(kids, F.lit(1))["hash"], F.lit(""))).otherwise(F.lit(""))
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            return F.struct(c.alias("node"), F.when(passed, p["path"]).otherwise(F.concat(step, p["path"])).alias("path"))

        return F.transform(kids, kid)

    for _ in range(BLOCK_LEVELS):
        rows = rows.withColumn("open", F.flatten(F.transform("open", kids_of)))
    return rows.select(*keys, *rest, F.explode("open").alias("one")).select(
        *keys, *rest, F.col("one.node.item").alias("item"), F.col("one.node.hash").alias("hash"), F.col("one.path").alias("path")
    )


def _stages(nodes: DataFrame, keys: Sequence[str], name: str) -> list[DataFrame]:
    """Roll-ups from the nodes to one block a key."""
    most = nodes.agg(F.max("rank")).first()[0] or 0
    stages = []
    while True:
        stages.append(_roll_up(nodes, keys, f"{name}-{len(stages)}"))
        most >>= BLOCK_LEVELS
        if not most:
            return stages
        nodes = stages[-1].select(
            *keys, F.col("block").alias("rank"), F.col("top.hash").alias("hash"), F.col("block").alias("item")
        )


def _paths(stages: list[DataFrame], top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paths of the lowest nodes. ``top``: (keys, path, ...) above each key's last node."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for stage in reversed(stages):
        rows = _hand_down(stage, above, keys)
        above = rows.withColumnRenamed("item", "block").drop("hash")
    return rows


def proofs(
    docs: DataFrame,
    key: str = "lang",
    doc_id: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    altered: dict[str, Column] | None = None,
    when: Column | None = None,
) -> DataFrame:
    """(doc_id, leaf, claim, subroot, root, path): a claim is the leaf, or where ``when`` holds that of altered fields.

    Leaves are digested once and written; two shuffles of leaves follow (ranks and blocks), texts are not shuffled."""
    claim = leaves(docs, fields, altered)
    base = docs.select(
        F.col(key).isNotNull().alias("has_key"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.col(doc_id).isNotNull().alias("has_id"),
        F.col(doc_id).alias("id"),
        leaves(docs, fields).alias("hash"),
        F.when(F.coalesce(when, F.lit(False)), claim).alias("claim") if when is not None else F.lit(None).cast("string").alias("claim"),
    )
    base = materialize(base, "leaves")
    keys = ["has_key", "key"]
    # Nulls must not stand in an order of the slices, so the id is ordered as a struct behind its flag.
    order = base.withColumn("place", F.struct("has_id", "id", "hash"))
    ranked = materialize(row_numbers(order, keys, ["place"], "rank").drop("place"), "ranked-leaves")
    nodes = ranked.select(*keys, "rank", "hash", F.struct("id", "claim").alias("item"))
    trees = _stages(nodes, keys, "blocks")
    tops = trees[-1].select(F.struct(*keys).alias("item"), F.col("top.hash").alias("hash"))
    tops = tops.select("item", "hash", F.lit(0).alias("all"))
    ranked_tops = row_numbers(tops, ["all"], ["item"], "rank").select("all", "rank", "hash", "item")
    crown = _stages(materialize(ranked_tops, "subroots"), ["all"], "crown")
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = crown[-1].select("all", F.col("top.hash").alias("root"), none.alias("path"))
    subroots = _paths(crown, start, ["all"]).select(
        F.col("item.has_key").alias("has_key"), F.col("item.key").alias("key"), F.col("hash").alias("subroot"), "root", "path"
    )
    return _paths(trees, subroots, keys).select(
        F.col("item.id").alias("doc_id"), F.col("hash").alias("leaf"), F.coalesce("item.claim", "hash").alias("claim"), "subroot", "root", "path"
    )


def folded(path: Column, claim: Column) -> Column:
    """The root that a claim and its siblings lead to."""
    return F.aggregate(path, claim, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered(docs: DataFrame, share: int = 7, field: str = "n_chars") -> DataFrame:
    """Proofs of all rows, checked against claims in which every ``share``-th id's ``field`` is one higher."""
    when = F.crc32(F.col("doc_id").cast("string")) % share == 0
    raised = F.col(field).cast("decimal(38,0)") + 1
    rows = proofs(docs, altered={field: raised}, when=when)
    checked = rows.withColumn("folded_root", folded(F.col("path"), F.col("claim")))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
