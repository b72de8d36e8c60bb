"""Near-duplicate embeddings by randomly rotated binary codes (op9).

A unit vector o is rotated by a seeded random orthogonal matrix; its code is the signs, a corner c of the unit
cube. Stored beside it: the angle alpha between o and c (the correction), and the rotated vector itself in 16
levels with the length of what that rounding lost. The product of one vector's corner and another's levels takes
popcounts only; divided by cos(alpha) it estimates the inner product without bias over rotations. For the decision
the bound is the sphere's triangle inequality: vectors within the angle t of each other satisfy
``<c, q> >= cos(alpha + t)``, so a pair whose product, plus the rounding length of q, stays below cannot reach the
threshold. Only the other pairs are recomputed from the full vectors in double precision. Nothing is missed.

Vectors meet within one label (and dimension) in tiles: a label of over ``tile`` distinct vectors is cut by a hash
into parts, and every two parts meet in a task of their own. A tile gives back counts and a spanning set of its
links, never its pairs. All pairs of a label are compared, as the contract asks, so tiles grow with its square.

Rows: equal vectors of a label fold into one with a count beforehand. Vectors that are null, empty, zero or hold
null or non-finite components, and rows without a label, link with nothing. A null vec_id never names a component
unless all in it are null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.bit_planes import spanning
from ledgerscope.operators.graph_walks import components
from ledgerscope.session import cut, materialize

TILE = 2048
LEVEL_BITS = 4
SLACK = 1e-9


@functools.cache
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two first, which loses nothing, so that squares neither overflow nor vanish."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def words(bits: np.ndarray) -> np.ndarray:
    """(rows, dim) of 0/1 as (rows, words) of unsigned 64-bit."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def codes(vectors: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Corner, angle and levels of each row of finite non-zero vectors."""
    dim = vectors.shape[1]
    turned = unit(vectors) @ rotation(dim, seed)
    corner = turned > 0
    angle = np.arccos(np.clip(np.abs(turned).sum(axis=1) / np.sqrt(dim), -1, 1))
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / (2**LEVEL_BITS - 1)
    step[step == 0] = 1.0
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    lost = np.sqrt(((low[:, None] + level * step[:, None] - turned) ** 2).sum(axis=1))
    planes = np.stack([words((level >> b) & 1) for b in range(LEVEL_BITS)], axis=1)
    return {
        "corner": words(corner), "angle": angle, "low": low, "step": step, "lost": lost,
        "planes": planes, "levels": level.sum(axis=1), "above": corner.sum(axis=1),
    }


def products(a: dict, b: dict, dim: int, rows: slice) -> np.ndarray:
    """<corner of a's rows, levels of b>, by popcounts."""
    inside = np.zeros((len(a["angle"][rows]), len(b["angle"])), np.int32)
    for k in range(LEVEL_BITS):
        for w in range(a["corner"].shape[1]):
            both = a["corner"][rows, w][:, None] & b["planes"][:, k, w][None, :]
            inside += np.bitwise_count(both).astype(np.int32) << k
    spread = b["low"][None, :] * (2 * a["above"][rows] - dim)[:, None]
    return (spread + b["step"][None, :] * (2.0 * inside - b["levels"][None, :])) / np.sqrt(dim)


def estimates(vectors: np.ndarray, seed: int = 9) -> np.ndarray:
    """The unbiased estimates of all inner products of a small set of vectors, for inspection and tests."""
    c = codes(vectors, seed)
    return products(c, c, vectors.shape[1], slice(None)) / np.cos(c["angle"])[:, None]


def linked(a_vec, a, b_vec, b, threshold: float, same: bool, block: int = 256):
    """Yields (rows of a, rows of b) with cosine at or over the threshold; within one part only later rows of b."""
    dim = a_vec.shape[1]
    far = np.arccos(threshold)
    a_norm, b_norm = np.sqrt((a_vec * a_vec).sum(axis=1)), np.sqrt((b_vec * b_vec).sum(axis=1))
    for at in range(0, len(a_vec), block):
        rows = slice(at, at + block)
        least = np.cos(np.minimum(a["angle"][rows] + far, np.pi))
        near = products(a, b, dim, rows) + b["lost"][None, :] + SLACK >= least[:, None]
        if same:
            near &= np.arange(len(b_vec))[None, :] > np.arange(at, at + near.shape[0])[:, None]
        i, j = np.nonzero(near)
        i += at
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", a_vec[x], b_vec[y]) / (a_norm[x] * b_norm[y])
            hit = cosine >= threshold
            if hit.any():
                yield x[hit], y[hit]


CODED = "gid long, label string, copies long, dim int, vector binary, corner binary, planes binary, angle double, low double, step double, lost double, levels long, above long"


def _coded(folded: DataFrame, seed: int) -> DataFrame:
    """The folded vectors with their codes and correction factors, row by row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                vectors = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1))[1][:, None])
                c = codes(vectors, seed)
                rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], rows(vectors), rows(c["corner"]), rows(c["planes"])]
                    + [pa.array(c[k]) for k in ("angle", "low", "step", "lost", "levels", "above")],
                    names=["gid", "label", "copies", "dim", "vector", "corner", "planes", "angle", "low", "step", "lost", "levels", "above"],
                )

    return folded.select("gid", "label", "copies", "dim", "embedding").mapInArrow(work, CODED)


def _tile_counts(tiles: DataFrame, threshold: float) -> DataFrame:
    """(gid, others, joined): per tile the copies a vector links to there and the vector it hangs on."""

    def tile(table: pa.Table) -> pa.RecordBatch | None:
        n, dim = len(table), table.column("dim")[0].as_py()
        binary = lambda name, kind, *shape: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(n, *shape)
        w = -(-dim // 64)
        vectors = binary("vector", "<f8", dim)
        c = {k: np.asarray(table.column(k)) for k in ("angle", "low", "step", "lost", "levels", "above")}
        c |= {"corner": binary("corner", "<u8", w), "planes": binary("planes", "<u8", LEVEL_BITS, w)}
        copies, part = np.asarray(table.column("copies")), np.asarray(table.column("part"))
        same = table.column("a")[0] == table.column("b")[0]
        cut_at = 0 if same else int((part == table.column("a")[0].as_py()).sum())
        left = slice(0, n if same else cut_at)
        right = slice(cut_at, n)
        pick = lambda s: {k: v[s] for k, v in c.items()}
        others = np.zeros(n, np.int64)

        def pairs():
            for x, y in linked(vectors[left], pick(left), vectors[right], pick(right), threshold, same):
                y = y + cut_at
                others[:] += np.bincount(x, copies[y], n).astype(np.int64) + np.bincount(y, copies[x], n).astype(np.int64)
                yield x, y

        joined = spanning(n, pairs())
        some = np.flatnonzero(others)
        gid = np.asarray(table.column("gid"))
        return pa.RecordBatch.from_arrays(
            [pa.array(gid[some]), pa.array(others[some]), pa.array(gid[joined[some]])], names=["gid", "others", "joined"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != now and held:
                        yield tile(pa.Table.from_batches(held))
                        held = []
                    now = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield tile(pa.Table.from_batches(held))

    return tiles.mapInArrow(work, "gid long, others long, joined long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    seed: int = 9,
    tile: int = TILE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    own = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (
        F.col("label").isNotNull()
        & F.forall("embedding", finite)
        & F.exists("embedding", lambda x: x != 0.0)
    )
    rows = materialize(own.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    fit = rows.where("usable").select("vec_id", "label", "embedding")
    folded = materialize(
        fit.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("gid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")),
        "distinct-vectors",
    )
    sizes = folded.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("long").alias("parts"))
    dealt = (
        _coded(folded, seed)
        .join(sizes, ["label", "dim"])
        .withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")})
        .withColumn("key", F.concat_ws("/", "dim", "a", "b", "label"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = (
        dealt.select("key", "a", "b", "part", "gid", "copies", "dim", "vector", "corner", "planes", "angle", "low", "step", "lost", "levels", "above")
        .repartition(parts, "key")
        .sortWithinPartitions("key", "part", "gid")
    )
    found = materialize(_tile_counts(tiles, threshold), "vector-links")
    others = found.groupBy("gid").agg(F.sum("others").alias("others"))
    links = found.where("gid <> joined").select(F.col("gid").alias("src"), F.col("joined").alias("dst")).distinct()
    parts_of = components(links, folded.select(F.col("gid").alias("id"))).withColumnRenamed("id", "gid")
    named = cut(folded.select("gid", "least").join(parts_of, "gid"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = (
        folded.select("label", "embedding", "gid", "copies")
        .join(named.select("gid", "component"), "gid")
        .join(names, "component")
        .join(others, "gid", "left")
        .select("label", "embedding", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    linked_rows = fit.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
