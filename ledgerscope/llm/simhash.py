"""Near-duplicates by 64-bit fingerprints of word shingles (op7).

1. Fingerprints: one narrow pass. Shingles of four words, hashed by XXH64; a bit is set when it is set in over half
   of a text's hashes. Texts with fewer words hash as one shingle; no words give fingerprint zero.
2. Equal fingerprints fold into one row before anything is compared, so copies cost nothing further.
3. Two fingerprints that differ in at most four of six blocks' bits share at least two whole blocks. Each distinct
   fingerprint goes under its 15 pairs of blocks; keys met once are dropped.
4. Keys of over ``tile`` fingerprints are cut by a hash into parts, and every two parts meet in a task of their own;
   this bounds a task, not the result. A tile is compared by bit planes (``bit_planes``) and returns a spanning set
   of its links, so links grow with the fingerprints and never with their pairs.
5. The links are joined into components; every document takes the smallest doc_id of its component.

Rows: null text counts as empty and gets fingerprint zero, which links like any other. Very long texts are taken whole, in
memory in proportion to the one text. A bit set in exactly half of the hashes is 0. A null doc_id is a document
like any other but never names a component unless all in it are null. Repeated rows link to each other. An empty
table gives an empty result. Extra columns are kept by ``keep_one`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.bit_planes import neighbours, spanning
from ledgerscope.operators.graph_walks import components
from ledgerscope.session import cut, materialize

SHINGLE = 4
RADIUS = 4
# Six blocks of the 64 bits, as (first bit, width).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
TILE = 2048


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only the six ASCII spaces part words
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct column ``row`` with all columns as they are, and ``fp``: the fingerprint's bits as a signed long."""
    schema = docs.select(F.struct("*").alias("row")).schema
    kept = [f.name for f in schema["row"].dataType]
    place = kept.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(place).to_pylist()
            marks = np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows, pa.array(marks)], names=["row", "fp"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(work, schema.add("fp", "long"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp). One narrow pass over the two columns."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["doc_id", "fp"])

    return base.mapInArrow(work, "doc_id long, fp long")


def block_keys(fp: Column) -> Column:
    """The 15 keys of a fingerprint: two blocks' bits and which two they are, in one long."""
    bits = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << w) - 1) for a, w in BLOCKS]
    return F.array(
        *[
            F.shiftleft(F.shiftleft(bits[i], 11).bitwiseOR(bits[j]), 4).bitwiseOR(F.lit(n))
            for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )


def tile_links(tiles: DataFrame, radius: int) -> DataFrame:
    """(src, dst): spanning links of each tile of (key, a, b, part, fp), rows of one tile adjacent and ordered by part.

    In a tile of one part all rows meet; in a tile of two parts the rows of one meet those of the other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            if len(changes) == 0:
                held = rows
                continue
            held = rows[changes[-1] :]
            yield from links(rows[: changes[-1]])
        if held is not None and len(held):
            yield from links(held)

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        fp = rows[:, 4].copy().view(np.uint64)
        new_tile = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        starts = np.flatnonzero(new_tile)
        tile = np.cumsum(new_tile) - 1
        ends = np.concatenate((starts[1:], [n]))[tile]
        same = rows[:, 1] == rows[:, 2]
        first_part = rows[:, 3] == rows[:, 1]
        in_first = np.add.reduceat(first_part.astype(np.int64), starts)[tile]
        low = np.where(same, np.arange(n) + 1, starts[tile] + in_first)
        high = np.where(same | first_part, ends, 0)
        part = spanning(n, neighbours(fp, low, high, radius))
        child = np.flatnonzero(part != np.arange(n))
        if len(child):
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[part[child]])], names=["src", "dst"])

    return tiles.mapInArrow(work, "src long, dst long")


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) links that connect the distinct fingerprints within the radius, both as longs."""
    if radius > 4:
        raise ValueError("six blocks find four differing bits")
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("long")
    met = keyed.join(sizes, "key").select(
        "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp", F.lit(7)), parts).alias("part")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiles = met.select("key", "fp", "part", other.alias("other")).select(
        "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp"
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "part", "fp")
    return tile_links(dealt, radius).distinct()


def component_of_fingerprints(marked: DataFrame) -> DataFrame:
    """(fp, component): over (fp); the component is named by its smallest fingerprint."""
    distinct = cut(marked.select("fp").distinct())
    return components(cut(near_links(distinct)), distinct.select(F.col("fp").alias("id"))).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per document row."""
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    parts = component_of_fingerprints(marked)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = cut(least.join(parts, "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def groups(texts: DataFrame) -> DataFrame:
    """(place, group) over (place, text): rows of one component of fingerprints share a group. Rows alone are left out."""
    marked = materialize(fingerprints(texts, "place").withColumnRenamed("doc_id", "place"), "fingerprints")
    parts = component_of_fingerprints(marked)
    named = cut(marked.join(parts, "fp").select("place", F.col("component").alias("group")))
    several = named.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("group")
    return named.join(several, "group", "left_semi").select("place", "group")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The given columns of one document per component: that of the smallest doc_id (nulls last), first as written."""
    marked = materialize(
        with_fingerprint(docs, text).withColumn("place", F.monotonically_increasing_id()), "marked-documents"
    )
    own = F.col("row").getField(doc_id)
    best = F.min(F.struct(own.isNull().alias("no_id"), own.alias("id"), F.col("place").alias("place"))).alias("best")
    firsts = cut(marked.groupBy("fp").agg(best).join(component_of_fingerprints(marked), "fp"))
    kept = firsts.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.place").alias("place"))
    return marked.join(kept, "place", "left_semi").select("row.*")
