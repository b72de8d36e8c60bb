"""Near copies by the Jaccard similarity of word shingles (the pipeline's near-duplicate stage).

1. One narrow pass makes the set of a text's five-word shingles, hashed by XXH64. Texts with fewer words are one shingle,
   texts without words the empty set. Equal sets fold into one before anything is compared.
2. A set goes under 16 keys of four least hashes each. Two sets of similarity s meet under one of them with probability
   1 - (1 - s^4)^16: 99.98 % at 0.8, more above. Keys met once are dropped.
3. Sets that meet are compared as a whole, so a link is always true. Keys of few sets are listed in pairs, each pair
   once; larger ones are tiles. Keys of over ``tile`` sets are cut by a hash into parts, and every two parts meet in a
   task of their own; a tile returns a spanning set of its links.
4. The links are joined into components; the document of the smallest doc_id stays.

Rows: null text counts as empty. Texts without a word are copies of each other. Texts of any length are taken whole, in
memory in proportion to the one text. Of documents of one id, the first as written stays; null ids come last. Repeated
rows are copies, so one stays. An empty table gives an empty table. All columns are kept, whatever their names. Sets are
told apart by a 64-bit digest: among ten billion distinct ones a few pairs are expected to share theirs and to be taken
as equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ledgerscope.operators.graph_walks import components
from ledgerscope.session import cut, materialize

SHINGLE = 5
# Least similarity of near copies as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 16, 4
TILE = 512
# Sets of a key up to which they are listed in pairs.
FEW = 8

_draw = np.random.default_rng(5)
MIX = _draw.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
MIX[1] |= np.uint64(1)  # odd factors permute the 64-bit numbers
# Places of documents left out that are broadcast, eight bytes each and as much for their table.
MAX_OUT = 4_000_000


def shingle_set(text: str, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64))


def set_keys(tokens: np.ndarray) -> np.ndarray:
    """The keys of a set, one a band; none for the empty set."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 1 << 12):
        block = (tokens[at : at + (1 << 12), None] ^ MIX[0]) * MIX[1]
        least = np.minimum(least, block.min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(bands)], np.uint64).view(np.int64)


def with_set(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct column ``row`` with all columns as they are, ``mark``: a digest of the set, and ``keys``."""
    schema = docs.select(F.struct("*").alias("row")).schema
    place = [f.name for f in schema["row"].dataType].index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            marks, keys = [], []
            for t in rows.field(place).to_pylist():
                tokens = shingle_set(t or "")
                marks.append(xxhash.xxh64_intdigest(tokens.tobytes(), 1))
                keys.append(set_keys(tokens))
            held = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows, held, pa.array(keys, pa.list_(pa.int64()))], names=["row", "mark", "keys"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(work, schema.add("mark", "long").add("keys", ArrayType(LongType())))


def sets_of(texts: DataFrame) -> DataFrame:
    """(mark, tokens) over (mark, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingle_set(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["mark", "tokens"])

    return texts.mapInArrow(work, "mark long, tokens binary")


def tile_spanning(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Each row's part in a tile. Rows below ``first`` meet those from it on; at ``first`` 0 all rows meet.

    Rows that are joined already are not compared again.
    """
    n = len(sets)
    part = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    names, local = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(names), np.int64)
    for i in range(first or n):
        apart = part != part[i]
        apart[: first or i + 1] = False
        if not apart.any():
            continue
        own = local[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        both = np.add.reduceat(marked[local], starts)
        marked[own] = 0
        found = np.flatnonzero(apart & (both * SIMILAR[1] >= SIMILAR[0] * (sizes[i] + sizes - both)))
        if len(found):
            joined = np.isin(part, np.append(part[found], part[i]))
            part[joined] = part[joined].min()
    return part


def tile_links(tiles: DataFrame) -> DataFrame:
    """(src, dst): spanning links of each tile of (key, a, b, part, mark, tokens), rows of one tile adjacent and ordered
    by part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            src, dst = [], []
            *numbers, tokens = batch.columns
            for *at, part, mark, blob in zip(*(c.to_pylist() for c in numbers), tokens.to_pylist()):
                if at != tile:
                    links(tile, held, src, dst)
                    tile, held = at, []
                held.append((part, mark, blob))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        src, dst = [], []
        links(tile, held, src, dst)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def links(tile: list | None, held: list, src: list, dst: list) -> None:
        if len(held) < 2:
            return
        first = 0 if tile[1] == tile[2] else sum(h[0] == tile[1] for h in held)
        if tile[1] != tile[2] and not 0 < first < len(held):
            return
        part = tile_spanning([np.frombuffer(h[2], np.uint64) for h in held], first)
        for child in np.flatnonzero(part != np.arange(len(held))).tolist():
            src.append(held[child][1])
            dst.append(held[part[child]][1])

    return tiles.mapInArrow(work, "src long, dst long")


def near_links(marked: DataFrame, firsts: DataFrame, text: str = "text", tile: int = TILE) -> DataFrame:
    """(src, dst) links that connect the marks of near copies. ``firsts`` is (mark, keys, place), one row a distinct set.

    Sets of a small key meet pair by pair, each pair once whatever the number of its keys; the others meet in tiles.
    Only sets that meet any are made again from their texts.
    """
    keyed = firsts.select("mark", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keyed.join(sizes, "key"))
    few = met.where(F.col("n") <= FEW).select("key", "mark")
    pairs = few.join(few.withColumnRenamed("mark", "other"), "key").where("mark < other").select("mark", "other").distinct()
    zero = F.lit(0).cast("long")
    paired = pairs.select(F.xxhash64("mark", "other").alias("key"), F.explode(F.array("mark", "other")).alias("mark")).select(
        "key", zero.alias("a"), zero.alias("b"), zero.alias("part"), "mark"
    )
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("long")
    dealt = met.where(F.col("n") > FEW).select(
        "key", "mark", parts.alias("parts"), F.pmod(F.xxhash64("mark", F.lit(7)), parts).alias("part")
    )
    other = F.explode(F.sequence(zero, F.col("parts") - 1))
    tiles = dealt.select("key", "mark", "part", other.alias("other")).select(
        "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "mark"
    )
    wanted = firsts.select("mark", "place").join(met.select("mark").distinct(), "mark")
    texts = marked.select("place", F.col("row").getField(text).cast("string").alias("text")).join(wanted, "place")
    whole = paired.union(tiles).join(sets_of(texts.select("mark", "text")), "mark").select("key", "a", "b", "part", "mark", "tokens")
    n = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tile_links(whole.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "part", "mark")).distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The given columns of one document per component: that of the smallest doc_id (nulls last), first as written.

    ``also`` takes (place, text) and gives (place, group): documents of one group are linked as well.
    """
    marked = materialize(with_set(docs, text).withColumn("place", F.monotonically_increasing_id()), "marked-documents")
    own = F.col("row").getField(doc_id)
    best = F.min(F.struct(own.isNull().alias("no_id"), own.alias("id"), F.col("place").alias("place"))).alias("best")
    # Equal sets have equal keys, so the keys are those of any row.
    firsts = cut(marked.groupBy("mark").agg(best, F.first("keys").alias("keys")))
    links = near_links(marked, firsts.select("mark", "keys", F.col("best.place").alias("place")), text)
    if also is not None:
        groups = also(marked.select("place", F.col("row").getField(text).alias("text")))
        # Every mark of a group is linked to the group's smallest.
        grouped = cut(groups.join(marked.select("place", "mark"), "place").select("group", "mark").distinct())
        least = grouped.groupBy("group").agg(F.min("mark").alias("least"))
        links = links.union(grouped.join(least, "group").where("mark <> least").select("mark", "least"))
    named = components(cut(links), firsts.select(F.col("mark").alias("id"))).withColumnRenamed("id", "mark")
    kept = firsts.join(named, "mark").groupBy("component").agg(F.min("best").alias("best"))
    kept = cut(kept.select(F.col("best.place").alias("place")))
    # Documents left out are the fewer: as long as a task can hold their places, no text is shuffled to find the others.
    out = cut(marked.select("place").join(kept, "place", "left_anti"))
    if out.count() <= MAX_OUT:
        return marked.join(F.broadcast(out), "place", "left_anti").select("row.*")
    return marked.join(kept, "place", "left_semi").select("row.*")
