"""Token-id files compressed by a pair grammar (op3).

Documents are encoded, an end id is appended to each, and the ids are written in ascending doc_id order as
containers of about ``shard_tokens`` ids. In a container, frequent adjacent pairs are replaced by new symbols
until no pair is frequent (Re-Pair): a round takes the frequent ones best first such that no symbol is the right end
of one chosen pair and the left end of another, so that chosen pairs never overlap, and replaces them all. A pair never holds an end id; a document therefore begins at a symbol, and any document can be read
alone. The rules and every symbol's expansion length are stored; the lengths lead to a token position inside a
document without expanding what comes before it.

Container layout, little-endian: magic ``RPG1``, then 6 unsigned 32-bit numbers (base = first symbol that is a
rule, rules, symbols, documents, bytes a symbol (2 or 4), end id), rules as pairs of unsigned 32-bit symbols,
expansion lengths (u32), document offsets in symbols (u64, one more than documents), then the symbols.
Containers are rows of a Parquet table in the shared folder, so Spark commits them and any executor reads them.

Rows: null text is an empty text: its ids are the end id alone. A null doc_id sorts first. Repeated doc_ids are
ordered by a hash of their text. Very long texts take memory in proportion to the one text, and a container ends behind
them. An empty table gives no containers and no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerscope.llm.memo import Memo
from ledgerscope.llm.token_counts import LATIN_WORDS, LONGEST_REMEMBERED, byte_letters, safe_pieces, splits_at_blanks
from ledgerscope.session import work_path

VOCABULARY = "byte_bpe_50k.json"
END = 2
MAGIC = b"RPG1"
HEAD = struct.Struct("<4s6I")
CONTAINERS = "pid int, seq int, n_docs long, n_tokens long, doc_ids binary, blob binary"


class IdEncoder:
    """The library's ids of whole texts. A text is cut into pieces that do not depend on each other; a piece, and each
    word of a new piece, goes through the library's model once while it is remembered."""

    def __init__(self, path: str, remember: int = 1_600_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        # Pieces after a blank, without it; other pieces; single words.
        self.after_blank, self.plain, self.words = Memo(remember), Memo(remember // 8), Memo(remember // 2)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word_ids(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            written = word.replace(" ", self.letters[32])
        else:
            written = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def make(self, piece: str, prefix: str) -> bytes:
        whole = prefix + piece
        latin = piece.isascii() or max(piece) < "\u0100"
        if latin and prefix and piece.isalpha():
            # A word by itself, remembered as a piece; other pieces find it there.
            return self.words.young.get(whole) or self.word_ids(whole)
        if latin:
            words = LATIN_WORDS.findall(whole)
        else:
            words = [whole[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]
        out, beside = [], self.after_blank.young.get
        for word in words:
            ids = self.words.young.get(word) or (beside(word[1:]) if word[0] == " " else None) or self.words.recall(word)
            if ids is None:
                ids = self.word_ids(word)
                if len(word) <= LONGEST_REMEMBERED:
                    self.words.put(word, ids)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def fill(self, pieces: list[str], found: list[bytes | None], memo: Memo, prefix: str) -> bytes:
        """Joins what is known of the pieces with what is made now."""
        if None in found:
            make, known, recall, put = self.make, memo.young.get, memo.recall, memo.put
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    # A new piece may stand in the text twice.
                    ids = known(piece) or recall(piece)
                    if ids is None:
                        ids = make(piece, prefix)
                        if len(piece) <= LONGEST_REMEMBERED:
                            put(piece, ids)
                    found[i] = ids
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            data = self.library(text)
        elif splits_at_blanks(text):
            pieces = text.split(" ")
            first = pieces[:1]
            pieces[0] = ""
            head = self.fill(first, [self.plain.young.get(first[0])], self.plain, "") if text else b""
            found = list(map(self.after_blank.young.get, pieces))
            found[0] = head
            data = self.fill(pieces, found, self.after_blank, " ")
        else:
            pieces = safe_pieces(text)
            data = self.fill(pieces, list(map(self.plain.young.get, pieces)), self.plain, "")
        return np.frombuffer(data, "<u4")


@functools.cache
def encoder(path: str) -> IdEncoder:
    """One per worker process and file; Spark runs the processes, so the library starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return IdEncoder(path)


def choose(lefts: np.ndarray, rights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the pairs to replace, best first, such that no symbol ends one of them and starts another. A pair of
    equal symbols is both and stands alone."""
    taken, starts, ends = [], set(), set()
    for p in np.argsort(-counts, kind="stable").tolist():
        left, right = int(lefts[p]), int(rights[p])
        if left not in ends and right not in starts and (left != right or left not in starts and left not in ends):
            starts.add(left)
            ends.add(right)
            taken.append(p)
    return np.array(sorted(taken), np.int64)


def compress(ids: np.ndarray, end: int, least: int = 8, per_round: int = 8000) -> tuple[int, np.ndarray, np.ndarray]:
    """(base, rules, symbols): rounds of replacement until no pair is met ``least`` times.

    A replacement only makes pairs with the new symbol, so a pair once met too seldom stays so: a round looks at the
    places of pairs that were frequent or lie beside a replaced one, and the sequence is linked, so that its other places
    cost nothing. ``per_round`` is how many of the frequent pairs one round looks at; the others wait for the next. In a
    run of equal symbols a pair of two of them is met every second place, from the left.
    """
    n, base = len(ids), int(ids.max()) + 1 if len(ids) else 0
    seq = np.append(ids, end).astype(np.uint32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    kept = np.ones(n + 1, bool)
    rules: list[np.ndarray] = []
    made = 0
    live = np.flatnonzero((seq[:-1] != end) & (seq[1:] != end)).astype(np.int32)
    while len(live) >= least:
        # Pairs are one number of 32 bits as long as symbols have 16.
        narrow = base + made + per_round <= 1 << 16
        key_type, shift = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
        left, right = seq[live].astype(key_type, copy=False), seq[after[live]].astype(key_type, copy=False)
        keys = (left << shift) | right
        inner = np.sort(keys)
        edges = np.flatnonzero(np.concatenate(([True], inner[1:] != inner[:-1], [True])))
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= least)
        if len(often) == 0:
            break
        found, counts = inner[edges[often]], counts[often]
        lefts, rights = found >> shift, found & ((key_type(1) << shift) - key_type(1))
        # Twins: of places of a pair of equal symbols that follow each other only every second one counts.
        twins = np.flatnonzero(left == right)
        if len(twins):
            once = keys[twins][spaced(live[twins], after)]
            same = np.flatnonzero(lefts == rights)
            once = np.sort(once)
            counts[same] = np.searchsorted(once, found[same], "right") - np.searchsorted(once, found[same], "left")
        enough = np.flatnonzero(counts >= least)
        if len(enough) == 0:
            break
        best = enough
        if len(best) > per_round:
            best = np.sort(best[np.argsort(-counts[best], kind="stable")[:per_round]])
        taken = best[choose(lefts[best], rights[best], counts[best])]
        is_left, is_right = np.zeros(base + made, bool), np.zeros(base + made, bool)
        is_left[lefts[enough]], is_right[rights[enough]] = True, True
        near = np.flatnonzero(is_left[left] & is_right[right])
        live, keys, left, right = live[near], keys[near], left[near], right[near]
        is_left[:], is_right[:] = False, False
        is_left[lefts[taken]], is_right[rights[taken]] = True, True
        near = np.flatnonzero(is_left[left] & is_right[right])
        place = np.minimum(np.searchsorted(found[taken], keys[near]), len(taken) - 1)
        met = found[taken][place] == keys[near]
        near, place = near[met], place[met]
        twin = (lefts == rights)[taken][place]
        if twin.any():
            once = ~twin
            once[twin] = spaced(live[near[twin]], after)
            near, place = near[once], place[once]
        hit = near
        at, gone = live[hit], after[live[hit]]
        seq[at] = base + made + place
        kept[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        seen = np.zeros(n + 1, bool)
        seen[live] = seen[at] = seen[before[at]] = True  # before the first place is the one behind the last
        live = np.flatnonzero(seen[:-1] & kept[:-1]).astype(np.int32)
        live = live[(seq[live] != end) & (seq[after[live]] != end)]
        rules.append(np.stack([lefts[taken], rights[taken]], axis=1).astype("<u4"))
        made += len(taken)
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), "<u4"), seq[:-1][kept[:-1]]


def spaced(live: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Every second one of places that follow each other, from the first."""
    follows = np.concatenate(([False], after[live[:-1]] == live[1:])) if len(live) else np.zeros(0, bool)
    number = np.arange(len(live))
    return (number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids below each rule; a rule only uses symbols made before it."""
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1)
    return lengths


def pack(docs: list[np.ndarray], end: int) -> bytes:
    """One container of documents' ids, each closed by the end id."""
    ids = np.concatenate(docs)
    base, rules, symbols = compress(ids, end)
    lengths = expansion_lengths(base, rules)
    each = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    each[rule] = lengths[symbols[rule] - base]
    reached = np.concatenate(([0], np.cumsum(each)))
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    offsets = np.searchsorted(reached, starts)
    assert np.array_equal(reached[offsets], starts), "a document must begin at a symbol"
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(MAGIC, base, len(rules), len(symbols), len(docs), width, end)
    parts = rules.astype("<u4"), lengths.astype("<u4"), offsets.astype("<u8"), symbols.astype(f"<u{width}")
    return head + b"".join(x.tobytes() for x in parts)


class Container:
    """Reader of one container."""

    def __init__(self, blob: bytes) -> None:
        magic, self.base, n_rules, n_symbols, self.n_docs, width, self.end = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a container")
        at = HEAD.size
        self.rules = np.frombuffer(blob, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(blob, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.offsets = np.frombuffer(blob, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.symbols = np.frombuffer(blob, f"<u{width}", n_symbols, at)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    @functools.cached_property
    def rule_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rules one after another, where each rule's begin)."""
        starts = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = np.zeros(starts[-1], "<u4")
        base, at = self.base, starts.tolist()
        for i, pair in enumerate(self.rules.tolist()):
            here = at[i]
            for s in pair:
                if s < base:
                    flat[here] = s
                    here += 1
                else:
                    size = at[s - base + 1] - at[s - base]
                    flat[here : here + size] = flat[at[s - base] : at[s - base + 1]]
                    here += size
        return flat, starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols."""
        flat, starts = self.rule_ids
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.repeat(symbols.astype("<u4"), sizes)
        rules = np.flatnonzero(symbols >= self.base)
        if len(rules):
            # Places of rule symbols in the output, and the places in ``flat`` they copy from.
            width = sizes[rules]
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            into = np.repeat(ends[rules] - width, width) + step
            out[into] = flat[np.repeat(starts[symbols[rules].astype(np.int64) - self.base], width) + step]
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of one document, its end id included."""
        return self.expand(self.symbols[self.offsets[k] : self.offsets[k + 1]])

    def slice(self, k: int, first: int, last: int) -> np.ndarray:
        """Ids first..last-1 of a document; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.offsets[k] : self.offsets[k + 1]]
        reached = np.concatenate(([0], np.cumsum(self.sizes(symbols))))
        a = max(0, int(np.searchsorted(reached, first, "right")) - 1)
        b = int(np.searchsorted(reached, last, "left"))
        return self.expand(symbols[a:b])[first - reached[a] : last - reached[a]]

    def documents(self) -> list[np.ndarray]:
        bounds = np.concatenate(([0], np.cumsum(self.sizes(self.symbols))))[self.offsets]
        whole = self.expand(self.symbols)
        return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def write_shards(
    docs: DataFrame,
    out_path: str,
    path: str | None = None,
    end: int = END,
    shard_tokens: int = 1_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encodes, orders by doc_id and writes the containers to ``out_path``.

    One shuffle, by ranges of (doc_id, text): a range takes any number of equal doc_ids apart. A task holds one
    container's ids and one Arrow batch. Container (pid, seq) order is doc_id order.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        pid, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def container() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([pid], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([pack_names(names)], pa.binary()),
                    pa.array([pack(ids, end)], pa.binary()),
                ],
                names=["pid", "seq", "n_docs", "n_tokens", "doc_ids", "blob"],
            )

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(name)
                ids.append(np.append(encode(text or ""), np.uint32(end)))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield container()
                    ids, names, held, seq = [], [], 0, seq + 1
        if ids:
            yield container()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(work, CONTAINERS).write.parquet(out_path)


def pack_names(names: list[int | None]) -> bytes:
    """doc_ids with a leading bit row for nulls."""
    null = np.array([n is None for n in names], np.uint8)
    return null.tobytes() + np.array([0 if n is None else n for n in names], "<i8").tobytes()


def unpack_names(stored: bytes, n: int) -> list[int | None]:
    null = np.frombuffer(stored, np.uint8, n)
    return [None if z else v for z, v in zip(null.tolist(), np.frombuffer(stored, "<i8", n, n).tolist())]


def read_shards(containers: DataFrame) -> DataFrame:
    """(pid, seq, doc_id, at, n_tokens, ids_crc32) read back from containers; ``at`` counts within one container."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                box = Container(row["blob"])
                docs = box.documents()
                sizes = np.array([len(d) for d in docs], np.int64)
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["pid"]] * len(docs), pa.int32()),
                        pa.array([row["seq"]] * len(docs), pa.int32()),
                        pa.array(unpack_names(row["doc_ids"], len(docs)), pa.int64()),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                    ],
                    names=["pid", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return containers.select("pid", "seq", "doc_ids", "blob").mapInArrow(
        work, "pid int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )


def container_starts(containers: DataFrame) -> DataFrame:
    """(pid, seq, before): ids in all containers ahead. The window without a key runs over one row a range
    partition; within a range partition its containers are few."""
    sizes = containers.select("pid", "seq", "n_tokens")
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("pid").agg(F.sum("n_tokens").alias("total")).select(
        "pid", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.select("pid", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("ahead"))
    return local.join(ranges, "pid").select("pid", "seq", (F.col("base") + F.col("ahead")).alias("before"))


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files below the shared folder, reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    place = work_path(spark, "token-shards")
    write_shards(docs, place, path, **options)
    schema = CONTAINERS
    containers = spark.read.schema(schema).parquet(place)
    rows = read_shards(containers)
    return rows.join(container_starts(containers), ["pid", "seq"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
