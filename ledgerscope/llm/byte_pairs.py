"""Byte-level BPE by folds of higher-order functions over a block's distinct words (op11).

1. A narrow pass cuts texts into words and numbers the distinct ones of a block of documents; a block is one row: its
   words, and for every document their numbers. A task closes a block at ``BLOCK_WORDS`` distinct words or
   ``BLOCK_TEXT`` bytes of text, so a row is bounded but for the length of one text.
2. Higher-order functions fold each distinct word: it starts as the array of its bytes' ids, and the fold merges the
   pair of the lowest rank, the leftmost first, until no pair has one. The ranks are one literal map from a pair of ids
   to the id of the joined bytes, laid out as flat arrays (the rows of left ids shifted over one another), so that a
   lookup does not grow with the vocabulary. In a rank file a pair's rank is that id, whichever two tokens make the
   bytes up. Words of up to ``LONG_WORD`` bytes merge one place a step; in longer ones a step merges every place of the
   lowest rank, from the left and without overlap.
3. A last pass puts the ids of words together to those of documents. Decoding concatenates the tokens' bytes; an id
   outside the vocabulary is an error.

All three are one Spark stage without a shuffle.

Words are cut at the blanks that always begin a word, then by the split pattern. Letters and numbers are those of the
tokenizer's own patterns, whatever the Unicode version of the pattern library here.

Rows: null text counts as empty and gives no ids. Very long texts and words take memory in proportion to the one
text. Repeated rows are encoded each, ties do not arise, an empty table gives an empty table. doc_id is passed on with
its type, null ids too; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.token_counts import LATIN_WORDS, safe_pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Distinct words and bytes of text at which a block is closed, ids of one batch passed on.
BLOCK_WORDS = 1 << 18
BLOCK_TEXT = 1 << 25
BATCH_IDS = 1 << 22
# Words of more bytes merge all places of a rank at once; a place in a shorter one has so many bits.
LONG_WORD = 64
PLACE_BITS = 6
BLOCK = 64


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once."""
    return F.transform(F.array(value), body)[0]


def shifted_rows(rows: dict[int, dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a sparse matrix laid over one another: (shift of each row, owner of each place, value of each place).

    A row's entry of column c stands at the row's shift + c. Shifts are drawn until no place is taken twice."""
    spread = 1 << max(4, (3 * sum(map(len, rows.values()))).bit_length())
    owner, value = np.full(spread + width, -1, np.int64), np.zeros(spread + width, np.int64)
    shift, draw = np.zeros(width, np.int64), np.random.default_rng(11)
    for row, entries in sorted(rows.items(), key=lambda e: (-len(e[1]), e[0])):
        columns = np.fromiter(entries.keys(), np.int64)
        while True:
            tried = draw.integers(0, spread, 64)
            free = (owner[tried[:, None] + columns] < 0).all(axis=1)
            if free.any():
                break
        shift[row] = tried[free.argmax()]
        owner[shift[row] + columns], value[shift[row] + columns] = row, np.fromiter(entries.values(), np.int64)
    return shift, owner, value


def number_literal(values: list) -> Column:
    """array<bigint>, folded to a literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


@dataclass(frozen=True)
class Ranks:
    """The rank map: a matrix of left and right ids whose entries are the ids of the joined bytes.

    ``tables`` is the literal. Expressions meet it as the variable of one enclosing ``let``, so that a plan holds it
    once however often it is looked up; so do the other literals here. ``end`` is an id beyond the vocabulary, which
    joins with nothing; ids and ``end`` have ``bits`` bits. A cell holds the owner of its place above the joined id,
    so that a lookup taken apart by the left id is the joined id where it is the owner, and larger everywhere else."""

    tables: Column
    end: int

    @property
    def bits(self) -> int:
        return self.end.bit_length()

    @staticmethod
    def read(path: str) -> Ranks:
        ranks = read_ranks(path)
        rows: dict[int, dict[int, int]] = {}
        for joined, merged in ranks.items():
            for i in range(1, len(joined)):
                left, right = ranks.get(joined[:i]), ranks.get(joined[i:])
                if left is not None and right is not None:
                    rows.setdefault(left, {})[right] = merged
        end = max(ranks.values()) + 1
        shift, owner, value = shifted_rows(rows, end)
        cells = (np.where(owner < 0, 1 << end.bit_length(), owner) << end.bit_length()) + value
        # ``end`` is a row without entries and a column behind the last.
        parts = ([*shift.tolist(), 0], [*cells.tolist(), 1 << 2 * end.bit_length()], [ranks[bytes([b])] for b in range(256)])
        return Ranks(F.struct(*(number_literal(x).alias(n) for n, x in zip(("shift", "cells", "bytes"), parts))), end)

    def bound(self, tables: Column) -> Ranks:
        return Ranks(tables, self.end)

    def raw(self, left: Column, right: Column) -> Column:
        """id of the two joined, a number of more than ``bits`` bits if no token is made of them."""
        return F.get(self.tables["cells"], F.get(self.tables["shift"], left) + right).bitwiseXOR(F.shiftleft(left, self.bits))

    def of_pair(self, left: Column, right: Column) -> Column:
        """id of the two joined, null if no token is made of them or one is null."""
        return let(self.raw(left, right), lambda made: F.when(made < 1 << self.bits, made))


def _pair_ranks(ranks: Ranks, ids: Column) -> Column:
    """Rank of every id with its right neighbour, null where there is none."""
    return F.transform(ids, lambda x, i: ranks.of_pair(x, F.get(ids, i + 1)))


def _step_by_step(ranks: Ranks, ids: Column) -> Column:
    """ids after merging the leftmost pair of the lowest rank again and again.

    An id is one number with its rank with the right neighbour on top, its place in the word below that and the id
    itself at the bottom: the least number is the pair to merge, and its rank the id made. A step looks up the two new
    pairs only. ``end`` on both sides spares the borders; ``live`` has a bit for every place where an id begins, and
    the bits below a place say how many ids come before it."""
    bits = ranks.bits
    low = bits + PLACE_BITS
    none = 1 << bits + low
    places = (1 << low) - (1 << bits)
    id_of = lambda x: x.bitwiseAND((1 << bits) - 1)
    bit_of = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(x.bitwiseAND(places), bits).cast("int"))

    def merged(state: Column, least: Column, ahead: Column) -> Column:
        made, numbers = F.shiftright(least, low), state["numbers"]
        before = F.transform(
            F.slice(numbers, ahead + 1, 1), lambda b: F.shiftleft(ranks.raw(id_of(b), made), low) + b.bitwiseAND((1 << low) - 1)
        )
        after = F.get(numbers, ahead + 3)
        here = F.array(F.shiftleft(ranks.raw(made, id_of(after)), low) + least.bitwiseAND(places) + made)
        joined = F.flatten(F.array(F.slice(numbers, 1, ahead), before, here, F.slice(numbers, ahead + 4, LONG_WORD + 1)))
        return F.struct(joined.alias("numbers"), state["live"].bitwiseXOR(bit_of(F.get(numbers, ahead + 2))).alias("live"))

    def step(state: Column, _: Column) -> Column:
        def by_least(least: Column) -> Column:
            ahead = F.bit_count(state["live"].bitwiseAND(bit_of(least) - 1))
            return F.when(least >= none, state).otherwise(let(ahead, lambda n: merged(state, least, n)))

        return let(F.array_min(state["numbers"]), by_least)

    def first(x: Column, i: Column) -> Column:
        rank = ranks.raw(x, F.coalesce(F.get(ids, i + 1), F.lit(ranks.end)))
        return F.shiftleft(rank, low) + F.shiftleft(i.cast("bigint"), bits) + x

    border = F.array(F.lit(none + ranks.end).cast("bigint"))
    start = F.struct(F.concat(border, F.transform(ids, first), border).alias("numbers"), F.lit(-1).cast("bigint").alias("live"))
    return F.aggregate(ids, start, step, lambda s: F.transform(F.slice(s["numbers"], 2, F.size(s["numbers"]) - 2), lambda x: id_of(x).cast("int")))


def _merge_all(ranks: Ranks, ids: Column) -> Column:
    """ids with all pairs of the lowest rank joined from the left, none overlapping."""

    def step(state: Column, x: Column, rank: Column, lowest: Column) -> Column:
        """state: ids made so far and whether x already belongs to the pair before."""
        takes = ~state["used"] & rank.eqNullSafe(lowest)
        made = F.when(state["used"], state["made"]).otherwise(
            F.concat(state["made"], F.array(F.when(takes, lowest).otherwise(x)))
        )
        return F.struct(made.alias("made"), takes.alias("used"))

    def join(found: Column) -> Column:
        def by_lowest(lowest: Column) -> Column:
            none = F.array().cast("array<bigint>")

            def block(state: Column, start: Column) -> Column:
                pairs = F.arrays_zip(F.slice(ids, start, BLOCK).alias("x"), F.slice(found, start, BLOCK).alias("r"))
                inner = F.aggregate(
                    pairs,
                    F.struct(none.alias("made"), state["used"].alias("used")),
                    lambda s, p: step(s, p["x"], p["r"], lowest),
                )
                return let(
                    inner,
                    lambda b: F.struct(F.concat(state["blocks"], F.array(b["made"])).alias("blocks"), b["used"].alias("used")),
                )

            start = F.struct(F.array().cast("array<array<bigint>>").alias("blocks"), F.lit(False).alias("used"))
            merged = F.aggregate(
                F.sequence(F.lit(1), F.size(ids), F.lit(BLOCK)), start, block, lambda s: F.flatten(s["blocks"])
            )
            return F.when(lowest.isNull(), ids).otherwise(merged)

        return let(F.array_min(found), by_lowest)

    return F.when(F.size(ids) < 2, ids).otherwise(let(_pair_ranks(ranks, ids), join))


def _until_settled(ids: Column, merge: Callable[[Column], Column]) -> Column:
    """Folds ``merge`` over ids as often as the word is long; a step that changes nothing ends the work."""
    start = F.struct(ids.alias("ids"), (F.size(ids) < 2).alias("done"))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(
            let(
                merge(state["ids"]),
                lambda m: F.struct(m.alias("ids"), (F.size(m) == F.size(state["ids"])).alias("done")),
            )
        )

    return F.aggregate(ids, start, step, lambda s: s["ids"])


def word_ids(word: Column, ranks: Ranks, long_word: int = LONG_WORD) -> Column:
    """ids of one non-empty word."""
    # One character a byte, whose code is the byte.
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    first = F.transform(letters, lambda c: F.get(ranks.tables["bytes"], F.ascii(c)))
    return F.when(
        F.octet_length(word) <= long_word, let(first, lambda ids: _step_by_step(ranks, ids))
    ).otherwise(let(first, lambda ids: _until_settled(ids, lambda s: _merge_all(ranks, s))).cast("array<int>"))


def _members(pattern: str) -> set[int]:
    """Code points that a class of the tokenizer's own patterns holds."""
    single = {bytes([i]): i for i in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
    every = "\n".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return set(map(ord, bytes(probe.encode_ordinary(every)).decode()))


def _ranges(points: set[int]) -> str:
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)


@functools.cache
def split_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The pattern for the library here, its classes of letters and numbers brought to the tokenizer's."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name in (r"\p{L}", r"\p{N}"):
        known, meant = set(map(ord, regex.findall(name, every))), _members(name)
        # Every use stands within a class already or followed by +, where a class of its own means the same.
        made = f"[{name}{_ranges(meant - known)}]"
        if known - meant:
            made = f"[{made}--[{_ranges(known - meant)}]]"
        pattern = pattern.replace(name, made)
    return "(?V1)" + pattern


class Splitter:
    """Cuts texts into pieces at blanks and pieces into words."""

    def __init__(self, pattern: str) -> None:
        self.words = regex.compile(pattern)

    def split(self, piece: str) -> list[str]:
        return (LATIN_WORDS if max(piece, default="") < "\u0100" else self.words).findall(piece)

    def pieces(self, text: str) -> list[str]:
        return safe_pieces(text) if text else []


@functools.cache
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


class Block:
    """Documents of one row: distinct words, the words of each distinct piece, the pieces of each document."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        # The words of all pieces one after another, and where each piece's end.
        self.piece_words, self.piece_ends = array("I"), array("Q")
        self.docs: list[np.ndarray] = []
        self.names: list[pa.Array] = []
        self.text = 0

    def add(self, text: str, cutter: Splitter) -> None:
        parts, known = cutter.pieces(text), self.pieces
        found = list(map(known.get, parts))
        if None in found:
            words, items, ends = self.words, self.piece_words, self.piece_ends
            for k, at in enumerate(found):
                if at is None:
                    piece = parts[k]
                    at = known.get(piece)
                    if at is None:
                        at = known[piece] = len(ends)
                        if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece.isalpha()):
                            items.append(words.setdefault(piece, len(words)))  # a word by itself
                        else:
                            items.extend([words.setdefault(w, len(words)) for w in cutter.split(piece)])
                        ends.append(len(items))
                    found[k] = at
        self.docs.append(np.array(found, "<u4"))
        self.text += len(text)

    def row(self) -> pa.RecordBatch:
        names = pa.concat_arrays(self.names)
        binary = [(self.piece_ends.tobytes(), self.piece_words.tobytes()), flat(self.docs)]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([list(self.words)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(
            [*columns, *(pa.array([x], pa.binary()) for pair in binary for x in pair)],
            names=["names", "words", "piece_ends", "piece_words", "doc_ends", "doc_pieces"],
        )


def flat(parts: list) -> tuple[bytes, bytes]:
    """(ends, items) of many short lists of numbers."""
    ends = np.cumsum([len(p) for p in parts], dtype="<u8")
    items = np.concatenate([np.asarray(p, "<u4") for p in parts]) if parts else np.zeros(0, "<u4")
    return ends.tobytes(), items.tobytes()


class Parts:
    """Many short lists of numbers behind one another, put together again in any order."""

    def __init__(self, ends: np.ndarray, items: np.ndarray) -> None:
        self.starts = np.concatenate((np.zeros(1, np.int64), ends[:-1].astype(np.int64)))[: len(ends)]
        self.sizes, self.items = ends.astype(np.int64) - self.starts, items

    def joined(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items of the chosen lists one after another, ends of these)."""
        sizes = self.sizes[chosen]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[chosen] - (ends - sizes), sizes)
        return self.items[place], ends


def _blocks(docs: DataFrame, doc_id: str, text: str, block_words: int) -> DataFrame:
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    pattern = split_pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, block = splitter(pattern), Block()
        for batch in batches:
            first = 0
            for i, value in enumerate(batch.column(1).to_pylist()):
                block.add(value or "", cutter)
                if len(block.words) >= block_words or block.text >= BLOCK_TEXT:
                    block.names.append(batch.column(0).slice(first, i + 1 - first))
                    yield block.row()
                    first, block = i + 1, Block()
            if first < batch.num_rows:
                block.names.append(batch.column(0).slice(first))
        if block.docs:
            yield block.row()

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = "piece_ends binary, piece_words binary, doc_ends binary, doc_pieces binary"
    return given.mapInArrow(work, f"names array<{kind}>, words array<string>, {parts}")


def _document_ids(row: dict) -> Iterator[np.ndarray]:
    """ids of every document of a folded block."""
    ids = row["ids"]
    words = Parts(np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)), pc.list_flatten(ids).to_numpy().astype("<u4"))
    of_pieces, ends = words.joined(np.frombuffer(row["piece_words"], "<u4"))
    # Where the ids of each piece end: those of its last word.
    piece_ends = np.frombuffer(row["piece_ends"], "<u8").astype(np.int64)
    pieces = Parts(np.concatenate((np.zeros(1, np.int64), ends))[piece_ends], of_pieces)
    start, doc_pieces = 0, np.frombuffer(row["doc_pieces"], "<u4")
    for end in np.frombuffer(row["doc_ends"], "<u8").tolist():
        yield pieces.joined(doc_pieces[start:end])[0]
        start = end


def folded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, long_word: int = LONG_WORD) -> DataFrame:
    """Blocks of documents with the ids of their distinct words."""
    ranks = Ranks.read(path)
    ids = let(ranks.tables, lambda t: F.transform("words", lambda w: word_ids(w, ranks.bound(t), long_word)))
    return _blocks(docs, doc_id, text, block_words).select("names", ids.alias("ids"), "piece_ends", "piece_words", "doc_ends", "doc_pieces")


def _per_document(blocks: DataFrame, columns: str, made: Callable[[np.ndarray], tuple], kinds: list[pa.DataType]) -> DataFrame:
    """(doc_id, columns): what ``made`` makes of each document's ids."""
    kind = blocks.schema["names"].dataType.elementType.simpleString()
    labels = [c.split(" ")[0] for c in columns.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                names = row["names"].values
                row = {n: v.values if n == "ids" else v.as_py() for n, v in row.items() if n != "names"}
                rows, first, size = [], 0, 0
                for k, ids in enumerate(_document_ids(row), 1):
                    rows.append(made(ids))
                    size += len(ids)
                    if size >= BATCH_IDS or k == len(names):
                        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays([names.slice(first, k - first), *arrays], names=["doc_id", *labels])
                        rows, first, size = [], k, 0

    return blocks.mapInArrow(work, f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """(doc_id, ids array<int>): ids of each whole text, without special tokens."""
    blocks = folded(docs, path or public_tokenizers.path(VOCABULARY), **options)
    return _per_document(blocks, "ids array<int>", lambda ids: (ids.astype(np.int32),), [pa.list_(pa.int32())])


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: piece for piece, i in read_ranks(path).items()}


def concatenated(ids: list[int], path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, ids))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, data binary): the bytes of encoded rows (doc_id, ids); null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else concatenated(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them."""
    path = path or public_tokenizers.path(VOCABULARY)

    def made(ids: np.ndarray) -> tuple[int, str, str]:
        data = concatenated(ids.tolist(), path)
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()

    return _per_document(
        folded(docs, path, **options), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", made, [pa.int64(), pa.string(), pa.string()]
    )
