"""Token counts of every prefix of a text (op10).

``prefix_counts`` stores, per document, how the exact token count changes with each character: one signed
byte a character. The running sum at character i is the number of tokens the tokenizer gives text[:i], so
truncation and budget questions are answered from the table, without encoding anything again. Counts of
prefixes are not monotone (a longer prefix may merge into fewer tokens), hence ``longest_within`` looks for
the last prefix that fits.

The byte-level BPE splits a text into words first. A blank between two characters that are not white space
always starts a word, so a text is cut there, and the pieces between are independent: each distinct piece is
put through the prefix table once and remembered. The words of a piece are those of the tokenizer's own
pre-tokenizer. The two places where a cut prefix is split otherwise than the whole text are handled: a run of
white space before a word, and contractions and special tokens that end inside the prefix.

Rows: null text counts as empty. Empty texts have 0 tokens and an empty table. Repeated rows are counted each.
Columns other than the two named are not read. Documents are worked on one by one; memory is bounded by one
Arrow batch and by the remembered pieces (``remember``).
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerscope.llm.memo import Memo
from ledgerscope.llm.prefix_bpe import PrefixTable

VOCABULARY = "byte_bpe_50k.json"
# White space other than the blank: the Unicode White_Space property, fixed values.
OTHER_SPACE = (
    "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RARE_SPACE = OTHER_SPACE.replace("\n", "")
SPACE = re.compile(f"[ {OTHER_SPACE}]")
# Two or more white space characters before something else.
CUT_RUN = re.compile(f"[ {OTHER_SPACE}]{{2}}[^ {OTHER_SPACE}]")
# The tokenizer's word pattern over the characters below 256: their letters, numbers and white space, fixed values.
LETTERS, NUMBERS, BLANKS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+"
    rf"|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
LONGEST_REMEMBERED = 40


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where it is printable, the
    others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


def splits_at_blanks(text: str) -> bool:
    """Whether every blank stands between two characters that are not white space."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text and (f"{c} " in text or f" {c}" in text) for c in RARE_SPACE)


def safe_pieces(text: str) -> list[str]:
    """Cuts a text before blanks where the words on both sides do not depend on each other.

    Each piece but the first keeps its leading blank.
    """
    if splits_at_blanks(text):
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]
    out, start = [], 0
    for m in re.finditer(f"(?<=[^ {OTHER_SPACE}]) (?=[^ {OTHER_SPACE}])", text):
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


class PrefixCounter:
    """Counts by prefix for one byte-level BPE tokenizer file."""

    def __init__(self, path: str, remember: int = 800_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        # The file writes bytes in an alphabet of printable characters; here a byte is the character of its number.
        byte_of = {c: chr(b) for b, c in enumerate(byte_letters())}
        plain = lambda token: "".join(map(byte_of.__getitem__, token))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = PrefixTable(
            [plain(t) for t in spec["model"]["vocab"] if t not in self.special], lambda a, b: ranks.get((a, b))
        )
        self.special_cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known, self.known_words = Memo(remember), Memo(remember)

    def split(self, text: str) -> list[str]:
        """The tokenizer's words of an ordinary text."""
        if max(text, default="") < "\u0100":
            return LATIN_WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def word_changes(self, word: str) -> bytes:
        """Changes of the count per character inside a word that no prefix splits."""
        made = self.known_words.young.get(word) or self.known_words.recall(word)
        if made is None:
            if word.isascii():
                counts = self.words.counts(word)
            else:
                inner = self.words.counts(word.encode().decode("latin-1"))
                counts = [inner[i] for i in accumulate((len(c.encode()) for c in word), initial=0)]
            if len(counts) < 128:
                made = bytes([(b - a) & 255 for a, b in pairwise(counts)])
            else:
                made = as_bytes(np.diff(counts))
            if len(word) <= LONGEST_REMEMBERED:
                self.known_words.put(word, made)
        return made

    def total(self, text: str) -> int:
        """Tokens of an ordinary text."""
        return sum(int(from_bytes(self.word_changes(w)).sum()) for w in self.split(text))

    def piece_changes(self, piece: str) -> bytes:
        """Changes per character of a piece, each prefix split on its own."""
        words = self.split(piece)
        contraction = "'" in piece and any(w[0] == "'" and w[1:2].isalpha() for w in words)
        if not contraction and not CUT_RUN.search(piece):
            return b"".join(map(self.word_changes, words))
        reached: list[int] = []
        base = 0
        run: tuple[int, int] | None = None
        for k, word in enumerate(words):
            start = len(reached)
            inside = (base + np.cumsum(from_bytes(self.word_changes(word)))).tolist()
            total = inside[-1]
            if word[0] == "'" and word[1:2].isalpha():
                # A contraction is one word only when whole.
                inside[1:-1] = [base + self.total(word[:i]) for i in range(2, len(word))]
            if run:
                # The prefix that ends with a whole run of white space keeps the run together.
                inside[0] = run[1] + self.total(piece[run[0] : start + 1])
            run = None
            if SPACE.match(word[-1]) and k + 1 < len(words) and SPACE.match(words[k + 1][0]):
                run = start, base
            reached += inside
            base = total
        return as_bytes(np.diff(reached, prepend=0))

    def plain_changes(self, text: str) -> bytes:
        """Changes per character, as signed bytes, of a text without special tokens."""
        if not text:
            return b""
        known, make = self.known.young.get, self.make_piece
        return b"".join([known(x) or make(x) for x in safe_pieces(text)])

    def make_piece(self, piece: str) -> bytes:
        made = self.known.recall(piece)
        if made is None:
            made = self.piece_changes(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                self.known.put(piece, made)
        return made

    def deltas(self, text: str) -> bytes:
        """Changes per character of a whole text; special tokens count one when complete."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return self.plain_changes(text)
        parts, at = [], 0
        for m in self.special_cut.finditer(text):
            before = text[at : m.start()]
            reached = np.cumsum(from_bytes(self.plain_changes(before + m[0])))
            reached[-1] = self.total(before) + 1
            parts.append(as_bytes(np.diff(reached, prepend=0)))
            at = m.end()
        parts.append(self.plain_changes(text[at:]))
        return b"".join(parts)


def as_bytes(changes: np.ndarray) -> bytes:
    """One signed byte a change. A change of over 127 cannot arise from one character of at most 4 bytes unless
    a longer prefix loses as many tokens; that is refused rather than stored wrongly."""
    if len(changes) and (changes.max() > 127 or changes.min() < -128):
        raise ValueError("a count changes by more than a byte holds")
    return changes.astype(np.int8).tobytes()


def from_bytes(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, np.int8).astype(np.int64)


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One per worker process and file."""
    return PrefixCounter(path)


def _arrays(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    count = counter(path)
    tables, sizes, totals = [], [], []
    for text in batch.column(1).to_pylist():
        text = text or ""
        table = count.deltas(text)
        tables.append(table)
        sizes.append(len(text.encode()))
        totals.append(int(np.frombuffer(table, np.int8).sum(dtype=np.int64)))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(tables, pa.binary())],
        names=["doc_id", "n_bytes", "n_tokens", "changes"],
    )


def prefix_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, changes): the stored table of each document. One narrow pass, no shuffle."""
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _arrays(batch, path)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, n_bytes long, n_tokens long, changes binary"
    )


def count_at(changes: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(np.frombuffer(changes, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    reached = np.cumsum(from_bytes(changes))
    fits = np.flatnonzero(reached <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncate(docs: DataFrame, budget: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row, cut to the longest prefix within a budget: one narrow pass that reads the cut off the
    row's own table, so that repeated and null ids keep their rows."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            kept = [t[: longest_within(count.deltas(t), budget)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(work, f"doc_id {kind}, text string")


def truncate_stored(docs: DataFrame, tables: DataFrame, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) as ``truncate``, from stored tables and without encoding anything.

    Rows find their table by id, null ids too. Repeated rows share one; an id whose tables cut differently, since its
    texts differ, is an error, and ``truncate`` is the way for such ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [longest_within(x, budget) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(cut, pa.int64())], names=["key", "keep"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    kept = tables.select(F.col("doc_id").alias("key"), "changes").mapInArrow(work, f"key {kind}, keep long")
    once = kept.groupBy("key").agg(F.min("keep").alias("keep"), F.max("keep").alias("other"))
    once = once.select("key", F.when(F.col("keep") == F.col("other"), F.col("keep")).otherwise(
        F.raise_error(F.format_string("id %s has tables of different texts", F.col("key").cast("string")))
    ).alias("keep"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = rows.join(once, F.col("doc_id").eqNullSafe(F.col("key")))
    return joined.select("doc_id", F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.col("keep").cast("int")).alias("text"))
