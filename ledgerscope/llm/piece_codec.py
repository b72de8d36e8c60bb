"""SentencePiece encoding and decoding by prefix tables (op5).

The model merges by the score of the joined piece, whichever two pieces make it up. ``PrefixTable`` holds each
prefix's unique last piece; ids come out backwards from the end of a word. Words are the stretches between
boundaries that no piece of the vocabulary crosses: before the blank sign after another character, and around
characters that occur in no piece of two characters or more (line ends, mostly). Characters without a piece
become their UTF-8 bytes. Distinct words go through the table once and are remembered (``remember``, per worker
process).

Rows: null text counts as empty, which encodes to the end id alone and decodes to empty text. Very long texts
take memory in proportion to the one text. Repeated rows are encoded each. Other columns are not read by
``encode``; ``encode_rows`` carries none of them either.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.memo import Memo
from ledgerscope.llm.prefix_bpe import PrefixTable

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
LONGEST_REMEMBERED = 40


class PieceCodec:
    """Encoder and decoder for one BPE model file with byte fallback and no user-defined pieces."""

    def __init__(self, path: str, remember: int = 800_000) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        texts = [m.id_to_piece(i) for i in plain]
        order = {p: -m.get_score(i) for p, i in zip(texts, plain)}
        self.words = PrefixTable(texts, lambda a, b: order.get(a + b))
        self.ids = [np.array([i], "<u4").tobytes() for i in plain]
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = m.eos_id()
        long = [p for p in texts if len(p) > 1]
        assert not any(BLANK in p.lstrip(BLANK) for p in long), "a piece crosses a word boundary"
        assert not any("\n" in p for p in long), "a piece crosses a line end"
        self.decimal = [str(i) for i in range(size)]
        # Ids of words that follow a blank, without it, and of all other words.
        self.after_blank, self.plain = Memo(remember), Memo(remember)

    def token_ids(self, token: int) -> bytes:
        if token < len(self.ids):
            return self.ids[token]
        return np.array([self.bytes[b] for b in self.words.texts[token].encode()], "<u4").tobytes()

    def make(self, word: str, memo: Memo, prefix: str = "") -> bytes:
        """Ids of a word, read backwards from its table and remembered."""
        made = memo.recall(word)
        if made is None:
            made = b"".join(map(self.token_ids, self.words.tokens(prefix + word)))
            if len(word) <= LONGEST_REMEMBERED:
                memo.put(word, made)
        return made

    def encode(self, text: str) -> np.ndarray:
        """Ids with the end id."""
        if not text:
            return np.array([self.end], "<u4")
        make, known_after, known = self.make, self.after_blank.young.get, self.plain.young.get
        out = []
        # The model writes blanks as its blank sign and puts one in front.
        for n, line in enumerate((" " + text.replace(BLANK, " ")).split("\n")):
            if n:
                out.append(known("\n") or make("\n", self.plain))
            if "  " in line or line[-1:] == " ":
                for word in re.findall(" +[^ ]*|[^ ]+", line):
                    word = word.replace(" ", BLANK)
                    out.append(known(word) or make(word, self.plain))
                continue
            first, *rest = line.split(" ")
            if first:
                out.append(known(first) or make(first, self.plain))
            out += [known_after(w) or make(w, self.after_blank, BLANK) for w in rest]
        out.append(np.array([self.end], "<u4").tobytes())
        return np.frombuffer(b"".join(out), "<u4")

    def written(self, ids: list[int]) -> str:
        """Ids as decimals joined by one blank."""
        decimal = self.decimal
        return " ".join([decimal[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@functools.cache
def codec(path: str) -> PieceCodec:
    """One per worker process and file."""
    return PieceCodec(path)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the model's ids of each whole text and the end id. One narrow pass."""
    path = path or public_tokenizers.path(MODEL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            ids = [pieces.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs, doc_id, text).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded rows; null ids decode to null."""
    path = path or public_tokenizers.path(MODEL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""
    path = path or public_tokenizers.path(MODEL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1).to_pylist():
                ids = pieces.encode(t or "").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(pieces.written(ids).encode()).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(docs, doc_id, text).mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
