"""Fill-in-middle rearrangement with a sparse index of multibyte characters (op13).

A text is cut twice into prefix, middle and suffix, at units drawn from a digest of its id, and written with the
suffix ahead of the middle. Cuts are counted in code points, texts are sliced in bytes: ``SparseIndex`` records only
where characters of more than one byte stand and how many bytes they have beyond one, so that a position is turned by
one binary search and an addition, and stretches of ASCII cost nothing.

Forms: ``plain`` (the text as it is: empty, holding a sentinel, or not drawn), ``psm`` (<P>prefix<S>suffix<M>middle)
and ``spm`` (<S>suffix<P>prefix<M>middle). ``restore`` rebuilds the text from output and form alone.

Rows: null text counts as empty. Texts of any length take memory in proportion to the one text. Repeated rows give
repeated rows, equal ids draw alike whatever their text, a null id draws as the empty string. An empty table gives an
empty table. doc_id keeps its type; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Bytes of output after which a task passes a batch on.
BATCH_BYTES = 32 << 20


class SparseIndex:
    """Turns byte positions of one UTF-8 text into code-point positions and back."""

    def __init__(self, raw: np.ndarray) -> None:
        self.bytes = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.bytes]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(excess)))
        self.points = self.bytes - self.excess[:-1]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Of bytes at which a character starts, or the end."""
        return places - self.excess[np.searchsorted(self.bytes, places)]


@dataclass(frozen=True)
class Rearranged:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def draws(seed: str, name: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(raw: bytes, name: str, seed: str = "7", percent: int = 100, spm_percent: int = 50, unit: str = "line") -> Rearranged:
    """One text. Units are lines with their line ends (``line``) or code points (``char``)."""
    view = np.frombuffer(raw, np.uint8)
    index = None
    if unit == "line":
        ends = np.flatnonzero(view == 10) + 1
        n = len(ends) + (len(view) > 0 and view[-1] != 10)
    else:
        index = SparseIndex(view)
        n = int(len(view) - index.excess[-1])
    one, two, three, four = draws(seed, name)
    held = any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE))
    if not raw or held or three % 100 >= percent:
        return Rearranged(n, "plain", None, None, raw)
    cuts = np.sort(np.array([one % (n + 1), two % (n + 1)]))
    if index is None:
        index = SparseIndex(view)
        places = np.concatenate(([0], ends, [len(view)]))[cuts]
        points = index.to_points(places)
    else:
        points, places = cuts, index.to_bytes(cuts)
    a, b = places.tolist()
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if four % 100 < spm_percent else "psm"
    parts = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
    output = b"".join(p if isinstance(p, bytes) else p.encode() for p in (*parts, MIDDLE, middle))
    return Rearranged(n, form, int(points[0]), int(points[1] - points[0]), output)


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one narrow pass; options are those of ``rearrange``."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    made_columns = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []

            def made(last: int) -> pa.RecordBatch:
                columns = zip(*((r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode()) for r in rows))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *arrays], names=["doc_id", *made_columns])

            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer()
                rows.append(rearrange(raw.to_pybytes() if raw else b"", batch.column(1)[i].as_py() or "", **options))
                size += len(rows[-1].output)
                if size >= BATCH_BYTES:
                    yield made(i + 1)
                    first, size, rows = i + 1, 0, []
            if rows:
                yield made(batch.num_rows)

    given = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("name"), F.col(text).cast("string").cast("binary").alias("raw")
    )
    return given.mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _parts(output: Column, first: str, second: str) -> tuple[Column, Column, Column]:
    """What follows the first sentinel, the second and the middle's."""
    at = F.instr(output, second)
    rest = F.substr(output, at + len(second))
    cut = F.instr(rest, MIDDLE)
    return (
        F.substr(output, F.lit(len(first) + 1), at - len(first) - 1),
        F.substr(rest, F.lit(1), cut - 1),
        F.substr(rest, cut + len(MIDDLE)),
    )


def restore(output: Column, form: Column) -> Column:
    """The text behind an output. No part holds a sentinel, and sentinels do not overlap, so the first find is right."""
    prefix, suffix, middle = _parts(output, PREFIX, SUFFIX)
    tail, head, core = _parts(output, SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(head, core, tail)).otherwise(output)


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    made = transform(docs, **options)
    restored = restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )
