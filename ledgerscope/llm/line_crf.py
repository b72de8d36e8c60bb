"""Document quality by a linear-chain conditional random field over lines (op1).

Every line is good or bad. A line's evidence is a weighted sum of its own features and those of the lines before and
after it; neighbouring labels are tied by transition weights. The field is fitted on lines that carry their
document's label, by gradient ascent on the conditional likelihood (forward-backward expectations), on a bounded
sample: ``sample_docs`` labelled documents with the smallest hashes, each of at most ``max_lines`` lines. All
documents are scored whole: forward-backward gives every line's marginal, and a document's score is their mean
weighted by line length.

Rows: null text counts as empty. A text without a word is one empty line, and scores as such. Documents without a
label are scored like others. Without labels of both kinds there is nothing to fit, and every score is ``PRIOR``.
Very long texts are scored whole. Equal hashes of the fitted sample are ordered by doc_id. Repeated rows are scored each;
repeated labels of one doc_id count once, the lower quality. An empty table gives an
empty result. ``keep_good`` keeps all given columns. Memory follows one Arrow batch and its lines' features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
PRIOR = 0.5
SAMPLE_DOCS = 4000
MAX_LINES = 500
OWN_FEATURES = 10
SYMBOLS = "#*$%&|<>"


def line_features(line: str, seen: set[str]) -> list[float]:
    """Features of one line; ``seen`` holds the lines above it."""
    words = line.split()
    n = max(1, len(words))
    chars = max(1, len(line))
    symbols = sum(map(line.count, SYMBOLS))
    same = sum(map(str.__eq__, words, words[1:]))
    out = [
        np.log1p(len(words)),
        min(2.0, symbols / n),
        min(2.0, line.count("!") / n),
        sum(map(str.isupper, words)) / n,
        min(20.0, sum(map(len, words)) / n) / 10,
        len(set(words)) / n,
        same / n,
        1.0 if line in seen else 0.0,
        1.0 if line[-1:] in ".?!" else 0.0,
        min(1.0, 20 * line.count("|") / chars),
    ]
    seen.add(line)
    return out


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weights, starts) of all lines of the texts, neighbours' features beside a line's own."""
    rows: list[list[float]] = []
    weights: list[int] = []
    starts = [0]
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
        seen: set[str] = set()
        rows += [line_features(x, seen) for x in lines]
        weights += [max(1, len(x)) for x in lines]
        starts.append(len(rows))
    own = np.array(rows, np.float64).reshape(-1, OWN_FEATURES)
    at = np.array(starts)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[at[:-1]], last[at[1:] - 1] = True, True
    zero = np.zeros((1, OWN_FEATURES))
    before = np.concatenate([zero, own[:-1]])[: len(own)] * ~first[:, None]
    after = np.concatenate([own[1:], zero])[: len(own)] * ~last[:, None]
    both = np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))], axis=1)
    return both, np.array(weights, np.float64), at


def chains(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the chains, longest first, and how many have more than t rows, for t = 0, 1, ..."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    more = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    return starts[:-1][order], more


def forward_backward(evidence: np.ndarray, tie: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good over bad from the lines up to each one, and from those after it. tie[i, j]: weight of j after i."""
    ahead, behind = evidence.copy(), np.zeros_like(evidence)
    first, more = chains(starts)
    for t in range(1, len(more)):
        now = first[: more[t]] + t
        a = ahead[now - 1]
        ahead[now] += np.logaddexp(a + tie[1, 1], tie[0, 1]) - np.logaddexp(a + tie[1, 0], tie[0, 0])
    for t in range(len(more) - 1, 0, -1):
        now = first[: more[t]] + t
        b = behind[now] + evidence[now]
        behind[now - 1] = np.logaddexp(b + tie[1, 1], tie[1, 0]) - np.logaddexp(b + tie[0, 1], tie[0, 0])
    return ahead, behind


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Field:
    """Weights over standardised features, and the transition weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, size, starts = features(texts)
        evidence = ((rows - self.mean) / self.scale) @ self.weights
        ahead, behind = forward_backward(evidence, self.tie, starts)
        good = sigmoid(ahead + behind)
        if len(starts) == 1:
            return np.zeros(0)
        return np.clip(np.add.reduceat(good * size, starts[:-1]) / np.add.reduceat(size, starts[:-1]), 0, 1)


def fit(rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the mean conditional log likelihood a line, every document of equal weight."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0.0, 1.0
    x = (rows - mean) / scale
    lengths = np.diff(starts)
    y = np.repeat(labels, lengths).astype(np.float64)
    share = np.repeat(1 / lengths, lengths) / len(labels)
    inner = np.ones(len(x), bool)
    inner[starts[1:] - 1] = False
    left = np.flatnonzero(inner)
    pair_share = share[left]
    seen = np.array([[((1 - y[left]) * (1 - y[left + 1]) * pair_share).sum(), ((1 - y[left]) * y[left + 1] * pair_share).sum()],
                     [(y[left] * (1 - y[left + 1]) * pair_share).sum(), (y[left] * y[left + 1] * pair_share).sum()]])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, tie = theta[:-4], theta[-4:].reshape(2, 2)
        evidence = x @ weights
        ahead, behind = forward_backward(evidence, tie, starts)
        grad = np.empty_like(theta)
        grad[:-4] = x.T @ (share * (y - sigmoid(ahead + behind))) - decay * weights
        a, b = ahead[left], evidence[left + 1] + behind[left + 1]
        logs = np.stack([np.full_like(a, tie[0, 0]), tie[0, 1] + b, tie[1, 0] + a, tie[1, 1] + a + b])
        odds = np.exp(logs - logs.max(axis=0))
        expected = (odds / odds.sum(axis=0) * pair_share).sum(axis=1)
        grad[-4:] = seen.ravel() - expected - decay * tie.ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    max_lines: int = MAX_LINES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Field | None:
    """The field fitted on a bounded sample of labelled rows outside the held-out part; None without both kinds."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    )
    # At most sample_docs rows of two numbers.
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    joined = texts.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, _, starts = features(part.column(2).to_pylist())
                few = [i for i in range(part.num_rows) if starts[i + 1] - starts[i] <= max_lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(few, pa.int64())),
                        part.column(1).take(pa.array(few, pa.int64())).cast(pa.int32()),
                        pa.array([rows[starts[i] : starts[i + 1]].astype("<f4").tobytes() for i in few], pa.binary()),
                    ],
                    names=["doc_id", "quality", "rows"],
                )

    # One row a doc_id, so repeated documents do not widen the sample.
    sample = joined.mapInArrow(work, "doc_id long, quality int, rows binary").groupBy("doc_id").agg(
        F.min(F.struct("quality", "rows")).alias("s")
    )
    found = sorted(sample.select("doc_id", "s.quality", "s.rows").collect(), key=lambda r: r["doc_id"])
    if {r["quality"] for r in found} != {0, 1}:
        return None
    width = 3 * OWN_FEATURES + 3
    each = [np.frombuffer(r["rows"], "<f4").astype(np.float64).reshape(-1, width) for r in found]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in each])))
    return fit(np.concatenate(each), starts, np.array([r["quality"] for r in found]))


def _scores(field: Field | None, texts: list[str | None]) -> np.ndarray:
    if field is None:
        return np.full(len(texts), PRIOR)
    parts = [field.scores(texts[at : at + 512]) for at in range(0, len(texts), 512)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per document, in one narrow pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_scores(field, batch.column(2).to_pylist()))],
                names=["doc_id", "held_out", "score"],
            )

    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    return base.mapInArrow(work, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def keep_good(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that score at or over the threshold, with their columns. Without a field all stay."""
    if field is None:
        return docs
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _scores(field, batch.column(place).to_pylist()) >= threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(work, docs.schema)
