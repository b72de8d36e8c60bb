"""Near copies of the pipeline's stage against brute force over whole shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerscope.llm import shingle_sets, simhash


def plain_set(text, k=5):
    words = (text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_kept(rows):
    """Smallest ids of the components that pairs of similarity 0.8 or more make."""
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    return sorted({min(rows[j][0] for j in range(len(rows)) if up[j] == u) for u in up})


def edited_rows():
    rng = random.Random(4)
    rows = []
    for base in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 3, 4, 6, 12):
            copy = list(words)
            for at in rng.sample(range(200), edits):
                copy[at] = f"n{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile, few", [(4, 2), (512, 2), (512, 8)])
def test_edited_copies_are_caught(spark, tile, few, monkeypatch):
    monkeypatch.setattr(shingle_sets, "FEW", few)
    monkeypatch.setattr(shingle_sets.near_links, "__defaults__", ("text", tile))
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r[0] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect())
    assert got == plain_kept(rows)
    far = [np.bitwise_count(np.uint64(simhash.fingerprint(rows[i][1])) ^ np.uint64(simhash.fingerprint(rows[i + 3][1]))) for i in range(0, 210, 7)]
    assert max(far) > 4  # copies that four bits do not reach


def test_tile_spanning_at_the_threshold():
    base = np.arange(9, dtype=np.uint64)
    near = np.array([0, 1, 2, 3, 4, 5, 6, 7], np.uint64)  # 8 of 9
    edge = np.array([0, 1, 2, 3, 4, 5, 6, 7, 100], np.uint64)  # 8 of 10
    under = np.array([0, 1, 2, 3, 4, 5, 6, 200, 201], np.uint64)  # 7 of 11
    assert shingle_sets.tile_spanning([base, near, edge, under], 0).tolist() == [0, 0, 0, 3]
    assert shingle_sets.tile_spanning([base, under, near], 2).tolist() == [0, 1, 0]


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("text").rlike("^[ -~\\s]*$"))
    rows = [(r["doc_id"], r["text"].lower()) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in shingle_sets.keep_one(docs).collect()) == plain_kept(rows)
