"""The pipeline's near-duplicate stage: documents linked by either method are one group."""

import corpus_pipeline
import numpy as np
import pytest

from ledgerscope.llm import shingle_sets, simhash


def rows():
    said = "one short phrase that is said again " * 60
    tails = [" ".join(f"{c}{i}" for i in range(40)) for c in "xyz"]
    other = " ".join(f"w{i}" for i in range(120))
    return [(1, said + tails[0]), (2, said + tails[1]), (3, other), (4, other + " end"), (5, " ".join(tails))]


@pytest.mark.parametrize("most", [0, 100])
def test_fingerprints_and_sets_both_link(spark, most, monkeypatch):
    monkeypatch.setattr(shingle_sets, "MAX_OUT", most)
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    one, two = (simhash.fingerprint(t) for _, t in rows()[:2])
    assert np.bitwise_count(np.uint64(one) ^ np.uint64(two)) <= 4
    assert sorted(r["doc_id"] for r in shingle_sets.keep_one(docs).collect()) == [1, 2, 3, 5]  # sets alone leave them apart
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3, 5]
