"""The line field against brute-force sums, held-out accuracy, and the pipeline against plain Python."""

import hashlib
import itertools
import re
import sys
import zlib

import edge_tables
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_duplicates import parts
from test_rules_mix_urls import plain_mix, plain_verdict

import corpus_pipeline
from ledgerscope.llm import line_crf

SF = "/root/testdata/sf0.001"


def test_marginals_equal_the_sum_over_all_labelings():
    rng = np.random.default_rng(1)
    starts = np.array([0, 1, 6, 8])
    evidence, tie = rng.standard_normal(8), rng.standard_normal((2, 2))
    ahead, behind = line_crf.forward_backward(evidence, tie, starts)
    got = line_crf.sigmoid(ahead + behind)
    for a, b in zip(starts[:-1], starts[1:]):
        weight = np.zeros((b - a, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(evidence[a + i] for i, y in enumerate(labels) if y) + sum(tie[p, q] for p, q in itertools.pairwise(labels)))
            for i, y in enumerate(labels):
                weight[i, y] += w
        assert np.allclose(got[a:b], weight[:, 1] / weight.sum(axis=1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = line_crf.score(docs, line_crf.train(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    right = scored.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_labels_of_the_held_out_part_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(line_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = line_crf.train(docs, labels), line_crf.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.tie, b.tie)


def test_edge_documents(spark):
    docs = edge_tables.docs(spark)
    field = line_crf.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = line_crf.score(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 11)}) == 1
    kept = line_crf.keep_good(docs, field)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["score"] >= 0.7)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_crf.train(docs, none) is None
    assert {r["score"] for r in line_crf.score(docs, None).collect()} == {line_crf.PRIOR}
    ids = [i for i in (1, 4, 5, 7, 8, 9, 10) if zlib.crc32(str(i).encode()) % 4 != 2]
    untidy = [(ids[0], 1), (ids[0], 0), (None, 1), (ids[1], None), (ids[2], 1), (ids[2], 1), (ids[3], 7)]
    assert line_crf.train(docs, spark.createDataFrame(untidy, "doc_id long, quality int")) is not None
    one_kind = spark.createDataFrame(untidy[:2], "doc_id long, quality int")
    assert line_crf.train(docs, one_kind) is None
    assert line_crf.score(edge_tables.empty(spark), field).count() == 0


def five_word_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    field = line_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if plain_verdict(r[1])[1]]
    rows = [r for r, s in zip(rows, field.scores([r[1] for r in rows])) if s >= 0.7]
    rows.sort()
    sets = [five_word_set(r[1]) for r in rows]
    near = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 5 * len(a & b) >= 4 * len(a | b)]
    part = parts(len(rows), near)
    rows = [r for i, (r, p) in enumerate(zip(rows, part)) if i == p]
    taken = {}
    for line in plain_mix(rows):
        i, size, _, _, words = eval(line)  # noqa: S307  plain tuples written by the test itself
        taken[i] = words // size
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = [*model.encode(text), 2]
        want += [(i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))] * taken[i]
    assert 0 < len(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_keep_columns(spark):
    docs = edge_tables.docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, edge_tables.empty(spark), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, edge_tables.empty(spark), SF).count() == 0


def test_registration():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    names = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
