"""Fingerprints and vectors against brute force over all pairs."""

import random

import edge_tables
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm import bit_planes, rotated_codes, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(n, linked):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_bit_planes_find_all_neighbours(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 70, dtype=np.uint64)
    flips = [base.copy() for _ in range(4)]
    for k, v in enumerate(flips):
        for _ in range(2 * k):
            v ^= np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64)
    v = np.concatenate(flips)
    n = len(v)
    low, high = rng.integers(0, n, n), rng.integers(0, n + 1, n)
    got = {(a, b) for x, y in bit_planes.neighbours(v, low, high, radius, items=100) for a, b in zip(x.tolist(), y.tolist())}
    far = np.bitwise_count(v[:, None] ^ v[None, :])
    assert got == {(i, j) for i in range(n) for j in range(low[i], high[i]) if far[i, j] <= radius}


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["Ab", "É", " ", "\n", "x", "\t", " ", "Q"], k=rng.randint(0, 60)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    rows = simhash.fingerprints(edge_tables.docs(spark)).collect()
    want = sorted((str(i), plain_fingerprint(t)) for i, t, _ in edge_tables.TEXTS)
    assert sorted((str(r[0]), r[1] % 2**64) for r in rows) == want


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_join_what_brute_force_joins(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    chain = [base]
    for _ in range(5):
        step = chain[-1].copy()
        for _ in range(3):
            step ^= np.uint64(1) << rng.integers(0, 64, len(step)).astype(np.uint64)
        chain.append(step)
    v = np.unique(np.concatenate(chain))
    far = np.bitwise_count(v[:, None] ^ v[None, :])
    want = parts(len(v), [(i, j) for i, j in zip(*np.nonzero(far <= 4)) if i < j])
    distinct = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(v.view(np.int64))}
    links = simhash.near_links(distinct, tile=tile).collect()
    assert all(far[place[r["src"]], place[r["dst"]]] <= 64 for r in links)
    assert parts(len(v), [(place[r["src"]], place[r["dst"]]) for r in links]) == want


def test_documents_of_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = sorted((r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect())
    v = np.array([f for _, f in given], np.uint64)
    far = np.bitwise_count(v[:, None] ^ v[None, :])
    part = parts(len(v), [(i, j) for i, j in zip(*np.nonzero(far <= 4)) if i < j])
    want = [(d, f"{f:016x}", given[p][0]) for (d, f), p in zip(given, part)]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({w[2] for w in want})


def test_edge_documents(spark):
    docs = edge_tables.docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[11] == {("0" * 16, 2)}
    assert {c for _, c in by[1]} == {c for _, c in by[10]} == {1}
    assert len(by[5]) == 1 and {c for _, c in by[None]} == {None}
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "7", "8", "9", "None"]
    assert simhash.near_duplicates(edge_tables.empty(spark)).count() == 0
    assert simhash.keep_one(edge_tables.empty(spark)).count() == 0


def brute_vectors(rows, threshold=0.98):
    def fit(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [fit(v, label) for _, v, label in rows]
    linked = []
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if good[i] and good[j] and label == other and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    linked.append((j, i))
    part = parts(len(rows), linked)
    counts = np.bincount(np.array(linked, int).ravel(), minlength=len(rows))
    least = {}
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    return sorted(str((rows[i][0], int(counts[i]), least.get(p))) for i, p in enumerate(part))


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("copies", T.StringType()),
    ]
)


@pytest.mark.parametrize("tile", [16, 2048])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        base = rng.standard_normal((20, 10))
        near = base[:8] + 0.06 * rng.standard_normal((8, 10))
        for v in np.concatenate([base, near, base[:3], 2 * base[:2], np.repeat(base[:1], 9, axis=0)]):
            rows.append((len(rows), v.tolist(), label))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 10, 1), (1003, [1.0, None], 1), (1004, [float("nan")] * 10, 1)]
    rows += [(1005, [float("inf")] + [0.0] * 9, 1), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1)]
    rows += [(None, [3.0, 1.0], 1), (1008, [1e-300, 1e-300], 0), (1009, [1e300, 1e300], 0), (1010, [-0.0, 1.0], 0), (1011, [0.0, 1.0], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = rotated_codes.near_vectors(frame, tile=tile).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert rotated_codes.near_vectors(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((200, 48))
    v[100:] = v[:100] + 0.1 * rng.standard_normal((100, 48))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    mean = np.mean([rotated_codes.estimates(v, seed) for seed in range(40)], axis=0)
    off = ~np.eye(len(v), dtype=bool)
    assert abs((mean - u @ u.T)[off].mean()) < 2e-3
    c = rotated_codes.codes(v, 9)
    product = rotated_codes.products(c, c, 48, slice(None)) + c["lost"][None, :] + rotated_codes.SLACK
    angle = np.arccos(np.clip(u @ u.T, -1, 1))
    assert (product >= np.cos(np.minimum(c["angle"][:, None] + angle, np.pi))).all()


def test_every_document_has_one_row(spark):
    from ledgerscope.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    out = QUERIES["op7_simhash_duplicates"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count() == out.select(F.count_distinct("doc_id")).first()[0]
