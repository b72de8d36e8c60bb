"""Prefix tables against the libraries, and token files against an exact round trip."""

import hashlib
import random
import zlib

import edge_tables
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerscope.llm import piece_codec, repair_shards, token_counts
from ledgerscope.llm.prefix_bpe import PrefixTable, merge_greedily

PARTS = [
    " ", " ", "\n", "\t", "a", "the", "ing", "'s", "'re", "'", "l", "1", "23", "!", "##", "é", "漢", " ", "　", "🙂",
    "<|endoftext|>", "<|endo", "<s>", "<0x41>", "▁", "\x00", "\x0b", "Ġ", "=====", "    ", "́", "\x85", "\x1c",
]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_prefix_table_equals_greedy_merging():
    rng = random.Random(3)
    for _ in range(30):
        pairs = {}
        tokens = list("abc")
        for _ in range(12):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if len(a + b) < 7 and (a, b) not in pairs:
                pairs[a, b] = len(pairs)
                tokens.append(a + b)
        table = PrefixTable(dict.fromkeys(tokens), lambda a, b: pairs.get((a, b)))
        for _ in range(40):
            word = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
            want = merge_greedily(word, lambda a, b: pairs.get((a, b)))
            assert [table.texts[t] for t in table.tokens(word)] == want
            assert table.counts(word)[-1] == len(want)


def test_every_prefix_has_the_library_count(library):
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts(250, 1):
        got = np.concatenate([[0], np.cumsum(token_counts.from_bytes(counter.deltas(text)))])
        want = [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        assert got.tolist() == want, text


def test_pieces_equal_the_library(pieces):
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for text in [*texts(1500, 2), edge_tables.LONG]:
        assert codec.encode(text).tolist() == [*pieces.encode(text), 2], text


def test_forgetting_changes_nothing(library, pieces):
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"), remember=3)
    counter.words.pairs = 3
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"), remember=3)
    encoder = repair_shards.IdEncoder(public_tokenizers.path("byte_bpe_50k.json"), remember=3)
    some = texts(60, 4)
    for text in some:
        assert int(token_counts.from_bytes(counter.deltas(text)).sum()) == len(library.encode(text).ids)
        assert codec.encode(text).tolist() == [*pieces.encode(text), 2]
        assert encoder.encode(text).tolist() == library.encode(text).ids


def test_counts_of_edge_rows(spark, library):
    rows = token_counts.prefix_counts(edge_tables.docs(spark)).select("doc_id", "n_bytes", "n_tokens").collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, _ in edge_tables.TEXTS)
    assert sorted((str(r[0]), r[1], r[2]) for r in rows) == want
    assert token_counts.prefix_counts(edge_tables.empty(spark)).count() == 0


def cut_text(library, text, budget):
    fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i]).ids) <= budget]
    return text[: max(fits)]


def test_truncation_by_stored_tables(spark, library):
    docs = edge_tables.docs(spark).where("doc_id in (1, 3, 8, 9) or doc_id is null")
    docs = docs.union(docs.where("doc_id = 9"))
    tables = token_counts.prefix_counts(docs)
    texts = {i: t for i, t, _ in edge_tables.TEXTS}
    for budget in (0, 1, 5):
        want = sorted((str(i), cut_text(library, texts[i] or "", budget)) for i in (1, 3, 8, 9, 9, None))
        for got in (token_counts.truncate(docs, budget), token_counts.truncate_stored(docs, tables, budget)):
            assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == want
    changes = tables.where("doc_id = 1").first()["changes"]
    assert token_counts.count_at(changes, 9) == len(library.encode(edge_tables.TEXTS[0][1][:9]).ids)


def test_truncation_of_one_id_with_two_texts(spark, library):
    docs = spark.createDataFrame([("x", "one two three four"), ("x", "!!!! a b c"), ("x", None)], "doc_id string, text string")
    got = sorted(r["text"] for r in token_counts.truncate(docs, 2).collect())
    assert got == sorted(cut_text(library, t or "", 2) for _, t in docs.collect())
    numbered = docs.withColumn("doc_id", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="different texts"):
        token_counts.truncate_stored(numbered, token_counts.prefix_counts(numbered), 2).collect()


def test_round_trip_of_edge_rows(spark, pieces):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = piece_codec.round_trip(edge_tables.docs(spark)).collect()
    want = []
    for i, t, _ in edge_tables.TEXTS:
        ids = [*pieces.encode(t or ""), 2]
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(pieces.decode(ids))))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)
    decoded = piece_codec.decode(piece_codec.encode(edge_tables.docs(spark).where("doc_id in (1, 9)"))).collect()
    assert {r["doc_id"]: r["text"] for r in decoded} == {i: t for i, t, _ in edge_tables.TEXTS if i in (1, 9)}
    assert piece_codec.round_trip(edge_tables.empty(spark)).count() == 0


def test_containers_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    pool = [rng.integers(3, 60, 12, dtype=np.uint32) for _ in range(8)]
    docs = [np.append(np.concatenate([pool[k] for k in rng.integers(0, 8, n)] or [np.zeros(0, np.uint32)]), np.uint32(2)) for n in (0, 1, 40, 90, 0, 7)]
    box = repair_shards.Container(repair_shards.pack(docs, 2))
    assert len(box.rules) > 0 and len(box.symbols) < sum(map(len, docs))
    for k, (got, want) in enumerate(zip(box.documents(), docs)):
        assert np.array_equal(got, want) and np.array_equal(box.document(k), want)
        for a in range(0, len(want), 17):
            for b in range(a, len(want) + 1, 29):
                assert np.array_equal(box.slice(k, a, b), want[a:b])
    wide = [np.array([70_000, 70_001] * 40 + [2], np.uint32)]
    assert np.array_equal(repair_shards.Container(repair_shards.pack(wide, 2)).document(0), wide[0])
    alone = [np.array([2], np.uint32)]
    assert np.array_equal(repair_shards.Container(repair_shards.pack(alone, 2)).document(0), alone[0])


def left_pairs(symbols, end):
    """How often each pair is still met; of a run of equal symbols every second place counts."""
    met, skip = {}, False
    for a, b in zip(symbols, symbols[1:]):
        skip = a == b != end and not skip
        if end not in (a, b) and (a != b or skip):
            met[a, b] = met.get((a, b), 0) + 1
    return met


def test_grammar_goes_on_to_its_least_count():
    run = np.append(np.full(50_000, 7, np.uint32), np.uint32(2))
    stored = repair_shards.pack([run], 2)
    assert len(stored) < 400 and np.array_equal(repair_shards.Container(stored).document(0), run)
    rng = np.random.default_rng(8)
    copy = np.append(rng.integers(3, 5000, 500, dtype=np.uint32), np.uint32(2))
    box = repair_shards.Container(repair_shards.pack([copy] * 2000, 2))
    assert len(box.symbols) == 4000 and all(np.array_equal(d, copy) for d in box.documents())
    for _ in range(300):
        top = 3 + rng.integers(1, 6)
        docs = [np.append(rng.integers(3, top, rng.integers(0, 80), dtype=np.uint32), np.uint32(2)) for _ in range(rng.integers(1, 9))]
        box = repair_shards.Container(repair_shards.pack(docs, 2))
        assert all(np.array_equal(a, b) for a, b in zip(box.documents(), docs))
        assert max(left_pairs(box.symbols.tolist(), 2).values(), default=0) < 8


def test_new_pieces_of_a_text_are_made_once(library):
    """A piece that is new and stands in a text twice goes through the model once; so does a word with accents."""
    path = public_tokenizers.path(repair_shards.VOCABULARY)
    enc = repair_shards.IdEncoder(path)
    made, word_ids = [], enc.word_ids
    enc.word_ids = lambda *a: made.append(a) or word_ids(*a)
    for text in ("x qwrtz qwrtz qwrtz, qwrtz", "x \xe9t\xe9qw \xe9t\xe9qw\xba \xe9t\xe9qw", "漢字 qq漢 qq漢 漢"):
        assert enc.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(made) == len(set(made))


@pytest.mark.parametrize("shard_tokens", [50, 1_000_000])
def test_token_files(spark, library, shard_tokens):
    rows = repair_shards.token_files(edge_tables.docs(spark), shard_tokens=shard_tokens).collect()
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == [False] + [True] * (len(rows) - 1)
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = []
    for i, t, _ in edge_tables.TEXTS:
        ids = np.array([*library.encode(t or "").ids, 2], "<u4")
        want.append((str(i), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert repair_shards.token_files(edge_tables.empty(spark)).count() == 0


def test_queries_over_given_tables(spark, library):
    from ledgerscope.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    counted = QUERIES["op10_token_counts"](spark, sf).collect()
    assert len(counted) == len(texts)
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]]).ids) for r in counted)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in counted)
    assert QUERIES["op3_token_files"](spark, sf).agg(F.sum("n_tokens")).first()[0] == sum(r["n_tokens"] + 1 for r in counted)
