"""Byte pairs against the library, proofs against a plain tree, rearranged texts against plain slicing."""

import hashlib
import random
import zlib

import edge_tables
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm import byte_pairs, fill_middle, merkle_manifest

PARTS = [
    " ", " ", "\n", "\t", "a", "the", "ing", "'s", "'re", "'", "l", "1", "23", "!", "##", "é", "漢", " ", "　", "🙂",
    "<|endoftext|>", "\x00", "\x0b", "=====", "    ", "́", "\x85", "\x1c", "aaaa", "zzzzzzz",
    # A letter and a number that are newer than the tables of some JVMs.
    "ࡰ", "\U00010d40",
]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    ranks = byte_pairs.read_ranks(public_tokenizers.path(byte_pairs.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("options", [{}, {"block_words": 5, "long_word": 3}])
def test_byte_pairs_equal_the_library(spark, library, options):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["", None, "a" * 3000, "ab" * 700, "".join(rng.choices("abcdefgh", k=1500)), edge_tables.LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    encoded = byte_pairs.encode(rows, **options)
    for i, ids in encoded.collect():
        assert ids == library.encode_ordinary(texts[i] or ""), texts[i]
    if not options:
        for i, data in byte_pairs.decode(encoded).collect():
            assert bytes(data).decode() == (texts[i] or "")


def test_folds_of_every_length(spark, library):
    """Words of 1 to 70 bytes, around the length from which all places of a rank merge at once; a fold holds its ids in
    one array of numbers and never looks for a number by its value."""
    rng = random.Random(3)
    words = ["".join(rng.choices(letters, k=n)) for n in range(1, 71) for letters in ("a", "ab", "etaoinsh", "théё")]
    ranks = byte_pairs.Ranks.read(public_tokenizers.path(byte_pairs.VOCABULARY))
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    ids = rows.select("w", byte_pairs.let(ranks.tables, lambda t: byte_pairs.word_ids(F.col("w"), ranks.bound(t))).alias("ids"))
    assert "array_position" not in ids._jdf.queryExecution().analyzed().toString()
    for word, found in ids.collect():
        assert found == library.encode_ordinary(word), word


def test_blocks_hold_words_of_pieces_in_flat_arrays():
    block, cutter = byte_pairs.Block(), byte_pairs.splitter(byte_pairs.split_pattern())
    texts = ["one two, two", "", "x'll été l'été \n two", "漢字 one"]
    for text in texts:
        block.add(text, cutter)
    names, items, ends = list(block.words), block.piece_words.tolist(), [0, *block.piece_ends.tolist()]
    assert ["".join("".join(names[i] for i in items[ends[p] : ends[p + 1]]) for p in d.tolist()) for d in block.docs] == texts
    assert names == list(dict.fromkeys(w for t in texts for p in cutter.pieces(t) for w in cutter.split(p)))


def test_byte_pairs_of_edge_rows(spark, library):
    got = sorted((str(r[0]), *r[1:]) for r in byte_pairs.round_trip(edge_tables.docs(spark)).collect())
    want = []
    for i, t, _ in edge_tables.TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert got == sorted(want)
    assert byte_pairs.round_trip(edge_tables.empty(spark)).count() == 0


def test_every_token_folds_to_itself(library):
    """The library takes a word that is a token as it is; the merges lead there too, so the fold needs no such rule."""
    ranks = byte_pairs.read_ranks(public_tokenizers.path(byte_pairs.VOCABULARY))
    for token, i in ranks.items():
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            k = found.index(min(found))
            if found[k] == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token], i


def test_words_are_the_librarys():
    cutter = byte_pairs.splitter(byte_pairs.split_pattern())
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    # Every character among letters, numbers, signs and blanks.
    text = "".join(f"a{c}1{c}! {c} {c}" for c in every)
    words = [w for p in cutter.pieces(text) for w in cutter.split(p)]
    assert "".join(words) == text
    known = regex.compile(byte_pairs.split_pattern()).findall(text)
    assert words == known
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        mine = byte_pairs.split_pattern(name)
        assert set(map(ord, regex.findall(mine, "".join(every)))) == byte_pairs._members(name)


def test_rows_laid_over_one_another():
    rng = random.Random(2)
    rows = {r: {c: rng.randrange(9) for c in rng.sample(range(60), rng.randint(1, 30))} for r in rng.sample(range(60), 40)}
    shift, owner, value = byte_pairs.shifted_rows(rows, 60)
    for r in range(60):
        for c in range(60):
            at = shift[r] + c
            assert (value[at] if owner[at] == r else None) == rows.get(r, {}).get(c)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Levels of a tree from its leaves to its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, r):
    out = []
    for level in levels[:-1]:
        other = r ^ 1
        has = other < len(level)
        out.append((level[other] if has and other < r else "", level[other] if has and other > r else ""))
        r >>= 1
    return out


def plain_proofs(rows):
    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by_lang[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[x] = plain_tree([leaf(r) for r in by_lang[x]])
    crown = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by_lang[x]):
            path = siblings(trees[x], i) + siblings(crown, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            acc = leaf(r, 1 if hit else 0)
            for a, b in path:
                acc = sha(a + acc + b)
            root = crown[-1][0]
            out.append((str(r["doc_id"]), leaf(r), trees[x][-1][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out)


ROWS = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("text", "source", "lang")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("hash", "rank", "path", "node", "id", "key")]
)


def proof_rows(spark, langs):
    rng = random.Random(4)
    rows = []
    for lang, n in langs.items():
        for i in range(n):
            text = rng.choice([None, "", "é漢", edge_tables.LONG if i == 1 else "words"])
            rows.append((rng.randrange(4 * n), text, rng.choice("ab"), lang, rng.choice([None, 5, 77]), *"uvwxyz"))
    rows += [(None, None, None, None, None, *"uvwxyz")] * 2 + rows[:3]
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("langs", [{"en": 700, "de": 257, "": 1, "fr": 2, None: 5, "ü": 256}, {None: 1}, {"en": 3}])
def test_proofs_equal_a_plain_tree(spark, langs):
    table = proof_rows(spark, langs)
    got = sorted((str(r[0]), *r[1:]) for r in merkle_manifest.tampered(table).collect())
    assert got == plain_proofs([r.asDict() for r in table.collect()])
    assert any(not r[-1] for r in got) or len(got) < 20


def test_proofs_over_sliced_ranks(spark):
    table = proof_rows(spark, {"en": 900, None: 300})
    spark.conf.set("spark.ledgerscope.splitRows", "50")
    try:
        got = sorted((str(r[0]), *r[1:]) for r in merkle_manifest.tampered(table).collect())
    finally:
        spark.conf.unset("spark.ledgerscope.splitRows")
    assert got == plain_proofs([r.asDict() for r in table.collect()])


def test_proofs_of_nothing(spark):
    assert merkle_manifest.tampered(proof_rows(spark, {}).where("false")).count() == 0


def test_sparse_index():
    for text in ["", "abc", "é", "aé漢🙂b", "漢" * 50 + "x" + "🙂é" * 20]:
        raw = text.encode()
        index = fill_middle.SparseIndex(np.frombuffer(raw, np.uint8))
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in points])
        assert index.to_bytes(points).tolist() == places.tolist()
        assert index.to_points(places).tolist() == points.tolist()


@pytest.mark.parametrize("unit", ["line", "char"])
def test_rearranged_texts(spark, unit):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "é", "漢\n", "\n", "🙂", "<", "<S", "P>", "word "], k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["holds <S> itself", None, "", "no end", "\n", edge_tables.LONG]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, output string, form string")
    made = fill_middle.transform(rows, unit=unit)
    forms = set()
    for r in made.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect():
        text = texts[r["doc_id"]] or ""
        units = list(text) if unit == "char" else text.splitlines(keepends=True) if "\x0b" not in text else None
        h = [int(sha(f"7:{r['doc_id']}")[k : k + 8], 16) for k in range(0, 32, 8)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        forms.add(r["form"])
        assert (r["n"], r["restored"]) == (n, text)
        if r["form"] == "plain":
            assert text == "" or any(s in text for s in ("<P>", "<S>", "<M>"))
            assert (r["output"], r["prefix_chars"], r["middle_chars"]) == (text, None, None)
            continue
        assert r["form"] == ("spm" if h[3] % 100 < 50 else "psm")
        assert (r["prefix_chars"], r["middle_chars"]) == (len(prefix), len(middle))
        lead = f"<S>{suffix}<P>{prefix}" if r["form"] == "spm" else f"<P>{prefix}<S>{suffix}"
        assert r["output"] == f"{lead}<M>{middle}"
    assert forms == {"plain", "psm", "spm"}


def test_rearranged_edge_rows(spark):
    made = fill_middle.digests(edge_tables.docs(spark)).collect()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in made) == sorted((str(i), sha(t or "")) for i, t, _ in edge_tables.TEXTS)
    assert fill_middle.digests(edge_tables.empty(spark)).count() == 0
    named = edge_tables.docs(spark).withColumn("doc_id", F.lit("abc"))
    assert {r["doc_id"] for r in fill_middle.digests(named).collect()} == {"abc"}
    kept = fill_middle.transform(edge_tables.docs(spark), percent=0)
    assert kept.where("form <> 'plain'").count() == 0


def test_a_task_passes_long_outputs_on(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 10)
    assert fill_middle.digests(edge_tables.docs(spark).coalesce(1)).count() == len(edge_tables.TEXTS)
