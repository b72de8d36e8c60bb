"""Rules, mixing, url verdicts and license spans against plain Python."""

import hashlib
import itertools
import random
import re

import edge_tables
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import license_scan, quality_cascade, source_mix, url_filter

SPACES = "[\x20\x09-\x0d]+"


def split(text):
    return [w for w in re.split(SPACES, text or "") if w]


def plain_counts(text):
    ws = split(text)
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def plain_verdict(text):
    n, chars, symbols, dup, rep = plain_counts(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    upper = sum(1 for c in text or "" if re.match("[A-ZÀ-ÖØ-Þ]", c))
    base = n < 50 or 100 * rep > 50 * n
    own = 10 * symbols > n or 2 * upper > chars or (len(lines) >= 5 and 10 * dup > 7 * len(lines)) or chars > 20 * n
    return base, not (base or own)


def quality_texts():
    rng = random.Random(8)
    words = ["aa", "b", "Cc", "d##", "e", "ÉÉ", "f|", "gggg"]
    plain = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(60):
        pool = rng.choice([words, plain, plain + words, ["X" * 30] + plain])
        ws = rng.choices(pool, k=rng.randint(0, 120))
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in ws))
    out += ["line one is here\n" * 30 + " ".join(plain), " ".join(f"u{i}" for i in range(60)), "HELLO WORLD AGAIN " + " ".join(f"ABC{i}DEF" for i in range(60))]
    return out


def test_counts_and_verdicts(spark):
    texts = [(i, t, "s") for i, t in enumerate(quality_texts())] + edge_tables.TEXTS
    rows = quality_cascade.judge(edge_tables.docs(spark, texts)).collect()
    got = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"])) for r in rows)
    assert got == sorted(str((i, *plain_counts(t), *plain_verdict(t))) for i, t, _ in texts)
    assert any(r["kept"] for r in rows)


def test_cascade_order_and_stage(spark):
    texts = [(i, t, "s") for i, t in enumerate(quality_texts())]
    docs = edge_tables.docs(spark, texts)
    want = sorted(i for i, t, _ in texts if plain_verdict(t)[1])
    for rules in (quality_cascade.RULES, quality_cascade.RULES[::-1]):
        kept = quality_cascade.keep_good(docs, rules)
        assert kept.schema == docs.schema
        assert sorted(r["doc_id"] for r in kept.collect()) == want
    cheap = quality_cascade.Rule("never", lambda m: m("n_words") < 0)
    order = quality_cascade.plan(docs, [cheap, *quality_cascade.RULES])
    assert order[-1].name == "never" or all(r.name != "never" for r in order[:1])
    assert quality_cascade.keep_good(edge_tables.empty(spark)).count() == 0
    assert quality_cascade.judge(edge_tables.empty(spark)).count() == 0


def test_targets():
    assert source_mix.targets([10, 10, 10], [5, 2, 1]) == [20.0, 25 * 2 / 3, 25 / 3]
    assert source_mix.targets([], []) == []
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(0, 50) for _ in range(rng.randint(1, 7))]
        got = source_mix.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6


def plain_cost(patterns, quotas, repeats):
    """Least total cost of the fullest flow, by trying all whole-number splits."""
    best = None
    options = [
        [split for split in itertools.product(range(repeats * size + 1), repeat=len(members)) if sum(split) <= repeats * size]
        for members, size in patterns
    ]
    for pick in itertools.product(*options):
        given = [0] * len(quotas)
        cost = total = 0
        for (members, size), amounts in zip(patterns, pick):
            for s, a in zip(sorted(members), amounts):
                given[s] += a
            used = sum(amounts)
            total += used
            for r in range(repeats):
                cost += r * r * max(0, min(size, used - r * size))
        if all(g <= q for g, q in zip(given, quotas)):
            best = min(best, (-total, cost)) if best else (-total, cost)
    return best


def test_flow_is_fullest_and_cheapest():
    rng = random.Random(2)
    for _ in range(25):
        n = rng.randint(1, 2)
        members = [frozenset({0}), frozenset({1}), frozenset({0, 1})]
        patterns = [(m, rng.randint(0, 3)) for m in rng.sample(members, n + 1)]
        quotas = [rng.randint(0, 6), rng.randint(0, 6)]
        flows = source_mix.min_cost_flow(patterns, quotas, 2)
        total = sum(flows.values())
        cost = sum(r * r * f for (_, r, _), f in flows.items())
        assert (-total, cost) == plain_cost(patterns, quotas, 2)
        for (p, r, s), f in flows.items():
            assert s in patterns[p][0] and f > 0
        for p, (_, size) in enumerate(patterns):
            for r in range(2):
                assert sum(f for (q, k, _), f in flows.items() if (q, k) == (p, r)) <= size


def plain_mix(rows):
    sized = [(i, len(split(t)), s, hashlib.md5(f"6:{'' if i is None else i}".encode()).hexdigest()) for i, t, s in rows]
    names = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    totals = [sum(n for _, n, s, _ in sized if s == x) for x in names]
    wanted = source_mix.targets(totals, [(5, 2, 1)[i % 3] for i in range(len(names))])
    out = []
    for x, total, target in zip(names, totals, wanted):
        groups = {}
        for _, n, s, mark in sized:
            if s == x:
                groups[mark] = groups.get(mark, 0) + n
        quota, start, copies = round(target), 0, {}
        for mark in sorted(groups):
            middle = start + groups[mark] / 2
            copies[mark] = (middle < min(quota, total)) + (middle < quota - total)
            start += groups[mark]
        out += [str((i, n, total, target, n * copies[mark])) for i, n, s, mark in sized if s == x]
    return sorted(out)


def test_mix_equals_plain_python(spark):
    rng = random.Random(3)
    rows = edge_tables.TEXTS + [(100 + i, "w " * rng.randint(0, 9), rng.choice(["a", "b", "c", None, ""])) for i in range(400)]
    docs = edge_tables.docs(spark, rows)
    got = source_mix.mix(docs).collect()
    assert sorted(str((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in got) == plain_mix(rows)
    again = source_mix.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = source_mix.mixed_rows(docs)
    assert copies.schema == docs.schema
    assert copies.count() == sum(r["copies"] for r in got)
    assert source_mix.mix(edge_tables.empty(spark)).count() == 0
    assert source_mix.mixed_rows(edge_tables.empty(spark)).count() == 0


def test_overlapping_sources_share_a_pattern(spark):
    rows = [(i, "w " * 5, ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = source_mix.mix(docs, weights=(1, 1), share=0.6).collect()
    assert all(r["taken"] in (0, 5) for r in got)
    # Sources hold 1000 words each as patterns overlap: 0.6 of 2000 words is wanted in all.
    assert abs(sum(r["taken"] for r in got) - 1200) <= 15


def plain_verdict_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    listed = any(x in url_filter.BLOCKED_NAMES for x in host.split("."))
    return host, path, None, "block" if listed else "allow"


URLS = [
    None, "", "no scheme/at all", "http://", "https://EXAMPLE.org/es/1", "http://a.example.org/en/1x?y#z", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://x.com?/de/", "http://x.com#/de/",
    "ftp://a://b/c", "http://www.spam-farm.example.net/a", "http://spam-farmer.net/", "http://adult-x.example.com/fr/2", "http://h\n.org/p\nq",
    "http://free-bets.x/", "http://free-bets.x/", "http://user@casino-win.net:80/",
]


def test_urls(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[4], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *plain_verdict_of(u))) for i, u, *_ in rows)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [0, 1, 40, 3000])
def test_cascade_is_exact_over_its_universe(spark, listed):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") < listed).alias("listed"))
    cascade = url_filter.Cascade(keys)
    assert keys.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0
    if listed == 40:
        assert len(cascade.levels) > 1


def test_given_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.net/"), (3, None)], "page_id long, url string")
    listed = spark.createDataFrame([("b.net",), ("b.net",), ("never.seen",), (None,)], "key string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, listed=listed).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}


def test_license_spans(spark):
    notice = license_scan.TEMPLATES["GPL-3.0"]
    worn = license_scan.TEMPLATES["MIT-grant"].replace("free of charge, ", "").replace("use, copy", "use, fold, copy")
    rows = [
        (1, f"Some words.\n{notice}\nMore words é here. {notice.upper()}", "s"),
        (2, "nothing of the kind in this text at all", "s"),
        (3, f"ß {worn} end", "s"),
        (4, notice[: len(notice) // 2], "s"),
        *edge_tables.TEXTS,
    ]
    got = license_scan.scan(edge_tables.docs(spark, rows)).where("doc_id < 5 and doc_id <> 2").orderBy("doc_id", "start").collect()
    text = {i: (t or "").encode() for i, t, _ in rows[:4]}
    assert [(r["doc_id"], r["template"], r["coverage"]) for r in got[:2]] == [(1, "GPL-3.0", 1.0)] * 2
    assert text[1][got[0]["start"] : got[0]["end"]].decode() == notice
    assert text[1][got[1]["start"] : got[1]["end"]].decode() == notice.upper()
    assert [(r["doc_id"], r["template"]) for r in got[2:]] == [(3, "MIT-grant")]
    assert 0.9 < got[2]["coverage"] < 1.0 and text[3][got[2]["start"] :].startswith(b"Permission is")
    assert license_scan.scan(edge_tables.empty(spark)).count() == 0


def test_license_candidates_are_complete():
    """Every whole notice is found wherever it stands, whatever is around it."""
    rng = random.Random(9)
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        for _ in range(5):
            fill = lambda: " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 8))) for _ in range(rng.randint(0, 60)))
            whole = f"{fill()} {text} {fill()}"
            assert any(f[0] == name and f[1] == 1.0 for f in license_scan.findings(whole, index)), name


def test_documents_of_no_source_stay(spark):
    rows = [(1, "one two", ["a", "b"]), (2, "three", []), (3, "four five six", None), (4, "seven", ["b"]), (5, "", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = {r["doc_id"]: r for r in source_mix.mix(docs).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[2]["source"] is None and got[2]["source_size"] == got[3]["source_size"] == 4
    assert all(r["taken"] <= 2 * r["size"] for r in got.values())
