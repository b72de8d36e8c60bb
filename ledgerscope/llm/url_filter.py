"""URL rules and a Bloom filter cascade over hosts (op8). DataFrame functions only.

The cascade answers "is this key listed?" exactly for every key of a known universe, here all hosts of the corpus.
Level 1 holds the listed keys; level 2 the other keys of the universe that level 1 takes for listed; level 3 the
listed keys that level 2 takes for those; and so on until a level is wrong about none. A key's answer is read off the
first level that does not hold it. Testing is arithmetic on a row, without a join: a level is one array of 64-bit
words, which reaches the tasks as a scalar subquery. The size of all levels is known before they are built from the
number of keys and is refused beyond ``max_bits``; it depends on the list, hardly on the corpus.

Rules come first: a rule fits its host and all subdomains when the path starts with the rule's; of several the
longest host and path wins. A url without a rule gets the cascade's verdict for its host.

Rows: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Repeated rows are
judged each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import materialize

# (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Names a listed domain starts with, fixed values.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, name, start = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def by_rules(rules: list[tuple[str, str, str]], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r, host, path), F.lit(value(r))) for r in longest])


class Cascade:
    """Levels built over a universe of (key, listed), keys distinct and not null."""

    def __init__(self, universe: DataFrame, max_bits: int = 1 << 28, max_levels: int = 64) -> None:
        counts = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
        inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
        n, others = counts[0] or 0, counts[1] or 0
        # Per level: bits, positions a key has, table of the one row of words.
        self.levels: list[tuple[int, int, DataFrame]] = []
        self.bits = 0
        while n and len(self.levels) < max_levels:
            # The first level is stricter, as its mistakes are drawn from all other keys; later ones take half.
            rate = 0.5 if self.levels or not others else min(0.5, n * math.sqrt(0.5) / others)
            bits = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
            self.bits += bits
            if self.bits > max_bits:
                raise ValueError(f"the cascade needs over {max_bits} bits")
            hashes = max(1, math.ceil(math.log2(1 / rate)))
            level = len(self.levels)
            words = self.words(inside, level, bits, hashes)
            self.levels.append((bits, hashes, materialize(words, f"cascade-{level}")))
            wrong = materialize(outside.where(self.holds(level, F.col("key"))), f"cascade-wrong-{level}")
            inside, outside = wrong, inside
            n = wrong.count()
        if n:
            raise ValueError(f"{max_levels} levels do not settle the universe")

    @staticmethod
    def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * level + j)), F.lit(bits).cast("long")) for j in range(hashes)]

    def words(self, keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
        """One row: the level's words in order."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key"), level, bits, hashes))).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
        used = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
        row = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        return every.join(used, "word", "left").agg(F.transform(row, lambda x: x["bits"]).alias("words"))

    def holds(self, level: int, key: Column) -> Column:
        """Whether a level takes the key for one of its own."""
        bits, hashes, table = self.levels[level]
        words = table.select("words").scalar()
        tests = []
        for at in self.positions(key, level, bits, hashes):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            bit = F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long"))
            tests.append(bit == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def listed(self, key: Column) -> Column:
        """Exact for keys of the universe."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self.holds(level, key), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def is_blocked_name(key: Column, names: list[str] = BLOCKED_NAMES) -> Column:
    """Whether a host or a domain above it starts with a blocked name."""
    return F.arrays_overlap(F.split(key, r"\."), F.array(*map(F.lit, names)))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    listed: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    max_bits: int = 1 << 28,
) -> DataFrame:
    """(page_id, host, path, rule, verdict). ``listed`` holds blocked hosts in ``key``; by default those that
    ``is_blocked_name`` picks from the corpus."""
    parsed = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    keys = parsed.select(F.col("host").alias("key")).distinct()
    if listed is None:
        flagged = keys.withColumn("listed", is_blocked_name(F.col("key")))
    else:
        given = listed.select("key").distinct().withColumn("given", F.lit(True))
        flagged = keys.join(given, "key", "left").select("key", F.coalesce("given", F.lit(False)).alias("listed"))
    cascade = Cascade(materialize(flagged, "hosts"), max_bits)
    ruled = by_rules(rules, F.col("host"), F.col("path"), lambda r: r[0])
    own = F.when(cascade.listed(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.select(
        "page_id", "host", "path",
        by_rules(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(ruled, own).alias("verdict"),
    )
