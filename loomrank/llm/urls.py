"""URL rules by exact set membership: cascades of Bloom filters over every key the corpus can ask for (native: DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More levels than a cascade of distinct keys ever has; passing it means that two keys have all hashes in common.
MOST_LEVELS = 64
#: Bits of one filter at most (1 GiB), as each is one value of a row; a list of 2^33 bits holds some 10^8 rules.
MOST_BITS = 1 << 33


@dataclass(frozen=True)
class Level:
    """One filter: its words as the only row (`bits`) of a table, the number of hash functions, and of bits."""

    words: DataFrame
    hashes: int
    bits: int
    n: int


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "\\."))


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) that rules have: a few, bounded by the longest host times the longest path and not by the number of rules."""
    x = rules.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("long")).distinct()
    return sorted((r.labels, r.long) for r in x.collect())


def asked(host: Column, path: Column, shaped: list[tuple[int, int]]) -> Column:
    """The keys (n, h, key) that could name a rule for this url: for every shape the host's last labels followed by the path's first characters; n and h are the lengths of key and host."""
    if not shaped:
        return F.array().cast("array<struct<n:int,h:int,key:string>>")
    seats = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("long")) for a, b in shaped])

    def key(s: Column) -> Column:
        tail = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        return F.when(F.length(path) >= s["long"], F.struct((F.length(tail) + s["long"]).alias("n"), F.length(tail).alias("h"), F.concat(tail, F.left(path, s["long"])).alias("key")))

    return F.array_distinct(F.filter(F.transform(seats, key), lambda k: k.isNotNull()))


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _encode(members: DataFrame, n: int, rate: float, level: int) -> Level:
    """A filter of n keys with about this rate of false positives. Bits are or-ed map-side, a word of 64 at a time."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = max(64, -(-math.ceil(n * hashes / math.log(2)) // 64) * 64)
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits for {n} keys is more than one row can hold")
    spark = members.sparkSession
    at = members.select(F.explode(F.array(*_places(F.col("key"), level, hashes, bits))).alias("at"))
    ones = at.select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    words = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")).union(ones).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    return Level(written(one), hashes, bits, level)


def _contains(level: Level, words: Column, key: Column) -> Column:
    """Has the filter all of the key's bits?"""
    hit = [F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1 for at in _places(key, level.n, level.hashes, level.bits)]
    return reduce(lambda a, b: a & b, hit)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that the filter lets through."""
    return keys.select("key", level.words.scalar().alias("_words")).where(_contains(level, F.col("_words"), F.col("key"))).select("key")


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Filters (column key of both) that together tell for every key of universe exactly whether it is listed.

    Level 1 encodes the listed keys; level 2 the keys of the universe that level 1 lets through though
    they aren't listed; level 3 the listed keys that level 2 lets through, and so on until nothing is
    let through wrongly. Level 1 gets a rate of sqrt(1/2) r / s, of r listed keys and s others, the
    following ones 1/2, so that level 2 has about as many keys as level 1 and each later one half of
    the one before: bits grow with r log(s / r) and not with the corpus, and the number of levels with log r.

    Null keys, and repeats, don't matter. No listed key gives no level, with which nothing is listed.
    """
    tagged = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True))).where("key IS NOT NULL")
    keys = written(tagged.groupBy("key").agg(F.max("listed").alias("listed")))
    count = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    n, rate = count.get(True, 0), min(0.5, math.sqrt(0.5) * count.get(True, 0) / max(1, count.get(False, 0)))
    members, others, out, scratch = keys.where("listed").select("key"), keys.where(~F.col("listed")).select("key"), [], [keys]
    while n:
        if len(out) == MOST_LEVELS:
            raise ValueError("two different keys have all hashes in common")
        level = _encode(members, n, rate, len(out) + 1)
        out.append(level)
        wrong = written(_passing(others, level))
        scratch.append(wrong)
        n, rate, members, others = wrong.count(), 0.5, wrong, members
    for x in scratch:
        release(x)
    return out


def member(levels: list[Level], words: list[Column], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that lacks it decides, an odd one says no and an even one yes; what all levels have is listed if their number is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for level, w in reversed(list(zip(levels, words))):
        out = F.when(~_contains(level, w, key), F.lit(level.n % 2 == 0)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", into: str = "judged") -> DataFrame:
    """Adds a struct `into` (host, path, rule, verdict) to every page.

    rules is (host, path, action) with action `block` or `allow`. A rule fits its host and all
    subdomains if the url's path starts with the rule's. Of the rules that fit the longest wins (host
    and path together, then the longer host); a rule that is given as both blocks. Where none
    fits, rule is null: the url's keys are in neither list, and the verdict is `allow`.

    Every url asks for a few keys, one a shape (labels, length of path) that rules have; the
    distinct ones are the key universe. A cascade for each list gives exact membership, so
    judging is one projection over the pages without a join or a shuffle: the filters come
    along as scalar subqueries, of a size that follows the lists.

    Nulls: a url of null or without ``://`` has empty host and path; rules of null host or path, or
    of another action, are none. Rules' hosts are compared lower-cased. Very long urls and hosts cost
    a key a shape. Repeated pages are judged each. Without rules every page is allowed; an empty
    table gives an empty one. Other columns pass through; only a column named `into` is replaced.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").where("host IS NOT NULL AND path IS NOT NULL AND action IN ('block', 'allow')")
    host, path = parsed(F.col(f"`{url}`"))
    shaped = shapes(rules)
    universe = pages.select(host.alias("h"), path.alias("p")).select(F.explode(asked(F.col("h"), F.col("p"), shaped)["key"]).alias("key"))
    universe = written(universe.distinct())
    lists = {a: cascade(rules.where(F.col("action") == a).select(F.concat("host", "path").alias("key")), universe) for a in ("block", "allow")}
    release(universe)
    rest = [c for c in pages.columns if c != into]
    x = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), host.alias("host"), path.alias("path"), *[level.words.scalar().alias(f"{a}{level.n}") for a, levels in lists.items() for level in levels])
    x = x.withColumn("asked", asked(F.col("host"), F.col("path"), shaped))

    def best(action: str) -> Column:
        levels = lists[action]
        words = [F.col(f"{action}{level.n}") for level in levels]
        return F.array_max(F.filter("asked", lambda k: member(levels, words, k["key"]))) if levels else F.lit(None).cast("struct<n:int,h:int,key:string>")

    x = x.select("row", "host", "path", best("block").alias("block"), best("allow").alias("allow"))
    blocks = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("block") >= F.col("allow")))
    rule = F.when(blocks, F.col("block.key")).otherwise(F.col("allow.key"))
    told = F.struct("host", "path", rule.alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"))
    return x.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], told.alias(into))


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


URLS_SQL = r"""
WITH r(host, path, action) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES) + r"""),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT i, r.host || r.path AS rule, action, row_number() OVER (PARTITION BY i ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, action DESC) AS k
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (i)
"""
