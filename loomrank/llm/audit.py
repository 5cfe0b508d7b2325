"""How filters of a corpus interact: what each removes, repeats and loses, for every order in which they may be applied."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged

#: The filters, in the order of their bits in a mask. E is the exact copy of a smaller id's text.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 2
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
COPY = 1 << LETTERS.index("E")
MASKS = 1 << len(LETTERS)
#: Bytes of texts that a task keeps at hand while it looks for copies before the shuffle; with more it hands them on and begins anew.
NEAR_BYTES, HELD_ROW = 16 << 20, 200
#: Bytes of text that a partition of the shuffle is meant to get.
ROUTED_BYTES = 32 << 20


def own_mask(text: bytes, points: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails."""
    words = text.split()  # of bytes: at \\x20 and \\x09 to \\x0D only
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (n < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_SHARE * n, 100 * capitals > CAPITAL_SHARE * points, _MARKS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _near(rows: Iterator) -> Iterator:
    """Rows of a scan as ((fingerprint, id), (text, {(part, mask): rows})), with texts for those only that may be the first of their copies.

    Copies that meet in the task are settled here, so a text that a third of the corpus repeats
    travels once a task and not once a row. What is settled travels without text, by a hash of its
    id, and equal settled rows as one.
    """
    held: dict[int, list] = {}  # fingerprint -> chain of [text, least id, {(part, mask): rows}]
    settled: dict[tuple, int] = {}  # (hash to travel by, id, part, mask) -> rows
    size = 0
    for fp, id, part, text in rows:
        data = text.encode()
        found = {(part, own_mask(data, len(text))): 1}
        if id is None:
            _settle(settled, fp, None, found, 0)
            continue
        chain = held.setdefault(fp, [])
        entry = next((e for e in chain if e[0] == data), None)
        if entry is None:
            chain.append([data, id, found])
            size += len(data)
        elif id == entry[1]:
            _settle(entry[2], None, None, found, 0)
        elif id > entry[1]:
            _settle(settled, _spread(id), id, found, COPY)
        else:
            _settle(settled, _spread(entry[1]), entry[1], entry[2], COPY)
            entry[1:] = [id, found]
        if size + HELD_ROW * (len(held) + len(settled)) > NEAR_BYTES:
            yield from _handed(held, settled)
            held, settled, size = {}, {}, 0
    yield from _handed(held, settled)


def _settle(rows: dict, by: int | None, id: int | None, found: dict, copy: int) -> None:
    """Adds rows of (part, mask) to those of a text (by is None), or to the settled ones."""
    for (part, mask), n in found.items():
        key = (part, mask) if by is None else (by, id, part, mask | copy)
        rows[key] = rows.get(key, 0) + n


def _spread(id: int) -> int:
    return id * 0x9E3779B97F4A7C15 >> 16 & 0xFFFFFFFF


def _handed(held: dict[int, list], settled: dict[tuple, int]) -> Iterator:
    for fp, chain in held.items():
        for data, id, rows in chain:
            yield (fp, id), (data, id, rows)
    for (by, id, part, mask), n in settled.items():
        yield (by, 0), (None, id, {(part, mask): n})


def _settled(rows: Iterator) -> Iterator:
    """(id, part, mask, rows) of a partition that is sorted by fingerprint and id.

    Of the current fingerprint a chain of (full text, minimum id) is stored; texts that differ though
    their fingerprints are equal are other links of it. A row whose text stands in the chain with a
    smaller id is a non-minimum one.
    """
    now, chain = None, []
    for (fp, _), (data, id, found) in rows:
        copy = 0
        if data is not None:
            if fp != now:
                now, chain = fp, []
            first = next((least for text, least in chain if text == data), None)
            if first is None:
                chain.append((data, id))
            elif first < id:
                copy = COPY
        for (part, mask), n in found.items():
            yield id, part, mask | copy, n


def _route(key: tuple) -> int:
    """By fingerprint, so that all copies of a text that travel meet."""
    return key[0]


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (id, part, mask, n): n documents of an id and part fail the filters of mask.

    Texts are routed by their 64-bit xxhash to partitions, which Spark sorts by (hash, id), spilling
    to disk, so that a task holds the chain of one hash at a time and no group of copies. Their
    number follows the bytes of all texts, ROUTED_BYTES for each at most if none had copies.

    Nulls: a null text is an empty one, a null part the empty string. A row of null id is no copy
    and has none. Rows equal in id and text aren't copies of each other.
    """
    rows = docs.select(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{part}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))).rdd
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    n = max(-(-size // ROUTED_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitions(_near).repartitionAndSortWithinPartitions(n, _route)
    got = docs.sparkSession.createDataFrame(routed.mapPartitions(_settled), "id long, part string, mask int, n long", verifySchema=False)
    return got.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def _zero() -> list[int]:
    return [0] * (3 * MASKS)


def _counted(vector: list[int], row) -> list[int]:
    for i, x in enumerate((row.n, row.n * row.good, row.n * row.toxic)):
        vector[i * MASKS + row.mask] += x
    return vector


def _added(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def report(vector: list[int]) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the counts of a part by mask: all documents, the good and the toxic ones."""
    every, good, toxic = (vector[i * MASKS : (i + 1) * MASKS] for i in range(3))
    total = lambda counts, fits: sum(n for mask, n in enumerate(counts) if fits(mask))
    out, shapley = [], dict.fromkeys(LETTERS, 0)
    for order in itertools.permutations(range(len(LETTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            bit = 1 << i
            here = lambda m: m & bit and not m & before  # noqa: B023, E731
            removed = total(every, here)
            shapley[LETTERS[i]] += removed
            out.append(("".join(LETTERS[j] for j in order), step, LETTERS[i], total(every, lambda m: not m & (before | bit)), removed,
                        total(every, lambda m: m & bit and m & before), every[bit], total(good, here), total(toxic, here)))
            before |= bit
    for order, step, letter, *counts in out:
        yield (order, step, *counts, shapley[letter])


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step, zeros included.

    Failure conditions of a text: A, under 200 words; B, 100 * distinct words < 50 * words; C, 100 *
    capitals > 2 * code points; D, any of ``#$%&*|``; E, identical to the text of any smaller id,
    removed or not. Counts are of documents of the part: kept after the step, removed by it, redundant
    (fails its filter but was removed before), unique_fails (fails its filter only), good_lost and
    toxic_lost (removed here, of labels with quality or toxic 1), shapley (removed by its filter,
    summed over all orders).

    Documents are counted by mask of failed filters, and the 32 counts of a part, merged map-side,
    give all its rows; no order costs a pass. Nulls: see masks(); an id that has several labels is
    good or toxic if any says so, one without labels is neither. Repeated rows count each. No
    documents give no rows. Other columns aren't looked at.
    """
    told = labels.groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    found = masks(docs, key, text, part).join(merged(told), "id", "left").fillna(0, ["good", "toxic"])
    counts = found.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r.part, r)).combineByKey(lambda r: _counted(_zero(), r), _counted, _added)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: ((x[0], *row) for row in report(x[1]))), REPORT, verifySchema=False)


AUDIT_SQL = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT o, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, o, step, any_value(bit) AS bit, sum(n) FILTER (mask & (coalesce(before, 0)::INT | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0) AS removed,
        sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0) AS toxic_lost
      FROM c, s GROUP BY part, o, step)
SELECT part, o AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM x
"""
