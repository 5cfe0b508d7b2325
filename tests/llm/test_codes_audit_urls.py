"""Vector codes, filter audit and URL rules against plain Python on awkward rows; their SQL runs over the test tables."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.llm import audit, codes, queries, urls

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_codes", "op12_audit", "op13_urls"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    rows = lambda x: sorted(tuple("" if v is None or v != v else v for v in r) for r in x[sorted(want.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def lloyd(rows, parts, entries, rounds):
    """rows of (id, whole vector); whole numbers throughout."""
    wide = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in rows:
                groups.setdefault(near(cut(v, p), books[p]), []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for _, v in rows:
        at = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append(("".join(f"{e:02x}" for e in at), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(at))))
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    return out, digest


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_codes_equal_plain_lloyd(spark, scale):
    r = random.Random(int(scale) % 97)
    near = [[float(np.float32(r.gauss(0, 1) * scale)) for _ in range(8)] for _ in range(12)]
    rows = [(i, near[r.randrange(12)] if i % 3 == 0 else [float(np.float32(x + r.gauss(0, 0.1) * scale)) for x in near[r.randrange(12)]], r.choice([1, 2, None])) for i in range(90)]
    rows += [(5, rows[5][1], 1), (None, rows[7][1], 3), (None, rows[8][1], None)]
    odd = [(200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [float("nan")] + [0.0] * 7, 1), (203, [float("inf")] + [0.0] * 7, 1), (204, [1.0] * 7, 9), (205, [1.0] * 4, 2), (206, [], 9)]
    frame = spark.createDataFrame([(*x, "clash") for x in rows + odd], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = codes.compress(frame, entries=16, rounds=3).collect()
    whole = lambda v: [int(x) * 1024 if abs(x) >= 2**52 else int(np.floor(x * 1024)) for x in v]
    plain = [(i, whole(v)) for i, v, _ in rows]
    want, digest = lloyd(plain, 4, 16, 3)
    top = (1 << 63) - 1
    sums = {}
    for (_, _, label), (_, e) in zip(rows, want):
        sums[label] = sums.get(label, 0) + e
    expect = [(i, label, c, min(e, top), min(sums[label], top), digest) for (i, _, label), (c, e) in zip(rows, want)]
    expect += [(204, 9, None, None, None, digest), (205, 2, None, None, min(sums[2], top), digest), (206, 9, None, None, None, digest)]
    show = lambda x: sorted(map(str, x))
    assert show(tuple(x) for x in got) == show(expect)


def test_codes_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [0.5] * 4, 1)] * 3 + [(2, [-0.5] * 4, 1)], "vec_id long, embedding array<float>, label int")
    got = codes.compress(frame).collect()
    assert sorted((r.id, r.code, r.error) for r in got) == [(1, "00000000", 0)] * 3 + [(2, "03030303", 0)]
    assert codes.compress(frame.where("false")).count() == 0
    assert [(r.code, r.error) for r in codes.compress(frame.limit(1).withColumn("embedding", F.array().cast("array<float>"))).collect()] == [("00000000", 0)]


def brute_audit(docs, labels):
    def fails(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t) is not None)

    rows = []
    for i, t, p in docs:
        t, p = t or "", p or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        mine = [(q, x) for j, q, x in labels if j is not None and j == i]
        rows.append((p, (*fails(t), copy), any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                at = "ABCDE".index(f)
                here = [r for r in alive if r[1][at]]
                alive = [r for r in alive if not r[1][at]]
                only = sum(r[1][at] and sum(r[1]) == 1 for r in rows if r[0] == part)
                out[part, "".join(order), step] = [len(alive), len(here), sum(r[1][at] for r in gone), only, sum(r[2] for r in here), sum(r[3] for r in here)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(here)
                gone += here
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("near_bytes", [audit.NEAR_BYTES, 600])
def test_audit_equals_brute_force(spark, near_bytes, monkeypatch):
    monkeypatch.setattr(audit, "NEAR_BYTES", near_bytes)
    r = random.Random(3)
    long = [" ".join(f"w{r.randrange(k)}" for _ in range(260)) for k in (40, 5000, 5000, 5000)]
    texts = [None, "", "AB cd", "a\x1cb # c", "é" * 60 + "A", "\x85 x\xa0y", long[0], long[1], long[2] + " $", long[3].upper(), "z " * 150_000]
    docs = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["a", "a", "b", "", None])) for _ in range(150)]
    docs += [(77, "copied", "a")] * 8 + [(76, "copied", "b"), (90, "copied", "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 40, 2), 4, 4, 77, 77, None, 500]]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, mask int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in audit.audit(d, lab).collect()}
    assert got == brute_audit(docs, labels)
    assert audit.audit(d.where("false"), lab).count() == 0


def test_equal_fingerprints_of_different_texts_are_no_copies():
    chain = [((7, 1), (b"x", 1, {("a", 0): 1})), ((7, 2), (b"y", 2, {("a", 0): 1})), ((7, 3), (b"x", 3, {("a", 1): 2})), ((8, 4), (b"x", 4, {("a", 0): 1}))]
    assert list(audit._settled(iter(chain))) == [(1, "a", 0, 1), (2, "a", 0, 1), (3, "a", 1 | audit.COPY, 2), (4, "a", 0, 1)]
    same = [(7, 5, "a", "x"), (7, 6, "a", "y"), (7, 3, "b", "x"), (7, 5, "a", "x"), (7, None, "a", "x")]
    sent = sorted(((k[1], v[0], v[1], v[2]) for k, v in audit._near(iter(same))), key=str)
    assert (3, b"x", 3, {("b", 1): 1}) in sent and (6, b"y", 6, {("a", 1): 1}) in sent and (0, None, 5, {("a", 1 | audit.COPY): 2}) in sent and (0, None, None, {("a", 1): 1}) in sent and len(sent) == 4


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans(urls.UPPER, urls.LOWER))
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fit = [(len(h + p), len(h), a == "block", h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


def test_urls_equal_brute_force(spark):
    r = random.Random(9)
    names, steps = ["net", "org", "example", "b", "WWW", "x-y", "日本", ""], ["", "/", "/en", "/en/", "/de/a", "/日/", "/EN/", "//"]
    rules = {(".".join(r.choice(names).lower() for _ in range(r.randint(1, 3))), r.choice(steps)) for _ in range(60)}
    rules = [(h, p, r.choice(["block", "allow"])) for h, p in sorted(rules)]
    rules += [(rules[0][0], rules[0][1], "allow"), (rules[0][0], rules[0][1], "block")]
    made = ["://".join([r.choice(["http", "", "A"]), ".".join(r.choice(names) for _ in range(r.randint(0, 5))) + r.choice(["", ":80"]) + r.choice(steps) + r.choice(["", "x/y", "?q=/en/", "#/de/a", "x" * 3000])]) for _ in range(3000)]
    made += [None, "", "no host", "http:/one", "a://b://net/en/", "http://net", "http://net?/", "x://\nnet/\n"]
    pages = spark.createDataFrame([(i, u, "h", 1, 2) for i, u in enumerate(made)] * 2, "page_id long, url string, host string, asked int, judged int").repartition(3)
    given = spark.createDataFrame([*rules, ("net", None, "block"), (None, "/", "block"), ("net", "/", "other")], "host string, path string, action string")
    got = urls.judge(pages, given)
    assert got.columns == ["page_id", "url", "host", "asked", "judged"] and got.count() == 2 * len(made)
    for x in got.collect():
        assert tuple(x.judged) == brute_verdict(x.url, rules), x.url
    assert {x.judged.verdict for x in urls.judge(pages, given.where("false")).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), given).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.xxhash64("key") % 29 == 0).union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    levels = urls.cascade(listed, universe)
    assert len(levels) > 3 and levels[0].bits < 2 * sum(x.bits for x in levels[1:]) + 64 * listed.count()
    got = universe.select("key", *[x.words.scalar().alias(f"w{x.n}") for x in levels])
    got = got.where(urls.member(levels, [F.col(f"w{x.n}") for x in levels], F.col("key"))).select("key")
    assert got.exceptAll(listed).count() == 0 and got.count() == listed.count() - 2
    assert urls.cascade(listed.where("false"), universe) == []
