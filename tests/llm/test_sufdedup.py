import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomrank.llm import sufdedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        off = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                off[i : i + length] = True
        kept = bytes(b for b, o in zip(d, off) if not o)
        out.append((len(d), int(off.sum()), int((np.diff(np.concatenate([[0], off.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    passage = [" ".join(word() for _ in range(80)) for _ in range(4)]
    texts = [None, "", "short", "a" * 700, "ab" * 300, passage[0], passage[0]]
    for _ in range(40):
        p = r.choice(passage)
        cut = r.randint(0, len(p) - 1)
        texts.append(" ".join(word() for _ in range(r.randint(0, 60))) + p[cut : cut + r.randint(100, 400)] + " ".join(word() for _ in range(30)))
    return texts + texts[-3:]


def test_repeated_starts_against_counting():
    r = random.Random(3)
    for alphabet in ("ab", "abcdefgh"):
        bodies = ["".join(r.choice(alphabet) for _ in range(r.randint(12, 60))).encode() for _ in range(30)]
        bodies += bodies[:3]
        starts = np.array([len(b) - 9 for b in bodies])
        copies = np.array([1.0] * len(bodies))
        copies[5] = 2
        got = sufdedup.repeated_starts(bodies, starts, copies, 10)
        count = Counter()
        for b, m in zip(bodies, copies):
            for i in range(len(b) - 9):
                count[b[i : i + 10]] += m
        assert got.tolist() == [count[b[i : i + 10]] >= 2 for b in bodies for i in range(len(b) - 9)]


def test_against_brute_force(spark, monkeypatch):
    for largest in (sufdedup.LARGEST, 500):  # with 500 nearly all marks are matched by hash
        monkeypatch.setattr(sufdedup, "LARGEST", largest)
        texts = sample()
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sufdedup.dedup_substrings(docs).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "x"), (None, None), (2, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in sufdedup.dedup_substrings(docs).collect())
    assert got == [(0, 0), (0, len(text)), (1, len(text)), (1, len(text)), (2, 0)]
    assert sufdedup.dedup_substrings(docs.where(F.lit(False))).count() == 0


def test_many_equal_rows_stay_linear(spark):
    t = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    docs = spark.createDataFrame([(1, t)] * 150 + [(None, t)] * 50, "doc_id long, text string")
    spans = sufdedup.repeated_spans(docs, 60).collect()
    assert len(spans) == 2 and all(len(r.spans) <= 2 * 500 for r in spans)
    got = sufdedup.dedup_substrings(docs, 60).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans, r["count"]) for r in got) == [(0, 500, 1, 50), (1, 500, 1, 150)]
