"""Stemming against published examples, and the block-max index against plain scoring."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomrank.functions import stemming
from loomrank.operators import bm25, retrieval

# Words and stems from the algorithm's published sample vocabulary.
SAMPLE = {"consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori",
          "consolidating": "consolid", "consolingly": "consol", "consonant": "conson", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir", "constable": "constabl", "constancy": "constanc",
          "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "kneels": "kneel", "knees": "knee", "knightly": "knight", "knitted": "knit", "knives": "knive", "knocker": "knocker", "knots": "knot"}
# Rules one by one: regions and their exceptions, y as a consonant, short words, doubled letters, invariants.
RULES = {"generate": "generat", "generic": "generic", "communism": "communism", "arsenal": "arsenal", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "hoped": "hope",
         "luxuriating": "luxuri", "falling": "fall", "agreed": "agre", "feed": "feed", "by": "by", "say": "say", "cry": "cri", "sky": "sky", "skies": "sky", "news": "news", "inning": "inning", "proceeds": "proceed", "youth": "youth", "sensational": "sensat",
         "relational": "relat", "analogi": "analog", "radically": "radic", "quickly": "quick", "rate": "rate", "roll": "roll", "controll": "control", "adoption": "adopt", "union": "union", "'cause": "caus", "dog's": "dog", "a": "a", "12": "12", "3d": "3d"}


@pytest.mark.parametrize("word,want", sorted((SAMPLE | RULES).items()))
def test_stem(word, want):
    assert stemming.stem(word) == want


def test_stems_of_a_vocabulary(spark):
    frame = spark.createDataFrame([("running",), ("runs",), (None,), ("running",)], "term string")
    assert sorted(map(tuple, stemming.stems(frame).collect())) == [("running", "run"), ("runs", "run")]


def plain(docs, queries, k, stem):
    """All scores by the formula, from the texts."""
    cut = lambda t: [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in retrieval.STOPWORDS]
    told = {i: cut(t) for i, t in docs}
    mean = sum(map(len, told.values())) / len(told)
    df = {}
    for ts in told.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        scores = {}
        for i, ts in told.items():
            s = sum(math.log(1 + (len(told) - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in cut(text) if t in df)
            if s > 0:
                scores[i] = round(s, 9)
        out[q] = [(i, scores[i]) for i in sorted(scores, key=lambda i: (-scores[i], i))[:k]]
    return out


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_equals_plain_scores(spark, stemmed, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 70)  # three shards
    r = random.Random(2)
    words = ["run", "running", "runs", "ring", "rings", "blue", "gear", "gears", "the", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "the of")]
    docs += [(600 + i, docs[3][1]) for i in range(12)]  # ties past the last rank
    queries = [(1, "running gear"), (2, "the blue rings rings"), (3, "nothing here"), (4, None), (5, docs[3][1]), (6, "w1 w2 w3 w4 run")]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index = bm25.build(d, "doc", F.col("text"), str(tmp_path / "i"), stemmed, block=4)
    want = plain(docs, queries, 5, stemming.stem if stemmed else lambda w: w)
    got = {}
    for x in bm25.top(index, q, F.col("text"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.doc, round(x.bm25_score, 9)))
    assert got.keys() == {k for k, v in want.items() if v}
    for k, v in got.items():
        assert [i for i, _ in v] == [i for i, _ in want[k]] and [s for _, s in v] == pytest.approx([s for _, s in want[k]])
    terms, buckets = bm25.weighted_terms(index, q, F.col("text"))
    all_blocks = terms.join(index.read(spark, "blocks"), ["bucket", "term"]).count()
    assert bm25.surviving_blocks(index, terms, buckets, 1).count() < bm25.surviving_blocks(index, terms, buckets, 5).count() < all_blocks
    pairs = spark.createDataFrame([(1, 3), (5, 3), (3, 4), (5, 500)], "query_id long, doc long")
    every = plain(docs, queries, 10**6, stemming.stem if stemmed else lambda w: w)
    for x in bm25.of_pairs(index, q, F.col("text"), pairs).collect():
        assert x.bm25_score == pytest.approx(dict(every[x.query_id]).get(x.doc, 0.0))
    assert 0 < len(buckets) < bm25.BUCKETS and {x.bucket for x in terms.select("bucket").distinct().collect()} <= set(buckets)
    plan = bm25._pruned(index.read(spark, "blocks"), buckets)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_index_of_nothing_and_of_bad_keys(spark, tmp_path):
    d = spark.createDataFrame([(1, "ring")], "doc long, text string")
    q = spark.createDataFrame([(1, "ring")], "query_id long, text string")
    none = bm25.build(d.where("false"), "doc", F.col("text"), str(tmp_path / "none"))
    assert bm25.top(none, q, F.col("text"), 3).count() == 0
    for n, bad in enumerate((d.union(d), spark.createDataFrame([(None, "ring")], d.schema))):
        with pytest.raises(ValueError):
            bm25.build(bad, "doc", F.col("text"), str(tmp_path / f"bad{n}"))


@pytest.mark.parametrize("stemmed", [False, True])
def test_terms_are_counted_without_a_shuffle(spark, stemmed):
    d = spark.createDataFrame([(1, "runs run the runs"), (2, None)], "doc long, text string")
    got = bm25.term_counts(d, ["doc"], F.col("text"), stemmed)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == ([(1, "run", 3, 3)] if stemmed else [(1, "run", 1, 3), (1, "runs", 2, 3)])
