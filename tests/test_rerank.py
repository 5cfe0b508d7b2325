import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomrank.functions import text
from loomrank.operators import rerank, retrieval
from loomrank.sources import readers, writers

TEMPLATE = "{n} for {query}\n{listing}"


def _window(spark, places):
    rows = [(q, f"d{i}", i + 1, float(g), p) for q, ps in places.items() for i, (g, p) in enumerate(ps)]
    return spark.createDataFrame(rows, "query_id long, product_id string, stage2_rank int, gain double, position int")


def _texts(spark):
    return spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, query string"), spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(4)], "product_id string, text string")


def test_window_dataset_drops_and_reports_windows_without_a_teacher(spark):
    x = _window(spark, {1: [(0.0, 2), (1.0, 3), (1.0, 1)], 2: [(1.0, None), (0.0, None)]})
    want = {"labels": [0.0, 1.0, 1.0], "llm": [2.0, 1.0, 3.0], "hybrid": [1.0, 2.0, 3.0]}
    for kind, labels in want.items():
        got = {r.query_id: r for r in rerank.window_dataset(x, *_texts(spark), kind).collect()}
        assert got[1].labels == labels and got[1].docs == ["text 0", "text 1", "text 2"] and got[1].query == "q one" and not got[1].dropped
        assert got[2].dropped == (kind != "labels") and (got[2].labels is None) == got[2].dropped
    with pytest.raises(ValueError):
        rerank.window_dataset(x, *_texts(spark), "other")
    queries, texts = _texts(spark)
    partly = _window(spark, {1: [(0.0, 2), (1.0, None)]})
    twice = _window(spark, {1: [(0.0, 1), (1.0, 1)]})
    for bad in (lambda: rerank.window_dataset(partly, queries, texts, "llm"), lambda: rerank.window_dataset(twice, queries, texts, "hybrid"),
                lambda: rerank.window_dataset(x, queries, texts.withColumn("text", F.lit(" ")), "labels"), lambda: rerank.window_dataset(x, queries.where("query_id = 2"), texts, "labels")):
        with pytest.raises(PySparkException):
            bad().collect()


def test_pairwise_rows(spark):
    x = _window(spark, {1: [(0.0, 1), (1.0, 2)]})
    got = sorted(tuple(r) for r in rerank.pairwise_rows(x, *_texts(spark)).collect())
    assert got == [(1, "d0", "q one", "text 0", 0.0), (1, "d1", "q one", "text 1", 1.0)]
    queries, texts = _texts(spark)
    for bad in (rerank.pairwise_rows(x, queries.where("false"), texts), rerank.pairwise_rows(x, queries, texts.where("product_id = 'd0'"))):
        with pytest.raises(PySparkException):
            bad.collect()


def test_listwise_rerank_from_cache_call_and_fallback(spark):
    docs = ["a", "b", "c"]
    windows = spark.createDataFrame([(i, f"query {i}", docs, ["A", "B", "C"]) for i in range(5)], "query_id long, query string, docs array<string>, titles array<string>")
    fp = windows.limit(1).select(rerank.prompt_fingerprint(TEMPLATE)).first()[0]
    key = {r.query_id: r.k for r in windows.select("query_id", text.window_key(F.col("query"), F.col("docs")).alias("k")).collect()}
    cache = spark.createDataFrame([(key[0], [3, 1, 2], "m", fp), (key[0], [3, 1, 2], "m", fp), (key[1], [1, 1, 2], "m", fp), (key[2], [3, 2, 1], "other", fp)], "window_key string, permutation array<int>, model string, prompt_fp string")

    def opener():
        def call(prompt):
            if "query 3" in prompt:
                raise OSError
            assert prompt.startswith("3 for query ") and "[2] B" in prompt
            return ("no order" if "query 4" in prompt else "[2] > [3] > [1]"), 10, 2, 1

        return call

    out = rerank.listwise_rerank(windows, cache, TEMPLATE, opener, "m").persist()
    got = {r.query_id: (r.source, r.ordering) for r in out.collect()}
    assert got == {0: ("cache", ["c", "a", "b"]), 1: ("call", ["b", "c", "a"]), 2: ("call", ["b", "c", "a"]), 3: ("fallback", docs), 4: ("fallback", docs)}
    u = rerank.usage(out).first()
    assert (u.n_calls, u.n_cached, u.n_fallback, u.prompt_tokens, u.reasoning_tokens) == (4, 1, 2, 30, 3)
    assert sorted((r.window_key, r.permutation, r.k) for r in rerank.new_answers(out).collect()) == sorted((key[i], [2, 3, 1], 3) for i in (1, 2))
    assert rerank.listwise_rerank(windows.where("false"), cache, TEMPLATE, opener, "m").count() == 0


def test_embedded_images_are_the_new_ones_only(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "url string")
    stored = spark.createDataFrame([("c", [1.0])], "key string, embedding array<float>")
    get = lambda u: ("ok", u) if u == "a" else ("missing", None)
    got = rerank.embedded_images(urls, stored, lambda: get, lambda: lambda x: [[1.0, 2.0]] * len(x), 2)
    assert sorted((r.url, r.status, r.embedding) for r in got.collect()) == [("a", "ok", [1.0, 2.0]), ("b", "missing", None)]
    assert {r.status: r.n for r in rerank.status_counts(got).collect()} == {"ok": 1, "missing": 1}
    with pytest.raises(PySparkException):
        rerank.embedded_images(urls, stored, lambda: get, lambda: lambda x: [[1.0]] * len(x), 2).collect()


def test_a_brace_in_a_query_is_no_place_of_the_template(spark):
    x = spark.range(1).select(rerank.prompt(TEMPLATE, F.lit("{listing} {n}"), F.array(F.lit("t"))).alias("p")).first().p
    assert x == "1 for {listing} {n}\n[1] t"


def test_records_sidecars_and_index(spark, tmp_path):
    writers.model_record(spark, str(tmp_path / "store"), "m1", 128)
    readers.check_model_record(spark, str(tmp_path / "store"), "m1", 128)
    for bad in (("m2", 128), ("m1", 64)):
        with pytest.raises(ValueError):
            readers.check_model_record(spark, str(tmp_path / "store"), *bad)
    with pytest.raises(ValueError):
        readers.check_model_record(spark, str(tmp_path / "none"), "m1")
    folds = spark.createDataFrame([(2, 1), (1, 0)], "query_id long, fold int")
    told = writers.frozen_folds(folds, str(tmp_path / "folds"))
    assert len(told) == 64 and readers.frozen_folds(spark, str(tmp_path / "folds")).orderBy("query_id").collect() == folds.orderBy("query_id").collect()
    for crc in (tmp_path / "folds").glob(".*.crc"):
        crc.unlink()
    next((tmp_path / "folds").glob("*.csv")).write_text("query_id,fold\n1,1\n2,1\n")
    with pytest.raises(ValueError):
        readers.frozen_folds(spark, str(tmp_path / "folds")).collect()
    docs = spark.createDataFrame([(1, "red ring"), (2, "the")], "doc long, t string")
    index, stats = retrieval.postings(docs, "doc", F.col("t")), retrieval.document_stats(docs, F.col("t"))
    writers.bm25_index(index, stats, docs, str(tmp_path / "i"))
    assert readers.bm25_index(spark, str(tmp_path / "i"))[0].count() == 2
    writers.bm25_index(index, stats, docs.where("doc = 2"), str(tmp_path / "j"))
    with pytest.raises(ValueError):
        readers.bm25_index(spark, str(tmp_path / "j"))
