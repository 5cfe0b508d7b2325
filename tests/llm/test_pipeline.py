import os
import re
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomrank.llm import bpe, langid, mix
from loomrank.llm.common import written

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_search_and_groups import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_long_single_lines_go_whatever_stands_around_them(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    texts = {1: f"a\n{long}\nb", 2: f"c\n \n  {long} \nd", 3: long, 4: f"e\n{short}\nf", 5: f"g\n{short}", 6: f"{long}\nh\n{long}", 7: None, 8: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, DATA).collect()}
    assert got == {i: t for i, t in texts.items() if i not in (2, 3, 6)} | {2: "c\n \nd", 6: "h"}


EXTRA = ("mix_note", "n_lines", "n_removed", "lang_pred", "lang_score", "id", "th", "root", "words", "loomrank_th")


def brute_lines(texts: dict, run: int, alone: int) -> dict:
    """Later repeats of runs of lines, and of single lines of many words, deleted one text at a time."""
    solid = {i: [(n, x.strip(" \t\n\v\f\r")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")] for i, t in texts.items()}
    seen, gone = set(), {i: set() for i in texts}
    for many, fits in ((run, lambda w: True), (1, lambda w: len(w[0][1].split()) >= alone)):
        for i in sorted(texts):
            for a in range(len(solid[i]) - many + 1):
                w = solid[i][a : a + many]
                if fits(w):
                    name = (many, tuple(x for _, x in w))
                    if name in seen:
                        gone[i] |= {n for n, _ in w}
                    seen.add(name)
    return {i: t if not gone[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_stage_against_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    near = docs.where("doc_id = 3").first().text
    planted = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 !!", None, None, 6), (10**6 + 2, near + " more", "en", "src1", 0)], docs.schema)
    docs = docs.union(planted)
    for c in EXTRA:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    docs = written(docs)
    whole = Tokenizer.from_file(bpe.default_path())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mix_sources", "tokenize"]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA))
        rows, texts = out.collect(), {r.doc_id: r.text for r in docs.collect()}
        if name != "tokenize":
            assert out.columns == docs.columns
            assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in EXTRA)
            got = {r.doc_id: r.text for r in rows}
        if name == "language_id":
            model = langid.train(docs)
            told = {i: model.predict(t) for i, t in texts.items()}
            want = {i: texts[i] for i, (lang, p) in told.items() if lang != "und" and p >= corpus_pipeline.LEAST_SCORE}
            assert got == want and len(rows) == len(want) == len(texts) - 2
        if name == "line_dedup":
            want = brute_lines(texts, 2, corpus_pipeline.ALONE)
            assert got == {i: t for i, t in want.items() if t == texts[i] or t.split()}
        if name == "minhash_dedup":
            roots = brute(texts, 5, 80, 100)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, root) in roots.items() if i == root)
            assert got == {i: texts[i] for i in got} and any(root != i for i, (_, root) in roots.items())
        if name == "mix_sources":
            many = Counter(r.doc_id for r in rows)
            con = duckdb.connect()
            con.register("documents", docs.select("doc_id", "text", "source").toArrow())
            size = {i: len(re.findall(r"[^ \t-\r]+", t)) for i, t in texts.items()}
            assert {i: many[i] * size[i] for i in texts} == {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken FROM ({mix.mix_sql()})").fetchall()}
        if name == "tokenize":
            assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)] == sorted(r.doc_id for r in docs.collect())
            assert all(r.round_trips and r.ids == whole.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
        docs = out


def test_repeated_rows_null_ids_and_empty_tables(spark):
    """Of equal rows one stays, of near copies without ids too; an empty table stays one through all stages."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, one, "en", "s", 1)] * 3 + [(None, two, "en", "s", 1), (None, two + " more", "en", "s", 1), (None, None, "en", "s", 0), (4, "", "en", "s", 0)], kind)
    got = corpus_pipeline.minhash_dedup(spark, docs, DATA).collect()
    assert len(got) == 4 and [r.doc_id for r in got if r.text == one] == [1] and sum((r.text or "").startswith(two) for r in got) == 1
    empty = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, DATA))
        assert empty.count() == 0
