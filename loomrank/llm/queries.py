"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.session import table

from . import ann, audit, bpe, chat, codes, langid, linededup, maxscore, minhash, mix, passages, sufdedup, urls


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sufdedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.default_path())


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix.mix(docs.select("doc_id", "source", mix.word_count(F.col("text")).alias("words")), F.col("words"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, part=85)
    return near.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected side of pair n."""
    got = chat.preference(table(spark, sf_dir, "conversations"), F.shiftright(F.col("conv_id").cast("long"), 1), F.col("conv_id") % 2 != 0)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return got.withColumns({c: shown(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return told.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = passages.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", "n_shared", "n_spans", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = codes.compress(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark)).select("page_id", "judged.*")


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d),
m AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::BIGINT, 400)) AS m FROM w),
s AS (SELECT doc_id, i FROM m WHERE m IN (SELECT m FROM m GROUP BY m HAVING count(*) > 1)),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
r AS (SELECT doc_id, run, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS since FROM r),
a AS (SELECT k.doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS until, string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (b - since))::BIGINT), '' ORDER BY b) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN until IS NULL THEN h ELSE kept || substr(h, (2 * until + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
      FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM d),
c AS (SELECT md5(array_to_string(g, chr(10))) AS cls, min(doc_id) AS rep, any_value(g) AS g FROM s WHERE len(g) > 0 GROUP BY 1),
x AS (SELECT rep, len(g) AS n, unnest(g) AS gram FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(v, root) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.g) > 0 AND md5(array_to_string(s.g, chr(10))) = c.cls LEFT JOIN m ON m.v = c.rep
"""

QUERIES = {"op1_substrings": op1_substrings, "op2_bpe": op2_bpe, "op3_mix": op3_mix, "op4_topk": op4_topk, "op5_minhash": op5_minhash, "op6_chat": op6_chat, "op7_lines": op7_lines, "op8_ann": op8_ann, "op9_langid": op9_langid, "op10_passages": op10_passages, "op11_codes": op11_codes, "op12_audit": op12_audit, "op13_urls": op13_urls}
ORACLE = {"op1_substrings": OP1_SQL, "op3_mix": mix.mix_sql(), "op4_topk": OP4_SQL, "op5_minhash": OP5_SQL, "op6_chat": chat.PREFERENCE_SQL, "op7_lines": linededup.lines_sql(), "op11_codes": codes.codes_sql(), "op12_audit": audit.AUDIT_SQL, "op13_urls": urls.URLS_SQL}
