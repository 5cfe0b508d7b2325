"""Registered queries of the engine's operators with their DuckDB equivalents. Keys begin with the inventory's row ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import nested, numeric, stemming, text
from loomrank.operators import aggregates as agg
from loomrank.operators import bm25, features, metrics, ranking, relational, retrieval
from loomrank.session import scratch, table
from loomrank.sources import readers, writers

from . import views as v

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEY = ["query_id", "product_id"]


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def r9(*columns: str) -> list:
    return [F.round(c, 9).alias(c) for c in columns]


# --- scans, projections, filters -------------------------------------------------

@add("s1_scan", "SELECT * FROM part")
def _(s, d):
    return readers.parquet(s, f"{d}/part.parquet")


@add("s2_pruned_scan", "SELECT p_partkey, p_brand FROM part")
def _(s, d):
    return readers.parquet(s, f"{d}/part.parquet", ["p_partkey", "p_brand"])


@add("s3_split_loader", f"WITH {v.J}, {v.P} SELECT query_id, product_id, label, gain, qrel FROM j SEMI JOIN p USING (product_id) WHERE query_id % 2 = 0")
def _(s, d):
    x = v.judgements(s, d).where("query_id % 2 = 0").join(v.products(s, d), "product_id", "left_semi")
    return relational.first_per_key(x, KEY, [F.col("label")]).select(*KEY, "label", "gain", "qrel")


@add("s5_trec_roundtrip", f"WITH {v.J} SELECT query_id::VARCHAR AS query_id, product_id, stage2_score AS score, 'run1' AS tag FROM j")
def _(s, d):
    lines = writers.trec_lines(v.judgements(s, d), "run1", "stage2_score")
    return readers.parse_trec(lines.select("value"))


@add("s17_counter_total", "SELECT event_id, ((event_id % 7) + 2.5)::DOUBLE AS total FROM events")
def _(s, d):
    body = F.concat(F.lit("# HELP hits\nhits{a=\"1\"} "), (F.col("event_id") % 7).cast("string"), F.lit("\nother 9\nhits 2.5"))
    return table(s, d, "events").select("event_id", text.counter_total(body, "hits").alias("total"))


@add("p1_conjunctive_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 30")
def _(s, d):
    return table(s, d, "lineitem").where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 30)).select("l_orderkey", "l_linenumber", "l_quantity")


RAW = """r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'uk' ELSE 'us' END AS locale, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'book' ELSE 'product' END AS type FROM events)"""


def _raw(s, d):
    return table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "uk").otherwise("us").alias("locale"),
                                        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "book").otherwise("product").alias("type"))


@add("p3_a16_pass_counters", f"""WITH {RAW} SELECT count(*) AS seen, count(*) FILTER (locale <> 'us') AS other_locale, count(*) FILTER (locale = 'us' AND type = 'error') AS errors,
  count(*) FILTER (locale = 'us' AND type <> 'error') AS kept, count(*) FILTER (locale = 'us' AND type = 'book') / count(*) FILTER (locale = 'us' AND type <> 'error') AS book_share FROM r""")
def _(s, d):
    return agg.pass_counters(_raw(s, d), "us")


@add("p6_normalise", """SELECT 'A' || p_partkey AS asin, CASE WHEN p_partkey % 4 = 0 THEN 'book' ELSE 'product' END AS type, p_name AS title, lower(p_type) AS description,
  'https://x/images/I/' || p_partkey || '.jpg' AS image_url, '{"a":"1","b":"' || p_size || '"}' AS attrs_json, CASE WHEN p_partkey % 4 <> 0 THEN (1000 + p_partkey)::INT ELSE -1 END AS bsr_rank,
  CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS bsr_category, (p_size % 5)::DOUBLE + 0.5 AS stars, 1000 + p_size AS ratings, 1000 + p_size + 0.5::DOUBLE AS price, p_partkey % 3 = 0 AS price_multi, 0 AS n_reviews FROM part""")
def _(s, d):
    p = table(s, d, "part")
    book = F.col("p_partkey") % 4 == 0
    t = lambda x: F.col(x).cast("string")
    none = F.lit(None).cast("string")
    desc = F.concat(F.lit("  "), F.lower("p_type"), F.lit(" "))
    image = F.concat(F.lit("https://x/images/W/q1/images/I/"), t("p_partkey"), F.lit(".jpg"))
    attrs = F.concat(F.lit('{"b":"'), t("p_size"), F.lit('","a":"1"}'))
    price = F.concat(F.lit("$1,0"), F.lpad(t("p_size"), 2, "0"), F.lit(".50"))
    info = F.when(~book, F.concat(F.lit('{"Best Sellers Rank":"#'), F.format_number(F.col("p_partkey") + 1000, 0), F.lit(" in "), F.col("p_type"), F.lit(' ( See Top 100 in X ) #7 in Y"}')))
    raw = p.select(F.concat(F.lit("A"), t("p_partkey")).alias("asin"), F.lit("us").alias("locale"), F.when(book, "book").otherwise("product").alias("type"), none.alias("error"), none.alias("template"),
                   F.col("p_name").alias("title"), none.alias("subtitle"), none.alias("author"), F.when(~book, desc).alias("description"), F.when(book, desc).alias("desc"),
                   F.when(~book, image).alias("image"), F.when(book, image).alias("img"), F.concat((F.col("p_size") % 5).cast("string"), F.lit(".5 out of 5 stars")).alias("stars"),
                   F.concat(F.lit("1,0"), F.lpad(t("p_size"), 2, "0"), F.lit(" ratings")).alias("ratings"), F.when(F.col("p_partkey") % 3 == 0, F.concat(price, F.lit(" $12.99"))).otherwise(price).alias("price"),
                   F.when(~book, attrs).alias("attrs"), F.when(book, attrs).alias("attr"), info.alias("info"),
                   *[F.lit(None).cast(k).alias(n) for n, k in (("bullets", "array<string>"), ("category", "array<string>"), ("reviews", "array<map<string,string>>"))])
    return readers.normalise(raw).select("asin", "type", "title", "description", "image_url", "attrs_json", F.coalesce("bsr_rank", F.lit(-1)).alias("bsr_rank"), "bsr_category", "stars", "ratings", "price", "price_multi", "n_reviews")


@add("p11_p12_presence", f"WITH {v.P} SELECT product_id, coalesce(length(product_brand) > 0, false) AS brand, coalesce(len(s_category) > 0, false) AS category FROM e")
def _(s, d):
    return v.enriched(s, d).select("product_id", nested.present(F.col("product_brand")).alias("brand"), nested.present_list(F.col("s_category")).alias("category"))


FOLD = "(('0x' || substr(sha256('val-folds/v1:' || query_id), 1, 16))::UBIGINT % 5)::INT"


@add("f11_p14_folds", f"WITH {v.J} SELECT query_id, product_id, {FOLD} AS fold, {FOLD} <> 0 AS training FROM j")
def _(s, d):
    train, val = relational.train_validation(v.folded(s, d), 0)
    cut = lambda x, t: x.select(*KEY, "fold", F.lit(t).alias("training"))
    return cut(train, True).unionByName(cut(val, False))


@add("p13_p19_fold_selection", f"WITH {v.J}, f AS (SELECT *, {FOLD} AS fold FROM j) SELECT query_id, product_id, fold, fold IN (2, 3) AS in_sample FROM f WHERE fold IN (1, 2, 3)")
def _(s, d):
    return relational.in_sample(relational.folds(v.folded(s, d), [1, 2, 3]), [2, 3]).select(*KEY, "fold", "in_sample")


@add("p15_feature_columns", f"WITH {v.P} SELECT product_id, coalesce(length(product_brand) > 0, false)::INT::DOUBLE AS has_brand, coalesce(length(product_color) > 0, false)::INT::DOUBLE AS has_color, coalesce(length(product_description) > 0, false)::INT::DOUBLE AS has_own_desc, coalesce(length(product_bullet_point) > 0, false)::INT::DOUBLE AS has_bullets FROM e")
def _(s, d):
    return features.product_matrix(v.enriched(s, d)).select("product_id", *relational.selected(features.GROUPS, ["own_indicators"]))


@add("p16_image_urls", f"WITH {v.J}, {v.P} SELECT product_id, replace(s_image_url, '/images/W/abc/images/I/', '/images/I/') AS url FROM e WHERE s_image_url IS NOT NULL AND product_id IN (SELECT product_id FROM j WHERE label = 'E')")
def _(s, d):
    judged = v.judgements(s, d).where("label = 'E'")
    return v.enriched(s, d).where("s_image_url IS NOT NULL").join(judged, "product_id", "left_semi").select("product_id", text.normalize_url(F.col("s_image_url")).alias("url"))


@add("p17_r2_pending", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def _(s, d):
    e = table(s, d, "events")
    return relational.pending(e, e.where("event_type = 'signup'").select("user_id"), "user_id")


@add("p21_example_queries", f"WITH {v.S} SELECT query_id, count(DISTINCT label) AS n_labels FROM s WHERE NOT regexp_matches(query, '(?i)bolt|gear') GROUP BY query_id HAVING count(DISTINCT label) >= 3")
def _(s, d):
    x = v.signals(s, d).where(~text.mentions(F.col("query"), "bolt", "gear"))
    return x.groupBy("query_id").agg(F.countDistinct("label").alias("n_labels")).where("n_labels >= 3")


@add("p22_label_maps", f"WITH {v.J} SELECT label, gain, qrel, label_code, count(*) AS n FROM j GROUP BY ALL")
def _(s, d):
    return v.judgements(s, d).groupBy("label", "gain", "qrel", "label_code").agg(F.count("*").alias("n"))


@add("p23_f4_document_text", f"WITH {v.P} SELECT product_id, substr(product_title || coalesce(' ' || description, ''), 1, 12) AS doc FROM e")
def _(s, d):
    return v.enriched(s, d).select("product_id", text.document_text(F.col("product_title"), F.col("description"), max_chars=12).alias("doc"))


@add("p24_catalogue_ids", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def _(s, d):
    return table(s, d, "lineitem").where("l_returnflag = 'N'").select("l_partkey").distinct()


# --- joins -----------------------------------------------------------------------

@add("j1_p10_enrich", f"WITH {v.P} SELECT product_id, has_enrichment, description, description_source, s_price FROM e")
def _(s, d):
    return v.enriched(s, d).select("product_id", "has_enrichment", "description", "description_source", "s_price")


@add("j3_semi", f"WITH {v.J}, {v.P} SELECT product_id, product_title FROM p WHERE product_id IN (SELECT product_id FROM j WHERE gain > 0)")
def _(s, d):
    return v.products(s, d).join(v.judgements(s, d).where("gain > 0"), "product_id", "left_semi").select("product_id", "product_title")


@add("j5_anti", f"WITH {v.J}, {v.P} SELECT DISTINCT product_id FROM j WHERE product_id NOT IN (SELECT asin FROM c)")
def _(s, d):
    return v.judgements(s, d).select("product_id").distinct().join(v.corpus(s, d).withColumnRenamed("asin", "product_id"), "product_id", "left_anti")


#: What a left join of the windows' ranks gives each judgement, without a join: the rank within the window, -1 outside.
RANKED = "SELECT query_id, product_id, label, CASE WHEN stage2_rank <= 10 THEN row_number() OVER (PARTITION BY query_id, stage2_rank <= 10 ORDER BY day, product_id) ELSE -1 END AS llm_rank FROM w"


@add("j9_two_key_left", f"WITH {v.S} {RANKED}")
def _(s, d):
    return relational.guarded_left(v.judgements(s, d).select(*KEY, "label"), v.signals(s, d).select(*KEY, "llm_rank"), KEY).fillna(-1, ["llm_rank"])


@add("j10_covered_inner", f"WITH {v.S} SELECT s.query_id, s.product_id, s.stage2_rank, j.qrel FROM s JOIN j USING (query_id, product_id)")
def _(s, d):
    return relational.covered_inner(v.signals(s, d).select(*KEY, "stage2_rank"), v.judgements(s, d).select(*KEY, "qrel"), KEY)


@add("j15_lookup", f"WITH {v.J} SELECT query_id, product_id, c_mktsegment AS segment FROM j JOIN customer ON query_id = c_custkey")
def _(s, d):
    seg = table(s, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("segment"))
    return relational.query_texts(v.judgements(s, d).select(*KEY), seg)


@add("j16_vector_lookup", "SELECT doc_id, embedding IS NOT NULL AS found, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def _(s, d):
    x = relational.vector_lookup(table(s, d, "documents").select(F.col("doc_id").alias("key")), table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding"))
    return x.select(F.col("key").alias("doc_id"), "found", F.round(F.coalesce(F.get("embedding", F.lit(0)).cast("double"), F.lit(0.0)), 6).alias("first"))


@add("j17_w7_signals", f"WITH {v.S} SELECT query_id, product_id, stage2_score, round(ce_score, 9) AS ce_score, llm_rank, round(1.0 / (60 + llm_rank), 9) AS llm_rr, label FROM s")
def _(s, d):
    x = v.windows(s, d)
    got = relational.assemble_signals(x.select(*KEY), *[x.select(*KEY, c) for c in ("stage2_score", "ce_score", "llm_rank", "label")])
    return ranking.window_signals(got).select(*KEY, "stage2_score", *r9("ce_score"), "llm_rank", *r9("llm_rr"), "label")


@add("j18_pairwise_accuracy", f"""WITH {v.S} SELECT round(avg(CASE WHEN a.gain > b.gain THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n_pairs
  FROM s a JOIN s b USING (query_id) WHERE a.stage2_rank < b.stage2_rank AND a.gain <> b.gain""")
def _(s, d):
    return relational.pairwise_accuracy(v.signals(s, d).withColumnRenamed("stage2_rank", "position")).select(*r9("accuracy"), "n_pairs")


@add("j19_top1_accuracy", """WITH i AS (SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT vec_id AS k, list_transform(embedding::DOUBLE[], lambda x, n: CASE WHEN n % 4 = 1 THEN x ELSE 0 END) AS v FROM embeddings),
  x AS (SELECT i.k AS ik, t.k AS tk, round(list_inner_product(i.v, t.v), 9) AS s FROM i, t),
  o AS (SELECT ik, max(s) FILTER (ik = tk) AS own, max(s) FILTER (ik <> tk) AS other FROM x GROUP BY ik) SELECT avg(CASE WHEN own >= other THEN 1.0 ELSE 0.0 END) AS top1, count(*) AS n FROM o""")
def _(s, d):
    """All vectors against texts that know every fourth component, in small blocks."""
    images = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    fourth = images.withColumn("embedding", F.transform("embedding", lambda x, n: F.when(n % 4 == 0, x).otherwise(0.0)))
    return retrieval.top1_accuracy_in_blocks(images, fourth, 1024)


@add("j19_top1_accuracy_whole", """WITH i AS (SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT vec_id AS k, list_transform(embedding::DOUBLE[], lambda x, n: CASE WHEN n <= 32 THEN x ELSE 0 END) AS v FROM embeddings),
  x AS (SELECT i.k AS ik, t.k AS tk, round(list_inner_product(i.v, t.v), 9) AS s FROM i, t),
  o AS (SELECT ik, max(s) FILTER (ik = tk) AS own, max(s) FILTER (ik <> tk) AS other FROM x GROUP BY ik) SELECT avg(CASE WHEN own >= other THEN 1.0 ELSE 0.0 END) AS top1, count(*) AS n FROM o""")
def _(s, d):
    images = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    half = images.withColumn("embedding", F.transform("embedding", lambda x, n: F.when(n < 32, x).otherwise(0.0)))
    return retrieval.top1_accuracy_in_blocks(images, half)


@add("j20_newly_over", f"""WITH {v.S}, f AS (SELECT a.query_id, a.product_id AS over, b.product_id AS under FROM s a JOIN s b USING (query_id) WHERE a.llm_rank < b.llm_rank AND a.gain < b.gain),
  g AS (SELECT a.query_id, a.product_id AS over, b.product_id AS under FROM s a JOIN s b USING (query_id) WHERE a.stage2_rank < b.stage2_rank AND a.gain < b.gain) SELECT * FROM f EXCEPT ALL SELECT * FROM g""")
def _(s, d):
    x = v.signals(s, d)
    return relational.newly_over(x.withColumnRenamed("stage2_rank", "position"), x.withColumnRenamed("llm_rank", "position"))


@add("j21_paired", f"WITH {v.ARMS} SELECT a.query_id, round(a.ndcg, 9) AS a, round(b.ndcg, 9) AS b, round(a.ndcg - b.ndcg, 9) AS delta FROM n2 a JOIN n1 b USING (query_id)")
def _(s, d):
    x = v.arms(s, d)
    return relational_paired(x).select("query_id", *r9("a", "b", "delta"))


def relational_paired(x):
    return metrics.paired(x.where("arm = 'ce'"), x.where("arm = 'stage2'"))


TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains(" + repr(retrieval.STOPWORDS) + ", t))"
BM25 = f"""d AS (SELECT doc_id, {TOKENS} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
x AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), po AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
im AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS impact FROM po JOIN df USING (term), st),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(impact * qtf) AS bm25_score FROM qt JOIN im USING (term) GROUP BY ALL)"""


def _index(s, d, stemmed=False):
    return bm25.build(table(s, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), scratch(s), stemmed)


def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@add("j23_bm25_pairs", f"""WITH {BM25}, li AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark), ld AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
  pr AS (SELECT DISTINCT query_id, doc_id FROM li JOIN ld USING (term) WHERE length(term) >= 7) SELECT query_id, doc_id, round(coalesce(bm25_score, 0), 6) AS bm25_score FROM pr LEFT JOIN sc USING (query_id, doc_id)""")
def _(s, d):
    """Every pair of a query and a document that have a word of seven letters or more in common."""
    long = lambda t, key: t.select(key, F.explode(text.token_set(F.col("text"))).alias("term")).where(F.length("term") >= 7)
    pairs = long(_asked(s, d), "query_id").join(long(table(s, d, "documents"), "doc_id"), "term").select("query_id", "doc_id").distinct()
    return bm25.of_pairs(_index(s, d), _asked(s, d), F.col("text"), pairs).select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"))


@add("t3_bm25_top", f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM sc WHERE bm25_score > 0) SELECT query_id, doc_id, rank, round(bm25_score, 6) AS bm25_score FROM r WHERE rank <= 10")
def _(s, d):
    return bm25.top(_index(s, d), _asked(s, d), F.col("text"), 10).select("query_id", "doc_id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


STEMS = f"""voc AS (SELECT unnest({TOKENS}) AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)),
{stemming.stem_sql("voc", "st")}"""


@add("l14_stems", f"WITH {STEMS} SELECT term, stem FROM st")
def _(s, d):
    texts = table(s, d, "documents").select("text").union(table(s, d, "benchmark").select("text"))
    return stemming.stems(texts.select(F.explode(retrieval.term_list(F.col("text"))).alias("term")))


@add("l14_t3_stemmed_bm25", f"""WITH {STEMS}, {BM25.replace("st AS (SELECT count(*)", "ct AS (SELECT count(*)").replace("USING (term), st)", "USING (term), ct)")
    .replace("x AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d)", "x0 AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), x AS (SELECT doc_id, dl, stem AS term FROM x0 JOIN st USING (term))")
    .replace("SELECT item_id AS query_id, term, count(*) AS qtf FROM (", "SELECT item_id AS query_id, stem AS term, count(*) AS qtf FROM (").replace("FROM benchmark) GROUP BY ALL)", "FROM benchmark) JOIN st USING (term) GROUP BY ALL)")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM sc WHERE bm25_score > 0) SELECT query_id, doc_id, rank, round(bm25_score, 6) AS bm25_score FROM r WHERE rank <= 10""")
def _(s, d):
    return bm25.top(_index(s, d, stemmed=True), _asked(s, d), F.col("text"), 10).select("query_id", "doc_id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


@add("k8_postings", f"WITH {BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM po GROUP BY term")
def _(s, d):
    return retrieval.postings(table(s, d, "documents").select("doc_id", "text"), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


# --- aggregates ------------------------------------------------------------------

@add("a1_invariants", f"WITH {v.J} SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(DISTINCT product_id) AS n_products, " + ", ".join(f"round(avg((label = '{x}')::INT), 9) AS share_{x.lower()}" for x in ("E", "S", "C", "I")) + " FROM j")
def _(s, d):
    return agg.invariants(v.judgements(s, d)).select("n_rows", "n_queries", "n_products", *r9("share_e", "share_s", "share_c", "share_i"))


@add("a2_value_shares", f"WITH {v.J} SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM j GROUP BY label")
def _(s, d):
    return agg.value_shares(v.judgements(s, d), "label")


@add("a3_join_coverage", f"""WITH {v.J}, {v.P}, x AS (SELECT DISTINCT product_id FROM j), y AS (SELECT count(*) AS requested, count(asin) AS matched, count(*) FILTER (s_image_url IS NOT NULL) AS with_image FROM x LEFT JOIN c ON product_id = asin)
  SELECT *, matched / requested AS coverage, with_image / requested AS image_coverage FROM y""")
def _(s, d):
    return agg.join_coverage(v.judgements(s, d), v.corpus(s, d), F.col("image_url").isNotNull())


@add("a4_presence_bias", f"""WITH {v.J}, {v.P}, x AS (SELECT gain, coalesce(s_stars IS NOT NULL, false) AS stars, coalesce(len(s_category) > 0, false) AS category, coalesce(s_price IS NOT NULL, false) AS price FROM j LEFT JOIN c ON product_id = asin),
  y AS (UNPIVOT x ON stars, category, price INTO NAME field VALUE there) SELECT field, round(avg(there::INT), 9) AS share, round(avg(gain) FILTER (there), 9) AS gain_present, round(avg(gain) FILTER (NOT there), 9) AS gain_absent,
  round(avg(gain) FILTER (there) - avg(gain) FILTER (NOT there), 9) AS shift FROM y GROUP BY field""")
def _(s, d):
    fields = {"stars": F.col("stars").isNotNull(), "category": F.size("category") > 0, "price": F.col("price").isNotNull()}
    return agg.presence_bias(v.judgements(s, d), v.corpus(s, d), fields).select("field", *r9("share", "gain_present", "gain_absent", "shift"))


NDCG = v.J + ",\n" + v.ndcg_sql("j", "stage2_score", "n")


@add("a5_ndcg", f"WITH {NDCG} SELECT query_id, n_docs, round(ndcg, 9) AS ndcg FROM n")
def _(s, d):
    return metrics.ndcg_per_query(v.judgements(s, d), "stage2_score").select("query_id", "n_docs", *r9("ndcg"))


@add("a6_mean_ndcg", f"WITH {NDCG} SELECT round(avg(ndcg), 9) AS mean_ndcg, count(*) AS n_queries FROM n")
def _(s, d):
    return metrics.mean_ndcg(metrics.ndcg_per_query(v.judgements(s, d), "stage2_score")).select(*r9("mean_ndcg"), "n_queries")


@add("a8_group_stats", f"WITH {v.J} SELECT query_id, count(*) AS n, round(avg(ce_score), 9) AS mean_ce, round(avg(stage2_score) FILTER (gain > 0), 8) AS mean_relevant FROM j GROUP BY query_id")
def _(s, d):
    return v.judgements(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("ce_score"), 9).alias("mean_ce"), F.round(F.avg(F.when(F.col("gain") > 0, F.col("stage2_score"))), 8).alias("mean_relevant"))


CATS = f"""{v.J}, {v.P}, m AS (SELECT query_id, s_category[1] AS cat, count(*) AS n FROM j JOIN e USING (product_id) WHERE len(s_category) > 0 GROUP BY ALL),
q AS (SELECT query_id, cat AS mode FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cat) AS r FROM m) WHERE r = 1)"""


def _cats(s, d):
    x = v.judgements(s, d).join(v.enriched(s, d).select("product_id", text.top_category(F.col("s_category")).alias("cat")), "product_id")
    return agg.smallest_mode(x, "query_id", "cat")


@add("a9_j13_mode", f"WITH {CATS} SELECT query_id, mode FROM q")
def _(s, d):
    return _cats(s, d)


@add("a10_buckets", f"""WITH {CATS}, n AS (SELECT mode, count(*) AS n FROM q GROUP BY mode), b AS (SELECT CASE WHEN n >= 250 THEN mode ELSE '(other)' END AS bucket, sum(n)::BIGINT AS n FROM n GROUP BY 1)
  SELECT bucket, n, row_number() OVER (ORDER BY bucket = '(other)', n DESC, bucket) AS place FROM b""")
def _(s, d):
    return agg.collapse_small(_cats(s, d), "mode", 250)


@add("a11_breakdown", f"WITH {CATS.replace(v.J + ',', v.ARMS + ',', 1)} SELECT mode AS bucket, arm, round(avg(ndcg), 9) AS ndcg FROM arms JOIN q USING (query_id) GROUP BY ALL")
def _(s, d):
    return v.arms(s, d).join(_cats(s, d), "query_id").groupBy(F.col("mode").alias("bucket"), "arm").agg(F.round(F.avg("ndcg"), 9).alias("ndcg"))


@add("a12_a13_strata", f"""WITH {v.S}, {v.ndcg_sql('s', 'ce_score', 'n')}, x AS (SELECT CASE WHEN ndcg >= 0 AND ndcg < 0.5 THEN 0 WHEN ndcg >= 0.5 AND ndcg < 0.5001 THEN 1 WHEN ndcg >= 0.5001 AND ndcg < 0.9 THEN 2 WHEN ndcg >= 0.9 AND ndcg <= 1 THEN 3 END AS stratum, n_docs FROM n)
  SELECT i::INT AS stratum, round(avg(n_docs), 9) AS mean, count(n_docs) AS n FROM range(4) t(i) LEFT JOIN x ON stratum = i GROUP BY i""")
def _(s, d):
    return agg.stratum_means(metrics.ndcg_per_query(v.signals(s, d), "ce_score").withColumn("ndcg", F.col("ndcg")), [0, 0.5, 0.5001, 0.9, 1.0], "ndcg", "n_docs").select("stratum", *r9("mean"), "n")


@add("a14_outcomes", f"""WITH {v.ARMS}, x AS (SELECT a.ndcg - b.ndcg AS delta, a.n_docs AS n_docs FROM n2 a JOIN n1 b USING (query_id))
  SELECT CASE WHEN delta > 1e-9 THEN 'better' WHEN delta < -1e-9 THEN 'worse' ELSE 'same' END AS outcome, count(*) AS n, round(avg(delta), 9) AS mean_delta, round(avg(n_docs), 9) AS mean_attribute FROM x GROUP BY 1""")
def _(s, d):
    n = v.signals(s, d).groupBy("query_id").agg(F.count("*").alias("n_docs"))
    return agg.outcome_profile(relational_paired(v.arms(s, d)).join(n, "query_id"), "n_docs").select("outcome", "n", *r9("mean_delta", "mean_attribute"))


@add("a15_normaliser", "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY event_type")
def _(s, d):
    return agg.fit_normaliser(table(s, d, "events"), "value", "event_type").select("event_type", *r9("mean"), F.round("std", 6).alias("std"), "n")


@add("a17_a18_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50_cont, round(quantile_cont(value, 0.95), 9) AS p95_cont, quantile_disc(value, 0.5) AS p50_disc, quantile_disc(value, 0.95) AS p95_disc FROM events GROUP BY event_type")
def _(s, d):
    return agg.percentiles(table(s, d, "events"), "value", "event_type").select("event_type", *r9("p50_cont", "p95_cont"), "p50_disc", "p95_disc")


@add("a20_latency", "SELECT user_id, count(value) AS n, round(avg(value), 9) AS mean, quantile_disc(value, 0.5) AS p50, CASE WHEN count(value) >= 100 THEN quantile_disc(value, 0.95) END AS p95, CASE WHEN count(value) >= 1000 THEN quantile_disc(value, 0.99) END AS p99 FROM events GROUP BY user_id")
def _(s, d):
    return agg.latency_profile(table(s, d, "events"), "value", "user_id").select("user_id", "n", *r9("mean"), "p50", "p95", "p99")


@add("a21_k10_usage", "SELECT count(*) AS calls, sum(user_id)::BIGINT AS prompt, sum(event_id)::BIGINT AS completion, round(sum(user_id) / count(*), 9) AS prompt_per_call, round(sum(event_id) / count(*), 9) AS completion_per_call FROM events")
def _(s, d):
    return agg.usage_totals(table(s, d, "events").select(F.col("user_id").alias("prompt"), F.col("event_id").alias("completion"))).select("calls", "prompt", "completion", *r9("prompt_per_call", "completion_per_call"))


@add("a22_w9_selector_features", f"""WITH {v.S}, x AS (SELECT query_id, count(*) AS n_candidates, max(ce_score) - min(ce_score) AS ce_spread, list_sort(list(ce_score), 'DESC') AS o, max(stage2_score) - min(stage2_score) AS stage2_score_spread,
    CASE WHEN stddev_pop(stage2_rank) > 0 AND stddev_pop(llm_rank) > 0 THEN covar_pop(stage2_rank, llm_rank) / (stddev_pop(stage2_rank) * stddev_pop(llm_rank)) END AS c1,
    CASE WHEN stddev_pop(ce_score) > 0 AND stddev_pop(llm_rank) > 0 THEN covar_pop(-ce_score, llm_rank) / (stddev_pop(ce_score) * stddev_pop(llm_rank)) END AS c2 FROM s GROUP BY query_id)
  SELECT query_id, n_candidates, round(ce_spread, 9) AS ce_spread, CASE WHEN n_candidates > 1 THEN round(o[1] - o[2], 9) ELSE 0 END AS ce_top_margin, round(stage2_score_spread, 6) AS stage2_score_spread, round(coalesce(c1, 0), 6) + 0.0 AS agree_stage2_llm, round(coalesce(c2, 0), 6) + 0.0 AS agree_ce_llm FROM x""")
def _(s, d):
    x = agg.selector_features(v.signals(s, d))
    return x.select("query_id", "n_candidates", *r9("ce_spread", "ce_top_margin"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("stage2_score_spread", "agree_stage2_llm", "agree_ce_llm")])


@add("a23_best_arm", f"WITH {v.ARMS}, m AS (SELECT arm, round(avg(ndcg), 9) AS ndcg FROM arms GROUP BY arm) SELECT arm, ndcg FROM m ORDER BY ndcg DESC, arm LIMIT 1")
def _(s, d):
    return agg.best_arm(v.arms(s, d).groupBy("arm").agg(F.round(F.avg("ndcg"), 9).alias("ndcg")))


@add("a24_deployed_rung", "WITH r AS (SELECT event_type AS rung, avg(value) AS mean, quantile_disc(value, 0.95) AS p95 FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT rung, p95 AS latency FROM r ORDER BY p95, rung LIMIT 1")
def _(s, d):
    x = agg.latency_profile(table(s, d, "events"), "value", "event_type").withColumnRenamed("event_type", "rung")
    return agg.deployed_rung(x.withColumn("lossless", F.col("rung") != "error"))


@add("a25_w10_run_lengths", """WITH x AS (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events),
  y AS (SELECT *, sum(new) OVER (ORDER BY event_id)::BIGINT AS run FROM x) SELECT run, event_type, count(*) AS n FROM y GROUP BY ALL""")
def _(s, d):
    return ranking.run_lengths(table(s, d, "events"), "event_type", ["event_id"])


@add("a26_window_shift", f"""WITH {v.S}, x AS (SELECT query_id, max(product_id) FILTER (stage2_rank = 1) = max(product_id) FILTER (llm_rank = 1) AS top, count(*) FILTER ((stage2_rank <= 3) <> (llm_rank <= 3)) = 0 AS same FROM s GROUP BY query_id)
  SELECT round(avg(top::INT), 9) AS same_top, round(avg(same::INT), 9) AS same_set, count(*) AS n_queries FROM x""")
def _(s, d):
    return agg.window_shift(v.signals(s, d), "stage2_rank", "llm_rank", 3).select(*r9("same_top", "same_set"), "n_queries")


ROUTE = f"{v.ARMS}, ch AS (SELECT query_id, ['stage2', 'ce', 'llm'][(query_id % 3 + 1)::INT] AS arm FROM n1)"


@add("a27_routes", f"""WITH {ROUTE}, x AS (SELECT arm, arms.ndcg - n1.ndcg AS d FROM ch JOIN arms USING (query_id, arm) JOIN n1 USING (query_id)), y AS (SELECT arm, count(*) AS n, count(*) FILTER (d > 1e-9) AS better, count(*) FILTER (d < -1e-9) AS worse FROM x GROUP BY arm)
  SELECT *, n / sum(n) OVER () AS share FROM y""")
def _(s, d):
    x = v.arms(s, d)
    arm = F.element_at(F.array(F.lit("stage2"), F.lit("ce"), F.lit("llm")), (F.col("query_id") % 3 + 1).cast("int"))
    return agg.routes(x.select("query_id").distinct().withColumn("arm", arm), x, "stage2")


@add("a28_a29_non_null", f"WITH {v.P}, x AS (SELECT avg((product_brand IS NOT NULL)::INT) AS product_brand, avg((s_stars IS NOT NULL)::INT) AS s_stars, avg((s_image_url IS NOT NULL)::INT) AS s_image_url FROM e) SELECT field, round(share, 9) AS share FROM (UNPIVOT x ON product_brand, s_stars, s_image_url INTO NAME field VALUE share)")
def _(s, d):
    return agg.non_null_shares(v.enriched(s, d), ["product_brand", "s_stars", "s_image_url"]).select("field", *r9("share"))


@add("a30_listwise", f"WITH {v.S} SELECT query_id, string_agg(product_id, ',' ORDER BY stage2_rank) AS docs, string_agg(label, ',' ORDER BY stage2_rank) AS labels FROM s GROUP BY query_id")
def _(s, d):
    return agg.listwise(v.signals(s, d)).select("query_id", F.array_join("docs", ",").alias("docs"), F.array_join("labels", ",").alias("labels"))


@add("a31_vocabulary", "SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)")
def _(s, d):
    return agg.vocabulary(table(s, d, "part"), "p_type")


@add("a32_truncation", "SELECT round(avg((length(text) > 2000)::INT), 9) AS truncated FROM documents")
def _(s, d):
    return agg.truncation_share(table(s, d, "documents"), F.length("text"), 2000).select(*r9("truncated"))


@add("a33_g21_fold_sizes", f"WITH {v.J} SELECT {FOLD} AS fold, count(DISTINCT query_id) AS n FROM j GROUP BY 1")
def _(s, d):
    return v.folded(s, d).groupBy("fold").agg(F.countDistinct("query_id").alias("n"))


@add("a34_cluster_sums", f"""WITH {v.J}, {v.P}, x AS (SELECT query_id, gain, coalesce(s_stars IS NOT NULL, false) AS present FROM j LEFT JOIN c ON product_id = asin)
  SELECT query_id, round(sum(gain) FILTER (present), 9) AS sum_in, count(*) FILTER (present) AS n_in, round(sum(gain) FILTER (NOT present), 9) AS sum_out, count(*) FILTER (NOT present) AS n_out FROM x GROUP BY query_id""")
def _(s, d):
    return metrics.cluster_sums(_presence(s, d)).select("query_id", *r9("sum_in"), "n_in", *r9("sum_out"), "n_out")


def _presence(s, d):
    stars = v.corpus(s, d).select(F.col("asin").alias("product_id"), F.col("stars").isNotNull().alias("present"))
    return v.judgements(s, d).join(stars, "product_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))


CALLS = """ca AS (SELECT user_id % 5 + 1 AS rate, event_id::DOUBLE AS scheduled_ms, event_id + value AS finish_ms, event_type <> 'error' AS ok, (event_id // 100)::DOUBLE AS seconds FROM events),
re AS (SELECT rate, count(*) AS n, count(*) FILTER (ok) / max(seconds) AS achieved, (count(*) - count(*) FILTER (ok)) / count(*) AS errors, quantile_disc(CASE WHEN ok THEN finish_ms - scheduled_ms END, 0.95) AS p95 FROM ca GROUP BY rate)"""


def _calls(s, d):
    e = table(s, d, "events")
    return e.select((F.col("user_id") % 5 + 1).alias("rate"), F.col("event_id").cast("double").alias("scheduled_ms"), (F.col("event_id") + F.col("value")).alias("finish_ms"), (F.col("event_type") != "error").alias("ok"), F.floor(F.col("event_id") / 100).cast("double").alias("seconds"))


@add("a39_r4_rates", f"WITH {CALLS} SELECT rate, n, round(achieved, 9) AS achieved, round(errors, 9) AS errors, round(p95, 6) AS p95 FROM re")
def _(s, d):
    return agg.rate_results(_calls(s, d)).select("rate", "n", *r9("achieved", "errors"), F.round("p95", 6).alias("p95"))


@add("a35_max_rate", f"WITH {CALLS} SELECT max(rate) FILTER (p95 <= 300 AND errors <= 0.2) AS max_rate FROM re")
def _(s, d):
    return agg.max_rate_under(agg.rate_results(_calls(s, d)), errors=0.2)


@add("a37_g9_presence_control", f"WITH {v.ARMS} SELECT round(avg(c.ndcg - a.ndcg), 9) AS naive, round(avg(b.ndcg - a.ndcg), 9) AS artefact, round(avg(c.ndcg - b.ndcg), 9) AS honest FROM n1 a JOIN n2 b USING (query_id) JOIN n3 c USING (query_id)")
def _(s, d):
    x = v.arms(s, d).groupBy("query_id").pivot("arm", ["stage2", "ce", "llm"]).agg(F.first("ndcg"))
    return metrics.presence_control(x.withColumnsRenamed({"stage2": "text", "ce": "with_indicators", "llm": "with_values"})).select(*r9("naive", "artefact", "honest"))


# --- windows, fusion, sorts, samples ----------------------------------------------

@add("w1_rank", f"WITH {v.J} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, product_id) AS rank FROM j")
def _(s, d):
    return v.ranked(v.judgements(s, d), "ce_score").select(*KEY, "rank")


@add("w3_window_tail", f"WITH {v.S} SELECT query_id, product_id, stage2_rank, stage2_rank <= 10 AS in_window FROM w")
def _(s, d):
    return ranking.top_window(v.judgements(s, d)).select(*KEY, "stage2_rank", "in_window")


@add("w4_w6_splice", f"WITH {v.S} SELECT query_id, product_id, (count(*) OVER (PARTITION BY query_id) - stage2_rank + 1)::DOUBLE AS run_score FROM w")
def _(s, d):
    return ranking.splice(ranking.top_window(v.judgements(s, d))).select(*KEY, "run_score")


SPLICED = v.S + """, o AS (SELECT query_id, product_id, llm_rank AS position FROM s WHERE query_id % 3 <> 0),
sp AS (SELECT w.*, count(*) OVER (PARTITION BY w.query_id) - row_number() OVER (PARTITION BY w.query_id ORDER BY w.stage2_rank > 10, CASE WHEN w.stage2_rank <= 10 THEN coalesce(position, w.stage2_rank) ELSE w.stage2_rank END, w.product_id) + 1 AS run_score FROM w LEFT JOIN o USING (query_id, product_id))"""


def _spliced(s, d):
    ordering = v.signals(s, d).where("query_id % 3 <> 0").select(*KEY, F.col("llm_rank").alias("position"))
    return ranking.spliced_run(ranking.top_window(v.judgements(s, d)), ordering, v.tasks(s, d))


@add("w5_spliced_run", f"WITH {SPLICED} SELECT query_id, product_id, run_score::DOUBLE AS run_score FROM sp")
def _(s, d):
    return _spliced(s, d).select(*KEY, "run_score")


@add("g12_a7_spliced_ndcg", f"WITH {SPLICED}, {v.ndcg_sql('sp', 'run_score', 'n')} SELECT query_id, round(ndcg, 9) AS ndcg FROM n")
def _(s, d):
    return metrics.ndcg_per_query(_spliced(s, d)).select("query_id", *r9("ndcg"))


@add("w8_t5_fusion", f"""WITH {v.S}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, product_id) AS ce_pos FROM s),
  y AS (SELECT *, 1.0::DOUBLE / (60 + stage2_rank) + 1.0::DOUBLE / (60 + ce_pos) + 4.0::DOUBLE / (60 + llm_rank) AS fused FROM x) SELECT query_id, product_id, round(fused, 12) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, product_id) AS fused_rank FROM y""")
def _(s, d):
    x = ranking.reciprocal_rank_fusion(ranking.stage_orderings(v.signals(s, d)), ["stage_pos", "ce_pos", "llm_pos"])
    return x.select(*KEY, F.round("fused", 12).alias("fused"), "fused_rank")


@add("w11_k4_trec_lines", f"""WITH {v.J} SELECT query_id, query_id || ' Q0 ' || product_id || ' ' || row_number() OVER (PARTITION BY query_id ORDER BY stage2_score DESC, product_id) || ' ' || stage2_score::VARCHAR || ' run1' AS value FROM j""")
def _(s, d):
    return writers.trec_lines(v.judgements(s, d), "run1", "stage2_score").select("query_id", "value")


@add("w12_x10_targets", f"""WITH {v.S} SELECT query_id, product_id, gain AS target_labels, (count(*) OVER q - row_number() OVER (PARTITION BY query_id ORDER BY llm_rank, product_id))::DOUBLE AS target_llm,
  (count(*) OVER q - row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, llm_rank, product_id))::DOUBLE AS target_hybrid FROM s WINDOW q AS (PARTITION BY query_id)""")
def _(s, d):
    return ranking.hybrid_target(v.signals(s, d)).select(*KEY, "target_labels", "target_llm", "target_hybrid")


@add("w13_gain_permutation", f"WITH {v.S} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, stage2_rank) AS target_pos FROM s")
def _(s, d):
    return ranking.gain_permutation(v.signals(s, d)).select(*KEY, "target_pos")


@add("t1_sorted", f"WITH {v.J} SELECT query_id, product_id FROM j")
def _(s, d):
    return ranking.sort_for_ranking(v.judgements(s, d).select(*KEY))


@add("t4_x18_moves", f"WITH {v.S}, x AS (SELECT query_id, product_id, stage2_rank AS pos_before, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, product_id) AS pos_after FROM s) SELECT *, pos_before - pos_after AS moved FROM x")
def _(s, d):
    x = v.signals(s, d)
    return ranking.position_changes(x.select(*KEY, F.col("stage2_rank").alias("position")), v.ranked(x, "ce_score", "position").select(*KEY, "position"))


@add("t6_t7_sample", f"WITH {v.J}, x AS (SELECT DISTINCT query_id FROM j ORDER BY sha256('s1:' || query_id), query_id LIMIT 50) SELECT query_id, count(*) AS n FROM j SEMI JOIN x USING (query_id) GROUP BY query_id")
def _(s, d):
    x = v.judgements(s, d)
    return x.join(ranking.hash_sample(x, 50, "s1"), "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))


@add("t8_batches", f"WITH {v.S} SELECT query_id, product_id, ((row_number() OVER (PARTITION BY query_id ORDER BY sha256('b1:' || product_id), product_id) - 1) // 4)::INT AS batch FROM s")
def _(s, d):
    return ranking.batches(v.signals(s, d), 4, "b1").select(*KEY, "batch")


@add("t10_head", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def _(s, d):
    return table(s, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey", "p_name")


@add("t11_t12_report_order", f"WITH {v.ARMS} SELECT row_number() OVER (ORDER BY avg(ndcg) DESC, arm) AS place, arm, round(avg(ndcg), 9) AS ndcg FROM arms GROUP BY arm")
def _(s, d):
    from pyspark.sql import Window as W

    x = v.arms(s, d).groupBy("arm").agg(F.avg("ndcg").alias("m"))
    return x.select(F.row_number().over(W.orderBy(F.col("m").desc(), "arm")).alias("place"), "arm", F.round("m", 9).alias("ndcg"))


# --- set operations ----------------------------------------------------------------

@add("u1_union_splits", f"WITH {v.J} SELECT query_id, product_id, CASE WHEN query_id % 2 = 0 THEN {FOLD} ELSE -1 END AS fold, CASE WHEN query_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM j")
def _(s, d):
    x = v.judgements(s, d)
    return relational.combine_splits({"train": x.where("query_id % 2 = 0"), "test": x.where("query_id % 2 <> 0")}).select(*KEY, "fold", "split")


@add("u3_union_distinct", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 40 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def _(s, d):
    return table(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id")).union(table(s, d, "part").where("p_size > 40").select("p_partkey")).distinct()


@add("u4_difference", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def _(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id")).subtract(table(s, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@add("u5_u7_symmetric_difference", "(SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49 EXCEPT ALL SELECT p_partkey FROM part) UNION ALL (SELECT p_partkey FROM part EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(s, d):
    return relational.symmetric_difference(table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id")), table(s, d, "part").select("p_partkey"))


@add("u9_first_per_key", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def _(s, d):
    return relational.first_per_key(table(s, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_partkey")


# --- scalar functions -----------------------------------------------------------------

@add("f1_f2_u6_tokens", "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents) SELECT doc_id, len(ts)::INT AS n, len(list_distinct(ts))::INT AS n_distinct, len(list_intersect(list_distinct(ts), ['the', 'der', 'la']))::INT AS common FROM t")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("ts"), text.token_set(F.col("text")).alias("u"))
    return x.select("doc_id", F.size("ts").alias("n"), F.size("u").alias("n_distinct"), F.size(F.array_intersect("u", F.array(F.lit("the"), F.lit("der"), F.lit("la")))).alias("common"))


@add("f3_product_text", f"WITH {v.P} SELECT product_id, trim(product_title || ' ' || coalesce(product_brand, '') || CASE WHEN product_brand IS NULL THEN '' ELSE ' ' END || product_bullet_point) AS doc FROM p")
def _(s, d):
    return v.products(s, d).select("product_id", text.product_text(F.col("product_title"), F.col("product_brand"), F.col("product_bullet_point")).alias("doc"))


@add("f5_f8_parsers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0::DOUBLE END AS stars, 1000 + p_size AS ratings, p_size + 0.5::DOUBLE AS price, p_partkey % 2 = 0 AS multi, p_size AS bsr, p_type AS category FROM part")
def _(s, d):
    t = lambda c: F.col(c).cast("string")
    stars = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") / 10).cast("string"), F.lit(" out of 5 stars"))).otherwise(F.lit("none yet"))
    price = F.concat(F.lit("$"), t("p_size"), F.lit(".50"))
    p = text.parse_price(F.when(F.col("p_partkey") % 2 == 0, F.concat(price, F.lit(" $9.99"))).otherwise(price))
    rank = text.parse_rank(F.concat(F.lit("#"), t("p_size"), F.lit(" in "), F.col("p_type"), F.lit(" ( See Top 100 in "), F.col("p_type"), F.lit(" )")))
    return table(s, d, "part").select("p_partkey", text.parse_stars(stars).alias("stars"), text.parse_ratings(F.format_string("1,%03d ratings", F.col("p_size"))).alias("ratings"), p["price"].alias("price"), p["multi"].alias("multi"), rank["rank"].alias("bsr"), rank["category"].alias("category"))


@add("f9_f10_urls", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN url END, ''), 'https://x/images/I/' || page_id || '.jpg') AS url FROM pages")
def _(s, d):
    image = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.lit(""))
    return table(s, d, "pages").select("page_id", text.image_url(image, F.concat(F.lit("https://x/images/W/1_2/images/I/"), F.col("page_id").cast("string"), F.lit(".jpg"))).alias("url"))


@add("f13_fingerprint", "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS fp FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", text.fingerprint(F.col("p_name")).alias("fp"))


@add("f14_f15_f17_prompts", f"WITH {v.S}, l AS (SELECT query_id, any_value(query) AS query, string_agg('[' || stage2_rank || '] ' || substr(product_id, 1, 3), chr(10) ORDER BY stage2_rank) AS listing, string_agg('[' || llm_rank || ']', ' > ' ORDER BY stage2_rank) AS answer FROM s GROUP BY query_id) SELECT query_id, 'Query: ' || query || chr(10) || 'Product: ' AS head, listing, answer FROM l")
def _(s, d):
    x = v.signals(s, d).groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("stage2_rank", "product_id", "llm_rank"))).alias("w"))
    return x.select("query_id", text.query_prefix(F.col("query")).alias("head"), text.listing(F.col("w.product_id"), 3).alias("listing"), text.answer_text(F.col("w.llm_rank")).alias("answer"))


@add("f16_x16_permutations", f"WITH {v.S} SELECT query_id, product_id, CASE WHEN query_id % 4 = 0 THEN stage2_rank ELSE llm_rank END AS position FROM s")
def _(s, d):
    from pyspark.sql import Window as W

    x = v.signals(s, d)
    lists = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("llm_rank", "stage2_rank", "product_id"))).alias("w"))
    said = F.when(F.col("query_id") % 4 == 0, F.lit("[1] > [1] > [99]")).otherwise(text.answer_text(F.col("w.stage2_rank")))
    answers = lists.select("query_id", text.parse_permutation(said, F.size("w")).alias("p"))
    order = answers.select("query_id", F.posexplode("p").alias("i", "stage2_rank")).select("query_id", "stage2_rank", (F.col("i") + 1).alias("llm"))
    return x.drop("llm_rank").join(order, ["query_id", "stage2_rank"], "left").select("query_id", "product_id", F.coalesce("llm", "stage2_rank").alias("position"))


@add("f19_f20_texts", f"WITH {v.ARMS}, m AS (SELECT arm, avg(ndcg) AS m FROM arms GROUP BY arm) SELECT arm, printf('%.4f [%.4f, %.4f]', round(m, 6), 0.0::DOUBLE, 1.0::DOUBLE) AS cell, '&lt;' || arm || '&gt;' AS html FROM m")
def _(s, d):
    x = v.arms(s, d).groupBy("arm").agg(F.round(F.avg("ndcg"), 6).alias("m"))
    return x.select("arm", text.interval_text(F.col("m"), F.lit(0.0), F.lit(1.0)).alias("cell"), text.escape_html(F.concat(F.lit("<"), F.col("arm"), F.lit(">"))).alias("html"))


@add("m2_m3_similarity", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    """Every vector with the one of the next id, null where there is none."""
    e = table(s, d, "embeddings").select("vec_id", numeric.l2_normalize(F.col("embedding")).alias("embedding"))
    pairs = e.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("product_id"))
    x = retrieval.pair_similarity(pairs, e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "product_id"))
    return x.select(F.col("query_id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


BLEND = f"""{v.J}, st AS (SELECT avg(stage2_score) AS m1, stddev_pop(stage2_score) AS s1, avg(ce_score) AS m2, stddev_pop(ce_score) AS s2 FROM j),
z AS (SELECT j.*, (stage2_score - m1) / s1 AS text_z, CASE WHEN label_code = 2 THEN NULL ELSE (ce_score - m2) / s2 END AS image_z FROM j, st)"""


def _blend(s, d):
    j = v.judgements(s, d)
    a, b = (agg.fit_normaliser(j, c).select(F.col("mean").alias(f"m{i}"), F.col("std").alias(f"s{i}")) for i, c in ((1, "stage2_score"), (2, "ce_score")))
    x = j.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))  # one row each
    z = numeric.zscore
    return x.withColumns({"text_z": z(F.col("stage2_score"), F.col("m1"), F.col("s1")), "image_z": F.when(F.col("label_code") != 2, z(F.col("ce_score"), F.col("m2"), F.col("s2")))})


@add("m5_m6_m7_blend", f"WITH {BLEND} SELECT query_id, product_id, round(CASE WHEN image_z IS NULL THEN text_z ELSE 0.25 * text_z + 0.75 * image_z END, 6) AS s FROM z")
def _(s, d):
    return _blend(s, d).select(*KEY, F.round(numeric.or_last(numeric.blend(F.col("text_z"), F.col("image_z"), F.lit(0.25))), 6).alias("s"))


@add("m8_m9_coverage", f"WITH {v.J}, {v.P}, x AS (SELECT query_id, product_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(product_title), '[a-z0-9]+')) AS t FROM j JOIN p USING (product_id)) SELECT query_id, product_id, round(len(list_intersect(q, t)) / len(q), 9) AS coverage, round(len(list_intersect(q, t)) / len(t), 9) AS share FROM x")
def _(s, d):
    x = v.judgements(s, d).join(v.products(s, d), "product_id")
    q, t = text.token_set(F.col("query")), text.token_set(F.col("product_title"))
    return x.select(*KEY, F.round(numeric.coverage(q, t), 9).alias("coverage"), F.round(numeric.match_share(q, t), 9).alias("share"))


@add("m10_numbers", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", numeric.number(F.get_json_object("props", "$.k")).alias("k"), numeric.number(F.col("event_type")).alias("bad"))


@add("m11_m12_sigmoid", "SELECT event_id, round(CASE WHEN value - 100 >= 0 THEN 1 / (1 + exp(-(value - 100))) ELSE exp(value - 100) / (1 + exp(value - 100)) END, 9) AS p FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(numeric.yes_probability(F.create_map(F.lit("yes"), F.col("value") - 100, F.lit("no"), F.lit(0.0)))["p"], 9).alias("p"))


@add("m13_expected_gain", "SELECT p_partkey, round(0.0 * 0 + (p_size / 100.0) * 0.01 + 0.25 * 0.1 + (0.75 - p_size / 100.0) * 1.0, 9)::DOUBLE AS g FROM part")
def _(s, d):
    x = F.col("p_size") / 100.0
    return table(s, d, "part").select("p_partkey", F.round(numeric.expected_gain(F.array(F.lit(0.0), x, F.lit(0.25), 0.75 - x)), 9).alias("g"))


@add("m14_m16_costs", "SELECT event_id, round((user_id * 2.0 + event_id * 8.0) / 1e6, 12) AS tokens, round(0.4 / ((value + 1) * 3600) * 1000, 9) AS hosting, CASE WHEN user_id >= 0.9 * 50 THEN value END AS trusted FROM events")
def _(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.round(numeric.token_cost(F.col("user_id"), F.col("event_id"), F.lit(2.0), F.lit(8.0)), 12).alias("tokens"), F.round(numeric.hosting_cost(F.col("value") + 1, F.lit(0.4)), 9).alias("hosting"), numeric.trusted_latency(F.col("value"), F.col("user_id"), F.lit(50)).alias("trusted"))


@add("x1_x5_json", f"WITH {v.P}, x AS (SELECT product_id, CASE WHEN json_valid(s_info_json) THEN s_info_json END AS i, CASE WHEN json_valid(s_attrs_json) THEN s_attrs_json END AS a FROM e) SELECT product_id, coalesce(len(json_keys(a)), 0)::INT AS n_attrs, coalesce(len(json_keys(i)), 0)::INT AS n_info, json_extract_string(a, '$.Brand') AS brand FROM x")
def _(s, d):
    a, i = nested.json_map(F.col("s_attrs_json")), nested.json_map(F.col("s_info_json"))
    return v.enriched(s, d).select("product_id", F.size(a).alias("n_attrs"), F.size(i).alias("n_info"), F.try_element_at(a, F.lit("Brand")).alias("brand"))


TOK = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


@add("x6_product_features", f"""WITH {v.P} SELECT product_id, length(product_title)::DOUBLE AS title_chars, len(regexp_extract_all(lower(product_title), '[a-z0-9]+'))::DOUBLE AS title_words, length(product_description)::DOUBLE AS own_desc_chars,
  nullif(len(s_category), 0)::DOUBLE AS category_depth, CASE WHEN s_attrs_json IS NOT NULL THEN 2.0::DOUBLE END AS n_attrs, CASE WHEN s_info_json LIKE '%}}' THEN 1.0::DOUBLE END AS n_info, s_stars, s_ratings, s_price, s_price_multi::INT::DOUBLE AS s_price_multi, s_bsr_rank, s_n_reviews FROM e""")
def _(s, d):
    return features.product_matrix(v.enriched(s, d)).select("product_id", "title_chars", "title_words", "own_desc_chars", "category_depth", "n_attrs", "n_info", "s_stars", "s_ratings", "s_price", "s_price_multi", "s_bsr_rank", "s_n_reviews")


@add("x7_x4_pair_features", f"""WITH {v.J}, {v.P}, x AS (SELECT query_id, product_id, {TOK('query')} AS q, {TOK('product_title')} AS t, {TOK('product_brand')} AS b, {TOK('product_color')} AS o, s_category, s_attrs_json,
    {TOK('s_category[1]')} AS c1, {TOK('s_category[2]')} AS c2, length(query) AS qc FROM j JOIN e USING (product_id))
  SELECT query_id, product_id, qc::DOUBLE AS query_chars, len(q)::DOUBLE AS query_words, len(list_intersect(q, t))::DOUBLE AS title_overlap, CASE WHEN len(b) > 0 THEN round(len(list_intersect(q, b)) / len(b), 9) END AS brand_match,
    CASE WHEN len(b) > 0 THEN (len(list_intersect(q, b)) = len(b))::INT::DOUBLE END AS brand_match_all, CASE WHEN len(o) > 0 THEN len(list_intersect(q, o)) / len(o) END AS color_match,
    CASE WHEN len(s_category) > 0 THEN (CASE WHEN len(list_intersect(q, c2)) > 0 THEN 2 WHEN len(list_intersect(q, c1)) > 0 THEN 1 ELSE 0 END)::DOUBLE END AS category_match_depth,
    CASE WHEN s_attrs_json IS NOT NULL THEN len(list_intersect(q, ['size', 'brand']))::DOUBLE END AS attr_key_overlap FROM x""")
def _(s, d):
    x = features.pair_matrix(v.judgements(s, d), v.enriched(s, d))
    return x.select(*KEY, "query_chars", "query_words", "title_overlap", *r9("brand_match"), "brand_match_all", "color_match", "category_match_depth", "attr_key_overlap")


@add("x8_indicators", f"""WITH {v.P} SELECT product_id, has_enrichment::INT::DOUBLE AS has_enrichment, (s_stars IS NOT NULL)::INT::DOUBLE AS has_stars, (s_ratings IS NOT NULL)::INT::DOUBLE AS has_ratings, (s_price IS NOT NULL)::INT::DOUBLE AS has_price, (s_bsr_rank IS NOT NULL)::INT::DOUBLE AS has_bsr,
  (s_attrs_json IS NOT NULL)::INT::DOUBLE AS has_attrs, coalesce(s_info_json LIKE '%}}', false)::INT::DOUBLE AS has_info, coalesce(len(s_category) > 0, false)::INT::DOUBLE AS has_category, (description_source = 'scrape')::INT::DOUBLE AS desc_from_scrape FROM e""")
def _(s, d):
    return features.product_matrix(v.enriched(s, d)).select("product_id", *features.GROUPS["s_indicators"])


@add("x9_feature_matrix", f"""SELECT r.query_id, r.product_id, r.label, r.llm_rank, b.* EXCLUDE (query_id, product_id), a.* EXCLUDE (product_id), i.* EXCLUDE (product_id) FROM (WITH {v.S} {RANKED}) r
  JOIN ({ORACLE['x7_x4_pair_features']}) b ON r.query_id = b.query_id AND r.product_id = b.product_id JOIN ({ORACLE['x6_product_features']}) a ON a.product_id = r.product_id JOIN ({ORACLE['x8_indicators']}) i ON i.product_id = r.product_id""")
def _(s, d):
    """29 features of all groups but the modelled scores, which the rank stands for."""
    x = features.feature_matrix(v.judgements(s, d), v.enriched(s, d), v.signals(s, d).select(*KEY, "llm_rank"))
    own = ["title_chars", "title_words", "own_desc_chars", "category_depth", "n_attrs", "n_info", "s_stars", "s_ratings", "s_price", "s_price_multi", "s_bsr_rank", "s_n_reviews", *features.GROUPS["s_indicators"]]
    pair = ["query_chars", "query_words", "title_overlap", *r9("brand_match"), "brand_match_all", "color_match", "category_match_depth", "attr_key_overlap"]
    return x.select(*KEY, "label", *own, *pair, F.coalesce("llm_rank", F.lit(-1)).alias("llm_rank"))


@add("x17_chart_points", "SELECT event_type AS arm, kind, round(ms, 6) AS ms FROM (SELECT event_type, avg(value) AS mean, max(value) AS worst FROM events GROUP BY 1) UNPIVOT (ms FOR kind IN (mean, worst))")
def _(s, d):
    x = table(s, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.create_map(F.lit("mean"), F.avg("value"), F.lit("worst"), F.max("value")).alias("m"))
    return x.select("arm", F.explode("m").alias("kind", "ms")).withColumn("ms", F.round("ms", 6))


# --- statistics and evaluation -------------------------------------------------------

FLOOR = v.J + """, x AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM j),
fl AS (SELECT query_id, CASE WHEN sum(gain / log2(i + 1)) > 0 THEN avg(gain) * sum(1 / log2(i + 1)) / sum(gain / log2(i + 1)) ELSE 0 END AS floor FROM x GROUP BY query_id)"""


@add("g2_random_floor", f"WITH {FLOOR} SELECT query_id, round(floor, 9) AS floor FROM fl")
def _(s, d):
    return metrics.random_floor(v.judgements(s, d)).select("query_id", *r9("floor"))


@add("g1_a19_floor_trials", f"""WITH {v.S}, x AS (SELECT query_id, product_id, gain, trial FROM s, (SELECT unnest(range(100)) AS trial)),
  y AS (SELECT query_id, trial, gain, row_number() OVER (PARTITION BY query_id, trial ORDER BY md5('{metrics.SEED}:' || trial || ':' || query_id || ':' || product_id), product_id) AS r, row_number() OVER (PARTITION BY query_id, trial ORDER BY gain DESC) AS i FROM x),
  pq AS (SELECT trial, query_id, CASE WHEN sum(gain) > 0 THEN sum(gain / log2(r + 1)) / sum(gain / log2(i + 1)) ELSE 0 END AS n FROM y GROUP BY ALL), t AS (SELECT trial, avg(n) AS m FROM pq GROUP BY trial), o AS (SELECT list(m ORDER BY m) AS o, avg(m) AS point FROM t)
  SELECT round(point, 9) AS point, round(o[floor(0.025 * 99)::INT + 1], 9) AS low, round(o[floor(0.975 * 99)::INT + 1], 9) AS high FROM o""")
def _(s, d):
    return metrics.floor_interval(metrics.random_runs(v.signals(s, d), 100)).select(*r9("point", "low", "high"))


def replicates_sql(source: str, key: str, more: str) -> str:
    """(more, rep, w) of metrics.replicates() over a source."""
    steps = " + ".join(f"(u >= {x})::INT" for x in metrics.poisson_steps())
    return f"""SELECT {more}, rep, w FROM (SELECT {more}, rep, {steps} AS w FROM (SELECT {more}, block * 8 + i AS rep, ('0x' || substr(h, 8 * i + 1, 8))::UBIGINT AS u
    FROM (SELECT {more}, block, sha256('{metrics.SEED}:' || block || ':' || {key}) AS h FROM {source}, (SELECT unnest(range({-(-metrics.RESAMPLES // 8)})) AS block)), (SELECT unnest(range(8)) AS i)) WHERE rep < {metrics.RESAMPLES}) WHERE w > 0"""


def bootstrap_sql(source: str, name: str) -> str:
    """CTE `name` (arm, point, low, high, n) of metrics.bootstrap() over a source (arm, query_id, v)."""
    return f"""{name}_r AS (SELECT arm, rep, sum(w * v) / sum(w) AS m FROM ({replicates_sql(source, 'query_id', 'arm, query_id, v')}) GROUP BY arm, rep),
{name} AS (SELECT arm, point, low, high, n FROM (SELECT arm, avg(v) AS point, count(*) AS n FROM {source} GROUP BY arm) JOIN (SELECT arm, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM {name}_r GROUP BY arm) USING (arm))"""


@add("g3_bootstrap", f"WITH {v.ARMS}, av AS (SELECT arm, query_id, ndcg AS v FROM arms), {bootstrap_sql('av', 'b')} SELECT arm, round(point, 9) AS point, round(low, 9) AS low, round(high, 9) AS high, n FROM b")
def _(s, d):
    return metrics.bootstrap(v.arms(s, d), arm="arm").select("arm", *r9("point", "low", "high"), "n")


@add("g4_g6_paired_verdict", f"""WITH {v.ARMS}, av AS (SELECT 'all' AS arm, a.query_id, a.ndcg - b.ndcg AS v FROM n2 a JOIN n1 b USING (query_id)), {bootstrap_sql('av', 'b')}
  SELECT arm, round(point, 9) AS point, round(low, 9) AS low, round(high, 9) AS high, n, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'not separable' END AS verdict FROM b""")
def _(s, d):
    return metrics.verdict(metrics.bootstrap(relational_paired(v.arms(s, d)), "delta")).select("arm", *r9("point", "low", "high"), "n", "verdict")


@add("g5_cluster_bootstrap", f"""WITH {v.J}, {v.P}, pr AS (SELECT query_id, gain, coalesce(s_stars IS NOT NULL, false) AS present FROM j LEFT JOIN c ON product_id = asin),
  cs AS (SELECT query_id, coalesce(sum(gain) FILTER (present), 0) AS si, count(*) FILTER (present) AS ni, coalesce(sum(gain) FILTER (NOT present), 0) AS so, count(*) FILTER (NOT present) AS no FROM pr GROUP BY query_id),
  r AS (SELECT rep, sum(w * si) / nullif(sum(w * ni), 0) - sum(w * so) / nullif(sum(w * no), 0) AS m FROM ({replicates_sql('cs', 'query_id', 'query_id, si, ni, so, no')}) GROUP BY rep)
  SELECT (SELECT round(avg(gain) FILTER (present) - avg(gain) FILTER (NOT present), 9) FROM pr) AS point, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM r""")
def _(s, d):
    return metrics.cluster_bootstrap(_presence(s, d)).select(*r9("point", "low", "high"))


@add("g7_g8_report", f"""WITH {v.ARMS}, {v.ndcg_sql('j', 'stage2_score', 'n')}, {FLOOR.split(', x AS', 1)[1].join(['x AS', ''])},
  av AS (SELECT 'stage2' AS arm, query_id, ndcg AS v FROM n UNION ALL SELECT 'lift', query_id, ndcg - floor FROM n JOIN fl USING (query_id)), {bootstrap_sql('av', 'b')}
  SELECT arm, round(point, 9) AS point, round(low, 9) AS low, round(high, 9) AS high, n, (SELECT round(avg(floor), 9) FROM fl) AS floor FROM b""")
def _(s, d):
    got = metrics.report(v.judgements(s, d), "stage2_score", "stage2")
    return got.select("arm", *r9("point", "low", "high"), "n", *r9("floor"))


SWEEP = BLEND + """, wt AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight), b AS (SELECT weight, query_id, product_id, gain, CASE WHEN image_z IS NULL THEN text_z ELSE weight * text_z + (1 - weight) * image_z END AS s FROM z, wt),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, weight ORDER BY s DESC, product_id) AS r, row_number() OVER (PARTITION BY query_id, weight ORDER BY gain DESC) AS i FROM b),
pq AS (SELECT weight, query_id, CASE WHEN sum(gain / log2(i + 1)) > 0 THEN sum(gain / log2(r + 1)) / sum(gain / log2(i + 1)) ELSE 0 END AS n FROM r GROUP BY ALL), sw AS (SELECT weight, round(avg(n), 5) AS mean_ndcg FROM pq GROUP BY weight)"""


@add("g10_g11_weight_sweep", f"WITH {SWEEP} SELECT weight, mean_ndcg FROM sw")
def _(s, d):
    return metrics.weight_sweep(_blend(s, d), [0.0, 0.25, 0.5, 0.75, 1.0]).select("weight", F.round("mean_ndcg", 5).alias("mean_ndcg"))


@add("t9_best_weight", f"WITH {SWEEP} SELECT weight, mean_ndcg FROM sw ORDER BY mean_ndcg DESC, weight LIMIT 1")
def _(s, d):
    x = metrics.weight_sweep(_blend(s, d), [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("mean_ndcg", F.round("mean_ndcg", 5))
    return metrics.best_weight(x)


@add("g13_oracle", f"WITH {v.ARMS} SELECT query_id, arm, round(ndcg, 9) AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ndcg, 9) DESC, list_position(['stage2', 'ce', 'llm'], arm)) AS r FROM arms) WHERE r = 1")
def _(s, d):
    return metrics.oracle_choice(v.arms(s, d).withColumn("ndcg", F.round("ndcg", 9)), ["stage2", "ce", "llm"])


@add("g14_selector_targets", f"WITH {v.ARMS}, m AS (SELECT arm, avg(ndcg) AS mean FROM arms GROUP BY arm), x AS (SELECT query_id, arm, row_number() OVER (PARTITION BY query_id ORDER BY ndcg >= top - 1e-9 DESC, mean DESC, arm) AS r FROM (SELECT *, max(ndcg) OVER (PARTITION BY query_id) AS top FROM arms) JOIN m USING (arm)) SELECT query_id, arm FROM x WHERE r = 1")
def _(s, d):
    return metrics.selector_targets(v.arms(s, d), 1e-9)


PART = "(('0x' || substr(sha256('parts/v1:' || query_id), 1, 16))::UBIGINT % 3)::INT"


@add("g15_query_parts", f"WITH {v.J} SELECT query_id, {PART} AS part, count(*) AS n FROM j GROUP BY ALL")
def _(s, d):
    return metrics.query_parts(v.judgements(s, d), 3).groupBy("query_id", "part").agg(F.count("*").alias("n"))


@add("g16_cross_fit", f"""WITH {v.S}, y AS (SELECT *, {PART} AS part FROM s), m AS (SELECT p.part, label, avg(ce_score) AS m FROM (SELECT unnest(range(3)) AS part) p JOIN y ON y.part <> p.part GROUP BY p.part, label)
  SELECT query_id, product_id, round(m, 6) AS m FROM y JOIN m USING (part, label)""")
def _(s, d):
    fit = lambda x: x.groupBy("label").agg(F.avg("ce_score").alias("m"))
    return metrics.cross_fit(v.signals(s, d), 3, fit, lambda m, x: x.join(F.broadcast(m), "label")).select(*KEY, F.round("m", 6).alias("m"))


@add("g18_gate", f"WITH {v.ARMS}, x AS (SELECT a.arm, round(avg(a.ndcg - b.ndcg), 9) AS low FROM arms a JOIN n2 b USING (query_id) WHERE a.arm <> 'ce' GROUP BY a.arm) SELECT max_by(arm, (low, arm)) AS arm, max(low) AS low FROM x WHERE low > 0")
def _(s, d):
    x = v.arms(s, d)
    base = x.where("arm = 'ce'").select("query_id", F.col("ndcg").alias("b"))
    return metrics.gate(x.where("arm <> 'ce'").join(base, "query_id").groupBy("arm").agg(F.round(F.avg(F.col("ndcg") - F.col("b")), 9).alias("low")))


@add("g19_j22_comparisons", f"WITH {v.ARMS}, m AS (SELECT arm, avg(ndcg) AS m FROM arms GROUP BY arm) SELECT a.arm, b.arm AS base, round(a.m - b.m, 9) AS delta FROM m a JOIN m b ON a.arm > b.arm")
def _(s, d):
    m = v.arms(s, d).groupBy("arm").agg(F.avg("ndcg").alias("m"))
    a, b = m, m.select(F.col("arm").alias("base"), F.col("m").alias("mb"))
    return a.join(b, F.col("arm") > F.col("base")).select("arm", "base", F.round(F.col("m") - F.col("mb"), 9).alias("delta"))


@add("g20_k13_table", f"WITH {v.ARMS}, m AS (SELECT arm, round(avg(ndcg), 4) AS m FROM arms GROUP BY arm) SELECT '| ' || arm || ' | ' || printf('%.4f', m) || ' |' AS line FROM m")
def _(s, d):
    x = v.arms(s, d).groupBy("arm").agg(F.format_string("%.4f", F.round(F.avg("ndcg"), 4)).alias("m"))
    return writers.markdown_rows(x, ["arm", "m"])


@add("l1_pointwise_out_of_fold")
def _(s, d):
    from loomrank.operators import learned

    x = v.windows(s, d).withColumn("fold", (F.col("query_id") % 2).cast("int"))
    got = learned.out_of_fold(x, [0, 1], lambda t: learned.train_pointwise(t, ["stage2_score", "ce_score", "llm_rank"], rounds=3, depth=3))
    return got.select(*KEY, F.round("score", 6).alias("score"))


@add("l6_pair_scorer", f"WITH {v.S}, {v.P}, x AS (SELECT query_id, product_id, list_distinct(string_split(query, ' ')) AS q, list_distinct(string_split(lower(product_title), ' ')) AS t FROM s JOIN p USING (product_id)) SELECT query_id, product_id, len(list_intersect(q, t)) / greatest(1, len(q)) AS score FROM x")
def _(s, d):
    x = v.signals(s, d).join(v.products(s, d).select("product_id", F.col("product_title").alias("text")), "product_id").select(*KEY, "query", "text")
    return retrieval.scored_pairs(x, _overlap_scorer).select(*KEY, "score")


def _overlap_scorer():
    return lambda queries, texts: [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.split()))) for q, t in zip(queries, texts)]


FLAGSHIP_SQL = f"WITH {NDCG}, {FLOOR.split(', x AS', 1)[1].join(['x AS', ''])} SELECT c_mktsegment AS segment, count(*) AS n_queries, round(avg(ndcg), 9) AS ndcg, round(avg(floor), 9) AS floor FROM n JOIN fl USING (query_id) JOIN customer ON query_id = c_custkey GROUP BY 1"


@add("flagship_ndcg_by_segment", FLAGSHIP_SQL)
def flagship(s, d):
    """Mean NDCG and random floor of the queries of each market segment."""
    x = metrics.ndcg_and_floor(v.judgements(s, d), "stage2_score")
    seg = table(s, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("segment"))
    return x.join(seg, "query_id").groupBy("segment").agg(F.count("*").alias("n_queries"), F.round(F.avg("ndcg"), 9).alias("ndcg"), F.round(F.avg("floor"), 9).alias("floor"))

from . import rows, training, trips  # noqa: E402, F401  registers more
