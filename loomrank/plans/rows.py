"""Registered queries of inventory rows that no larger query returns: guards, small functions, training rows and re-ranking passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import nested, numeric, text
from loomrank.operators import aggregates as agg
from loomrank.operators import features, guards, learned, metrics, ranking, relational, rerank, retrieval
from loomrank.session import table
from loomrank.sources import readers, writers

from . import views as v
from .queries import KEY, add, r9

# --- guards: each returns its rows, or raises ---------------------------------------

SEEN = "SELECT event_id, user_id, value FROM events"


def _events(s, d):
    return table(s, d, "events").select("event_id", "user_id", "value")


def _deltas(s, d):
    arms = v.arms(s, d)
    base = arms.where("arm = 'stage2'").select("query_id", F.col("ndcg").alias("b"))
    return arms.where("arm <> 'stage2'").join(base, "query_id").select("query_id", "arm", (F.col("ndcg") - F.col("b")).alias("delta"))


def _shifts(s, d):
    """How far two fields lie apart, and a mean from its reproduction out of the means of groups."""
    x = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"), F.sum("l_discount").alias("sd"), F.sum("l_tax").alias("st"))
    y = x.agg(F.sum("sd").alias("sd"), F.sum("st").alias("st"), F.sum("n").alias("n"), F.sum(F.col("m") * F.col("n")).alias("again"))
    return y.select(F.round((F.col("sd") - F.col("st")) / F.col("n"), 9).alias("shift"), (F.round(F.col("again") / F.col("n") - F.col("sd") / F.col("n"), 9) + 0.0).alias("gap"))


def _guarded(name: str, sql: str, f) -> None:
    add(name, sql)(f)


_guarded("v1_unique", f"WITH {v.J} SELECT query_id, product_id, label FROM j", lambda s, d: guards.unique(v.judgements(s, d), *KEY).select(*KEY, "label"))
_guarded("v2_only_folds", f"{SEEN} WHERE event_id % 5 < 3", lambda s, d: guards.only_folds(_events(s, d).withColumn("fold", (F.col("event_id") % 5).cast("int")).where("fold < 3"), [0, 1, 2]).drop("fold"))
_guarded("v3_v4_share", SEEN, lambda s, d: guards.share_at_most(_events(s, d), F.col("event_id") % 1000 == 7, guards.FALLBACK, "fallbacks"))
_guarded("v5_complete", f"WITH {v.S} SELECT query_id, product_id, llm_rank FROM s", lambda s, d: guards.complete(v.signals(s, d), "stage2_score", "ce_score", "llm_rank").select(*KEY, "llm_rank"))
_guarded("v6_join_coverage", f"WITH {v.P} SELECT avg(has_enrichment::INT::DOUBLE) AS coverage FROM e", lambda s, d: guards.value_between(v.enriched(s, d).agg(F.avg(F.col("has_enrichment").cast("int")).alias("coverage")), "coverage", guards.JOIN_COVERAGE, 1.0))
_guarded("v7_v9_shift", """SELECT round(avg(l_discount) - avg(l_tax), 9) AS shift, round((SELECT sum(m * n) / sum(n) FROM (SELECT l_returnflag, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY 1)) - avg(l_discount), 9) + 0.0 AS gap FROM lineitem""",
         lambda s, d: guards.value_between(guards.value_between(_shifts(s, d), "shift", -guards.DENSE_SHIFT, guards.DENSE_SHIFT), "gap", -guards.REPRODUCTION, guards.REPRODUCTION))
_guarded("v8_book_share", "SELECT avg((p_size = 7 OR p_size = 8 OR p_size = 9)::INT::DOUBLE) AS share FROM part", lambda s, d: guards.value_between(table(s, d, "part").agg(F.avg(F.col("p_size").isin(7, 8, 9).cast("int")).alias("share")), "share", *guards.BOOK_SHARE))
_guarded("v10_lossless", f"WITH {v.ARMS}, x AS (SELECT a.arm, a.ndcg - b.ndcg AS delta FROM arms a JOIN n1 b USING (query_id) WHERE a.arm <> 'stage2') SELECT arm, round(min(delta), 9) AS low, round(max(delta), 9) AS high FROM x GROUP BY arm",
         lambda s, d: guards.lossless(_deltas(s, d).groupBy("arm").agg(F.round(F.min("delta"), 9).alias("low"), F.round(F.max("delta"), 9).alias("high"))))
_guarded("v12_provenance", "SELECT event_id, 'm' || user_id % 3 AS model, event_type AS kind FROM events WHERE user_id % 3 = 1 AND event_type = 'view'",
         lambda s, d: guards.same_provenance(table(s, d, "events").where("event_type = 'view' AND user_id % 3 = 1").select("event_id", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("kind")), model="m1", kind="view"))
_guarded("v14_not_empty", f"WITH {v.S} SELECT query_id, product_id, stage2_rank FROM s", lambda s, d: guards.not_empty(v.signals(s, d), "windows").select(*KEY, "stage2_rank"))
_guarded("v17_enough", "SELECT DISTINCT user_id FROM events", lambda s, d: guards.enough(table(s, d, "events"), "user_id", 10).select("user_id").distinct())


@add("v11_final_only", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM events WHERE event_id % 5 <> 0 OR user_id % 2 = 0")
def _(s, d):
    """Rows of both splits: those of the test split only with leave, which even users have."""
    x = table(s, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("user_id") % 2 == 0).alias("final"))
    return guards.final_rows(x.where("split = 'train' OR final")).select("event_id", "split")


@add("v13_v15_sets", "SELECT event_type AS arm, count(*) AS n, 'p0,p1' AS precisions FROM events GROUP BY 1")
def _(s, d):
    x = table(s, d, "events").select(F.col("event_type").alias("arm"), F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("precision"))
    got = guards.complete_sets(x, ["arm"], "precision", ["p0", "p1"])
    return got.select("arm", "n", F.array_join("found", ",").alias("precisions"))


@add("v13_v15_v18_names", f"WITH {v.ARMS} SELECT arm, count(*) AS n FROM arms GROUP BY arm")
def _(s, d):
    return guards.complete_sets(v.arms(s, d).withColumn("all", F.lit(1)), ["all"], "arm", ["ce", "llm", "stage2"], keep=True)


@add("v16_u8_disjoint", "SELECT event_id % 2 AS half, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 2).alias("half"))
    guards.disjoint(e.where("half = 0"), e.where("half = 1"), "event_id")
    return e.groupBy("half").agg(F.count("*").alias("n"))


@add("u10_no_leak", f"WITH {v.P} SELECT product_id, length(product_title)::DOUBLE AS title_chars, has_enrichment::INT::DOUBLE AS has_enrichment FROM e")
def _(s, d):
    names = ["title_chars", "has_enrichment"]
    relational.no_leak(names, {"label", "gain", "qrel", "label_code"})
    return features.product_matrix(v.enriched(s, d)).select("product_id", *names)


# --- small functions ------------------------------------------------------------------

@add("f6_f7_scraped", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN (12000 + p_size)::INT ELSE -1 END AS ratings, CASE WHEN p_partkey % 4 <> 0 THEN 1000 + p_size + 0.25::DOUBLE END AS price, p_partkey % 4 = 1 AS multi FROM part""")
def _(s, d):
    k, size = F.col("p_partkey"), F.lpad(F.col("p_size").cast("string"), 3, "0")
    ratings = F.when(k % 3 == 0, "1 rating").when(k % 3 == 1, F.concat(F.lit(" 12,"), size, F.lit(" ratings "))).otherwise("none yet")
    price = F.when(k % 4 == 0, "unavailable").otherwise(F.concat(F.lit("$1,"), size, F.lit(".25"), F.when(k % 4 == 1, " - $9,999.99").otherwise("")))
    got = text.parse_price(price)
    return table(s, d, "part").select("p_partkey", F.coalesce(text.parse_ratings(ratings), F.lit(-1)).alias("ratings"), got["price"].alias("price"), got["multi"].alias("multi"))


@add("f18_f21_f22_text", f"WITH {v.P} SELECT product_id, s_category[1] AS head, CASE WHEN length(product_brand) > 0 THEN length(product_brand)::DOUBLE END AS chars, regexp_matches(product_title, '(?i)(ring|bolt)') AS mentions FROM e")
def _(s, d):
    return v.enriched(s, d).select("product_id", text.top_category(F.col("s_category")).alias("head"), text.char_length(F.col("product_brand")).alias("chars"), text.mentions(F.col("product_title"), "ring", "bolt").alias("mentions"))


TEMPLATE = "Rank the {n} products below for: {query}\n{listing}\nAnswer with numbers only."


@add("f13_f14_prompt", f"""WITH {v.S}, {v.P} SELECT query_id, sha256('Rank the ' || count(*) || ' products below for: ' || any_value(query) || chr(10) || string_agg('[' || stage2_rank || '] ' || substr(product_title, 1, 160), chr(10) ORDER BY stage2_rank) || chr(10) || 'Answer with numbers only.') AS prompt,
  substr(sha256('Rank the {{n}} products below for: {{query}}' || chr(10) || '{{listing}}' || chr(10) || 'Answer with numbers only.'), 1, 16) AS fp FROM s JOIN p USING (product_id) GROUP BY query_id""")
def _(s, d):
    x = _windows(s, d)
    return x.select("query_id", F.sha2(rerank.prompt(TEMPLATE, F.col("query"), F.col("titles")), 256).alias("prompt"), rerank.prompt_fingerprint(TEMPLATE).alias("fp"))


@add("f12_window_key", f"""WITH {v.S} SELECT query_id, sha256('["' || any_value(query) || '","' || string_agg(product_id, '","' ORDER BY stage2_rank) || '"]') AS window_key FROM s GROUP BY query_id""")
def _(s, d):
    return _windows(s, d).select("query_id", text.window_key(F.col("query"), F.col("docs")).alias("window_key"))


@add("m1_dcg_terms", f"WITH {v.S} SELECT query_id, product_id, round(gain / log2(stage2_rank + 1), 9) AS term FROM s")
def _(s, d):
    return v.signals(s, d).select(*KEY, F.round(numeric.dcg_term(F.col("gain"), F.col("stage2_rank")), 9).alias("term"))


@add("m15_m17_m18_numbers", "SELECT event_id, round((user_id * 3.0 + event_id * 5.0) / 1e6, 12) AS cost, round(-ln((event_id % 97 + 1) / 100.0) / 4, 9) AS gap, greatest(60.0, 150.0 / (user_id % 8 + 1))::DOUBLE AS seconds, (event_id % 11) / 10.0::DOUBLE AS target FROM events")
def _(s, d):
    e, k = table(s, d, "events"), F.col("event_id")
    return e.select("event_id", F.round(numeric.token_cost(F.col("user_id"), k, F.lit(3.0), F.lit(5.0)), 12).alias("cost"), F.round(numeric.poisson_gap((k % 97 + 1) / 100.0, 4.0), 9).alias("gap"),
                    numeric.load_seconds((F.col("user_id") % 8 + 1).cast("double")).alias("seconds"), numeric.soft_target((k % 11) / 10.0).alias("target"))


@add("x2_x3_terms", f"""WITH {v.P}, x AS (SELECT product_id, CASE WHEN s_attrs_json IS NOT NULL THEN list_distinct(list_concat(['size'], ['brand'])) ELSE [] END AS k,
    coalesce(list_distinct(regexp_extract_all(lower(json_extract_string(s_attrs_json, '$.Size') || ' ' || json_extract_string(s_attrs_json, '$.Brand')), '[a-z0-9]+')), []) AS val, list_distinct(regexp_extract_all(lower(product_title), '[a-z0-9]+')) AS t FROM e)
  SELECT product_id, array_to_string(list_sort(k), ' ') AS keys, array_to_string(list_sort(val), ' ') AS vals, array_to_string(list_sort(t), ' ') AS title FROM x""")
def _(s, d):
    shown = lambda c: F.array_join(F.array_sort(c), " ")
    return features.with_terms(v.enriched(s, d)).select("product_id", shown("t_attr_keys").alias("keys"), shown("t_attr_values").alias("vals"), shown("t_title").alias("title"))


@add("x14_x15_encoding", """SELECT p_partkey, array_to_string(list_resize(list_slice(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 1, 1), 3, '-'), ' ') AS right_ids, '0 0 1' AS left_mask, len(list_slice(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 1, greatest(3 - len(regexp_extract_all(lower(p_brand), '[a-z0-9]+')), 0)))::INT AS kept FROM part""")
def _(s, d):
    one = F.slice(text.tokens(F.col("p_type")), 1, 1)
    pad = lambda left: learned.padded(one, F.lit(3), left, "-")
    return table(s, d, "part").select("p_partkey", F.array_join(pad(False)["ids"], " ").alias("right_ids"), F.array_join(F.transform(pad(True)["mask"], lambda x: x.cast("string")), " ").alias("left_mask"),
                                      F.size(learned.truncated_pairs(text.tokens(F.col("p_brand")), text.tokens(F.col("p_name")), 3)).alias("kept"))


# --- filters, joins, windows --------------------------------------------------------------

@add("p2_locale", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 2 = 1 AND event_id % 3 <> 0")
def _(s, d):
    x = table(s, d, "events").withColumns({"product_locale": F.col("event_type"), "small_version": (F.col("user_id") % 2).cast("int"), "split": F.when(F.col("event_id") % 3 == 0, "test").otherwise("train")})
    return relational.conjunctive_filter(x, "view", "small_version", "train").select("event_id")


@add("p4_p5_record_kinds", "SELECT event_type AS type, count(*) AS seen, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS kept FROM events GROUP BY 1")
def _(s, d):
    x = table(s, d, "events").select(F.col("event_type").alias("type"), F.lit("us").alias("locale"))
    return agg.pass_counters(x, "us", by=["type"]).select("type", "seen", "kept")


@add("p7_p8_fallbacks", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE lower(p_type) END AS told, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '{"a":"' || p_size || '","b":"' || p_partkey || '"}' END AS attrs FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    a = F.when(k % 4 == 0, "{}").otherwise(F.concat(F.lit('{"b":"'), k.cast("string"), F.lit('","a":"'), F.col("p_size").cast("string"), F.lit('"}')))
    return table(s, d, "part").select("p_partkey", text.first_text(F.when(k % 3 == 0, F.concat(F.lit("  "), "p_name")).otherwise(" \t "), F.lower("p_type")).alias("told"), nested.sorted_json(nested.json_map(a)).alias("attrs"))


@add("p9_j2_prefixed", f"WITH {v.P} SELECT product_id, s_template, s_price, has_enrichment FROM e")
def _(s, d):
    return v.enriched(s, d).select("product_id", "s_template", "s_price", F.coalesce("has_enrichment", F.lit(False)).alias("has_enrichment"))


@add("p18_no_zero_scores", """WITH d AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), st AS (SELECT term, max(item_id) AS item_id FROM (SELECT item_id, unnest(t) AS term FROM d) WHERE item_id % 3 <> 0 GROUP BY term)
  SELECT term, item_id FROM st""")
def _(s, d):
    """Every third item scores 0 and never shows, so a term that stands in such items only has no row."""
    x = table(s, d, "benchmark").select("item_id", F.explode(text.token_set(F.col("text"))).alias("term"))
    terms = x.select("term").distinct().select(F.col("term").alias("query_id"), "term", F.lit(1).alias("qtf"))
    hits = x.withColumn("impact", F.when(F.col("item_id") % 3 != 0, F.col("item_id") + 1.0).otherwise(0.0))
    return retrieval.bm25_top(terms, hits, "item_id", 1).select(F.col("query_id").alias("term"), "item_id")


@add("p20_scope_windows", f"WITH {v.J}, r AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY stage2_score DESC, product_id) AS stage2_rank FROM j) SELECT *, stage2_rank <= 10 AS in_window FROM r")
def _(s, d):
    x = v.judgements(s, d)
    return rerank.scope_windows(x.select(*KEY, "gain"), x.select(*KEY, "stage2_score"), 10).select(*KEY, "stage2_rank", "in_window")


@add("j4_j14_semi", f"WITH {v.J}, {v.P} SELECT product_id, product_title FROM p SEMI JOIN j USING (product_id)")
def _(s, d):
    return v.products(s, d).join(v.judgements(s, d).select("product_id"), "product_id", "left_semi").select("product_id", "product_title")


@add("j6_no_missing", f"WITH {v.J} SELECT query_id, product_id FROM j")
def _(s, d):
    return relational.no_missing(v.judgements(s, d), v.products(s, d), ["product_id"], "judged products without a row").select(*KEY)


@add("j7_missing_evidence", f"WITH {v.J}, {v.P} SELECT query_id, product_id, s_stars, asin IS NOT NULL AS there FROM j LEFT JOIN c ON product_id = asin")
def _(s, d):
    c = v.corpus(s, d).select(F.col("asin").alias("product_id"), F.col("stars").alias("s_stars"), F.lit(True).alias("there"))
    return v.judgements(s, d).select(*KEY).join(c, "product_id", "left").fillna(False, ["there"]).select(*KEY, "s_stars", "there")


@add("j8_pair_and_product", f"WITH {v.J}, {v.P} SELECT query_id, product_id, length(query)::DOUBLE AS query_chars, length(product_title)::DOUBLE AS title_chars FROM j JOIN p USING (product_id)")
def _(s, d):
    e = v.enriched(s, d)
    return features.pair_matrix(v.judgements(s, d), e).select(*KEY, "query_chars").join(features.product_matrix(e).select("product_id", "title_chars"), "product_id", "left").select(*KEY, "query_chars", "title_chars")


@add("j11_j12_inner", f"WITH {v.S} SELECT query_id, product_id, s.llm_rank, j.gain FROM s JOIN j USING (query_id, product_id)")
def _(s, d):
    x = v.signals(s, d).select(*KEY, "llm_rank").join(v.judgements(s, d).select(*KEY, "gain"), KEY)
    return guards.complete(x, "gain")


@add("a36_outcomes", f"WITH {v.ARMS}, x AS (SELECT a.ndcg - b.ndcg AS delta FROM n2 a JOIN n1 b USING (query_id)) SELECT CASE WHEN delta > 1e-9 THEN 'better' WHEN delta < -1e-9 THEN 'worse' ELSE 'same' END AS outcome, count(*) AS n FROM x GROUP BY 1")
def _(s, d):
    x = v.arms(s, d)
    return agg.outcome_profile(metrics.paired(x.where("arm = 'ce'"), x.where("arm = 'stage2'")), "a").select("outcome", "n")


@add("w2_ideal_dcg", f"WITH {v.S}, {v.ndcg_sql('s', 'stage2_score', 'n1')} SELECT query_id, round(idcg, 9) AS idcg FROM n1")
def _(s, d):
    return metrics.ndcg_per_query(v.signals(s, d), "stage2_score").select("query_id", *r9("idcg"))


@add("t2_ascending", f"WITH {v.S} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY ce_score ASC NULLS LAST, product_id) AS rank FROM s")
def _(s, d):
    return v.signals(s, d).withColumn("rank", ranking.rank_by("ce_score", ascending=True)).select(*KEY, "rank")


@add("k5_qrel_lines", f"WITH {v.J} SELECT query_id || ' 0 ' || product_id || ' ' || qrel AS value FROM j")
def _(s, d):
    return writers.qrel_lines(v.judgements(s, d)).select("value")


@add("k14_report_rows", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def _(s, d):
    return writers.markdown_rows(table(s, d, "region"), ["r_regionkey", "r_name"])


@add("s7_s8_persisted", "SELECT p_partkey, p_size FROM part")
def _(s, d):
    return readers.parquet(s, f"{d}/part.parquet", ["p_partkey", "p_size"], hint="run the pass that writes it")


@add("s9_s10_vectors", "SELECT vec_id, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def _(s, d):
    return readers.vectors(s, f"{d}/embeddings.parquet", 64).select("vec_id", F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last"))


@add("s15_s16_fetched", "SELECT url, CASE WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 5 = 1 THEN 'small' ELSE 'ok' END AS outcome FROM pages")
def _(s, d):
    def opener():
        tried: dict = {}

        def get(url):
            tried[url] = tried.get(url, 0) + 1
            kind = int(url.rsplit("#", 1)[1]) % 5
            return (404, b"") if kind == 0 else (503, b"") if kind == 2 and tried[url] < 3 else (200, bytes([8 if kind == 1 else 32]))

        return get

    x = table(s, d, "pages").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    return readers.fetched(x, opener, lambda b: (b[0], b[0])).select(F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "outcome")


# --- training rows and passes ----------------------------------------------------------------

def _windows(s, d):
    x = v.signals(s, d).join(v.products(s, d).select("product_id", "product_title"), "product_id")
    y = x.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("stage2_rank", "product_id", "product_title"))).alias("w"))
    return y.select("query_id", "query", F.col("w.product_id").alias("docs"), F.col("w.product_title").alias("titles"))


def _texts(s, d):
    return v.judgements(s, d).select("query_id", "query").distinct(), v.products(s, d).select("product_id", F.col("product_title").alias("text"))


@add("x11_window_dataset", f"""WITH {v.S}, {v.P}, h AS (SELECT s.*, product_title, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, llm_rank) AS place FROM s JOIN p USING (product_id))
  SELECT query_id, query_id % 3 = 0 AS dropped, any_value(query) AS query, CASE WHEN query_id % 3 <> 0 THEN sha256(string_agg(product_title, '|' ORDER BY stage2_rank)) END AS docs,
    CASE WHEN query_id % 3 <> 0 THEN string_agg((n - place + 1)::INT::VARCHAR, ',' ORDER BY stage2_rank) END AS labels FROM h GROUP BY query_id""")
def _(s, d):
    x = v.signals(s, d).select(*KEY, "stage2_rank", "gain", F.when(F.col("query_id") % 3 != 0, F.col("llm_rank")).alias("position"))
    got = rerank.window_dataset(x, *_texts(s, d), "hybrid")
    return got.select("query_id", "dropped", "query", F.when(~F.col("dropped"), F.sha2(F.array_join("docs", "|"), 256)).alias("docs"), F.when(~F.col("dropped"), F.array_join(F.transform("labels", lambda x: x.cast("int").cast("string")), ",")).alias("labels"))


@add("x12_pairwise_rows", f"WITH {v.J}, {v.P} SELECT query_id, product_id, query, product_title AS doc, gain AS label FROM j JOIN p USING (product_id)")
def _(s, d):
    return rerank.pairwise_rows(v.judgements(s, d).select(*KEY, "gain"), *_texts(s, d))


@add("x13_list_rows", f"""WITH {v.S}, y AS (SELECT *, (('0x' || substr(sha256('val-folds/v1:' || query_id), 1, 16))::UBIGINT % 5)::INT AS fold FROM s), t AS (SELECT * FROM y WHERE fold IN (2, 3, 4)),
  m AS (SELECT f.fold, label, avg(ce_score) AS m FROM (SELECT unnest([2, 3, 4]) AS fold) f JOIN t ON t.fold <> f.fold GROUP BY f.fold, label), o AS (SELECT t.*, round(m, 9) AS score FROM t JOIN m USING (fold, label))
  SELECT query_id, any_value(fold) AS fold, string_agg(product_id, ',' ORDER BY score DESC, product_id) AS docs, string_agg(label, ',' ORDER BY score DESC, product_id) AS labels FROM o GROUP BY query_id""")
def _(s, d):
    """Lists of the training folds, each in the order of a model of the other two: mean scores by label."""
    def fit(x):
        m = x.groupBy("label").agg(F.round(F.avg("ce_score"), 9).alias("score"))
        return lambda y: y.join(F.broadcast(m), "label")  # a row a label

    x = relational.with_fold(v.signals(s, d)).where("fold IN (2, 3, 4)")
    scored = learned.out_of_fold(x, [2, 3, 4], fit, reserved=(0, 1)).withColumn("stage2_rank", ranking.rank_by("score"))
    got = agg.listwise(scored).join(scored.select("query_id", "fold").distinct(), "query_id")
    return got.select("query_id", "fold", F.array_join("docs", ",").alias("docs"), F.array_join("labels", ",").alias("labels"))


@add("l10_listwise_rerank", f"""WITH {v.S}, x AS (SELECT query_id, product_id, stage2_rank, count(*) OVER (PARTITION BY query_id) AS n FROM s)
  SELECT query_id, string_agg(product_id, ',' ORDER BY CASE WHEN query_id % 4 IN (0, 1) THEN n - stage2_rank ELSE stage2_rank END) AS ordering,
    CASE query_id % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'call' ELSE 'fallback' END AS source, CASE WHEN query_id % 4 IN (1, 2) THEN any_value(n) ELSE 0 END::BIGINT AS prompt_tokens FROM x GROUP BY query_id""")
def _(s, d):
    """A stand-in for the hosted model: answers from the cache, reversed orders, answers that are none, and calls that fail."""
    windows = _windows(s, d).withColumn("query", F.concat("query", F.lit(" #"), F.col("query_id").cast("string")))
    held = windows.where("query_id % 4 = 0").select(text.window_key(F.col("query"), F.col("docs")).alias("window_key"), F.reverse(F.sequence(F.lit(1), F.size("docs"))).alias("permutation"), F.lit("m1").alias("model"), rerank.prompt_fingerprint(TEMPLATE).alias("prompt_fp"))

    def opener():
        import re

        def call(prompt):
            kind, n = int(re.search(r"#(\d+)", prompt).group(1)) % 4, int(re.search(r"the (\d+) products", prompt).group(1))
            if kind == 3:
                raise OSError("no answer")
            return (" > ".join(f"[{i}]" for i in range(n, 0, -1)) if kind == 1 else "[1] > [1]"), n, 1, 0

        return call

    got = rerank.listwise_rerank(windows, held, TEMPLATE, opener, "m1")
    return got.select("query_id", F.array_join("ordering", ",").alias("ordering"), "source", "prompt_tokens")


@add("l13_embedded_images", "SELECT url, CASE WHEN page_id % 4 = 0 THEN 'timeout' ELSE 'ok' END AS status, CASE WHEN page_id % 4 <> 0 THEN length(url)::DOUBLE END AS first FROM pages WHERE page_id % 3 <> 0")
def _(s, d):
    def opener():
        return lambda u: ("timeout", None) if int(u.rsplit("#", 1)[1]) % 4 == 0 else ("ok", u.rsplit("#", 1)[0])

    urls = table(s, d, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    stored = urls.where("page_id % 3 = 0").select(F.col("url").alias("key"))
    got = rerank.embedded_images(urls.union(urls), stored, opener, lambda: lambda images: [[float(len(i)), 0.0] for i in images], 2)
    return got.select(F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "status", F.get("embedding", F.lit(0)).cast("double").alias("first"))
