"""Registered queries that write what the tables give and read it back (S, K and R rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import text
from loomrank.operators import relational, retrieval
from loomrank.session import scratch, stored, table
from loomrank.sources import readers, writers
from loomrank.streaming import incremental

from . import views as v
from .queries import KEY, add, r9


@add("k1_k2_parquet", f"WITH {v.J} SELECT query_id, product_id, label, gain FROM j")
def _(s, d):
    path = scratch(s)
    writers.parquet(v.judgements(s, d).select(*KEY, "label", "gain"), path)
    return readers.parquet(s, path, [*KEY, "label", "gain"])


@add("s4_json_lines", "SELECT event_id::VARCHAR AS asin, event_type AS type, user_id::VARCHAR AS title, props AS info FROM events")
def _(s, d):
    path = scratch(s)
    table(s, d, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("asin"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("title"), F.col("props").alias("info"))).alias("value")).write.option("compression", "gzip").text(path)
    return readers.json_lines(s, path).select("asin", "type", "title", "info")


@add("s6_k3_frozen_folds", f"WITH {v.J} SELECT DISTINCT query_id, (('0x' || substr(sha256('val-folds/v1:' || query_id), 1, 16))::UBIGINT % 5)::INT AS fold FROM j")
def _(s, d):
    path = scratch(s)
    writers.frozen_folds(v.folded(s, d).select("query_id", "fold").distinct(), path)
    return readers.frozen_folds(s, path)


@add("s11_bm25_open", "SELECT count(DISTINCT doc_id) AS n_docs, sum(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains(" + repr(retrieval.STOPWORDS) + ", t))))) ::BIGINT AS n_postings FROM documents")
def _(s, d):
    path, docs = scratch(s), table(s, d, "documents").select("doc_id", "text")
    writers.bm25_index(retrieval.postings(docs.withColumnRenamed("doc_id", "doc"), "doc", F.col("text")), retrieval.document_stats(docs, F.col("text")), docs, path)
    postings, stats = readers.bm25_index(s, path)
    return postings.agg(F.count("*").alias("n_postings")).join(stats.select("n_docs"))


@add("s12_k9_answer_cache", f"WITH {v.S} SELECT query_id::VARCHAR AS window_key, string_agg(llm_rank::VARCHAR, ',' ORDER BY stage2_rank) AS permutation, 'm1' AS model FROM s WHERE query_id % 7 <> 0 GROUP BY query_id")
def _(s, d):
    """Entries without a list are written too, and skipped by the reader."""
    path = scratch(s)
    x = v.signals(s, d).groupBy(F.col("query_id").cast("string").alias("window_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("stage2_rank", "llm_rank"))), lambda r: r["llm_rank"]).alias("permutation"))
    x = x.withColumns({"permutation": F.when(F.col("window_key").cast("long") % 7 != 0, F.col("permutation")), "model": F.lit("m1"), "prompt_fp": F.lit("f"), "k": F.lit(10)})
    writers.cache(x, path)
    return readers.answer_cache(s, path).select("window_key", F.array_join("permutation", ",").alias("permutation"), "model")


@add("s13_k6_results", f"WITH {v.ARMS} SELECT arm AS name, round(avg(ndcg), 9) AS ndcg, count(*) AS n FROM arms GROUP BY arm")
def _(s, d):
    """A document an arm, in a folder of its own."""
    path, arms = scratch(s), ["stage2", "ce", "llm"]
    x = stored(v.arms(s, d).groupBy(F.col("arm").alias("name")).agg(F.round(F.avg("ndcg"), 9).alias("ndcg"), F.count("*").alias("n")))
    for arm in arms:
        writers.report(x.where(F.col("name") == arm).coalesce(1), f"{path}/{arm}")
    return readers.results(s, f"{path}/*", arms).select("name", "ndcg", "n")


@add("k7_vector_append", "SELECT vec_id AS key, len(embedding) AS width, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def _(s, d):
    """Two appends, the second of keys that the store doesn't have."""
    path = scratch(s)
    x = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    odd = F.col("key") % 2 == 1
    writers.append_vectors(x.where(odd), path, None, 64)
    writers.append_vectors(x.where(~odd), path, readers.vectors(s, path, 64), 64)
    return readers.vectors(s, path, 64).select("key", F.size("embedding").cast("long").alias("width"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@add("k11_s19_v18_record", "SELECT vec_id FROM embeddings")
def _(s, d):
    """A store with the record of its encoder, which must be there and agree before it is read."""
    path = scratch(s)
    writers.parquet(table(s, d, "embeddings").select("vec_id"), f"{path}/vectors")
    writers.model_record(s, path, "m1", 512)
    readers.check_model_record(s, path, "m1", 512)
    return readers.parquet(s, f"{path}/vectors")


@add("k12_slim_bundle", f"WITH {v.J}, {v.P}, f AS (SELECT * FROM j WHERE (('0x' || substr(sha256('val-folds/v1:' || query_id), 1, 16))::UBIGINT % 5)::INT = 0) SELECT product_id, product_title FROM p SEMI JOIN f USING (product_id)")
def _(s, d):
    path = scratch(s)
    fold = v.folded(s, d).where("fold = 0")
    writers.parquet(v.products(s, d).join(fold.select("product_id"), "product_id", "left_semi").select("product_id", "product_title"), path)
    return readers.parquet(s, path)


@add("u2_g17_union", f"""WITH {v.J}, y AS (SELECT *, (('0x' || substr(sha256('val-folds/v1:' || query_id), 1, 16))::UBIGINT % 5)::INT AS fold FROM j),
  m AS (SELECT f.fold, label, avg(ce_score) AS m FROM (SELECT unnest([2, 3, 4]) AS fold) f JOIN y ON y.fold IN (2, 3, 4) AND y.fold <> f.fold GROUP BY f.fold, label) SELECT query_id, product_id, fold, false AS in_sample, round(m, 6) AS m FROM y JOIN m USING (fold, label)""")
def _(s, d):
    from loomrank.operators import learned

    def fit(x):
        m = x.groupBy("label").agg(F.avg("ce_score").alias("m"))
        return lambda y: y.join(F.broadcast(m), "label")  # a row a label

    got = learned.out_of_fold(v.folded(s, d).where("fold IN (2, 3, 4)"), [2, 3, 4], fit, reserved=(0, 1))
    return got.select(*KEY, "fold", "in_sample", *[F.round("m", 6).alias("m")])


@add("l11_l12_encoded", f"WITH {v.P} SELECT product_id, length(product_title)::DOUBLE AS chars, (length(product_title) - length(replace(product_title, 'a', '')))::DOUBLE AS letters FROM p WHERE substr(product_id, 2)::BIGINT % 3 <> 0")
def _(s, d):
    """Texts that a store doesn't have yet, through the batch contract of encoders; the encoder counts characters."""
    x = v.products(s, d).select("product_id", F.col("product_title").alias("text"))
    done = x.where(F.substring("product_id", 2, 20).cast("long") % 3 == 0).select("product_id")
    todo = relational.pending(x, done, "product_id").join(x, "product_id")
    got = retrieval.encoded(todo, "text", lambda: lambda ts: [[float(len(t)), float(t.count("a"))] for t in ts], 2)
    return got.select("product_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("letters"))


@add("r1_available_now", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def _(s, d):
    """One pass of the stream over what is there, started twice: the second start adds nothing."""
    path, checkpoint = scratch(s), scratch(s)
    events = table(s, d, "events")
    for _ in range(2):
        source = s.readStream.schema(events.schema).parquet(f"{d}/events*.parquet")
        incremental.available_now(source, path, checkpoint, lambda x: x.where("event_type <> 'error'").select("event_id", "user_id", "event_type"))
    return s.read.parquet(path)


@add("r2_r3_keyed_batches", "SELECT user_id, ('u' || user_id) AS name FROM events GROUP BY user_id")
def _(s, d):
    """Keys worked on once over two passes of a stream, by keyed state; the second pass starts anew from its checkpoint."""
    path, checkpoint = scratch(s), scratch(s)
    events = table(s, d, "events")
    for _ in range(2):
        source = s.readStream.schema(events.schema).parquet(f"{d}/events*.parquet")
        incremental.keyed_batches(source, path, checkpoint, "user_id", lambda x: x.select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")))
    return s.read.parquet(path).select("user_id", "name")


@add("j18_whole_lists", f"""WITH {v.J}, r AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY stage2_score DESC, product_id) AS position FROM j)
  SELECT round(avg(CASE WHEN a.gain > b.gain THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n_pairs FROM r a JOIN r b ON a.query_id = b.query_id AND a.position < b.position AND a.gain <> b.gain""")
def _(s, d):
    x = v.ranked(v.judgements(s, d), "stage2_score", "position")
    return relational.pairwise_accuracy(x).select(*r9("accuracy"), "n_pairs")


@add("f14_listing_of_titles", f"WITH {v.S}, {v.P} SELECT query_id, string_agg('[' || stage2_rank || '] ' || substr(product_description, 1, 20), chr(10) ORDER BY stage2_rank) AS listing FROM s JOIN (SELECT product_id, coalesce(product_description, product_title) AS product_description FROM p) USING (product_id) GROUP BY query_id")
def _(s, d):
    p = v.products(s, d).select("product_id", F.coalesce("product_description", "product_title").alias("t"))
    x = v.signals(s, d).join(p, "product_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("stage2_rank", "t"))).alias("w"))
    return x.select("query_id", text.listing(F.col("w.t"), 20).alias("listing"))
