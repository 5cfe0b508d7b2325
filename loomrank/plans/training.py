"""Registered queries of the rankers that are trained here: boosting, combiner, selector and RankNet."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.operators import boosting, learned, ranknet, relational, retrieval
from loomrank.session import scratch, stored

from . import views as v
from .queries import KEY, add, r9

FOLD = "(('0x' || substr(sha256('val-folds/v1:' || query_id), 1, 16))::UBIGINT % 5)::INT"
#: Windows with folds and one feature of two values, so that a tree of depth 1 can only part them, and SQL can tell its leaves.
B = v.S + f""", b AS (SELECT *, (ce_score > 25)::INT AS hi, {FOLD} AS fold FROM s)"""
ONE_SPLIT = {"rate": 1.0, "depth": 1, "least_rows": 1, "rounds": 1, "patience": 1}


def _halved(s, d):
    return v.windows(s, d).withColumn("hi", (F.col("ce_score") > 25).cast("double"))


# scores are 0 at first: places go by id, every pair is wrong with a chance of 1/2
LAMBDAS = B + """, q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM b WHERE fold IN (2, 3, 4)),
qm AS (SELECT *, sum(gain / log2(i + 1)) OVER (PARTITION BY query_id) AS m FROM q),
pr AS (SELECT a.query_id, a.product_id, a.hi, sign(a.gain - b.gain) * abs((a.gain - b.gain) * (1 / log2(a.r + 1) - 1 / log2(b.r + 1))) / a.m AS d FROM qm a JOIN qm b ON a.query_id = b.query_id AND a.gain <> b.gain),
lv AS (SELECT hi, sum(d / 2) / sum(abs(d) / 4) AS leaf FROM pr GROUP BY hi)"""


@add("l1_newton_leaves", f"WITH {LAMBDAS} SELECT query_id, product_id, round(leaf, 6) AS score FROM b JOIN lv USING (hi)")
def _(s, d):
    """A tree of one split on NDCG gradients: its leaves are sums of first over sums of second derivatives."""
    x = _halved(s, d)
    model = boosting.train(boosting.rows_of(x, [2, 3, 4]), boosting.rows_of(x, [1]), ["hi"], settings=ONE_SPLIT)
    return model.score(x).select(*KEY, F.round("score", 6).alias("score"))


@add("l1_early_stopping", f"""WITH {LAMBDAS}, h AS (SELECT query_id, product_id, gain, leaf FROM b JOIN lv USING (hi) WHERE fold = 1), {v.ndcg_sql('h', 'leaf', 'nv')}
  SELECT 1 AS best_round, 4 AS rounds, round(avg(ndcg), 9) AS best FROM nv""")
def _(s, d):
    """With one split the order is settled in the first round; three more don't better it, and training ends though twenty were allowed."""
    x = _halved(s, d)
    model = boosting.train(boosting.rows_of(x, [2, 3, 4]), boosting.rows_of(x, [1]), ["hi"], settings=ONE_SPLIT | {"rounds": 20, "patience": 3, "rate": 0.5})
    return s.createDataFrame([(model.best_round, len(model.history), round(max(model.history), 9))], "best_round int, rounds int, best double")


@add("l1_m13_multiclass", f"""WITH {B}, t AS (SELECT * FROM b WHERE fold IN (2, 3, 4)), k AS (SELECT unnest(range(4)) AS k), pri AS (SELECT k, greatest(count(*) FILTER (label_code = k), 0.5) / count(*) AS p FROM t, k GROUP BY k),
  lv AS (SELECT hi, k, ln(p) + sum((label_code = k)::INT - p) / sum(p * (1 - p)) AS sc FROM t, pri GROUP BY hi, k, p), z AS (SELECT hi, k, exp(sc) / sum(exp(sc)) OVER (PARTITION BY hi) AS p FROM lv),
  e AS (SELECT hi, sum(p * [0.0::DOUBLE, 0.01, 0.1, 1.0][k + 1]) AS g FROM z GROUP BY hi) SELECT query_id, product_id, round(g, 6) AS score, 1.0::DOUBLE AS total FROM b JOIN e USING (hi)""")
def _(s, d):
    """Softmax boosting, a tree a class a round, judged by expected gain."""
    x = _halved(s, d)
    model = boosting.train(boosting.rows_of(x, [2, 3, 4]), boosting.rows_of(x, [1]), ["hi"], "multiclass", ONE_SPLIT)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return model.score(x).select(*KEY, F.round("score", 6).alias("score"), F.round(total, 9).alias("total"))


SHORT = (("depth", 2), ("least_rows", 20), ("patience", 2), ("rate", 0.3), ("rounds", 3))


@add("l1_l2_out_of_fold", f"WITH {B} SELECT query_id, product_id, fold, false AS in_sample, true AS scored, true AS inside FROM b WHERE fold IN (2, 3, 4)")
def _(s, d):
    """Classes out of fold: every row once, by a model of the other folds, its expected gain between the least and the largest gain."""
    x = _halved(s, d).withColumn("llm_rr", 1.0 / (60 + F.col("llm_rank")))
    valid = boosting.rows_of(x, [1])

    def fit(t):
        return boosting.train(t, valid, ["stage2_score", "ce_score", "llm_rr"], "multiclass", dict(SHORT) | {"rounds": 1}).score

    got = learned.out_of_fold(boosting.rows_of(x, [2, 3, 4]), [2, 3, 4], fit, reserved=(0, 1))
    return got.select(*KEY, "fold", "in_sample", F.col("score").isNotNull().alias("scored"), F.col("score").between(0.0, 1.0).alias("inside"))


@add("l3_l4_combiner", f"WITH {B} SELECT query_id, product_id, fold, fold IN (2, 3, 4) AS in_sample, true AS same FROM b")
def _(s, d):
    """The combiner of five signals trained, saved, loaded and held against its frozen configuration; scores of the loaded model equal those of the trained one."""
    x = v.windows(s, d).withColumn("llm_rr", 1.0 / (60 + F.col("llm_rank")))
    config = boosting.Frozen(settings=SHORT)
    model, path = boosting.train_frozen(x, config), scratch(s)
    boosting.save(s, model, config, path)
    again = boosting.score_frozen(s, path, config, x)
    mine = model.score(x, "mine").select(*KEY, "fold", "mine")
    return again.join(mine, KEY).select(*KEY, "fold", "in_sample", (F.abs(F.col("score") - F.col("mine")) < 1e-12).alias("same"))


@add("l5_selector_routes", f"WITH {v.J} SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'llm' ELSE 'ce' END AS arm FROM j GROUP BY query_id")
def _(s, d):
    """A forest learns which arm serves a query from two features, one of them telling."""
    x = v.judgements(s, d).groupBy("query_id").agg(F.avg("ce_score").alias("mean_ce")).withColumn("third", (F.col("query_id") % 3 == 0).cast("double"))
    x = stored(x.withColumn("arm", F.when(F.col("third") == 1, "llm").otherwise("ce")))
    route = learned.train_selector(x, ["third", "mean_ce"], ["ce", "llm"], trees=5, depth=3)
    return route(x.drop("arm")).select("query_id", "arm")


HALF = "(('0x' || substr(sha256('halves/v1:' || query_id), 1, 16))::UBIGINT % 2)::INT"


@add("l7_window_training", f"""WITH {v.S}, y AS (SELECT *, {HALF} AS half FROM s), a AS (SELECT a.half, count(*) AS n_pairs FROM y a JOIN y b ON a.query_id = b.query_id AND a.gain > b.gain GROUP BY a.half)
  SELECT half, n_pairs, round(ln(2), 9) AS first_loss, true AS fell, true AS better FROM a""")
def _(s, d):
    """RankNet on the labels of one half's windows with a layer of none: ln 2 at first, less at the end, and more pairs in order than the first stage has."""
    out = None
    for half in (0, 1):
        x = stored(ranknet.halves(v.signals(s, d).withColumn("told", F.col("gain") + F.col("ce_score") / 1000)).where(F.col("half") == half))
        model = ranknet.train(x, ["told", "stage2_score"], "gain", epochs=12)
        after = relational.pairwise_accuracy(model.orderings(x).join(x.select(*KEY, "gain"), KEY))
        before = relational.pairwise_accuracy(x.withColumnRenamed("stage2_rank", "position"))
        one = after.select(F.lit(half).alias("half"), "n_pairs", F.round(F.lit(model.losses[0]), 9).alias("first_loss"), F.lit(model.losses[-1] < model.losses[0]).alias("fell"), (F.col("accuracy") > before.select("accuracy").scalar()).alias("better"))
        out = one if out is None else out.unionByName(one)
    return out


@add("l7_g16_cross_fit_orderings", f"WITH {v.S} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY llm_rank) AS position FROM s")
def _(s, d):
    """Windows ordered by a scorer of the other half that learned the teacher's places from 1 / (60 + place): the teacher's own order comes back."""
    x = v.signals(s, d).withColumns({"llm_rr": 1.0 / (60 + F.col("llm_rank")), "teacher": -F.col("llm_rank")})
    return ranknet.cross_fit_orderings(x, lambda w: ranknet.train(w, ["llm_rr"], "teacher", epochs=5))


@add("l8_m4_text_pairs", f"WITH {v.S}, {v.P} SELECT query_id, product_id, len(list_intersect(list_distinct(string_split(lower(query), ' ')), list_distinct(string_split(lower(product_title), ' ')))) / greatest(1, len(list_distinct(string_split(lower(query), ' ')))) AS score FROM s JOIN p USING (product_id)")
def _(s, d):
    """The seam of pair scorers with a scorer of shared words in the model's place."""
    x = v.signals(s, d).join(v.products(s, d).select("product_id", F.col("product_title").alias("text")), "product_id").select(*KEY, "query", "text")

    def scorer():
        words = lambda t: set(t.lower().split(" "))
        return lambda queries, texts: [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in zip(queries, texts)]

    return retrieval.scored_pairs(x, scorer).select(*KEY, "score")
