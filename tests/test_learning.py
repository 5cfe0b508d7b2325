"""Boosting with Newton leaves and early stopping, frozen models, and RankNet on windows, against plain numpy."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomrank.operators import boosting, metrics, ranknet, relational

GAINS = [0.0, 0.01, 0.1, 1.0]
FEW = {"rate": 0.5, "depth": 2, "least_rows": 3, "rounds": 3, "patience": 2}


@pytest.fixture(scope="module")
def frame(spark):
    """One telling feature, one of noise, with gaps."""
    r = np.random.default_rng(5)
    rows = []
    for q in range(60):
        for i in range(8):
            code = int(r.choice(4, p=[0.2, 0.1, 0.3, 0.4]))
            rows.append((q, f"p{i}", code, GAINS[code], float(code + r.normal(0, 0.3)) if i else None, float(r.normal()), q % 5))
    return spark.createDataFrame(rows, "query_id long, product_id string, label_code int, gain double, signal double, noise double, fold int").cache()


def test_gradients_are_derivatives(spark):
    """Against finite differences of the pairwise loss with the swaps' weights held."""
    rows = [(1, "a", 1.0, 0.3), (1, "b", 0.1, 0.9), (1, "c", 0.0, -0.2), (1, "d", 0.1, 0.3), (2, "a", 0.1, 0.0), (2, "b", 0.1, 1.0)]
    got = {(x.query_id, x.product_id): (x.g, x.h) for x in boosting.lambda_gradients(spark.createDataFrame(rows, "query_id long, product_id string, gain double, score double")).collect()}
    assert {q for q, _ in got} == {1}  # a query of one gain has no pair
    one = rows[:4]
    place = {p: i + 1 for i, (_, p, _, _) in enumerate(sorted(one, key=lambda x: (-x[3], x[1])))}
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((x[2] for x in one), reverse=True)))
    swap = lambda a, b: abs((a[2] - b[2]) * (1 / math.log2(place[a[1]] + 1) - 1 / math.log2(place[b[1]] + 1))) / ideal

    def loss(s):
        return sum(swap(a, b) * math.log1p(math.exp(s[b[1]] - s[a[1]])) for a in one for b in one if a[2] > b[2])

    at, e = {x[1]: x[3] for x in one}, 1e-4
    for p in at:
        up, down = loss(at | {p: at[p] + e}), loss(at | {p: at[p] - e})
        assert got[1, p] == pytest.approx((-(up - down) / (2 * e), (up - 2 * loss(at) + down) / e**2), rel=1e-3, abs=1e-6)


def test_leaves_are_newton_steps(frame):
    """One tree: its leaves, found again by their values, are sum of g over sum of h."""
    train, valid = frame.where("fold > 1"), frame.where("fold = 1")
    model = boosting.train(train, valid, ["signal", "noise"], settings=FEW | {"rate": 1.0, "rounds": 1})
    scored = model.score(train).join(boosting.lambda_gradients(train.withColumn("score", F.lit(0.0))), ["query_id", "product_id"])
    leaves = scored.groupBy(F.round("score", 9).alias("s")).agg((F.sum("g") / F.sum("h")).alias("step")).collect()
    assert len(leaves) > 2 and all(x.s == pytest.approx(x.step, abs=1e-6) for x in leaves)


@pytest.mark.parametrize("objective", boosting.OBJECTIVES)
def test_objectives_learn_the_telling_feature(frame, objective):
    settings = FEW | ({"rounds": 1} if objective == "multiclass" else {})
    model = boosting.train(frame.where("fold > 1"), frame.where("fold = 1"), ["signal", "noise"], objective, settings)
    got = model.score(frame.where("fold = 0"))
    assert got.count() == frame.where("fold = 0").count() and got.where("score IS NULL OR isnan(score)").count() == 0
    ndcg = lambda x, s: metrics.ndcg_per_query(x, s).agg(F.avg("ndcg")).first()[0]
    assert ndcg(got, "score") > ndcg(got, "noise") + 0.1
    assert not hasattr(model, "ndcg")
    if objective == "multiclass":
        assert got.where("score < 0 OR score > 1").count() == 0
        assert got.select(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p) - 1))).first()[0] < 1e-9


def test_training_stops_early_and_uses_the_best_round(spark):
    rows = [(q, f"p{i}", 0, float(i == 0), float(i), q) for q in range(4) for i in range(4)]
    x = spark.createDataFrame(rows, "query_id long, product_id string, label_code int, gain double, signal double, fold long")
    against = x.withColumn("signal", -F.col("signal"))  # what training learns is wrong there: the first round is the best of bad ones
    model = boosting.train(x, against, ["signal"], settings=FEW | {"rounds": 9, "patience": 2, "least_rows": 1})
    assert len(model.history) == 3 and model.best_round == 1 and len(model.trees) == 3
    assert model.raw(x).select("_s0").distinct().count() == boosting._grown(boosting.assembled(x, ["signal"]).withColumn("_s0", F.lit(0.0)), model.trees[0], 0.5).select("_s0").distinct().count()
    nothing = boosting.train(x.withColumn("gain", F.lit(1.0)), against, ["signal"], settings=FEW)
    assert nothing.best_round == 0 and nothing.score(x).where("score <> 0").count() == 0


def test_bad_settings_are_refused(frame):
    a, b = frame.where("fold > 1"), frame.where("fold = 1")
    for args in ((a, b, ["signal"], "lambdarank", {"label_gain": [0, 1, 3, 7]}), (a, b, ["signal"], "lambdarank", {"leaves": 3}), (a, b, ["signal"], "pairwise"), (a.where("false"), b, ["signal"]), (a, b.where("false"), ["signal"])):
        with pytest.raises(ValueError):
            boosting.train(*args)
    assert boosting.probabilities([F.lit(800.0), F.lit(0.0)]) is not None
    assert frame.select(F.get(boosting.probabilities([F.lit(800.0), F.lit(0.0)]), F.lit(0)).alias("p")).first().p == 1.0


def test_frozen_models_refuse_departures(spark, frame, tmp_path):
    config = boosting.Frozen(features=("signal", "noise"), settings=tuple(sorted((FEW | {"rounds": 2}).items())))
    model = boosting.train_frozen(frame, config)
    path = str(tmp_path / "model")
    boosting.save(spark, model, config, path)
    got = boosting.score_frozen(spark, path, config, frame)
    want = {(r.query_id, r.product_id): r.score for r in model.score(frame).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(want[r.query_id, r.product_id] == r.score and r.in_sample == (r.query_id % 5 in (2, 3, 4)) for r in rows)
    assert boosting.score_frozen(spark, path, config, frame.drop("fold")).where("in_sample").count() == 0
    assert boosting.score_frozen(spark, path, config, frame, report_fold=0).count() == frame.where("fold = 0").count()
    for other in (boosting.Frozen(("noise", "signal"), config.objective, config.settings), config.with_settings(rate=0.1), boosting.Frozen(config.features, "regression", config.settings), boosting.Frozen(config.features, config.objective, config.settings, (3, 4))):
        with pytest.raises(ValueError):
            boosting.score_frozen(spark, path, other, frame)
    for fold in (1, 2):
        with pytest.raises(ValueError):
            boosting.score_frozen(spark, path, config, frame, report_fold=fold)
    with pytest.raises(ValueError):
        boosting.score_frozen(spark, path, config, frame.drop("noise"))
    for bad in (boosting.Frozen(config.features, stop_fold=2), boosting.Frozen(config.features, fit_folds=(2, 9))):
        with pytest.raises(ValueError):
            boosting.train_frozen(frame, bad)
    record = json.loads(spark.read.text(f"{path}/record").first()[0])
    spark.createDataFrame([(json.dumps(record | {"digest": "0"}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")
    with pytest.raises(ValueError):
        boosting.score_frozen(spark, path, config, frame)


@pytest.mark.parametrize("hidden", [0, 3])
def test_window_gradients_are_derivatives(hidden):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(6, 2)), np.array([1.0, 0.1, 0.1, 0.0, 1.0, 0.01])
    w = r.normal(size=2 * hidden + 2 * hidden if hidden else 2)
    loss, g, pairs = ranknet.window_loss(x, y, w, hidden)
    score = (lambda w: np.tanh(x @ w[: 2 * hidden].reshape(2, hidden) + w[2 * hidden : 3 * hidden]) @ w[3 * hidden :]) if hidden else (lambda w: x @ w)
    plain = lambda w: sum(math.log1p(math.exp(score(w)[j] - score(w)[i])) for i in range(6) for j in range(6) if y[i] > y[j])
    assert pairs == sum(a > b for a in y for b in y) and loss == pytest.approx(plain(w))
    for k in range(len(w)):
        e = np.eye(len(w))[k] * 1e-5
        assert g[k] == pytest.approx((plain(w + e) - plain(w - e)) / 2e-5, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("hidden", [0, 4])
def test_ranknet_orders_windows_better(frame, hidden):
    x = frame.withColumn("stage2_rank", F.row_number().over(ranknet.by_query(F.col("noise").desc())))
    model = ranknet.train(x, ["signal", "noise"], "gain", hidden, epochs=15)
    assert model.losses[-1] < 0.9 * model.losses[0] and (hidden or model.losses[0] == pytest.approx(math.log(2)))
    after = relational.pairwise_accuracy(model.orderings(x).join(x.select("query_id", "product_id", "gain"), ["query_id", "product_id"])).first()
    before = relational.pairwise_accuracy(x.withColumnRenamed("stage2_rank", "position")).first()
    assert after.accuracy > before.accuracy + 0.2 and after.n_pairs == before.n_pairs
    with pytest.raises(ValueError):
        ranknet.train(x.withColumn("gain", F.lit(1.0)), ["signal"], "gain")


def test_cross_fit_never_scores_what_it_saw(spark, frame):
    seen = []

    def fit(windows):
        seen.append({r.query_id for r in windows.select("query_id").distinct().collect()})
        return ranknet.train(windows, ["signal"], "gain", epochs=2)

    got = ranknet.cross_fit_orderings(frame, fit)
    assert got.count() == frame.count() == got.select("query_id", "product_id").distinct().count()
    assert seen[0] & seen[1] == set() and len(seen[0] | seen[1]) == 60
    dealt = spark.createDataFrame([(q, q % 2) for q in range(60)], "query_id long, half int")
    for bad in (dealt.where("query_id > 0"), dealt.union(spark.createDataFrame([(3, 0)], dealt.schema))):
        with pytest.raises(PySparkException):
            ranknet.cross_fit_orderings(frame, fit, bad).collect()


def test_gradients_join_nothing(spark, frame):
    plan = boosting.lambda_gradients(frame.withColumn("score", F.col("noise")), keep=["signal"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_gradients_in_chunks(spark, monkeypatch):
    """Lists longer and shorter than a chunk, tied, missing and equal gains and scores, against plain loops."""
    r = np.random.default_rng(3)
    rows = [(q, f"p{i}", [None, 0.0, 0.01, 0.1, 1.0][r.integers(5)] if q else 0.5, float(r.integers(-2, 3)), i) for q in range(7) for i in range(2 + 3 * q)]
    frame = spark.createDataFrame(rows, "query_id long, product_id string, gain double, score double, n int")
    got = {(x.query_id, x.product_id): (x.g, x.h, x.n) for x in boosting.lambda_gradients(frame, keep=["n"]).collect()}
    want = {}
    for q in range(7):
        one = [x for x in rows if x[0] == q]
        share = {x[1]: 1 / math.log2(i + 2) for i, x in enumerate(sorted(one, key=lambda x: (-x[3], x[1])))}
        best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((x[2] for x in one if x[2] is not None), reverse=True)))
        for a in one:
            g, h, pairs = 0.0, 0.0, 0
            for b in one:
                if a[2] is not None and b[2] is not None and a[2] != b[2]:
                    swap, sign = abs((a[2] - b[2]) * (share[a[1]] - share[b[1]])) / best, 1 if a[2] > b[2] else -1
                    wrong = 1 / (1 + math.exp(sign * (a[3] - b[3])))
                    g, h, pairs = g + sign * swap * wrong, h + swap * wrong * (1 - wrong), pairs + 1
            if pairs:
                want[q, a[1]] = (g, h, a[4])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    lists = [pa.array([[x[c] for x in rows if x[0] == q] for q in range(7)]) for c in (1, 3, 2)]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(boosting, "PAIRS", size)
        each = boosting._list_derivatives(*lists).flatten().to_pylist()
        assert {(x[0], x[1]): (y["g"], y["h"], x[4]) for x, y in zip(rows, each) if y} == got


def test_pairs_are_met_once_a_round(spark, frame, monkeypatch):
    seen, met = spark.sparkContext.accumulator(0), boosting.lambda_gradients
    count = F.udf(lambda g: seen.add(1) or True, "boolean")
    monkeypatch.setattr(boosting, "lambda_gradients", lambda *a, **k: met(*a, **k).where(count("g")))
    train = frame.where("fold > 1")
    rows = met(train.withColumn("score", F.lit(0.0))).count()
    boosting.train(train, frame.where("fold = 1"), ["signal"], settings=FEW | {"rounds": 1})
    assert seen.value == rows


@pytest.mark.parametrize("objective", boosting.OBJECTIVES)
def test_validation_is_the_same_in_any_order(spark, objective):
    """Over other tasks and orders of the same rows, to the last bit."""
    r = np.random.default_rng(11)
    rows = [(q, f"p{i}", int(c), GAINS[c] * (1e15 if objective == "regression" else 1), *map(float, r.normal(size=4))) for q in range(3000) for i, c in enumerate(r.integers(0, 4, 3))]
    kind = "query_id long, product_id string, label_code int, gain double, _s0 double, _s1 double, _s2 double, _s3 double"
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = set()
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 2, 3, 5, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            some = [rows[i] for i in np.random.default_rng(parts).permutation(len(rows))]
            got.add(boosting._validation(spark.createDataFrame(some, kind).repartition(parts), objective, 4))
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert len(got) == 1
