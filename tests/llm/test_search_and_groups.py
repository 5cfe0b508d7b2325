import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomrank.llm import ann, blocks, components, maxscore, minhash


def vectors(spark, n=700, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    v = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, d))
    v[100:140] = v[100]  # ties
    rows = [(i, v[i].astype(np.float32).tolist(), "x") for i in range(n)]
    rows += [(n, None, "x"), (n + 1, [float("nan")] * d, "x"), (n + 2, [1.0, None] + [0.0] * (d - 2), "x"), (n + 3, [0.0] * d, "x"), (n + 4, [float("inf")] * d, "x"), (n + 5, [], "x"), (None, [1.0] * d, "x"), (n + 6, [1.0] * (d - 1), "x"), (3, rows[3][1], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string"), np.array([r[1] for r in rows[:n]], np.float64)


def best(score, ids, q, k=5):
    s = score.copy()
    at = np.lexsort((ids, -s))
    return [(int(ids[i]), s[i]) for i in at if ids[i] != q][:k]


@pytest.mark.parametrize("shard", [16384, 100])
def test_maxscore_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(blocks, "SHARD_ROWS", shard)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 9)
    monkeypatch.setattr(maxscore, "BLOCK", 32)
    frame, v = vectors(spark)
    got = {}
    for r in maxscore.top_k(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * v)
    ids = np.concatenate([np.arange(len(v)), [len(v) + 3, 3]])
    whole = np.concatenate([whole, np.zeros((1, v.shape[1])), whole[3:4]])
    for q in range(0, 700, 20):
        want = best(whole @ whole[q], ids, q)
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, int(s)) for i, s in want]


@pytest.mark.parametrize("size", [2.0**28, 2.0**29, 2.0**29 - 1])
def test_maxscore_is_exact_beyond_what_doubles_hold(monkeypatch, size):
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = np.floor(rng.uniform(-size, size, (300, 8)))
    rows[1::3] = rows[:-1:3]
    rows[1::3, 0] += 1  # scores that differ by one product
    q, r, s = maxscore.maxscore(np.arange(300), rows, np.array([400, 401]), np.array([np.append(1.0, rows[0, 1:]), rows[5]]), 7)
    for i, query in enumerate(([1, *map(int, rows[0, 1:])], [*map(int, rows[5])])):
        want = sorted((-sum(int(a) * b for a, b in zip(row, query)), n) for n, row in enumerate(rows))[:7]
        got = sorted((-int(x), int(n)) for x, n, j in zip(s, r, q) if j == i)
        assert got == want


def test_scores_beyond_a_long_stop_there(spark):
    docs = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 1.0]), (3, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in maxscore.top_k(docs, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_repeated_rows_are_candidates_each_and_travel_at_most_k_times(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD_ROWS", 8)
    docs = spark.createDataFrame([(0, [1.0, 0.0])] + [(1, [1.0, 0.5])] * 40 + [(1, [1.0, 0.25])] * 2, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in maxscore.top_k(docs, F.col("id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 65536), (2, 1, 65536), (3, 1, 65536)]
    near = [(r.rank, r.vec_id, round(r.score, 3)) for r in ann.nearest_neighbours(docs, F.col("id") == 0, k=3).orderBy("rank").collect()]
    assert near == [(1, 1, 0.97), (2, 1, 0.97), (3, 1, 0.894)]


def test_ann_of_very_large_and_tiny_components(spark):
    docs = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e250, 1e249]), (3, [-1e-300, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 6)) for r in ann.nearest_neighbours(docs, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(2, 0.995037), (1, 0.707107), (3, -1.0)]


def test_ann_recall_and_scores(spark):
    frame, v = vectors(spark)
    got = {}
    for r in ann.nearest_neighbours(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.append(np.arange(len(v)), 3)
    w = np.concatenate([v, v[3:4]])
    norm = np.sqrt((w * w).sum(axis=1))
    hit = total = 0
    for q in range(0, 700, 20):
        s = (w * w[q]).sum(axis=1) / (norm * norm[q])
        want = best(s, ids, q)
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and all(x[2] == pytest.approx(s[x[1]], abs=1e-12) for x in mine)
        hit += len({x[1] for x in mine} & {i for i, _ in want})
        total += 5
    assert hit / total >= 0.9
    assert ann.nearest_neighbours(frame.where("false"), F.col("id") == 0).count() == 0
    few = ann.nearest_neighbours(frame.where("vec_id IN (0, 1)"), F.col("id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = ann.Codes(x)
    codes.with_centre = x @ codes.centre
    estimate, off = codes.bounds(x[:50])
    assert (np.abs(estimate - x[:50] @ x.T) <= off).mean() > 0.995 and codes.bits.shape == (2000, 8)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 199)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(pairs + [(5, 5)], "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[102] == 100 and got[200] == 199 and {got[300 + i] for i in range(30)} == {300}


def brute(texts, k, part, whole):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_texts(seed=7):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts = {}
    for _ in range(12):
        base = [word() for _ in range(r.choice([1, 2, 4, 8, 30, 120, 400]))]
        for _ in range(r.randint(1, 14)):
            x = [word() if r.random() < r.choice([0.0, 0.005, 0.02, 0.04]) else w for w in base]
            if r.random() < 0.3:
                x[0] = x[0].upper()
            texts[len(texts)] = r.choice([" ", "\n", "  "]).join(x)
    for t in (None, "", " \n\t", "Ä", "ä", "A", "a"):
        texts[len(texts)] = t
    return texts


@pytest.mark.parametrize("k, part, block", [(3, 85, 512), (5, 80, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, part, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, cls string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k, part).collect()}
    assert got == brute(texts, k, part, 100)


@pytest.mark.parametrize("k, part, words", [(5, 80, 9), (3, 85, 9), (5, 80, 14)])
def test_no_pair_of_short_texts_is_missed(spark, k, part, words):
    r = random.Random(words)
    texts = {}
    for i in range(0, 3000, 2):
        w = [f"w{r.randrange(10**9)}" for _ in range(words)]
        texts[i], texts[i + 1] = " ".join(w), " ".join(w[:-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.id: x.component_id for x in minhash.near_duplicates(docs, k, part).collect()}
    assert got == {i: i - i % 2 for i in texts}


SMALL = [(c, one, two) for one, two in ((0, 1), (1, 1), (0, 2), (1, 2), (2, 2), (0, 3), (2, 3), (0, 5)) for c in range(1, 41 - max(one, two))]


@pytest.mark.parametrize("least", [0.85, 0.8])
def test_small_sets_share_a_band_and_are_never_ruled_out(least):
    rng = np.random.default_rng(4)
    at_threshold = [(c, one, two) for c, one, two in SMALL if least <= c / (c + one + two) + 1e-9 < least + 0.06]
    for common, one, two in at_threshold:
        x = rng.integers(0, 2**64, (2000, common + one + two), dtype=np.uint64)
        a, b = np.sort(x[:, : common + one], axis=1), np.sort(np.concatenate([x[:, :common], x[:, common + one :]], axis=1), axis=1)
        ra, rb = (minhash.registers(y.reshape(-1), np.arange(2001) * y.shape[1]) for y in (a, b))
        assert (minhash.bands(ra) == minhash.bands(rb)).any(axis=1).all(), (common, one, two)
        assert minhash.possible(ra, rb, np.full(2000, common + one), np.full(2000, common + two), common / (common + one + two))[0].all()


def test_a_family_of_strays_is_compared_in_full_within_bounded_rounds(spark, monkeypatch):
    """Copies that stray from one original: most pairs of copies lie under the threshold, some above."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "FIRST", 1)
    monkeypatch.setattr(minhash, "GROWTH", 2)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(60):
        x = list(base)
        for _ in range(r.choice([3, 5, 8])):
            x[r.randrange(150)] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(x)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute(texts, 3, 85, 100)


@pytest.mark.parametrize("blocks", [1, 2])
def test_small_cells_are_looked_at_together(monkeypatch, blocks):
    rng = np.random.default_rng(4)
    texts = list({" ".join(f"w{family}x{i if rng.random() > 0.04 else rng.integers(1000, 9999)}" for i in range(60)) for family in range(150) for _ in range(3)})
    s, off = minhash.sets(pa.array(texts), 3)
    cls, regs, n = minhash.classes(s, off), minhash.registers(s, off), np.diff(off)
    keys = minhash.bands(regs)
    rows = sorted((int(key.view(np.int64)), i) for i in range(len(texts)) for key in keys[i])
    one = lambda values, kind: pa.array(values, kind)
    at = [i for _, i in rows]
    side = [i % blocks for i in at]
    table = pa.table({"band": one([b for b, _ in rows], pa.int64()), "i": one([0] * len(rows), pa.int32()), "j": one([blocks - 1] * len(rows), pa.int32()), "side": one(side, pa.int32()),
                      "root": one([cls[i] for i in at], pa.binary()), "n": one(n[at], pa.int64()), "cls": one([cls[i] for i in at], pa.binary()), "regs": one([regs[i].tobytes() for i in at], pa.binary())})
    calls, made = [], minhash.bands
    monkeypatch.setattr(minhash, "bands", lambda x: calls.append(len(x)) or made(x))
    found = [(b, frozenset((x, y))) for out in minhash._pairs_of_cells(table.to_batches(max_chunksize=500), 50, 100, 99) for b, x, y in zip(*(out.column(c).to_pylist() for c in range(3)))]
    members = {}
    for b, i in rows:
        members.setdefault(b, []).append(i)
    want, seen = set(), set()
    for j in range(minhash.BANDS):
        for b in np.unique(keys[:, j].view(np.int64)):
            for p, q in ((p, q) for p in members[int(b)] for q in members[int(b)] if p < q and (blocks == 1 or p % 2 != q % 2) and (p, q) not in seen):
                seen.add((p, q))
                if 100 * min(n[p], n[q]) >= 50 * max(n[p], n[q]) and minhash.possible(regs[[p]], regs[[q]], n[[p]], n[[q]], 0.5)[0][0]:
                    want.add((int(b), frozenset((cls[p], cls[q]))))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    assert len(calls) < len(members) / 10  # once a cell before


def test_many_equal_rows_give_as_many_rows(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, t)] * 300 + [(2, t + " more")] * 300 + [(None, t + " else")] * 300, "doc_id long, text string")
    got = minhash.near_duplicates(docs).groupBy("id", "component_id").count().collect()
    assert sorted(((x.id or 0), x.component_id, x["count"]) for x in got) == [(0, None, 300), (1, None, 300), (2, None, 300)]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (7, "other words here only")], "doc_id long, text string")
    got = sorted((r.id or 0, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, None), (5, None), (5, None), (7, 7)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * share)
        x, y = np.sort(base[:2000]), np.sort(np.concatenate([base[:n], base[2000 : 4000 - n]]))
        j = n / (4000 - n)
        r = minhash.registers(np.concatenate([x, y]), np.array([0, 2000, 4000]))
        ok, got = minhash.possible(r[:1], r[1:], np.array([2000]), np.array([2000]), j)
        assert ok[0] and abs(got[0] - j) < 5 * np.sqrt(j * (1 - j) / 256)
