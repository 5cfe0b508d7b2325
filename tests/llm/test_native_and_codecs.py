import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomrank.llm import bpe, chat, langid, linededup, mix, queries


def test_targets_share_all_and_stop_at_three_times(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 5), (True, "", 100), (False, "d", 0)], "no_source boolean, source string, source_size long")
    got = {(r.no_source, r.source): r.target for r in mix.targets(sizes, (5, 2, 1), 3).collect()}
    assert sum(got.values()) == pytest.approx(1115) and got[False, "a"] == 30 and got[False, "c"] == 15 and got[False, "d"] == 0
    # the rest is shared by the weights of b (second) and of null (fifth): 2 to 2, null stops at 300
    assert got[True, ""] == 300 and got[False, "b"] == pytest.approx(770)


def test_mix_takes_near_targets(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), " ".join("w" * r.randint(1, 40)), 1) for i in range(3000)] + [(i, "b", None, 1) for i in range(3)] + [(7, "a", "x y", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_size int").repartition(5)
    mixed = mix.mix(docs, mix.word_count(F.col("text")))
    got = mixed.collect()
    assert len(got) == len(rows) and max(x.mix_copies for x in got) <= 3
    per = {}
    for x in got:
        t = per.setdefault(x.source, [0, x.mix_target, x.mix_source_size])
        t[0] += x.mix_size * x.mix_copies
    for taken, target, size in per.values():
        assert abs(taken - target) <= 0.02 * target + 60 and target <= 3 * size
    key = lambda m: sorted((x.doc_id, x.source or "", x.mix_size, x.mix_copies) for x in m)
    assert key(mix.mix(docs.repartition(2), mix.word_count(F.col("text"))).collect()) == key(got)
    assert mix.emit(mixed).count() == sum(x.mix_copies for x in got)
    assert mix.mix(docs.where("false"), mix.word_count(F.col("text"))).count() == 0


def test_preference_pairs(spark):
    rows = [(0, 0, "user", "hi", 1), (0, 1, "assistant", "a", 1), (0, 2, "user", "x", 1), (0, 3, "assistant", "good", 1), (1, 0, "user", "hi", 1), (1, 1, "assistant", "a", 1), (1, 2, "user", "y", 1), (1, 3, "assistant", "bad", 1),
            (2, 0, "user", "alone", 1), (4, 0, "user", None, 1), (5, 0, "user", None, 1), (None, 0, "user", "lost", 1), (7, None, None, "t", 1), (7, 1, "assistant", "z", 1), (7, 1, "assistant", "z", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")
    got = {r.pair_id: r for r in chat.preference(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 != 0).collect()}
    assert set(got) == {0, 1, 2, 3}
    r = got[0]
    assert r.n_prompt_turns == 2 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["good<|im_end|>"] and [r.rejected[a:b] for a, b in r.rejected_mask] == ["bad<|im_end|>"]
    assert (got[1].prompt, got[1].rejected, got[1].chosen_mask) == ("", "", []) and "alone" in got[1].chosen
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].chosen == "" and got[3].rejected.count("z<|im_end|>") == 2 and len(got[3].rejected_mask) == 2
    assert chat.preference(turns.where("false"), F.col("conv_id"), F.lit(False)).count() == 0


TRICKY = ["的", "，", "。的", "я", "я ", "\u3000 ", "\xa0 ", "\u2028 ", "\u2003 ", "a", "b", " ", "  ", "\n", "\t", "é", "1", "'s", "日本", "!!", "\x1c", "\x85", " ", "🙂", "word ", "<|endoftext|>"]


def test_bpe_equals_the_library():
    whole = Tokenizer.from_file(bpe.default_path())
    r = random.Random(1)
    own = bpe.Codec(bpe.default_path(), 3, 20_000)  # a cut every 8 bytes and a memo that overflows
    texts = [None, "", "<|endoftext|>", "x" * 5000, " " * 700] + ["".join(r.choice(TRICKY) for _ in range(r.randrange(400))) for _ in range(400)]
    texts = [t for t in texts for _ in range(2)]
    for ids, t in zip(bpe._encoded(own, pa.array(texts)), texts):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids
        assert own.decode(ids) == whole.decode(ids.tolist(), skip_special_tokens=False)
    assert own.reused > 0


@pytest.mark.parametrize("letters,gap", [("abcdefghijklmnop", " "), ("абвгдежзиклмнопр", " "), ("αβγδεζηθικλμνξοπ", " "), ("אבגדהוזחטיכלמנסע", " "), ("的一是不了人我在有他这中大来上国", "，")])
def test_bpe_reuses_chunks_in_every_script(letters, gap):
    """A text, and twice nearly the same one: what goes to the engine for those is little, and the ids are the library's."""
    whole, own, r = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path()), random.Random(7)
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(20000)]
    handed = []
    for turn in range(3):
        text = gap.join(words)
        before = own.handed
        ids = next(bpe._encoded(own, pa.array([text])))
        handed.append(own.handed - before)
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        words[5000 * turn + 17] = words[0] + words[1]
    size = len(text.encode())
    assert handed[0] < 1.6 * size and max(handed[1:]) < 0.1 * size


@pytest.mark.parametrize("chunk_bits", [bpe.CHUNK_BITS, 4])
def test_bpe_of_very_long_runs(chunk_bits):
    whole = Tokenizer.from_file(bpe.default_path())
    own = bpe.Codec(bpe.default_path(), chunk_bits)
    many = 2_000_000 if chunk_bits == bpe.CHUNK_BITS else 20_000
    texts = [c * many for c in (" ", "\n", "a", "!", "\u3000", "7", " \n", "a ", "é")]
    texts += [f"a b{' ' * 5000}c", f"a{chr(10) * 5000}", f"{' ' * 9000}\n é", f"x{chr(0xA0) * 5000}y{' ' * 4096}<|endoftext|>{' ' * 5000} z", f"a{' ' * 4095}b{' ' * 4096}c{' ' * 4097}d"]
    for ids, t in zip(bpe._encoded(own, pa.array(texts)), texts):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t[:20]
        assert own.decode(ids) == t


def test_bpe_frames(spark):
    docs = spark.createDataFrame([(1, "Hello there", 5), (1, "Hello there", 5), (None, None, 6), (2, "", 7)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(docs, bpe.default_path(), check="same"), bpe.default_path(), out="back").collect()
    assert len(got) == 4 and all(r.same and r.back == (r.text or "") for r in got)
    assert bpe.round_trip(docs, bpe.default_path(), ["doc_id"]).where("doc_id IS NULL").first().ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(docs.where("false"), bpe.default_path()).count() == 0


def test_language_id(spark):
    r = random.Random(2)
    words = {"xx": ["foo", "bar", "baz", "qux"], "yy": ["lorem", "ipsum", "dolor", "amet"], "zz": ["ζητα", "ητα", "θητα"]}
    rows = [(i, " ".join(r.choice(words[g]) for _ in range(r.randint(3, 30))), g if i % 9 else None, 0.5) for i in range(400) for g in [r.choice(list(words))]]
    rows += [(1000, None, "xx", 0.0), (1001, "", "yy", 0.0), (1002, "123 !? ²½", "xx", 0.0), (1, rows[1][1], rows[1][2], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    model = langid.train(docs, sample=100)
    assert model.langs == ["xx", "yy", "zz"] and (model.weights == 0).mean() > 0.9
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.lang_score <= 1 for x in got)
    truth = lambda t: next(g for g, w in words.items() if t.split()[0] in w)
    assert all(x.lang_pred == truth(x.text) and x.lang_score > 0.5 for x in got if x.doc_id < 1000)
    assert all(x.lang_pred == "und" and x.lang_score == 0 for x in got if x.doc_id >= 1000)
    empty = langid.train(docs.where("false"))
    assert langid.identify(docs, empty).where("lang_pred <> 'und'").count() == 0


def test_languages_are_learned_whatever_the_ids(spark):
    r = random.Random(4)
    kinds = {"en": [f"e{i}" for i in range(30)], "de": [f"d{i}" for i in range(30)], "fr": [f"f{i}" for i in range(30)]}
    text = lambda g: " ".join(r.choice(kinds[g]) for _ in range(12))
    rows = [(None, text("en"), "en") for _ in range(900)] + [(0, text("de"), "de") for _ in range(900)] + [(i, text("fr"), "fr") for i in range(900)]
    rows += [(0, "the same once more", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.train(docs, sample=50)
    assert model.langs == ["de", "en", "fr"]
    assert all(model.predict(text(g))[0] == g for g in kinds for _ in range(20))


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    docs = spark.createDataFrame([(i, "words here", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(docs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy_of_the_query(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op9_langid(spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").join(truth, "doc_id").where("lang IS NOT NULL").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 3)) * 8
    y = np.array([rng.choice(3, p=langid.softmax(row / 4)) for row in z])
    assert langid.temperature(z, y) == pytest.approx(4, rel=0.25)
    assert langid.temperature(z[:0], y[:0]) == 1.0


def brute_lines(docs, run):
    seqs = {k: [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")] for k, t in docs.items()}
    first, gone = {}, {k: set() for k in docs}
    for k in sorted(docs):
        for p in range(len(seqs[k]) - run + 1):
            key = tuple(x for _, x in seqs[k][p : p + run])
            if first.setdefault(key, (k, p)) != (k, p):
                gone[k].update(i for i, _ in seqs[k][p : p + run])
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in docs.items()}


def test_fingerprints_are_the_selected_minima_only():
    rng = np.random.default_rng(5)
    h, doc = rng.integers(0, 50, 4000).astype(np.uint64), np.sort(rng.integers(0, 300, 4000))
    for run in (1, 2, 4, 9):
        chosen, ends, at, _ = linededup.fingerprints(doc, h, run)
        windows = {int(a): [int(x) for x in h[a : a + run]] for a in range(4000 - run + 1) if doc[a] == doc[a + run - 1]}
        want = {a: a + w.index(min(w)) for a, w in windows.items()}
        assert sorted(set(want.values())) == chosen.tolist() and at.tolist() == sorted(windows)
        assert {int(a): int(c) for c, x, y in zip(chosen, ends, ends[1:]) for a in at[x:y]} == want
        assert run == 1 or len(chosen) < len(at)


def test_lines_against_brute_force(spark):
    r = random.Random(9)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "hot"]
    docs = {i: "\n".join((" " if r.random() < 0.1 else "") + r.choice(pool) for _ in range(r.randint(0, 25))) for i in range(60)} | {60: None, 61: "", 62: "hot\nhot\nhot\nhot"}
    frame = spark.createDataFrame([(k, t, k) for k, t in docs.items()], "doc_id long, text string, n_lines long").repartition(3)
    for run in (1, 2, 4):
        got = {x.doc_id: x.text for x in linededup.dedup_lines(frame, run).collect()}
        assert got == brute_lines(docs, run)
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\na\nb")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text, x.n_removed) for x in linededup.dedup_lines(twice, 2, counts=True).collect())
    assert got == [(0, "q\na\nb", 0), (1, "c", 2), (1, "c", 2)]
    assert linededup.dedup_lines(frame.where("false")).count() == 0
