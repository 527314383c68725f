"""Decontamination, toxicity, language, quality and language-model scores."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import lower, odd_texts, table
from pyspark.sql import functions as F

from reelgrid.llm import language as L
from reelgrid.llm import lm_score, toxicity
from reelgrid.llm.decontaminate import contamination
from reelgrid.llm.resample import importance_sample
from reelgrid.llm.store import Workspace

SF = "/root/testdata/sf0.01"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brute_contamination(docs, items, length):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = []
    for item, t in items:
        w = words(t)
        wins += [(item, tuple(w[i : i + length])) for i in range(max(len(w) - length + 1, 1))] if w else []
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    if item is not None:
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 23, 200])
def test_contamination_equals_brute_force(spark, block_bytes):
    r = random.Random(3)
    vocabulary = "a b c d e the of é".split()
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 5, 5, 8, 1, 0, 12, 4, 4])]
    items += [(11, None), (11, items[0][1]), (None, items[1][1]), (12, "never seen anywhere at all")]
    docs = [x for x in odd_texts() if x[0] not in (9, 10)] + [(100 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for i in range(60)]
    docs += [(300, items[6][1].upper().replace(" ", " -- ")), (301, items[6][1]), (301, items[6][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = contamination(table(spark, docs), bench, length=4, block_bytes=block_bytes).drop("n_near").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_contamination(docs, items, 4)))


def test_proximity_finds_a_changed_passage(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = table(spark, [(1, "so alpha beta or gamma delta epsilon zeta"), (2, item), (3, "zeta epsilon delta gamma beta alpha")])
    got = {r.doc_id: (r.n_hit, r.n_near > 0) for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), length=6, slop=1).collect()}
    assert got == {1: (0, True), 2: (6, True), 3: (0, False)}


def test_contamination_of_empty_tables(spark):
    docs, items = table(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:6] for r in contamination(docs, items).collect()] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def held(i, parts, which):
    return i is not None and zlib.crc32(str(i).encode()) % parts == which


def test_machine_learns_an_interaction():
    """Toxic only with both words: a sum of single weights can't tell."""
    r = np.random.default_rng(1)
    both = r.integers(0, 2, (2000, 2))
    rows = [np.flatnonzero(np.concatenate([b, r.integers(0, 2, 20)])) for b in both]
    label = (both[:, 0] == both[:, 1]).astype(float) * both[:, 0]
    m = toxicity.train(rows, label, bits=6, factors=4, epochs=30)
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    out = m.raw(np.concatenate(rows), ptr)
    assert (out[label == 1].min() > out[label == 0]).mean() > 0.99
    pair = m.factor[0] @ m.factor[1]
    assert pair > 0.3
    brute = [m.bias + m.weight[x].sum() + sum(m.factor[a] @ m.factor[b] for k, a in enumerate(x) for b in x[:k]) for x in rows[:50]]
    assert np.allclose(out[:50], brute)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    clean, toxic = got[got["toxic"] == 0], got[got["toxic"] == 1]
    assert clean["predicted"].mean() < 0.01
    assert toxic["predicted"].mean() > 0.7


def test_toxicity_of_odd_tables(spark):
    docs = table(spark, odd_texts())
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_language_on_held_out_documents(spark):
    got = L.identify(read(spark, "documents")).join(read(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_language_backs_off_and_stands_odd_tables(spark):
    rows = [(i, "the water house") for i in range(20)] + [(100 + i, "das wasser haus") for i in range(20)]
    docs = table(spark, rows[:20]).unionByName(table(spark, rows[20:], lang="de")).unionByName(table(spark, [(999, "x y"), *odd_texts()], lang=None))
    docs = docs.unionByName(table(spark, [(500, "wasserhaus"), (501, "waterhouse"), (502, "123 456"), (503, None), (None, "the")], lang=None))
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert (got[500].lang_pred, got[501].lang_pred) == ("de", "en")
    assert {got[i].lang_pred for i in (1, 2, 3, 502, 503)} == {"und"} and got[502].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0) for r in got.values())
    assert {r.lang_pred for r in L.identify(table(spark, odd_texts(), lang=None)).collect()} == {"und"}
    assert L.identify(docs.limit(0)).collect() == []


def test_backing_off_by_hand():
    model = L.Model(["a", "b"], {"known": 0}, np.array([[1.0, 2.0]]), {"abcd": 0, "bcd\x03": 1, "z": 2}, np.array([[0.0, 4.0], [2.0, 0.0], [7.0, 7.0]]))
    assert model.vector("known").tolist() == [1, 2]
    assert model.vector("abcd").tolist() == [1, 2]
    assert model.vector("qz").tolist() == [7, 7]
    assert model.vector("qq").tolist() == [0, 0]


def test_importance_sample(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = importance_sample(docs, labels.where("quality = 1"), fraction=0.8)
    rows = got.collect()
    assert sum(r.kept for r in rows) == 800 and len(rows) == 1000
    assert sorted(map(tuple, rows)) == sorted(map(tuple, importance_sample(docs.repartition(3), labels.where("quality = 1"), fraction=0.8).collect()))
    by = {r.quality: r.kept for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1] > by[0] + 0.2


def test_importance_sample_of_odd_tables(spark):
    docs = table(spark, odd_texts())
    got = importance_sample(docs, spark.createDataFrame([(4,), (None,)], "doc_id long"), fraction=0.5).collect()
    assert len(got) == len(odd_texts())
    assert [r.log_weight for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert all(r.log_weight == 0 for r in importance_sample(docs, spark.createDataFrame([], "doc_id long")).collect())
    assert importance_sample(docs.limit(0), spark.createDataFrame([(4,)], "doc_id long")).collect() == []


def test_log_weights_equal_brute_force(spark):
    docs = [(1, "a b a"), (2, "b c"), (3, "a")]
    got = {r.doc_id: r for r in importance_sample(table(spark, docs), spark.createDataFrame([(1,)], "doc_id long"), buckets=100_003).collect()}
    grams = lambda t: (w := t.split()) + list(zip(w, w[1:]))
    raw, own = {}, {}
    for i, t in docs:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            own[g] = own.get(g, 0) + (i == 1)
    ratio = lambda g: np.log((own[g] + 1) / (sum(own.values()) + 100_003)) - np.log((raw[g] + 1) / (sum(raw.values()) + 100_003))
    for i, t in docs:
        assert got[i].n_features == len(grams(t))
        assert abs(got[i].log_weight - sum(map(ratio, grams(t)))) < 1e-9


def test_cross_entropy_difference(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    got = lm_score.cross_entropy_difference(docs, labels.where("quality = 1 and doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert np.allclose(got["score"], got["background_loss"] - got["target_loss"])
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.6
    odd = lm_score.cross_entropy_difference(table(spark, odd_texts()), spark.createDataFrame([], "doc_id long")).collect()
    assert len(odd) == len(odd_texts()) and [r.score for r in odd if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert lm_score.cross_entropy_difference(table(spark, []), spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def test_bigram_losses_equal_brute_force(spark):
    """All words and all target texts count: also with more words than any fixed table of classes."""
    r = random.Random(4)
    docs = [(i, " ".join(f"w{r.randrange(3000)}" if r.random() < 0.7 else "the" for _ in range(r.randrange(60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (8, "another text of number eight"), (None, "the w1"), (400, None), (401, "a b " * 700)]
    wanted = {i for i in range(0, 402, 3)}
    got = lm_score.cross_entropy_difference(table(spark, docs), spark.createDataFrame([(i,) for i in wanted] + [(None,), (3,)], "doc_id long")).collect()
    steps = lambda t: list(zip(["<", *(w := lower(t).split())], [*w, ">"])) if lower(t).split() else []
    want = []
    models = []
    for own in (True, False):
        pair, word, ctx = {}, {}, {}
        for i, t in docs:
            for v, w in steps(t) if not own or i in wanted else []:
                pair[v, w], word[w], ctx[v] = pair.get((v, w), 0) + 1, word.get(w, 0) + 1, ctx.get(v, 0) + 1
        models.append((pair, word, ctx))
    size = len(models[1][1])
    for i, t in docs:
        loss = []
        for pair, word, ctx in models:
            p = lambda v, w: (pair.get((v, w), 0) + 10 * (word.get(w, 0) + 0.1) / (sum(word.values()) + 0.1 * size)) / (ctx.get(v, 0) + 10)
            s = steps(t)
            loss.append(-sum(np.log(p(v, w)) for v, w in s) / len(s) if s else 0.0)
        want.append((i, max(len(steps(t)) - 1, 0), *loss))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got, want = sorted((tuple(r)[:4] for r in got), key=order), sorted(want, key=order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_bigrams_travel_in_few_rows(spark, monkeypatch):
    """A chunk sends a row per bucket, not per word, and buckets that are weighed in many small parts score alike."""
    r = random.Random(6)
    docs = table(spark, [(i, " ".join(f"w{r.randrange(4000)}" if r.random() < 0.8 else "the the" for _ in range(300))) for i in range(60)]).coalesce(1)
    wanted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    dealt, kind = [], type(docs)
    monkeypatch.setattr(kind, "repartition", lambda self, *a, f=kind.repartition: dealt.append(self) or f(self, *a))
    run = lambda: lm_score.cross_entropy_difference(docs, wanted).orderBy("doc_id").toPandas().to_numpy()
    whole = run()
    monkeypatch.setattr(lm_score, "BUCKETS", 16, raising=False)
    monkeypatch.setattr(lm_score, "BUCKET_STEPS", 1 << 30, raising=False)
    monkeypatch.setattr(lm_score, "AT_ONCE", 1, raising=False)
    assert np.allclose(run(), whole) and dealt[-1].count() <= 17
