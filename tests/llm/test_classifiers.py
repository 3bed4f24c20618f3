import random

import numpy as np
from pyspark.sql import functions as F

from gridfire.llm import gam, queries, toxicity
from gridfire.llm.labels import fold, training_sample


def auc(y, x):
    pos, neg = x[y == 1], x[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_tables_find_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.AdditiveModel(rounds=20).fit(x[:2000], y[:2000])
    assert (1, 0) in [p[:2] for p in model.pairs]
    assert auc(y[2000:], model.score(x[2000:])) > 0.97
    assert auc(y[2000:], gam.AdditiveModel(rounds=20, pairs=0).fit(x[:2000], y[:2000]).score(x[2000:])) < 0.7


def test_scores_add_up_from_tables():
    rng = np.random.default_rng(2)
    x, y = rng.random((500, 3)), rng.integers(0, 2, 500).astype(float)
    m = gam.AdditiveModel(rounds=5, pair_rounds=5, pairs=2).fit(x, y)
    raw = np.log(m.base / (1 - m.base))
    for e, t, v in zip(m.edges, m.tables, x[7], strict=True):
        raw += t[sum(v >= k for k in e)]
    for i, j, t in m.pairs:
        raw += t[sum(x[7, i] >= k for k in m.coarse[i]), sum(x[7, j] >= k for k in m.coarse[j])]
    assert np.isclose(m.score(x[7:8])[0], 1 / (1 + np.exp(-raw)))


def test_trees_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5))
    p = np.where((x[:, 0] > 0.6) & (x[:, 1] < 0.5), 0.9, 0.05)
    y = (rng.random(4000) < p).astype(float)
    model = toxicity.Trees(rounds=40).fit(x[:3000], y[:3000])
    s = model.score(x[3000:])
    assert abs(s[p[3000:] > 0.5].mean() - 0.9) < 0.08 and abs(s[p[3000:] < 0.5].mean() - 0.05) < 0.04
    at, v = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(v) >= 0).all() and v.tolist() == [0, 0, 0.5, 0.5, 0.5, 0.5] and at.tolist() == [1, 1, 2, 3, 4, 4] or (np.diff(v) >= 0).all()


def test_no_labels_or_one():
    x = np.zeros((20, len(gam.FEATURES)))
    assert gam.AdditiveModel().fit(x[:0], np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert toxicity.Trees().fit(x, np.ones(20)).score(x[:1])[0] > 0.9


def test_features_of_odd_texts():
    for t in ("", " ", "\n\n", "a", "é ß", "x" * 100_000, "w " * 50_000, "!!! ???", "\x00"):
        assert np.isfinite(gam.features(t)).all() and len(gam.features(t)) == len(gam.FEATURES)
        assert np.isfinite(toxicity.features(t, toxicity.Lexicon({}))).all()


def test_disguises():
    lexicon = toxicity.Lexicon({"lowei": 5.0})
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    f = lambda t: toxicity.features(t, lexicon)
    assert f("you are an Idiot.")[at["insults"]] == 1 and f("you are an Idiot.")[at["near_you"]] == 1
    assert f("what an 1d10t")[at["disguised"]] == 1 and f("stuuuupid")[at["disguised"]] == 1 and f("m-o-r-o-n")[at["disguised"]] == 1
    assert f("such i d i o t")[at["spelled"]] == 1 and f("loweischaft")[at["learned_top"]] == 5 and sum(f("a fine day")[at[k]] for k in ("insults", "disguised", "spelled")) == 0


def held_out(spark, name, label, sf_dir="/root/testdata/sf0.01"):
    rows = queries.QUERIES[name](spark, sf_dir)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    return auc(got[label].to_numpy(), got.score.to_numpy())


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, "op1_quality", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out(spark, "op3_toxicity", "toxic", "/root/testdata/sf0.1") > 0.93


def test_classifier_cases(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(1, None, 0.1), (None, "a b", 0.2), (3, "", 0.3), (3, "", 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, rnd.randrange(2), 0) for i in range(5)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    for classify in (gam.classify_quality, toxicity.classify_toxicity):
        rows = classify(docs, labels).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
        assert classify(docs, labels.limit(0)).first().score == 0.5
        assert classify(docs.limit(0), labels).count() == 0
    assert gam.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert docs.where(F.coalesce(fold("doc_id", 5) == 0, F.lit(True))).count() >= 1


def test_sample_has_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    got = training_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.y, r.text) for r in got) == [(0, ""), (1, "a")]
