import zlib

import numpy as np
import pytest

from panelforge.llm import quality, toxicity
from panelforge.llm.queries import op5_toxicity, op10_quality


def checked(rows, truth, cut):
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    return np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth])


def test_quality_held_out(spark, sf):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert checked(rows, truth, 0.3) >= 0.9
    assert {r.doc_id: r.score for r in op10_quality(spark, sf).collect()} == {r.doc_id: r.score for r in rows}


def test_toxicity_held_out(spark, sf):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert checked(op5_toxicity(spark, sf).collect(), truth, 0.5) >= 0.8


def test_labels_of_the_held_out_fold_are_not_used(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.rank_documents(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_pairs_rank_good_over_bad():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 17))
    y = (x[:, 0] + 0.5 * x[:, 3] > -0.5).astype(int)
    m = quality.fit(x, y, 1 - y.mean())
    s = m.score(x)
    assert ((s >= 0.3) == y).mean() > 0.97
    assert quality.fit(x, np.ones(400, int), 0.0) is None


def test_kernel_tolerates_insertions():
    codes = toxicity._Codes()

    def kernel(a, b):
        row, number, weight = toxicity.subsequences([a, b], 0.5, codes)
        f = [dict(zip(number[row == i], weight[row == i], strict=True)) for i in (0, 1)]
        return sum(w * f[1].get(k, 0) for k, w in f[0].items())

    assert kernel("idiot", "idiot") == pytest.approx(1)
    assert kernel("idiot", "id.iot") > 0.6 and kernel("idiot", "idxiot") > 0.3 and kernel("idiot", "table") < 0.05
    assert "idiot" in toxicity.windows("you i d i o t there") or "idiotthere" in toxicity.windows("you i d i o t there")


def test_insults_with_characters_let_in():
    clean = ["the cat sat on the mat and looked at the moon", "a river runs through the green valley", "bread and butter make a fine meal"] * 12
    toxic = [f"{t} you {w}" for w in ("worthless", "pathetic", "disgusting") for t in clean[:10]]
    m = toxicity.fit(clean + toxic, np.array([0] * len(clean) + [1] * len(toxic)), 0.4)
    bad, odd, good = m.score(["what a worthless thing"])[0], m.score(["what a worth.less thing"])[0], m.score(["what a green thing"])[0]
    assert bad > 0.5 > good and odd > good


def test_awkward_rows(awkward, empty, labels):
    for got in (quality.rank_documents(awkward, labels), toxicity.score_documents(awkward, labels)):
        rows = got.collect()
        assert len(rows) == awkward.count()
        same = {r.score for r in rows if r.doc_id in (1, 2, 10)}
        assert len(same) == 1
    one = labels.filter("quality = 1")
    assert {r.score for r in quality.rank_documents(awkward, one).collect()} == {0.5}
    assert {r.score for r in toxicity.score_documents(awkward, labels.filter("toxic = 0")).collect()} == {0.5}
    assert quality.rank_documents(empty, labels).count() == 0 and toxicity.score_documents(empty, labels).count() == 0
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns


def test_sentences_and_gaps():
    text = "A calm start. You stu pid\nthing! i d i o t here.  Fine.Really"
    assert toxicity.sentences(text) == ["A calm start.", "You stu pid", "thing!", "i d i o t here.", "Fine.Really"]
    assert {"stu pid", "you stu"} <= toxicity.windows(text) and not any("pid thing" in w for w in toxicity.windows(text))
    codes = toxicity._Codes()
    row, number, weight = toxicity.subsequences(["stupid", "stu pid", "quiet"], 0.5, codes)
    f = [dict(zip(number[row == i], weight[row == i], strict=True)) for i in range(3)]
    assert sum(w * f[1].get(k, 0) for k, w in f[0].items()) > 0.6 and sum(w * f[2].get(k, 0) for k, w in f[0].items()) < 0.05


def test_the_worst_sentence_is_told():
    clean = [f"the weather in week {i} was mild. you are a good friend, see you. it rained on day {i % 7}." for i in range(60)]
    toxic = [f"{c} you are a {('stupid', 'idiot')[i % 2]} friend. see you." for i, c in enumerate(clean[:30])]
    m = toxicity.fit(clean + toxic, np.array([0] * 60 + [1] * 30), 1 / 3)
    s, worst, where = m.judge(["all is well. what a stu pid idea, stupid. thanks.", "all is well. it rained.", ""])
    assert s[0] > 0.5 > s[1] and "stupid" in where[0] and where[2] is None and worst[0] > worst[1]


def test_texts_without_windows():
    for texts in (["", ""], ["...", "  "], ["", "some words"]):
        m = toxicity.fit(texts, np.array([1, 0]), 0.5)
        assert m.score(texts + [""]) == pytest.approx([0.5] * 3)
    assert toxicity.fit(["a b"], np.array([1]), 1.0) is None
    m = toxicity.fit(["some words", ""], np.array([1, 0]), 0.5)
    assert ((m.score(["some words", "", "x"]) >= 0) & (m.score(["some words", "", "x"]) <= 1)).all()


def test_contradicting_labels_train_nothing(spark):
    from panelforge.llm.labelled import training_rows

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(i, 0) for i in range(10)], "doc_id long, toxic int")
    assert all(r["__id"] >= 10 and r["__label"] == 1 for r in training_rows(docs, labels, "toxic", 100).collect())


def test_every_pair_counts():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 17))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    m = quality.fit(x, y, 0.5)
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, 17)
    p = 1 / (1 + np.exp(d @ m.weights))
    assert np.abs(-(d * p[:, None]).mean(axis=0) + 1e-3 * m.weights).max() < 1e-6  # the gradient over all pairs, written out


def test_all_labelled_rows_train_quality(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["calm", "Rain!", "a|b", "walks,", "home.", "HOME", "7", "x=y"], 4 + i % 9, p=p)) for i in range(4000) for p in [rng.dirichlet(np.ones(8))]]
    good = [int(t.count("|") + t.count("!") < 3 or i % 11 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    learnt = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.features(t.encode()) for t in texts]), np.array(good)
    assert (y[learnt] == 1).sum() > 2000 and (y[learnt] == 0).sum() > 100
    own = quality.fit(x[learnt], y[learnt], 1 - y[learnt].mean())
    got = {r.doc_id: r.score for r in quality.rank_documents(docs, labels).collect()}
    assert np.abs(np.array([got[i] for i in range(len(texts))]) - own.score(x)).max() < 1e-6
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.3}


def test_sums_by_node_are_sums_over_pairs():
    rng = np.random.default_rng(6)
    for spread in (0, 0.01, 3, 40):
        u, v = rng.normal(size=300) * spread, rng.normal(size=200) * spread + 1
        z = rng.normal(size=(300, 17))
        (a, s), (b, t) = quality.by_node(u, z), quality.by_node(v, np.zeros((200, 17)))
        nodes = ((b + np.arange(len(t)))[None, :] - (a + np.arange(len(s)))[:, None]) * quality.STEP
        for f in (quality._logistic, lambda d: np.logaddexp(0, d)):
            told = s.T @ f(nodes) @ t[:, 0]
            plain = np.hstack([np.ones((300, 1)), z]).T @ f(v[None, :] - u[:, None]).sum(axis=1)
            assert np.abs(told - plain).max() / (300 * 200) < 1e-10


def test_quantile_with_fewest_on_the_wrong_side(spark):
    def best(rows):
        return quality.best_quantile(spark.createDataFrame(rows, "s double, bad long, good long").repartition(3))

    assert best([(0.0, 3, 0), (1.0, 2, 1), (2.0, 0, 3), (9.0, 1, 0), (10.0, 0, 8)]) == 1.5
    assert best([(-1.0, 2, 0), (0.0, 1, 1), (3.0, 0, 4)]) == 1.5  # equally good under 0 and over it: the wider gap
    assert best([(-2.0, 2, 0), (0.0, 1, 1), (2.0, 0, 4)]) == -1.0  # and of equal gaps the lower
    assert best([(4.0, 2, 3)]) == 4.0


def test_equal_texts_of_both_labels(spark):
    docs = spark.createDataFrame([(i, "the same") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert {(round(r.score, 9), r.predicted) for r in quality.rank_documents(docs, labels).collect()} == {(0.3, 1)}
