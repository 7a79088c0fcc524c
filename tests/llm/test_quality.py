import numpy as np
import pyarrow as pa

from moments.llm import quality
from tests.llm import common

D = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    targets = quality.fit(spark, docs, labels.where("doc_id % 2 = 0"))
    got = quality.score(spark, docs, targets).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert auc(got.p_quality.to_numpy(), got.quality.to_numpy()) >= 0.95
    assert auc(got.p_toxic.to_numpy(), got.toxic.to_numpy()) >= 0.9
    good = got[(got.quality == 1) & (got.toxic == 0)]
    assert good.kept.mean() >= 0.95 and got[got.toxic == 1].kept.mean() <= 0.3


def test_logistic_is_at_the_minimum():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(300, 4)), (rng.random(300) < 0.3).astype(float), rng.random(300)
    b = quality.logistic(x, y, 0.7, w)
    p = 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))
    slope = np.append(x.T @ (w * (p - y)) + 0.7 * b[:-1], (w * (p - y)).sum() + 1e-6 * b[-1])
    assert np.abs(slope).max() < 1e-4


def test_views_by_hand():
    doc, words, meta = quality.views(pa.array(["The cat, the DOG.", "", "a a\nB!"]), pa.array(["x", None, "x"]), pa.array(["en", "de", None]))
    assert np.bincount(doc, minlength=3).tolist() == [3, 1, 2]  # distinct words, whatever their case and marks; an empty text has the empty word
    assert meta[:, 0].tolist() == [np.log1p(17), 0.0, np.log1p(6)] and meta[2, 4] == 1 / 6 and meta[0, 6] == 3 / 4
    both = meta[:, 7 : 7 + quality.SOURCES]
    assert (both[0] == both[2]).all() and both.sum() == 3


def brute_telling(n, doc, words, y):
    gain = {}
    for w in set(words.tolist()):
        has = np.isin(np.arange(n), doc[words == w])
        if has.sum() < 5:
            continue
        g = 0.0
        for seen, of in ((y[has].sum(), y.mean()), ((1 - y[has]).sum(), 1 - y.mean())):
            g += seen * np.log(seen / (has.sum() * of)) if seen else 0
        gain[w] = g
    return {w for w, g in gain.items() if g > 3}


def test_telling_words():
    rng = np.random.default_rng(2)
    y = (np.arange(200) % 2).astype(float)
    rows = [(i, w) for i in range(200) for w in {int(rng.integers(0, 40)), int(rng.integers(0, 40)), 100 + int(y[i])}]
    doc, words = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
    got = quality.telling(200, doc, words, y)
    assert set(got.tolist()) == brute_telling(200, doc, words, y) and {100, 101} <= set(got.tolist())


def test_pseudo_labels_help():
    """With few labels the rounds give each view labels from the other, and the outcome is better than the labels alone."""
    rng = np.random.default_rng(3)
    n = 600
    truth = (rng.random(n) < 0.5).astype(float)
    rows = [(i, int(rng.integers(0, 30)) + (30 if truth[i] else 0)) for i in range(n) for _ in range(4)]
    doc, words = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
    meta = np.stack([truth * 4 + rng.normal(size=n), rng.normal(size=n)], 1)
    y = np.where(np.arange(n) < 80, truth, np.nan)
    t = quality.co_train(y, n, doc, words, meta)
    got = t.score(n, doc, words, meta)
    assert auc(got[80:], truth[80:]) >= 0.97


def test_rows_and_edges(spark):
    docs = common.documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(spark, docs, quality.fit(spark, docs, labels)).collect()
    assert len(got) == len(common.rows()) and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    none = quality.fit(spark, docs, labels.limit(0))
    assert {(r.p_quality, r.kept) for r in quality.score(spark, docs, none).collect()} == {(0.5, True)}
    assert quality.score(spark, common.empty(spark), none).count() == 0
    kept = quality.good_documents(spark, docs, none)
    assert kept.columns == docs.columns and kept.count() == len(common.rows())
    bare = docs.select("doc_id", "text")
    assert quality.good_documents(spark, bare, none).count() == len(common.rows())
