import random
import re

import numpy as np
import pyarrow as pa
import pytest

from moments.llm import neardup
from tests.llm import common


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    extra, n = [], 1000
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(3, 150))]
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = r.choice(words)
            extra.append((n, " ".join(t)))
            n += 1
    chain = [r.choice(words) for _ in range(120)]
    for i in range(12):
        extra.append((n + i, " ".join(chain[i * 4 :] + [f"t{j}" for j in range(i * 4)])))
    docs = common.documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark, docs, k, percent).collect())
    assert got == brute([x[:2] for x in common.rows()] + extra, k, percent)


def test_empty(spark):
    assert neardup.near_duplicates(spark, common.empty(spark)).count() == 0
    got = neardup.near_duplicates(spark, spark.createDataFrame([(None, None), (None, "a b c"), (5, "a b c")], "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in got) == [("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = neardup.mix(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2600])
    s = neardup.sketches([a, b, np.unique(pool[:2600])])
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    j = neardup.estimate(s[:1], s[1:2], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(j - 1500 / 2600) < 0.15
    assert (neardup.sketches(neardup.shingle_sets(pa.array(["x y z", "x y z"]), 3))[0] == neardup.sketches(neardup.shingle_sets(pa.array(["X\ty\nz"]), 3))[0]).all()


def variants(n, seed=2):
    """Sets that share most of one base, their nodes and their sketches."""
    r = np.random.default_rng(seed)
    base, sets = r.integers(0, 1 << 62, 300).astype(np.uint64), []
    for _ in range(n):
        s = base.copy()
        s[r.permutation(300)[: r.integers(2, 60)]] = r.integers(0, 1 << 62, 1).astype(np.uint64) + np.uint64(len(sets))
        sets.append(np.unique(s))
    return sets, neardup._struct(*neardup._nodes(sets)), neardup.sketches(sets)


def test_a_pair_leaves_one_of_its_buckets():
    """Pairs of a large cluster share many buckets; they were sent from each, with both sets, to be confirmed."""
    sets, node, regs = variants(60)
    width, found, shared = neardup.band_width(0.8), [], set()
    names = [(x["k1"], x["k2"]) for x in node.to_pylist()]
    for band in range(neardup.M // width):
        own = regs[:, band * width : (band + 1) * width]
        for key in np.unique(own, axis=0):
            i = np.flatnonzero((own == key).all(1))
            if len(i) < 2:
                continue
            n, k = len(i), pa.array(i)
            same = {c: pa.array([v] * n) for c, v in (("band", band), ("block", 0), ("lo", 0), ("hi", 0), ("is_head", False))}
            out = neardup._crosser(0.6, width)(pa.table({**same, "node": node.take(k), "comp": node.take(k), "n": pa.array([len(sets[x]) for x in i]), "sketch": pa.array([regs[x].tobytes() for x in i])}))
            found += [frozenset((x["k1"], x["k2"]) for x in row.values()) for row in out.to_pylist()]
            shared |= {frozenset((names[x], names[y])) for x in i for y in i if x < y}
    assert len(found) == len(set(found)) and set(found) <= shared
    jaccard = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y]))
    close = {p for x in range(60) for y in range(x) if (p := frozenset((names[x], names[y]))) in shared and jaccard(x, y) >= 0.8}
    assert len(close) > 50 and close <= set(found)


def test_reaches_is_the_estimate():
    r = np.random.default_rng(3)
    sets, _, regs = variants(80)
    i, j = r.integers(0, 80, (2, 2000))
    n = np.array([len(s) for s in sets])
    got = neardup.reaches((regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1), n[i], n[j], 0.7)
    est = neardup.estimate(regs[i], regs[j], n[i], n[j])
    assert got[est > 0.706].all() and not got[est < 0.694].any() and 0 < got.sum() < 2000


def test_blocks_of_sets_confirm_as_brute_force(spark, monkeypatch):
    """The same classes whether the sets are of one block or of many."""
    monkeypatch.setattr(neardup, "SET_BYTES", 4000)
    r = random.Random(8)
    base, rows = [f"w{r.randrange(300)}" for _ in range(150)], []
    for k in range(80):
        t = list(base)
        for _ in range(r.randint(0, 8)):
            t[r.randrange(150)] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(t)))
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == brute(rows, 3, 85)


def test_a_worker_gets_some_bytes_at_a_time(spark):
    from moments.llm import util

    util.prepare(spark)
    big = spark.range(60).selectExpr("id", "repeat('x', 1000000) as text").coalesce(1)
    got = big.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert max(x.n for x in got) <= util.BATCH_BYTES + 2_000_000
