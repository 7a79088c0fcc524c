"""Sets of any size: pairs block against block and greedy groups by vectors, against plain loops over all pairs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from moments.operators import blocks as B
from moments.operators import evaluation as EV
from moments.operators import greedy
from moments.operators import photos as PH

ROWS = "k int, idx long, e array<double>"


def _distance(a, b):
    if not a or not b or len(a) != len(b):
        return None
    x, y = np.array(a, float), np.array(b, float)
    p, q = np.sqrt((x * x).sum()), np.sqrt((y * y).sum())
    return float(np.clip(1 - x @ y / p / q, 0, 2)) if 0 < p < np.inf and 0 < q < np.inf else None


def _photos(n, seed=0, sets=2):
    rng = np.random.default_rng(seed)
    rows = [(k % sets, k, [float(v) for v in rng.normal(size=6)]) for k in range(n)]
    for k, odd in zip((3, 8, 11, 14, 21), (None, [], [0.0] * 6, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), strict=True):
        rows[k] = (*rows[k][:2], odd)
    rows[26] = (*rows[26][:2], [3.0, 2.0, 1.0])
    return rows


def test_pairs_of_blocks_are_all_pairs(spark):
    rows = _photos(60)
    want = {(a[0], a[1], b[1]): d for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (d := _distance(a[2], b[2])) is not None}
    for block in (4, 7, 100):
        got = {(r.k, r.i, r.j): r.d for r in B.all_pairs(spark.createDataFrame(rows, ROWS).repartition(3), "k", block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    near = {(r.k, r.i, r.j) for r in B.all_pairs(spark.createDataFrame(rows, ROWS), "k", 0.6, 7).collect()}
    assert near == {k for k, d in want.items() if d <= 0.6}


def test_a_set_may_have_any_number_of_pairs(spark):
    n = greedy.MOST_IN_A_SET + 100
    x = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("idx"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.5)).alias("e"))
    assert PH.vector_pairs(x, "k").count() == n * (n - 1) // 2


def test_tallies_of_blocks(spark):
    from moments.plans import q_matching as Q

    rows = _photos(60, 0, 1)
    pairs = [(a[1], b[1], d) for a in rows for b in rows if a[1] < b[1] and (d := _distance(a[2], b[2])) is not None]
    want = {}
    for i, j, d in pairs:
        key = (("similar", "different", "unknown", "different")[(i * 31 + j) % 4], d <= 0.95 if (i + j) % 7 else None)
        want[key] = want.get(key, 0) + 1
    one = spark.createDataFrame(rows, ROWS)
    got = B.pair_blocks(one, "k", Q._tally, "label string, similar boolean, n long", 7).groupBy("label", "similar").agg(F.sum("n").alias("n")).where("n > 0")
    assert {(r.label, r.similar): r.n for r in got.collect()} == want
    m = EV.pair_metrics(got.withColumn("outcome", EV.outcome(F.col("label"), F.col("similar"))), n=F.col("n")).first()
    assert m.pairs == len(pairs) and m.tp == want[("similar", True)] and m.missing == want[("similar", None)] + want[("different", None)]
    far = {}
    for i, j, d in pairs:
        far[(j % 40, i % 40)] = max(d, far.get((j % 40, i % 40), 0.0))
    got = B.pair_blocks(one, "k", Q._farthest, "i long, j long, d double", 7).groupBy("i", "j").agg(F.max("d").alias("d")).collect()
    assert {(r.i, r.j): round(r.d, 9) for r in got} == {k: round(d, 9) for k, d in far.items()}


def test_similar_pairs_asks_for_its_pairs_only(spark):
    rows = _photos(60)
    x = spark.createDataFrame(rows, ROWS)
    asked = x.select("k", (F.col("idx") + 10).alias("i"), F.col("idx").alias("j"))
    got = {(r.k, r.j): r.similar for r in PH.similar_pairs(asked, PH.asked_distances(x, "k", asked).withColumn("o", F.lit(1)), "k", 0.8, "o").collect()}
    by = {(k, i): e for k, i, e in rows}
    assert got == {(k, i): (d := _distance(e, by.get((k, i + 10)))) is not None and d <= 0.8 for k, i, e in rows}


@pytest.mark.parametrize("n", [60, greedy.MOST_IN_A_SET + 300])
def test_leaders(spark, n):
    rng = np.random.default_rng(5)
    rows = [(k, i, e, round(float(rng.random()), 2)) for k, i, e in _photos(n, 3, 1)]
    want = []
    for row in rows:
        at = next((p for p, r in enumerate(want) if (d := _distance(r[2], row[2])) is not None and d <= 0.5), None)
        if at is None:
            want.append(row)
        elif row[3] > want[at][3]:
            want[at] = row
    got = B.leaders(spark.createDataFrame(rows, ROWS + ", quality double").repartition(3), "k", 0.5).collect()
    assert sorted((r.k, r.idx, r.quality) for r in got) == sorted((r[0], r[1], r[3]) for r in want)


def _linked(order, d, limit):
    groups, out = [], {}
    for i in order:
        g = next((g for g in groups if all((x := d(i, o)) is not None and x <= limit for o in g)), None)
        if g is None:
            groups.append(g := [])
        g.append(i)
        out[i] = (groups.index(g) + 1, len(g))
    return out


@pytest.mark.parametrize("n", [60, greedy.MOST_IN_A_SET + 300])
def test_complete_link(spark, n):
    rows = _photos(n, 4, 1)
    order = np.random.default_rng(6).permutation(n).tolist()
    e = {i: v for _, i, v in rows}
    x = spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(order)], "k int, idx long, rank int")
    got = {r.idx: (r.grp, r.member) for r in B.complete_link(x, spark.createDataFrame(rows, ROWS), "k", 0.5).collect()}
    assert got == _linked(order, lambda a, b: _distance(e[a], e[b]), 0.5)


def test_of_several_vectors_of_a_photo_the_farthest_counts(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.1]), (0, 2, [0.0, 1.0]), (0, 3, [1.0, 0.2]), (0, 4, [0.0, 1.0]), (0, 4, None)]
    x = spark.createDataFrame([(0, i, i) for i in (1, 2, 3, 4, 5)], "k int, idx long, rank int")
    got = {r.idx: (r.grp, r.member) for r in B.complete_link(x, spark.createDataFrame(rows, ROWS), "k", 0.3).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 2), 4: (3, 1), 5: (4, 1)}


def test_diverse_photos_of_a_large_set(spark):
    n = greedy.MOST_IN_A_SET + 300
    i = F.col("id")
    x = spark.range(n).select(F.lit(1).alias("k"), i.alias("idx"), (i * 31 % 97 / 97.0).alias("sharp"), F.lit(0.5).alias("expo"), F.lit(10).alias("px"), F.lit(None).cast("double").alias("aes"), F.array(F.sin("id"), F.cos(i * 3), F.lit(0.3)).alias("e"))
    got = PH.diverse(x.drop("e"), None, "k", 0.2, 12, x.select("k", "idx", "e"))
    rows = got.collect()
    assert len(rows) == n and sum(r.selected for r in rows) == 12 and len({r.grp for r in rows}) > 5 and max(r.member for r in rows) > 1
    assert PH.diverse(x.drop("e"), None, "k", -1.0, 12, x.select("k", "idx", "e")).where("member > 1").count() == 0
    from moments.sources import sinks

    line = json.loads(sinks.photo_line(got, "k").first().line)
    assert len(line["groups"]) == len({r.grp for r in rows}) and sum(len(g["memberIndices"]) for g in line["groups"]) == n
    assert all(g["representativeIndex"] == g["memberIndices"][0] for g in line["groups"]) and len(line["selectedIndices"]) == 12


def test_places_with_nothing_but_nulls_drop_out(spark):
    x = spark.createDataFrame([(1, [None, 0.5]), (2, [0.25, None]), (2, [0.75, None])], "clip long, p array<double>")
    assert sorted(tuple(r) for r in EV.per_index(x, "clip", "p").collect()) == [(1, 1, 0.5, 0.5, 0.5), (2, 0, 0.5, 0.75, 0.25)]


def test_a_sum_of_nothing_is_null(spark):
    from moments.functions import vectors as V

    x = spark.createDataFrame([([],), ([1.0, 2.5],)], "xs array<double>").select(V.some_total(F.col("xs")).alias("s"))
    assert [r.s for r in x.collect()] == [None, 3.5]


def test_a_set_beyond_a_document_takes_several(spark, tmp_path):
    from moments.plans import q_sources as Q

    x = spark.range(2100).select(F.col("id").alias("vec_id"), F.lit(3).alias("label"), F.array(*[F.sin(F.col("id") + k).cast("float") for k in range(4)]).alias("embedding"))
    x.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert Q.protocol_photos(spark, str(tmp_path)).distinct().count() == 2100
