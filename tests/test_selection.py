"""Selections, folds, matching and calibration: by hand, against brute force, and what must always hold."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moments.operators import calibration as K
from moments.operators import greedy, matching, ranges, sets
from moments.operators import highlights as H
from moments.operators import photos as PH


def test_leader_keeps_the_better_of_near_ones(spark):
    photos = spark.createDataFrame([("a", 0, 0.40), ("a", 1, 0.75), ("a", 2, 0.55), ("b", 0, 0.1)], "set_id string, idx int, quality double")
    pairs = spark.createDataFrame([("a", 0, 1, 0.04), ("a", 0, 2, 0.44), ("a", 1, 2, 0.42)], "set_id string, i int, j int, d double")
    got = greedy.leader_clusters(photos, pairs, "set_id", 0.12)
    assert sorted((r.set_id, r.idx) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 0)]
    assert greedy.leader_clusters(photos, pairs, "set_id", -1.0).count() == 4
    assert greedy.leader_clusters(photos, pairs.where("i = 9"), "set_id", 0.13).count() == 4
    with pytest.raises(Exception, match="more than"):
        many = spark.range(greedy.MOST_IN_A_SET + 1).select(F.lit("a").alias("set_id"), F.col("id").cast("int").alias("idx"), F.lit(0.5).alias("quality"))
        greedy.leader_clusters(many, pairs, "set_id", 0.12).collect()


def test_canonical_pairs(spark):
    rows = [(1, 2, 1, 0.3, 0), (1, 1, 2, 0.1, 1), (1, 1, 1, 0.0, 2), (1, 1, 9, 0.2, 3), (1, 2, 3, math.nan, 4), (1, 2, 3, -1.0, 5), (1, 3, 1, math.inf, 6)]
    pairs = spark.createDataFrame(rows, "k int, i int, j int, d double, o int")
    known = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k int, idx int")
    assert [tuple(r) for r in greedy.canonical_pairs(pairs, "k", known).collect()] == [(1, 1, 2, 0.3)]
    assert sorted(tuple(r) for r in greedy.canonical_pairs(pairs, "k", known, "last", "o").collect()) == [(1, 1, 2, 0.1), (1, 1, 3, math.inf)]


def test_folds_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k % 3}", float(t), float(v), k) for k, (t, v) in enumerate(zip(rng.random(300).round(2) * 60, rng.random(300).round(1), strict=True))]
    df = spark.createDataFrame(rows, "src string, t double, score double, id long").repartition(5)
    kept = greedy.temporal_nms(df, "src", 1.0).collect()
    want = []
    for s, t, v, k in sorted(rows, key=lambda r: (-r[2], r[1], r[3])):
        if all(s != o[0] or abs(o[1] - t) >= 1.0 for o in want):
            want.append((s, t, v, k))
    assert sorted((r.src, r.t, r.score, r.id) for r in kept) == sorted(want)
    last: dict = {}
    want = []
    for s, t, _, k in sorted(rows, key=lambda r: (r[1], r[3])):
        if t - last.get(s, -math.inf) >= 2.0:
            last[s] = t
            want.append((s, t, k))
    assert sorted((r.src, r.t, r.id) for r in greedy.refractory(df, "src", 2.0).collect()) == sorted(want)


def test_nearest_ties_go_to_the_later(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 0.0), ("b", 1.0), ("a", 400000.0)], "k string, t double")
    right = spark.createDataFrame([("a", 4.0, 1.0), ("a", 6.0, None), ("a", 400000.0, 3.0)], "k string, u double, v double")
    got = {(r.k, r.t): (r.near_u, r.near_v) for r in ranges.nearest(left, right, "k", ["v"]).collect()}
    assert got == {("a", 5.0): (6.0, None), ("a", 0.0): (4.0, 1.0), ("b", 1.0): (None, None), ("a", 400000.0): (400000.0, 3.0)}


def test_asof_takes_the_row_not_the_last_value(spark):
    left = spark.createDataFrame([("a", 5.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 7.0), ("a", 5.0, None)], "k string, u double, v double")
    assert ranges.backward_asof(left, right, "k", "v").first().v is None
    assert ranges.forward_asof(left, right, "k").first().next_u is None and ranges.forward_asof(left, right, "k", 0.0, True).first().next_u == 5.0


def test_diverse_photos(spark):
    photos = spark.createDataFrame([(1, k, 0.9 - k / 10, 0.5, 10, None) for k in range(5)] + [(1, 7, 0.5, 0.5, 10, None), (1, 7, 0.5, 0.5, 10, None), (1, -1, 0.5, 0.5, 10, None), (1, 8, 0.5, 0.5, 0, None), (1, 9, 0.5, 0.5, 10, 2.0)], "k int, idx long, sharp double, expo double, px long, aes double")
    near = [(0, 1, 0.1), (0, 2, 0.1), (1, 3, 0.1), (0, 3, 0.1)]  # 2 isn't known to be near 1, so it can't join 0 and 1; 3 can
    d = spark.createDataFrame([(1, *x) for x in near], "k int, i long, j long, d double")
    got = {r.idx: r for r in PH.diverse(photos, d, "k", 0.2, 3).collect()}
    assert {i: r.reason for i, r in got.items() if r.reason} == {7: "duplicateCandidateId", -1: "invalidIndex", 8: "nonPositivePixelCount", 9: "nonFiniteOrOutOfRangeAesthetics"}
    assert [(got[k].grp, got[k].member) for k in range(5)] == [(1, 1), (1, 2), (2, 1), (1, 3), (3, 1)]
    assert sorted(i for i, r in got.items() if r.selected) == [0, 2, 4] and got[0].role == "groupRepresentative"
    assert PH.diverse(photos, d, "k", -1.0, 3).where("member > 1").count() == 0 and PH.diverse(photos, d, "k", 0.2, 0).where("selected").count() == 0


CONF = H.Highlights(frame_count=5, similarity_threshold=0.1)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.floats(0, 60), min_size=1, max_size=12, unique=True), st.floats(0, 40), st.floats(0.5, 8), st.lists(st.floats(0.5, 59), max_size=4))
def test_segments_hold(times, budget, longest, cuts):
    conf = H.Highlights(frame_count=9, similarity_threshold=0.1, max_segment=longest, budget=budget)
    anchors, cuts = sorted(times), sorted(set(cuts))
    segments = H.build(anchors, cuts, 60.0, conf)
    assert sorted(k for s in segments for k in s[2]) == list(range(len(anchors)))
    assert all(a[1] <= b[0] + 1e-9 for a, b in zip(segments, segments[1:], strict=False))
    assert all(0 <= s <= e <= 60 and e - s <= longest + 1e-9 and all(s - 1e-9 <= anchors[k] <= e + 1e-9 for k in own) for s, e, own in segments)
    assert not any(s + 1e-9 < x < e - 1e-9 for s, e, _ in segments for x in cuts)
    paid = H.pack(segments, anchors, list(range(len(anchors))), budget)
    assert sum(segments[k][1] - segments[k][0] for k in paid) <= budget + 1e-6
    assert all(segments[k][0] - 1e-9 <= anchors[a] <= segments[k][1] + 1e-9 for k in paid for a in segments[k][2])


def test_highlights(spark):
    frames = spark.createDataFrame([("v", 1, 10.0, 0.9, None), ("v", 2, 10.5, 0.8, None), ("v", 3, 20.0, 0.7, None), ("v", 4, 30.0, 0.6, None), ("v", 5, 50.0, 0.1, None), ("v", 6, 99.0, 0.9, None)], "k string, idx long, t double, q double, imp double")
    dist = spark.createDataFrame([("v", 3, 1, 0.05)], "k string, i long, j long, d double")
    rec = spark.createDataFrame([("v", 60.0, [9.5])], "k string, duration double, cuts array<double>")
    got = {r.idx: r for r in H.highlights(frames, dist, rec, "k", CONF).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "minimumSpacingConflict", 3: "localNearDuplicateConflict", 4: None, 5: "belowQualityThreshold", 6: "nonFiniteOrOutOfRangeTime"}
    assert (got[1].start, got[1].end, got[1].segment) == (9.5, 12.0, 1) and (got[4].start, got[4].end) == (29.0, 32.0)
    bad = H.Highlights(frame_count=-1, similarity_threshold=0.1)
    assert H.highlights(frames, dist, rec, "k", bad).count() == 0
    none = H.Highlights(frame_count=5, similarity_threshold=0.1, budget=0.0)
    assert H.highlights(frames, dist, rec, "k", none).where("segment is not null").count() == 0
    from moments.sources import sinks

    line = sinks.highlight_line(H.highlights(frames, dist, rec, "k", CONF), frames, "k").first().line
    import json

    out = json.loads(line)
    assert out["selectedFrameIndices"] == [1, 4] and out["segments"][0] == {"startSeconds": 9.5, "endSeconds": 12.0, "anchorIndices": [1]} and out["usedImportanceScores"] is False
    assert list(out["rejectionReasonsByIndex"]) == ["2", "3", "5", "6"]


@given(st.lists(st.lists(st.integers(0, 5), max_size=4, unique=True), max_size=6))
def test_matching_is_maximum(wishes):
    got = matching.augmented(list(range(len(wishes))), dict(enumerate(wishes)))
    assert all(v in wishes[k] for k, v in got.items()) and len(set(got.values())) == len(got)
    best = 0
    for pick in itertools.product(*[[None, *w] for w in wishes]):
        some = [p for p in pick if p is not None]
        best = max(best, len(some) if len(set(some)) == len(some) else 0)
    assert len(got) == best


def test_one_to_one(spark):
    cands = spark.createDataFrame([("s", 1, 10.0, 1), ("s", 2, 10.2, 2), ("s", 3, 10.4, 3), ("s", 4, 20.0, 4)], "src string, id long, t double, rank long")
    refs = spark.createDataFrame([("s", 1, 9.5, "putter"), ("s", 2, 10.5, "driver"), ("s", 3, 11.0, "non-shot")], "src string, ref long, u double, label string")
    got = {r.id: r.label for r in matching.one_to_one(cands, refs, "src", 1.0).collect()}
    assert got == {1: "ambiguous", 2: "other-club", 3: "negative", 4: "unlabeled"}


def test_newton_is_at_the_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) < 0.4).astype(float)
    for l2 in (0.0, 0.1, 10.0):
        b, ok, _ = K.newton(x, y, l2)
        p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
        slope = np.concatenate([[(p - y).mean()], x.T @ (p - y) / 200 + l2 * b[1:]])
        assert ok and np.linalg.norm(slope) < 1e-6


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=20), st.sampled_from(K.safe_settings()))
def test_bounded_order_keeps_its_contract(rows, conf):
    rows.sort(key=lambda r: -r[0])
    e, f, s = ([float(r[k]) for r in rows] for k in range(3))
    order = K.bounded_order(e, f, s, conf, {"full_high": 7.0, "full_low": 2.0, "short_high": 7.0, "short_low": 2.0, "scale": 1.0})
    head = K.protected_rows(conf["mode"], conf["value"], len(rows))
    assert sorted(order) == list(range(len(rows))) and order[:head] == list(range(head))
    assert max(abs(a - b) for a, b in enumerate(order)) <= conf["shift"]
    at = {k: n for n, k in enumerate(order)}
    assert all(at[a] < at[b] for a, b in itertools.combinations(range(len(rows)), 2) if e[a] == e[b])


def test_bounded_order_by_hand():
    conf = {"family": "promote_demote", "mode": "abs", "value": 1.0, "shift": 2, "gap": 2.0}
    known = {"full_high": 0.9, "full_low": 0.1, "short_high": 0.9, "short_low": 0.1, "scale": 1.0}
    e, half = [9.0, 8.0, 7.0, 6.0, 5.0], 0.5
    assert K.bounded_order(e, [half, half, half, 1.0, half], [half, half, half, 1.0, half], conf, known) == [0, 3, 1, 2, 4]
    assert K.bounded_order(e, [half, 0.0, half, half, half], [half, 0.0, half, half, half], conf, known) == [0, 2, 3, 1, 4]
    assert K.bounded_order(e, [half, half, half, math.nan, half], [half] * 5, conf, known) == [0, 1, 2, 3, 4]


def test_merged_scores_refuse_differences(spark):
    schema = "id long, positive boolean, grp long, expert double, semantic double"
    a = spark.createDataFrame([(1, True, 1, 0.5, 0.1), (2, False, 1, None, 0.2)], schema)
    assert sets.merged_scores(a, a, a).count() == 2
    for other in ([(1, True, 1, 0.5, 0.1)], [(1, True, 1, 0.5, 0.1), (2, True, 1, None, 0.2)], [(1, True, 1, 0.5, 0.1), (2, False, 1, 0.7, 0.2)]):
        with pytest.raises(Exception, match="inputs differ"):
            sets.merged_scores(a, spark.createDataFrame(other, schema), a).collect()


def test_refuse(spark):
    from moments.operators import evaluation as EV

    cases = spark.createDataFrame([("calibration", "a", "x"), ("heldOut", "a", "y")], "split string, source string, session string")
    with pytest.raises(ValueError, match="leak.*source"):
        EV.refuse(EV.leaks(cases), "leak")
    EV.refuse(EV.leaks(cases.limit(1)), "leak")


def _bounded_plainly(expert, full, short, conf, known):
    order, limit, shift = list(range(len(expert))), conf["gap"] * known["scale"], conf["shift"]
    head = K.protected_rows(conf["mode"], conf["value"], len(expert))

    def may_swap(at):
        down, up = order[at], order[at + 1]
        far = expert[down] == -math.inf or expert[up] == -math.inf or expert[down] == expert[up] or expert[down] - expert[up] > limit
        return at >= head and not far and abs(at + 1 - down) <= shift and abs(at - up) <= shift

    sure = {k for k in order if full[k] >= known["full_high"] and short[k] >= known["short_high"]}
    doubted = {k for k in order if full[k] <= known["full_low"] and short[k] <= known["short_low"]} - sure if conf["family"] == "promote_demote" else set()
    for some, way in (([k for k in order if k in sure], -1), ("doubted", 1)):
        for k in some if way < 0 else [k for k in order if k in doubted][::-1]:
            for _ in range(shift):
                at, to = order.index(k), order.index(k) + way
                if not 0 <= to < len(order) or order[to] in sure or (way > 0 and order[to] in doubted) or not may_swap(min(at, to)):
                    break
                order[at], order[to] = order[to], order[at]
    return order


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=30), st.sampled_from(K.safe_settings()))
def test_bounded_order_equals_the_plain_one(rows, conf):
    rows.sort(key=lambda r: -r[0])
    e, f, s = ([float(r[k]) for r in rows] for k in range(3))
    known = {"full_high": 7.0, "full_low": 3.0, "short_high": 6.0, "short_low": 3.0, "scale": 1.0}
    assert K.bounded_order(e, f, s, conf, known) == _bounded_plainly(e, f, s, conf, known)


def test_safe_grid_takes_any_number_of_rows(spark):
    i = F.col("id")
    rows = spark.range(12_000).select("id", (i % 4).alias("grp"), (i % 3 == 0).alias("positive"), (i % 977 / 977.0).alias("expert"), (i * 7919 % 1009 / 1009.0).alias("full"), (i * 7919 % 1013 / 1013.0).alias("short"))
    got = K.safe_grid(rows, K.safe_settings()[:5]).collect()
    assert sorted(r.setting for r in got) == list(range(5)) and all(r.head_kept and r.shift <= 6 for r in got) and any(r.moved for r in got)


def test_blocked_logistic_takes_any_number_of_rows(spark):
    i = F.col("id")
    rows = spark.range(12_000).select("id", F.concat(F.lit("g"), (i % 3).cast("string")).alias("grp"), (i * 31 % 97 > 60).alias("positive"), (i % 977 / 977.0).alias("expert"), (i * 31 % 97 / 97.0).alias("motion"))
    got = K.blocked_logistic(rows, [["expert", "motion"]], [0.1], [0, 5]).collect()
    assert sorted(r.head for r in got) == [0, 5] and all(r.converged and r.ap > 0.9 for r in got)


def test_numbers_of_a_long_list_equal_one_sort(spark):
    from pyspark.sql import Window

    from moments.operators import ranking

    i = F.col("id")
    x = spark.range(5000).select("id", (i % 3).alias("g"), F.when(i % 11 != 0, i * 7919 % 401 / 7.0).alias("v")).repartition(4)
    v = F.col("v")
    for by, part in (((), None), (("g",), None), (("g",), F.floor(F.coalesce(v, F.lit(1e6)) / 9))):
        want = F.row_number().over(Window.partitionBy(*by).orderBy(v.asc_nulls_last(), "id"))
        assert ranking.numbered(x, "n", v, i, by=by, part=part).withColumn("w", want).where("n <> w or n is null").count() == 0
    assert ranking.numbered(x.where("id < 0"), "n", v, i).count() == 0


def test_metrics_go_over_the_stretches_of_a_ranking(spark, monkeypatch):
    rows = [(1, p, p % 3 == 0 or p > 40) for p in range(1, 51)] + [(2, p, p == 7) for p in range(1, 20)]
    x = spark.createDataFrame(rows, "g int, position int, positive boolean")
    whole = sorted(tuple(r) for r in K.list_metrics(x, ["g"]).collect())
    monkeypatch.setattr(K, "STRETCH", 6)
    assert whole == [pytest.approx(tuple(r)) for r in sorted(K.list_metrics(x, ["g"]).collect())] and whole[1][2] == pytest.approx(1 / 7)


def test_margins_take_any_number_of_references(spark):
    rng = np.random.default_rng(2)
    v = rng.random((20_500, 2)).round(3)
    refs = spark.createDataFrame([(k % 5, float(k), k % 3 == 0, v[k].tolist()) for k in range(len(v))], "s int, t double, positive boolean, v array<double>")
    rows = [(s, k, float(40 * k), [0.1 * k, 0.3]) for k in range(40) for s in (k % 5, 9)]
    got = matching.reference_margins(spark.createDataFrame(rows, "s int, id long, t double, v array<double>"), refs, "s", matching.mean_apart, 3, blocks=4, quarantine=5.0, duration=20_500.0)
    want = {}
    at = lambda t: min(3, int(t // 5125))
    by_edge = lambda t: abs(t - at(t) * 5125) <= 5 or abs((at(t) + 1) * 5125 - t) <= 5
    for s, i, t, x in rows:
        d = np.abs(v - x).mean(1)
        gone = np.array([k % 5 == s and (abs(k - t) <= 6 or at(k) == at(t) or (abs(at(k) - at(t)) == 1 and (by_edge(k) or by_edge(t)))) for k in range(len(v))])
        want[s, i] = [np.sort(d[~gone & ((np.arange(len(v)) % 3 == 0) == kind)])[:3].mean() for kind in (True, False)]
    found = {(r.s, r.id): [r.positive, r.negative] for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_as_of_joins_and_triggers_sort_in_many_parts(spark):
    from moments.operators import machines as M
    from moments.operators.groups import many

    x = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").cast("double").alias("t"))
    assert ranges.nearest(x, x.withColumnRenamed("t", "u"), "k").rdd.getNumPartitions() == many(x)
    rows = x.select(F.col("k").alias("src"), "t", F.lit(0).alias("ord"), F.lit("frame").alias("kind"), F.col("t").cast("long").alias("id"), F.array(*[F.lit(0.0)] * 6).alias("a"))
    assert M.triggers(rows, "src").rdd.getNumPartitions() == many(x)


def test_a_slice_of_a_stream_is_many_files_with_a_source_in_one(spark, tmp_path, monkeypatch):
    from moments.plans import q_machines as Q

    monkeypatch.setattr(Q, "_shared", lambda spark: str(tmp_path))
    x = spark.range(5000).select((F.col("id") % 100).alias("src"), F.floor(F.col("id") / 100).alias("k"), "id")
    Q._slices(spark, x, "slices")
    slice_ = F.when(F.col("id") < 2000, 0).when(F.col("id") < 4500, 1).otherwise(2)
    rows = spark.read.parquet(f"{tmp_path}/slices-*").withColumns({"file": F.input_file_name(), "slice": slice_})
    assert rows.count() == 5000 and rows.groupBy("slice", "src").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    assert rows.groupBy("slice").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 3
