"""Functions against the published cases and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moments.functions import policies as P
from moments.functions import scalars as S
from moments.functions import vectors as V

AUDIO = "id int, rms double, peak double, crossing double, baseline double, recent double, sensitivity string, want boolean"
IMPACTS = [
    (1, 0.06, 0.30, 0.12, 0.008, 0.008, "normal", True), (2, 0.02, 0.10, 0.09, 0.008, 0.008, "normal", True), (3, 0.05, 0.10, 0.05, 0.03, 0.05, "quiet", False),
    (4, 0.004, 0.02, 0.02, 0.008, 0.008, "noisy", False), (5, 0.012, 0.075, 0.07, 0.005, 0.005, "automatic", True), (6, 0.012, 0.075, 0.07, 0.03, 0.03, "automatic", False),
]


def test_impacts(spark):
    rows = S.detect_impact(spark.createDataFrame(IMPACTS, AUDIO), S.thresholds(spark)).collect()
    assert all(r.is_triggered == r.want for r in rows)
    assert next(r.confidence for r in rows if r.id == 3) == 0
    for r in rows:
        score, fired, sure = S.detect_one(r.rms, r.peak, r.crossing, r.baseline, r.recent, r.sensitivity)
        assert (fired, pytest.approx(sure)) == (r.is_triggered, r.confidence) and score == pytest.approx(r.score)


def _swing(version, triggered, audio, motion, pose, ref, needs_pose, frame, ready, tracked=None):
    return (version, triggered, *audio, *motion, *pose, ref, needs_pose, frame, ready, tracked)


LOUD, WEAK, FAINT = (0.06, 0.30, 0.12), (0.0313, 0.1419, 0.1584), (0.02, 0.10, 0.05)
DOWN, REST, NONE = ("downswing", 0.9, 1.0), ("addressed", 0.28, None), ("seekingAddress", 0.0, None)
NOPOSE, POSED = (None, None, None, None), ("impactWindow", 0.9, 0.8, 1.5)
EARLY = ("impactWindow", 0.85, 0.0, 0.5)
SWINGS = [
    (_swing("0.7.0", True, LOUD, REST, NOPOSE, 1.0, False, True, False), False),
    (_swing("0.6.0", False, LOUD, DOWN, NOPOSE, 1.1, False, True, False), False),
    (_swing("0.7.0", False, WEAK, REST, EARLY, 0.2, True, True, False), True),
    (_swing("0.7.0", False, WEAK, REST, NOPOSE, 0.2, False, True, False), False),
    (_swing("0.6.0", False, WEAK, REST, EARLY, 0.2, True, True, False), False),
    (_swing("0.7.0", True, LOUD, DOWN, NOPOSE, 1.1, False, True, False), True),
    (_swing("0.7.0", True, LOUD, ("downswing", 0.9, 0.5), NOPOSE, 1.0, False, True, False), False),
    (_swing("0.7.0", True, LOUD, NONE, NOPOSE, 1.0, False, False, False), False),
    (_swing("0.6.0", True, LOUD, NONE, NOPOSE, 1.0, False, False, False), True),
    (_swing("0.7.0", True, LOUD, NONE, NOPOSE, 1.0, False, False, True), False),
    (_swing("0.7.0", True, LOUD, REST, POSED, 1.0, True, True, False), True),
    (_swing("0.5.0", True, LOUD, REST, POSED, 1.0, True, True, False), False),
    (_swing("0.7.0", True, FAINT, DOWN, NOPOSE, 1.1, False, True, True), False),
    (_swing("0.7.0", True, (0.06, 0.20, 0.12), DOWN, NOPOSE, 1.1, False, True, True), True),
    (_swing("0.7.0", True, LOUD, DOWN, NOPOSE, 1.1, False, True, False, False), False),
    (_swing("0.6.0", True, LOUD, DOWN, NOPOSE, 1.1, False, True, False, False), True),
]
SWING_SCHEMA = """version string, triggered boolean, rms double, peak double, crossing double, motion_phase string, motion_conf double, impact_t double, pose_phase string, pose_conf double, win_start double,
win_end double, ref_t double, needs_pose boolean, recent_frame boolean, ready_prompt boolean, tracked boolean, want boolean"""


def test_swing_cases(spark):
    df = spark.createDataFrame([(*x, want) for x, want in SWINGS], SWING_SCHEMA)
    assert [(r.want, r.fires) for r in P.swing_trigger(df, P.model_versions(spark)).collect() if r.want != r.fires] == []


def _putt(**change):
    base = {"version": "0.7.0", "phase": "confirmedStroke", "conf": 0.85, "t": 1.6, "pose": 0.9, "age": 0.1, "frame": 0.1, "stable": 5.0, "ready": True, "prompt": False, "pending": False}
    return tuple((base | change).values())


PUTTS = [
    (_putt(), True), (_putt(age=0.5, frame=0.5), True), (_putt(version="0.6.0", age=0.5, frame=0.5), False), (_putt(conf=0.71), False), (_putt(pose=0.71), False), (_putt(age=0.56), False), (_putt(frame=0.56), False),
    (_putt(stable=0.9), False), (_putt(ready=False), False), (_putt(prompt=True), False), (_putt(pending=True), False), (_putt(version="0.5.1"), False), (_putt(phase=None, conf=None, t=None), False), (_putt(phase="forwardStroke", t=None), False),
]


def test_putt_cases(spark):
    schema = "version string, stroke_phase string, stroke_conf double, stroke_t double, pose_conf double, pose_age double, frame_age double, stable_for double, ready boolean, ready_prompt boolean, pending boolean, want boolean"
    df = spark.createDataFrame([(*x, want) for x, want in PUTTS], schema)
    assert [r.want for r in P.putt_trigger(df, P.model_versions(spark)).collect()] == [r.fires for r in P.putt_trigger(df, P.model_versions(spark)).collect()]


def test_lineage_flags_never_go_back(spark):
    rows = [tuple(r)[3:] for r in P.model_versions(spark).orderBy("version").collect()]
    assert len(rows) == 9 and all(a <= b for x, y in zip(rows, rows[1:], strict=False) for a, b in zip(x, y, strict=True))


def test_non_finite_figures_are_refused(spark):
    bad = [math.nan, math.inf, -math.inf, None, -0.1, 1.1]
    df = spark.createDataFrame([(x,) for x in [*bad, 0.0, 1.0]], "x double")
    assert [r.u for r in df.select(P.unit(F.col("x")).alias("u")).collect()] == [False] * 6 + [True] * 2
    reason = P.photo_reason(F.lit(1), F.lit(3), F.col("x"), F.lit(0.5), F.lit(10), F.lit(None).cast("double"))
    assert {r.r for r in df.limit(6).select(reason.alias("r")).collect()} == {"nonFiniteOrOutOfRangeSharpness"}


def test_warped_distance(spark):
    rng = np.random.default_rng(3)
    pairs = [(rng.random((int(n), 2)), rng.random((int(m), 2))) for n, m in rng.integers(1, 9, (20, 2))]
    rows = [(k, *a.T.tolist(), *b.T.tolist()) for k, (a, b) in enumerate(pairs)] + [(90, [], [], [1.0], [1.0]), (91, None, None, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "k int, ax array<double>, ay array<double>, bx array<double>, by array<double>")
    got = {r.k: r.d for r in df.select("k", V.warped_distance("ax", "ay", "bx", "by").alias("d")).collect()}
    assert math.isinf(got[90]) and got[91] is None
    for k, (a, b) in enumerate(pairs):
        g = np.full((len(a) + 1, len(b) + 1), np.inf)
        g[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                g[i + 1, j + 1] = np.hypot(*(a[i] - b[j])) + min(g[i, j + 1], g[i + 1, j], g[i, j])
        assert got[k] == pytest.approx(g[-1, -1] / (len(a) + len(b)))


def test_region_and_shift(spark):
    df = spark.createDataFrame([([float(k) for k in range(64)], [1.0, 2.0, 3.0], [2.0, 3.0, 9.0])], "g array<double>, a array<double>, b array<double>")
    r = df.select(V.region(F.col("g"), 8, 8).alias("g"), V.shifted_distance(F.col("a"), F.col("b"), lambda x, y: F.abs(x - y)).alias("d")).first()
    assert r.g == [float(y * 8 + x) for y in range(3, 8) for x in range(2, 6)] and r.d == 0.0


def test_pixels():
    from moments.functions import pixels

    flat = np.full((64, 64, 3), 128.0)
    sharp, expo, tiles, hist = pixels.describe(flat)
    assert (sharp, expo) == (0, 1) and tiles == pytest.approx([128 / 255] * 64) and sum(hist) == pytest.approx(3)
    spot = flat.copy()
    spot[10:14, 10:14] = 255
    ssim, worst, mad, most = pixels.agree(flat, spot)
    assert worst < ssim <= 1 and mad < 0.01 and most == pytest.approx(127 / 255)
    assert pixels.agree(flat, flat)[0] == pytest.approx(1)
