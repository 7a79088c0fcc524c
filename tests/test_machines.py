"""The state machines against the published sequences, and streams against batch."""

import math

import pytest
from pyspark.sql import functions as F

from moments.operators import machines as M
from moments.plans import q_machines
from moments.plans import testdata as T

D = "/root/testdata/sf0.001"


def putt(xs, core=None, **k):
    m = M.Putt(**k)
    for n, x in enumerate(xs):
        got = m.observe(n * 0.2, x, 0.0, (core or {}).get(n, 0.5), 0.5, 0.2, 0.9)
    return m, got


REST = [0.0] * 4
STROKE = [*REST, 0.10, 0.25, 0.30, 0.22, 0.08, -0.06, -0.10]


def test_putts():
    m, got = putt(STROKE)
    assert got[0] == "confirmedStroke" and got[1] >= 0.72 and got[2] == pytest.approx(1.6)
    assert m.latched(2.1) and m.latched(2.55) and not m.latched(2.61) and not m.latched(2.55)
    m, _ = putt(STROKE, hold=0.35)
    assert m.latched(2.3) and not m.latched(2.4)
    m, _ = putt(STROKE)
    m.consume()
    assert m.latched(2.1) is None
    for xs, phase in (([0.0] * 20, "addressed"), ([*REST, 0.04], "addressed"), ([*REST, 0.1, 0.4, 0.7, -0.06, -0.1], "seekingAddress"), ([*REST, 0.1, 0.3, 0.5, 0.02], "seekingAddress"), ([*STROKE[:9], -0.5], "seekingAddress")):
        m, got = putt(xs)
        assert got[0] == phase and m.latch is None
    assert putt([*REST, 0.10, 0.25], {5: 0.7})[1][0] == "seekingAddress"
    assert putt([math.nan if k == 2 else x for k, x in enumerate(STROKE)])[1][0] != "confirmedStroke"


def swing(xs, times, conf=0.9):
    m = M.Swing()
    for t, x in zip(times, xs, strict=True):
        got = m.observe(t, x, 0.0, 0.5, 0.5, 0.2, conf)
    return m, got


TIMES = [0.0, 0.3, 0.6, 0.8, 1.0, 1.2, 1.4]


def test_swings():
    m, got = swing([0, 0, 0, 0.25, 0.5, 0.35, 0.15], TIMES)
    assert got[0] == "impactWindow" and got[1] >= 0.72 and got[2:] == (pytest.approx(0.95), pytest.approx(1.70))
    assert m.signal(1.0)[0] == "impactWindow" and m.signal(0.94)[0] == m.signal(1.71)[0] == "seekingAddress"
    assert swing([0, 0, 0, 0.25, 0.5, 0.35, 0.15], TIMES, 0.3)[1][0] == "seekingAddress"
    assert swing([0, 0, 0, 0.25, 0.5, 0.55], TIMES[:6])[1][0] == "backswing"
    assert swing([0, 0, 0, 0.25], [0, 0.3, 0.6, 1.21])[1][0] == "seekingAddress" and swing([0, 0, 0, 0.25], [0, 0.3, 0.6, 1.2])[1][0] == "backswing"


def motion(samples):
    m = M.Motion()
    for t, local, whole, wide in samples:
        got = m.observe(t, local, whole, wide, 0.6, 0.02, 1)
    return m, got


def test_motion():
    start = [(t, 0.05, 0.04, 0.2) for t in (0.0, 0.3, 0.6)]
    rise = [(0.8, 0.13, 0.04, 0.2), (0.95, 0.15, 0.04, 0.2), (1.12, 0.18, 0.04, 0.2), (1.3, 0.27, 0.04, 0.2)]
    _, got = motion(start + rise)
    assert got[0] == "downswing" and got[1] >= 0.72 and got[2] == 1.3
    m, got = motion([*start, (0.8, 0.4, 0.2, 0.8), (0.9, 0.5, 0.22, 0.82)])
    assert got == ("seekingAddress", 0.0, None) and m.changed == 0.9 and m.phase == "seekingAddress"
    assert motion([(t / 100, x, 0.04, 0.2) for t, x in ((0, 0.13), (15, 0.15), (30, 0.18), (45, 0.27))])[1][0] == "seekingAddress"


def test_state_survives_as_text():
    m = M.Putt()
    for n, x in enumerate(STROKE):
        m = M.Putt.load(m.dump())
        got = m.observe(n * 0.2, x, 0.0, 0.5, 0.5, 0.2, 0.9)
    assert got[0] == "confirmedStroke" and M.Putt.load(m.dump()) == m
    t = M.Trigger()
    t.step("frame", 0.0, [0.05, 0.04, 0.2, 0.6, 0.02, 1])
    assert M.Trigger(t.dump()).dump() == t.dump()


def test_body():
    m = M.Body()
    seen = [m.observe(k * 0.2, 0, 0, 0.5, 0.5, 0.2, 0.9)[0] for k in range(5)]
    assert seen == [False, False, False, True, True] and m.tracked(1.1) and not m.tracked(1.2)
    assert m.observe(1.0, 0, 0, 0.7, 0.5, 0.2, 0.9) == (False,)


@pytest.mark.parametrize("name", ["swing", "putt", "body", "trigger"])
def test_streams_equal_batch(spark, name):
    from moments.streaming import machines as ST

    p = T.pose(spark, D)
    if name == "trigger":
        rows = q_machines._trigger_rows(spark, D).withColumn("k", (F.col("t") / 5).cast("long"))
        batch, stream = M.triggers(rows.drop("k"), "src"), ST.trigger_stream(q_machines._slices(spark, rows, name), "src")
    else:
        from moments.operators.windows import body_tracked

        make = {"swing": (M.swing_signals, ST.swing_stream), "putt": (M.putt_signals, ST.putt_stream), "body": (None, ST.body_stream)}[name]
        stream = make[1](q_machines._slices(spark, p, name), "src")
        batch = body_tracked(p, "src").select("src", "id", "t", "tracked") if name == "body" else make[0](p, "src")
        if name == "body":  # batch answers for good samples only
            stream_rows = {r.id: r.tracked for r in ST.finish(stream, q_machines._shared(spark)).collect()}
            assert all(stream_rows[r.id] == r.tracked for r in batch.collect())
            return
    got = ST.finish(stream, q_machines._shared(spark))
    norm = lambda df: sorted(tuple(repr(v) for v in r) for r in df.select(*sorted(batch.columns)).collect())
    assert norm(got) == norm(batch) and got.count() > 0
