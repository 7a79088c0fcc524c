"""State machines over samples in time order: one step function each, driven in batch here and on streams in ``moments.streaming``.

A machine is a dataclass of plain numbers and texts, so that its state can be kept anywhere. ``observe`` takes a sample and
gives the signal after it; ``signal`` gives the signal at another time without a sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moments.operators.groups import by_group, kind, many

c = F.col
NEVER = -math.inf
REST = ("seekingAddress", 0.0)


class Machine:
    KEPT: tuple[str, ...] = ()

    def reset(self) -> None:
        """Back to the start, but for what outlives it."""
        for f in fields(self):
            if f.name not in self.KEPT:
                setattr(self, f.name, f.default)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str | None):
        return cls(**json.loads(text)) if text else cls()


@dataclass
class Motion(Machine):
    """Rest, a local backswing, an accelerating downswing. Changes of the whole picture are no evidence, two in a row start afresh."""

    phase: str = "seekingAddress"
    changed: float = NEVER
    quiet: float | None = None
    since: float | None = None
    seen: int = 0
    began: float | None = None
    peak: float = 0.0
    moving: int = 0
    before: float = 0.0
    region: int | None = None
    hit: float | None = None
    shaken: int = 0
    KEPT = ("changed",)

    def observe(self, t: float, local: float, whole: float, widespread: float, focus: float, light: float, region: int) -> tuple[str, float, float | None]:
        if whole >= 0.16 or widespread >= 0.68 or light >= 0.14:
            self.changed, self.shaken = t, self.shaken + 1
            if self.shaken >= 2:
                self.reset()
            return (*REST, None)
        self.shaken = 0
        getattr(self, "_" + self.phase)(t, local, whole, widespread, focus, region)
        return self.signal(t)

    def _seekingAddress(self, t, local, whole, widespread, focus, region):
        if local <= 0.075 and whole <= 0.08 and widespread <= 0.32:
            self.quiet = t if self.quiet is None else self.quiet
            if t - self.quiet >= 0.55:
                self.phase, self.since, self.seen = "addressed", None, 0
        else:
            self.quiet = None

    def _addressed(self, t, local, whole, widespread, focus, region):
        if local >= 0.12 and focus >= 0.38 and 0.04 <= widespread <= 0.58:
            if self.since is not None and t - self.since <= 0.35 and abs((region if self.region is None else self.region) - region) <= 1:
                self.seen += 1
            else:
                self.since, self.seen, self.region = t, 1, region
            if self.seen >= 2:
                self.phase, self.began, self.peak, self.moving, self.before = "backswing", self.since, local, self.seen, local
        elif local <= 0.085:
            self.since, self.seen, self.region = None, 0, None

    def _backswing(self, t, local, whole, widespread, focus, region):
        if self.began is None or t - self.began > 1.8 or (abs((region if self.region is None else self.region) - region) > 1 and local >= 0.18):
            self.reset()
            return
        self.moving += local >= 0.10
        faster, high = local - self.before, self.peak
        self.peak, self.before = max(high, local), local
        if t - self.began >= 0.18 and self.moving >= 3 and local >= 0.20 and (faster >= 0.035 or local >= max(0.26, high * 1.15)):
            self.phase, self.hit = "downswing", t

    def _downswing(self, t, local, whole, widespread, focus, region):
        if self.hit is not None and t - self.hit > 0.42:
            self.reset()

    def signal(self, t: float) -> tuple[str, float, float | None]:
        if self.phase == "downswing":
            if self.hit is None or not 0 <= t - self.hit <= 0.42 or self.changed >= self.hit:
                return (*REST, None)
            return "downswing", max(0.72, min(1.0, 0.62 + self.peak * 0.95)), self.hit
        if self.phase == "backswing":
            return "backswing", min(0.7, 0.34 + self.peak), None
        return self.phase, 0.28 if self.phase == "addressed" else 0.0, None


def _good(conf: float, scale: float) -> bool:
    return conf >= 0.45 and scale >= 0.04


@dataclass
class Swing(Machine):
    """Rest, the hands leave it along one line, come back fast; the impact was shortly before or after that."""

    phase: str = "seekingAddress"
    quiet: float | None = None
    x: float = 0.0
    y: float = 0.0
    rested: int = 0
    last: list | None = None
    dx: float = 0.0
    dy: float = 0.0
    began: float | None = None
    peak: float = 0.0
    before: float = 0.0
    returning: int = 0
    start: float | None = None
    end: float | None = None
    sure: float = 0.0

    def observe(self, t: float, hx: float, hy: float, cx: float, cy: float, scale: float, conf: float) -> tuple[str, float, float | None, float | None]:
        if not _good(conf, scale):
            return self.signal(t)
        self.sure = conf
        if self.last is not None:
            gap = t - self.last[0]
            if gap <= 0 or gap > 0.6 or abs(scale - self.last[5]) / max(0.001, self.last[5]) > 0.25:
                self.reset()
        last, sample = self.last, [t, hx, hy, cx, cy, scale]
        getattr(self, "_" + self.phase)(sample, last)
        self.last = sample
        return self.signal(t)

    def _seekingAddress(self, s, last):
        t, hx, hy, cx, cy, scale = s
        if last is None:
            self.x, self.y, self.rested = hx, hy, 1
            return
        dt = max(0.05, t - last[0])
        if math.hypot(hx - last[1], hy - last[2]) / dt <= 0.22 and math.hypot(cx - last[3], cy - last[4]) / dt / max(0.04, scale) <= 0.20:
            self.quiet = last[0] if self.quiet is None else self.quiet
            self.rested += 1
            share = 1.0 / self.rested
            self.x, self.y = self.x + (hx - self.x) * share, self.y + (hy - self.y) * share
            if t - self.quiet >= 0.55 and self.rested >= 3:
                self.phase = "addressed"
        else:
            self.quiet, self.x, self.y, self.rested = None, hx, hy, 1

    def _addressed(self, s, last):
        dx, dy = s[1] - self.x, s[2] - self.y
        far = math.hypot(dx, dy)
        if far >= 0.20:
            self.dx, self.dy, self.began, self.peak, self.before, self.returning, self.phase = dx / far, dy / far, s[0], far, far, 0, "backswing"

    def _backswing(self, s, last):
        t = s[0]
        if self.began is None or t - self.began > 1.8:
            self.reset()
            return
        far = (s[1] - self.x) * self.dx + (s[2] - self.y) * self.dy
        self.peak = max(self.peak, far)
        speed = (self.before - far) / max(0.05, t - (last[0] if last else t - 0.2))
        if t - self.began >= 0.18 and self.peak >= 0.28 and far < self.before and speed >= 0.55:
            self.returning += 1
        elif far >= self.before:
            self.returning = 0
        self.before = far
        if self.returning >= 2 and self.peak - far >= max(0.18, self.peak * 0.55):
            self.phase, self.start, self.end = "impactWindow", t - 0.45, t + 0.30

    def _impactWindow(self, s, last):
        if self.end is not None and s[0] > self.end:
            self.reset()

    def signal(self, t: float) -> tuple[str, float, float | None, float | None]:
        if self.phase == "impactWindow":
            if self.start is None or not self.start <= t <= self.end:
                return (*REST, None, None)
            return "impactWindow", min(self.sure, min(1.0, 0.72 + self.peak * 0.45)), self.start, self.end
        if self.phase == "backswing":
            return "backswing", min(0.7, 0.35 + self.peak), None, None
        return self.phase, 0.32 if self.phase == "addressed" else 0.0, None, None


@dataclass
class Putt(Machine):
    """Rest, a short way back, slowly through the address, a short follow-through. Larger, faster or walking movements start afresh.

    A confirmed stroke can be read for ``hold`` seconds unless it is consumed, and none is confirmed within two seconds of
    another.
    """

    phase: str = "seekingAddress"
    confirmed: float = NEVER
    quiet: float | None = None
    x: float = 0.0
    y: float = 0.0
    rested: int = 0
    last: list | None = None
    dx: float = 0.0
    dy: float = 0.0
    began: float | None = None
    peak: float = 0.0
    before: float = 0.0
    returning: int = 0
    following: int = 0
    stroke: float | None = None
    least: float = 1.0
    latch: list | None = None
    hold: float = 0.60
    KEPT = ("confirmed", "hold")

    def observe(self, t: float, hx: float, hy: float, cx: float, cy: float, scale: float, conf: float) -> tuple[str, float, float | None]:
        if not _good(conf, scale):
            return self.signal()
        if self.last is not None:
            gap = t - self.last[0]
            if gap <= 0 or gap > 0.6 or abs(scale - self.last[5]) / max(0.001, self.last[5]) > 0.25:
                self.reset()
        last, self.last = self.last, [t, hx, hy, cx, cy, scale]
        dt = max(0.05, t - last[0]) if last else 0.2
        walk = math.hypot(cx - last[3], cy - last[4]) / dt / max(0.04, scale) if last else 0.0
        if walk > 0.9:
            sample = self.last
            self.reset()
            self.last = sample
            return self.signal()
        self.least = min(self.least, conf)
        getattr(self, "_" + self.phase)(t, hx, hy, conf, last, dt, walk)
        return self.signal()

    def _seekingAddress(self, t, hx, hy, conf, last, dt, walk):
        speed = math.hypot(hx - last[1], hy - last[2]) / dt if last else 0.0
        if last is None or (speed <= 0.25 and walk <= 0.20):
            self.quiet = (last[0] if last else t) if self.quiet is None else self.quiet
            self.rested += 1
            share = 1.0 / self.rested
            self.x, self.y = self.x + (hx - self.x) * share, self.y + (hy - self.y) * share
            if t - self.quiet >= 0.60 and self.rested >= 3:
                self.phase, self.least = "addressed", conf
        else:
            self.quiet, self.rested, self.x, self.y = None, 1, hx, hy

    def _addressed(self, t, hx, hy, conf, last, dt, walk):
        dx, dy = hx - self.x, hy - self.y
        far = math.hypot(dx, dy)
        if far >= 0.06:
            self.dx, self.dy, self.began, self.peak, self.before, self.returning, self.phase = dx / far, dy / far, t, far, far, 0, "backswing"

    def _along(self, hx: float, hy: float) -> float:
        return (hx - self.x) * self.dx + (hy - self.y) * self.dy

    def _backswing(self, t, hx, hy, conf, last, dt, walk):
        far = self._along(hx, hy)
        self.peak = max(self.peak, far)
        speed, through = (self.before - far) / dt, max(0.04, self.peak * 0.30)
        if self.began is None or t - self.began > 2.0 or self.peak > 0.60 or (far <= through and speed > 1.5):
            self.reset()
            return
        if t - self.began >= 0.15 and self.peak >= 0.12 and far < self.before and speed >= 0.20:
            self.returning += 1
        elif far >= self.before:
            self.returning = 0
        self.before = far
        if self.returning >= 2 and far <= through:
            self.phase, self.stroke, self.following = "forwardStroke", t, 0

    def _forwardStroke(self, t, hx, hy, conf, last, dt, walk):
        far = self._along(hx, hy)
        if self.stroke is None or t - self.stroke > 0.9 or far <= -max(0.30, self.peak * 1.2):
            self.reset()
            return
        self.following += far <= -max(0.025, self.peak * 0.15)
        self.before = far
        if self.following >= 2 and t - self.confirmed >= 2.0:
            self.phase, self.confirmed = "confirmedStroke", t
            self.latch = [min(self.least, min(1.0, 0.62 + self.peak * 0.9)), self.stroke]

    def _confirmedStroke(self, t, hx, hy, conf, last, dt, walk):
        sample, latch = self.last, self.latch
        self.reset()
        self.last, self.latch = sample, latch

    def latched(self, now: float) -> tuple[float, float] | None:
        """Confidence and time of the stroke that can still be read; one too old is dropped."""
        if self.latch is not None and now - self.confirmed > self.hold:
            self.latch = None
        return tuple(self.latch) if self.latch else None

    def consume(self) -> None:
        self.latch = None

    def signal(self, t: float | None = None) -> tuple[str, float, float | None]:
        if self.phase == "confirmedStroke":
            return ("confirmedStroke", *(self.latch or (0.0, None)))
        if self.phase == "forwardStroke":
            return "forwardStroke", min(0.7, 0.4 + self.peak), None
        if self.phase == "backswing":
            return "backswing", min(0.6, 0.3 + self.peak), None
        return self.phase, 0.3 if self.phase == "addressed" else 0.0, None


@dataclass
class Levels(Machine):
    """Slow and fast exponential averages of the score: the room's level, which takes scores up to 1 only, and the level just before."""

    baseline: float = 0.012
    recent: float = 0.012

    def observe(self, score: float) -> tuple[float, float]:
        self.baseline = self.baseline * 0.985 + min(1.0, max(0.0, score)) * 0.015
        self.recent = self.recent * 0.72 + score * 0.28
        return self.baseline, self.recent


@dataclass
class Body(Machine):
    """Whether one body has been seen without a break over the last moments and stayed where it is."""

    seen: list | None = None

    def observe(self, t: float, hx: float, hy: float, cx: float, cy: float, scale: float, conf: float) -> tuple[bool]:
        if all(map(math.isfinite, (t, hx, hy, cx, cy, scale, conf))) and _good(conf, scale):
            kept = self.seen or []
            if kept and not 0 < t - kept[-1][0] <= 0.6:
                kept = []
            self.seen = [s for s in kept if t - s[0] <= 1.2] + [[t, cx, cy, scale]]
        return (self.tracked(t),)

    def tracked(self, t: float) -> bool:
        recent = [s for s in self.seen or [] if t - s[0] <= 1.2]
        if len(recent) < 3 or not 0 <= t - recent[-1][0] <= 0.35 or recent[-1][0] - recent[0][0] < 0.55:
            return False
        return all(math.hypot(a[1] - b[1], a[2] - b[2]) / max(0.04, min(a[3], b[3])) <= 0.75 for k, a in enumerate(recent) for b in recent[k + 1 :])


MOTION_COLUMNS = ("t", "local", "global", "widespread", "conc", "bright", "region")
POSE_COLUMNS = ("t", "hand_x", "hand_y", "core_x", "core_y", "scale", "conf")
MOTION_OUT = "phase string, confidence double, impact_t double"
SWING_OUT = "phase string, confidence double, win_start double, win_end double"
PUTT_OUT = "phase string, confidence double, stroke_t double"


def _drive(samples: DataFrame, key: str, columns: tuple[str, ...], make: Callable[[], Machine], out: str) -> DataFrame:
    n = len(columns)

    def run(rows: list[tuple]) -> list[tuple]:
        machine = make()
        return [(r[0], r[1], r[2], *machine.observe(*r[4 : 4 + n])) for r in rows]

    x = samples.select(key, "id", "t", "_s", *[F.col(v).alias(f"v{k}") for k, v in enumerate(columns)])
    return by_group(x, [key, "_s"], ["t", "id"], run, f"{key} {kind(x, key)}, id long, t double, {out}")


def _pieces(samples: DataFrame, key: str, new: Column) -> DataFrame:
    """Numbers the pieces of each key that begin where ``new`` holds; what comes before can't matter there."""
    w = Window.partitionBy(key).orderBy("t", "id")
    x = samples.withColumn("_new", F.coalesce(new(w).cast("int"), F.lit(0)))
    return x.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def motion_signals(samples: DataFrame, key: str) -> DataFrame:
    """key, id, t, phase, confidence, impact_t after each sample (key, id, t, local, global, widespread, conc, bright, region).

    Two changes of the whole picture in a row start afresh, so the series is cut after them.
    """
    shaken = (c("global") >= 0.16) | (c("widespread") >= 0.68) | (c("bright") >= 0.14)
    x = _pieces(samples.withColumn("_g", shaken), key, lambda w: ~c("_g") & F.lag("_g").over(w) & F.lag("_g", 2).over(w))
    return _drive(x, key, MOTION_COLUMNS, Motion, MOTION_OUT)


@dataclass
class _MotionState(Motion):
    def observe(self, *sample):
        super().observe(*sample)
        return self.phase, self.peak, self.hit, self.changed


def motion_states(samples: DataFrame, key: str) -> DataFrame:
    """key, id, t and what ``motion_signal_at`` needs to know the signal later: phase, peak, hit, changed."""
    shaken = (c("global") >= 0.16) | (c("widespread") >= 0.68) | (c("bright") >= 0.14)
    x = _pieces(samples.withColumn("_g", shaken), key, lambda w: ~c("_g") & F.lag("_g").over(w) & F.lag("_g", 2).over(w))
    return _drive(x, key, MOTION_COLUMNS, _MotionState, "phase string, peak double, hit double, changed double")


def swing_signals(samples: DataFrame, key: str) -> DataFrame:
    """key, id, t, phase, confidence, win_start, win_end after each sample (key, id, t, hand_x, hand_y, core_x, core_y, scale, conf).

    A gap of over 0.6 s between good samples starts afresh; where any samples are so far apart the series is cut, if the
    first after the gap is a good one.
    """
    x = _pieces(samples, key, lambda w: (c("t") - F.lag("t").over(w) > 0.6) & (c("conf") >= 0.45) & (c("scale") >= 0.04))
    return _drive(x, key, POSE_COLUMNS, Swing, SWING_OUT)


def putt_signals(samples: DataFrame, key: str, hold: float = 0.60) -> DataFrame:
    """key, id, t, phase, confidence, stroke_t after each sample. Cut like swings, at gaps of over 2 s, after which the last stroke forbids nothing any more."""
    x = _pieces(samples, key, lambda w: (c("t") - F.lag("t").over(w) > 2.0) & (c("conf") >= 0.45) & (c("scale") >= 0.04))
    return _drive(x, key, POSE_COLUMNS, lambda: Putt(hold=hold), PUTT_OUT)


def levels(scores: DataFrame, key: str) -> DataFrame:
    """key, id, t, baseline, recent after each score (key, id, t, score). An average never forgets, so a key is one series."""
    return _drive(scores.withColumn("_s", F.lit(0)), key, ("score",), Levels, "baseline double, recent double").select(key, "id", "t", "baseline", "recent")


def latch_reads(events: DataFrame, key: str, hold: float = 0.60) -> DataFrame:
    """key, id, t, confidence, stroke_t of what can be read at the ``read`` events, in time order with the samples and ``consume`` events (column op).

    At equal times samples come first, then reads, then what consumes.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rank = rows["op"].map({"sample": 0, "read": 1, "consume": 2})
        rows, machine, out = rows.assign(o=rank).sort_values(["t", "o", "id"]), Putt(hold=hold), []
        for k, op, i, *x in rows[["k", "op", "id", *POSE_COLUMNS]].itertuples(index=False):
            if op == "sample":
                machine.observe(*x)
            elif op == "consume":
                machine.consume()
            else:
                out.append((k, i, x[0], *(machine.latched(x[0]) or (None, None))))
        return pd.DataFrame(out, columns=["k", "id", "t", "confidence", "stroke_t"])

    x = events.select(F.col(key).alias("k"), "op", "id", *POSE_COLUMNS)
    return x.groupBy("k").applyInPandas(run, f"k {x.schema['k'].dataType.simpleString()}, id long, t double, confidence double, stroke_t double").withColumnRenamed("k", key)


def motion_signal_at(phase: Column, peak: Column, hit: Column, changed: Column, t: Column) -> Column:
    """phase, confidence, impact_t of a kept state of the motion machine at another time."""
    none = F.lit(None).cast("double")
    valid = F.coalesce((t >= hit) & (t - hit <= 0.42) & (changed < hit), F.lit(False))
    rest = F.struct(F.lit("seekingAddress").alias("phase"), F.lit(0.0).alias("confidence"), none.alias("impact_t"))
    down = F.struct(F.lit("downswing").alias("phase"), F.greatest(F.lit(0.72), F.least(F.lit(1.0), 0.62 + peak * 0.95)).alias("confidence"), hit.alias("impact_t"))
    back = F.struct(F.lit("backswing").alias("phase"), F.least(F.lit(0.7), 0.34 + peak).alias("confidence"), none.alias("impact_t"))
    ready = F.struct(F.lit("addressed").alias("phase"), F.lit(0.28).alias("confidence"), none.alias("impact_t"))
    return F.when((phase == "downswing") & valid, down).when(phase == "backswing", back).when(phase == "addressed", ready).otherwise(rest)


def fused_signals(sounds: DataFrame, states: DataFrame, swings: DataFrame, key: str) -> DataFrame:
    """Adds motion_phase, motion_conf, impact_t, pose_phase, pose_conf, win_start, win_end to sounds (key, id, t, ...).

    The last motion state (``motion_states``) and swing signal at or before each sound are looked up, and what they mean at
    the sound's own time is worked out from them.
    """
    from moments.operators.ranges import backward_asof

    kept = states.select(key, F.col("t").alias("u"), F.struct("id", "phase", "peak", "hit", "changed").alias("_m"))
    pose = swings.select(key, F.col("t").alias("u"), F.struct("id", "phase", "confidence", "win_start", "win_end").alias("_w"))
    x = backward_asof(backward_asof(sounds, kept, key, "_m"), pose, key, "_w")
    x = x.withColumn("_s", motion_signal_at(c("_m")["phase"], c("_m")["peak"], c("_m")["hit"], c("_m")["changed"], c("t")))
    x = x.withColumns({"motion_phase": c("_s")["phase"], "motion_conf": c("_s")["confidence"], "impact_t": c("_s")["impact_t"], "pose_phase": c("_w")["phase"], "pose_conf": c("_w")["confidence"]})
    return x.withColumns({"win_start": c("_w")["win_start"], "win_end": c("_w")["win_end"]}).drop("_m", "_w", "_s")


def suffix_confirmations(samples: DataFrame, key: str, label: str) -> DataFrame:
    """label, total, confirmed of labelled clips (key, label, id, t, pose): whether a stroke is confirmed from any of its samples on. A clip is one group."""

    def run(rows: list[tuple]) -> list[tuple]:
        found = False
        for start in range(len(rows)):
            machine = Putt()
            found = any(machine.observe(*r[3:])[0] == "confirmedStroke" and machine.latch is not None for r in rows[start:])
            if found:
                break
        return [(rows[0][1], found)]

    x = samples.select(key, F.col(label).alias("label"), "id", *POSE_COLUMNS)
    clips = by_group(x, [key], ["t", "id"], run, "label string, ok boolean")
    return clips.groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("confirmed"))


class Trigger:
    """All signals of one source: levels and impact of sounds, motion, swing and putt; says when to fire. State is four machines and two times."""

    PARTS = (("levels", Levels), ("motion", Motion), ("swing", Swing), ("putt", Putt))

    def __init__(self, state: str | None = None):
        kept = json.loads(state) if state else {}
        for name, kind in self.PARTS:
            setattr(self, name, kind(**kept.get(name, {})))
        self.seen_pose, self.seen_frame, self.pose_conf = kept.get("times", (NEVER, NEVER, 0.0))

    def dump(self) -> str:
        return json.dumps({name: asdict(getattr(self, name)) for name, _ in self.PARTS} | {"times": (self.seen_pose, self.seen_frame, self.pose_conf)})

    def step(self, kind: str, t: float, a: list[float]) -> tuple[str, float] | None:
        """sound: rms, peak, crossing; frame: the motion columns after t; pose: the pose columns after t. Gives what fires (swing or putt) and how sure it is."""
        from moments.functions.scalars import detect_one

        if kind == "frame":
            self.seen_frame = t
            self.motion.observe(t, *a[:5], int(a[5]))
            return None
        if kind == "pose":
            if _good(a[5], a[4]):
                self.seen_pose, self.pose_conf = t, a[5]
            self.swing.observe(t, *a[:6])
            self.putt.observe(t, *a[:6])
            held = self.putt.latched(t)
            if held and held[0] >= 0.72 and self.pose_conf >= 0.72 and t - self.seen_pose <= 0.55 and t - self.seen_frame <= 0.55 and t - self.motion.changed >= 1.0:
                self.putt.consume()
                return "putt", held[0]
            return None
        rms, peak, crossing = a[:3]
        score, fired, sure = detect_one(rms, peak, crossing, self.levels.baseline, self.levels.recent)
        self.levels.observe(score)
        if t - self.seen_frame > 0.55:
            return None
        phase, conf, hit = self.motion.signal(t)
        aligned = phase == "downswing" and hit is not None and conf >= 0.72 and -0.20 <= t - hit <= 0.32
        pose = self.swing.signal(t)
        held = pose[0] == "impactWindow" and pose[1] >= 0.72 and pose[2] <= t <= pose[3]
        weak = peak >= 0.10 and score >= 0.065 and crossing >= 0.08 and peak / max(0.001, rms) >= 3.5
        return ("swing", sure) if (aligned or held) and (fired or weak) else None


def trigger_rows(source: str, audio: DataFrame, visual: DataFrame, pose: DataFrame) -> DataFrame:
    """source, t, ord, kind, id, a: the three inputs as one stream; of equal times frames come first, then poses, then sounds."""
    part = lambda df, kind, n, cols: df.select(source, "t", F.lit(n).alias("ord"), F.lit(kind).alias("kind"), "id", F.array(*[c(x).cast("double") for x in cols]).alias("a"))
    return part(visual, "frame", 0, MOTION_COLUMNS[1:]).unionByName(part(pose, "pose", 1, POSE_COLUMNS[1:])).unionByName(part(audio, "sound", 2, ("rms", "peak", "crossing")))


TRIGGER_OUT = "kind string, id long, t double, confidence double"


def triggers(rows: DataFrame, source: str) -> DataFrame:
    """source, kind (swing or putt), id of the row that fired, t, confidence of ``trigger_rows``; a source is one series, as its levels never end."""

    def run(some: list[tuple]) -> list[tuple]:
        machine, out = Trigger(), []
        for k, t, _, i, kind_, a in some:
            if fired := machine.step(kind_, t, a):
                out.append((k, fired[0], i, t, fired[1]))
        return out

    x = rows.select(source, "t", "ord", "id", "kind", "a")
    return by_group(x, [source], ["t", "ord", "id"], run, f"{source} {kind(x, source)}, {TRIGGER_OUT}", many(x))
