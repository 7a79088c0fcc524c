"""Features of moving windows over series (key, t, id, hand_x, hand_y, core_x, core_y, scale, conf).

A window's rows are gathered by a range frame, so a series is sorted once and nothing is joined; a window holds seconds of
samples, not the recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moments.functions.policies import shape_confidence, strict_shape
from moments.functions.vectors import total
from moments.operators.ranges import nearest

c = F.col
POSE = ("t", "id", "hand_x", "hand_y", "core_x", "core_y", "scale", "conf")


def windowed(samples: DataFrame, key: str, frames: dict[str, tuple[float, float]], fields: tuple[str, ...] = POSE, centers: DataFrame | None = None) -> DataFrame:
    """Adds to each center (key, t, ...) an array a frame: its samples from t + low to t + high, ends included, in order of the fields.

    Without centers each sample is one.
    """
    item = F.struct(*fields)
    both = samples.withColumn("_r", item) if centers is None else centers.unionByName(samples.select(key, "t", item.alias("_r")), allowMissingColumns=True)

    def bound(x: float) -> str:
        return f"{abs(x)!r}D {'preceding' if x < 0 else 'following'}"

    for name, (low, high) in frames.items():
        both = both.withColumn(name, F.expr(f"sort_array(collect_list(_r) over (partition by `{key}` order by t range between {bound(low)} and {bound(high)}))"))
    return (both if centers is None else both.where("_r is null")).drop("_r")


def _steps(rows: Column) -> Column:
    last = F.greatest(F.size(rows) - 1, F.lit(0))
    return F.zip_with(
        F.slice(rows, 1, last), F.slice(rows, 2, last),
        lambda a, b: F.struct((b["hand_x"] - a["hand_x"]).alias("dx"), F.hypot(b["hand_x"] - a["hand_x"], b["hand_y"] - a["hand_y"]).alias("far"), F.greatest(F.lit(0.05), b["t"] - a["t"]).alias("dt")),
    )


def _spread(rows: Column, name: str) -> Column:
    values = F.transform(rows, lambda r: r[name])
    return F.array_max(values) - F.array_min(values)


def stroke_features(rows: Column, minimum: int = 5, deadband: float = 0.004) -> Column:
    """n, range_x, range_y, path, core, peak, reversals, ratio of a window's rows; null for fewer than minimum.

    Steps are those between rows of the window. A reversal is a change of direction between two steps of at least deadband.
    """
    steps = _steps(rows)
    last = F.greatest(F.size(steps) - 1, F.lit(0))
    turn = F.zip_with(F.slice(steps, 1, last), F.slice(steps, 2, last), lambda a, b: ((F.abs(a["dx"]) >= deadband) & (F.abs(b["dx"]) >= deadband) & (a["dx"] * b["dx"] < 0)).cast("int"))
    wide, tall = _spread(rows, "hand_x"), _spread(rows, "hand_y")
    features = F.struct(
        F.size(rows).alias("n"), wide.alias("range_x"), tall.alias("range_y"), total(F.transform(steps, lambda s: s["far"])).alias("path"),
        F.hypot(_spread(rows, "core_x"), _spread(rows, "core_y")).alias("core"), F.coalesce(F.array_max(F.transform(steps, lambda s: s["far"] / s["dt"])), F.lit(0.0)).alias("peak"),
        F.aggregate(turn, F.lit(0), lambda s, x: s + x).alias("reversals"), (tall / F.greatest(wide, F.lit(0.01))).alias("ratio"),
    )
    return F.when(F.size(rows) >= minimum, features)


def eligible(rows: Column, confidence: float = 0.45) -> Column:
    return F.filter(rows, lambda r: (r["conf"] >= confidence) & (r["scale"] >= 0.04))


def gates(f: Column) -> tuple[Column, ...]:
    return f["range_x"], f["core"], f["path"], f["reversals"], f["ratio"]


def detection(good: Column) -> Column:
    """candidate, conf, t (of the middle row, for candidates) of a window's good rows: at least seven within four seconds."""
    f = stroke_features(good, 7, 0.008)
    short = F.get(good, F.size(good) - 1)["t"] - F.get(good, F.lit(0))["t"] <= 4.0
    ok = F.coalesce(short & strict_shape(*gates(f)), F.lit(False))
    conf = F.when(F.coalesce(short, F.lit(False)) & f.isNotNull(), shape_confidence(*gates(f))).otherwise(0.0)
    return F.struct(ok.alias("candidate"), conf.alias("conf"), F.when(ok, F.get(good, F.floor(F.size(good) / 2).cast("int"))["t"]).alias("t"))


def series_centers(samples: DataFrame, key: str, window: float, step: float) -> DataFrame:
    """key, t of window centers from half a window after the first sample, by repeated addition of step, to half a window before the last."""
    ends = samples.groupBy(key).agg(F.min("t").alias("a"), F.max("t").alias("b")).where(c("b") - c("a") >= window)
    n = F.floor((c("b") - c("a") - window) / step).cast("int") + 1
    x = ends.withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    add = F.when(c("k") == 0, c("a") + window / 2.0).otherwise(step)
    x = x.withColumn("t", F.sum(add).over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(c("t") <= c("b") - window / 2.0).select(key, "t")


def series_windows(samples: DataFrame, key: str, window: float = 1.6, step: float = 0.2, confidence: float = 0.45) -> DataFrame:
    """key, t, score of the centers whose window is a candidate, before overlapping ones are thinned out (see greedy.temporal_nms)."""
    half = window / 2.0
    x = windowed(samples, key, {"rows": (-half - 1e-6, half + 1e-6)}, POSE, series_centers(samples, key, window, step))
    good = eligible(F.filter("rows", lambda r: F.abs(r["t"] - c("t")) <= half), confidence)
    return x.select(key, "t", good.alias("good")).select(key, "t", detection(c("good")).alias("d")).where("d.candidate").select(key, "t", c("d.conf").alias("score"))


def candidate_scores(candidates: DataFrame, samples: DataFrame, key: str, half: float = 4.0) -> DataFrame:
    """Adds status, n, score to candidates: the greatest confidence of the series around each, 0 if no window fits, null if there are too few samples.

    Thinning out overlapping windows never takes the best one, so it isn't needed here.
    """
    x = windowed(samples, key, {"rows": (-half - 1e-6, half + 1e-6)}, POSE, candidates).withColumn("rows", F.filter("rows", lambda r: F.abs(r["t"] - c("t")) <= half))
    x = x.withColumn("_good", eligible(c("rows")))
    edge = lambda a, k: F.get(a, k)["t"]
    span = edge(c("_good"), F.size("_good") - 1) - edge(c("_good"), F.lit(0))
    enough = F.coalesce((F.size("_good") >= 7) & (span >= 1.6), F.lit(False))
    first, last = edge(c("rows"), F.lit(0)), edge(c("rows"), F.size("rows") - 1)
    most = int(2 * half / 0.2) + 1
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(first + 0.8), lambda acc, _: F.when(F.element_at(acc, -1) + 0.2 <= last - 0.8, F.concat(acc, F.array(F.element_at(acc, -1) + 0.2))).otherwise(acc))
    centers = F.filter(grown, lambda t: t <= last - 0.8)
    x = x.select(*candidates.columns, F.size("_good").alias("n"), F.when(enough, "ok").otherwise("insufficient-pose").alias("status"), F.when(enough, c("_good")).alias("_good"), F.explode_outer(F.when(enough, centers)).alias("_c"))
    x = x.withColumn("_good", F.filter("_good", lambda r: F.abs(r["t"] - c("_c")) <= 0.8)).withColumn("_d", detection(c("_good")))
    best = F.max(F.when(c("_d")["candidate"], c("_d")["conf"]))
    return x.groupBy(*candidates.columns).agg(F.max("n").alias("n"), F.max("status").alias("status"), F.when(F.max("status") == "ok", F.coalesce(best, F.lit(0.0))).alias("score"))


def context_score(before: Column, after: Column) -> Column:
    """Stillness of hands and body in the windows before and after; 0 if either has fewer than five rows."""
    a, b = stroke_features(before), stroke_features(after)
    still = 0.65 * F.exp(-0.8 * (a["path"] + b["path"])) + 0.35 * F.exp(-1.2 * (a["core"] + b["core"]))
    return F.coalesce(still, F.lit(0.0))


OFFSETS = (-0.9, -0.7, -0.5, -0.3, -0.1, 0.1, 0.3, 0.5, 0.7, 0.9)


def phase_scores(centers: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """key, id, score of centers (key, t, id): how the hand, seen from the body at ten fixed offsets, leaves its rest and comes back to it."""
    x = centers.select(key, "id", F.posexplode(F.array(*[c("t") + F.lit(o) for o in OFFSETS])).alias("k", "t"))
    value = (c("hand_x") - c("core_x")) / F.greatest(c("scale"), F.lit(0.04))
    near = nearest(x, samples.select(key, c("t").alias("u"), value.alias("v")), key, ["v"]).where("near_u is not null")
    v = near.groupBy(key, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", c("near_v").alias("v")))), lambda s: s["v"]).alias("v"))
    at = lambda k: c("v")[k]
    rest = ((at(0) + at(1) + at(2)) / 3 + (at(7) + at(8) + at(9)) / 3) / 2.0
    moved = F.abs(at(1) - at(0)) + F.abs(at(2) - at(1)) + (F.abs(at(8) - at(7)) + F.abs(at(9) - at(8)))
    out = F.greatest(*[F.abs(at(k) - rest) for k in range(3, 7)])
    peak = F.when(F.abs(at(3) - rest) == out, at(3)).when(F.abs(at(4) - rest) == out, at(4)).when(F.abs(at(5) - rest) == out, at(5)).otherwise(at(6))
    crossing = F.least(*[F.abs(at(k) - rest) for k in range(4, 8)])
    compact = F.exp(-0.8 * F.greatest(F.lit(0.0), F.array_max("v") - F.array_min("v") - 1.2))
    one = lambda x: F.least(F.lit(1.0), x)
    phase = one(out / 0.18) * one(F.abs(peak - at(6)) / 0.08) * one((0.12 - crossing + 0.12) / 0.24)
    return v.select(key, "id", (F.exp(-0.7 * moved) * compact * phase).alias("score"))


def trajectory(rows: Column, t: Column, radius: float = 0.8, points: int = 9) -> Column:
    """The hand seen from the body at evenly spaced moments around t, each from the nearest row (the earlier of two as near); null for fewer than five rows."""

    def at(k: int) -> Column:
        target = (t - radius) + F.lit(k * (2.0 * radius / (points - 1)))
        best = F.array_min(F.transform(rows, lambda r, i: F.struct(F.abs(r["t"] - target).alias("apart"), i.alias("i"), r["hand_x"].alias("hx"), r["hand_y"].alias("hy"), r["core_x"].alias("cx"), r["core_y"].alias("cy"), r["scale"].alias("s"))))
        size = F.greatest(best["s"], F.lit(0.04))
        return F.struct(((best["hx"] - best["cx"]) / size).alias("x"), ((best["hy"] - best["cy"]) / size).alias("y"))

    return F.when(F.size(rows) >= 5, F.array(*[at(k) for k in range(points)]))


def body_tracked(samples: DataFrame, key: str, queries: DataFrame | None = None) -> DataFrame:
    """Adds tracked to queries (key, t, ...), or to each good sample: whether one body was seen without a break and stayed where it is.

    Of the good samples of the last 1.2 s since the last break (a gap over 0.6 s or no progress in time) there are three at
    least over 0.55 s, the last one is at most 0.35 s old, and no two are farther apart than 0.75 of the smaller body.
    """
    fields = ("t", "id", "core_x", "core_y", "scale")
    fine = [~F.isnan(n) & (F.abs(n) < float("inf")) for n in ("t", "hand_x", "hand_y", "core_x", "core_y", "scale", "conf")]
    good = samples.where((c("conf") >= 0.45) & (c("scale") >= 0.04))
    for f in fine:
        good = good.where(f)
    w = Window.partitionBy(key).orderBy("t", "id")
    gap = c("t") - F.lag("t").over(w)
    good = good.withColumn("_new", F.coalesce(((gap > 0.6) | (gap <= 0)).cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    x = windowed(good, key, {"rows": (-1.2 - 1e-6, 0.0)}, (*fields, "run"), queries)
    last = F.get(c("rows"), F.size("rows") - 1)
    recent = F.filter("rows", lambda r: (r["run"] == last["run"]) & (c("t") - r["t"] <= 1.2))
    x = x.withColumn("rows", recent)
    far = lambda a, b: F.hypot(a["core_x"] - b["core_x"], a["core_y"] - b["core_y"]) / F.greatest(F.lit(0.04), F.least(a["scale"], b["scale"])) > 0.75
    moved = F.exists("rows", lambda a: F.exists("rows", lambda b: far(a, b)))
    ok = (F.size("rows") >= 3) & (c("t") - last["t"] <= 0.35) & (last["t"] - F.get(c("rows"), F.lit(0))["t"] >= 0.55) & ~moved
    return x.withColumn("tracked", F.coalesce(ok, F.lit(False))).drop("rows", "run")


def coarse_times(duration: Column, interval: float, most: int) -> Column:
    """Moments to look at: every interval, or evenly spaced if these were more than ``most``; to the nearest thousandth, before the end."""
    n = F.ceil(duration / interval).cast("int")
    by_interval = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rint(i * F.lit(interval) * 1000) / 1000)
    evenly = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (duration / most) * 1000) / 1000)
    times = F.filter(F.when(n <= most, by_interval).otherwise(evenly), lambda t: (t >= 0) & (t < duration))
    return F.when((duration > 0) & F.lit(interval > 0 and most > 0), times).otherwise(F.array().cast("array<double>"))


def frame_times(duration: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: duration * i / (n + 1))


def window_times(duration: Column, window: Column, n: int = 8) -> Column:
    """Middles of n equal parts of the window around the middle of a clip; a null window is the whole clip."""
    width = F.coalesce(F.least(window, duration), duration)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (duration / 2.0 - width / 2.0) + (width / n) * (i + 0.5))


def local_maxima(series: DataFrame, key: str, floor: Column, contrast: float = 0.0, value: str = "value", tie: str = "id") -> DataFrame:
    """Rows inside a series that are at least floor and not below either neighbour, and above the lower neighbour by at least contrast."""
    w = Window.partitionBy(key).orderBy("t", tie)
    x = series.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w)})
    v = c(value)
    return x.where((v >= c("_b")) & (v >= c("_a")) & (v >= floor) & (v - F.least("_b", "_a") >= contrast)).drop("_b", "_a")


def time_histogram(blocks: DataFrame, key: str, duration: Column, buckets: int = 192) -> DataFrame:
    """key, bucket, rms (mean), peak (greatest), crossing_rate of blocks (key, t of the middle, rms, peak, crossings, count); empty buckets are 0."""
    at = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(c("t") / duration * buckets))).cast("int")
    h = blocks.groupBy(key, at.alias("bucket")).agg(F.avg("rms").alias("rms"), F.max("peak").alias("peak"), (F.sum("crossings") / F.when(F.sum("count") > 0, F.sum("count"))).alias("crossing_rate"))
    grid = blocks.select(key).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return grid.join(h, [key, "bucket"], "left").na.fill(0.0, ["rms", "peak", "crossing_rate"])
