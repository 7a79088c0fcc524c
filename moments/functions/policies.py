"""Decisions as column expressions: fusion predicates, model lineage, validation reasons, gates and review scores.

Nothing here shuffles; a null in a guard counts as a failed guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.functions.scalars import impact_score, isfinite

VERSIONS = ("0.1.0", "0.2.0", "0.2.1", "0.3.0", "0.4.0", "0.5.0", "0.5.1", "0.6.0", "0.7.0")
#: Each flag holds from one version on; versions are ordered as listed.
FLAG_SINCE = {
    "visual_assist": "0.2.0", "response_weight": "0.2.0", "motion_fusion": "0.4.0", "pose_assist": "0.5.0",
    "pose_evidence": "0.5.1", "silent_putt": "0.6.0", "needs_visual": "0.7.0", "weak_impact": "0.7.0",
}
TITLES = ("sound", "sound with picture", "tuned on video", "sound and picture apart", "swing motion", "body pose", "pose evidence", "silent putts", "all clubs")
RELEASED = ("2026.08.06",) * 3 + ("2026.08.20",) * 3 + ("2026.08.24",) * 2 + ("2026.09.07",)
CURRENT = VERSIONS[-1]


def _unknown(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def model_versions(spark: SparkSession) -> DataFrame:
    """A dimension of nine rows: version, title, released and eight flags."""
    flags = [[VERSIONS.index(v) >= VERSIONS.index(since) for since in FLAG_SINCE.values()] for v in VERSIONS]
    rows = [(v, t, r, *f) for v, t, r, f in zip(VERSIONS, TITLES, RELEASED, flags, strict=True)]
    return spark.createDataFrame(rows, "version string, title string, released string, " + ", ".join(f"{n} boolean" for n in FLAG_SINCE))


def is_impact_window(phase: Column, impact_time: Column) -> Column:
    return _unknown(phase == "downswing") & impact_time.isNotNull()


def is_confirmed_stroke(phase: Column, stroke_time: Column) -> Column:
    return _unknown(phase == "confirmedStroke") & stroke_time.isNotNull()


def in_pose_window(phase: Column, start: Column, end: Column, t: Column) -> Column:
    return _unknown((phase == "impactWindow") & t.between(start, end))


def swing_trigger(df: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds fires to rows of version, triggered, rms, peak, crossing, motion_phase, motion_conf, impact_t, pose_phase, pose_conf,
    win_start, win_end, ref_t, needs_pose, recent_frame, ready_prompt and tracked (null: not known)."""
    c = F.col
    x = df.join(F.broadcast(versions.select("version", "pose_evidence", "needs_visual", "weak_impact")), "version")
    motion = is_impact_window(c("motion_phase"), c("impact_t")) & _unknown((c("motion_conf") >= 0.72) & (c("ref_t") - c("impact_t")).between(-0.20, 0.32))
    pose = c("pose_evidence") & _unknown(c("pose_conf") >= 0.72) & in_pose_window(c("pose_phase"), c("win_start"), c("win_end"), c("ref_t"))
    score = impact_score(c("rms"), c("peak"), c("crossing"))
    weak = c("weak_impact") & ~c("ready_prompt") & (c("peak") >= 0.10) & (score >= 0.065) & (c("crossing") >= 0.08) & (c("peak") / F.greatest(F.lit(0.001), c("rms")) >= 3.5)
    fires = (
        F.when(~c("recent_frame"), c("triggered") & ~c("needs_visual") & ~c("ready_prompt"))
        .when(c("needs_visual") & c("tracked").eqNullSafe(False), False)
        .when(~(motion | pose) | (c("needs_pose") & ~pose), False)
        .when(~c("triggered"), weak)
        .when(c("ready_prompt"), (c("peak") >= 0.16) & (score >= 0.08))
        .otherwise(True)
    )
    return x.withColumn("fires", _unknown(fires)).drop("pose_evidence", "needs_visual", "weak_impact")


def putt_trigger(df: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds fires to rows of version, stroke_phase, stroke_conf, stroke_t, pose_conf, pose_age, frame_age, stable_for, ready, ready_prompt, pending."""
    c = F.col
    x = df.join(F.broadcast(versions.select("version", "silent_putt")), "version")
    oldest = F.when(c("version") == "0.7.0", 0.55).otherwise(0.35)
    fires = (
        c("silent_putt") & is_confirmed_stroke(c("stroke_phase"), c("stroke_t")) & (c("stroke_conf") >= 0.72) & (c("pose_conf") >= 0.72) & (c("pose_age") <= oldest) & (c("frame_age") <= oldest)
        & (c("stable_for") >= 1.0) & c("ready") & ~c("ready_prompt") & ~c("pending")
    )
    return x.withColumn("fires", _unknown(fires)).drop("silent_putt")


def unit(x: Column) -> Column:
    return isfinite(x) & x.between(0, 1)


def unit_or_null(x: Column) -> Column:
    """The value where it is finite and between 0 and 1; text is read as a number first."""
    d = x.try_cast("double")
    return F.when(unit(d), d)


def photo_reason(copies: Column, idx: Column, sharp: Column, expo: Column, pixels: Column, aes: Column) -> Column:
    """The first reason to turn a photo down, in fixed order; null if there is none."""
    return (
        F.when(copies > 1, "duplicateCandidateId").when(idx < 0, "invalidIndex").when(~unit(sharp), "nonFiniteOrOutOfRangeSharpness").when(~unit(expo), "nonFiniteOrOutOfRangeExposure")
        .when(~_unknown(pixels > 0), "nonPositivePixelCount").when(aes.isNotNull() & ~unit(aes), "nonFiniteOrOutOfRangeAesthetics")
    )


def frame_reason(copies: Column, idx: Column, t: Column, duration: Column, quality: Column, importance: Column, minimum: Column) -> Column:
    return (
        F.when(copies > 1, "duplicateCandidateId").when(idx < 0, "invalidIndex").when(~(isfinite(t) & _unknown(t.between(F.lit(0), duration))), "nonFiniteOrOutOfRangeTime")
        .when(~unit(quality), "nonFiniteOrOutOfRangeQuality").when(importance.isNotNull() & ~unit(importance), "nonFiniteOrOutOfRangeImportance").when(quality < minimum, "belowQualityThreshold")
    )


#: name of the setting -> (its error, is it good)
_CHECKS = {
    "duration": ("invalidDuration", lambda x: x > 0),
    "similarity_threshold": ("invalidSimilarityThreshold", lambda x: x >= 0),
    "minimum_quality": ("invalidMinimumQuality", lambda x: x.between(0, 1)),
    "minimum_spacing": ("invalidMinimumSpacingSeconds", lambda x: x >= 0),
    "diversity_window": ("invalidLocalDiversityWindowSeconds", lambda x: x >= 0),
    "pre_roll": ("invalidPreRollSeconds", lambda x: x >= 0),
    "post_roll": ("invalidPostRollSeconds", lambda x: x >= 0),
    "max_segment": ("invalidMaxSegmentDurationSeconds", lambda x: x > 0),
    "budget": ("invalidTotalDurationBudgetSeconds", lambda x: x >= 0),
    "frame_count": ("invalidFrameCount", lambda x: x >= 0),
    "importance_weight": ("invalidImportanceWeight", lambda x: x.between(0, 1)),
}


def configuration_errors(**settings: Column) -> Column:
    """All errors of a highlight configuration, in fixed order."""
    return F.array_compact(F.array(*[F.when(~(isfinite(settings[n].cast("double")) & _unknown(good(settings[n]))), error) for n, (error, good) in _CHECKS.items() if n in settings]))


def strict_shape(range_x: Column, core: Column, path: Column, reversals: Column, ratio: Column) -> Column:
    return range_x.between(0.05, 0.30) & (core <= 0.32) & path.between(0.08, 2.0) & (reversals >= 1) & (ratio <= 0.60)


def recall_shape(range_x: Column, core: Column, path: Column, reversals: Column, ratio: Column) -> Column:
    return range_x.between(0.03, 0.50) & (core <= 0.45) & path.between(0.10, 2.5) & (ratio <= 1.25) & ((reversals >= 1) | (path >= 0.10))


def shape_confidence(range_x: Column, core: Column, path: Column, reversals: Column, ratio: Column) -> Column:
    """The sum of what each satisfied gate adds, in the order of the gates."""
    gates = ((range_x.between(0.05, 0.30), 0.28), (core <= 0.32, 0.24), (path.between(0.08, 2.0), 0.20), (reversals >= 1, 0.28), (ratio <= 0.60, 0.10))
    total = F.lit(0.0)
    for gate, worth in gates:
        total = total + F.when(gate, worth).otherwise(0.0)
    return total


def print_score(positive: Column, negative: Column, db: Column, roi: Column, mat: Column, use_mat: bool) -> Column:
    """Margin of a candidate between its references, less penalties for loudness and motion; nulls are -40 dB and no motion."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    loud = F.greatest(F.lit(0.0), (F.coalesce(db, F.lit(-40.0)) + 3.0) / 3.0)
    wild = F.greatest(F.lit(0.0), (zero(roi) - 10.0) / 10.0)
    score = negative - positive - (0.10 * loud + (0.20 if use_mat else 0.05) * wild)
    return score + 0.10 * F.when(zero(mat) > 0, F.exp(-F.pow((mat - 6.5) / 2.8, 2))).otherwise(0.0) if use_mat else score


def relative_time(raw: Column, start: Column, duration: Column, closed: bool = True) -> Column:
    """Time since the start of the source, null where it isn't within it; ``closed``: the end itself is within."""
    t = raw - start
    return F.when((t >= 0) & ((t <= duration) if closed else (t < duration)), t)


def content_dims(width: Column, height: Column, turn: Column, canvas: int) -> Column:
    """w, h of a picture fitted into a square canvas after its turn; sizes are rounded half to even and are 1 at least."""
    w, h = (F.when(turn.isin(90, 270), a).otherwise(b).cast("double") for a, b in ((height, width), (width, height)))
    scale = F.least(canvas / w, canvas / h)
    size = lambda x: F.least(F.lit(canvas), F.greatest(F.lit(1), F.rint(x * scale).cast("int")))
    return F.struct(size(w).alias("w"), size(h).alias("h"))


def content_box(width: Column, height: Column, turn: Column, canvas: int = 64) -> Column:
    """x, y, w, h of the content in the canvas, a pixel less on every side where it is wide enough."""
    d = content_dims(width, height, turn, canvas)
    half = lambda x: F.floor((F.lit(canvas) - x) / 2).cast("int")
    inset = F.when((d["w"] > 2) & (d["h"] > 2), 1).otherwise(0)
    return F.struct((half(d["w"]) + inset).alias("x"), (half(d["h"]) + inset).alias("y"), (d["w"] - 2 * inset).alias("w"), (d["h"] - 2 * inset).alias("h"))


def contrastive(p: Column) -> Column:
    """Second score of five against the best of the last three; null where both are next to nothing."""
    worst = F.greatest(p[2], p[3], p[4])
    return F.when(p[1] + worst >= 1e-6, p[1] / (p[1] + worst))


def review_motion(motion: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(motion - 5.8) / 2.2)


def anchor_proximity(gap: Column) -> Column:
    return F.when(gap.between(3.0, 45.0), 1.0 - F.least(F.abs(gap - 18.0) / 27.0, F.lit(1.0))).otherwise(0.0)


def scene_rejected(roi: Column, hand_range: Column, hand_path: Column) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return (zero(roi) > 9.5) & (zero(hand_range) < 0.25) & (zero(hand_path) < 0.60)


def importance_weight(explicit: Column, has_query: Column, backend: Column) -> Column:
    return F.coalesce(explicit, F.when(_unknown(has_query & (backend == "siglip2")), 1.0).otherwise(0.3))


def label_class(label: Column) -> Column:
    return F.when(label == "putter", "putter").when(label.isin("non-shot", "nonPutter"), "negative").when(label.isin("driver", "wood", "iron", "wedge"), "other-club").otherwise("unlabeled")


def engine_quality(status: Column, time_status: Column, sharpness: Column, exposure: Column) -> Column:
    """Sharpness times exposure of a decoded frame whose time was measured; null for others, which aren't candidates."""
    return F.when((status == "ok") & (time_status == "measured"), sharpness * exposure)


def reduced_pose(wrists: Column, shoulders: Column, hips: Column, floor: float = 0.35) -> Column:
    """Hand, core, body scale and confidence from joints (arrays of x, y, conf): means over the joints that are sure enough; null without any of a kind."""

    def mean(joints: Column) -> tuple[Column, ...]:
        sure = F.filter(joints, lambda j: j["conf"] >= floor)
        of = lambda k: F.aggregate(F.transform(sure, lambda j: j[k]), F.lit(0.0), lambda s, x: s + x)
        return tuple(of(k) / F.when(F.size(sure) > 0, F.size(sure)) for k in ("x", "y", "conf"))

    (hx, hy, hc), (sx, sy, sc), (px, py, pc) = map(mean, (wrists, shoulders, hips))
    scale = F.greatest(F.lit(0.04), F.hypot(sx - px, sy - py))
    pose = F.struct(hx.alias("hand_x"), hy.alias("hand_y"), ((sx + px) / 2).alias("core_x"), ((sy + py) / 2).alias("core_y"), scale.alias("scale"), F.least(hc, sc, pc).alias("conf"))
    return F.when(hx.isNotNull() & sx.isNotNull() & px.isNotNull(), pose)
