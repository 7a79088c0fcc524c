"""Queries of the scalar, policy and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.functions import policies as P
from moments.functions import scalars as S
from moments.functions import vectors as V
from moments.operators import photos as PH
from moments.plans import testdata as T
from moments.plans.base import c, query, r6

E, A, PHOTOS, POSE, FRAMES = T.EVENTS_SQL, T.AUDIO_SQL, T.PHOTOS_SQL, T.POSE_SQL, T.FRAMES_SQL


def lit_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in xs) + "]"


def pick(xs, index):
    return F.element_at(F.array(*map(F.lit, xs)), (index + 1).cast("int"))


# ---- fusion predicates and lineage -----------------------------------------------------------------------------------

_FLAG_ROWS = ", ".join(f"('{v}', '{t}', '{r}', " + ", ".join(str(P.VERSIONS.index(v) >= P.VERSIONS.index(s)).lower() for s in P.FLAG_SINCE.values()) + ")" for v, t, r in zip(P.VERSIONS, P.TITLES, P.RELEASED, strict=True))
_FLAGS = f"(values {_FLAG_ROWS}) as mv(version, title, released, {', '.join(P.FLAG_SINCE)})"


@query("f08_model_versions", f"select * from {_FLAGS}")
def model_versions(spark, d):
    return P.model_versions(spark)


_PHASES, _POSES = ("seekingAddress", "addressed", "backswing", "downswing"), ("seekingAddress", "addressed", "backswing", "impactWindow")
_SWING_SQL = f"""(select *, {lit_list(P.VERSIONS)}[id % 9 + 1] v, id % 5 <> 0 trig, {lit_list(_PHASES)}[case when id % 4 = 0 then id % 3 else 3 end + 1] mp, (id % 30) / 30.0::double + 0.2::double mc,
case when id % 6 <> 0 then t - ((id % 13) - 4) / 16.0::double end it, {lit_list(_POSES)}[case when id % 3 = 0 then 3 else id % 3 end + 1] pp, case when id % 10 <> 0 then (id % 20) / 25.0::double + 0.3::double end pc,
t - 0.45::double + (id % 5) / 10.0::double ws, t + 0.30::double - (id % 4) / 8.0::double we, id % 7 = 0 np, id % 11 <> 0 rf, id % 8 = 0 rp, case when id % 3 = 0 then null else id % 6 <> 1 end tr from {A})"""


def _swing_rows(spark, d):
    i, t = c("id"), c("t")
    return T.audio(spark, d).select(
        "id", "rms", "peak", "crossing", pick(P.VERSIONS, i % 9).alias("version"), (i % 5 != 0).alias("triggered"), pick(_PHASES, F.when(i % 4 == 0, i % 3).otherwise(3)).alias("motion_phase"),
        ((i % 30) / 30.0 + 0.2).alias("motion_conf"), F.when(i % 6 != 0, t - ((i % 13) - 4) / 16.0).alias("impact_t"), pick(_POSES, F.when(i % 3 == 0, 3).otherwise(i % 3)).alias("pose_phase"),
        F.when(i % 10 != 0, (i % 20) / 25.0 + 0.3).alias("pose_conf"), (t - 0.45 + (i % 5) / 10.0).alias("win_start"), (t + 0.30 - (i % 4) / 8.0).alias("win_end"), t.alias("ref_t"),
        (i % 7 == 0).alias("needs_pose"), (i % 11 != 0).alias("recent_frame"), (i % 8 == 0).alias("ready_prompt"), F.when(i % 3 != 0, i % 6 != 1).alias("tracked"),
    )


@query(
    "f06_swing_fusion",
    f"""select id, case when not rf then trig and not needs_visual and not rp when needs_visual and tr is not null and not tr then false when not (al or ap) or (np and not ap) then false
    when not trig then weak_impact and not rp and peak >= 0.10 and sc >= 0.065 and crossing >= 0.08 and peak / greatest(0.001, rms) >= 3.5 when rp then peak >= 0.16 and sc >= 0.08 else true end fires
    from (select *, least(1.0, 0.55 * rms + 0.45 * peak + 0.35 * least(1.0, 10 * crossing) * rms) sc, coalesce(mp = 'downswing' and it is not null and mc >= 0.72 and t - it between -0.20::double and 0.32::double, false) al,
    pose_evidence and coalesce(pc >= 0.72 and pp = 'impactWindow' and t between ws and we, false) ap from {_SWING_SQL} s join {_FLAGS} on s.v = mv.version)""",
)
def swing_fusion(spark, d):
    return P.swing_trigger(_swing_rows(spark, d), P.model_versions(spark)).select("id", "fires")


@query(
    "f07_putt_fusion",
    f"""select id, silent_putt and sp = 'confirmedStroke' and st is not null and sc >= 0.72 and pc >= 0.72 and pa <= lim and fa <= lim and stable >= 1.0 and ready and not rp and not pend fires from (
    select *, case when v = '0.7.0' then 0.55::double else 0.35::double end lim from (select id, {lit_list(P.VERSIONS)}[case when id % 2 = 0 then 8 else id % 9 end + 1] v, case when id % 7 = 0 then 'forwardStroke' else 'confirmedStroke' end sp,
    case when id % 13 <> 0 then t end st, 0.6::double + (id % 10) / 20.0::double sc, 0.65::double + (id % 6) / 15.0::double pc, (id % 12) / 20.0::double pa, (id % 9) / 15.0::double fa, value / 40 stable, id % 10 <> 3 ready, id % 14 = 5 rp, id % 16 = 9 pend from {E})) s join {_FLAGS} on s.v = mv.version""",
)
def putt_fusion(spark, d):
    i = c("id")
    x = T.events(spark, d).select(
        "id", pick(P.VERSIONS, F.when(i % 2 == 0, 8).otherwise(i % 9)).alias("version"), F.when(i % 7 == 0, "forwardStroke").otherwise("confirmedStroke").alias("stroke_phase"), F.when(i % 13 != 0, c("t")).alias("stroke_t"),
        (0.6 + (i % 10) / 20.0).alias("stroke_conf"), (0.65 + (i % 6) / 15.0).alias("pose_conf"), ((i % 12) / 20.0).alias("pose_age"), ((i % 9) / 15.0).alias("frame_age"), (c("value") / 40).alias("stable_for"),
        (i % 10 != 3).alias("ready"), (i % 14 == 5).alias("ready_prompt"), (i % 16 == 9).alias("pending"),
    )
    return P.putt_trigger(x, P.model_versions(spark)).select("id", "fires")


@query("f29_f33_signal_windows", f"select id, coalesce(mp = 'downswing' and it is not null, false) impact, coalesce(pp = 'impactWindow' and t between ws and we, false) held from {_SWING_SQL}")
def signal_windows(spark, d):
    x = _swing_rows(spark, d)
    return x.select("id", P.is_impact_window(c("motion_phase"), c("impact_t")).alias("impact"), P.in_pose_window(c("pose_phase"), c("win_start"), c("win_end"), c("ref_t")).alias("held"))


# ---- validation ------------------------------------------------------------------------------------------------------

#: Photos with faults: repeated, negative and out-of-range figures.
BAD_PHOTOS_SQL = f"""(select set_id, case when idx % 50 < 2 then -(idx // 50) - 1 when idx % 40 = 7 then 7 else idx end idx, case when idx % 31 = 3 then 'nan'::double when idx % 37 = 4 then 1.5::double else sharp end sharp,
case when idx % 41 = 5 then -0.1::double else expo end expo, case when idx % 43 = 6 then 0 else px end px, case when idx % 47 = 8 then 2.0::double else aes end aes, e from {PHOTOS})"""


def bad_photos(spark, d):
    i = c("idx")
    return T.photos(spark, d).select(
        "set_id", F.when(i % 50 < 2, -F.floor(i / 50) - 1).when(i % 40 == 7, 7).otherwise(i).cast("long").alias("idx"), F.when(i % 31 == 3, float("nan")).when(i % 37 == 4, 1.5).otherwise(c("sharp")).alias("sharp"),
        F.when(i % 41 == 5, -0.1).otherwise(c("expo")).alias("expo"), F.when(i % 43 == 6, 0).otherwise(c("px")).alias("px"), F.when(i % 47 == 8, 2.0).otherwise(c("aes")).alias("aes"), "e",
    )


PHOTO_REASON_SQL = """case when count(*) over (partition by set_id, idx) > 1 then 'duplicateCandidateId' when idx < 0 then 'invalidIndex' when isnan(sharp) or sharp not between 0 and 1 then 'nonFiniteOrOutOfRangeSharpness'
when isnan(expo) or expo not between 0 and 1 then 'nonFiniteOrOutOfRangeExposure' when px <= 0 then 'nonPositivePixelCount' when aes is not null and (isnan(aes) or aes not between 0 and 1) then 'nonFiniteOrOutOfRangeAesthetics' end"""


@query("f12_validation", f"select set_id, idx, {PHOTO_REASON_SQL} reason from {BAD_PHOTOS_SQL}")
def photo_validation(spark, d):
    return PH.checked(bad_photos(spark, d), "set_id").select("set_id", "idx", "reason")


FRAME_REASON_SQL = """case when count(*) over (partition by src, idx) > 1 then 'duplicateCandidateId' when idx < 0 then 'invalidIndex' when isnan(t) or t not between 0 and 73 then 'nonFiniteOrOutOfRangeTime'
when q not between 0 and 1 then 'nonFiniteOrOutOfRangeQuality' when imp is not null and imp not between 0 and 1 then 'nonFiniteOrOutOfRangeImportance' when q < 0.25 then 'belowQualityThreshold' end"""


@query("f12_frame_validation", f"select src, idx, {FRAME_REASON_SQL} reason from {FRAMES}")
def frame_validation(spark, d):
    from pyspark.sql import Window

    copies = F.count(F.lit(1)).over(Window.partitionBy("src", "idx"))
    return T.frames(spark, d).select("src", "idx", P.frame_reason(copies, c("idx"), c("t"), F.lit(73.0), c("q"), c("imp"), F.lit(0.25)).alias("reason"))


def _odd(name: str, modulus: int) -> str:
    return f"case when id % {modulus} = 0 then 'nan'::double when id % {modulus} = 1 then -1.0::double when id % {modulus} = 2 then 1.5::double else 0.5::double end {name}"


_SETTINGS = {"duration": 5, "similarity_threshold": 6, "minimum_quality": 7, "minimum_spacing": 8, "diversity_window": 9, "pre_roll": 10, "post_roll": 11, "max_segment": 12, "budget": 13, "importance_weight": 14}
_BAD = {"duration": "x <= 0", "similarity_threshold": "x < 0", "minimum_quality": "x not between 0 and 1", "minimum_spacing": "x < 0", "diversity_window": "x < 0", "pre_roll": "x < 0", "post_roll": "x < 0", "max_segment": "x <= 0", "budget": "x < 0", "importance_weight": "x not between 0 and 1"}
_ERRORS = {n: e for n, (e, _) in P._CHECKS.items()}
_error_sql = ", ".join(f"case when isnan({n}) or {_BAD[n].replace('x', n, 1)} then '{_ERRORS[n]}' end" if n != "frame_count" else f"case when frame_count < 0 then '{_ERRORS[n]}' end" for n in P._CHECKS)


@query("f13_configuration_errors", f"select id, array_to_string(list_filter([{_error_sql}], lambda e: e is not null), ',') errors from (select id, id % 4 - 1 frame_count, {', '.join(_odd(n, m) for n, m in _SETTINGS.items())} from {E})")
def configuration(spark, d):
    i = c("id")
    odd = {n: F.when(i % m == 0, float("nan")).when(i % m == 1, -1.0).when(i % m == 2, 1.5).otherwise(0.5) for n, m in _SETTINGS.items()}
    return T.events(spark, d).select("id", F.array_join(P.configuration_errors(**odd, frame_count=i % 4 - 1), ",").alias("errors"))


@query("f30_coercions", f"select id, case when isnan(v) or isinf(v) then null when v between 0 and 1 then round(v, 6) end u from (select id, case id % 6 when 0 then null when 1 then 'nan'::double when 2 then 'inf'::double when 3 then value / 100 when 4 then null else -value end v from {E})")
def coercions(spark, d):
    i = c("id")
    text = F.when(i % 6 == 0, None).when(i % 6 == 1, "NaN").when(i % 6 == 2, "Infinity").when(i % 6 == 3, (c("value") / 100).cast("string")).when(i % 6 == 4, "three").otherwise((-c("value")).cast("string"))
    return T.events(spark, d).select("id", r6(P.unit_or_null(text)).alias("u"))


# ---- scores and gates ------------------------------------------------------------------------------------------------

_SHAPE_SQL = f"(select id, rms / 2 x, crossing core, peak * 3 path, id % 3 rev, (id % 29) / 20.0::double ratio from {A})"
_STRICT = "x between 0.05 and 0.30 and core <= 0.32 and path between 0.08 and 2.0 and rev >= 1 and ratio <= 0.60"


@query(
    "f15_stroke_gates",
    f"""select id, {_STRICT} strict, x between 0.03 and 0.50 and core <= 0.45 and path between 0.10 and 2.5 and ratio <= 1.25 and (rev >= 1 or path >= 0.10) recall, round(case when x between 0.05 and 0.30 then 0.28 else 0 end
    + case when core <= 0.32 then 0.24 else 0 end + case when path between 0.08 and 2.0 then 0.20 else 0 end + case when rev >= 1 then 0.28 else 0 end + case when ratio <= 0.60 then 0.10 else 0 end, 6)::double conf from {_SHAPE_SQL}""",
)
def gates(spark, d):
    a = (c("rms") / 2, c("crossing"), c("peak") * 3, c("id") % 3, (c("id") % 29) / 20.0)
    return T.audio(spark, d).select("id", P.strict_shape(*a).alias("strict"), P.recall_shape(*a).alias("recall"), r6(P.shape_confidence(*a)).alias("conf"))


_PRINT_SQL = f"(select id, value / 100 pos, (id % 17) / 10.0::double neg, case when id % 5 = 0 then null else value / 10 - 20 end db, case when id % 7 = 0 then null else (id % 25)::double end roi, case when id % 3 = 0 then null else (id % 11)::double end mat from {E})"


def _print_sql(mat: bool) -> str:
    s = f"neg - pos - (0.10 * greatest(0, (coalesce(db, -40) + 3) / 3) + {0.20 if mat else 0.05} * greatest(0, (coalesce(roi, 0) - 10) / 10))"
    return s + " + 0.10 * case when coalesce(mat, 0) > 0 then exp(-pow((mat - 6.5) / 2.8, 2)) else 0 end" if mat else s


@query("f17_f31_print_score", f"select id, round({_print_sql(False)}, 6) plain, round({_print_sql(True)}, 6) with_mat, round(neg - pos, 6) margin from {_PRINT_SQL}")
def print_scores(spark, d):
    i = c("id")
    x = T.events(spark, d).select("id", (c("value") / 100).alias("pos"), ((i % 17) / 10.0).alias("neg"), F.when(i % 5 != 0, c("value") / 10 - 20).alias("db"), F.when(i % 7 != 0, (i % 25).cast("double")).alias("roi"), F.when(i % 3 != 0, (i % 11).cast("double")).alias("mat"))
    a = (c("pos"), c("neg"), c("db"), c("roi"), c("mat"))
    return x.select("id", r6(P.print_score(*a, False)).alias("plain"), r6(P.print_score(*a, True)).alias("with_mat"), r6(c("neg") - c("pos")).alias("margin"))


@query("f18_side_rotation", f"select id, case when side is not null then (case when (-side % 360 + 360) % 360 in (0, 90, 180, 270) then (-side % 360 + 360) % 360 else 0 end) when tag is not null and (tag % 360 + 360) % 360 in (0, 90, 180, 270) then (tag % 360 + 360) % 360 else 0 end turn from (select id, case when id % 3 = 0 then (id % 17 - 8) * 45 end side, case when id % 5 <> 0 then (id % 9 - 4) * 90 end tag from {E})")
def side_rotation(spark, d):
    i = c("id")
    return T.events(spark, d).select("id", S.source_rotation(F.when(i % 3 == 0, (i % 17 - 8) * 45), F.when(i % 5 != 0, (i % 9 - 4) * 90)).cast("long").alias("turn"))


@query("f19_relative_time", f"select id, round(case when t - s between 0 and 60 then t - s end, 6) closed, round(case when t - s >= 0 and t - s < 60 then t - s end, 6) half_open from (select id, t, (id % 20)::double s from {E})")
def relative_times(spark, d):
    s, e = (c("id") % 20).cast("double"), F.lit(60.0)
    return T.events(spark, d).select("id", r6(P.relative_time(c("t"), s, e)).alias("closed"), r6(P.relative_time(c("t"), s, e, False)).alias("half_open"))


_BOX = "least(64, greatest(1, round_even({} * least(64.0::double / w, 64.0::double / h), 0)))::int"


@query(
    "f20_content_box",
    f"""select id, (64 - cw) // 2 + i x, (64 - ch) // 2 + i y, cw - 2 * i w, ch - 2 * i h from (select *, case when cw > 2 and ch > 2 then 1 else 0 end i from (select id, {_BOX.format("w")} cw, {_BOX.format("h")} ch from (
    select id, case when turn in (90, 270) then b else a end::double w, case when turn in (90, 270) then a else b end::double h from (select id, 100 + id % 1900 a, 80 + (id * 7) % 1400 b, (id % 4) * 90 turn from {E}))))""",
)
def boxes(spark, d):
    i = c("id")
    b = P.content_box(100 + i % 1900, 80 + (i * 7) % 1400, (i % 4) * 90)
    return T.events(spark, d).select("id", b.alias("b")).select("id", *[c("b")[n].alias(n) for n in "xywh"])


FIVE_SQL = f"(select set_id, idx, idx // 5 clip, idx % 5 n, (idx // 5) % 4 = 0 positive, greatest(sharp, 0.1) q, list_transform([11, 12, 13, 14, 15], lambda k: least(1, abs(e[k]::double) * 4)) p from {PHOTOS})"


def five(spark, d):
    """Frames with five prompt scores, five frames a clip: set_id, idx, clip, n, positive, q, p."""
    clip = F.floor(c("idx") / 5)
    return T.photos(spark, d).select(
        "set_id", "idx", clip.alias("clip"), (c("idx") % 5).alias("n"), (clip % 4 == 0).alias("positive"), F.greatest("sharp", F.lit(0.1)).alias("q"),
        F.array(*[F.least(F.lit(1.0), F.abs(c("e")[k].cast("double")) * 4) for k in range(10, 15)]).alias("p"),
    )


@query("f22_contrastive", f"select idx, round(case when p[2] + greatest(p[3], p[4], p[5]) >= 1e-6 then p[2] / (p[2] + greatest(p[3], p[4], p[5])) end, 6) s from {FIVE_SQL}")
def contrastives(spark, d):
    return five(spark, d).select("idx", r6(P.contrastive(c("p"))).alias("s"))


@query("f24_review_scores", f"select id, round(greatest(0, 1 - abs(value / 20 - 5.8) / 2.2), 6) m, round(case when gap between 3 and 45 then 1 - least(abs(gap - 18) / 27, 1) else 0 end, 6) p from (select id, value, (id % 60)::double gap from {E})")
def review_scores(spark, d):
    return T.events(spark, d).select("id", r6(P.review_motion(c("value") / 20)).alias("m"), r6(P.anchor_proximity((c("id") % 60).cast("double"))).alias("p"))


@query("f26_scene_rejector", f"select id from {E} where not (coalesce(case when id % 4 <> 0 then value / 10 end, 0) > 9.5 and coalesce(case when id % 3 <> 0 then (id % 10) / 20.0 end, 0) < 0.25 and (id % 12) / 10.0 < 0.60)")
def scenes(spark, d):
    i = c("id")
    return T.events(spark, d).where(~P.scene_rejected(F.when(i % 4 != 0, c("value") / 10), F.when(i % 3 != 0, (i % 10) / 20.0), (i % 12) / 10.0)).select("id")


@query("f27_importance_weight", f"select id, coalesce(case when id % 3 = 0 then 0.5::double end, case when id % 2 = 0 and id % 5 < 3 then 1.0::double else 0.3::double end) w from {E}")
def weights(spark, d):
    i = c("id")
    return T.events(spark, d).select("id", P.importance_weight(F.when(i % 3 == 0, 0.5), i % 2 == 0, F.when(i % 5 < 3, "siglip2").otherwise("dinov2")).alias("w"))


LABELS = ("putter", "non-shot", "nonPutter", "driver", "wood", "iron", "wedge", "unsure")


@query("f28_label_class", f"select id, case when l = 'putter' then 'putter' when l in ('non-shot', 'nonPutter') then 'negative' when l in ('driver', 'wood', 'iron', 'wedge') then 'other-club' else 'unlabeled' end k from (select id, {lit_list(LABELS)}[id % 8 + 1] l from {E})")
def classes(spark, d):
    return T.events(spark, d).select("id", P.label_class(pick(LABELS, c("id") % 8)).alias("k"))


@query("f32_engine_quality", f"select id, round(rms * peak, 6) q from {A} where id % 6 <> 0 and id % 7 <> 0")
def engine(spark, d):
    i = c("id")
    q = P.engine_quality(F.when(i % 6 != 0, "ok").otherwise("failed"), F.when(i % 7 != 0, "measured").otherwise("unknown"), c("rms"), c("peak"))
    return T.audio(spark, d).select("id", r6(q).alias("q")).where("q is not null")


def _joint(k: int):
    i = c("id")
    return F.struct(((i * (k + 3)) % 101 / 101.0).alias("x"), ((i * (k + 7)) % 103 / 103.0).alias("y"), ((i + k * 5) % 11 / 10.0).alias("conf"))


_JOINT = "{{'x': (id * {a}) % 101 / 101.0::double, 'y': (id * {b}) % 103 / 103.0::double, 'conf': (id + {k} * 5) % 11 / 10.0::double}}"
_joints_sql = lambda *ks: "list_filter([" + ", ".join(_JOINT.format(a=k + 3, b=k + 7, k=k) for k in ks) + "], lambda j: j.conf >= 0.35)"
_avg = lambda a, f: f"list_avg(list_transform({a}, lambda j: j.{f}))"


@query(
    "s12_reduced_pose",
    f"""select id, round({_avg("w", "x")}, 6) hand_x, round(({_avg("s", "y")} + {_avg("h", "y")}) / 2, 6) core_y, round(greatest(0.04, sqrt(pow({_avg("s", "x")} - {_avg("h", "x")}, 2) + pow({_avg("s", "y")} - {_avg("h", "y")}, 2))), 6) scale,
    round(least({_avg("w", "conf")}, {_avg("s", "conf")}, {_avg("h", "conf")}), 6) conf from (select id, {_joints_sql(0, 1)} w, {_joints_sql(2, 3)} s, {_joints_sql(4, 5)} h from {E}) where len(w) > 0 and len(s) > 0 and len(h) > 0""",
)
def reduced(spark, d):
    x = T.events(spark, d).select("id", P.reduced_pose(*[F.array(_joint(k), _joint(k + 1)) for k in (0, 2, 4)]).alias("p")).where("p is not null")
    return x.select("id", *[r6(c("p")[n]).alias(n) for n in ("hand_x", "core_y", "scale", "conf")])


# ---- arrays ----------------------------------------------------------------------------------------------------------

_abs_sum = lambda a, n, b, m: f"list_sum(list_transform(range(1, {m} + 1), lambda k: abs({a}[{n} + k]::double - {b}[{n} + k]::double)))"


def _next(spark, d):
    """Each photo with the vector of the one before it in its set."""
    from pyspark.sql import Window

    return T.photos(spark, d).withColumn("f", F.lag("e").over(Window.partitionBy("set_id").orderBy("idx")))


_NEXT = f"(select *, lag(e) over (partition by set_id order by idx) f from {PHOTOS})"


@query("v03_perceptual_distance", f"select idx, round(least(1, greatest(0, 0.6 * {_abs_sum('e', 0, 'f', 40)} / 40 + 0.4 * {_abs_sum('e', 40, 'f', 24)} / 2)), 6) d from {_NEXT} where f is not null")
def perceptual(spark, d):
    part = lambda a, k, n: F.slice(a, k, n)
    return _next(spark, d).where("f is not null").select("idx", r6(V.perceptual_distance(part("e", 1, 40), part("e", 41, 24), part("f", 1, 40), part("f", 41, 24))).alias("d"))


@query("v05_region_difference", f"select idx, round(least(1, (select avg(abs(e[y * 8 + x + 1]::double - f[y * 8 + x + 1]::double)) from range(3, 8) a(y), range(2, 6) b(x))), 6) m from {_NEXT} where f is not null")
def region_difference(spark, d):
    return _next(spark, d).where("f is not null").select("idx", r6(V.mean_difference(V.region(c("e"), 8, 8), V.region(c("f"), 8, 8))).alias("m"))


@query("v01_whole_vector", f"select idx, round(list_sum(list_transform(range(1, 65), lambda k: e[k]::double / s * k)), 6) w from (select *, sqrt(list_dot_product(e::double[], e::double[])) s from {PHOTOS})")
def whole_vector(spark, d):
    n = S.l2_normalise(c("e"))
    return T.photos(spark, d).select("idx", r6(V.total(F.zip_with(n, F.sequence(F.lit(1), F.lit(64)), lambda x, k: x * k))).alias("w"))


@query("v10_per_index_aggregates", f"select clip, k, round(avg(v), 6) mean, round(max(v), 6) high, round(min(v), 6) low from (select clip, unnest([0, 1, 2, 3, 4]) k, unnest(p) v, n from {FIVE_SQL}) where not (n = k) group by all")
def per_index(spark, d):
    from moments.operators.evaluation import per_index as op

    x = five(spark, d).withColumn("p", F.transform("p", lambda v, k: F.when(k != c("n"), v)))
    return op(x, "clip", "p").select("clip", c("k").cast("int").alias("k"), r6("mean").alias("mean"), r6("high").alias("high"), r6("low").alias("low"))


@query("v11_prompt_scores", f"select idx, round(c, 6) cosine, round(c * 10 - 2, 6) logit, round(1 / (1 + exp(-(c * 10 - 2))), 6) score from (select idx, least(1, greatest(-1, list_dot_product(e::double[], f::double[]))) c from {_NEXT} where f is not null)")
def prompt_scores(spark, d):
    x = _next(spark, d).where("f is not null").select("idx", V.prompt_score(c("e"), c("f"), 10.0, -2.0).alias("s"))
    return x.select("idx", *[r6(c("s")[n]).alias(n) for n in ("cosine", "logit", "score")])


@query("v12_softmax", f"select idx, round(exp(p[2] - list_max(p)) / list_sum(list_transform(p, lambda x: exp(x - list_max(p)))), 6) s from {FIVE_SQL}")
def softmaxed(spark, d):
    return five(spark, d).select("idx", r6(V.softmax(c("p"))[1]).alias("s"))


@query(
    "v13_warped_distance",
    f"""with recursive x as (select idx, e[1:9]::double[] ax, e[11:19]::double[] ay, f[1:9]::double[] bx, f[11:19]::double[] by_ from {_NEXT} where f is not null),
    g(idx, k, row_, prev) as (select idx, 0, []::double[], list_transform(range(0, 10), lambda j: case when j = 0 then 0 else 'inf'::double end) from x union all
    select g.idx, k + 1, case when k % 9 = 8 then []::double[] else cell.r end, case when k % 9 = 8 then list_prepend('inf'::double, cell.r) else prev end from g join x on g.idx = x.idx,
    lateral (select list_append(row_, sqrt(pow(ax[k // 9 + 1] - bx[k % 9 + 1], 2) + pow(ay[k // 9 + 1] - by_[k % 9 + 1], 2)) + least(prev[k % 9 + 2], prev[k % 9 + 1], case when k % 9 = 0 then 'inf'::double else row_[k % 9] end)) r) cell where k < 81)
    select idx, round(prev[10] / 18, 6) d from g where k = 81""",
)
def warps(spark, d):
    at = lambda a, k: F.slice(a, k, 9).cast("array<double>")
    return _next(spark, d).where("f is not null").select("idx", r6(V.warped_distance(at("e", 1), at("e", 11), at("f", 1), at("f", 11))).alias("d"))


@query(
    "v14_shifted_distance",
    f"""select idx, round(least((select avg(abs(e[i]::double - f[i]::double)) from range(1, 6) r(i)), (select avg(abs(e[i]::double - f[i + 1]::double)) from range(1, 5) r(i)), (select avg(abs(e[i]::double - f[i - 1]::double)) from range(2, 6) r(i))), 6) d from {_NEXT} where f is not null""",
)
def shifted(spark, d):
    part = lambda a: F.slice(a, 1, 5)
    return _next(spark, d).where("f is not null").select("idx", r6(V.shifted_distance(part("e"), part("f"), lambda x, y: F.abs(x.cast("double") - y.cast("double")))).alias("d"))


@query(
    "v09_audio_blocks",
    f"""select src, k // 16 block, count(*) n, round(sqrt(sum(v / 32768.0 * v / 32768.0) / count(*)), 6) rms, round(max(abs(v / 32768.0)), 6) peak, sum(case when (v >= 0) <> (b >= 0) then 1 else 0 end)::bigint crossings from (
    select *, lag(v) over (partition by src order by k) b from (select src, k, case when id % 3 = 0 then -1 else 1 end * round(value * 50)::bigint v from {T._STEPS_SQL})) group by all""",
)
def sound_blocks(spark, d):
    x = T._steps(spark, d).select("src", "k", (F.when(c("id") % 3 == 0, -1).otherwise(1) * F.round(c("value") * 50).cast("long")).alias("v"))
    return V.audio_blocks(x, "src", "k", "v", 16).select("src", "block", c("count").alias("n"), r6("rms").alias("rms"), r6("peak").alias("peak"), "crossings")


@query("v04_pixel_descriptor")
def pixel_descriptors(spark, d):
    from moments.functions import pixels

    grey = F.transform(F.sequence(F.lit(0), F.lit(767)), lambda k: F.chr(F.pmod((F.element_at("e", (k % 64 + 1).cast("int")).cast("double") * 200).cast("int") + (k / 3).cast("int"), F.lit(128))))
    x = T.photos(spark, d).select("idx", F.encode(F.array_join(grey, ""), "US-ASCII").alias("raw"))
    x = x.select("idx", pixels.descriptor("raw", F.lit(16), F.lit(16)).alias("x"), pixels.laplacian_variance(F.substring("raw", 1, 256), F.lit(16), F.lit(16)).alias("sharp"))
    return x.select("idx", r6("x.sharpness").alias("sharpness"), r6("x.exposure").alias("exposure"), r6(V.total(c("x.hist"))).alias("mass"), r6("sharp").alias("laplacian"))


@query("v06_pixel_agreement")
def pixel_agreement(spark, d):
    from moments.functions import pixels

    grey = lambda add: F.transform(F.sequence(F.lit(0), F.lit(767)), lambda k: F.chr(F.pmod((F.element_at("e", (k % 64 + 1).cast("int")).cast("double") * 200).cast("int") + (k / 3).cast("int") + F.lit(add), F.lit(128))))
    x = T.photos(spark, d).select("idx", *[F.encode(F.array_join(grey(a), ""), "US-ASCII").alias(n) for n, a in (("a", 0), ("b", 3))])
    y = x.select("idx", pixels.pixel_agreement("a", F.lit(16), F.lit(16), "b", F.lit(16), F.when(c("idx") % 5 == 0, 8).otherwise(16)).alias("x")).select("idx", "x.*")
    return y.select("idx", "status", *[r6(n).alias(n) for n in ("ssim", "tile_ssim_min", "rgb_mad", "max_residual")])
