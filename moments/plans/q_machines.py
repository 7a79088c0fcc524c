"""Queries of the state machines, in batch and on streams. The oracles run the same machines as recursive SQL, a sample a step."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from moments.functions import scalars as S
from moments.operators import greedy
from moments.operators import machines as M
from moments.plans import testdata as T
from moments.plans.base import c, query, r6

E, A, POSE, VISUAL = T.EVENTS_SQL, T.AUDIO_SQL, T.POSE_SQL, T.VISUAL_SQL


def machine_sql(samples: str, state: dict[str, str], layers: list[dict[str, str]], new: dict[str, str], out: dict[str, str]) -> str:
    return "with recursive " + machine_cte(samples, state, layers, new, out, "x", "n")


def machine_cte(samples: str, state: dict[str, str], layers: list[dict[str, str]], new: dict[str, str], out: dict[str, str], xs: str, ns: str) -> str:
    """state: name -> first value; layers: expressions over n (state before), x (sample) and earlier layers; new: state after; out: over v (state after)."""
    lateral = ", ".join(f"lateral (select {', '.join(f'{e} {n}' for n, e in layer.items())}) l{k}" for k, layer in enumerate([*layers, {f'v_{n}': e for n, e in new.items()}]))
    names = ", ".join(state)
    return f"""{xs} as (select *, row_number() over (partition by src order by t, id) r from {samples}),
    {ns}(src, r, id, t, {names}, {', '.join(f'o_{o}' for o in out)}) as (select s.src, 0::bigint, null::bigint, null::double, {', '.join(state.values())}, {', '.join('null::varchar' if o == 'phase' else 'null::double' for o in out)} from (select distinct src from {xs}) s union all
    select n.src, x.r, x.id, x.t, {', '.join(f'v_{n}' for n in state)}, {', '.join(out.values())} from {ns} n join {xs} x on x.src = n.src and x.r = n.r + 1, {lateral})
    """


_D, _B = "null::double", "0::bigint"
# ---- motion ----------------------------------------------------------------------------------------------------------

_SHAKEN = "(x.global >= 0.16 or x.widespread >= 0.68 or x.bright >= 0.14)"
_MOTION_STATE = {"phase": "'seekingAddress'", "changed": "'-inf'::double", "quiet": _D, "since": _D, "seen": _B, "began": _D, "peak": "0::double", "moving": _B, "bef": "0::double", "region": "null::bigint", "hit": _D, "shaken": _B}
_MOTION_LAYERS = [
    {"g": _SHAKEN, "still": "x.local <= 0.075 and x.global <= 0.08 and x.widespread <= 0.32", "cand": "x.local >= 0.12 and x.conc >= 0.38 and x.widespread between 0.04 and 0.58", "far": "abs(coalesce(n.region, x.region) - x.region) > 1"},
    {"quiet2": "coalesce(n.quiet, x.t)", "cont": "coalesce(n.since is not null and x.t - n.since <= 0.35 and not far, false)", "mv2": "n.moving + (x.local >= 0.10)::int"},
    {"seen2": "case when cont then n.seen + 1 else 1 end", "since2": "case when cont then n.since else x.t end", "reg2": "case when cont then n.region else x.region end", "brs": "n.phase = 'backswing' and (x.t - n.began > 1.8 or (far and x.local >= 0.18))", "drs": "n.phase = 'downswing' and x.t - n.hit > 0.42"},
    {"rs": "(g and n.shaken + 1 >= 2) or (not g and (brs or drs))", "addr": "not g and n.phase = 'seekingAddress' and still and x.t - quiet2 >= 0.55", "back": "not g and n.phase = 'addressed' and cand and seen2 >= 2",
     "down": "not g and n.phase = 'backswing' and not brs and x.t - n.began >= 0.18 and mv2 >= 3 and x.local >= 0.20 and (x.local - n.bef >= 0.035 or x.local >= greatest(0.26, n.peak * 1.15))", "ad": "not g and n.phase = 'addressed'", "bs": "not g and n.phase = 'backswing'"},
]
_MOTION_NEW = {
    "phase": "case when rs then 'seekingAddress' when addr then 'addressed' when back then 'backswing' when down then 'downswing' else n.phase end",
    "changed": "case when g then x.t else n.changed end",
    "quiet": "case when rs then null when g or n.phase <> 'seekingAddress' then n.quiet when still then quiet2 end",
    "since": "case when rs or addr then null when ad and cand then since2 when ad and x.local <= 0.085 then null else n.since end",
    "seen": "case when rs or addr then 0 when ad and cand then seen2 when ad and x.local <= 0.085 then 0 else n.seen end",
    "began": "case when rs then null when back then since2 else n.began end",
    "peak": "case when rs then 0 when back then x.local when bs then greatest(n.peak, x.local) else n.peak end",
    "moving": "case when rs then 0 when back then seen2 when bs then mv2 else n.moving end",
    "bef": "case when rs then 0 when back or bs then x.local else n.bef end",
    "region": "case when rs then null when ad and cand then reg2 when ad and x.local <= 0.085 then null else n.region end",
    "hit": "case when rs then null when down then x.t else n.hit end",
    "shaken": "case when rs or not g then 0 else n.shaken + 1 end",
}


def _motion_out(t: str, quiet: str) -> dict[str, str]:
    ok = f"v_phase = 'downswing' and {t} >= v_hit and {t} - v_hit <= 0.42 and v_changed < v_hit"
    return {
        "phase": f"case when {quiet} then 'seekingAddress' when v_phase = 'downswing' and not ({ok}) then 'seekingAddress' else v_phase end",
        "conf": f"case when {quiet} then 0 when v_phase = 'downswing' then case when {ok} then greatest(0.72, least(1, 0.62 + v_peak * 0.95)) else 0 end when v_phase = 'backswing' then least(0.7, 0.34 + v_peak) when v_phase = 'addressed' then 0.28 else 0 end::double",
        "at": f"case when {quiet} then null when {ok} then v_hit end",
    }


_P01 = machine_sql(VISUAL, _MOTION_STATE, _MOTION_LAYERS, _MOTION_NEW, _motion_out("x.t", "g")) + "select id, o_phase phase, round(o_conf, 6) confidence, round(o_at, 6) impact_t from n where r > 0"


def _signal(df, at: str):
    return df.select("id", "phase", r6("confidence").alias("confidence"), r6(at).alias(at))


@query("p01_motion", _P01)
def motion(spark, d):
    return _signal(M.motion_signals(T.visual(spark, d), "src"), "impact_t")


@query("p04_signal_later", machine_sql(VISUAL, _MOTION_STATE, _MOTION_LAYERS, _MOTION_NEW, _motion_out("(x.t + 0.3::double)", "false")) + "select id, o_phase phase, round(o_conf, 6) confidence, round(o_at, 6) impact_t from n where r > 0")
def later(spark, d):
    x = M.motion_states(T.visual(spark, d), "src")
    s = M.motion_signal_at(c("phase"), c("peak"), c("hit"), c("changed"), c("t") + 0.3)
    return _signal(x.select("id", s.alias("s")).select("id", "s.*"), "impact_t")


# ---- swings and putts ------------------------------------------------------------------------------------------------

_LAST = {n: _D for n in ("lt", "lhx", "lhy", "lcx", "lcy", "lsc")}
_SAMPLE = {"lt": "x.t", "lhx": "x.hand_x", "lhy": "x.hand_y", "lcx": "x.core_x", "lcy": "x.core_y", "lsc": "x.scale"}
_POSE_STATE = {"phase": "'seekingAddress'", "quiet": _D, "px": "0::double", "py": "0::double", "rested": _B, **_LAST, "dx": "0::double", "dy": "0::double", "began": _D, "peak": "0::double", "bef": "0::double", "ret": _B}
_SWING_STATE = _POSE_STATE | {"st": _D, "en": _D, "sure": "0::double"}
_GAP = {"good": "x.conf >= 0.45 and x.scale >= 0.04", "gap": "x.conf >= 0.45 and x.scale >= 0.04 and coalesce(x.t - n.lt <= 0 or x.t - n.lt > 0.6 or abs(x.scale - n.lsc) / greatest(0.001, n.lsc) > 0.25, false)"}


def _entered(state: dict[str, str], kept: tuple[str, ...] = ()) -> dict[str, str]:
    """The state once a gap has had its effect."""
    return {f"e_{n}": (f"n.{n}" if n in kept else f"case when gap then {v} else n.{n} end") for n, v in state.items()}


_dist = lambda a, b: f"sqrt(pow({a}, 2) + pow({b}, 2))"
_SWING_LAYERS = [
    _GAP,
    _entered(_SWING_STATE) | {"e_sure2": "case when gap then 0 when good then x.conf else n.sure end"},
    {"dt": "greatest(0.05, x.t - coalesce(e_lt, x.t - 0.2::double))", "prog": "(x.hand_x - e_px) * e_dx + (x.hand_y - e_py) * e_dy", "far": _dist("x.hand_x - e_px", "x.hand_y - e_py"), "quiet2": "coalesce(e_quiet, e_lt)"},
    {"still": f"coalesce({_dist('x.hand_x - e_lhx', 'x.hand_y - e_lhy')} / dt <= 0.22 and {_dist('x.core_x - e_lcx', 'x.core_y - e_lcy')} / dt / greatest(0.04, x.scale) <= 0.20, false)", "peak2": "greatest(e_peak, prog)", "speed": "(e_bef - prog) / dt"},
    {"sk": "good and e_phase = 'seekingAddress'", "bs": "good and e_phase = 'backswing'", "rs": "good and ((e_phase = 'backswing' and x.t - e_began > 1.8) or (e_phase = 'impactWindow' and x.t > e_en))", "away": "good and e_phase = 'addressed' and far >= 0.20",
     "ret2": "case when x.t - e_began >= 0.18 and peak2 >= 0.28 and prog < e_bef and speed >= 0.55 then e_ret + 1 when prog >= e_bef then 0 else e_ret end"},
    {"addr": "sk and still and x.t - quiet2 >= 0.55 and e_rested + 1 >= 3", "imp": "bs and not rs and ret2 >= 2 and peak2 - prog >= greatest(0.18, peak2 * 0.55)"},
]
_SWING_NEW = {
    "phase": "case when rs then 'seekingAddress' when addr then 'addressed' when away then 'backswing' when imp then 'impactWindow' else e_phase end",
    "quiet": "case when rs then null when sk then case when still then quiet2 end else e_quiet end",
    "px": "case when rs then 0 when sk then case when still then e_px + (x.hand_x - e_px) * (1.0::double / (e_rested + 1)) else x.hand_x end else e_px end",
    "py": "case when rs then 0 when sk then case when still then e_py + (x.hand_y - e_py) * (1.0::double / (e_rested + 1)) else x.hand_y end else e_py end",
    "rested": "case when rs then 0 when sk then case when still then e_rested + 1 else 1 end else e_rested end",
    **{n: f"case when good then {v} else n.{n} end" for n, v in _SAMPLE.items()},
    "dx": "case when rs then 0 when away then (x.hand_x - e_px) / far else e_dx end",
    "dy": "case when rs then 0 when away then (x.hand_y - e_py) / far else e_dy end",
    "began": "case when rs then null when away then x.t else e_began end",
    "peak": "case when rs then 0 when away then far when bs then peak2 else e_peak end",
    "bef": "case when rs then 0 when away then far when bs then prog else e_bef end",
    "ret": "case when rs or away then 0 when bs then ret2 else e_ret end",
    "st": "case when rs then null when imp then x.t - 0.45::double else e_st end",
    "en": "case when rs then null when imp then x.t + 0.30::double else e_en end",
    "sure": "case when rs then 0 else e_sure2 end",
}
_IN = "v_phase = 'impactWindow' and x.t >= v_st and x.t <= v_en"
_SWING_OUT = {
    "phase": f"case when v_phase = 'impactWindow' and not ({_IN}) then 'seekingAddress' else v_phase end",
    "conf": f"case v_phase when 'impactWindow' then case when {_IN} then least(v_sure, least(1, 0.72 + v_peak * 0.45)) else 0 end when 'backswing' then least(0.7, 0.35 + v_peak) when 'addressed' then 0.32 else 0 end::double",
    "ws": f"case when {_IN} then v_st end", "we": f"case when {_IN} then v_en end",
}


@query("p02_swing", machine_sql(POSE, _SWING_STATE, _SWING_LAYERS, _SWING_NEW, _SWING_OUT) + "select id, o_phase phase, round(o_conf, 6) confidence, round(o_ws, 6) win_start, round(o_we, 6) win_end from n where r > 0")
def swing(spark, d):
    x = M.swing_signals(T.pose(spark, d), "src")
    return x.select("id", "phase", *[r6(n).alias(n) for n in ("confidence", "win_start", "win_end")])


_PUTT_STATE = _POSE_STATE | {"confirmed": "'-inf'::double", "fol": _B, "stroke": _D, "lst": "1::double", "lc": _D, "ls": _D}
_PUTT_LAYERS = [
    _GAP,
    _entered(_PUTT_STATE, ("confirmed",)),
    {"dt": "case when e_lt is null then 0.2::double else greatest(0.05, x.t - e_lt) end", "prog": "(x.hand_x - e_px) * e_dx + (x.hand_y - e_py) * e_dy", "far": _dist("x.hand_x - e_px", "x.hand_y - e_py"), "quiet2": "coalesce(e_quiet, e_lt, x.t)"},
    {"walk": f"coalesce({_dist('x.core_x - e_lcx', 'x.core_y - e_lcy')} / dt / greatest(0.04, x.scale), 0)", "peak2": "greatest(e_peak, prog)", "speed": "(e_bef - prog) / dt"},
    {"wk": "good and walk > 0.9", "lst2": "least(e_lst, x.conf)", "thr": "greatest(0.04, peak2 * 0.30)", "still": f"e_lt is null or (coalesce({_dist('x.hand_x - e_lhx', 'x.hand_y - e_lhy')} / dt, 0) <= 0.25 and walk <= 0.20)"},
    {"sk": "good and not wk and e_phase = 'seekingAddress'", "bs": "good and not wk and e_phase = 'backswing'", "fw": "good and not wk and e_phase = 'forwardStroke'", "cs": "good and not wk and e_phase = 'confirmedStroke'", "away": "good and not wk and e_phase = 'addressed' and far >= 0.06",
     "ret2": "case when x.t - e_began >= 0.15 and peak2 >= 0.12 and prog < e_bef and speed >= 0.20 then e_ret + 1 when prog >= e_bef then 0 else e_ret end", "fol2": "e_fol + (prog <= -greatest(0.025, e_peak * 0.15))::int"},
    {"prs": "(bs and (x.t - e_began > 2.0 or peak2 > 0.60 or (prog <= thr and speed > 1.5))) or (fw and (x.t - e_stroke > 0.9 or prog <= -greatest(0.30, e_peak * 1.2)))", "addr": "sk and still and x.t - quiet2 >= 0.60 and e_rested + 1 >= 3"},
    {"rs": "wk or cs or prs", "thru": "bs and not prs and ret2 >= 2 and prog <= thr", "done": "fw and not prs and fol2 >= 2 and x.t - e_confirmed >= 2.0"},
]
_PUTT_NEW = {
    "phase": "case when rs then 'seekingAddress' when addr then 'addressed' when away then 'backswing' when thru then 'forwardStroke' when done then 'confirmedStroke' else e_phase end",
    "quiet": "case when rs then null when sk then case when still then quiet2 end else e_quiet end",
    "px": "case when rs then 0 when sk then case when still then e_px + (x.hand_x - e_px) * (1.0::double / (e_rested + 1)) else x.hand_x end else e_px end",
    "py": "case when rs then 0 when sk then case when still then e_py + (x.hand_y - e_py) * (1.0::double / (e_rested + 1)) else x.hand_y end else e_py end",
    "rested": "case when rs then 0 when sk then case when still then e_rested + 1 else 1 end else e_rested end",
    **{n: f"case when not good then n.{n} when prs then null else {v} end" for n, v in _SAMPLE.items()},
    "dx": "case when rs then 0 when away then (x.hand_x - e_px) / far else e_dx end",
    "dy": "case when rs then 0 when away then (x.hand_y - e_py) / far else e_dy end",
    "began": "case when rs then null when away then x.t else e_began end",
    "peak": "case when rs then 0 when away then far when bs then peak2 else e_peak end",
    "bef": "case when rs then 0 when away then far when bs or fw then prog else e_bef end",
    "ret": "case when rs or away then 0 when bs then ret2 else e_ret end",
    "confirmed": "case when done then x.t else e_confirmed end",
    "fol": "case when rs or thru then 0 when fw then fol2 else e_fol end",
    "stroke": "case when rs then null when thru then x.t else e_stroke end",
    "lst": "case when rs then 1 when addr then x.conf when good then lst2 else e_lst end",
    "lc": "case when cs then e_lc when rs then null when done then least(lst2, least(1, 0.62 + e_peak * 0.9)) else e_lc end",
    "ls": "case when cs then e_ls when rs then null when done then e_stroke else e_ls end",
}
_PUTT_OUT = {
    "phase": "v_phase",
    "conf": "case v_phase when 'confirmedStroke' then coalesce(v_lc, 0) when 'forwardStroke' then least(0.7, 0.4 + v_peak) when 'backswing' then least(0.6, 0.3 + v_peak) when 'addressed' then 0.3 else 0 end::double",
    "at": "case when v_phase = 'confirmedStroke' then v_ls end",
    "lc": "v_lc", "ls": "v_ls", "cf": "v_confirmed",
}
_PUTT = machine_sql(POSE, _PUTT_STATE, _PUTT_LAYERS, _PUTT_NEW, _PUTT_OUT)


@query("p03_putt", _PUTT + "select id, o_phase phase, round(o_conf, 6) confidence, round(o_at, 6) stroke_t from n where r > 0")
def putt(spark, d):
    return _signal(M.putt_signals(T.pose(spark, d), "src"), "stroke_t")


@query("g12_f33_strokes", _PUTT + "select id, round(o_at, 6) stroke_t, round(o_conf, 6) confidence from n where o_phase = 'confirmedStroke' and o_at is not null qualify row_number() over (partition by src, o_at order by r) = 1")
def strokes(spark, d):
    # a stroke is confirmed once, but a poor sample after it still shows the same signal
    x = M.putt_signals(T.pose(spark, d), "src").where("phase = 'confirmedStroke' and stroke_t is not null")
    kept = greedy.refractory(x.select("src", c("stroke_t").alias("t"), "id"), "src", 1.0)
    return x.join(kept.select("src", "id"), ["src", "id"]).select("id", r6("stroke_t").alias("stroke_t"), r6("confidence").alias("confidence"))


@query("p05_latch_reads", _PUTT + "select id, case when t + 0.1 - o_cf <= 0.60 then round(o_lc, 6) end confidence, case when t + 0.1 - o_cf <= 0.60 then round(o_ls, 6) end stroke_t from n where r > 0")
def latch_reads(spark, d):
    p = T.pose(spark, d)
    events = p.withColumn("op", F.lit("sample")).unionByName(p.withColumn("op", F.lit("read")).withColumn("t", c("t") + 0.1))
    return M.latch_reads(events, "src").select("id", r6("confidence").alias("confidence"), r6("stroke_t").alias("stroke_t"))


_SOUND = "((k + src) % 40 in (8, 14, 29))"
_SOUNDS = f"(select src, id, {T._T_SQL} + 0.05::double t, case when {_SOUND} then 0.06::double else 0.004 end rms, case when {_SOUND} then 0.30::double else 0.01 end peak, case when {_SOUND} then 0.12::double else 0.02 end crossing from {T._STEPS_SQL})"


def sounds(spark, d):
    """A sound at each step, a sharp one at some."""
    loud = ((c("k") + c("src")) % 40).isin(8, 14, 29)
    return T._steps(spark, d).select("src", "id", (c("t") + 0.05).alias("t"), F.when(loud, 0.06).otherwise(0.004).alias("rms"), F.when(loud, 0.30).otherwise(0.01).alias("peak"), F.when(loud, 0.12).otherwise(0.02).alias("crossing"))


_FUSED = "with recursive " + machine_cte(VISUAL, _MOTION_STATE, _MOTION_LAYERS, _MOTION_NEW, {"phase": "v_phase", "peak": "v_peak", "hit": "v_hit", "changed": "v_changed"}, "x", "n") + ", " + machine_cte(POSE, _SWING_STATE, _SWING_LAYERS, _SWING_NEW, _SWING_OUT, "y", "m") + f""",
u as (select a.*, arg_max({{'p': n.o_phase, 'k': n.o_peak, 'h': n.o_hit, 'c': n.o_changed}}, n.r) s from {_SOUNDS} a join n on n.src = a.src and n.r > 0 and n.t <= a.t group by all),
w as (select a.id, arg_max({{'p': m.o_phase, 'k': m.o_conf, 's': m.o_ws, 'e': m.o_we}}, m.r) q from {_SOUNDS} a join m on m.src = a.src and m.r > 0 and m.t <= a.t group by all)
select u.id, (coalesce(s.p = 'downswing' and u.t >= s.h and u.t - s.h <= 0.42 and s.c < s.h and u.t - s.h between -0.20::double and 0.32::double, false) or coalesce(q.p = 'impactWindow' and q.k >= 0.72 and u.t between q.s and q.e, false)) and peak >= 0.10 and crossing >= 0.08 and peak / greatest(0.001, rms) >= 3.5
and least(1.0, 0.55 * rms + 0.45 * peak + 0.35 * least(1.0, 10 * crossing) * rms) >= 0.065 fires from u left join w on w.id = u.id"""


@query("j18_signal_fusion", _FUSED)
def signal_fusion(spark, d):
    from moments.functions.policies import model_versions, swing_trigger

    x = M.fused_signals(sounds(spark, d), M.motion_states(T.visual(spark, d), "src"), M.swing_signals(T.pose(spark, d), "src"), "src")
    x = x.withColumns({"version": F.lit("0.7.0"), "triggered": F.lit(False), "needs_pose": F.lit(False), "recent_frame": F.lit(True), "ready_prompt": F.lit(False), "tracked": F.lit(True), "ref_t": c("t")})
    return swing_trigger(x, model_versions(spark)).select("id", "fires")


@query("a22_suffix_confirmations")
def suffixes(spark, d):
    p = T.pose(spark, d)
    x = p.select(F.concat_ws("-", "src", F.floor(c("k") / 20).cast("string")).alias("clip"), F.when(c("src") % 2 == 0, "half").otherwise("full").alias("label"), "id", *M.POSE_COLUMNS)
    return M.suffix_confirmations(x, "clip", "label").select("label", "total", "confirmed")


# ---- levels, streams -------------------------------------------------------------------------------------------------

_SCORE = "least(1.0, 0.55 * rms + 0.45 * peak + 0.35 * least(1.0, 10 * crossing) * rms)"


@query("p06_levels", machine_sql(f"(select src, id, t, {_SCORE} score from {A})", {"b": "0.012::double", "q": "0.012::double"}, [], {"b": "n.b * 0.985::double + least(1, greatest(0, x.score)) * 0.015::double", "q": "n.q * 0.72::double + x.score * 0.28::double"}, {"at": "v_b"}) + "select id, round(b, 6) baseline, round(q, 6) recent from n where r > 0")
def level_series(spark, d):
    x = T.audio(spark, d).select("src", "id", "t", S.impact_score(c("rms"), c("peak"), c("crossing")).alias("score"))
    return M.levels(x, "src").select("id", r6("baseline").alias("baseline"), r6("recent").alias("recent"))


def _shared(spark) -> str:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/moments-streams-{os.getpid()}"


def _slices(spark, rows, name: str):
    """The rows as a stream of three slices, in order of time. A slice is many files, a source in one of them."""
    import uuid

    files = 2 * spark.sparkContext.defaultParallelism
    path = f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    for lo, hi in ((0, 20), (20, 45), (45, 1 << 40)):
        rows.where((c("k") >= lo) & (c("k") < hi)).drop("k").repartition(files, "src").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("k").schema).option("maxFilesPerTrigger", files).parquet(path)


@query("p01_motion_stream", _P01)
def motion_stream(spark, d):
    from moments.streaming import machines as ST

    out = ST.finish(ST.motion_stream(_slices(spark, T.visual(spark, d), "visual"), "src"), _shared(spark))
    return _signal(out, "impact_t")


def _trigger_rows(spark, d):
    return M.trigger_rows("src", sounds(spark, d), T.visual(spark, d), T.pose(spark, d))


@query("p08_triggers")
def triggers(spark, d):
    return M.triggers(_trigger_rows(spark, d), "src").select("src", "kind", "id", r6("t").alias("t"), r6("confidence").alias("confidence"))
