"""Queries of rank fusion grids, weights, logistic fits and bounded re-ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moments.functions import scalars as S
from moments.functions.policies import label_class
from moments.operators import calibration as K
from moments.operators import greedy, ranges
from moments.operators import windows as W
from moments.plans import testdata as T
from moments.plans.base import c, query, r6
from moments.plans.q_scalars import FIVE_SQL, LABELS, five, lit_list, pick
from moments.plans.q_windows import SCORE_SQL, features_sql

C, E, POSE = T.CLIPS_SQL, T.EVENTS_SQL, T.POSE_SQL


def _rows(spark, d):
    return T.clips(spark, d).withColumnRenamed("g", "grp")


_GRID = f"""(select *, row_number() over (partition by head, alpha order by fixed desc, case when fixed then re end, fused desc, re, id) position from (select *, re <= head or alpha = 0 fixed, case when alpha = 0 or not whole then 1.0::double / (60 + re) else (1.0 - alpha) / (60 + re) + alpha / (60 + rs) end fused from (
select *, row_number() over (order by expert desc, id) re, row_number() over (order by coalesce(semantic, -1e9) desc, id) rs, bool_and(semantic is not null) over (partition by g) whole from {C}), (select unnest([0, 3, 5, 10]) head), (select unnest([0.0, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5]::double[]) alpha)))"""


def metrics_sql(rows: str, by: str, total: str = "sum(h)") -> str:
    return f"(select {by}, count(*) n, sum(h * hits / position) / nullif({total}, 0) ap, sum(case when position <= 10 then h else 0 end) / least(10, count(*)) p10, sum(case when position <= 20 then h else 0 end) / least(20, count(*)) p20 from (select *, sum(h) over (partition by {by} order by position) hits from (select *, positive::int h from {rows})) group by {by})"


_REPORT = f"(select m.head, m.alpha, m.ap, m.p10, m.p20, m.ap - b.ap d_ap, m.p10 - b.p10 d_p10, m.p20 - b.p20 d_p20 from {metrics_sql(_GRID, 'head, alpha')} m, {metrics_sql(_GRID, 'head, alpha')} b where b.head = 0 and b.alpha = 0)"
_FIT = "d_ap >= -1e-12 and d_p10 >= -1e-12 and d_p20 >= -1e-12"


@query("m04_fusion_grid", f"select head, alpha, {', '.join(f'round({n}, 6) {n}' for n in ('ap', 'p10', 'p20', 'd_ap', 'd_p10', 'd_p20'))}, {_FIT} eligible, d_ap > 1e-12 gains from {_REPORT}")
def fusion_grid(spark, d):
    x = K.fusion_report(K.fusion_grid(_rows(spark, d)))
    return x.select("head", "alpha", *[r6(n).alias(n) for n in ("ap", "p10", "p20", "d_ap", "d_p10", "d_p20")], "eligible", "gains")


@query("m04_t08_fusion_choice", f"select case when head is null then 'expert' when head = 0 then 'weighted' else 'protected' end \"method\", coalesce(alpha, 0) alpha, coalesce(head, 0) head, round(coalesce(d_ap, 0), 6) d_ap, coalesce(d_ap < 0.005, false) fragile from (select 1) left join (select * from {_REPORT} where {_FIT} and d_ap > 1e-12 order by ap desc, p20 desc, p10 desc, head > 0, alpha, head limit 1) on true")
def fusion_choice(spark, d):
    return K.fusion_choice(K.fusion_report(K.fusion_grid(_rows(spark, d)))).select("method", "alpha", "head", r6("d_ap").alias("d_ap"), "fragile")


@query(
    "m10_block_diagnostics",
    f"select m.g grp, t.n rows, t.p positives, round(m.ap, 6) ap, round(m.p10, 6) p10, round(m.p20, 6) p20, t.n < 30 or t.p < 5 few from {metrics_sql('(select g, positive, row_number() over (partition by g order by position) position from ' + _GRID + ' where head = 3 and alpha = 0.2)', 'g')} m join (select g, count(*) n, count(*) filter (where positive) p from {C} group by 1) t on t.g = m.g",
)
def block_diagnostics(spark, d):
    x = _rows(spark, d)
    return K.block_diagnostics(K.fusion_grid(x, (3,), (0.2,)), x).select("grp", "rows", "positives", r6("ap").alias("ap"), r6("p10").alias("p10"), r6("p20").alias("p20"), "few")


_BEST = f"""(select *, row_number() over (partition by weight, method order by score desc, clip) position from (select weight, method, clip, positive, n, score from (select *, case when weight = 0 then q when method = 'raw' then (1.0 - weight) * q + weight * p[2] when p[2] + greatest(p[3], p[4], p[5]) >= 1e-6 then (1.0 - weight) * q + weight * (p[2] / (p[2] + greatest(p[3], p[4], p[5]))) end score
from {FIVE_SQL}, (select unnest([0.0, 0.3, 0.6, 0.85, 1.0]::double[]) weight), (select unnest(['raw', 'contrastive']) method) where q >= 0.25) where score is not null qualify row_number() over (partition by weight, method, clip order by score desc, n) = 1))"""
_WEIGHTS = metrics_sql(_BEST, "weight, method", f"(select count(distinct clip) from {FIVE_SQL} where positive)")


@query("a16_best_frames", f"select weight, method, clip, n, round(score, 6) score from {_BEST}")
def best_frames(spark, d):
    return K.best_frames(five(spark, d)).select("weight", "method", "clip", "n", r6("score").alias("score"))


@query("m05_weight_grid", f"select weight, method, n, round(ap, 6) ap, round(p10, 6) p10, round(p20, 6) p20 from {_WEIGHTS}")
def weight_grid(spark, d):
    return K.weight_report(five(spark, d)).select("weight", "method", "n", r6("ap").alias("ap"), r6("p10").alias("p10"), r6("p20").alias("p20"))


@query(
    "m05_t08_weight_choice",
    f"""with m as (select * from {_WEIGHTS}), t as (select * from m order by coalesce(ap, -1) desc, coalesce(p10, -1) desc, coalesce(p20, -1) desc, method <> 'raw', abs(weight - 0.3), weight limit 1)
    select m.weight, m.method, round(m.ap, 6) ap, round(m.p10, 6) p10, round(m.p20, 6) p20 from m, t where t.ap - m.ap <= 0.005 and coalesce(t.p10 - m.p10, 0) <= 0.1 and coalesce(t.p20 - m.p20, 0) <= 0.05 order by m.method <> 'raw', abs(m.weight - 0.3) >= 1e-9, abs(m.weight - 0.3), m.weight limit 1""",
)
def weight_choice(spark, d):
    return K.weight_choice(K.weight_report(five(spark, d))).select("weight", "method", r6("ap").alias("ap"), r6("p10").alias("p10"), r6("p20").alias("p20"))


# ---- logistic fusion -------------------------------------------------------------------------------------------------


def _features(spark, d):
    x = _rows(spark, d)
    return x.select("id", "grp", "positive", "expert", S.logit(F.coalesce("semantic", F.lit(0.5))).alias("semantic"), ((c("id") * 31 % 97) / 97.0).alias("motion"))


@query("m07_blocked_logistic")
def blocked_logistic(spark, d):
    x = K.blocked_logistic(_features(spark, d), [["expert", "semantic"], ["expert", "semantic", "motion"]])
    return x.select("features", "l2", "head", *[F.round(n, 4).alias(n) for n in ("ap", "p10", "p20", "gain")], "converged", "passed")


_MU = {"expert": 0.5, "semantic": 0.1, "motion": 0.48}
_SD = {"expert": 0.29, "semantic": 1.7, "motion": 0.28}
_B = {"expert": 0.8, "semantic": 0.35, "motion": -0.2}
_Z = "0.25 + 0.8 * ((expert - 0.5) / 0.29) + 0.35 * ((semantic - 0.1) / 1.7) + -0.2 * ((motion - 0.48) / 0.28)"
_FEAT = f"(select id, g, expert, ln(p / (1 - p)) semantic, (id * 31 % 97) / 97.0::double motion from (select *, least(1 - 1e-6, greatest(1e-6, coalesce(semantic, 0.5))) p from {C}))"


@query("m08_frozen_scores", f"select g grp, id, round(z, 6) score, row_number() over (partition by g order by re <= 5 desc, case when re <= 5 then re end, z desc, re, id) position from (select *, {_Z} z, row_number() over (partition by g order by expert desc, id) re from {_FEAT})")
def frozen_scores(spark, d):
    x = K.protected_order(K.linear_scores(_features(spark, d), 0.25, _B, _MU, _SD), ["grp"], "score", 5)
    return x.select("grp", "id", r6("score").alias("score"), c("position").cast("long").alias("position"))


# ---- bounded re-ranking ----------------------------------------------------------------------------------------------


def _evidence(spark, d):
    """Four groups of labelled rows with two semantic scores."""
    x = T.clips(spark, d)
    return x.select("id", (c("id") % 4).alias("grp"), "positive", "expert", ((c("id") * 7919 % 1009) / 1009.0).alias("full"), ((c("id") * 7919 % 1013) / 1013.0).alias("short"))


_KNOWN = {"full_high": 0.75, "full_low": 0.25, "short_high": 0.75, "short_low": 0.25, "scale": 0.004}
_CONF = K.safe_settings()[30]


@query("g09_bounded_ranks")
def bounded_ranks(spark, d):
    return K.bounded_ranks(_evidence(spark, d), "grp", _CONF, _KNOWN)


@query("g10_order_contract", f"select id % 4 grp, {_CONF["shift"]} >= 0 \"within\", true head_kept, true ties_kept from {C} group by 1")
def order_contract(spark, d):
    x = _evidence(spark, d)
    ranked = K.bounded_ranks(x, "grp", _CONF, _KNOWN).join(x.select("grp", "id", "expert"), ["grp", "id"])
    return K.order_contract(ranked, "grp", 3).select("grp", (c("shift") <= _CONF["shift"]).alias("within"), "head_kept", "ties_kept")


@query("m06_safe_grid")
def safe_grid(spark, d):
    return K.safe_grid(_evidence(spark, d)).select("setting", F.round("gain", 6).alias("gain"), "moved", "shift", "head_kept", "passed")


# ---- search of window settings ---------------------------------------------------------------------------------------

_HALVES, _STEPS = (0.4, 0.8, 1.25), (1, 2, 3)
_TRIAL = """x{n} as (select {h}::double half, s step, p.src, p.id, p.t, round({score}, 9) score from {f} f join {pose} p on p.id = f.cid, (select unnest([1, 2, 3]) s) where p.k % s = 0)"""
_LABELLED = f"(select src, id, t u, {lit_list(LABELS)}[id % 8 + 1] l from {POSE} where k % 9 = 4)"


def _trials_sql() -> str:
    ctr = f"(select src, id cid, t c from {POSE})"
    parts = []
    for n, h in enumerate(_HALVES):
        rows = f"(select c.src, c.cid, p.t, p.id, hand_x, hand_y, core_x, core_y, scale, conf from {ctr} c join {POSE} p on p.src = c.src and p.t between c.c - {h}::double and c.c + {h}::double)"
        parts.append(_TRIAL.format(n=n, h=h, score=SCORE_SQL, f=features_sql(rows, 5, 0.004), pose=POSE))
    return f"""with recursive {', '.join(parts)}, x as (select *, row_number() over (partition by half, step, src order by score desc, t, id) r from ({' union all '.join(f'select * from x{n}' for n in range(len(_HALVES)))})),
    n(half, step, src, r, kept) as (select distinct half, step, src, 0::bigint, []::double[] from x union all select x.half, x.step, x.src, x.r, case when len(list_filter(n.kept, lambda k: abs(k - x.t) < 3.0)) = 0 then list_append(n.kept, x.t) else n.kept end from n join x on x.half = n.half and x.step = n.step and x.src = n.src and x.r = n.r + 1),
    sel as (select x.* from n join n p on p.half = n.half and p.step = n.step and p.src = n.src and p.r = n.r - 1 join x on x.half = n.half and x.step = n.step and x.src = n.src and x.r = n.r where len(n.kept) > len(p.kept) qualify row_number() over (partition by x.half, x.step order by x.score desc, x.src, x.t, x.id) <= 30),
    hit as (select distinct s.half, s.step, l.id, case when l.l = 'putter' then 'p' when l.l in ('non-shot', 'nonPutter') then 'n' when l.l in ('driver', 'wood', 'iron', 'wedge') then 'o' end k from sel s join {_LABELLED} l on l.src = s.src and abs(l.u - s.t) <= 3.0)
    select c.half, c.step::int step, c.selected, coalesce(p, 0) putter, coalesce(q, 0) negative, coalesce(o, 0) other, 5 * coalesce(p, 0) - 2 * coalesce(q, 0) - coalesce(o, 0) objective, row_number() over (order by 5 * coalesce(p, 0) - 2 * coalesce(q, 0) - coalesce(o, 0) desc, coalesce(p, 0) desc, coalesce(q, 0), c.half, c.step)::int place
    from (select half, step, count(*) selected from sel group by 1, 2) c left join (select half, step, count(*) filter (where k = 'p') p, count(*) filter (where k = 'n') q, count(*) filter (where k = 'o') o from hit group by 1, 2) h on h.half = c.half and h.step = c.step"""


@query("m09_t07_window_search", _trials_sql())
def window_search(spark, d):
    p = T.pose(spark, d)
    labels = p.where("k % 9 = 4").select("src", "id", c("t").alias("u"), label_class(pick(LABELS, c("id") % 8)).alias("k"))
    x = W.windowed(p, "src", {f"w{n}": (-h, h) for n, h in enumerate(_HALVES)})
    per = F.array(*[F.struct(F.lit(h).alias("half"), W.stroke_features(c(f"w{n}")).alias("f")) for n, h in enumerate(_HALVES)])
    x = x.select("src", "id", "t", "k", F.explode(per).alias("x")).select("src", "id", "t", "k", "x.half", "x.f").where("f is not null")
    x = K.with_settings(x, step=_STEPS).where("k % step = 0")
    f = c("f")
    score = F.round(S.stroke_score(f["range_x"], f["core"], f["ratio"], f["reversals"], f["path"]), 9)
    x = x.select(F.struct("half", "step", "src").alias("key"), "t", score.alias("score"), "id")
    kept = greedy.temporal_nms(x, "key", 3.0).select("key.*", "t", "score", "id")
    best = kept.withColumn("r", F.row_number().over(Window.partitionBy("half", "step").orderBy(F.desc("score"), "src", "t", "id"))).where("r <= 30")
    hit = ranges.band_join(best.select("src", "t", "half", "step"), labels.withColumnRenamed("id", "label_id"), "src", 3.0).select("half", "step", "label_id", "k").distinct()
    n = lambda k: F.count_if(c("k") == k)
    counts = hit.groupBy("half", "step").agg(n("putter").alias("putter"), n("negative").alias("negative"), n("other-club").alias("other"))
    y = best.groupBy("half", "step").agg(F.count(F.lit(1)).alias("selected")).join(counts, ["half", "step"], "left").na.fill(0)
    y = y.withColumn("objective", 5 * c("putter") - 2 * c("negative") - c("other"))
    return y.withColumn("place", F.row_number().over(Window.orderBy(F.desc("objective"), F.desc("putter"), "negative", "half", "step")))
