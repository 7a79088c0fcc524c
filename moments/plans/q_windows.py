"""Queries of window features, resampling, schedules and the orders and sets of candidate lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moments.functions import scalars as S
from moments.functions import vectors as V
from moments.functions.policies import review_motion
from moments.operators import greedy, ranges, sets
from moments.operators import windows as W
from moments.plans import testdata as T
from moments.plans.base import c, query, r6
from moments.plans.q_scalars import FIVE_SQL, five

E, POSE, PHOTOS, C = T.EVENTS_SQL, T.POSE_SQL, T.PHOTOS_SQL, T.CLIPS_SQL


def features_sql(rows: str, minimum: int, deadband: float) -> str:
    """Features of windows (src, cid, t, id, hand_x, ...)."""
    return f"""(select src, cid, count(*) n, max(hand_x) - min(hand_x) range_x, max(hand_y) - min(hand_y) range_y, coalesce(sum(far), 0) path, sqrt(pow(max(core_x) - min(core_x), 2) + pow(max(core_y) - min(core_y), 2)) core, coalesce(max(far / greatest(0.05, dt)), 0) peak,
    sum(case when abs(dx) >= {deadband} and abs(pdx) >= {deadband} and dx * pdx < 0 then 1 else 0 end)::bigint reversals, (max(hand_y) - min(hand_y)) / greatest(max(hand_x) - min(hand_x), 0.01) ratio, max(t) - min(t) span from (
    select *, sqrt(dx * dx + dy * dy) far, lag(dx) over (partition by src, cid order by t, id) pdx from (select *, hand_x - lag(hand_x) over v dx, hand_y - lag(hand_y) over v dy, t - lag(t) over v dt from {rows} window v as (partition by src, cid order by t, id)))
    group by 1, 2 having count(*) >= {minimum})"""


def window_sql(centers: str, low: float, high: float) -> str:
    return f"(select c.src, c.cid, p.t, p.id, hand_x, hand_y, core_x, core_y, scale, conf from {centers} c join {POSE} p on p.src = c.src and p.t between c.c + ({low}::double) and c.c + {high}::double)"


def ramp(x, low, width):
    return f"least(1.0, greatest(0.0, ({x} - {low}) / {width}))"


SCORE_SQL = f"(0.28 * {ramp('range_x', 0.035, 0.2)} + 0.17 * {ramp('-range_x', -0.34, 0.25)} + 0.23 * {ramp('-core', -0.27, 0.18)} + 0.14 * {ramp('-ratio', -1.25, 0.9)} + 0.14 * least(1.0, reversals / 2.0) + 0.04 * {ramp('path', 0.05, 0.75)})"
STRICT_SQL = "range_x between 0.05 and 0.30 and core <= 0.32 and path between 0.08 and 2.0 and reversals >= 1 and ratio <= 0.60"
CONF_SQL = "case when range_x between 0.05 and 0.30 then 0.28::double else 0 end + case when core <= 0.32 then 0.24::double else 0 end + case when path between 0.08 and 2.0 then 0.20::double else 0 end + case when reversals >= 1 then 0.28::double else 0 end + case when ratio <= 0.60 then 0.10::double else 0 end"
_EVERY = f"(select src, id cid, t c from {POSE} where k % 2 = 0)"
_F = ("range_x", "range_y", "path", "core", "peak", "ratio")


@query("a01_w01_stroke_windows", f"select cid id, n, {', '.join(f'round({f}, 6) {f}' for f in _F)}, reversals, round({SCORE_SQL}, 6) score from {features_sql(window_sql(_EVERY, -0.8, 0.8), 5, 0.004)}")
def stroke_windows(spark, d):
    x = W.windowed(T.pose(spark, d), "src", {"rows": (-0.8, 0.8)}).where("k % 2 = 0").select("id", W.stroke_features(c("rows")).alias("f")).where("f is not null").select("id", "f.*")
    score = S.stroke_score(c("range_x"), c("core"), c("ratio"), c("reversals"), c("path"))
    return x.select("id", c("n").cast("long").alias("n"), *[r6(f).alias(f) for f in _F], c("reversals").cast("long").alias("reversals"), r6(score).alias("score"))


_SERIES = f"""with recursive ends as (select src, min(t) a, max(t) b from {POSE} group by 1 having max(t) - min(t) >= 1.6),
ctr(src, k, c, b) as (select src, 0, a + 1.6::double / 2.0, b from ends where a + 1.6::double / 2.0 <= b - 0.8 union all select src, k + 1, c + 0.2::double, b from ctr where c + 0.2::double <= b - 0.8::double),
w as (select ctr.src, ctr.k cid, p.t, p.id, hand_x, hand_y, core_x, core_y, scale, conf from ctr join {POSE} p on p.src = ctr.src and abs(p.t - ctr.c) <= 0.8::double where conf >= 0.45 and scale >= 0.04),
f as (select *, {CONF_SQL} score from {features_sql('w', 7, 0.008)} where span <= 4.0 and {STRICT_SQL}),
hit as (select f.src, f.cid id, ctr.c t, f.score from f join ctr on ctr.src = f.src and ctr.k = f.cid)"""


@query("w02_series_windows", f"{_SERIES} select src, round(t, 6) t, round(score, 6) score from hit")
def series_windows(spark, d):
    return W.series_windows(T.pose(spark, d), "src").select("src", r6("t").alias("t"), r6("score").alias("score"))


@query(
    "w02_g01_series_detections",
    f"""{_SERIES}, x as (select *, row_number() over (partition by src order by score desc, t) r from hit),
    n(src, r, kept) as (select distinct src, 0::bigint, []::double[] from x union all select x.src, x.r, case when len(list_filter(n.kept, lambda k: abs(k - x.t) < 1.0)) = 0 then list_append(n.kept, x.t) else n.kept end from n join x on x.src = n.src and x.r = n.r + 1)
    select x.src, round(x.t, 6) t, round(x.score, 6) score from n join n p on p.src = n.src and p.r = n.r - 1 join x on x.src = n.src and x.r = n.r where len(n.kept) > len(p.kept)""",
)
def series_detections(spark, d):
    x = W.series_windows(T.pose(spark, d), "src").withColumn("id", F.lit(0))
    return greedy.temporal_nms(x, "src", 1.0).select("src", r6("t").alias("t"), r6("score").alias("score"))


_FEW = f"(select src, id, t from {POSE} where k % 12 = 5)"


@query(
    "w16_candidate_scores",
    f"""with recursive cand as {_FEW}, raw as (select cand.src, cand.id cand, p.* exclude (src) from cand join {POSE} p on p.src = cand.src and abs(p.t - cand.t) <= 4.0),
    st as (select cand, min(t) a, max(t) b, count(*) filter (where conf >= 0.45 and scale >= 0.04) n, max(t) filter (where conf >= 0.45 and scale >= 0.04) - min(t) filter (where conf >= 0.45 and scale >= 0.04) span from raw group by 1),
    ctr(cand, k, c, b) as (select cand, 0, a + 0.8::double, b from st where n >= 7 and span >= 1.6 and a + 0.8::double <= b - 0.8::double union all select cand, k + 1, c + 0.2::double, b from ctr where c + 0.2::double <= b - 0.8::double),
    w as (select ctr.cand src, ctr.k cid, r.t, r.id, hand_x, hand_y, core_x, core_y, scale, conf from ctr join raw r on r.cand = ctr.cand and abs(r.t - ctr.c) <= 0.8::double where conf >= 0.45 and scale >= 0.04),
    f as (select src cand, max({CONF_SQL}) s from {features_sql('w', 7, 0.008)} where span <= 4.0 and {STRICT_SQL} group by 1)
    select cand.id, coalesce(st.n, 0) n, case when st.n >= 7 and st.span >= 1.6 then 'ok' else 'insufficient-pose' end status, round(case when st.n >= 7 and st.span >= 1.6 then coalesce(f.s, 0) end, 6) score from cand left join st on st.cand = cand.id left join f on f.cand = cand.id""",
)
def candidate_scores(spark, d):
    p = T.pose(spark, d)
    x = W.candidate_scores(p.where("k % 12 = 5").select("src", "id", "t"), p, "src")
    return x.select("id", c("n").cast("long").alias("n"), "status", r6("score").alias("score"))


@query(
    "w03_context_scores",
    f"""select c.cid id, round(coalesce(0.65 * exp(-0.8 * (a.path + b.path)) + 0.35 * exp(-1.2 * (a.core + b.core)), 0), 6) score from {_EVERY} c left join {features_sql(window_sql(_EVERY, -1.8, -0.8), 5, 0.004)} a on a.cid = c.cid left join {features_sql(window_sql(_EVERY, 0.8, 1.8), 5, 0.004)} b on b.cid = c.cid""",
)
def context_scores(spark, d):
    x = W.windowed(T.pose(spark, d), "src", {"before": (-1.8, -0.8), "after": (0.8, 1.8)}).where("k % 2 = 0")
    return x.select("id", r6(W.context_score(c("before"), c("after"))).alias("score"))


_O = "[-0.9, -0.7, -0.5, -0.3, -0.1, 0.1, 0.3, 0.5, 0.7, 0.9]::double[]"
_ABS = lambda k: f"abs(v[{k + 1}] - rest)"


@query(
    "w04_phase_scores",
    f"""with q as (select f.src, f.id, i, f.t + ({_O})[i] target from {_FEW} f, range(1, 11) r(i)), near as (select q.id, q.i, arg_min((p.hand_x - p.core_x) / greatest(p.scale, 0.04), {{'d': abs(p.t - q.target), 'late': case when p.t >= q.target then 0 else 1 end, 'o': p.t}}) v from q join {POSE} p on p.src = q.src group by 1, 2),
    x as (select id, list(v order by i) v from near group by 1), y as (select *, ((v[1] + v[2] + v[3]) / 3 + (v[8] + v[9] + v[10]) / 3) / 2.0 rest from x), z as (select *, greatest({', '.join(map(_ABS, range(3, 7)))}) o from y),
    u as (select *, case when {_ABS(3)} = o then v[4] when {_ABS(4)} = o then v[5] when {_ABS(5)} = o then v[6] else v[7] end peak from z)
    select id, round(exp(-0.7 * (abs(v[2] - v[1]) + abs(v[3] - v[2]) + abs(v[9] - v[8]) + abs(v[10] - v[9]))) * exp(-0.8 * greatest(0.0, list_max(v) - list_min(v) - 1.2)) * least(1.0, o / 0.18) * least(1.0, abs(peak - v[7]) / 0.08) * least(1.0, (0.24 - least({', '.join(map(_ABS, range(4, 8)))})) / 0.24), 6) score from u""",
)
def phases(spark, d):
    p = T.pose(spark, d)
    return W.phase_scores(p.where("k % 12 = 5").select("src", "id", "t"), p, "src").select("id", r6("score").alias("score"))


@query(
    "w05_trajectories",
    f"""with q as (select f.src, f.id, i, f.t, (f.t - 0.8::double) + (i - 1) * (1.6::double / 8) target from {_FEW} f, range(1, 10) r(i)), w as (select q.id, q.i, q.target, p.t, p.id pid, (hand_x - core_x) / greatest(scale, 0.04) x, (hand_y - core_y) / greatest(scale, 0.04) y from q join {POSE} p on p.src = q.src and p.t between q.t - 0.8::double and q.t + 0.8::double),
    v as (select id, i, count(*) n, arg_min({{'x': x, 'y': y}}, {{'d': abs(t - target), 't': t, 'p': pid}}) p from w group by 1, 2) select id, round(sum(p.x * i), 6) x, round(sum(p.y * i), 6) y from v where n >= 5 group by 1""",
)
def trajectories(spark, d):
    x = W.windowed(T.pose(spark, d), "src", {"rows": (-0.8, 0.8)}).where("k % 12 = 5").select("id", W.trajectory(c("rows"), c("t")).alias("p")).where("p is not null")
    part = lambda n: V.total(F.transform("p", lambda q, i: q[n] * (i + 1)))
    return x.select("id", r6(part("x")).alias("x"), r6(part("y")).alias("y"))


@query(
    "w14_p07_body_tracked",
    f"""with g as (select *, sum(case when t - b > 0.6 or t - b <= 0 then 1 else 0 end) over (partition by src order by t, id rows unbounded preceding) run from (select *, lag(t) over (partition by src order by t, id) b from {POSE} where conf >= 0.45 and scale >= 0.04)),
    w as (select a.id, b.t, b.id bid, b.core_x, b.core_y, b.scale from g a join g b on a.src = b.src and a.run = b.run and b.t <= a.t and a.t - b.t <= 1.2),
    far as (select distinct a.id from w a join w b on a.id = b.id where sqrt(pow(a.core_x - b.core_x, 2) + pow(a.core_y - b.core_y, 2)) / greatest(0.04, least(a.scale, b.scale)) > 0.75)
    select id, count(*) >= 3 and max(t) - min(t) >= 0.55 and id not in (select id from far) tracked from w group by 1""",
)
def tracked(spark, d):
    return W.body_tracked(T.pose(spark, d), "src").select("id", "tracked")


@query(
    "w15_schedules",
    f"""select id, len(c) coarse, round(list_sum(c), 3) coarse_sum, round(list_sum(list_transform(range(1, 6), lambda i: value * i / 6)), 6) frames, round(list_sum(list_transform(range(0, 8), lambda i: (value / 2.0 - least(30, value) / 2.0) + least(30, value) / 8 * (i + 0.5))), 6) middles
    from (select id, value, list_filter(case when ceil(value / 5) <= 12 then list_transform(range(0, ceil(value / 5)::bigint), lambda i: round_even(i * 5.0::double * 1000, 0) / 1000) else list_transform(range(0, 12), lambda i: round_even(i * (value / 12) * 1000, 0) / 1000) end, lambda t: t < value) c from {E})""",
)
def schedules(spark, d):
    v = c("value")
    x = T.events(spark, d).select("id", W.coarse_times(v, 5.0, 12).alias("c"), W.frame_times(v, 5).alias("f"), W.window_times(v, F.lit(30.0)).alias("m"))
    return x.select("id", F.size("c").cast("long").alias("coarse"), F.round(V.some_total(c("c")), 3).alias("coarse_sum"), r6(V.total(c("f"))).alias("frames"), r6(V.total(c("m"))).alias("middles"))


@query("w08_contrast_maxima", f"select id from (select *, lag(value) over w b, lead(value) over w a from {E} window w as (partition by src order by t, id)) where value >= b and value >= a and value >= 20 and value - least(a, b) >= 15")
def contrast_maxima(spark, d):
    return W.local_maxima(T.events(spark, d), "src", F.lit(20.0), 15.0).select("id")


@query(
    "a14_time_histogram",
    f"""with h as (select src % 5 g, least(191, greatest(0, floor(t / 73 * 192)))::int b, avg(rms) r, max(peak) p, sum(id % 40) / sum(100) z from {T.AUDIO_SQL} group by 1, 2)
    select s.g, k::int bucket, round(coalesce(r, 0), 9) rms, round(coalesce(p, 0), 6) peak, round(coalesce(z, 0), 6) crossing_rate from (select distinct src % 5 g from {E}) s cross join range(192) x(k) left join h on h.g = s.g and h.b = k""",
)
def histogram(spark, d):
    a = T.audio(spark, d).select((c("src") % 5).alias("g"), "t", "rms", "peak", (c("id") % 40).alias("crossings"), F.lit(100).alias("count"))
    return W.time_histogram(a, "g", F.lit(73.0)).select("g", "bucket", F.round("rms", 9).alias("rms"), r6("peak").alias("peak"), r6("crossing_rate").alias("crossing_rate"))


# ---- orders and sets -------------------------------------------------------------------------------------------------

_LIST = f"(select id, src, t, value, value / 100 - 1 score from {E} where kind = 'purchase')"


def _list(spark, d):
    return T.events(spark, d).where("kind = 'purchase'").select("id", "src", "t", "value", (c("value") / 100 - 1).alias("score"))


@query("t03_refinement_anchors", f"select clip, n, row_number() over (partition by clip order by score desc, n)::int rank from (select *, case when bool_and(imp between 0 and 1) over (partition by clip) then 0.7 * q * 0.9 + 0.3 * imp else q * 0.9 end score from (select clip, n, q, p[1] imp from {FIVE_SQL} where q >= 0.15)) qualify row_number() over (partition by clip order by score desc, n) <= 2")
def anchors(spark, d):
    x = five(spark, d).select("clip", c("n").alias("ordinal"), F.when(c("q") >= 0.15, "ok").otherwise("failed").alias("status"), c("q").alias("sharp"), F.lit(0.9).alias("expo"), c("p")[0].alias("imp"))
    return sets.refinement_anchors(x, "clip", 20, 0.3).select("clip", c("ordinal").alias("n"), "rank")


_OFFS = "[-0.5, -0.4, -0.3, -0.2, -0.1, 0.1, 0.2, 0.3, 0.4, 0.5]"


@query(
    "t04_refinement_times",
    f"""with a as (select src, row_number() over (partition by src order by value desc, id) rank, round_even(t * 10, 0) / 10 t from {_LIST}), x as (select a.src, a.rank, o, round_even(a.t + ({_OFFS}::double[])[o], 2) t from a, range(1, 11) r(o) where a.rank <= 3)
    select src, n, round(t, 2) t from (select *, row_number() over (partition by src order by rank, o) n from (select * from x where t >= 0 and t < 73 and not exists (select 1 from a where a.src = x.src and round_even(a.t, 2) = x.t) qualify row_number() over (partition by src, t order by rank, o) = 1)) where n <= 20""",
)
def refinements(spark, d):
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("value"), "id"))
    a = _list(spark, d).select("src", r.alias("rank"), (F.rint(c("t") * 10) / 10).alias("t"))
    x = sets.refinement_times(a.where("rank <= 3"), "src", (-0.5, -0.4, -0.3, -0.2, -0.1, 0.1, 0.2, 0.3, 0.4, 0.5), F.lit(73.0), a, 20)
    return x.select("src", c("n").cast("long").alias("n"), F.round("t", 2).alias("t"))


@query("t05_uncertain_first", f"select id, row_number() over (order by abs(score), id) rank from {_LIST} qualify row_number() over (order by abs(score), id) <= 50")
def uncertain(spark, d):
    top = _list(spark, d).orderBy(F.abs("score"), "id").limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(F.abs("score"), "id")).cast("long").alias("rank"))


@query("t06_review_order", f"select id, row_number() over (order by -greatest(0, 1 - abs(value / 20 - 5.8) / 2.2), id % 4 = 0, src, t, id) rank from {_LIST} where id % 4 <> 0 and id % 5 <> 0 qualify row_number() over (order by -greatest(0, 1 - abs(value / 20 - 5.8) / 2.2), id % 4 = 0, src, t, id) <= 30")
def review(spark, d):
    order = [F.desc(review_motion(c("value") / 20)), c("src"), c("t"), c("id")]
    top = _list(spark, d).where("id % 4 <> 0 and id % 5 <> 0").orderBy(*order).limit(30)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


@query("w07_places", f"select src, id, row_number() over (partition by src order by value desc, id) - 1 place from {_LIST}")
def places(spark, d):
    from moments.operators.calibration import place

    return place(_list(spark, d), ["src"], "place", F.desc("value"), c("id")).select("src", "id", c("place").cast("long").alias("place"))


@query("u01_union_candidates", f"select id, src, round(value, 6) peak, null::double motion, 'audio' evidence from {_LIST} union all select id, src, null, round(value, 6), 'visual' from {E} where kind = 'click'")
def unions(spark, d):
    e = T.events(spark, d)
    audio = _list(spark, d).select("id", "src", r6("value").alias("peak"), F.lit("audio").alias("evidence"))
    return sets.union_candidates(audio, e.where("kind = 'click'").select("id", "src", r6("value").alias("motion"), F.lit("visual").alias("evidence"))).select("id", "src", "peak", "motion", "evidence")


@query(
    "u02_ordered_union",
    f"""with a as (select id, row_number() over (order by value desc, id) pos from {_LIST} qualify pos <= 200), b as (select id, row_number() over (order by abs(score), id) pos from {_LIST} qualify pos <= 200)
    select id, row_number() over (order by part, pos) queue_rank from (select * from (select id, 0 part, pos from a union all select id, 1, pos from b) qualify row_number() over (partition by id order by part, pos) = 1)""",
)
def ordered_union(spark, d):
    x = _list(spark, d)
    parts = []
    for order in ([F.desc("value"), c("id")], [F.abs("score"), c("id")]):
        parts.append(x.orderBy(*order).limit(200).withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("id", "pos"))
    return sets.queue_rank(sets.ordered_union("id", *parts), block=64).select("id", c("queue_rank").cast("long").alias("queue_rank"))


@query("u03_keep_first", f"select id from (select id, row_number() over (partition by src, round_even(t, 0) order by id) r from {E}) where r = 1")
def keep_first(spark, d):
    x = T.events(spark, d).withColumn("k", F.rint("t"))
    return sets.keep_first(x, ["src", "k"], c("id")).select("id")


@query("u05_common_keys", f"select distinct src, round_even(t, 0)::bigint k from {E} where kind = 'view' intersect select distinct src, round_even(t, 0)::bigint from {E} where kind = 'click'")
def common_keys(spark, d):
    x = T.events(spark, d).select("src", F.rint("t").cast("long").alias("k"), "kind")
    return x.where("kind = 'view'").select("src", "k").intersect(x.where("kind = 'click'").select("src", "k"))


@query("u06_tail_without_head", f"select src, id from {_LIST} except select src, id from (select *, row_number() over (partition by src order by value desc, id) r from {_LIST}) where r <= 3")
def tail(spark, d):
    x = _list(spark, d)
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("value"), "id"))
    return x.select("src", "id").join(x.withColumn("r", r).where("r <= 3").select("src", "id"), ["src", "id"], "left_anti")


@query("u07_fallback_tail", f"select g, id, row_number() over (partition by g order by e is null, e desc, case when e is null then semantic end desc, id) position from (select g, id, case when id % 7 <> 0 then expert end e, semantic from {C}) where e is not null or semantic is not null")
def fallback(spark, d):
    x = T.clips(spark, d).withColumn("expert", F.when(c("id") % 7 != 0, c("expert")))
    return sets.with_fallback(x, "g").select("g", "id", c("position").cast("long").alias("position"))


@query("u08_cut_list", f"select src, len(x) n, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i)), 6) w from (select src, list_sort(list_distinct(list_filter(list(case when id % 9 = 0 then 'nan'::double else round_even(t, 0) end), lambda v: not isnan(v) and v > 0 and v < 60))) x from {E} group by 1)")
def cut_lists(spark, d):
    t = F.when(c("id") % 9 == 0, float("nan")).otherwise(F.rint("t"))
    x = T.events(spark, d).groupBy("src").agg(F.collect_list(t).alias("x")).select("src", ranges.cut_list(c("x"), F.lit(60.0)).alias("x"))
    return x.select("src", F.size("x").cast("long").alias("n"), r6(V.some_total(F.transform("x", lambda v, i: v * (i + 1)))).alias("w"))


@query("w12_evenly_spaced", f"select id from (select id, row_number() over (order by id) - 1 r, count(*) over () n from {_LIST}) where r in (select (i * (n - 1)) // 39 from range(40) x(i), (select count(*) n from {_LIST}))")
def evenly_spaced(spark, d):
    return greedy.evenly(_list(spark, d).select("id"), 40, c("id"))
