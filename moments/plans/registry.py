"""Query registry: name -> callable(spark, sf_dir), and the DuckDB text that must give the same rows.

Names begin with the operator's id in the survey. Numbers are rounded to six places, as sums may be added up in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moments.functions import scalars as S
from moments.operators import greedy, ranges, ranking
from moments.operators import photos as PH
from moments.plans import testdata as T
from moments.plans.base import ORACLES, QUERIES, c, query, r6  # noqa: F401
from moments.sources import text

E, A, P, C = T.EVENTS_SQL, T.AUDIO_SQL, T.PHOTOS_SQL, T.CLIPS_SQL


# ---- the flagship: local maxima, temporal suppression, best of all ---------------------------------------------------


def _maxima(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("src").orderBy("t", "id")
    x = e.withColumn("before", F.lag("value").over(w)).withColumn("after", F.lead("value").over(w))
    return x.where((c("value") >= c("before")) & (c("value") >= c("after")) & (c("value") >= 50))


_MAXIMA = f"(select * from (select *, lag(value) over w b, lead(value) over w a from {E} window w as (partition by src order by t, id)) where value >= b and value >= a and value >= 50)"
#: A candidate is kept if no kept one of higher rank is near: rounds over the undecided, in rank order per source.
_NMS = """with recursive x as (select *, row_number() over (partition by src order by value desc, t, id) r from {rows}),
n(src, r, kept) as (select src, 0::bigint, []::double[] from (select distinct src from x) union all
  select x.src, x.r, case when len(list_filter(n.kept, lambda k: abs(k - x.t) < {gap})) = 0 then list_append(n.kept, x.t) else n.kept end from n join x on x.src = n.src and x.r = n.r + 1),
k as (select n.src, x.id, x.t, x.value from n join n p on p.src = n.src and p.r = n.r - 1 join x on x.src = n.src and x.r = n.r where len(n.kept) > len(p.kept))
"""


@query("top_moments", _NMS.format(rows=_MAXIMA, gap=3.0) + "select src, round(t, 6) t, round(value, 6) score, id from k order by value desc, src, t, id limit 100")
def top_moments(spark, d):
    m = _maxima(T.events(spark, d)).withColumnRenamed("value", "score")
    return greedy.temporal_nms(m, "src", 3.0, 100).select("src", r6("t").alias("t"), r6("score").alias("score"), "id")


@query("g01_temporal_nms", _NMS.format(rows=E, gap=1.0) + "select src, round(t, 6) t, round(value, 6) score, id from k")
def nms(spark, d):
    return greedy.temporal_nms(T.events(spark, d).withColumnRenamed("value", "score"), "src", 1.0).select("src", r6("t").alias("t"), r6("score").alias("score"), "id")


_SEQ = """with recursive x as (select *, row_number() over (partition by src order by t, id) r from {rows}),
n(src, r, last) as (select src, 0::bigint, null::double from (select distinct src from x) union all select x.src, x.r, case when n.last is null or x.t - n.last >= {gap} then x.t else n.last end from n join x on x.src = n.src and x.r = n.r + 1)
"""


@query("w09_refractory", _SEQ.format(rows=_MAXIMA, gap=1.5) + "select n.src, round(x.t, 6) t, x.id from n left join n p on p.src = n.src and p.r = n.r - 1 join x on x.src = n.src and x.r = n.r where n.r > 0 and (p.last is null or x.t - p.last >= 1.5)")
def refractory(spark, d):
    return greedy.refractory(_maxima(T.events(spark, d)), "src", 1.5).select("src", r6("t").alias("t"), "id")


@query("w12_spaced_subsample", _SEQ.format(rows=E, gap=2.0) + "select n.src, round(x.t, 6) t, x.id from n left join n p on p.src = n.src and p.r = n.r - 1 join x on x.src = n.src and x.r = n.r where n.r > 0 and (p.last is null or x.t - p.last >= 2.0)")
def spaced(spark, d):
    return greedy.refractory(T.events(spark, d), "src", 2.0).select("src", r6("t").alias("t"), "id")


def _merge_sql(loud: bool) -> str:
    pick = "case when x.value > n.l then x.t else n.t end" if loud else "n.t"
    return f"""with recursive x as (select *, row_number() over (partition by src order by t, value) r from {_MAXIMA}),
n(src, r, k, t, l, m) as (select src, 0::bigint, 0::bigint, null::double, null::double, 0::bigint from (select distinct src from x) union all
  select x.src, x.r, case when x.t - n.t < 4 then n.k else n.k + 1 end, case when x.t - n.t < 4 then {pick} else x.t end, case when x.t - n.t < 4 then greatest(n.l, x.value) else x.value end, case when x.t - n.t < 4 then n.m + 1 else 1 end
  from n join x on x.src = n.src and x.r = n.r + 1)
select src, round(t, 6) t, round(l, 6) lvl, m n from (select *, row_number() over (partition by src, k order by r desc) z from n where r > 0) where z = 1"""


@query("w10_merge_audio", _merge_sql(True))
def merge_audio(spark, d):
    m = _maxima(T.events(spark, d)).withColumnRenamed("value", "level")
    return greedy.anchored_merge(m, "src", 4.0, True).select("src", r6("t").alias("t"), r6("level").alias("lvl"), c("n").cast("long").alias("n"))


@query("w10_merge_visual", _merge_sql(False))
def merge_visual(spark, d):
    m = _maxima(T.events(spark, d)).withColumnRenamed("value", "level")
    return greedy.anchored_merge(m, "src", 4.0, False).select("src", r6("t").alias("t"), r6("level").alias("lvl"), c("n").cast("long").alias("n"))


@query("w08_local_maxima", f"select src, id, round(t, 6) t, round(value, 6) v from {_MAXIMA}")
def local_maxima(spark, d):
    return _maxima(T.events(spark, d)).select("src", "id", r6("t").alias("t"), r6("value").alias("v"))


# ---- scalars ---------------------------------------------------------------------------------------------------------

_SCORE = "least(1.0, 0.55 * rms + 0.45 * peak + 0.35 * least(1.0, 10 * crossing) * rms)"
_EFF = "case when sensitivity <> 'automatic' then sensitivity when baseline >= 0.026 then 'noisy' when baseline <= 0.009 then 'quiet' else 'normal' end"
_DIM = "(values " + ", ".join(f"('{k}', {', '.join(f'{x}::double' for x in v)})" for k, v in S.THRESHOLDS.items()) + f") as th(eff, {', '.join(S.THRESHOLD_NAMES)})"


def _strong(p):
    return f"(score >= greatest({p}_score, baseline * {p}_base) and peak >= greatest({p}_peak, baseline * {p}_peak_base) and rise >= {p}_rise and crossing >= {p}_cross and crest >= {p}_crest)"


@query("f01_impact_score", f"select id, round({_SCORE}, 11) score from {A}")
def impact_score(spark, d):
    return T.audio(spark, d).select("id", F.round(S.impact_score(c("rms"), c("peak"), c("crossing")), 11).alias("score"))


@query("f02_effective_sensitivity", f"select id, {_EFF} eff from {A}")
def effective(spark, d):
    return T.audio(spark, d).select("id", S.effective_sensitivity(c("sensitivity"), c("baseline")).alias("eff"))


@query("f03_thresholds", f"select * from {_DIM}")
def threshold_table(spark, d):
    return S.thresholds(spark).withColumnRenamed("effective", "eff")


@query(
    "f04_f05_detect_impact",
    f"""select id, not speech and ({_strong("s")} or {_strong("d")}) is_triggered, round(case when speech then 0 else 0.28 * score / d_score + 0.22 * peak / d_peak + 0.24 * rise / d_rise
    + 0.13 * least(crossing / d_cross, 1.8) + 0.13 * least(crest / d_crest, 1.8) end, 6) confidence from (select *, rms >= 0.025 and crest < 3.15 and crossing < 0.16 and rise < 4.8 and score < 0.18 speech from (
    select *, score / greatest(0.003, baseline, 0.82 * recent) rise, peak / greatest(0.001, rms) crest from (select *, {_SCORE} score, {_EFF} eff from {A}))) join {_DIM} using (eff)""",
)
def detect(spark, d):
    return S.detect_impact(T.audio(spark, d), S.thresholds(spark)).select("id", "is_triggered", r6("confidence").alias("confidence"))


@query("f09_f11_photo_quality", f"select set_id, idx, round(case when bool_and(aes is not null) over (partition by set_id) then 0.4 * q + 0.6 * aes else q end, 6) score from (select *, 0.4 * sharp + 0.2 * expo + ln(px) / 100 q from {P})")
def photo_scores(spark, d):
    return _scored_photos(spark, d).select("set_id", "idx", r6("score").alias("score"))


def _scored_photos(spark, d):
    whole = F.min(c("aes").isNotNull()).over(Window.partitionBy("set_id"))
    p = T.photos(spark, d)
    return p.withColumn("score", F.when(whole, S.photo_quality(c("sharp"), c("expo"), c("px"), c("aes"))).otherwise(S.photo_quality(c("sharp"), c("expo"), c("px"))))


_SCORED = f"(select *, case when bool_and(aes is not null) over (partition by set_id) then 0.4 * q + 0.6 * aes else q end score from (select *, 0.4 * sharp + 0.2 * expo + ln(px) / 100 q from {P}))"


@query("f10_similarity_quality", f"select idx, round(sharp + ln(greatest(1, px)) / 100, 6) q from {P}")
def sim_quality(spark, d):
    return T.photos(spark, d).select("idx", r6(S.similarity_quality(c("sharp"), c("px"))).alias("q"))


_ramp = lambda x, lo, w: f"least(1.0, greatest(0.0, ({x} - {lo}) / {w}))"


@query("f14_stroke_score", f"select id, round(0.28 * {_ramp('x', 0.035, 0.2)} + 0.17 * {_ramp('-x', -0.34, 0.25)} + 0.23 * {_ramp('-y', -0.27, 0.18)} + 0.14 * {_ramp('-z', -1.25, 0.9)} + 0.14 * least(1.0, (id % 4) / 2.0) + 0.04 * {_ramp('z', 0.05, 0.75)}, 6) s from (select id, rms / 2 x, peak / 3 y, crossing * 4 z from {A})")
def stroke(spark, d):
    return T.audio(spark, d).select("id", r6(S.stroke_score(c("rms") / 2, c("peak") / 3, c("crossing") * 4, c("id") % 4, c("crossing") * 4)).alias("s"))


@query("f16_composite", f"select id, round(0.7 * rms + 0.2 * exp(-pow((value / 20 - 30 + 12) / 10, 2)) + case when id % 9 = 0 then 0 else 0.1 * exp(-pow(((id % 9) - 9.5) / 5, 2)) end, 6) s from {A} join (select id, value from {E}) using (id)")
def composite(spark, d):
    a = T.audio(spark, d).join(T.events(spark, d).select("id", "value"), "id")
    return a.select("id", r6(S.composite_score(c("rms"), c("value") / 20 - 30, (c("id") % 9).cast("double"))).alias("s"))


@query("f18_rotation", f"select id, case when k % 360 in (0, 90, 180, 270) then k % 360 when (k % 360 + 360) % 360 in (0, 90, 180, 270) then (k % 360 + 360) % 360 else 0 end turn from (select id, (id % 17 - 8) * 45 k from {E})")
def rotations(spark, d):
    return T.events(spark, d).select("id", S.rotation((c("id") % 17 - 8) * 45).cast("long").alias("turn"))


@query("f21_logit_sigmoid", f"select id, round(ln(p / (1 - p)), 6) lo, round(case when value >= 100 then 1 / (1 + exp(-(value - 100) / 50)) else exp((value - 100) / 50) / (1 + exp((value - 100) / 50)) end, 6) si from (select id, value, least(1 - 1e-6, greatest(1e-6, value / 300)) p from {E})")
def logits(spark, d):
    return T.events(spark, d).select("id", r6(S.logit(c("value") / 300)).alias("lo"), r6(S.sigmoid((c("value") - 100) / 50)).alias("si"))


@query("f23_triage", f"select id, value / 20 - 10 >= -3 or id % 25 >= 18 confirmed from {E}")
def triaged(spark, d):
    return T.events(spark, d).select("id", S.triage(c("value") / 20 - 10, c("id") % 25).alias("confirmed"))


@query("s08_stable_id", f"select id, printf('engine-%d-%08d', src, round_even(t * 10, 0)::bigint) name from {E}")
def stable_ids(spark, d):
    return T.events(spark, d).select("id", S.stable_id(c("src"), c("t")).alias("name"))


@query("s07_recovered_label", f"select src source, round(round_even(t * 10, 0)::bigint / 10.0, 6) t from {E}")
def recovered(spark, d):
    return text.recovered(T.events(spark, d).select(S.stable_id(c("src"), c("t")).alias("id"))).select("source", r6("t").alias("t"))


@query("s04_metadata_lines", f"select src source, round(t0, 6) t, round(v, 6) v from (select src, id, v, last_value(t0 ignore nulls) over (partition by src order by t, id) t0 from (select src, id, t, case when id % 3 = 0 then round(value, 2) end t0, case when id % 3 <> 0 then round(value, 2) end v from {E})) where v is not null and t0 is not null")
def metadata(spark, d):
    e = T.events(spark, d)
    line = F.when(c("id") % 3 == 0, F.concat(F.lit("frame:1 pts_time:"), F.format_string("%.2f", "value"))).otherwise(F.concat(F.lit("lavfi.peak="), F.format_string("%.2f", "value")))
    return text.metadata_lines(e.select(c("src").alias("source"), F.struct("t", "id").alias("ord"), line.alias("line")), "lavfi.peak").select("source", r6("t").alias("t"), r6("value").alias("v"))


@query("s06_label_log", "select user_id id, arg_max(event_type, event_id) label from events group by 1")
def label_log(spark, d):
    return text.latest_labels(spark.read.parquet(f"{d}/events.parquet").select(c("user_id").alias("id"), c("event_type").alias("label"), c("event_id").alias("log_order")))


# ---- vectors ---------------------------------------------------------------------------------------------------------

_COS = "least(2, greatest(0, 1 - list_dot_product(a.e::double[], b.e::double[]) / sqrt(list_dot_product(a.e::double[], a.e::double[])) / sqrt(list_dot_product(b.e::double[], b.e::double[]))))"


def _pairs(spark, d, limit=None):
    return PH.vector_pairs(T.photos(spark, d), "set_id", limit)


@query("j01_v02_pair_distances", f"select a.set_id, a.idx i, b.idx j, round({_COS}, 6) d from {P} a join {P} b on a.set_id = b.set_id and a.idx < b.idx")
def pair_distances(spark, d):
    return _pairs(spark, d).select("set_id", "i", "j", r6("d").alias("d"))


@query("v01_l2_normalise", f"select idx, round(e[1]::double / sqrt(list_dot_product(e::double[], e::double[])), 6) first from {P}")
def normalised(spark, d):
    return T.photos(spark, d).select("idx", r6(S.l2_normalise(c("e"))[0]).alias("first"))


@query("v05_mean_absolute", f"select idx, round(list_avg(list_transform(range(1, 33), lambda k: abs(e[k]::double - e[k + 32]::double))), 6) m from {P}")
def mean_abs(spark, d):
    return T.photos(spark, d).select("idx", r6(S.mean_absolute(F.slice("e", 1, 32), F.slice("e", 33, 32))).alias("m"))


# ---- joins on time ---------------------------------------------------------------------------------------------------

_BUYS, _CLICKS = (f"(select src, t u, value from {E} where kind = '{k}')" for k in ("purchase", "click"))


def _of(spark, d, kind):
    return T.events(spark, d).where(c("kind") == kind).select("src", c("t").alias("u"), "value")


def _views(spark, d):
    return T.events(spark, d).where("kind = 'view'").select("src", "t", "id")


_VIEWS = f"(select src, t, id from {E} where kind = 'view')"


@query("j04_band_max", f"select v.id, round(coalesce(max(b.value), -1), 6) peak from {_VIEWS} v left join {_BUYS} b on v.src = b.src and abs(v.t - b.u) <= 1.5 group by 1")
def band_max(spark, d):
    return ranges.band_max(_views(spark, d), _of(spark, d, "purchase"), "src", 1.5, -1.0).select("id", r6("peak").alias("peak"))


@query("j05_forward_asof", f"select v.id, round(min(b.u), 6) next from {_VIEWS} v left join {_BUYS} b on v.src = b.src and b.u > v.t + 2.0 group by 1")
def forward(spark, d):
    return ranges.forward_asof(_views(spark, d), _of(spark, d, "purchase"), "src", 2.0).select("id", r6("next_u").alias("next"))


@query("j18_backward_asof", f"select v.id, round(arg_max(b.value, b.u), 6) last from {_VIEWS} v left join {_BUYS} b on v.src = b.src and b.u <= v.t group by 1")
def backward(spark, d):
    return ranges.backward_asof(_views(spark, d), _of(spark, d, "purchase"), "src", "value").select("id", r6("value").alias("last"))


@query("j03_nearest", f"select v.id, round(arg_min(b.u, abs(b.u - v.t)), 6) near from {_VIEWS} v left join {_BUYS} b on v.src = b.src group by 1")
def nearest(spark, d):
    return ranges.nearest(_views(spark, d), _of(spark, d, "purchase"), "src").select("id", r6("near_u").alias("near"))


@query("j06_tolerance_match", f"select id from {_VIEWS} v where exists (select 1 from {_CLICKS} b where v.src = b.src and abs(v.t - b.u) <= 0.5)")
def tolerance(spark, d):
    return ranges.band_join(_views(spark, d), _of(spark, d, "click"), "src", 0.5, "left_semi").select("id")


@query("j16_nearby_excluded", f"select id from {_VIEWS} v where not exists (select 1 from {_CLICKS} b where v.src = b.src and abs(v.t - b.u) <= 0.5)")
def excluded(spark, d):
    return ranges.band_join(_views(spark, d), _of(spark, d, "click"), "src", 0.5, "left_anti").select("id")


@query("f25_sequence_prior", f"select v.id, round(coalesce(case when min(b.u) - v.t <= 45 then exp(-(min(b.u) - v.t) / 15) end, 0), 6) prior from {_VIEWS} v left join {_BUYS} b on v.src = b.src and b.u > v.t + 2.0 group by v.id, v.t")
def prior(spark, d):
    x = ranges.forward_asof(_views(spark, d), _of(spark, d, "purchase"), "src", 2.0)
    return x.select("id", r6(F.coalesce(S.sequence_prior(c("next_u") - c("t")), F.lit(0.0))).alias("prior"))


@query("j15_shot_bounds", f"select id, floor(t / 7) * 7 s, least(73.0, floor(t / 7) * 7 + 7) e from {E}")
def shots(spark, d):
    start, end = ranges.shot_bounds(F.array(*[F.lit(7.0 * k) for k in range(1, 11)]), c("t"), F.lit(73.0))
    return T.events(spark, d).select("id", start.alias("s"), end.alias("e"))


# ---- ranks and top lists ---------------------------------------------------------------------------------------------


@query("t01_top_photos", f"select set_id, idx from (select *, row_number() over (partition by set_id order by score desc, idx) r from {_SCORED}) where r <= 5")
def top_photos(spark, d):
    return ranking.add_rank(_scored_photos(spark, d), "r", ["set_id"], F.desc("score"), c("idx")).where("r <= 5").select("set_id", "idx")


@query("t02_reference_search", f"select set_id, idx, n from (select *, count(*) over (partition by set_id) n, row_number() over (partition by set_id order by round(d, 9), idx) r from (select a.set_id, b.idx, {_COS} d from (select set_id, min(idx) f from {P} group by 1) q join {P} a on a.idx = q.f join {P} b on a.set_id = b.set_id and b.idx <> a.idx)) where r <= 20")
def reference_search(spark, d):
    p = T.photos(spark, d)
    q = p.groupBy("set_id").agg(F.min(F.struct("idx", "e")).alias("q"))
    x = p.join(q, "set_id").where(c("idx") != c("q.idx")).withColumn("d", F.round(S.cosine_distance(c("e"), c("q.e")), 9))
    x = x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("set_id")))
    return ranking.add_rank(x, "r", ["set_id"], c("d"), c("idx")).where("r <= 20").select("set_id", "idx", "n")


@query("a21_recommended_count", f"select set_id, greatest(1, count(*) filter (score >= b - greatest(0.1 * abs(b), 0.01)) // 2) n from (select *, max(score) over (partition by set_id) b from {_SCORED}) group by 1")
def recommended(spark, d):
    x = _scored_photos(spark, d).withColumn("b", F.max("score").over(Window.partitionBy("set_id")))
    near = F.count_if(c("score") >= c("b") - F.greatest(0.1 * F.abs("b"), F.lit(0.01)))
    return x.groupBy("set_id").agg(near.alias("k")).select("set_id", F.greatest(F.lit(1), F.expr("k div 2")).cast("long").alias("n"))


@query("u04_exclude_all_duplicates", "select user_id, ts::date::varchar dy from events group by user_id, ts::date having count(*) = 1")
def unique_only(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", c("ts").cast("date").cast("string").alias("dy")).count().where("count = 1").select("user_id", "dy")


_FUSED = """(select *, row_number() over (partition by g order by f desc, re, id) position from (select *, case when bool_and(semantic is not null) over (partition by g) then 0.6 / (60 + re) + 0.4 / (60 + rs) else 1.0 / (60 + re) end f from (
select *, row_number() over (partition by g order by expert desc, id) re, row_number() over (partition by g order by coalesce(semantic, -1e9) desc, id) rs from """ + C + ")))"


@query("m01_rank_fusion", f"select g, id, position from {_FUSED}")
def fusion(spark, d):
    return ranking.fuse_ranks(T.clips(spark, d), "g", 0.4).select("g", "id", c("position").cast("long").alias("position"))


@query("m02_protected_head", f"select g, id, row_number() over (partition by g order by re <= 3 desc, case when re <= 3 then re end, f desc, re, id) position from {_FUSED}")
def protected(spark, d):
    return ranking.fuse_ranks(T.clips(spark, d), "g", 0.4, head=3).select("g", "id", c("position").cast("long").alias("position"))


@query("a02_a03_average_precision", f"select g, round(sum(h * n / position) / nullif(sum(h), 0), 6) ap, round(sum(case when position <= 10 then h else 0 end) / least(10, count(*)), 6) p_at from (select *, positive::int h, sum(positive::int) over (partition by g order by position) n from {_FUSED}) group by 1")
def precision(spark, d):
    return ranking.average_precision(ranking.fuse_ranks(T.clips(spark, d), "g", 0.4), "g", 10).select("g", r6("ap").alias("ap"), r6("p_at").alias("p_at"))


@query("a08_summary", f"select kind, count(*) n, round(min(value), 6) low, round(max(value), 6) high, round(avg(value), 6) mean, round(quantile_cont(value, 0.25), 6) p25, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.75), 6) p75 from {E} group by 1")
def distribution(spark, d):
    x = ranking.summary(T.events(spark, d), "kind", "value")
    return x.select("kind", "n", *[r6(k).alias(k) for k in ("low", "high", "mean", "p25", "p50", "p75")])


@query("a10_upper_median", f"select src, round(list_sort(list(value))[count(*) // 2 + 1], 6) m, round(greatest(10, 1.25 * list_sort(list(value))[count(*) // 2 + 1]), 6) thr from {E} group by 1")
def medians(spark, d):
    x = ranking.upper_median(T.events(spark, d), "src", "value")
    return x.select("src", r6("m").alias("m"), r6(F.greatest(F.lit(10.0), 1.25 * c("m"))).alias("thr"))


@query("a11_exclusive_p90", f"select src, round(case when n >= 2 then v[j] + (p - j) * (v[j + 1] - v[j]) end, 6) p90 from (select *, least(n - 1, greatest(1, floor(p)))::int j from (select src, list_sort(list(value)) v, count(*) n, 0.9 * (count(*) + 1) p from {E} group by 1))")
def p90(spark, d):
    return ranking.exclusive_p90(T.events(spark, d), "src", "value").select("src", r6("p90").alias("p90"))


@query("a13_train_stats", f"select kind, round(avg(value), 6) mean, round(case when stddev_pop(value) = 0 then 1 else stddev_pop(value) end, 6) sd from {E} group by 1")
def train_stats(spark, d):
    return T.events(spark, d).groupBy("kind").agg(r6(F.avg("value")).alias("mean"), r6(F.when(F.stddev_pop("value") == 0, 1.0).otherwise(F.stddev_pop("value"))).alias("sd"))


@query("a16_best_per_source", f"select src, id from (select *, row_number() over (partition by src order by value desc, id) r from {E} where value >= 20) where r = 1")
def best(spark, d):
    x = T.events(spark, d).where("value >= 20").groupBy("src").agg(F.max(F.struct("value", -c("id"))).alias("x"))
    return x.select("src", (-c("x")["col2"]).alias("id"))


@query("a20_coverage", f"select src, count(*) n, round(min(t), 6) first, round(max(t), 6) last, round(max(g), 6) gap from (select *, t - lag(t) over (partition by src order by t) g from {E}) group by 1")
def coverage(spark, d):
    g = c("t") - F.lag("t").over(Window.partitionBy("src").orderBy("t"))
    return T.events(spark, d).withColumn("g", g).groupBy("src").agg(F.count(F.lit(1)).alias("n"), r6(F.min("t")).alias("first"), r6(F.max("t")).alias("last"), r6(F.max("g")).alias("gap"))


@query("w11_time_blocks", f"select id, least(3, greatest(0, floor(t / 18.25)))::bigint block from {E}")
def blocks(spark, d):
    return T.events(spark, d).select("id", F.least(F.lit(3), F.greatest(F.lit(0), F.floor(c("t") / 18.25))).cast("long").alias("block"))


@query("a01_window_features", f"""select id, count(*) n, round(max(v) - min(v), 6) rng, round(sum(case when k > 1 then abs(dv) else 0 end), 6) path, sum(case when k > 2 and abs(dv) >= 0.8 and abs(pd) >= 0.8 and dv * pd < 0 then 1 else 0 end)::bigint reversals
from (select *, lag(dv) over w pd from (select a.id, b.t, b.id o, b.value v, row_number() over w k, b.value - lag(b.value) over w dv from {E} a join {E} b on a.src = b.src and abs(a.t - b.t) <= 0.8 window w as (partition by a.id order by b.t, b.id)) window w as (partition by id order by t, o)) group by 1""")
def window_features(spark, d):
    e = T.events(spark, d)
    x = ranges.band_join(e.select("id", "src", "t"), e.select("src", c("t").alias("u"), c("id").alias("o"), c("value").alias("v")), "src", 0.8)
    rows = x.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("u", "o", "v"))), lambda y: y["v"]).alias("v"))
    step = F.transform(F.sequence(F.lit(2), F.size("v")), lambda k: F.element_at("v", k) - F.element_at("v", k - 1))
    rows = rows.withColumn("dv", F.when(F.size("v") > 1, step).otherwise(F.array().cast("array<double>")))
    turn = F.aggregate(F.zip_with("dv", F.slice("dv", 2, F.greatest(F.lit(0), F.size("dv"))), lambda a, b: F.when((F.abs(a) >= 0.8) & (F.abs(b) >= 0.8) & (a * b < 0), 1).otherwise(0)), F.lit(0), lambda s, k: s + k)
    return rows.select("id", F.size("v").cast("long").alias("n"), r6(F.array_max("v") - F.array_min("v")).alias("rng"), r6(F.aggregate("dv", F.lit(0.0), lambda s, y: s + F.abs(y))).alias("path"), turn.cast("long").alias("reversals"))


from moments.plans import q_calibration, q_machines, q_matching, q_scalars, q_selection, q_sources, q_windows  # noqa: E402, F401
