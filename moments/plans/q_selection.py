"""Queries of photo selection and highlights, and their recursive oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moments.operators import evaluation as EV
from moments.operators import highlights as H
from moments.operators import photos as PH
from moments.plans import testdata as T
from moments.plans.base import ORACLES, c, query, r6
from moments.plans.q_matching import PAIRS_SQL
from moments.plans.q_scalars import BAD_PHOTOS_SQL, FRAME_REASON_SQL, PHOTO_REASON_SQL, bad_photos

PHOTOS, E, FRAMES = T.PHOTOS_SQL, T.EVENTS_SQL, T.FRAMES_SQL

# ---- leaders ---------------------------------------------------------------------------------------------------------

_LEADERS = f"""with recursive p as (select set_id, idx, sharp + ln(greatest(1, px)) / 100 q, row_number() over (partition by set_id order by idx) r from {PHOTOS}), near as (select set_id, j idx, list(i) nb from {PAIRS_SQL} where d <= 0.85 group by all),
x as (select p.*, coalesce(nb, []::bigint[]) nb from p left join near using (set_id, idx)),
n(set_id, r, reps) as (select distinct set_id, 0::bigint, []::struct(idx bigint, q double)[] from x union all
  select n.set_id, x.r, case when k is null then list_append(reps, {{'idx': x.idx, 'q': x.q}}) when x.q > reps[k].q then list_transform(reps, lambda g, i: case when i = k then {{'idx': x.idx, 'q': x.q}} else g end) else reps end
  from n join x on x.set_id = n.set_id and x.r = n.r + 1, lateral (select nullif(list_position(list_transform(reps, lambda g: list_contains(x.nb, g.idx)), true), 0) k))
select set_id, u.idx, round(u.q, 6) quality from (select set_id, unnest(reps) u from n qualify row_number() over (partition by set_id order by r desc) = 1 or false)"""
# the last state of each set
_LEADERS = _LEADERS.split("select set_id, u.idx")[0] + "select set_id, u.idx, round(u.q, 6) quality from (select set_id, unnest(reps) u from (select set_id, arg_max(reps, r) reps from n group by 1))"


@query("g03_leader_clusters", _LEADERS)
def leaders(spark, d):
    from moments.functions import scalars as S
    from moments.operators import blocks

    p = T.photos(spark, d).withColumn("quality", S.similarity_quality(c("sharp"), c("px")))
    return blocks.leaders(p, "set_id", 0.85).select("set_id", "idx", r6("quality").alias("quality"))


# ---- diverse photos --------------------------------------------------------------------------------------------------

_EL = f"(select *, row_number() over (partition by set_id order by score desc, idx) rank from (select *, case when bool_and(aes is not null) over (partition by set_id) then 0.4 * b + 0.6 * aes else b end score from (select *, 0.4 * sharp + 0.2 * expo + ln(px) / 100 b from (select *, {PHOTO_REASON_SQL} reason from {BAD_PHOTOS_SQL}) where reason is null)))"
_GROUPS = f"""with recursive el as {_EL}, near as (select set_id, idx, list(o) nb from (select set_id, i idx, j o from {PAIRS_SQL} where d <= 0.9 union all select set_id, j, i from {PAIRS_SQL} where d <= 0.9) group by all),
x as (select el.set_id, el.idx, el.score, el.rank, coalesce(nb, []::bigint[]) nb from el left join near using (set_id, idx)),
n(set_id, r, idx, groups, g, m) as (select distinct set_id, 0::bigint, null::bigint, []::bigint[][], 0::bigint, 0::bigint from x union all
  select n.set_id, x.rank, x.idx, case when k is null then list_append(groups, [x.idx]) else list_transform(groups, lambda q, i: case when i = k then list_append(q, x.idx) else q end) end, coalesce(k, len(groups) + 1), case when k is null then 1 else len(groups[k]) + 1 end
  from n join x on x.set_id = n.set_id and x.rank = n.r + 1, lateral (select nullif(list_position(list_transform(groups, lambda q: list_has_all(x.nb, q)), true), 0) k)),
y as (select n.set_id, n.idx, x.score, x.rank, n.g, n.m, row_number() over (partition by n.set_id order by n.m, n.g) position from n join x on x.set_id = n.set_id and x.idx = n.idx where n.r > 0)
"""


def _diverse(spark, d):
    return PH.diverse(bad_photos(spark, d), None, "set_id", 0.9, 12, T.photos(spark, d))


@query(
    "g04_g05_f11_diverse_photos",
    _GROUPS + f"""select set_id, idx, null reason, round(score, 6) score, rank::int rank, g::int grp, m::int member, position::int position, case when position <= 12 then case when m = 1 then 'groupRepresentative' else 'extraGroupMember' end end role, position <= 12 selected from y
    union all select distinct set_id, idx, reason, null, null, null, null, null, null, false from (select *, {PHOTO_REASON_SQL} reason from {BAD_PHOTOS_SQL}) where reason is not null""",
)
def diverse(spark, d):
    return _diverse(spark, d).withColumn("score", r6("score"))


@query("a26_group_counts", _GROUPS + "select set_id, count(distinct g) groups, count(*) members, count(*) filter (where position <= 12) selected from y group by 1")
def group_counts(spark, d):
    x = _diverse(spark, d).where("reason is null")
    return x.groupBy("set_id").agg(F.count_distinct("grp").alias("groups"), F.count(F.lit(1)).alias("members"), F.count_if("selected").alias("selected"))


@query("g11_representative_frames", f"select clip, n from (select clip, n, row_number() over (partition by clip order by base, s desc, n) r from (select *, max(case when base then {{'d': dist, 's': s}} end) over (partition by clip) b from (select idx // 5 clip, idx % 5 n, idx % 5 = 2 and idx % 3 <> 0 base, sharp s, case when idx % 11 <> 0 then abs(idx % 5 - 2) * expo end dist from {PHOTOS})) where base or b is null or (dist <= b.d and s > b.s)) where r = 1")
def representatives(spark, d):
    i = c("idx")
    x = T.photos(spark, d).select(F.floor(i / 5).alias("clip"), (i % 5).alias("ordinal"), ((i % 5 == 2) & (i % 3 != 0)).alias("baseline"), "sharp", F.when(i % 11 != 0, F.abs(i % 5 - 2) * c("expo")).alias("distance"))
    return PH.representative_frames(x, "clip").select("clip", c("ordinal").alias("n"))


# ---- highlights ------------------------------------------------------------------------------------------------------

CONF = H.Highlights(frame_count=12, similarity_threshold=0.2, budget=15.0, max_segment=2.8)
_CUTS = "[" + ", ".join(f"{7.0 * k}::double" for k in range(1, 11)) + "]"
_FRAME = f"(select src, idx, t, score from (select *, case when bool_and(imp is not null) over (partition by src) then 0.7 * q + 0.3 * imp else q end score from (select *, {FRAME_REASON_SQL} reason from {FRAMES}) where reason is null))"
_LAGS = f"(select src, idx i, lag(idx, {{0}}) over (partition by src order by t, id) j from (select src, t, id, case when id % 101 = 0 then -id when id % 67 = 0 then 67 else id end idx from {E}))"
_DIST = "(select src, least(i, j) i, greatest(i, j) j, max(((i + j) % 10) / 10.0::double) d from (" + " union all ".join(f"select * from {_LAGS.format(n)}" for n in (1, 2, 3)) + ") where j is not null and i <> j and (i + j) % 10 >= 0 group by 1, 2, 3)"
_CHOSEN = f"""with recursive f as {_FRAME}, near as (select src, idx, list(o) nb from (select src, i idx, j o from {_DIST} where d <= 0.2 union all select src, j, i from {_DIST} where d <= 0.2) group by all),
x as (select f.*, coalesce(nb, []::bigint[]) nb, row_number() over (partition by src order by score desc, t, idx) r from f left join near using (src, idx)),
n(src, r, acc, reason) as (select distinct src, 0::bigint, []::struct(idx bigint, t double)[], null::varchar from x union all
  select n.src, x.r, case when w is null then list_append(acc, {{'idx': x.idx, 't': x.t}}) else acc end, w from n join x on x.src = n.src and x.r = n.r + 1, lateral (select case when len(acc) >= 12 then 'requestedCountReached'
  else list_filter(list_transform(acc, lambda a: case when abs(x.t - a.t) < 1.0 then 'minimumSpacingConflict' when abs(x.t - a.t) <= 30 and list_contains(x.nb, a.idx) then 'localNearDuplicateConflict' end), lambda z: z is not null)[1] end w)),
y as (select x.src, x.idx, x.t, x.score, n.reason, case when n.reason is null then len(n.acc) end position from n join x on x.src = n.src and x.r = n.r),
"""
_LOW, _HIGH = f"coalesce(list_max(list_filter({_CUTS}, lambda v: v <= {{0}})), 0)", f"coalesce(list_min(list_filter({_CUTS}, lambda v: v > {{0}})), 73)"
_SEGMENTS = f"""an as (select *, row_number() over (partition by src order by t, idx) k, {_LOW.format('t')} lo, {_HIGH.format('t')} hi from y where reason is null),
r0 as (select *, least(t, greatest(0, t - 1.0::double, lo)) s, greatest(t, least(73, t + 2.0::double, hi)) e from an),
r1 as (select *, least(t - s, 1.0) dl, least(e - t, 2.0) dr from r0),
r2 as (select *, case when e - s <= 2.8 then s when dl + dr <= 2.8 then t - dl else t - least(dl, 2.8 * (dl / (dl + dr))) end s2, case when e - s <= 2.8 then e when dl + dr <= 2.8 then t + dr else t + (2.8 - least(dl, 2.8 * (dl / (dl + dr)))) end e2 from r1),
r3 as (select *, (t + lead(t) over v) / 2 nm, (lag(t) over v + t) / 2 pm from r2 window v as (partition by src order by k)),
r4 as (select src, idx, t, k, position, greatest(lo, case when pm is not null and s2 < pm then least(t, pm) else s2 end) s, least(hi, case when nm is not null and e2 > nm then greatest(t, nm) else e2 end) e from r3),
mg(src, k, seg, ss, pe) as (select src, k, 1::bigint, s, e from r4 where k = 1 union all select m.src, r.k, case when j then m.seg else m.seg + 1 end, case when j then m.ss else r.s end, r.e from mg m join r4 r on r.src = m.src and r.k = m.k + 1,
  lateral (select abs(m.pe - r.s) < 1e-9 and r.e - m.ss <= 2.8 and {_LOW.format('m.ss')} = {_LOW.format('r.e')} j)),
sg as (select r.src, mg.seg, min(r.s) s, arg_max(r.e, r.k) e, min(r.t) a, max(r.t) b from r4 r join mg on mg.src = r.src and mg.k = r.k group by 1, 2),
od as (select r.src, r.position p, sg.* exclude (src) from r4 r join mg on mg.src = r.src and mg.k = r.k join sg on sg.src = r.src and sg.seg = mg.seg),
bd(src, p, paid, rest, seg, s, e) as (select distinct src, 0::bigint, []::bigint[], 15.0::double, null::bigint, null::double, null::double from od union all
  select o.src, o.p, case when ok then list_append(paid, o.seg) else paid end, case when not ok then rest when o.e - o.s <= rest then rest - (o.e - o.s) else 0 end, case when ok then o.seg end,
  case when o.e - o.s <= rest then o.s else o.s + cut end, case when o.e - o.s <= rest then o.e else o.e - ((o.e - o.s - rest) - cut) end
  from bd join od o on o.src = bd.src and o.p = bd.p + 1, lateral (select not list_contains(paid, o.seg) and rest > 0 and (o.e - o.s <= rest or o.b - o.a <= rest) ok, least(o.a - o.s, (o.e - o.s - rest) * ((o.a - o.s) / greatest(1e-9, (o.a - o.s) + (o.e - o.b)))) cut)),
fin as (select src, seg, s, e, row_number() over (partition by src order by s) number from bd where seg is not null and e > s)
"""


def _highlights(spark, d):
    e = T.events(spark, d)
    i = c("id")
    x = e.select("src", "t", "id", F.when(i % 101 == 0, -i).when(i % 67 == 0, 67).otherwise(i).alias("i"))
    w = Window.partitionBy("src").orderBy("t", "id")
    lags = [x.select("src", "i", F.lag("i", n).over(w).alias("j")) for n in (1, 2, 3)]
    dist = lags[0].unionByName(lags[1]).unionByName(lags[2]).where("j is not null").withColumn("d", ((c("i") + c("j")) % 10) / 10.0)
    rec = e.select("src").distinct().withColumns({"duration": F.lit(73.0), "cuts": F.array(*[F.lit(7.0 * k) for k in range(1, 11)], F.lit(float("nan")), F.lit(99.0))})
    return H.highlights(T.frames(spark, d), dist, rec, "src", CONF)


@query(
    "g06_highlight_frames",
    _CHOSEN.rstrip(",\n") + f""" select src, idx, reason, round(score, 6) score, position::int position from y union all select distinct src, idx, reason, null, null from (select *, {FRAME_REASON_SQL} reason from {FRAMES}) where reason is not null""",
)
def highlight_frames(spark, d):
    return _highlights(spark, d).select("src", "idx", "reason", r6("score").alias("score"), "position")


@query("g07_g08_segments", _CHOSEN + _SEGMENTS + "select f.src, f.number::int segment, round(f.s, 6) start, round(f.e, 6) \"end\", string_agg(r.idx::varchar, ',' order by r.idx) anchors from fin f join mg on mg.src = f.src and mg.seg = f.seg join r4 r on r.src = mg.src and r.k = mg.k group by all")
def highlight_segments(spark, d):
    x = H.segments(_highlights(spark, d), "src")
    return x.select("src", "segment", r6("start").alias("start"), r6("end").alias("end"), F.array_join(F.transform("anchors", lambda a: a.cast("string")), ",").alias("anchors"))


@query("a26_segment_totals", _CHOSEN + _SEGMENTS + "select src, count(*) segments, round(sum(e - s), 6) \"seconds\" from fin group by 1")
def segment_totals(spark, d):
    return H.segments(_highlights(spark, d), "src").groupBy("src").agg(F.count(F.lit(1)).alias("segments"), r6(F.sum(c("end") - c("start"))).alias("seconds"))


assert ORACLES and EV
