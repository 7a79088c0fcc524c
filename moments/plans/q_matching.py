"""Queries of joins, matching and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from moments.functions.policies import label_class
from moments.operators import evaluation as EV
from moments.operators import blocks, greedy, matching, ranges, ranking, sets
from moments.operators import photos as PH
from moments.plans import testdata as T
from moments.plans.base import c, query, r6
from moments.plans.q_scalars import FIVE_SQL, LABELS, five, lit_list, pick

E, A, PHOTOS, C = T.EVENTS_SQL, T.AUDIO_SQL, T.PHOTOS_SQL, T.CLIPS_SQL
CLASS = "case when {0} = 'ambiguous' then {0} when {0} = 'putter' then 'putter' when {0} in ('non-shot', 'nonPutter') then 'negative' when {0} in ('driver', 'wood', 'iron', 'wedge') then 'other-club' else 'unlabeled' end"

_CANDS = f"(select src, id, t, value, row_number() over (partition by src order by value desc, id) r from {E} where kind = 'view')"
_REFS = f"(select src, id ref, t u, {lit_list(LABELS)}[id % 8 + 1] l from {E} where kind = 'click')"


def _cands(spark, d):
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("value"), "id"))
    return T.events(spark, d).where("kind = 'view'").select("src", "id", "t", "value", r.alias("rank"))


def _refs(spark, d):
    return T.events(spark, d).where("kind = 'click'").select("src", c("id").alias("ref"), c("t").alias("u"), pick(LABELS, c("id") % 8).alias("label"))


_GREEDY = f"""with recursive cand as {_CANDS}, refs as {_REFS},
m as (select cand.src, r, id, list({{'d': abs(u - t), 'ref': ref, 'l': l}} order by abs(u - t), ref) filter (where ref is not null) ms from cand left join refs on cand.src = refs.src and abs(u - t) <= 1.0 group by all),
n(src, r, id, used, label) as (select src, 0::bigint, null::bigint, []::bigint[], null::varchar from (select distinct src from cand) union all
  select n.src, m.r, m.id, case when f[1] is null then used else list_append(used, f[1].ref) end, case when f[1] is null then 'unlabeled' when len(list_distinct(list_transform(list_filter(f, lambda x: x.d = f[1].d), lambda x: x.l))) > 1 then 'ambiguous' else f[1].l end
  from n join m on n.src = m.src and m.r = n.r + 1, lateral (select list_filter(ms, lambda x: not list_contains(used, x.ref)) f))
"""


@query("j07_one_to_one", _GREEDY + f"select src, id, {CLASS.format('label')} label from n where r > 0")
def one_to_one(spark, d):
    return matching.one_to_one(_cands(spark, d), _refs(spark, d), "src", 1.0).select("src", "id", "label")


@query(
    "a19_outcomes_at_limits",
    _GREEDY + f""", g as (select *, row_number() over (order by c.value desc, c.id) rk from (select n.id, {CLASS.format('n.label')} label from n where r > 0) l join (select id, value from cand) c using (id))
    select lim::int "limit", count(*) filter (where label = 'putter') putter, count(*) filter (where label = 'negative') negative, count(*) filter (where label = 'other-club') other_club, count(*) filter (where label = 'ambiguous') ambiguous, count(*) filter (where label = 'unlabeled') unlabeled
    from g join (values (30), (50), (100)) v(lim) on rk <= lim group by lim""",
)
def outcomes(spark, d):
    x = matching.one_to_one(_cands(spark, d), _refs(spark, d), "src", 1.0).select("id", "value", "label")
    top = x.orderBy(F.desc("value"), "id").limit(100).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("value"), "id")))
    return matching.outcomes(top, "rk", "label", (30, 50, 100))


@query("j08_priority_match", f"select c.src, c.id, case coalesce(max(case {CLASS.format('l')} when 'putter' then 3 when 'negative' then 2 when 'other-club' then 1 else 0 end), 0) when 3 then 'putter' when 2 then 'negative' when 1 then 'other-club' else 'unlabeled' end label from {_CANDS} c left join {_REFS} r on c.src = r.src and abs(u - t) <= 1.0 group by all")
def priority(spark, d):
    return matching.by_priority(_cands(spark, d).select("src", "id", "t"), _refs(spark, d), "src", 1.0).select("src", "id", "label")


@query(
    "j16_review_candidates",
    f"""select c.id, arg_min(l, ref) filter (where abs(c.t - u) < 0.25) label from (select *, value / 12 motion from {_CANDS}) c left join {_REFS} r on c.src = r.src and abs(c.t - u) < 0.6 group by c.id, c.motion having (count(ref) = 0 and motion <= 7.0) or coalesce(bool_or(l = 'putter'), false)""",
)
def review_candidates(spark, d):
    x = _cands(spark, d).select("src", "id", "t", (c("value") / 12).alias("motion"))
    return matching.review_candidates(x, _refs(spark, d), "src", "motion", 0.6).select("id", "label")


@query("j09_context_roles", f"select ref id, case when l = 'putter' or (l = 'non-shot' and exists (select 1 from {_REFS} p where p.src = r.src and p.l = 'putter' and abs(p.u - r.u) <= 2.0)) then 'positive' when l in ('non-shot', 'nonPutter') then 'negative' end role from {_REFS} r")
def context(spark, d):
    x = _refs(spark, d).select("src", c("ref").alias("id"), c("u").alias("t"), "label")
    return matching.with_context(x, "src", 2.0).select("id", "role")


_FAR = "(abs(least(3, floor(a.idx / 125)) - least(3, floor(b.idx / 125))) = 1 and ({0}))"
_EDGE = "abs({0}.idx - least(3, floor({0}.idx / 125)) * 125) <= 5 or abs((least(3, floor({0}.idx / 125)) + 1) * 125 - {0}.idx) <= 5"
_MARGINS = f"""(select idx id, pos, d, row_number() over (partition by idx, pos order by d) r from (select a.idx, b.idx % 20 = 0 pos, list_avg(list_transform(range(1, 65), lambda k: abs(a.e[k]::double - b.e[k]::double))) d from {PHOTOS} a join {PHOTOS} b on b.idx % 10 = 0
and not (a.set_id = b.set_id and (abs(a.idx - b.idx) <= 6 or least(3, floor(a.idx / 125)) = least(3, floor(b.idx / 125)) or {_FAR.format(_EDGE.format('a') + ' or ' + _EDGE.format('b'))}))))"""


@query("j10_a18_reference_margins", f"select id, round(p, 6) positive, round(q, 6) negative, round(q - p, 6) margin from (select id, avg(d) filter (where pos) p, avg(d) filter (where not pos) q from {_MARGINS} where r <= 3 group by 1) where p is not null and q is not null")
def margins(spark, d):
    p = T.photos(spark, d).select("set_id", c("idx").alias("id"), c("idx").cast("double").alias("t"), c("e").cast("array<double>").alias("v"))
    refs = p.where("id % 10 = 0").withColumn("positive", c("id") % 20 == 0)
    x = matching.reference_margins(p, refs, "set_id", matching.mean_apart, 3, blocks=4, quarantine=5.0, duration=500.0)
    return x.select("id", *[r6(n).alias(n) for n in ("positive", "negative", "margin")])


_LISTS = [f"(select src, round_even(t * 1000, 0)::bigint k, row_number() over (order by {order}) - 1 r from {E} where id % {m} <> 0)" for order, m in (("value desc, id", 3), ("(id * 7919) % 10007, id", 4))]
_BOTH = f"(select a.src, a.k, a.r ra, b.r rb from (select src, k, max(r) r from {_LISTS[0]} group by all) a join (select src, k, max(r) r from {_LISTS[1]} group by all) b on a.src = b.src and a.k = b.k)"


def _both(spark, d):
    e = T.events(spark, d)
    k = F.rint(c("t") * 1000).cast("long").alias("k")
    lists = []
    for m, lead in ((3, -c("value")), (4, (c("id") * 7919) % 10007)):
        x = e.where(c("id") % m != 0).select("src", k, "value", "id")
        lists.append(ranking.numbered(x, "r", lead, c("id")).groupBy("src", "k").agg((F.max("r") - 1).alias("r")))
    a, b = lists
    return a.withColumnRenamed("r", "ra").join(b.withColumnRenamed("r", "rb"), ["src", "k"])


@query("j11_m03_rank_intersection", f"select src, k, ra::bigint ra, rb::bigint rb, round(0.6 / (60 + ra) + 0.4 / (60 + rb), 9) f from {_BOTH}")
def intersection(spark, d):
    from moments.operators.calibration import positional_fusion

    x = positional_fusion(_both(spark, d), ["src"], "ra", "rb", (0.6, 0.4))
    return x.select("src", "k", c("ra").cast("long").alias("ra"), c("rb").cast("long").alias("rb"), F.round("fused", 9).alias("f"))


@query("j12_merged_scores", f"select id, g grp, positive, round(expert, 6) expert, round(semantic, 6) \"full\", round(semantic / 2, 6) short from {C}")
def merged(spark, d):
    x = T.clips(spark, d).withColumnRenamed("g", "grp")
    y = sets.merged_scores(x, x, x.withColumn("semantic", c("semantic") / 2))
    return y.select("id", "grp", "positive", r6("expert").alias("expert"), r6("full").alias("full"), r6("short").alias("short"))


@query("j17_latest_state", f"select v.id, coalesce(k.l, 'unreviewed') label from (select id, src from {E} where kind = 'view') v left join (select id % 500 * 2 id, arg_max({lit_list(LABELS)}[id % 8 + 1], id) l from {E} group by 1) k on v.id = k.id")
def latest(spark, d):
    from moments.sources import text

    e = T.events(spark, d)
    log = e.select((c("id") % 500 * 2).alias("id"), pick(LABELS, c("id") % 8).alias("label"), c("id").alias("log_order"))
    return text.with_latest_labels(e.where("kind = 'view'").select("id"), log, "unreviewed")


# ---- events and predictions ------------------------------------------------------------------------------------------

_PRED = f"(select src, id pid, t from {E} where kind = 'purchase')"
_EVTS = f"(select src, id eid, case id % 3 when 0 then 'positive' when 1 then 'negative' else 'other' end label, t s, case when id % 2 = 0 then t + 0.8 else t end z from {E} where kind = 'click')"
_COVER = f"(select src, t s, t + 5 z from {E} where kind = 'signup')"
_EDGES = f"(select p.src, pid, p.t, eid, label, greatest(0, s - t, t - z) dist, z from {_PRED} p join {_EVTS} v on p.src = v.src and case when s = z then abs(t - s) <= 0.5 + 1e-9 else t between s and z end)"


def _pred(spark, d):
    return T.events(spark, d).where("kind = 'purchase'").select("src", c("id").alias("pid"), "t")


def _evts(spark, d):
    i, t = c("id"), c("t")
    label = F.when(i % 3 == 0, "positive").when(i % 3 == 1, "negative").otherwise("other")
    return T.events(spark, d).where("kind = 'click'").select("src", i.alias("eid"), label.alias("label"), t.alias("start"), F.when(i % 2 == 0, t + 0.8).otherwise(t).alias("end"))


def _cover(spark, d):
    return T.events(spark, d).where("kind = 'signup'").select("src", c("t").alias("start"), (c("t") + 5).alias("end"))


@query("j13_event_containment", f"select pid, eid, label, round(dist, 6) dist from {_EDGES}")
def containment(spark, d):
    return matching.event_edges(_pred(spark, d), _evts(spark, d), "src", 0.5).select("pid", "eid", "label", r6("dist").alias("dist"))


#: As many points as can be are given intervals by taking, point after point, the open interval that ends first.
_MATCHED = f"""o as (select src, pid, row_number() over (partition by src order by t, pid) r, opts from (select src, pid, t, list(eid order by case when s = z then s + 0.5 else z end, eid) opts from (select e.*, v.s from {_EDGES} e join {_EVTS} v on e.eid = v.eid where e.label = 'positive') group by all)),
n(src, r, used) as (select distinct src, 0::bigint, []::bigint[] from o union all select n.src, o.r, case when f[1] is null then used else list_append(used, f[1]) end from n join o on n.src = o.src and o.r = n.r + 1, lateral (select list_filter(opts, lambda x: not list_contains(used, x)) f)),
tp as (select src, max(len(used)) tp from n group by 1)
"""


@query("j14_maximum_matching", f"with recursive {_MATCHED} select src, tp::bigint matched from tp where tp > 0")
def matched(spark, d):
    return matching.maximum_matching(_pred(spark, d), _evts(spark, d), "src", 0.5).groupBy("src").agg(F.count_distinct("pid").alias("matched"))


_COUNTERS = f"""with recursive {_MATCHED}, k as (select p.src, p.pid, bool_or(e.label = 'positive') pos, bool_or(e.label = 'negative') neg, exists (select 1 from {_COVER} v where v.src = p.src and p.t between v.s and v.z) cov from {_PRED} p left join {_EDGES} e on p.pid = e.pid group by p.src, p.pid, p.t),
b as (select src, count(*) selected, count(*) filter (where coalesce(pos, false)) pos, count(*) filter (where not coalesce(pos, false) and coalesce(neg, false)) negative_fp, count(*) filter (where not coalesce(pos, false) and not coalesce(neg, false) and cov) coverage_fp,
  count(*) filter (where not coalesce(pos, false) and not coalesce(neg, false) and not cov) unknown from k group by 1),
u as (select src, count(*) filter (where label = 'positive') positives, count(*) filter (where label = 'negative') negatives from {_EVTS} group by 1),
m as (select coalesce(b.src, u.src) src, coalesce(selected, 0) selected, coalesce(positives, 0) positives, coalesce(negatives, 0) negatives, coalesce(tp.tp, 0) tp, coalesce(pos, 0) - coalesce(tp.tp, 0) duplicate_fp, coalesce(negative_fp, 0) negative_fp, coalesce(coverage_fp, 0) coverage_fp, coalesce(unknown, 0) unknown
  from b full join u on b.src = u.src left join tp on tp.src = coalesce(b.src, u.src))
"""
_RATES = "round(tp / nullif(tp + duplicate_fp + negative_fp + coverage_fp, 0), 6) \"precision\", round(tp / nullif(positives, 0), 6) recall, round((tp + duplicate_fp + negative_fp + coverage_fp) / nullif(selected, 0), 6) known_share"
_NAMES = ("selected", "positives", "negatives", "tp", "duplicate_fp", "negative_fp", "coverage_fp", "unknown")


def _counters(spark, d):
    return EV.event_counters(_pred(spark, d), _evts(spark, d), _cover(spark, d), "src", 0.5)


@query("a06_event_counters", _COUNTERS + f"select src, {', '.join(f'{n}::bigint {n}' for n in _NAMES)}, {_RATES} from m")
def counters(spark, d):
    return _counters(spark, d).select("src", *_NAMES, *[r6(n).alias(n) for n in ("precision", "recall", "known_share")])


_CASE = "case when src % 4 = 0 then 'calibration' else 'heldOut' end split, 'run' || (src % 3) run, case when src % 5 = 0 then 'unspecified' else 'all-pairs' end \"scope\""


@query(
    "a05_run_totals",
    _COUNTERS + f"""select split, run, "scope", cases, {', '.join(f'{n}::bigint {n}' for n in _NAMES)}, measured, round(sec, 6) "seconds", round(sec / nullif(measured, 0), 6) mean_seconds, case when "scope" = 'unspecified' then 'fairness not verified' end note, {_RATES} from (
    select {_CASE}, count(*) cases, {', '.join(f'sum({n}) {n}' for n in _NAMES)}, count(el) measured, coalesce(sum(el), 0) sec from (select *, case when src % 7 <> 0 then src / 10.0::double end el from m) group by 1, 2, 3)""",
)
def run_totals(spark, d):
    s = c("src")
    x = _counters(spark, d).select(
        F.when(s % 4 == 0, "calibration").otherwise("heldOut").alias("split"), F.lit("video").alias("mode"), F.concat(F.lit("run"), (s % 3).cast("string")).alias("run"),
        F.when(s % 5 != 0, "all-pairs").alias("scope"), F.when(s % 7 != 0, s / 10.0).alias("elapsed"), *_NAMES,
    )
    y = EV.event_rates(EV.totals(x, list(_NAMES)))
    return y.select("split", "run", "scope", "cases", *_NAMES, "measured", r6("seconds").alias("seconds"), r6("mean_seconds").alias("mean_seconds"), "note", *[r6(n).alias(n) for n in ("precision", "recall", "known_share")])


# ---- pairs, preferences, groups --------------------------------------------------------------------------------------

COS = "least(2, greatest(0, 1 - list_dot_product(a.e::double[], b.e::double[]) / sqrt(list_dot_product(a.e::double[], a.e::double[])) / sqrt(list_dot_product(b.e::double[], b.e::double[]))))"
PAIRS_SQL = f"(select a.set_id, a.idx i, b.idx j, {COS} d from {PHOTOS} a join {PHOTOS} b on a.set_id = b.set_id and a.idx < b.idx)"
_TRUTH = f"(select *, ['similar', 'different', 'unknown', 'different'][(i * 31 + j) % 4 + 1] label, case when (i + j) % 7 <> 0 then d <= 0.95 end sim from {PAIRS_SQL})"


_TRUTHS = ("similar", "different", "unknown", "different")


def _tally(i: np.ndarray, j: np.ndarray, d: np.ndarray):
    """label, similar and n of the pairs of a block: they are as many as the square of a set, so they are counted where they are made."""
    truth = ((i * 31 % 4).astype(np.int8)[:, None] + (j % 4).astype(np.int8)) & 3
    known = ((i % 7).astype(np.int8)[:, None] + (j % 7).astype(np.int8)) % 7 != 0
    with np.errstate(invalid="ignore"):
        code = truth * np.int8(3) + np.where(known, d <= 0.95, np.int8(2)).astype(np.int8)
    n = np.bincount(code[~np.isnan(d)], minlength=12)
    yield [_TRUTHS[k // 3] for k in range(12)], [(False, True, None)[k % 3] for k in range(12)], n


@query(
    "a04_pair_metrics",
    f"""select set_id, pairs, tp, fp, tn, fn, unknown, missing, round(p, 6) "precision", round(r, 6) recall, round(2 * p * r / nullif(p + r, 0), 6) f1, round((tp + fp + tn + fn) / nullif(tp + fp + tn + fn + missing, 0), 6) coverage from (select *, tp / nullif(tp + fp, 0) p, tp / nullif(tp + fn, 0) r from (
    select set_id, count(*) pairs, count(*) filter (where label = 'similar' and sim) tp, count(*) filter (where label = 'different' and sim) fp, count(*) filter (where label = 'different' and not sim) tn, count(*) filter (where label = 'similar' and not sim) fn,
    count(*) filter (where label = 'unknown') unknown, count(*) filter (where label <> 'unknown' and sim is null) missing from {_TRUTH} group by 1))""",
)
def pair_metrics(spark, d):
    x = blocks.pair_blocks(T.photos(spark, d), "set_id", _tally, "label string, similar boolean, n long").where("n > 0")
    m = EV.pair_metrics(x.withColumn("outcome", EV.outcome(c("label"), c("similar"))), "set_id", n=c("n"))
    return m.select("set_id", "pairs", "tp", "fp", "tn", "fn", "unknown", "missing", *[r6(n).alias(n) for n in ("precision", "recall", "f1", "coverage")])


@query("g13_similar_pairs", f"select set_id, idx i, idx + 10 j, coalesce((select d <= 0.95 from {PAIRS_SQL} p where p.set_id = x.set_id and p.i = x.idx and p.j = x.idx + 10), false) \"similar\" from {PHOTOS} x")
def similar(spark, d):
    q = T.photos(spark, d).select("set_id", (c("idx") + 10).alias("i"), c("idx").alias("j"))
    dist = PH.asked_distances(T.photos(spark, d), "set_id", q).withColumn("o", F.lit(1))
    return PH.similar_pairs(q, dist, "set_id", 0.95, "o").select("set_id", c("j").alias("i"), c("i").alias("j"), "similar")


def _farthest(i: np.ndarray, j: np.ndarray, d: np.ndarray):
    """The records j % 40, i % 40 of the pairs of a block, of those of one name the largest distance."""
    a, b = i % 40, j % 40
    p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    (names, at), (others, to) = np.unique(a[p], return_index=True), np.unique(b[q], return_index=True)
    most = np.fmax.reduceat(np.fmax.reduceat(d[p], at, axis=0)[:, q], to, axis=1)
    some = ~np.isnan(most)
    yield np.broadcast_to(others, most.shape)[some], np.broadcast_to(names[:, None], most.shape)[some], most[some]


@query("j02_canonical_pairs", f"select set_id, i, j, round(max(d), 6) d from (select set_id, least(i % 40, j % 40) i, greatest(i % 40, j % 40) j, d from {PAIRS_SQL}) where i <> j and i % 3 <> 0 and j % 3 <> 0 group by all")
def canonical(spark, d):
    x = blocks.pair_blocks(T.photos(spark, d), "set_id", _farthest, "i long, j long, d double")
    known = T.photos(spark, d).select("set_id", (c("idx") % 40).alias("idx")).where("idx % 3 <> 0")
    everywhere = known.select("idx").distinct().join(F.broadcast(known.select("set_id").distinct()), how="cross")  # ten sets of forty
    return greedy.canonical_pairs(x, "set_id", everywhere).select("set_id", "i", "j", r6("d").alias("d"))


@query(
    "a07_preferences",
    f"""select set_id, count(*) total, count(*) filter (where g and (p % 4 = 0 or o % 4 = 0)) evaluable, count(*) filter (where g and p % 4 = 0) wins, count(*) filter (where g and o % 4 = 0) losses, round(count(*) filter (where g and p % 4 = 0) / nullif(count(*) filter (where g and (p % 4 = 0 or o % 4 = 0)), 0), 6) rate
    from (select x.set_id, x.idx p, x.idx + 1 + x.idx % 3 o, x.idx // 4 = (x.idx + 1 + x.idx % 3) // 4 and y.idx is not null g from {PHOTOS} x left join {PHOTOS} y on y.set_id = x.set_id and y.idx = x.idx + 1 + x.idx % 3) group by 1""",
)
def preferences(spark, d):
    p = T.photos(spark, d)
    groups = p.select("set_id", "idx", (c("idx") - c("idx") % 4).alias("representative"))
    wishes = p.select("set_id", c("idx").alias("preferred"), (c("idx") + 1 + c("idx") % 3).alias("other"))
    return EV.preference_metrics(wishes, groups, "set_id").select("set_id", "total", "evaluable", "wins", "losses", r6("rate").alias("rate"))


@query("a09_field_summary", f"select field, kind, count(v) n, round(min(v), 6) low, round(max(v), 6) high, round(avg(v), 6) mean, round(median(v), 6) \"median\" from (select kind, unnest(['rms', 'peak']) field, unnest([rms, peak]) v from {A} join (select id, kind from {E}) using (id)) group by all")
def field_summary(spark, d):
    x = T.audio(spark, d).join(T.events(spark, d).select("id", "kind"), "id")
    return EV.field_summary(x, ["rms", "peak"], "kind").select("field", "kind", "n", *[r6(k).alias(k) for k in ("low", "high", "mean", "median")])


@query("a12_gap_scale", f"select round(coalesce(median(gap), 0), 9) scale from (select expert - lead(expert) over (partition by g order by expert desc, id) gap from {C}) where gap > 0")
def gap_scale(spark, d):
    return EV.gap_scale(T.clips(spark, d), "g", "expert", "id").select(F.round("scale", 9).alias("scale"))


@query("a15_clip_aggregates", f"select clip, round(avg(q), 6) q_mean, round(min(q), 6) q_min, round(max(q), 6) q_max from {FIVE_SQL} group by 1")
def clip_aggregates(spark, d):
    x = EV.clip_aggregates(five(spark, d), "clip", ["q"])
    return x.select("clip", *[r6(n).alias(n) for n in ("q_mean", "q_min", "q_max")])


@query("a17_clip_status", f"select clip, count(*) filter (where q >= 0.3) succeeded, count(*) filter (where q < 0.3) failed, case when count(*) filter (where q >= 0.3) = 5 then 'ok' when count(*) filter (where q >= 0.3) > 0 then 'partial' else 'error' end status from {FIVE_SQL} group by 1")
def clip_status(spark, d):
    return EV.clip_status(five(spark, d), "clip", c("q") >= 0.3, 5)


@query("w13_adjacent_differences", f"select clip, n, before, round(abs(q - pq), 6) q_change from (select clip, n, q, lag(q) over w pq, lag(n) over w before from {FIVE_SQL} where q >= 0.3 window w as (partition by clip order by n)) where before is not null")
def adjacent(spark, d):
    return EV.adjacent_differences(five(spark, d), "clip", "n", c("q") >= 0.3, ["q"]).select("clip", "n", "before", r6("q_change").alias("q_change"))


@query("a25_contribution_spread", f"select set_id, round(avg(0.7 * q), 6) quality, round(avg(0.3 * p[2]), 6) semantic, round(avg(0.7 * q) / avg(0.3 * p[2]), 6) ratio, avg(0.7 * q) / avg(0.3 * p[2]) > 2 dominant from {FIVE_SQL} group by 1")
def spread(spark, d):
    x = EV.contribution_spread(five(spark, d).withColumn("s", c("p")[1]), "set_id")
    return x.select("set_id", r6("quality").alias("quality"), r6("semantic").alias("semantic"), r6("ratio").alias("ratio"), "dominant")


@query("a23_split_leaks", "select kind, id from (select case when event_id % 9 < 6 then 'calibration' else 'heldOut' end split, unnest(['source', 'session']) kind, unnest([user_id % 40, event_id % 18]::bigint[]) id from events) group by all having count(distinct split) > 1")
def leaks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    x = e.select(F.when(c("event_id") % 9 < 6, "calibration").otherwise("heldOut").alias("split"), (c("user_id") % 40).alias("source"), (c("event_id") % 18).alias("session"))
    return EV.leaks(x).select("kind", "id")


@query("a24_inconsistent_runs", "select user_id run from events group by 1 having count(distinct {'v': event_id % 2, 's': case when event_id % 11 = 0 then 'unspecified' else 'x' end}) > 1 and user_id % 3 = 0")
def inconsistent(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id % 3 = 0")
    return EV.inconsistent_runs(e.select(c("user_id").alias("run"), (c("event_id") % 2).alias("version"), F.lit("all").alias("variant"), F.when(c("event_id") % 11 != 0, "x").alias("scope"))).select("run")
