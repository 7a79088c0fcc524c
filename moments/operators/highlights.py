"""Highlights of recordings: frames that are good, apart and different, and the segments around them within a budget."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moments.functions.policies import configuration_errors, frame_reason
from moments.operators.greedy import bounded, canonical_pairs, with_neighbours
from moments.operators.groups import by_group, kind
from moments.operators.ranges import cut_list

c = F.col
TOUCH = 1e-9


@dataclass(frozen=True)
class Highlights:
    frame_count: int
    similarity_threshold: float
    minimum_quality: float = 0.25
    minimum_spacing: float = 1.0
    diversity_window: float = 30.0
    pre_roll: float = 1.0
    post_roll: float = 2.0
    max_segment: float = 6.0
    budget: float = 30.0
    importance_weight: float = 0.3


def errors(duration, conf: Highlights):
    """Column of all errors of the settings for recordings of a duration."""
    return configuration_errors(duration=duration, **{k: F.lit(v) for k, v in asdict(conf).items()})


def choose(times: list[float], ids: list, near: list[set], conf: Highlights) -> tuple[list[int], list[str | None]]:
    """Places taken, in the order of the ranked candidates, and why the others weren't."""
    taken, why = [], []
    for k, t in enumerate(times):
        reason = None
        if len(taken) >= conf.frame_count:
            reason = "requestedCountReached"
        else:
            for o in taken:
                apart = abs(t - times[o])
                if apart < conf.minimum_spacing:
                    reason = "minimumSpacingConflict"
                    break
                if apart <= conf.diversity_window and ids[o] in near[k]:
                    reason = "localNearDuplicateConflict"
                    break
        if reason is None:
            taken.append(k)
        why.append(reason)
    return taken, why


def shot(cuts: list[float], t: float, end: float) -> tuple[float, float]:
    return max((x for x in cuts if x <= t), default=0.0), min((x for x in cuts if x > t), default=end)


def reach(t: float, low: float, high: float, conf: Highlights) -> tuple[float, float]:
    """The segment of an anchor inside its shot, cut to the longest allowed in proportion to both sides."""
    start, end = min(t, max(0.0, t - conf.pre_roll, low)), max(t, min(t + conf.post_roll, high))
    if end - start <= conf.max_segment:
        return start, end
    left, right = min(t - start, conf.pre_roll), min(end - t, conf.post_roll)
    if left + right <= conf.max_segment:
        return t - left, t + right
    left = min(left, conf.max_segment * (left / (left + right)))
    return t - left, t + (conf.max_segment - left)


def build(anchors: list[float], cuts: list[float], duration: float, conf: Highlights) -> list[list]:
    """[start, end, places of anchors] of anchors in time order: split halfway between neighbours, joined again where they touch, fit and share a shot."""
    shots = [shot(cuts, t, duration) for t in anchors]
    spans = [list(reach(t, a, min(b, duration), conf)) for t, (a, b) in zip(anchors, shots, strict=True)]
    for k in range(len(anchors) - 1):
        middle = (anchors[k] + anchors[k + 1]) / 2
        if spans[k][1] > middle:
            spans[k][1] = max(anchors[k], middle)
        if spans[k + 1][0] < middle:
            spans[k + 1][0] = min(anchors[k + 1], middle)
    out: list[list] = []
    for k, ((start, end), (a, b)) in enumerate(zip(spans, shots, strict=True)):
        start, end = max(start, a), min(end, b)
        last = out[-1] if out else None
        if last and abs(last[1] - start) < TOUCH and end - last[0] <= conf.max_segment and shot(cuts, last[0], duration) == shot(cuts, end, duration):
            last[1] = end
            last[2].append(k)
        else:
            out.append([start, end, [k]])
    return out


def pack(segments: list[list], anchors: list[float], order: list[int], budget: float) -> set[int]:
    """Segments that the budget pays for, in the order of their anchors; the last one is shrunk around its anchors."""
    home = {a: s for s, (_, _, own) in enumerate(segments) for a in own}
    paid: set[int] = set()
    for a in order:
        s = home[a]
        if s in paid or budget <= 0:
            continue
        start, end, own = segments[s]
        if end - start <= budget:
            budget -= end - start
            paid.add(s)
            continue
        first, last = min(anchors[k] for k in own), max(anchors[k] for k in own)
        if last - first <= budget:
            excess, left, right = (end - start) - budget, first - start, end - last
            cut = min(left, excess * (left / max(TOUCH, left + right)))
            segments[s][:2] = [start + cut, end - (excess - cut)]
            paid.add(s)
            budget = 0.0
    return paid


OUT = "idx long, reason string, score double, position int, segment int, start double, end double"


def highlights(frames: DataFrame, distances: DataFrame, recordings: DataFrame, key: str, conf: Highlights) -> DataFrame:
    """key, idx, reason, score, position, segment, start, end of every candidate.

    frames: key, idx, t, q, imp; distances: key, i, j, d; recordings: key, duration, cuts. Selected frames have a position
    in the order of preference and no reason; those whose segment the budget pays for have the segment's number (in time)
    and bounds. Recordings for which the settings are wrong give nothing (see ``errors``). Rejected candidates come once for
    each idx. A recording is refused beyond MOST_IN_A_SET eligible candidates.
    """
    rec = recordings.where(F.size(errors(c("duration"), conf)) == 0).select(key, "duration", cut_list(F.coalesce("cuts", F.array().cast("array<double>")), c("duration")).alias("cuts"))
    copies = F.count(F.lit(1)).over(Window.partitionBy(key, "idx"))
    x = frames.select(key, "idx", "t", "q", "imp").join(rec, key)
    x = x.withColumn("reason", frame_reason(copies, c("idx"), c("t"), c("duration"), c("q"), c("imp"), F.lit(conf.minimum_quality)))
    whole = F.min(c("imp").isNotNull()).over(Window.partitionBy(key))
    good = x.where("reason is null").withColumn("score", F.when(whole, (1.0 - conf.importance_weight) * c("q") + conf.importance_weight * c("imp")).otherwise(c("q")))
    good = good.select(key, "idx", "t", "score", "duration", "cuts")
    pairs = canonical_pairs(distances, key, good)

    def select(rows: list[tuple]) -> list[tuple]:
        key_, ids, times, _, score, lengths, cut, near = map(list, zip(*bounded(rows), strict=True))
        taken, why = choose(times, ids, [set(n or ()) for n in near], conf)
        line = sorted(taken, key=lambda k: (times[k], ids[k]))
        place = {k: n for n, k in enumerate(line)}
        anchors = [times[k] for k in line]
        segments = build(anchors, cut[0], lengths[0], conf)
        paid = pack(segments, anchors, [place[k] for k in taken], conf.budget)
        shown = sorted((s for s in paid if segments[s][1] > segments[s][0]), key=lambda s: segments[s][0])
        seen = {a: (n + 1, *segments[s][:2]) for n, s in enumerate(shown) for a in segments[s][2]}
        order = {k: n + 1 for n, k in enumerate(taken)}
        return [(key_[k], ids[k], why[k], score[k], order.get(k), *seen.get(place.get(k), (None, None, None))) for k in range(len(ids))]

    near = with_neighbours(good, pairs, key, conf.similarity_threshold).select(key, "idx", "t", (-c("score")).alias("_s"), "score", "duration", "cuts", "near")
    found = by_group(near, [key], ["_s", "t", "idx"], select, f"{key} {kind(near, key)}, {OUT}")
    gone = x.where("reason is not null").select(key, "idx", "reason").distinct()
    return found.unionByName(gone, allowMissingColumns=True)


def segments(chosen: DataFrame, key: str) -> DataFrame:
    """key, segment, start, end, anchors of what ``highlights`` gives."""
    return chosen.where("segment is not null").groupBy(key, "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list("idx")).alias("anchors"))
