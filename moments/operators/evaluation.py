"""Measures of selections against labels: pairs, preferences, events, totals of runs, and checks of the data they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moments.operators.matching import event_edges, maximum_matching
from moments.operators.ranges import contained

c = F.col


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def per_index(df: DataFrame, key: str, array: str) -> DataFrame:
    """key, k (from 0), mean, high, low of the numbers at each place of the arrays; nulls don't count, and places with nothing else drop out."""
    x = df.select(key, F.posexplode(array).alias("k", "v")).where("v is not null")
    return x.groupBy(key, "k").agg(F.avg("v").alias("mean"), F.max("v").alias("high"), F.min("v").alias("low"))


def pair_outcomes(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Adds outcome to labelled pairs (keys, i, j, label): unknown, missing, or tp, fp, fn, tn by the prediction (keys, i, j, similar)."""
    ordered = lambda df, *more: df.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *more)
    x = ordered(truth, "label").join(ordered(predicted, "similar"), [*keys, "i", "j"], "left")
    return x.withColumn("outcome", outcome(c("label"), c("similar")))


def outcome(label: Column, similar: Column) -> Column:
    """unknown, missing (nothing predicted), or tp, fp, fn, tn."""
    hit = F.when(label == "similar", F.when(similar, "tp").otherwise("fn")).otherwise(F.when(similar, "fp").otherwise("tn"))
    return F.when(label == "unknown", "unknown").when(similar.isNull(), "missing").otherwise(hit)


def _rates(df: DataFrame) -> DataFrame:
    x = df.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn"))})
    known = c("tp") + c("fp") + c("tn") + c("fn")
    return x.withColumns({"f1": ratio(2.0 * c("precision") * c("recall"), c("precision") + c("recall")), "coverage": ratio(known, known + c("missing"))})


def pair_metrics(outcomes: DataFrame, *by: str, n: Column | None = None) -> DataFrame:
    """by, pairs, tp, fp, tn, fn, unknown, missing, precision, recall, f1, coverage; a rate without anything to divide by is null. A row stands for ``n`` pairs."""
    n = F.lit(1) if n is None else n
    count = [F.sum(F.when(c("outcome") == k, n).otherwise(0)).alias(k) for k in ("tp", "fp", "tn", "fn", "unknown", "missing")]
    return _rates(outcomes.groupBy(*by).agg(F.sum(n).alias("pairs"), *count))


def preference_metrics(preferences: DataFrame, groups: DataFrame, *by: str) -> DataFrame:
    """by, total, evaluable, wins, losses, rate of preferences (by, preferred, other) against groups (by, idx, representative).

    Only preferences within one group count, and of those the ones whose either side is the representative.
    """
    side = lambda name: groups.select(*by, c("idx").alias(name), c("representative").alias(f"_{name}"))
    x = preferences.join(side("preferred"), [*by, "preferred"], "left").join(side("other"), [*by, "other"], "left")
    same = c("_preferred") == c("_other")
    win, loss = F.count_if(same & (c("preferred") == c("_preferred"))), F.count_if(same & (c("other") == c("_other")))
    x = x.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), win.alias("wins"), loss.alias("losses"))
    return x.withColumn("evaluable", c("wins") + c("losses")).withColumn("rate", ratio(c("wins"), c("evaluable")))


def event_counters(predictions: DataFrame, events: DataFrame, coverage: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, selected, positives, negatives, tp, duplicate_fp, negative_fp, coverage_fp, unknown, precision, recall, known_share.

    A prediction that isn't matched counts once: as a duplicate if it meets a positive event, else as false if it meets a
    negative one, else as false if labels cover its time, else as unknown. Cases are those with predictions or events.
    """
    edges = event_edges(predictions, events, key, tolerance)
    matched = maximum_matching(predictions, events, key, tolerance, edges).select(key, "pid", F.lit(True).alias("hit"))
    met = edges.groupBy(key, "pid").agg(F.bool_or(c("label") == "positive").alias("pos"), F.bool_or(c("label") == "negative").alias("neg"))
    covered = contained(predictions.select(key, "pid", "t"), coverage.select(key, "start", "end"), key, 8.0, "left_semi").select(key, "pid", F.lit(True).alias("cov"))
    x = predictions.select(key, "pid").join(matched, [key, "pid"], "left").join(met, [key, "pid"], "left").join(covered, [key, "pid"], "left")
    kind = F.when(c("hit"), "tp").when(c("pos"), "duplicate_fp").when(c("neg"), "negative_fp").when(c("cov"), "coverage_fp").otherwise("unknown")
    kinds = ("tp", "duplicate_fp", "negative_fp", "coverage_fp", "unknown")
    counted = x.withColumn("kind", kind).groupBy(key).agg(F.count(F.lit(1)).alias("selected"), *[F.count_if(c("kind") == k).alias(k) for k in kinds])
    truth = events.groupBy(key).agg(F.count_if(c("label") == "positive").alias("positives"), F.count_if(c("label") == "negative").alias("negatives"))
    return event_rates(counted.join(truth, key, "full").na.fill(0))


def event_rates(df: DataFrame) -> DataFrame:
    false = c("duplicate_fp") + c("negative_fp") + c("coverage_fp")
    return df.withColumns({"precision": ratio(c("tp"), c("tp") + false), "recall": ratio(c("tp"), c("positives")), "known_share": ratio(c("tp") + false, c("selected"))})


def totals(cases: DataFrame, counters: list[str], by: tuple[str, ...] = ("split", "mode", "run", "scope")) -> DataFrame:
    """by, cases, the sums of the counters, measured, seconds, mean_seconds (of measured cases only), note where the scope isn't known."""
    x = cases.withColumn("scope", F.coalesce("scope", F.lit("unspecified")))
    x = x.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[F.sum(n).alias(n) for n in counters], F.count("elapsed").alias("measured"), F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("seconds"))
    return x.withColumns({"mean_seconds": ratio(c("seconds"), c("measured")), "note": F.when(c("scope") == "unspecified", "fairness not verified")})


def pair_totals(cases: DataFrame) -> DataFrame:
    return _rates(totals(cases, ["pairs", "tp", "fp", "tn", "fn", "unknown", "missing"]))


def leaks(cases: DataFrame) -> DataFrame:
    """kind and id of the sources and sessions that are in both splits."""
    x = cases.select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("id")) for k in ("source", "session")])).alias("x")).select("split", "x.*")
    return x.groupBy("kind", "id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("kind", "id")


def inconsistent_runs(runs: DataFrame) -> DataFrame:
    """run of those whose version, variant or scope isn't the same everywhere."""
    same = F.struct("version", "variant", F.coalesce("scope", F.lit("unspecified")))
    return runs.groupBy("run").agg(F.count_distinct(same).alias("n")).where("n > 1").select("run")


def refuse(found: DataFrame, what: str) -> None:
    """Raises if there is any row, naming up to ten."""
    if some := found.limit(10).collect():
        raise ValueError(f"{what}: " + ", ".join(str(tuple(r)) for r in some))


def field_summary(df: DataFrame, fields: list[str], label: str) -> DataFrame:
    """field, label, n, low, high, mean, median (of the middle two) of the numbers of each field."""
    x = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c(f).cast("double").alias("v")) for f in fields])).alias("x")).select(label, "x.*")
    return x.groupBy("field", label).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.median("v").alias("median"))


def clip_aggregates(frames: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and the mean, least and greatest of each field."""
    return frames.groupBy(key).agg(*[f(n).alias(f"{n}_{a}") for n in fields for a, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def adjacent_differences(frames: DataFrame, key: str, order: str, ok: Column, fields: list[str]) -> DataFrame:
    """key, order, before and |change| of each field between one good frame and the good one before it."""
    w = Window.partitionBy(key).orderBy(order)
    x = frames.where(ok).withColumns({"before": F.lag(order).over(w), **{f"{n}_change": F.abs(c(n) - F.lag(n).over(w)) for n in fields}})
    return x.where("before is not null").select(key, order, "before", *[f"{n}_change" for n in fields])


def clip_status(frames: DataFrame, key: str, ok: Column, requested: int) -> DataFrame:
    """key, succeeded, failed, status: ok if all requested frames succeeded, partial if some did, else error."""
    x = frames.groupBy(key).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return x.withColumn("status", F.when(c("succeeded") == requested, "ok").when(c("succeeded") > 0, "partial").otherwise("error"))


def contribution_spread(frames: DataFrame, by: str) -> DataFrame:
    """by, quality, semantic, ratio, dominant: mean of 0.7 q and of 0.3 s, and how the first outweighs the second (infinite over next to nothing)."""
    x = frames.groupBy(by).agg(F.avg(0.7 * c("q")).alias("quality"), F.avg(0.3 * c("s")).alias("semantic"))
    return x.withColumn("ratio", F.when(c("semantic") > 1e-9, c("quality") / c("semantic")).otherwise(float("inf"))).withColumn("dominant", c("ratio") > 2.0)


def gap_scale(df: DataFrame, block: str, score: str, order: str) -> DataFrame:
    """One row: scale, the median of positive adjacent gaps of the scores within each block, over all blocks; 0 without any."""
    w = Window.partitionBy(block).orderBy(F.desc(score), order)
    gap = c(score) - F.lead(score).over(w)
    x = df.withColumn("_g", gap).where((c("_g") > 0) & (c("_g") < float("inf")))
    return x.agg(F.coalesce(F.median("_g"), F.lit(0.0)).alias("scale"))
