"""Ranks, rank fusion and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_rank(df: DataFrame, name: str, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Parts that one long list is numbered in.
PARTS = 64


def numbered(df: DataFrame, name: str, lead: Column, *rest: Column, by: tuple[str, ...] = (), part: Column | None = None) -> DataFrame:
    """Adds the number, from 1, of each row in the list of ``by`` (or of all rows) in order of lead, a number with nulls last, and rest.

    No task sorts a whole list: each is numbered in parts, and a row's number is that in its part plus the sizes of the parts
    before. ``part`` never falls as lead rises; without it parts lie between quantiles of lead, which are looked up at once.
    """
    x = df.withColumn("_l", lead.cast("double"))
    if part is None:
        cuts = sorted(set(x.approxQuantile("_l", [k / PARTS for k in range(1, PARTS)], 0.002)))
        # null comes last, as it does in the order
        part = F.when(F.col("_l").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(F.lit(cuts), lambda q: q < F.col("_l"))) if cuts else F.lit(0))
    x = x.withColumn("_q", part)
    sizes = x.groupBy(*by, "_q").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_q", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*by, "_q").orderBy(F.col("_l").asc_nulls_last(), *rest))
    return x.withColumn("_i", inside).join(F.broadcast(sizes), [*by, "_q"]).withColumn(name, F.col("_o") + F.col("_i")).drop("_l", "_q", "_i", "_o")


def fuse_ranks(df: DataFrame, group: str, alpha: float, k: int = 60, head: int = 0) -> DataFrame:
    """group, id, expert, semantic -> fused position. A group with a missing semantic score falls back to the expert's rank; the first ``head`` stay."""
    w = Window.partitionBy(group)
    x = add_rank(df, "r_e", [group], F.desc("expert"), F.col("id"))
    x = add_rank(x, "r_s", [group], F.desc(F.coalesce("semantic", F.lit(-1e9))), F.col("id"))
    whole = F.min(F.col("semantic").isNotNull()).over(w)
    x = x.withColumn("fused", F.when(whole, (1 - alpha) / (k + F.col("r_e")) + alpha / (k + F.col("r_s"))).otherwise(1 / (k + F.col("r_e"))))
    fixed = F.col("r_e") <= head
    return add_rank(x, "position", [group], F.desc(fixed), F.when(fixed, F.col("r_e")), F.desc("fused"), F.col("r_e"), F.col("id"))


def average_precision(df: DataFrame, group: str, top: int) -> DataFrame:
    """group, position, positive -> ap (null without positives), p_at (of at most as many as there are)."""
    w = Window.partitionBy(group).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("hit", F.col("positive").cast("int")).withColumn("prec", F.col("hit") * F.sum("hit").over(w) / F.col("position"))
    return x.groupBy(group).agg(
        (F.sum("prec") / F.when(F.sum("hit") > 0, F.sum("hit"))).alias("ap"),
        (F.sum(F.when(F.col("position") <= top, F.col("hit")).otherwise(0)) / F.least(F.lit(top), F.count(F.lit(1)))).alias("p_at"),
    )


def _places(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values in order within their group, with their place and how many there are: a sort that spills, no list in memory."""
    w = Window.partitionBy(group)
    return df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})


def _at(value: str, place: Column) -> Column:
    return F.max(F.when(F.col("_r") == place, F.col(value)))


def _between(value: str, at: Column, low: Column) -> Column:
    """The value at a place, counted from 1, that may lie between two; ``low`` is the lower one."""
    below, above = _at(value, low), _at(value, F.least(low + 1, F.col("_n")))
    return below + (F.max(at) - F.max(low)) * (above - below)


def summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, low, high, mean, p25, p50, p75 (linear between neighbours)."""
    quartiles = {}
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        at = q * (F.col("_n") - 1) + 1
        quartiles[name] = _between(value, at, F.floor(at))
    return _places(df, group, value).groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), *[x.alias(n) for n, x in quartiles.items()])


def exclusive_p90(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, p90: the ninth decile at place 0.9 (n + 1); null for fewer than two values."""
    at = 0.9 * (F.col("_n") + 1)
    low = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(at)))
    return _places(df, group, value).groupBy(group).agg(F.when(F.max("_n") >= 2, _between(value, at, low)).alias("p90"))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, m: the middle value, the upper of two."""
    return _places(df, group, value).groupBy(group).agg(_at(value, F.floor(F.col("_n") / 2) + 1).alias("m"))
