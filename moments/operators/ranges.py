"""Joins on time: ranges are cut into buckets as wide as the reach, so that they become equi-joins and scale with their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moments.operators.groups import many


def band_join(left: DataFrame, right: DataFrame, key: str, reach: float, how: str = "inner", condition=None) -> DataFrame:
    """left (key, t, ...) with right (key, u, ...) where |t - u| <= reach: each right row goes into three buckets, each left row into one."""
    l = left.withColumn("_b", F.floor(F.col("t") / reach))  # noqa: E741
    r = right.withColumn("_c", F.explode(F.sequence(F.floor(F.col("u") / reach) - 1, F.floor(F.col("u") / reach) + 1))).withColumnRenamed(key, "_k")
    on = (l[key] == r["_k"]) & (l["_b"] == r["_c"]) & (F.abs(l["t"] - r["u"]) <= reach)
    return l.join(r, on if condition is None else on & condition, how).drop("_b", "_c", "_k")


def band_max(left: DataFrame, right: DataFrame, key: str, reach: float, default: float) -> DataFrame:
    """Adds peak: the greatest value of right (key, u, value) within reach, or the default."""
    top = band_join(left.select(key, "t").distinct(), right, key, reach).groupBy(key, "t").agg(F.max("value").alias("peak"))
    return left.join(top, [key, "t"], "left").withColumn("peak", F.coalesce("peak", F.lit(default)))


def contained(points: DataFrame, intervals: DataFrame, key: str, width: float, how: str = "inner") -> DataFrame:
    """points (key, t, ...) with intervals (key, start, end, ...) that hold them, ends included.

    An interval goes into each bucket of ``width`` that it touches, so choose a width near the usual length.
    """
    p = points.withColumn("_b", F.floor(F.col("t") / width))
    i = intervals.where("start <= end").withColumn("_c", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))).withColumnRenamed(key, "_k")
    return p.join(i, (p[key] == i["_k"]) & (p["_b"] == i["_c"]) & p["t"].between(i["start"], i["end"]), how).drop("_b", "_c", "_k")


def _beside(left: DataFrame, right: DataFrame, key: str, names: list[str], at: Column, left_first: bool) -> tuple[DataFrame, Column]:
    """The union of both sides, right rows wrapped into _r, and the order in which left rows come before or after right rows of the same _at.

    It is in so many parts that a task sorts few rows, as both sides stand in it whole.
    """
    l = left.withColumn("_at", at)  # noqa: E741
    r = right.select(key, F.col("u").alias("_at"), F.struct("u", *[n for n in names if n != "u"]).alias("_r"))
    return l.unionByName(r, allowMissingColumns=True).repartition(many(l), key), (F.col("_r").isNotNull() if left_first else F.col("_r").isNull())


def forward_asof(left: DataFrame, right: DataFrame, key: str, lead: float = 0.0, inclusive: bool = False, values: list[str] | None = None) -> DataFrame:
    """Adds next_u, and next_<name> of ``values``: of the first right row (key, u, ...) with u > t + lead, or >= if inclusive.

    One sort of the union, no pairs. Of right rows with equal u that of the least values counts.
    """
    names = ["u", *(values or [])]
    both, side = _beside(left, right, key, names, F.col("t") + lead, not inclusive)
    w = Window.partitionBy(key).orderBy(F.col("_at").desc(), side, F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_n", F.last("_r", True).over(w)).where("_r is null")
    return x.withColumns({f"next_{n}": F.col("_n")[n] for n in names}).drop("_at", "_r", "_n")


def backward_asof(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Adds value of the last right row (key, u, value) with u <= t, null if that row's value is; of equal u the greatest value counts."""
    names = ["u", value]
    both, side = _beside(left, right, key, names, F.col("t"), False)
    w = Window.partitionBy(key).orderBy("_at", side, F.col("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_n", F.last("_r", True).over(w)).where("_r is null").withColumn(value, F.col("_n")[value]).drop("_at", "_r", "_n")


def nearest(left: DataFrame, right: DataFrame, key: str, values: list[str] | None = None) -> DataFrame:
    """Adds near_u, and near_<name> of ``values``: of the right row (key, u, ...) nearest to t; of two as near the later one."""
    names = ["u", *(values or [])]
    after = forward_asof(left, right, key, 0.0, True, values).withColumn("_a", F.struct(*[F.col(f"next_{n}").alias(n) for n in names])).drop(*[f"next_{n}" for n in names])
    both, side = _beside(after, right, key, names, F.col("t"), True)
    w = Window.partitionBy(key).orderBy("_at", side, F.col("_r")).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_p", F.last("_r", True).over(w)).where("_r is null")
    later = F.col("_p").isNull() | (F.col("_a")["u"] - F.col("t") <= F.col("t") - F.col("_p")["u"])
    pick = F.when(later, F.col("_a")).otherwise(F.col("_p"))
    return x.withColumns({f"near_{n}": pick[n] for n in names}).drop("_at", "_r", "_p", "_a")


def cut_list(cuts: Column, end: Column) -> Column:
    """The finite cuts inside (0, end), distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(cuts, lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < end))))


def shot_bounds(cuts: Column, t: Column, end: Column) -> tuple[Column, Column]:
    """Start and end of the shot [start, end) of a cut list that holds t."""
    return F.coalesce(F.array_max(F.filter(cuts, lambda c: c <= t)), F.lit(0.0)), F.coalesce(F.array_min(F.filter(cuts, lambda c: c > t)), end)
