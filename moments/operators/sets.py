"""Unions, differences and orders of candidate lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def union_candidates(*parts: DataFrame) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of each ``by``: the first in the order, which should leave no ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def ordered_union(id: str, *parts: DataFrame) -> DataFrame:
    """Parts (id, pos, ...) one after the other, each id where it comes first; ``part`` and ``pos`` give the order of the queue."""
    return keep_first(union_candidates(*[p.withColumn("part", F.lit(n)) for n, p in enumerate(parts)]), [id], c("part"), c("pos"))


def queue_rank(df: DataFrame, part: str = "part", pos: str = "pos", block: int = 10_000, name: str = "queue_rank") -> DataFrame:
    """Numbers all rows from 1 in order of part and pos (unique together), without sorting them in one task.

    Rows are numbered within blocks of positions; a row's number is that plus the sizes of the blocks before.
    """
    x = df.withColumn("_b", F.floor(c(pos) / block))
    sizes = x.groupBy(part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy(part, "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(part, "_b").orderBy(pos))
    return x.withColumn("_i", inside).join(before, [part, "_b"]).withColumn(name, c("_o") + c("_i")).drop("_b", "_i", "_o")


def exclude_repeated(df: DataFrame, *by: str) -> DataFrame:
    """Rows whose ``by`` is theirs alone; all copies of a repeated one go."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("_n = 1").drop("_n")


def with_fallback(df: DataFrame, group: str) -> DataFrame:
    """position of rows (group, id, expert, semantic): those with an expert score by it, then those with a semantic one only; others go."""
    x = df.where("expert is not null or semantic is not null")
    order = [c("expert").isNull(), F.desc("expert"), F.when(c("expert").isNull(), c("semantic")).desc(), F.asc("id")]
    return x.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def merged_scores(static: DataFrame, full: DataFrame, short: DataFrame) -> DataFrame:
    """id, positive, grp, expert, full, short of three tables (id, positive, grp, expert, semantic) of the same rows.

    A row that isn't in all three, or differs in what it shares, is an error that stops the query.
    """
    same = ["positive", "grp", "expert"]
    side = lambda df, name: df.select("id", *[c(n).alias(f"{n}_{name}") for n in same], c("semantic").alias(name), F.lit(True).alias(f"in_{name}"))
    x = static.select("id", *same, F.lit(True).alias("in_static")).join(side(full, "full"), "id", "full").join(side(short, "short"), "id", "full")
    alike = c("in_static").eqNullSafe(True)
    for n in same:
        alike = alike & c(n).eqNullSafe(c(f"{n}_full")) & c(n).eqNullSafe(c(f"{n}_short"))
    alike = alike & c("in_full").eqNullSafe(True) & c("in_short").eqNullSafe(True)
    checked = F.when(alike, c("id")).otherwise(F.raise_error(F.concat(F.lit("the inputs differ at "), c("id").cast("string"))).cast(x.schema["id"].dataType))
    return x.select(checked.alias("id"), *same, "full", "short")


def refinement_times(anchors: DataFrame, key: str, offsets: tuple[float, ...], duration: Column, sampled: DataFrame, budget: int) -> DataFrame:
    """key, t of extra moments around anchors (key, rank, t): those within the duration that aren't sampled (key, t) yet, the first ``budget`` in order of anchor and offset.

    Moments are told apart at two decimals; of repeated ones the first counts.
    """
    x = anchors.select(key, "rank", F.posexplode(F.array(*[F.bround(c("t") + F.lit(o), 2) for o in offsets])).alias("o", "t")).where((c("t") >= 0) & (c("t") < duration))
    x = x.join(sampled.select(key, F.bround("t", 2).alias("t")).distinct(), [key, "t"], "left_anti")
    x = keep_first(x, [key, "t"], c("rank"), c("o"))
    return x.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank", "o"))).where(c("n") <= budget).select(key, "n", "t")


def refinement_anchors(frames: DataFrame, key: str, budget: int, weight: float, per_anchor: int = 10) -> DataFrame:
    """The best max(1, budget // per_anchor) good frames of (key, ordinal, status, sharp, expo, imp), as rank; importance counts where all good frames have it."""
    ok = frames.where("status = 'ok'")
    whole = F.min(c("imp").isNotNull() & c("imp").between(0, 1)).over(Window.partitionBy(key))
    base = c("sharp") * c("expo")
    score = F.when(whole, (1.0 - weight) * base + weight * c("imp")).otherwise(base)
    x = ok.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ordinal")))
    return x.where(c("rank") <= (max(1, budget // per_anchor) if budget > 0 else 0))
