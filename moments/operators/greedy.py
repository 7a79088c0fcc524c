"""Greedy selections in a fixed order.

Where a recording has a gap as wide as the rule's reach, what comes after doesn't depend on what was before. So each
recording is cut there first, and a fold sees one stretch of neighbours, not the whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moments.operators.groups import by_group, kind

#: Candidates of one set, as many as a selection takes; a larger set is refused rather than cut.
MOST_IN_A_SET = 2000


def stretches(df: DataFrame, key: str, reach: float, t: str = "t", name: str = "_s", closed: bool = False) -> DataFrame:
    """Numbers the stretches of each key in which neighbours are nearer than reach, or with ``closed`` as near at most."""
    w = Window.partitionBy(key).orderBy(t)
    gap = F.col(t) - F.lag(t).over(w)
    new = F.coalesce((gap > reach if closed else gap >= reach).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def temporal_nms(df: DataFrame, key: str, spacing: float, limit: int | None = None) -> DataFrame:
    """key, t, score, id: by score, an item goes if a kept one of its source is nearer than spacing; then the best ``limit`` of all."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("t").alias("t"), F.col("id").alias("id"))))
    free = lambda kept, x: ~F.exists(kept, lambda y: F.abs(y["t"] - x["t"]) < spacing)
    fold = F.aggregate("items", F.slice("items", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    kept = stretches(df, key, spacing).groupBy(key, "_s").agg(order.alias("items")).select(key, F.explode(fold).alias("x"))
    out = kept.select(key, F.col("x.t").alias("t"), (-F.col("x.s")).alias("score"), F.col("x.id").alias("id"))
    return out if limit is None else out.orderBy(F.desc("score"), key, "t", "id").limit(limit)


def refractory(df: DataFrame, key: str, gap: float) -> DataFrame:
    """key, t, id: in time, an item stays if it is at least gap after the last that stayed."""
    order = F.sort_array(F.collect_list(F.struct("t", "id")))
    free = lambda kept, x: (F.size(kept) == 0) | (x["t"] - F.get(kept, F.size(kept) - 1)["t"] >= gap)
    fold = F.aggregate("items", F.slice("items", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    kept = stretches(df, key, gap).groupBy(key, "_s").agg(order.alias("items")).select(key, F.explode(fold).alias("x"))
    return kept.select(key, "x.t", "x.id")


def evenly(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """Of the ordered rows those at positions i * (n - 1) // (limit - 1); all if there are no more than limit.

    The order is over all rows, of which the first column must be a number in rising order.
    """
    from moments.operators.ranking import numbered

    n = df.count()
    if n <= limit or limit <= 0:
        return df if limit > 0 else df.limit(0)
    wanted = sorted({0 if limit == 1 else i * (n - 1) // (limit - 1) for i in range(limit)})
    ranked = numbered(df, "_r", *order).withColumn("_r", F.col("_r") - 1)
    return ranked.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in wanted], "_r long")), "_r").drop("_r")


def anchored_merge(df: DataFrame, key: str, gap: float, loudest: bool) -> DataFrame:
    """key, t, level: items nearer than gap to the representative of the last cluster join it; ``loudest``: the louder one represents it."""
    order = F.sort_array(F.collect_list(F.struct("t", "level")))
    empty = F.slice(F.transform("items", lambda x: F.struct(x["t"].alias("t"), x["level"].alias("level"), F.lit(1).alias("n"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last, new = F.get(acc, F.size(acc) - 1), F.struct(x["t"].alias("t"), x["level"].alias("level"), F.lit(1).alias("n"))
        louder = (x["level"] > last["level"]) & F.lit(loudest)
        joined = F.struct(F.when(louder, x["t"]).otherwise(last["t"]).alias("t"), F.greatest(x["level"], last["level"]).alias("level"), (last["n"] + 1).alias("n"))
        near = (F.size(acc) > 0) & (x["t"] - last["t"] < gap)
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    merged = stretches(df, key, gap).groupBy(key, "_s").agg(order.alias("items")).select(key, F.explode(F.aggregate("items", empty, step)).alias("x"))
    return merged.select(key, "x.t", "x.level", "x.n")


def canonical_pairs(distances: DataFrame, key: str, candidates: DataFrame | None = None, rule: str = "max", order: str | None = None) -> DataFrame:
    """key, i < j, d of key, i, j, d in any order and number: of several records of a pair the largest distance, or with ``last`` the last one, counts.

    Records of a thing with itself, with null, negative or NaN distances (with ``max`` infinite ones too), and with things that aren't candidates, go.
    """
    x = distances.select(key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d", *([order] if order else [])).where("i <> j and d >= 0 and not isnan(d)")
    if rule == "max":
        x = x.where(F.col("d") < float("inf")).groupBy(key, "i", "j").agg(F.max("d").alias("d"))
    else:
        x = x.groupBy(key, "i", "j").agg(F.max(F.struct(order, "d")).alias("x")).select(key, "i", "j", F.col("x.d").alias("d"))
    if candidates is not None:
        ids = candidates.select(key, "idx").distinct()
        for side in ("i", "j"):
            x = x.join(ids.withColumnRenamed("idx", side), [key, side], "left_semi")
    return x.select(key, "i", "j", "d")


def with_neighbours(candidates: DataFrame, pairs: DataFrame, key: str, limit: float) -> DataFrame:
    """Adds near: the idx of those within limit, from canonical pairs. Pairs farther apart are dropped before anything is grouped."""
    close = pairs.where(F.col("d") <= limit)
    both = close.select(key, F.col("i").alias("idx"), F.col("j").alias("o")).unionByName(close.select(key, F.col("j").alias("idx"), F.col("i").alias("o")))
    return candidates.join(both.groupBy(key, "idx").agg(F.collect_list("o").alias("near")), [key, "idx"], "left")


def bounded(rows):
    if len(rows) > MOST_IN_A_SET:
        raise ValueError(f"a set has {len(rows)} candidates, more than {MOST_IN_A_SET}")
    return rows


def leader_clusters(candidates: DataFrame, pairs: DataFrame, key: str, limit: float, order: str = "idx") -> DataFrame:
    """key, idx, quality of the representatives of each set.

    In input order (``order``) a candidate joins the first representative within limit, and takes its place if its quality
    is higher; earlier members aren't looked at again. With a negative limit all stay. A set is one selection and is refused
    beyond MOST_IN_A_SET candidates.
    """
    if limit < 0:
        return candidates.select(key, "idx", "quality")

    def lead(rows: list[tuple]) -> list[tuple]:
        leaders: list[tuple] = []
        for row in bounded(rows):
            near = set(row[4] or ())
            at = next((p for p, r in enumerate(leaders) if r[1] in near), None)
            if at is None:
                leaders.append(row)
            elif row[2] > leaders[at][2]:
                leaders[at] = row
        return [r[:3] for r in leaders]

    x = with_neighbours(candidates.select(key, "idx", F.col("quality").cast("double").alias("quality"), F.col(order).alias("o")), pairs, key, limit).select(key, "idx", "quality", "o", "near")
    return by_group(x, [key], ["o", "idx"], lead, f"{key} {kind(x, key)}, idx {kind(x, 'idx')}, quality double")
