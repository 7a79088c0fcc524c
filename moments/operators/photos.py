"""Photo sets: validation, uniform scores, distances within a set, complete-link groups and a selection that goes round the groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moments.functions.policies import photo_reason
from moments.functions.scalars import cosine_distance, isfinite, photo_quality
from moments.operators import blocks
from moments.operators.greedy import bounded, canonical_pairs, with_neighbours
from moments.operators.groups import by_group, kind

c = F.col


def vector_pairs(df: DataFrame, key: str, limit: float | None = None) -> DataFrame:
    """key, i < j, d: cosine distances within each set of key, idx, e, those up to limit if there is one.

    Missing, empty, zero and non-finite vectors, and those of another length, have no distance. A set is any size; its
    pairs are worked out block against block.
    """
    return blocks.all_pairs(df, key, limit)


def asked_distances(df: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """key, i, j, d of the pairs asked for (key, i, j), in that order, from vectors (key, idx, e); those without a distance go."""
    side = lambda name: df.select(key, c("idx").alias(name), c("e").alias(f"_{name}"))
    x = asked.select(key, "i", "j").distinct().where("i <> j").join(side("i"), [key, "i"]).join(side("j"), [key, "j"])
    return x.select(key, "i", "j", cosine_distance(c("_i"), c("_j")).alias("d")).where("d is not null")


def checked(photos: DataFrame, key: str) -> DataFrame:
    """Adds reason to key, idx, sharp, expo, px, aes: why a candidate is turned down, or null. All records of a repeated idx are."""
    copies = F.count(F.lit(1)).over(Window.partitionBy(key, "idx"))
    return photos.withColumn("reason", photo_reason(copies, c("idx"), c("sharp"), c("expo"), c("px"), c("aes")))


def scored(photos: DataFrame, key: str) -> DataFrame:
    """The eligible candidates with score. Aesthetics count only in sets where every eligible candidate has them."""
    w = Window.partitionBy(key)
    whole = F.min(c("aes").isNotNull()).over(w)
    x = checked(photos, key).where("reason is null").drop("reason")
    return x.withColumn("score", F.when(whole, photo_quality(c("sharp"), c("expo"), c("px"), c("aes"))).otherwise(photo_quality(c("sharp"), c("expo"), c("px"))))


def top_photos(photos: DataFrame, key: str, n: int) -> DataFrame:
    """The n best of each set by score, then idx; none for n <= 0."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "idx"))
    return photos.withColumn("_r", r).where(c("_r") <= n).drop("_r")


def recommended_count(scores: DataFrame, key: str) -> DataFrame:
    """key, n: half of those near the best score of a set, rounded down, one at least."""
    x = scores.withColumn("_b", F.max("score").over(Window.partitionBy(key)))
    near = F.count_if(c("score") >= c("_b") - F.greatest(0.1 * F.abs("_b"), F.lit(0.01)))
    return x.groupBy(key).agg(near.alias("_k")).select(key, F.greatest(F.lit(1), F.expr("_k div 2")).cast("long").alias("n"))


def complete_link(ranked: DataFrame, pairs: DataFrame, key: str, limit: float) -> DataFrame:
    """Adds grp and member (both from 1) to key, idx, rank.

    In rank order a candidate joins the first group all of whose members are known to be within limit, else it opens one.
    With a negative or non-finite limit each is a group of its own.
    """
    if not (np.isfinite(limit) and limit >= 0):
        return ranked.withColumns({"grp": c("rank").cast("int"), "member": F.lit(1)})

    def group(rows: list[tuple]) -> list[tuple]:
        at: dict = {}
        sizes: list[int] = []
        out = []
        for k, idx, _, near in bounded(rows):
            met: dict[int, int] = {}
            for o in near or ():
                if o in at:
                    met[at[o]] = met.get(at[o], 0) + 1
            g = min((g for g, n in met.items() if n == sizes[g]), default=len(sizes))
            if g == len(sizes):
                sizes.append(0)
            sizes[g] += 1
            at[idx] = g
            out.append((k, idx, g + 1, sizes[g]))
        return out

    x = with_neighbours(ranked.select(key, "idx", "rank"), pairs, key, limit).select(key, "idx", "rank", "near")
    found = by_group(x, [key], ["rank"], group, f"{key} {kind(x, key)}, idx {kind(x, 'idx')}, grp int, member int")
    return ranked.join(found, [key, "idx"])


def diverse(photos: DataFrame, distances: DataFrame | None, key: str, limit: float, n: int, vectors: DataFrame | None = None) -> DataFrame:
    """key, idx, reason, score, rank, grp, member, position, role, selected of every candidate.

    What is near is told by distances (key, i, j, d), and then a set is refused beyond MOST_IN_A_SET candidates, or without
    them by the cosine distances of vectors (key, idx, e), for sets of any size.

    Groups of near duplicates are formed in order of quality; the selection takes the best of each group, then the second
    of each, and so on; the first n are selected. What was turned down has a reason and nothing else, once for each idx.
    """
    x = scored(photos, key).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "idx")))
    x = x.select(key, "idx", "score", "rank")
    if distances is None and np.isfinite(limit) and limit >= 0:
        x = x.join(blocks.complete_link(x, vectors, key, limit), [key, "idx"])
    else:
        x = complete_link(x, None if distances is None else canonical_pairs(distances, key, x), key, limit)
    position = F.row_number().over(Window.partitionBy(key).orderBy("member", "grp"))
    x = x.withColumn("position", position).withColumn("selected", c("position") <= n)
    x = x.withColumn("role", F.when(c("selected"), F.when(c("member") == 1, "groupRepresentative").otherwise("extraGroupMember")))
    gone = checked(photos, key).where("reason is not null").select(key, "idx", "reason").distinct()
    return x.unionByName(gone, allowMissingColumns=True).select(key, "idx", "reason", "score", "rank", "grp", "member", "position", "role", F.coalesce("selected", F.lit(False)).alias("selected"))


def similar_pairs(queries: DataFrame, distances: DataFrame, key: str, limit: float, order: str) -> DataFrame:
    """Adds similar to key, i, j: whether the two alone would leave one representative, that is whether their last known distance is within limit."""
    d = canonical_pairs(distances, key, None, "last", order)
    x = queries.withColumns({"_a": F.least("i", "j"), "_b": F.greatest("i", "j")})
    x = x.join(d.select(key, c("i").alias("_a"), c("j").alias("_b"), "d"), [key, "_a", "_b"], "left")
    return x.withColumn("similar", F.coalesce((c("d") <= limit) & F.lit(limit >= 0), F.lit(False))).drop("_a", "_b", "d")


def reference_search(items: DataFrame, reference: DataFrame, key: str, distance, limit: int) -> DataFrame:
    """key, idx, d, n: the candidates nearest to the reference of their set (key, q), and how many could be compared. limit is 1 to 200."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1 and 200")
    x = items.join(reference, key).withColumn("d", distance).where(isfinite(c("d")))
    r = F.row_number().over(Window.partitionBy(key).orderBy("d", "idx"))
    return x.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy(key)), "_r": r}).where(c("_r") <= limit).select(key, "idx", "d", "n")


def representative_frames(frames: DataFrame, key: str) -> DataFrame:
    """One frame a clip of key, ordinal, baseline, sharp, distance (null: time unknown).

    The baseline stays unless an extra frame is sharper and not farther from the anchor; without a baseline the sharpest
    extra one is taken. Of equal ones the first counts.
    """
    w = Window.partitionBy(key)
    base = F.max(F.when(c("baseline"), F.struct("distance", "sharp"))).over(w)
    x = frames.withColumn("_b", base)
    better = (c("distance") <= c("_b")["distance"]) & (c("sharp") > c("_b")["sharp"])
    fits = c("baseline") | c("_b").isNull() | F.coalesce(better, F.lit(False))
    order = [F.asc("baseline"), F.desc("sharp"), F.asc("ordinal")]
    return x.where(fits).withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_b", "_r")
