"""Arrays in, numbers or arrays out. All but the warped distances are column expressions; those are Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from moments.functions.scalars import dot, mean_absolute, sigmoid


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double"))


def some_total(xs: Column) -> Column:
    """The sum, null without any numbers."""
    return F.when(F.size(xs) > 0, total(xs))


def perceptual_distance(tiles_a: Column, hist_a: Column, tiles_b: Column, hist_b: Column) -> Column:
    """0.6 of the mean difference of tiles and 0.4 of half the difference of histograms, within 0 and 1."""
    apart = total(F.zip_with(hist_a, hist_b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / 2
    return clamp(0.6 * mean_absolute(tiles_a, tiles_b) + 0.4 * apart)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference within 0 and 1; null for missing, empty or unequal arrays."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), clamp(mean_absolute(a, b)))


def region(grid: Column, width: int, height: int, box: tuple[float, float, float, float] = (0.25, 0.75, 0.40, 0.95)) -> Column:
    """The part of a row-major grid inside a box of shares (left, right, top, bottom); sides are rounded half to even."""
    x0, x1, y0, y1 = round(box[0] * width), round(box[1] * width), round(box[2] * height), round(box[3] * height)
    x1, y1 = min(max(x1, x0 + 1), width), min(max(y1, y0 + 1), height)
    return F.flatten(F.array(*[F.slice(grid, y * width + x0 + 1, x1 - x0) for y in range(y0, y1)]))


def prompt_score(picture: Column, prompt: Column, scale: float, bias: float) -> Column:
    """cosine, logit and score of a picture against a prompt, both of unit length."""
    cosine = clamp(dot(picture, prompt), -1.0, 1.0)
    logit = cosine * scale + bias
    return F.struct(cosine.alias("cosine"), logit.alias("logit"), clamp(sigmoid(logit)).alias("score"))


def softmax(xs: Column) -> Column:
    raised = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(raised, lambda x: x / total(raised))


def shifted_distance(a: Column, b: Column, distance, shifts: int = 1) -> Column:
    """The least mean distance of two sequences over small shifts, of the places that both have; null without any."""

    def at(shift: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i + shift >= 1) & (i + shift <= F.size(b)))
        return total(F.transform(places, lambda i: distance(F.get(a, i - 1), F.get(b, i + shift - 1)))) / F.when(F.size(places) > 0, F.size(places))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_min(F.array_compact(F.array(*[at(F.lit(s)) for s in range(-shifts, shifts + 1)]))))


def warped(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Warped distances of many pairs of paths at once, a row each, over the sum of the lengths."""
    rows, n = ax.shape
    m = bx.shape[1]
    before = np.full((rows, m + 1), np.inf)
    before[:, 0] = 0
    for i in range(n):
        now = np.full((rows, m + 1), np.inf)
        for j in range(m):
            step = np.hypot(ax[:, i] - bx[:, j], ay[:, i] - by[:, j])
            now[:, j + 1] = step + np.minimum(np.minimum(before[:, j + 1], now[:, j]), before[:, j])
        before = now
    return before[:, m] / (n + m)


@F.pandas_udf(DoubleType())
def warped_distance(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    """Dynamic time warping of two paths (x and y arrays each); infinite where one is empty, null where one is missing."""
    out = np.full(len(ax), np.nan)
    sizes = [(-1, -1) if a is None or b is None else (len(a), len(b)) for a, b in zip(ax, bx, strict=True)]
    for size in set(sizes):
        at = [k for k, s in enumerate(sizes) if s == size]
        if size[0] > 0 and size[1] > 0:
            out[at] = warped(*(np.stack(v.iloc[at].tolist()).astype(float) for v in (ax, ay, bx, by)))
        elif size[0] >= 0:
            out[at] = np.inf
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def audio_blocks(samples, key: str, order: str, value: str, size: int = 1024):
    """key, block, count, rms, peak, crossings of 16-bit samples (key, position from 0, value). Signs are compared across the edges of blocks."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    crossed = F.coalesce((before >= 0) != (F.col(value) >= 0), F.lit(False)).cast("int")
    x = samples.select(key, F.floor(F.col(order) / size).alias("block"), (F.col(value) / 32768.0).alias("_v"), crossed.alias("_c"))
    return x.groupBy(key, "block").agg(F.count(F.lit(1)).alias("count"), F.sqrt(F.sum(F.col("_v") * F.col("_v")) / F.count(F.lit(1))).alias("rms"), F.max(F.abs("_v")).alias("peak"), F.sum("_c").alias("crossings"))
