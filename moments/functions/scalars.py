"""Column functions: every one maps columns to a column and stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Per sensitivity: strong then distant floors, baseline multipliers, rise, crossing rate and crest factor.
THRESHOLD_NAMES = ("s_score", "s_base", "s_peak", "s_peak_base", "s_rise", "s_cross", "s_crest", "d_score", "d_base", "d_peak", "d_peak_base", "d_rise", "d_cross", "d_crest")
THRESHOLDS = {
    "noisy": (0.10, 2.7, 0.18, 4.2, 2.2, 0.07, 2.3, 0.065, 3.4, 0.12, 5.0, 3.0, 0.10, 3.5),
    "normal": (0.075, 2.3, 0.13, 3.5, 1.8, 0.05, 2.0, 0.045, 2.8, 0.09, 4.2, 2.4, 0.08, 3.0),
    "quiet": (0.055, 1.9, 0.095, 3.0, 1.55, 0.04, 1.7, 0.035, 2.3, 0.07, 3.4, 2.0, 0.065, 2.5),
}


def isfinite(x: Column) -> Column:
    """NaN compares as larger than infinity in Spark, so each guard has to say what finite means."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def impact_score(rms: Column, peak: Column, crossing: Column) -> Column:
    return F.least(F.lit(1.0), 0.55 * rms + 0.45 * peak + 0.35 * F.least(F.lit(1.0), 10 * crossing) * rms)


def effective_sensitivity(sensitivity: Column, baseline: Column) -> Column:
    return F.when(sensitivity != "automatic", sensitivity).when(baseline >= 0.026, "noisy").when(baseline <= 0.009, "quiet").otherwise("normal")


def thresholds(spark: SparkSession) -> DataFrame:
    """A dimension of three rows."""
    return spark.createDataFrame([(k, *v) for k, v in THRESHOLDS.items()], "effective string, " + ", ".join(f"{n} double" for n in THRESHOLD_NAMES))


def detect_impact(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds is_triggered and confidence to rows of rms, peak, crossing, baseline, recent, sensitivity."""
    c = F.col
    x = df.withColumn("score", impact_score(c("rms"), c("peak"), c("crossing"))).withColumn("effective", effective_sensitivity(c("sensitivity"), c("baseline")))
    x = x.withColumn("rise", c("score") / F.greatest(F.lit(0.003), c("baseline"), 0.82 * c("recent"))).withColumn("crest", c("peak") / F.greatest(F.lit(0.001), c("rms")))
    x = x.join(F.broadcast(dim), "effective")

    def strong(p: str) -> Column:
        return (
            (c("score") >= F.greatest(c(f"{p}_score"), c("baseline") * c(f"{p}_base")))
            & (c("peak") >= F.greatest(c(f"{p}_peak"), c("baseline") * c(f"{p}_peak_base")))
            & (c("rise") >= c(f"{p}_rise"))
            & (c("crossing") >= c(f"{p}_cross"))
            & (c("crest") >= c(f"{p}_crest"))
        )

    speech = (c("rms") >= 0.025) & (c("crest") < 3.15) & (c("crossing") < 0.16) & (c("rise") < 4.8) & (c("score") < 0.18)
    ratio = lambda v, n: c(v) / F.greatest(F.lit(0.001), c(n))
    sure = 0.28 * ratio("score", "d_score") + 0.22 * ratio("peak", "d_peak") + 0.24 * ratio("rise", "d_rise") + 0.13 * F.least(ratio("crossing", "d_cross"), F.lit(1.8)) + 0.13 * F.least(ratio("crest", "d_crest"), F.lit(1.8))
    return x.withColumn("is_triggered", ~speech & (strong("s") | strong("d"))).withColumn("confidence", F.when(speech, 0.0).otherwise(sure))


def detect_one(rms: float, peak: float, crossing: float, baseline: float, recent: float, sensitivity: str = "automatic") -> tuple[float, bool, float]:
    """score, triggered and confidence of one window, as ``detect_impact`` gives for rows; for machines that keep their own levels."""
    score = min(1.0, 0.55 * rms + 0.45 * peak + 0.35 * min(1.0, 10 * crossing) * rms)
    if sensitivity == "automatic":
        sensitivity = "noisy" if baseline >= 0.026 else "quiet" if baseline <= 0.009 else "normal"
    th = dict(zip(THRESHOLD_NAMES, THRESHOLDS[sensitivity], strict=True))
    rise, crest = score / max(0.003, baseline, 0.82 * recent), peak / max(0.001, rms)
    if rms >= 0.025 and crest < 3.15 and crossing < 0.16 and rise < 4.8 and score < 0.18:
        return score, False, 0.0

    def strong(p: str) -> bool:
        loud = score >= max(th[f"{p}_score"], baseline * th[f"{p}_base"]) and peak >= max(th[f"{p}_peak"], baseline * th[f"{p}_peak_base"])
        return loud and rise >= th[f"{p}_rise"] and crossing >= th[f"{p}_cross"] and crest >= th[f"{p}_crest"]

    ratio = lambda v, n: v / max(0.001, th[n])
    sure = 0.28 * ratio(score, "d_score") + 0.22 * ratio(peak, "d_peak") + 0.24 * ratio(rise, "d_rise") + 0.13 * min(ratio(crossing, "d_cross"), 1.8) + 0.13 * min(ratio(crest, "d_crest"), 1.8)
    return score, strong("s") or strong("d"), sure


def photo_quality(sharpness: Column, exposure: Column, pixels: Column, aesthetics: Column | None = None) -> Column:
    base = 0.4 * sharpness + 0.2 * exposure + F.ln(pixels.cast("double")) / 100
    return base if aesthetics is None else F.coalesce(0.4 * base + 0.6 * aesthetics, base)


def similarity_quality(sharpness: Column, pixels: Column) -> Column:
    return sharpness + F.ln(F.greatest(F.lit(1), pixels).cast("double")) / 100


def ramp(x: Column, low: float, width: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / width))


def stroke_score(range_x: Column, core: Column, ratio: Column, reversals: Column, path: Column) -> Column:
    return (
        0.28 * ramp(range_x, 0.035, 0.20)
        + 0.17 * ramp(-range_x, -0.34, 0.25)
        + 0.23 * ramp(-core, -0.27, 0.18)
        + 0.14 * ramp(-ratio, -1.25, 0.90)
        + 0.14 * F.least(F.lit(1.0), reversals / 2.0)
        + 0.04 * ramp(path, 0.05, 0.75)
    )


def composite_score(pose: Column, db: Column, roi: Column) -> Column:
    return 0.7 * pose + 0.2 * F.exp(-F.pow((db + 12) / 10, 2)) + F.when(roi == 0, 0.0).otherwise(0.1 * F.exp(-F.pow((roi - 9.5) / 5, 2)))


def rotation(degrees: Column) -> Column:
    r = F.pmod(degrees, F.lit(360))
    return F.when(r.isin(0, 90, 180, 270), r).otherwise(0)


def source_rotation(side: Column, tag: Column) -> Column:
    """Clockwise turn of a picture: the display matrix counts the other way and goes before the tag; null and odd angles are 0."""
    return F.coalesce(rotation(F.coalesce(-side, tag)), F.lit(0))


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def triage(db: Column, motion: Column) -> Column:
    return (db >= -3) | (motion >= 18)


def sequence_prior(gap: Column) -> Column:
    return F.when(gap <= 45, F.exp(-gap / 15)).otherwise(0.0)


def stable_id(source: Column, t: Column) -> Column:
    return F.format_string("engine-%d-%08d", source, F.bround(t * 10).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null for missing, unequal, zero or non-finite vectors; else within 0 and 2."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    d = 1 - dot(a, b) / F.when(n > 0, n)
    return F.when((F.size(a) == F.size(b)) & isfinite(d), F.least(F.lit(2.0), F.greatest(F.lit(0.0), d)))


def l2_normalise(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def mean_absolute(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)
