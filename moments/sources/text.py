"""Text sources: media-tool metadata lines and label logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metadata_lines(lines: DataFrame, metric: str) -> DataFrame:
    """source, ord, line -> source, t, value: each metric line takes the last time stamp before it in its source."""
    time = F.regexp_extract("line", r"pts_time:(-?[0-9.]+)", 1)
    value = F.regexp_extract("line", metric + r"=(-?[0-9.]+)", 1)
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    t = F.last(F.when(time != "", time.cast("double")), True).over(w)
    return lines.select("source", t.alias("t"), F.when(value != "", value.cast("double")).alias("value")).where("value is not null and t is not null")


def latest_labels(log: DataFrame) -> DataFrame:
    """id, label, log_order -> the last line of each id; a partial aggregation, no sort."""
    return log.groupBy("id").agg(F.max(F.struct("log_order", "label")).alias("x")).select("id", F.col("x.label").alias("label"))


def with_latest_labels(candidates: DataFrame, log: DataFrame, default: str) -> DataFrame:
    """Adds label to candidates (id): the last one of the log, or the default."""
    return candidates.join(latest_labels(log), "id", "left").withColumn("label", F.coalesce("label", F.lit(default)))


def recovered(ids: DataFrame) -> DataFrame:
    """source and t of ids like engine-3-00000125; others drop out."""
    part = lambda k: F.regexp_extract("id", r"^engine-(\d+)-(\d+)$", k)
    return ids.where(part(1) != "").select("id", part(1).cast("long").alias("source"), (part(2).cast("double") / 10).alias("t"))
