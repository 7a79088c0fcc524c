"""Outputs: one JSON line a selection, tables that are never overwritten, and the log that labels are added to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def finite(x: Column) -> Column:
    """The number; one that isn't finite stops the query."""
    return F.when(x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf"))), x).otherwise(F.raise_error(F.lit("a number isn't finite")).cast("double"))


def _numbers(order: Column, when: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), c("idx").cast("long").alias("idx"))))), lambda x: x["idx"])


def _keyed(when: Column, value: Column, text: bool) -> Column:
    """A JSON object with the idx as keys, in order of number."""
    shown = F.to_json(F.array(value)) if text else value.cast("string")
    body = F.concat(F.lit('"'), c("idx").cast("string"), F.lit('":'), F.regexp_extract(shown, r"^\[(.*)\]$", 1) if text else shown)
    parts = F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("idx", body.alias("b"))))), lambda x: x["b"])
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _line(mode: str, parts: list[tuple[str, Column]]) -> Column:
    shown = [F.concat(F.lit(f'"{n}":'), x) for n, x in parts]
    return F.concat(F.lit(f'{{"protocolVersion":1,"mode":"{mode}",'), F.concat_ws(",", *shown), F.lit("}"))


def photo_line(diverse: DataFrame, key: str) -> DataFrame:
    """key, line: what ``photos.diverse`` chose, as one line of JSON a set. Groups are put together first, so that a line takes time as its length."""
    ok, x = c("reason").isNull(), diverse.withColumn("score", finite(c("score")))
    members = F.array_sort(F.collect_list(F.struct("member", "idx")))
    group = x.where(ok).groupBy(key, "grp").agg(members.alias("m")).withColumn("first", F.filter("m", lambda m: m["member"] == 1)[0]["idx"])
    group = group.select(key, F.struct("grp", F.struct(c("first").alias("representativeIndex"), F.transform("m", lambda m: m["idx"]).alias("memberIndices")).alias("g")).alias("x"))
    group = group.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("groups"))
    g = x.groupBy(key).agg(
        _numbers(c("idx"), c("selected")).alias("sel"), _numbers(c("rank"), ok).alias("ranked"), _numbers(c("position"), ok).alias("order"), _keyed(ok, c("score"), False).alias("scores"),
        _keyed(c("selected"), c("role"), True).alias("roles"), _keyed(~ok, c("reason"), True).alias("reasons"),
    )
    g = g.join(group, key, "left")
    none = F.array().cast(group.schema["groups"].dataType)
    groups = F.transform(F.coalesce("groups", none), lambda x: x["g"])
    parts = [("selectedIndices", F.to_json("sel")), ("qualityRankedIndices", F.to_json("ranked")), ("selectionOrderIndices", F.to_json("order")), ("scoreByIndex", c("scores")), ("groups", F.to_json(groups)), ("selectionRoleByIndex", c("roles")), ("rejectionReasonsByIndex", c("reasons"))]
    return g.select(key, _line("PHOTO", parts).alias("line"))


def highlight_line(chosen: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """key, line: what ``highlights.highlights`` chose of frames (key, idx, t, imp), as one line of JSON a recording."""
    x = chosen.join(frames.groupBy(key, "idx").agg(F.min("t").alias("t"), F.max("imp").alias("imp")), [key, "idx"], "left").withColumn("score", finite(c("score")))
    taken = c("position").isNotNull()
    scored = c("score").isNotNull()
    g = x.groupBy(key).agg(
        _numbers(F.struct("t", "idx"), taken).alias("sel"), _numbers(c("position"), taken).alias("order"), _keyed(scored, c("score"), False).alias("scores"), _keyed(c("reason").isNotNull(), c("reason"), True).alias("reasons"),
        _numbers(c("position"), taken & c("segment").isNull()).alias("omitted"), F.array_sort(F.collect_list(F.when(c("segment").isNotNull(), F.struct("segment", "start", "end", "t", "idx")))).alias("parts"),
        F.coalesce(F.min(F.when(scored, c("imp").isNotNull())), F.lit(False)).alias("used"),
    )
    numbers = F.array_distinct(F.transform("parts", lambda p: p["segment"]))
    of = lambda n: F.filter("parts", lambda p: p["segment"] == n)
    segments = F.transform(numbers, lambda n: F.struct(of(n)[0]["start"].alias("startSeconds"), of(n)[0]["end"].alias("endSeconds"), F.transform(of(n), lambda p: p["idx"]).alias("anchorIndices")))
    parts = [("selectedFrameIndices", F.to_json("sel")), ("selectionOrderIndices", F.to_json("order")), ("segments", F.to_json(segments)), ("scoreByIndex", c("scores")), ("rejectionReasonsByIndex", c("reasons")), ("omittedSegmentFrameIndices", F.to_json("omitted")), ("configurationErrors", F.lit("[]")), ("usedImportanceScores", c("used").cast("string"))]
    return g.select(key, _line("VIDEO", parts).alias("line"))


def write_new(df: DataFrame, path: str) -> None:
    """Writes a table that must not be there yet. It is written beside its place and moved there whole; what came first stays."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}.tmp")
    try:
        df.write.mode("errorifexists").parquet(beside.toString())
        # A rename onto a folder would go into it, so what appeared meanwhile is looked for once more.
        if fs.exists(target) or not fs.rename(beside, target):
            raise FileExistsError(path)
    finally:
        fs.delete(beside, True)


def add_labels(labels: DataFrame, log: str) -> None:
    """Adds rows (id, label, log_order) to the log; nothing there is changed. The last row of an id counts (text.latest_labels)."""
    labels.select(c("id").cast("long"), "label", c("log_order").cast("long")).write.mode("append").parquet(log)
