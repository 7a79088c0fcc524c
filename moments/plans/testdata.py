"""Deterministic stand-ins: the driver's tables seen as the engine's feature tables. They exercise operators; they aren't realistic media.

Time is counted in units of ten hours, so that a source has about one event a unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNIT = 36_000_000_000
START = 1_704_067_200_000_000
EVENTS_SQL = f"(select event_id id, user_id src, (epoch_us(ts) - {START}) / {UNIT}.0::double t, event_type kind, value from events)"
PHOTOS_SQL = "(select label set_id, vec_id idx, least(1, abs(embedding[1]::double) * 4) sharp, least(1, abs(embedding[2]::double) * 4) expo, 1000000 + vec_id px, case when label % 3 = 0 and vec_id % 7 = 0 then null else least(1, abs(embedding[3]::double) * 4) end aes, embedding e from embeddings)"
AUDIO_SQL = f"(select id, src, t, least(1, value / 200) rms, least(1, value / 60) peak, (id % 40) / 100.0::double crossing, [0.005::double, 0.012::double, 0.03::double][id % 3 + 1] baseline, [0.004::double, 0.02::double][id % 2 + 1] recent, ['automatic', 'noisy', 'normal', 'quiet'][id % 4 + 1] sensitivity from {EVENTS_SQL})"
CLIPS_SQL = "(select d.doc_id id, d.source g, quality = 1 and toxic = 0 positive, (n_chars % 977) / 977.0::double expert, case when d.doc_id % 211 = 5 then null else (d.doc_id * 7919 % 1009) / 1009.0::double end semantic from labels l join documents d on l.doc_id = d.doc_id)"


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - START) / F.lit(float(UNIT))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("src"), t.alias("t"), F.col("event_type").alias("kind"), "value")


def audio(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    at = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    return events(spark, d).select(
        "id", "src", "t", F.least(F.lit(1.0), F.col("value") / 200).alias("rms"), F.least(F.lit(1.0), F.col("value") / 60).alias("peak"), ((i % 40) / 100.0).alias("crossing"),
        at([0.005, 0.012, 0.03], 3).alias("baseline"), at([0.004, 0.02], 2).alias("recent"), at(["automatic", "noisy", "normal", "quiet"], 4).alias("sensitivity"),
    )


def photos(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    part = lambda k: F.least(F.lit(1.0), F.abs(e[k].cast("double")) * 4)
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("label").alias("set_id"), F.col("vec_id").alias("idx"), part(0).alias("sharp"), part(1).alias("expo"), (F.col("vec_id") + 1000000).alias("px"),
        F.when(~((F.col("label") % 3 == 0) & (F.col("vec_id") % 7 == 0)), part(2)).alias("aes"), e.alias("e"),
    )


def clips(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars"), "doc_id")
    semantic = F.when(F.col("doc_id") % 211 != 5, (F.col("doc_id") * 7919 % 1009) / 1009.0)
    return x.select(F.col("doc_id").alias("id"), F.col("source").alias("g"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("positive"), ((F.col("n_chars") % 977) / 977.0).alias("expert"), semantic.alias("semantic"))


#: Forty steps of a body at a fifth of a second: at rest, a short stroke, at rest, a full swing, at rest, two twitches.
HAND = [0.0] * 8 + [0.10, 0.25, 0.30, 0.22, 0.08, -0.06, -0.10, -0.08] + [0.0] * 8 + [0.25, 0.5, 0.35, 0.15, 0.0, 0.0] + [0.0] * 6 + [0.04, 0.0, 0.03, 0.0]
#: The same for motion on the screen.
LOCAL = [0.05] * 5 + [0.13, 0.15, 0.18, 0.27, 0.2, 0.1, 0.05] + [0.05] * 6 + [0.3, 0.1, 0.05, 0.13, 0.16, 0.1, 0.22, 0.3, 0.1, 0.05] + [0.05] * 12
_STEPS_SQL = "(select user_id src, event_id id, row_number() over (partition by user_id order by ts, event_id) - 1 k, event_type kind, value from events)"
_listed = lambda xs: "[" + ", ".join(f"{x}::double" for x in xs) + "]"
_T_SQL = "k * 0.2::double + (k // 50) * 1.0::double"
POSE_SQL = f"""(select src, id, k, {_T_SQL} t, {_listed(HAND)}[((k + src) % 40 + 1)::int] * (case when src % 2 = 0 then 0.5::double else 1.0::double end) + (id % 5) / 1000.0::double hand_x, (id % 7) / 500.0::double hand_y,
0.5::double + (id % 3) / 1000.0::double + (case when id % 97 = 0 then 0.3::double else 0.0::double end) core_x, 0.5::double + (id % 4) / 1000.0::double core_y,
case when id % 89 = 0 then 0.3::double else 0.2::double end scale, case when id % 23 = 0 then 0.3::double else 0.6::double + (id % 8) / 20.0::double end conf from {_STEPS_SQL})"""
VISUAL_SQL = f"""(select src, id, k, {_T_SQL} t, {_listed(LOCAL)}[((k + src) % 40 + 1)::int] + (id % 4) / 1000.0::double local, case when id % 29 = 0 then 0.2::double else 0.04::double end global,
0.2::double widespread, 0.6::double conc, case when id % 41 = 0 then 0.2::double else 0.02::double end bright, case when id % 31 = 0 then 4 else 1 + id % 2 end region from {_STEPS_SQL})"""
FRAMES_SQL = f"(select src, case when id % 101 = 0 then -id when id % 67 = 0 then 67 else id end idx, case when id % 113 = 0 then -1.0::double else t end t, case when id % 71 = 0 then 1.5::double else least(1, value / 60) end q, case when src % 3 = 0 and id % 19 = 0 then null else (id % 100) / 99.0::double end imp from {EVENTS_SQL})"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("src").orderBy("ts", "id")) - 1
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("src"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"), "value")
    return e.withColumn("k", k.cast("long")).drop("ts").withColumn("t", F.col("k") * F.lit(0.2) + F.floor(F.col("k") / 50) * F.lit(1.0))


def _step_of(xs: list[float]):
    return F.element_at(F.array(*map(F.lit, xs)), ((F.col("k") + F.col("src")) % 40 + 1).cast("int"))


def pose(spark: SparkSession, d: str) -> DataFrame:
    """src, id, k, t, hand_x, hand_y, core_x, core_y, scale, conf"""
    i = F.col("id")
    return _steps(spark, d).select(
        "src", "id", "k", "t", (_step_of(HAND) * F.when(F.col("src") % 2 == 0, 0.5).otherwise(1.0) + (i % 5) / 1000.0).alias("hand_x"), ((i % 7) / 500.0).alias("hand_y"),
        (F.lit(0.5) + (i % 3) / 1000.0 + F.when(i % 97 == 0, 0.3).otherwise(0.0)).alias("core_x"), (F.lit(0.5) + (i % 4) / 1000.0).alias("core_y"),
        F.when(i % 89 == 0, 0.3).otherwise(0.2).alias("scale"), F.when(i % 23 == 0, 0.3).otherwise(F.lit(0.6) + (i % 8) / 20.0).alias("conf"),
    )


def visual(spark: SparkSession, d: str) -> DataFrame:
    """src, id, k, t, local, global, widespread, conc, bright, region"""
    i = F.col("id")
    return _steps(spark, d).select(
        "src", "id", "k", "t", (_step_of(LOCAL) + (i % 4) / 1000.0).alias("local"), F.when(i % 29 == 0, 0.2).otherwise(0.04).alias("global"), F.lit(0.2).alias("widespread"), F.lit(0.6).alias("conc"),
        F.when(i % 41 == 0, 0.2).otherwise(0.02).alias("bright"), F.when(i % 31 == 0, 4).otherwise(1 + i % 2).cast("long").alias("region"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    """src, idx, t, q, imp: candidates of one recording a source, some of them invalid on purpose."""
    i = F.col("id")
    return events(spark, d).select(
        "src", F.when(i % 101 == 0, -i).when(i % 67 == 0, 67).otherwise(i).alias("idx"), F.when(i % 113 == 0, -1.0).otherwise(F.col("t")).alias("t"),
        F.when(i % 71 == 0, 1.5).otherwise(F.least(F.lit(1.0), F.col("value") / 60)).alias("q"), F.when(~((F.col("src") % 3 == 0) & (i % 19 == 0)), (i % 100) / 99.0).alias("imp"),
    )
