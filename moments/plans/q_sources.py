"""Queries of sources and sinks. Their inputs are built from the driver's tables, as text, and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moments.operators import photos as PH
from moments.plans import testdata as T
from moments.plans.base import c, query, r6
from moments.plans.q_scalars import PHOTO_REASON_SQL, bad_photos
from moments.plans.q_selection import _diverse, _highlights
from moments.sources import documents as D
from moments.sources import sinks

E, PHOTOS, POSE = T.EVENTS_SQL, T.PHOTOS_SQL, T.POSE_SQL


@query("s01_fixture_samples", f"select src id, (row_number() over (partition by src order by id) - 1)::int pos, round(value, 6) motion, case when id % 3 = 0 then round(value / 3, 6) else 0.2 end::double width, case when id % 4 = 0 then 2 else 1 end::bigint region from {E}")
def fixture_samples(spark, d):
    i = c("id")
    sample = F.struct(i.alias("o"), r6("value").alias("motion"), F.when(i % 3 == 0, r6(c("value") / 3)).alias("width"), F.when(i % 4 == 0, 2).cast("long").alias("region"))
    docs = T.events(spark, d).groupBy("src").agg(F.array_sort(F.collect_list(sample)).alias("s"))
    text = F.to_json(F.struct(c("src").alias("id"), F.struct(F.lit(0.2).alias("width"), F.lit(1).alias("region")).alias("defaults"), F.transform("s", lambda x: F.struct(x["motion"].alias("motion"), x["width"].alias("width"), x["region"].alias("region"))).alias("samples")))
    schema = "id long, defaults struct<width:double,region:long>, samples array<struct<motion:double,width:double,region:long>>"
    return D.with_defaults(D.strict_json(docs.select(text.alias("text")), "text", schema), "samples", "defaults").select("id", c("pos").cast("int").alias("pos"), "motion", "width", "region")


@query("s17_strict_json", "select event_id id, (props->>'k')::bigint k from events")
def strict_json(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select(c("event_id").alias("id"), "props")
    return D.unique_ids(D.strict_json(x, "props", "k long"), "id").select("id", "k")


@query("s02_protocol_photos", f"select set_id, idx, round(sharp, 6) sharp, round(expo, 6) expo, px, round(aes, 6) aes from (select *, {PHOTO_REASON_SQL} reason from {PHOTOS}) where reason is null")
def protocol_photos(spark, d):
    # a document has 2,000 candidates at most, so a set is as many documents as it takes
    n = F.row_number().over(Window.partitionBy("set_id").orderBy("idx")) - 1
    doc = F.struct("set_id", F.floor(c("n") / D.MOST["I"]).alias("part"))
    p = PH.checked(T.photos(spark, d), "set_id").where("reason is null").withColumn("n", n).withColumn("doc", doc)
    show = lambda n: F.coalesce(r6(n).cast("string"), F.lit(""))
    line = F.concat_ws("\t", F.lit("I"), c("idx").cast("string"), show("sharp"), show("expo"), c("px").cast("string"), show("aes"))
    o = c("n") % D.MOST["I"] + 1
    lines = p.select("doc", o.alias("ord"), line.alias("line")).unionByName(p.select("doc").distinct().withColumns({"ord": F.lit(0), "line": F.lit("PHOTO\t5\t0.4")}))
    photos, _ = D.protocol_photos(D.protocol(lines))
    return photos.select(c("doc")["set_id"].alias("set_id"), "idx", r6("sharp").alias("sharp"), r6("expo").alias("expo"), "px", r6("aes").alias("aes"))


@query("s05_pose_scan", f"select src, id, row_number() over (partition by src order by t, id) - 1 ordinal from {POSE}")
def pose_scan(spark, d):
    return D.pose_scan(T.pose(spark, d), "src").select("src", "id", c("ordinal").cast("long").alias("ordinal"))


@query("s03_photo_lines")
def photo_lines(spark, d):
    return sinks.photo_line(_diverse(spark, d), "set_id")


@query("s03_highlight_lines")
def highlight_lines(spark, d):
    return sinks.highlight_line(_highlights(spark, d), T.frames(spark, d), "src")


assert bad_photos
