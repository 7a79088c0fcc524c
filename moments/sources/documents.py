"""JSON and tab-separated inputs, read strictly: what doesn't fit the schema stops the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

c = F.col


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def strict_json(df: DataFrame, text: str, schema: str | StructType, most: int = 1 << 20) -> DataFrame:
    """The columns of the schema from JSON objects in a column of df, with df's other columns.

    A text over ``most`` characters, one that isn't an object of the schema, numbers that aren't numbers and keys that the
    schema doesn't name stop the query.
    """
    s = _schema(schema)
    value = F.from_json(text, s, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"})
    extra = F.array_except(F.json_object_keys(text), F.array(*[F.lit(n) for n in s.fieldNames()]))
    good = (F.length(text) <= most) & (F.size(extra) == 0)
    checked = F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit("not a document of the schema: "), F.coalesce(F.substring(text, 1, 80), F.lit("null")))))
    return df.withColumn("_j", checked).select(*[n for n in df.columns if n != text], "_j.*")


def unique_ids(df: DataFrame, *by: str) -> DataFrame:
    """The same rows; a repeated ``by`` stops the query."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    key = F.concat_ws(", ", *[c(x).cast("string") for x in by])
    first = F.when(n == 1, c(by[0])).otherwise(F.raise_error(F.concat(F.lit("repeated: "), key)).cast(df.schema[by[0]].dataType))
    return df.withColumn(by[0], first)


def with_defaults(df: DataFrame, samples: str, defaults: str) -> DataFrame:
    """A row a sample (pos and its fields) of documents with an array of samples and one struct of defaults for fields that a sample lacks."""
    inner = df.schema[samples].dataType.elementType
    known = set(df.schema[defaults].dataType.fieldNames())
    x = df.select("*", F.posexplode(samples).alias("pos", "_x"))
    fields = [F.coalesce(c("_x")[n], c(defaults)[n]).alias(n) if n in known else c("_x")[n].alias(n) for n in inner.fieldNames()]
    return x.select(*[n for n in df.columns if n not in (samples, defaults)], "pos", *fields)


def fixtures(spark, path: str, schema: str) -> DataFrame:
    """Samples of fixture files: JSON documents of the schema (id, defaults, samples, ...)."""
    return with_defaults(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path), "samples", "defaults")


def pose_scan(samples: DataFrame, key: str) -> DataFrame:
    """Samples with their ordinal in time within their source; ties keep the order of id."""
    return samples.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("t", "id")) - 1)


ARITY = {"PHOTO": (3, 3), "VIDEO": (5, 6), "I": (6, 6), "F": (5, 5), "D": (4, 4), "B": (2, 2)}
RECORDS = {"PHOTO": ("I", "D"), "VIDEO": ("F", "D", "B")}
MOST = {"I": 2000, "F": 2000, "D": 250_000, "B": 2000}
WHOLE, NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(x: Column, low: float | None = None, high: float | None = None, whole: bool = False) -> Column:
    v = F.when(x.rlike(WHOLE if whole else NUMBER), x.try_cast("double"))
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if whole:
        ok = ok & (F.abs(v) < 2.0**31)
    for bound, test in ((low, lambda b: v >= b), (high, lambda b: v <= b)):
        if bound is not None:
            ok = ok & test(bound)
    return F.coalesce(ok, F.lit(False))


def protocol(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, ord, tag, fields (strings after the tag) of documents of lines (doc, ord from 0, line).

    The first line is PHOTO (count, threshold) or VIDEO (count, threshold, duration, budget and maybe a weight), the others
    are its records: I and D, or F, D and B. Wrong tags, numbers of fields, values out of range, lines of over 256
    characters, blank lines, more records than a document may have (2,000 candidates, 250,000 distances, 2,000 cuts) or a
    document without its first line stop the query.
    """
    f = F.split("line", "\t", -1)
    w = Window.partitionBy(doc)
    x = lines.select(doc, "ord", "line", f.alias("f")).withColumn("tag", c("f")[0])
    x = x.withColumn("head", F.max(F.when(c("ord") == 0, c("tag"))).over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(doc, "tag")))
    at = lambda k: F.get(c("f"), F.lit(k))
    maybe = lambda k: (at(k) == "") | _number(at(k), 0, 1)
    size = F.size("f")
    fits = {
        "PHOTO": _number(at(1), 0, 2000, True) & _number(at(2), 0),
        "VIDEO": _number(at(1), 0, 2000, True) & _number(at(2), 0) & _number(at(3)) & (at(3).try_cast("double") > 0) & _number(at(4), 0) & ((size == 5) | _number(at(5), 0, 1)),
        "I": _number(at(1), 0, None, True) & _number(at(2), 0, 1) & _number(at(3), 0, 1) & _number(at(4), 1, None, True) & maybe(5),
        "F": _number(at(1), 0, None, True) & _number(at(2), 0) & _number(at(3), 0, 1) & maybe(4),
        "D": _number(at(1), None, None, True) & _number(at(2), None, None, True) & _number(at(3), 0),
        "B": _number(at(1), 0),
    }
    good = F.lit(False)
    for tag, (least, most) in ARITY.items():
        belongs = (c("ord") == 0) if tag in RECORDS else (c("ord") > 0) & c("head").isin(*[h for h, r in RECORDS.items() if tag in r]) & (c("n") <= MOST[tag])
        good = good | ((c("tag") == tag) & size.between(least, most) & belongs & fits[tag])
    good = F.coalesce(good & (F.length("line") <= 256), F.lit(False))
    checked = F.when(good, c("f")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad line"), c("ord").cast("string"), F.lit("of"), c(doc).cast("string"))))
    return x.select(doc, "ord", checked.alias("f")).select(doc, "ord", c("f")[0].alias("tag"), F.slice("f", 2, 10).alias("fields"))


def protocol_photos(records: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """photos (doc, idx, sharp, expo, px, aes) and distances (doc, i, j, d) of ``protocol``."""
    v = lambda k, kind: c("fields")[k].try_cast(kind)
    photos = records.where("tag = 'I'").select(doc, v(0, "long").alias("idx"), v(1, "double").alias("sharp"), v(2, "double").alias("expo"), v(3, "long").alias("px"), v(4, "double").alias("aes"))
    return photos, records.where("tag = 'D'").select(doc, v(0, "long").alias("i"), v(1, "long").alias("j"), v(2, "double").alias("d"))
