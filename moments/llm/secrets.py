"""Secrets in texts, on DataFrame functions alone.

Three kinds stand for themselves: assigned credentials, access identifiers and long hexadecimal runs. Three weak kinds
count only together: ``ident`` (an account or key name that is given a value), ``blob`` (a long run of letters and
digits) and ``endpoint`` (an address of a service). Parts of the same text are linked by an interval join: positions are
cut into scopes, each part looks into all scopes it covers and the neighbouring ones, and a weak part is reported if its
complements stand within ``SCOPE`` code points: a blob next to an identifier, an identifier next to a secret, an
endpoint next to both. The joins are semi-joins, so no pairs are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.decontam import keyed
from moments.llm.util import Scratch

SCOPE = 200
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(username|user_id|client_id|account_id|access_key_id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)"""
BLOB = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(https|http|postgres|mysql|redis|mongodb|amqp|ftp|ssh)://[A-Za-z0-9@:._-]+"

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "blob", "endpoint")
_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _spans(kind: int, regex: str, maybe: Column, keep: Column | None) -> Column:
    """start, kind, end of all matches, from the text between and the matches themselves; ``keep``: an array of booleans, one per match."""
    text = F.col("text")
    found, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    sizes = F.arrays_zip(between.alias("b"), found.alias("m"))
    walk = F.aggregate(
        F.filter(F.transform(sizes, lambda z: F.struct(F.length(z["b"]).alias("b"), F.length(z["m"]).alias("m"))), lambda z: z["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out")),
        lambda a, z: F.struct((a["at"] + z["b"] + z["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + z["b"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + z["b"] + z["m"]).alias("end")))).alias("out")),
    )["out"]
    if keep is not None:
        walk = F.transform(F.filter(F.arrays_zip(walk.alias("s"), keep.alias("k")), lambda z: z["k"]), lambda z: z["s"])
    return F.when(maybe, walk).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _parts(texts: DataFrame) -> DataFrame:
    """dk, dh, base, weak: spans of each text that may hold any. Cheap tests go first, so few texts meet the costly patterns."""
    text = F.col("text")
    sign = text.contains(":") | text.contains("=")
    value = lambda regex: F.regexp_extract_all(text, F.lit(regex), F.lit(2))
    blobs = F.transform(F.regexp_extract_all(text, F.lit(BLOB), F.lit(0)), lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    accesses = F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda m: F.length(m) >= 20)
    marked = texts.select("dk", "dh", "text", (sign & text.rlike(ASSIGN)).alias("m0"), text.contains("AKIA").alias("m1"), text.rlike(HEX).alias("m2"), (sign & text.rlike(IDENT)).alias("m3"))
    marked = marked.where("m0 or m1 or m2 or m3")
    base = F.concat(
        _spans(0, ASSIGN, F.col("m0"), F.transform(value(ASSIGN), lambda v: F.length(v) >= 6)),
        _spans(1, ACCESS, F.col("m1"), accesses),
        _spans(2, HEX, F.col("m2"), None),
    )
    # A blob counts next to an identifier, and an endpoint next to an identifier and a secret, so a text without identifiers has neither.
    weak = F.concat(_spans(3, IDENT, F.col("m3"), F.transform(value(IDENT), lambda v: F.length(v) >= 3)), _spans(4, BLOB, F.col("m1") | F.col("m3"), blobs), _spans(5, ENDPOINT, text.contains("://"), None))
    return marked.select("dk", "dh", base.alias("base"), weak.alias("weak"))


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that have a row of right in the same text within SCOPE code points."""
    scope = F.floor(F.col("start") / SCOPE)
    span = F.floor(F.col("end") / SCOPE)
    r = right.select("dk", "dh", F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(scope - 1, span + 1)).alias("scope"))
    near = (F.col("s2") <= F.col("end") + SCOPE) & (F.col("e2") >= F.col("start") - SCOPE)
    l = left.withColumn("scope", F.explode(F.sequence(scope, span)))  # noqa: E741
    return l.join(r, (l.dk == r.dk) & (l.dh == r.dh) & (l.scope == r.scope) & near, "left_semi").drop("scope").distinct()


def _text(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """dk, dh, base, spans (arrays of start, kind, end) of the texts that have any; spans also holds the linked weak parts."""
    scratch = Scratch(spark, "secrets")
    # Texts of the same id and content are looked at once each, and all give the same; one of them stays.
    parts = scratch.write(_parts(keyed(docs)), "parts").groupBy("dk", "dh").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    flat = parts.where("size(weak) > 0").select("dk", "dh", F.explode(F.concat("base", "weak")).alias("s")).select("dk", "dh", "s.start", "s.kind", "s.end")
    flat = scratch.write(flat, "flat")
    # A weak part that lies inside a span of a base kind adds nothing.
    idents, secrets = flat.where("kind in (1, 3)"), flat.where("kind in (0, 2, 4)")
    weak = _near(flat.where("kind = 4"), idents).unionByName(_near(flat.where("kind = 3"), secrets)).unionByName(_near(_near(flat.where("kind = 5"), idents), secrets))
    weak = weak.groupBy("dk", "dh").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    out = parts.join(weak, ["dk", "dh"], "left")
    linked = F.filter(F.coalesce("linked", F.expr(f"cast(array() as {_SPANS})")), lambda w: ~F.exists("base", lambda b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])))
    return out.select("dk", "dh", "base", F.concat("base", linked).alias("spans"))


def scan_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Secrets of every whole text.

    Reads ``doc_id, text``; other columns are ignored. One row per input row, repeated ids included: ``doc_id, n_assign,
    n_access, n_hex, base_sha256, spans``. A null or empty text, and a text without finds, has counts of 0 and an empty
    string; an empty table gives no rows. Positions are code points, the end is exclusive.
    """
    found = linked_spans(spark, docs)
    n = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long") for k in range(3)]
    digest = found.select("dk", "dh", *[c.alias(f"n_{k}") for c, k in zip(n, BASE, strict=True)], _text(F.col("base")).alias("b"), _text(F.col("spans")).alias("spans"))
    out = keyed(docs).select("doc_id", "dk", "dh").join(digest, ["dk", "dh"], "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE], F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(spark: SparkSession, docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows with every found span replaced, overlapping ones together; all columns stay, texts without finds as they are."""
    found = linked_spans(spark, docs).select(F.col("dk").alias("_dk"), F.col("dh").alias("_dh"), F.sort_array("spans").alias("_spans")).where("size(_spans) > 0")
    rows = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    joined = rows.join(found, (F.col("_k") == F.col("_dk")) & (F.col("_h") == F.col("_dh")), "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spans(kind: int, regex: str, keep: str) -> str:
    r = regex.replace("'", "''")
    return f"""select doc_id, {kind} kind, s + b s, s + b + m e from (
      select doc_id, i, found, length(between[i]) b, length(found[i]) m, value,
             coalesce(list_sum(list_transform(between[1:i - 1], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::bigint s
      from (select doc_id, between, found, value, unnest(generate_series(1, len(found))) i from (
        select doc_id, string_split_regex(t, '{r}') between, regexp_extract_all(t, '{r}') found, {"regexp_extract_all(t, '" + r + "', 2)" if kind in (0, 3) else "[]::varchar[]"} value from d))) where {keep}"""


OP9_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
p as ({_sql_spans(0, ASSIGN, "length(value[i]) >= 6")} union all {_sql_spans(1, ACCESS, "length(found[i]) >= 20")} union all {_sql_spans(2, HEX, "true")}
  union all {_sql_spans(3, IDENT, "length(value[i]) >= 3")} union all {_sql_spans(4, BLOB, "regexp_matches(found[i], '[0-9]') and regexp_matches(found[i], '[A-Za-z]')")} union all {_sql_spans(5, ENDPOINT, "true")}),
near as (select a.doc_id, a.kind, a.s, a.e, bool_or(b.kind in (1, 3)) ident, bool_or(b.kind in (0, 2, 4)) secret
  from p a join p b on a.doc_id = b.doc_id and b.s <= a.e + {SCOPE} and b.e >= a.s - {SCOPE} where a.kind > 2 group by all),
w as (select doc_id, kind, s, e from near n where ((kind = 4 and ident) or (kind = 3 and secret) or (kind = 5 and ident and secret))
  and not exists (select 1 from p where p.doc_id = n.doc_id and p.kind < 3 and p.s <= n.s and n.e <= p.e)),
a as (select *, ['assign', 'access', 'hex', 'ident', 'blob', 'endpoint'][kind + 1] || ':' || s || ':' || e x from (select doc_id, kind, s, e from p where kind < 3 union all select * from w)),
g as (select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
  string_agg(x, ',' order by s, kind, e) filter (kind < 3) b, string_agg(x, ',' order by s, kind, e) spans from a group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans
from d left join g using (doc_id)
"""
