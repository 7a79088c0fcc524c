"""Benchmark decontamination through a positional inverted index, on DataFrame functions alone.

1. Terms of the benchmark are counted over all training texts.
2. For every window of a benchmark item the two terms that training texts use least are its keys. The postings of those
   terms are stored: term, document, position, and the words around it.
3. Lists are adjusted by the offset of the term in the window and intersected; what is left is compared word by word.
4. The same lists give the proximity matches: texts where both key terms of a window stand near each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.util import Scratch, ascii_lower, pick, text_or_empty

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A side of a join is broadcast if it has at most so many rows (of a few hundred bytes each); else both are shuffled.
BROADCAST_ROWS = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SPLIT), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    """Documents by id and text hash: ids may repeat or be null."""
    base = pick(docs, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return base.withColumns({"dk": F.coalesce("doc_id", F.lit(-(1 << 63))), "dh": F.xxhash64("text")})


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, terms: every run of ``window`` words, or all words of a shorter item."""
    w = items.select(F.col("item_id").alias("item"), words_of(text_or_empty()).alias("w")).where("size(w) > 0")
    return w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("terms"))


def postings(texts: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """term, dk, dh, pos (from 0), before (how many words of context precede it), context."""
    split = texts.select("dk", "dh", words_of(F.col("text")).alias("w"))
    at = split.select("dk", "dh", "w", F.posexplode("w").alias("pos", "term")).join(terms, "term")
    first = F.greatest(F.lit(0), F.col("pos") - around)
    return at.select("term", "dk", "dh", "pos", (F.col("pos") - first).alias("before"), F.slice("w", first + 1, F.col("pos") - first + 1 + around).alias("context"))


class Index:
    """The stored postings of the terms that benchmark windows are looked up by."""

    def __init__(self, spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        self.scratch, self.window = Scratch(spark, "decontam"), window
        texts = keyed(docs)
        self.tests = self.scratch.write(test_windows(items, window).withColumn("test", F.xxhash64(F.concat_ws("\x01", "terms"))), "tests")
        self.distinct = self.tests.groupBy("test").agg(F.first("terms").alias("terms"))
        vocabulary = _small(self.scratch.write(self.tests.select(F.explode("terms").alias("term")).distinct(), "terms"))
        used = texts.select(F.explode(words_of(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").count()
        used = self.scratch.write(used, "used")
        # A window with a term that no text has can't occur. The two least used terms, at their first offsets, are its keys.
        offsets = self.distinct.select("test", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
        ranked = offsets.groupBy("test", "size", "term").agg(F.min("offset").alias("offset")).join(_small(used), "term", "left")
        keys = ranked.groupBy("test", "size").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "offset"))), 1, 2).alias("keys"))
        self.keys = self.scratch.write(keys.where("keys[0].n > 0").select("test", "size", F.size("keys").alias("lists"), F.posexplode("keys").alias("list", "k")).select("test", "size", "lists", "list", "k.term", "k.offset"), "keys")
        self.postings = self.scratch.write(postings(texts, _small(self.keys.select("term").distinct()), window - 1), "postings")

    def owners(self) -> DataFrame:
        """test, item of the windows of items that have an id."""
        return self.tests.where("item is not null").select("test", F.col("item").cast("string").alias("item")).distinct()

    def exact(self) -> DataFrame:
        """dk, dh, start, size, test of the windows that texts have word by word.

        Only offset-adjusted positions are shuffled to be intersected; the words around are fetched for what is left.
        """
        start = F.col("pos") - F.col("offset")
        adjusted = self.postings.select("term", "dk", "dh", "pos").join(_small(self.keys), "term").where(start >= 0)
        seen = F.bit_or(F.expr("shiftleft(1, list)"))
        both = adjusted.select("test", "size", "lists", "dk", "dh", start.alias("start"), "list").groupBy("test", "size", "lists", "dk", "dh", "start").agg(F.bit_count(seen).alias("n")).where("n = lists")
        both = self.scratch.write(both.select("test", "size", "dk", "dh", "start"), "both")
        first = self.keys.where("list = 0").select("test", "term", "offset")
        asked = both.join(_small(first), "test").withColumn("pos", F.col("start") + F.col("offset"))
        text = asked.join(self.postings, ["term", "dk", "dh", "pos"]).select("test", "size", "dk", "dh", "start", F.slice("context", F.col("before") - F.col("offset") + 1, F.col("size")).alias("seen"))
        exact = text.join(_small(self.distinct), "test").where("seen = terms").select("dk", "dh", "start", "size", "test").distinct()
        return self.scratch.write(exact, "exact")

    def near(self) -> DataFrame:
        """dk, dh, item: the two rarest terms of a window of the item stand at most a window apart, in any order, whether or not the rest is there."""
        two = self.keys.groupBy("test").agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a <> b")
        pairs = self.scratch.write(two.withColumn("pair", F.xxhash64("a", "b")), "pairs")
        keys = pairs.select("pair", F.explode(F.array("a", "b")).alias("term")).distinct()
        found = proximity_matches(self.postings, keys.withColumnRenamed("pair", "test"), self.window)
        items = pairs.select("pair", "test").join(_small(self.owners()), "test").select(F.col("pair").alias("test"), "item").distinct()
        return found.select("test", "dk", "dh").join(_small(items), "test").select("dk", "dh", "item").distinct()


def find_tests(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Matches of benchmark windows: (dk, dh, start, size, test) and (test, item)."""
    index = Index(spark, docs, items, window)
    return index.exact(), index.owners()


def proximity_matches(index: DataFrame, keys: DataFrame, within: int) -> DataFrame:
    """test, dk, dh, gap: documents where the two key terms of a test stand at most ``within`` words apart, in any order.

    ``index`` has term, dk, dh, pos and ``keys`` has test, term. Positions are cut into stretches of ``within`` words, so
    that only neighbouring stretches meet, and within those the nearest position decides.
    """
    a, b = (keys.groupBy("test").agg(f("term").alias("term")) for f in (F.min, F.max))
    stretch = F.floor(F.col("pos") / within)
    places = index.select("term", "dk", "dh", "pos")
    left = places.join(_small(a), "term").select("test", "dk", "dh", "pos", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("s"))
    right = places.join(_small(b), "term").groupBy("test", "dk", "dh", stretch.alias("s")).agg(F.sort_array(F.collect_set("pos")).alias("others"))
    gap = F.array_min(F.transform(F.filter("others", lambda x: x != F.col("pos")), lambda x: F.abs(x - F.col("pos"))))
    return left.join(right, ["test", "dk", "dh", "s"]).select("test", "dk", "dh", gap.alias("gap")).where(F.col("gap") <= within).groupBy("test", "dk", "dh").agg(F.min("gap").alias("gap"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """How far each text is covered by benchmark windows.

    Reads ``doc_id, text`` and ``item_id, text``; other columns are ignored. One row per input row, repeated ids included:
    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` (items of which the two rarest terms of a window
    stand at most a window apart). A null or empty text has no words and no hits; items without words have no windows,
    those without an id hit words but aren't listed or counted; with no items nothing is hit; no documents give no rows.
    """
    index = Index(spark, docs, items, window)
    matches, owners = index.exact(), index.owners()
    near = index.near().groupBy("dk", "dh").agg(F.count(F.lit(1)).alias("n_near"))
    hit = matches.select("dk", "dh", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("dk", "dh").agg(F.count(F.lit(1)).alias("n_hit"))
    names = matches.select("dk", "dh", "test").distinct().join(_small(owners), "test").select("dk", "dh", "item").distinct()
    names = names.groupBy("dk", "dh").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    base = keyed(docs).select("doc_id", "dk", "dh", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    found = hit.join(names, ["dk", "dh"], "left").join(near, ["dk", "dh"], "full")
    out = base.join(found, ["dk", "dh"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_W = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP6_SQL = f"""
with d as (select doc_id, {_W} w from documents), b as (select item_id, {_W} w from benchmark),
t as (select distinct item_id, array_to_string(w[i:i + 12], ' ') g, least(len(w), 13) k
      from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) i from b where len(w) > 0)),
g as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g
      from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) i from d, (select distinct k from t) where len(w) >= k)),
m as (select g.doc_id, g.i, g.k, t.item_id from g join t using (g, k)),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) p from m) group by 1),
u as (select term, count(*) n from (select unnest(w) term from d) group by 1),
rk as (select item_id, i, term, row_number() over (partition by item_id, i order by coalesce(n, 0), term) r, min(coalesce(n, 0)) over (partition by item_id, i) least_n
       from (select item_id, i, unnest(list_distinct(w[i:i + 12])) term from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) i from b where len(w) > 0 and item_id is not null)) left join u using (term)),
kp as (select distinct item_id, a, z from (select item_id, i, min(term) a, max(term) z, count(*) c from rk where r <= 2 and least_n > 0 group by 1, 2) where c = 2),
ps as (select * from (select doc_id, unnest(w) term, unnest(range(len(w))) p from d) where term in (select a from kp union select z from kp)),
nr as (select doc_id, count(*) n_near from (select distinct x.doc_id, kp.item_id from kp join ps x on x.term = a join ps y on y.term = z and y.doc_id = x.doc_id and abs(x.p - y.p) <= 13) group by 1),
n as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) items from (select distinct doc_id, item_id::varchar s from m where item_id is not null) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated, coalesce(n_near, 0)::bigint n_near
from d left join h using (doc_id) left join n using (doc_id) left join nr using (doc_id)
"""
