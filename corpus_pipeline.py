"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of the
next one. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm import decontam, neardup, quality, secrets, util, words
from moments.llm.util import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as poor or toxic go.

    It is fitted on the labelled documents among docs. A null text counts as empty; copies of a row stay or go together; a
    score at the threshold stays; without labels all stay; an empty table stays empty.
    """
    return quality.good_documents(spark, docs, quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _with_key(docs: DataFrame) -> DataFrame:
    """Rows of docs with their id (_k) and a hash of their text (_h)."""
    return docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def _by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs with, or without, their id and text in keys (_k, _h)."""
    return _with_key(docs).join(keys, ["_k", "_h"], how).select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or through others, the one row of the least id and
    text stays; rows without words all stay, whatever their ids."""
    scratch = Scratch(spark, "neardup-stage")
    found = scratch.write(neardup.labelled(spark, docs, 5, 80), "found")
    keys = found.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), F.col("dh").alias("_h")).agg(F.bool_or("first").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    # One row stays of those that are the same in id and text; all others stay or go by their key.
    keys = scratch.write(keys.where("not first or n > 0 and rows > 1"), "keys")
    one = _with_key(docs).join(keys.where("first").select("_k", "_h"), ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select(*docs.columns)
    return _by_key(docs, keys.select("_k", "_h"), "left_anti").unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 13 words in a row of a benchmark item go, and those of which items of fewer words cover a twentieth or more.

    However long a text is, a passage of an item in it is a leak; the words of a shorter item (an answer, a name) stand in
    texts anyway, so those go by their share. A null or empty text has no windows and stays; rows of the same id and text
    stay or go together; rows of one id, or of none, with other texts are judged by their own; without items all stay; an
    empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scratch = Scratch(spark, "decontamination-stage")
    matches, _ = decontam.find_tests(spark, docs, items)
    passages = matches.where(F.col("size") == decontam.WINDOW).select(F.col("dk").alias("_k"), F.col("dh").alias("_h")).distinct()
    matches = matches.join(passages, (F.col("dk") == F.col("_k")) & (F.col("dh") == F.col("_h")), "left_anti")
    hit = matches.select("dk", "dh", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("dk", "dh").agg(F.count(F.lit(1)).alias("n_hit"))
    touched = _by_key(docs, hit.select(F.col("dk").alias("_k"), F.col("dh").alias("_h")), "left_semi")
    n_words = decontam.keyed(touched).select("dk", "dh", F.size(decontam.words_of(F.col("text"))).alias("n_words")).distinct()
    covered = hit.join(n_words, ["dk", "dh"]).where("20 * n_hit >= n_words").select(F.col("dk").alias("_k"), F.col("dh").alias("_h"))
    bad = scratch.write(passages.unionByName(covered), "bad")
    return _by_key(docs, bad, "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay. A null text stays null; copies of a row are cut alike; an empty table stays empty."""
    return secrets.redacted(spark, docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids in decimal, of every row; they are decoded, too, but the pieces aren't kept. A null or empty text has no tokens; an empty table gives no rows."""
    import public_tokenizers

    return words.bpe_roundtrip(spark, docs, public_tokenizers.path("word_bpe_49k.json"), digests=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding", bpe_stage),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage staged, and the table before it, go once its own table is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        begun = len(util.MADE)
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
        util.release(spark, begun)
        if k:
            scratch.drop(str(k - 1))
    return docs
