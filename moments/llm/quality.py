"""Quality classifier by co-training.

Two views of a document: its text (which of the most telling words it has) and its page metadata (source, language,
size and layout figures). For each target, ``quality`` and ``toxic``, a logistic classifier per view is fitted on
labelled documents; over some rounds each view labels the unlabelled documents it is sure of, for the other view. Then
each view is calibrated on held-out labels, the calibrated views are combined, and all documents are scored.

Only the fit works on bounded samples: at most ``LABELLED`` labelled and ``UNLABELLED`` other documents, those of the
least hash of the id. Scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.util import prepare, trimmed
from moments.llm.words import slices

LABELLED, UNLABELLED = 8000, 4000
TERMS = 300
ROUNDS = 3
SURE = 0.97
SOURCES, LANGS = 16, 8
N_META = 7 + SOURCES + LANGS

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # capitals
for _c in b"!\"#$%&'()*+-/<=>@[]^_`{|}~":
    _CLASS[_c] = 2  # signs
_CLASS[48:58] = 3
_CLASS[10] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5


def views(texts: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash) of the distinct words of each text as two arrays, and the metadata figures, a row each."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, ".,!?;:\"'()").to_numpy(zero_copy_only=False)
    hashes = hash_array(words) if len(words) else np.empty(0, np.uint64)
    flat = hashes[coded.indices.to_numpy()]
    counts = pc.list_value_length(lists).to_numpy()
    doc = np.repeat(np.arange(n), counts)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset)
    kinds = _CLASS[raw[first[0] : first[-1]]]
    meta = np.zeros((n, N_META))
    length = np.maximum(1, sizes)
    meta[:, 0] = np.log1p(sizes)
    for k in range(1, 5):
        run = np.concatenate([[0], np.cumsum(kinds == k)])
        meta[:, k] = (run[ends] - run[ends - sizes]) / length
    meta[:, 5] = np.minimum(30, sizes / np.maximum(1, counts))
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (flat[1:] != flat[:-1])
    doc, flat = doc[new], flat[new]
    meta[:, 6] = np.bincount(doc, minlength=n) / np.maximum(1, counts)
    for at, size, column in ((7, SOURCES, source), (7 + SOURCES, LANGS, lang)):
        values = pc.fill_null(column.cast(pa.string()), "").to_numpy(zero_copy_only=False)
        meta[np.arange(n), at + (hash_array(values.astype(object)) % np.uint64(size)).astype(np.int64)] = 1
    return doc, flat, meta


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, w: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one the constant, of a ridge logistic regression (Newton's method)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, w = np.zeros(x.shape[1]), np.ones(len(x)) if w is None else w
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _value(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Target:
    """One fitted target: chosen words (sorted hashes), weights of both views, and the combination of the calibrated views."""

    prior: float = 0.5
    terms: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    joint: np.ndarray | None = None

    def has(self, n: int, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(self.terms)))
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
            ok = self.terms[at] == words
            x[doc[ok], at[ok]] = 1
        return x

    def score(self, n: int, doc: np.ndarray, words: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.joint is None:
            return np.full(n, self.prior)
        z = np.stack([_value(self.has(n, doc, words), self.text), _value((meta - self.mean) / self.scale, self.meta)], 1)
        return _sigmoid(_value(z, self.joint))


def telling(n: int, doc: np.ndarray, words: np.ndarray, y: np.ndarray, most: int = TERMS) -> np.ndarray:
    """The words whose presence says most about y (likelihood ratio), sorted by hash; of equal ones the smaller hash."""
    known, at = np.unique(words, return_inverse=True)
    a, c = np.bincount(at, y[doc], len(known)), np.bincount(at, minlength=len(known)).astype(float)
    p, g = y.mean(), np.zeros(len(known))
    for seen, of in ((a, p), (c - a, 1 - p)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(seen > 0, seen * np.log(seen / (c * of)), 0)
    g[c < 5] = 0
    best = np.lexsort((known, -g))[:most]
    return np.sort(known[best[g[best] > 3]])


def co_train(y: np.ndarray, n: int, doc: np.ndarray, words: np.ndarray, meta: np.ndarray) -> Target:
    """y: 1, 0 or nan where unlabelled. Every fourth labelled row is held out from the views and calibrates and combines them."""
    labelled = np.flatnonzero(~np.isnan(y))
    if not len(labelled) or len(set(y[labelled])) < 2:
        return Target(prior=float(y[labelled].mean()) if len(labelled) else 0.5)
    held, fit = labelled[::4], labelled[np.arange(len(labelled)) % 4 > 0]
    t = Target(prior=float(y[labelled].mean()))
    inside = np.zeros(n, bool)
    inside[fit] = True
    use = inside[doc]
    rank = np.cumsum(inside) - 1
    t.terms = telling(len(fit), rank[doc[use]], words[use], y[fit])
    t.mean, t.scale = meta[fit].mean(0), np.maximum(meta[fit].std(0), 1e-6)
    xs = [t.has(n, doc, words), (meta - t.mean) / t.scale]
    free = np.flatnonzero(np.isnan(y))
    given: list[dict[int, float]] = [{}, {}]
    fits = [None, None]
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            extra = np.array(sorted(given[v]), np.int64)
            rows = np.concatenate([fit, extra])
            target = np.concatenate([y[fit], [given[v][i] for i in extra.tolist()]])
            fits[v] = logistic(xs[v][rows], target, w=np.concatenate([np.ones(len(fit)), np.full(len(extra), 0.5)]))
        if turn < ROUNDS:
            for v in (0, 1):
                p = _sigmoid(_value(xs[v][free], fits[v]))
                for k in np.flatnonzero((p > SURE) | (p < 1 - SURE)).tolist():
                    given[1 - v][int(free[k])] = float(p[k] > 0.5)
    t.text, t.meta = fits
    z = np.stack([_value(xs[v], fits[v]) for v in (0, 1)], 1)
    t.joint = logistic(z[held], y[held], 0.1) if len(set(y[held])) == 2 else np.array([1.0, 0.0, 0.0])
    return t


FEATURES = "doc_id long, words array<long>, meta array<double>"


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in slices(batch.column("text"), 2_000_000):
            part = batch.slice(at, len(texts))
            doc, words, meta = views(texts, part.column("source"), part.column("lang"))
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64))), pa.array(list(meta), pa.list_(pa.float64()))], ["doc_id", "words", "meta"])
            at += len(texts)


def _inputs(docs: DataFrame) -> DataFrame:
    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(column("text"), F.lit("")).alias("text"), column("source").alias("source"), column("lang").alias("lang"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict[str, Target]:
    """Both targets, fitted on the samples. The views depend on each other as far as layout figures depend on words: the
    documents have no page but their text, source and language. Of several labels of an id the lowest quality and the highest toxicity count; nulls are no labels."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(marks, "doc_id", "left")
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = ids.where(known).orderBy(*order).limit(LABELLED).unionByName(ids.where(~known).orderBy(*order).limit(UNLABELLED))
    # at most LABELLED + UNLABELLED rows of three numbers
    sample = _inputs(docs).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(trimmed(_featurise), FEATURES).join(F.broadcast(picked), "doc_id").toArrow().sort_by("doc_id")
    n = sample.num_rows
    lists = sample.column("words").combine_chunks()
    words = lists.flatten().to_numpy().view(np.uint64) if n else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()) if n else np.empty(0, np.int64)
    meta = np.array(sample.column("meta").to_pylist()).reshape(n, N_META)
    targets = {}
    for name in ("quality", "toxic"):
        y = np.array([np.nan if v is None else float(v) for v in sample.column(name).to_pylist()])
        targets[name] = co_train(y, n, doc, words, meta)
    return targets


def _scorer(targets: dict[str, Target], keep_rows: bool, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            fill = lambda c: pc.fill_null(c.cast(pa.string()), "")
            column = lambda c, b=batch: b.column(c) if c in b.schema.names else pa.nulls(b.num_rows, pa.string())
            for texts in slices(fill(batch.column("text")), 2_000_000):
                doc, words, meta = views(texts, column("source").slice(at, len(texts)), column("lang").slice(at, len(texts)))
                good = targets["quality"].score(len(texts), doc, words, meta)
                toxic = targets["toxic"].score(len(texts), doc, words, meta)
                kept = pa.array((good >= threshold) & (toxic <= 1 - threshold))
                part = batch.slice(at, len(texts))
                at += len(texts)
                if keep_rows:
                    yield part.filter(kept)
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(good), pa.array(toxic), pa.array(good * (1 - toxic)), kept], ["doc_id", "p_quality", "p_toxic", "score", "kept"])

    return run


def score(spark: SparkSession, docs: DataFrame, targets: dict[str, Target], threshold: float = 0.5) -> DataFrame:
    """``doc_id, p_quality, p_toxic, score, kept`` of every row.

    Reads ``doc_id, text, source, lang`` (the last two may be missing or null); other columns are ignored. A null text counts
    as empty; repeated rows are scored alike; without labels of both kinds a target has its share as the score of all,
    without any labels 0.5, and all documents are kept; an empty table gives no rows.
    """
    prepare(spark)
    return _inputs(docs).mapInArrow(trimmed(_scorer(targets, False, threshold)), "doc_id long, p_quality double, p_toxic double, score double, kept boolean")


def good_documents(spark: SparkSession, docs: DataFrame, targets: dict[str, Target], threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with all their columns.

    A null text counts as empty, a null or missing source or language as the empty one; a repeated row is kept or goes with all
    its copies; a score at the threshold is kept; an empty table stays empty.
    """
    prepare(spark)
    return docs.mapInArrow(trimmed(_scorer(targets, True, threshold)), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(spark, docs, fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
