"""Near-duplicate documents by SetSketch registers.

1. Per document the set of word shingles (64-bit hashes) and a sketch of ``M`` registers: the minima of exponentially
   spaced values, truncated to powers of ``BASE``. The minimum of two sketches is the sketch of the union. Documents of
   equal sets are one node from here on, so thousands of copies cost one.
2. Bands of registers are hashed; of each bucket every node is paired with the bucket's first node only. The pairs'
   similarity is estimated by maximum likelihood from the registers that are larger, smaller and equal; pairs within five
   standard errors of the threshold are confirmed on the full sets, and joined into components.
3. Buckets that still hold several components are compared in blocks of sketches, where only pairs of different
   components that pass the estimate leave the task, each from the first bucket it shares, and are confirmed likewise.

To confirm pairs, nodes are dealt into blocks of about ``SET_BYTES``; the pairs of two blocks and the sets they need come
together, so a set goes to as many tasks as there are blocks at most, however many pairs it is in.

At the threshold a pair shares no band with a probability of at most ``MISS``. Components are labelled by repeated
star contraction on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.util import Scratch, pick, text_or_empty, trim_group, trimmed
from moments.llm.words import slices

M = 128
BASE = 1.001
MISS = 1e-5
#: Sketches of one bucket that are compared in one task at a time; larger buckets are cut into blocks of that size.
BLOCK = 1500
#: Sets of one block of nodes, of which two are confirmed in one task at a time.
SET_BYTES = 8 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def band_width(threshold: float) -> int:
    """Most registers a band can have so that pairs at the threshold share one with a probability of 1 - MISS."""
    return max([r for r in range(1, 17) if (1 - threshold**r) ** (M // r) <= MISS], default=1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are cut at ASCII white space, A-Z made small."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = mix(hash_array(known) if len(known) else np.empty(0, _U))
    flat, blank = coded.indices.to_numpy(), known == ""
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    words = hashes[flat]
    keep = ~blank[flat]
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        words = words[keep]
    grams = words.copy()
    for k in range(1, size):
        grams[: len(words) - k] = mix(grams[: len(words) - k] * _U(0x9E3779B97F4A7C15) + words[k:])
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h * _U(0x9E3779B97F4A7C15) + words[k : k + 1])
            out.append(mix(h + _U(b - a)))
        else:
            out.append(np.empty(0, _U))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row each: every element walks up its exponential spacings from register to register until it is above all minima."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    low = np.full((len(sets), M), np.inf)
    h = np.concatenate(sets) if sets else np.empty(0, _U)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = mix(h ^ _U(0xD6E8FEB86659FD93))
    at, step = (order & _U(M - 1)).astype(np.int64), ((order >> _U(16)) & _U(M - 1)).astype(np.int64) | 1
    x = np.zeros(len(h))
    for j in range(M):
        if not len(h):
            break
        u = (mix(h + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(11)).astype(np.float64) * 2.0**-53
        x -= np.log1p(-u) / (M - j)
        np.minimum.at(low.reshape(-1), doc * M + at, x)
        top = low.max(1)
        go = x < top[doc]
        h, doc, at, step, x = h[go], doc[go], (at[go] + step[go]) & (M - 1), step[go], x[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low / 20) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of maximum likelihood given the numbers of larger, smaller and equal registers and the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * c) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def reaches(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Is the similarity of maximum likelihood ``least`` or more? The likelihood has one top, so its slope there tells."""
    u, v = na / (na + nb), nb / (na + nb)
    can = np.minimum(u, v) > least * np.maximum(u, v)
    c = (BASE - 1) / BASE
    x, y = np.where(can, u - v * least, 0.5), np.where(can, v - u * least, 0.5)
    up, down = -np.log1p(-x * c) / np.log(BASE), -np.log1p(-y * c) / np.log(BASE)
    dx, dy = v * c / ((1 - x * c) * np.log(BASE)), u * c / ((1 - y * c) * np.log(BASE))
    return can & ((M - more - less) * (dx + dy) / np.clip(1 - up - down, 1e-12, 1) >= more * dx / up + less * dy / down)


NODE = "struct<k1: long, k2: long>"
SKETCH = f"doc_id long, dh long, n long, node {NODE}, sketch binary"


def _nodes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = [mix(s + _U(0x632BE59BD9B4E019)).sum(dtype=_U) for s in sets]
    two = [mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) for s in sets]
    return np.array(one, _U).view(np.int64), np.array(two, _U).view(np.int64)


def _struct(k1: np.ndarray, k2: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(k1), pa.array(k2)], ["k1", "k2"])


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), 4_000_000):
                sets = shingle_sets(texts, size)
                regs = sketches(sets)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("dh"), pa.array([len(s) for s in sets], pa.int64()), _struct(*_nodes(sets)), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "dh", "n", "node", "sketch"])
                at += len(texts)

    return run


def _set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), 4_000_000):
                # 48 bits of each hash tell the elements of two sets apart but for a chance of 1e-9 a pair
                blobs = [s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in shingle_sets(texts, size)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(texts)), pa.array(blobs, pa.binary())], ["node", "elements"])
                at += len(texts)

    return run


def _elements(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 6, 8), np.uint8)
    raw[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return raw.view(">u8").reshape(-1).astype(_U)


def _estimator(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            go = np.concatenate([estimate(a[k : k + 1024], b[k : k + 1024], na[k : k + 1024], nb[k : k + 1024]) for k in range(0, len(a), 1024)]) >= least if len(a) else np.empty(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(go))

    return run


def _names(column: pa.ChunkedArray) -> list[tuple[int, int]]:
    return list(zip(*(pc.struct_field(column, k).to_pylist() for k in ("k1", "k2")), strict=True))


def _confirmer(percent: int):
    """Of pairs a, b, and the sets of their nodes: those that share ``percent`` of their union."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        out = confirm(pairs, sets)
        trim_group(pairs.nbytes + sets.nbytes)
        return out

    def confirm(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        place = {node: k for k, node in enumerate(_names(sets.column("node")))}
        lists = [_elements(blob) for blob in sets.column("elements").to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        known, flat = np.unique(np.concatenate(lists), return_inverse=True) if lists else (np.empty(0, _U), np.empty(0, np.int64))
        del lists
        starts = np.cumsum(sizes) - sizes
        a, b = (np.array([place[node] for node in _names(pairs.column(c))], np.int64) for c in ("a", "b"))
        go, mine = np.zeros(len(a), bool), np.zeros(len(known), bool)
        order = np.argsort(a, kind="stable")
        for of_one in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else []:
            x = int(a[of_one[0]])
            own = flat[starts[x] : starts[x] + sizes[x]]
            mine[own] = True
            for k in of_one.tolist():
                y = int(b[k])
                both = int(np.count_nonzero(mine[flat[starts[y] : starts[y] + sizes[y]]]))
                go[k] = 100 * both >= percent * (int(sizes[x] + sizes[y]) - both)
            mine[own] = False
        return pairs.select(["a", "b"]).filter(pa.array(go))

    return run


def _bands(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bands = batch.num_rows, M // width
            if not n:
                continue
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(n, M).astype(_U)
            h = np.repeat((np.arange(bands, dtype=_U) + _U(1))[None, :] * _U(0x9E3779B97F4A7C15), n, 0)
            for k in range(width):
                h = mix(h + regs[:, k : bands * width : width])
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int16), n)), batch.column("node").take(pa.array(np.repeat(np.arange(n), bands)))], ["bucket", "band", "node"])

    return run


def _crosser(least: float, width: int):
    """Of one pair of blocks of a bucket: pairs of different components that pass the estimate, have no band before this
    bucket's in common, and don't hold the bucket's head, which all have been compared with."""

    def run(table: pa.Table) -> pa.Table:
        names: dict = {}
        comp = np.array([names.setdefault(c, len(names)) for c in _names(table.column("comp"))])
        regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, M)
        n, block, is_head = (table.column(c).to_numpy() for c in ("n", "block", "is_head"))
        band, lo, hi = (table.column(c)[0].as_py() for c in ("band", "lo", "hi"))
        left, right = np.flatnonzero((block == lo) & ~is_head), np.flatnonzero((block == hi) & ~is_head)
        out: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        for i in left.tolist():
            js = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) > least * np.maximum(n[right], n[i]))]
            if lo == hi:
                js = js[js > i]
            same = regs[js] == regs[i]
            some = same.sum(1) >= least * M / 2
            js, same = js[some], same[some]
            if not len(js):
                continue
            more = (regs[js] < regs[i]).sum(1)
            ok = reaches(more, M - more - same.sum(1), np.repeat(n[i : i + 1], len(js)), n[js], least)
            ok &= ~same[:, : band * width].reshape(len(js), band, width).all(2).any(1)
            out.append(np.stack([np.full(int(ok.sum()), i), js[ok]], 1))
        i, j = np.concatenate(out).T
        node = table.column("node").combine_chunks()
        return pa.table([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"])

    return run


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, comp: for every node of an edge the least node of its component. Large-star and small-star in turns, each round a written table."""
    now, k = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), 0
    # A round that changes nothing leaves as many edges with the same sums of two hashes.
    mark = lambda df: df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64("a", "b", F.lit(n)).cast("decimal(38,0)")) for n in (1, 2)]).first()
    before = mark(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(least.select("a", F.col("low").alias("b"))).distinct()
        after = scratch.write(small, f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        now, k, last, before = after, k + 1, before, mark(after)
        if last == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def labelled(spark: SparkSession, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row per input row: doc_id, dh (hash of the text), n (shingles), component_id, and first: is it by id and text the
    least of its component, or empty? Rows of the same id and text are all first or all not."""
    scratch = Scratch(spark, "neardup")
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / M) ** 0.5
    texts = pick(docs, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("dh", F.xxhash64("text"))
    rows = scratch.write(texts.mapInArrow(trimmed(_sketcher(shingle)), SKETCH), "sketches")
    nodes = scratch.write(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "dh")).alias("of")), "nodes")

    width = band_width(percent / 100)
    banded = nodes.select("node", "sketch").mapInArrow(trimmed(_bands(width)), f"bucket long, band short, node {NODE}")
    banded = scratch.write(banded, "banded")
    heads = banded.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.write(banded.join(heads, "bucket"), "shared")
    scratch.drop("banded")

    sets_made = 0

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        nonlocal sets_made
        sets_made += 1
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "of"), "node").select("node", F.col("of.doc_id").alias("doc_id"), F.col("of.dh").alias("dh"))
        mine = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.dh == wanted.dh)).select("node", "text").dropDuplicates(["node"])
        sets = scratch.write(mine.mapInArrow(trimmed(_set_maker(shingle)), f"node {NODE}, elements binary"), f"sets-{sets_made}")
        total = sets.agg(F.sum(F.octet_length("elements").cast("long"))).first()[0] or 0
        x, y = (F.pmod(F.xxhash64(c), F.lit(total // SET_BYTES + 1)) for c in ("a", "b"))
        dealt = pairs.select("a", "b", F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
        needed = dealt.select(F.col("lo").alias("x"), F.col("hi").alias("y"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").select("x", "y", "node", "elements")
        out = scratch.write(dealt.groupBy("lo", "hi").cogroup(needed.groupBy("x", "y")).applyInArrow(_confirmer(percent), f"a {NODE}, b {NODE}"), name)
        scratch.drop(f"sets-{sets_made}")
        return out

    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    with_sketches = stars.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    likely = scratch.write(with_sketches.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_estimator(least)), f"a {NODE}, b {NODE}"), "likely")
    edges = confirmed(likely, "edges-1")
    comps = scratch.write(components(scratch, edges, "cc1"), "comps-1")

    label = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = label.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket")
    left = label.join(mixed, "bucket").join(nodes.select("node", "n", "sketch"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = left.withColumn("blocks", blocks).withColumn("block", mine).select("bucket", "band", "node", (F.col("node") == F.col("head")).alias("is_head"), "comp", "n", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    # the estimate of stars is on a grid of half a hundredth
    crossed = scratch.write(spread.groupBy("bucket", "lo", "hi").applyInArrow(_crosser(least - 0.005, width), f"a {NODE}, b {NODE}"), "crossed")
    if not crossed.isEmpty():
        edges = edges.unionByName(confirmed(crossed, "edges-2"))
        comps = scratch.write(components(scratch, edges, "cc2"), "comps-2")

    named = nodes.join(comps, "node").groupBy("comp").agg(F.min("of").alias("best"))
    of_node = nodes.join(comps, "node", "left").join(named, "comp", "left").select("node", F.coalesce("best", "of").alias("best"))
    out = rows.select("doc_id", "dh", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    first = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("dh") == F.col("best.dh")))
    return out.select("doc_id", "dh", "n", component.alias("component_id"), first.alias("first"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """Components of documents whose shingle sets reach ``percent`` of their union in common.

    Reads ``doc_id, text``; other columns are ignored. One row per input row, repeated ids included: ``doc_id,
    n_shingles, component_id`` (the smallest id of the component) and ``kept``. Fewer words than a shingle are one
    shingle together; a null text, or one without words, is empty and stands alone. A null id counts as larger than
    any; an empty table gives no rows.
    """
    out = labelled(spark, docs, shingle, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
