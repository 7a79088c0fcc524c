"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, too.

1. Every window of LENGTH bytes picks an anchor in it, the gram of ``GRAM`` bytes of the least hash. Equal windows pick
   equal anchors, so windows can only repeat within the places of one anchor. A place owns the run of windows that pick
   it; the bytes under that run are its segment.
2. Places of a repeated anchor are put into classes of equal segments. A class of two or more places repeats wholly, and
   needs no text; so groups of copies cost one row a class.
3. Where an anchor has several classes, one segment of each goes into a shard of whole anchors. A shard's suffix array is
   built by induced sorting: suffixes are classified, the leftmost-smaller (LMS) substrings are sorted by induction and
   named, the string of names is sorted in turn by doubling of ranks, and all suffixes are induced from there,
   bucket by bucket. Permuted common prefixes of LENGTH or more mark the windows that repeat.
   An anchor whose segments outgrow a shard is counted window by window instead, by hashes, in a distributed way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.decontam import keyed
from moments.llm.neardup import mix
from moments.llm.util import Scratch

LENGTH, GRAM = 400, 64
SHARD_BYTES = 6_000_000
SLICE_BYTES = 400_000
PIECE_BYTES = 8_000_000

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_T1, _T2, _T3 = (_RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _RNG.integers(0, 2, 256).astype(_U) for _ in range(3))
_ODD = [_U(int(x) | 1) for x in _RNG.integers(1 << 40, 1 << 63, 8)]
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_POS_BITS = 24


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


class SpanHash:
    """Hashes of spans of a byte array from sums over its prefixes."""

    _known: dict = {}

    def __init__(self, b: np.ndarray, table: np.ndarray, base: np.uint64):
        if len(self._known.get(base, ((),))[0]) <= len(b):
            n = max(1 << 20, len(b) + 1)
            SpanHash._known[base] = (_powers(base, n), _powers(_inverse(base), n))
        up, self.down = self._known[base]
        self.sums = np.zeros(len(b) + 1, _U)
        np.cumsum(table[b] * up[: len(b)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def anchors(b: np.ndarray, edges: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts laid end to end (``edges``: where each begins, and the end): text, first window, windows, anchor hash and segment hash of each place."""
    n = len(b)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    h, width, k = _T1[b], 1, 0
    while width < gram:
        h = h[:-width] * _ODD[k] + h[width:]
        width, k = 2 * width, k + 1
    h = mix(h)
    v = (h >> _U(_POS_BITS) << _U(_POS_BITS)) | np.arange(len(h), dtype=_U)
    span, reach, m = length - gram + 1, 1, v
    while 2 * reach <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < span:
        m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
    at = (m & _U((1 << _POS_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(at)]
    ok = np.arange(len(at)) + length <= edges[doc + 1]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    count = np.add.reduceat(ok.astype(np.int64), first)
    seg = SpanHash(b, _T2, _BASE).of(first, first + count + length - 1)
    return doc[first], first - edges[doc[first]], count, h[at[first]].view(np.int64), seg.view(np.int64)


PLACE = "key long, seg long, size int, dk long, dh long, lo long"


def _placer(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b, edges, dk, dh, shift):
            doc, lo, size, key, seg = anchors(b, edges, length, gram)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.array(size.astype(np.int32)), pa.array(dk[doc]), pa.array(dh[doc]), pa.array(lo + shift)], ["key", "seg", "size", "dk", "dh", "lo"])

        for batch in batches:
            text, dk, dh = batch.column("text"), batch.column("dk").to_numpy(), batch.column("dh").to_numpy()
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            edges = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset).astype(np.int64)
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + SLICE_BYTES, "right")) - 1)
                if edges[j] - edges[i] > PIECE_BYTES:  # one very long text: stretches of windows
                    for at in range(int(edges[i]), int(edges[j]), PIECE_BYTES):
                        b = data[at : min(int(edges[j]), at + PIECE_BYTES + length - 1)]
                        yield out(b, np.array([0, len(b)]), dk[i:j], dh[i:j], at - int(edges[i]))
                else:
                    yield out(data[edges[i] : edges[j]], edges[i : j + 1] - edges[i], dk[i:j], dh[i:j], 0)
                i = j

    return run


# ---- suffix arrays -------------------------------------------------------------------------------------------


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and where leftmost-smaller ones begin. s ends with a unique 0."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int32) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(at, n - 2)] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, lms


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the order given."""
    n, letters = len(s), int(s.max()) + 1
    sizes = np.bincount(s, minlength=letters)
    head, tail = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    sa = np.full(n, -1, np.int32)
    letter = s[lms]
    by = np.argsort(letter, kind="stable")
    marks = np.bincount(letter, minlength=letters)
    ends = np.cumsum(marks)
    sorted_lms = lms[by].astype(np.int32)
    fill = head.copy()

    def place(j: np.ndarray, up: bool) -> None:
        c = s[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        counts = np.diff(first, append=len(c))
        rank = np.arange(len(c)) - np.repeat(first, counts)
        heads = c[first]
        if up:
            sa[fill[c] + rank] = j
            fill[heads] += counts
        else:
            sa[fill[c] - 1 - rank] = j
            fill[heads] -= counts

    for c in np.flatnonzero(sizes).tolist():
        done = head[c]
        while done < fill[c]:
            now = sa[done : fill[c]]
            done = fill[c]
            j = now[now > 0] - 1
            j = j[~smaller[j]]
            if len(j):
                place(j, True)
        if marks[c]:
            j = sorted_lms[ends[c] - marks[c] : ends[c]] - 1
            j = j[(j >= 0)]
            if len(j):
                place(j, True)
    larger_end = fill
    fill = tail.copy()
    sa[0] = n - 1  # the end itself is the least suffix
    for c in np.flatnonzero(sizes)[::-1].tolist():
        done = tail[c]
        while done > fill[c]:
            now = sa[fill[c] : done][::-1]
            done = fill[c]
            j = now[now > 0] - 1
            j = j[smaller[j]]
            if len(j):
                place(j, False)
        now = sa[head[c] : larger_end[c]][::-1]
        if c == 0:
            now = np.array([n - 1], np.int32)
        j = now[now > 0] - 1
        j = j[smaller[j]]
        if len(j):
            place(j, False)
    sa[0] = n - 1
    return sa


def sort_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string over a large alphabet in order, by doubling; it ends with a unique least letter."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        pair = rank * (n + 2) + nxt
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.diff(pair[order], prepend=pair[order[0]]) != 0)
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of s, in order. s: small numbers, the last one 0 and the only 0."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    smaller, lms = classify(s)
    order = induce(s, smaller, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # Names: neighbours in this order differ if their substrings, up to and with the next LMS place, do.
    place = np.empty(len(s), np.int64)
    place[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], len(s) - 1)
    size = (ends - lms)[place[order]]
    differ = np.ones(len(order), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    a, b, left = order[same - 1].astype(np.int64), order[same].astype(np.int64), size[same]
    equal, live, k = np.ones(len(same), bool), np.arange(len(same)), 0
    while len(live):
        hit = s[a[live] + k] == s[b[live] + k]
        equal[live[~hit]] = False
        live = live[hit]
        live = live[left[live] > k]
        k += 1
    differ[same[equal]] = False
    if len(order) > 1 and order[0] == len(s) - 1:
        differ[1] = True
    names = np.empty(len(lms), np.int64)
    names[place[order]] = np.cumsum(differ) - 1
    if len(lms) > 1 and names.max() + 1 < len(lms):
        lms = lms[sort_names(names)]
    else:
        lms = order
    return induce(s, smaller, np.asarray(lms, np.int64))


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the one before it in order (-1: none), and how many letters they have in common."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    # reducible: the letters in front are equal, too, so the pair one place to the left has one more in common
    whole = (before > 0) & (i > 0)
    reducible = np.zeros(n, bool)
    reducible[whole] = (s[i[whole] - 1] == s[before[whole] - 1]) & (before[i[whole] - 1] == before[whole] - 1)
    start = np.flatnonzero(~reducible)
    lcp = np.zeros(n, np.int64)
    live = start[before[start] >= 0]
    k = 0
    while len(live):
        p, q = live + k, before[live] + k
        ok = (p < n) & (q < n)
        live, p, q = live[ok], p[ok], q[ok]
        live = live[s[p] == s[q]]
        k += 1
        lcp[live] = k
    anchor = np.maximum.accumulate(np.where(~reducible, i, 0))
    return before, np.where(reducible, np.maximum(0, lcp[anchor] - (i - anchor)), lcp)


def repeated_windows(segments: list[bytes], length: int) -> np.ndarray:
    """Of the segments laid end to end, a 0 after each: which places start a string of ``length`` bytes that starts elsewhere, too."""
    parts = [np.frombuffer(x, np.uint8).astype(np.int16) + 2 for x in segments]
    s = np.concatenate([y for p in parts for y in (p, np.array([1], np.int16))] + [np.zeros(1, np.int16)])
    sa = suffix_array(s)
    before, lcp = permuted_prefixes(s, sa)
    room = np.full(len(s), 0, np.int64)
    ends = np.flatnonzero(s == 1)
    at = np.searchsorted(ends, np.arange(len(s)))
    room = np.where(at < len(ends), ends[np.minimum(at, len(ends) - 1)] - np.arange(len(s)), 0)
    hit = np.flatnonzero((lcp >= length) & (room >= length))
    out = np.zeros(len(s), bool)
    out[hit] = True
    out[before[hit]] = True
    return out


FOUND = "key long, seg long, size int, runs array<struct<a: int, b: int>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": a, "b": b} for a, b in edge.reshape(-1, 2).tolist()]


def _sorter(length: int):
    def run(table: pa.Table) -> pa.Table:
        segments = table.column("bytes").to_pylist()
        flags = repeated_windows(segments, length)
        at, runs = 0, []
        for x, size in zip(segments, table.column("size").to_pylist(), strict=True):
            runs.append(_runs(flags[at : at + size]))
            at += len(x) + 1
        return pa.table([table.column("key"), table.column("seg"), table.column("size"), pa.array(runs, _RUNS)], ["key", "seg", "size", "runs"])

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = np.frombuffer(batch.column("bytes")[k].as_py(), np.uint8)
                lo = np.arange(len(b) - length + 1)
                w = [SpanHash(b, t, base).of(lo, lo + length).view(np.int64) for t, base in ((_T2, _BASE), (_T3, _BASE2))]
                one = [pa.array(np.full(len(lo), batch.column(c)[k].as_py())) for c in ("key", "seg")]
                yield pa.RecordBatch.from_arrays([*one, pa.array(np.full(len(lo), batch.column("size")[k].as_py(), np.int32)), pa.array(w[0]), pa.array(w[1]), pa.array(lo.astype(np.int32))], ["key", "seg", "size", "w1", "w2", "at"])

    return run


def spans(spark: SparkSession, texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """dk, dh, a, b: stretches of bytes to remove from each text (dk, dh, text); they may touch and overlap."""
    places = scratch.write(texts.select("dk", "dh", "text").mapInArrow(_placer(length, gram), PLACE), "places")
    keys = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), ((F.min("seg") != F.max("seg")) | (F.min("size") != F.max("size"))).alias("mixed")).where("n > 1").select("key", "mixed")
    again = scratch.write(places.join(keys, "key"), "again")
    scratch.drop("places")
    classes = scratch.write(again.groupBy("key", "seg", "size", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dk", "dh", "lo")).alias("of")), "classes")
    wanted = classes.where("mixed").select("key", "seg", "size", "of.dk", "of.dh", "of.lo")
    raw = texts.select("dk", "dh", "text").join(wanted, ["dk", "dh"]).select("key", "seg", "size", F.encode("text", "UTF-8").alias("t"), "lo")
    segments = raw.select("key", "seg", "size", F.expr(f"substring(t, cast(lo + 1 as int), size + {length - 1})").alias("bytes")).dropDuplicates(["key", "seg", "size"])
    segments = scratch.write(segments, "segments")
    heavy = segments.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("b")).where(F.col("b") > shard_bytes).select("key")
    heavy = scratch.write(heavy, "heavy")
    total = segments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = 1 + total * 2 // shard_bytes
    light = segments.join(heavy, "key", "left_anti").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = light.groupBy("shard").applyInArrow(_sorter(length), FOUND)
    if not heavy.isEmpty():
        windows = segments.join(heavy, "key", "left_semi").mapInArrow(_window_hashes(length), "key long, seg long, size int, w1 long, w2 long, at int")
        twice = windows.groupBy("key", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ones = windows.join(twice, ["key", "w1", "w2"]).groupBy("key", "seg", "size").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))
        found = found.unionByName(ones)
    found = scratch.write(found, "found")
    marked = classes.where("n > 1").select("key", "seg", "size", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("runs"))
    single = classes.where("n = 1").select("key", "seg", "size").join(found.where("size(runs) > 0"), ["key", "seg", "size"])
    runs = again.join(marked.unionByName(single), ["key", "seg", "size"]).select("dk", "dh", "lo", F.explode("runs").alias("r"))
    return runs.select("dk", "dh", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b") + length - 1).alias("b"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cutter(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
                data, kept, at, runs, end = text.as_buffer(), [], 0, 0, -1
                data = memoryview(data) if data is not None else memoryview(b"")
                for c in sorted(cuts or [], key=lambda c: (c["a"], c["b"])):
                    if c["a"] > end:
                        runs += 1
                        kept.append(data[at : c["a"]])
                    end = max(end, c["b"])
                    at = end
                kept.append(data[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns.append(pa.array(out[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, with_bytes: bool = False) -> DataFrame:
    """Removes each byte under a string of ``length`` bytes that starts anywhere else in the texts, too.

    Reads ``doc_id, text`` (UTF-8; null: empty) and ignores other columns. One row per input row, repeated ids included:
    ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` and, if asked for, ``kept``, which may
    be cut within a character. Texts shorter than ``length`` stay whole, repeated or not; an empty table gives no rows.
    ``gram`` is a power of two below ``length``.
    """
    scratch = Scratch(spark, "suffixes")
    texts = keyed(docs)
    # touching stretches merge when they are cut; a text has at most one per window
    cuts = spans(spark, texts, scratch, length, gram, shard_bytes).groupBy("dk", "dh").agg(F.collect_set(F.struct("a", "b")).alias("cuts"))
    cuts = scratch.write(cuts, "cuts")
    return texts.join(cuts, ["dk", "dh"], "left").select("doc_id", "text", "cuts").mapInArrow(_cutter(with_bytes), RESULT + (", kept binary" if with_bytes else ""))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
