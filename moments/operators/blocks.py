"""Cosine distances within sets of any size: all pairs block against block, and greedy groups that vectors stream past.

Of a pair (i < j) the distance is 1 - dot / |i| / |j|, in that order, within 0 and 2. Missing, empty, zero and non-finite
vectors, and those of another length, have no distance, which is NaN here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from moments.operators.groups import kind

c = F.col
#: Vectors of a side of a block, rows that are sent on at once, and vectors that are compared with a selection at once.
BLOCK, OUT_ROWS, STRIP = 2048, 200_000, 256


class Vectors:
    """Rows of a matrix, padded with zeros to the longest, with their length and size (Euclidean; NaN for what can't be compared)."""

    def __init__(self, v: np.ndarray, size: np.ndarray, length: np.ndarray):
        self.v, self.size, self.length = v, size, length

    @classmethod
    def of(cls, lists: pa.Array) -> Vectors:
        length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
        width, flat = int(length.max(initial=0)), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        if (length == width).all():
            v = flat.reshape(len(length), width)
        else:
            v = np.zeros((len(length), width))
            v[np.arange(width) < length[:, None]] = flat
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt((v * v).sum(1))
        return cls(v, np.where(np.isfinite(size) & (size > 0), size, np.nan), length)

    def __len__(self) -> int:
        return len(self.size)

    def take(self, some) -> Vectors:
        return Vectors(self.v[some], self.size[some], self.length[some])

    def distances(self, other: Vectors) -> np.ndarray:
        """A row for each of these, a column for each of the others."""
        width = min(self.v.shape[1], other.v.shape[1])
        with np.errstate(invalid="ignore", over="ignore"):
            d = self.v[:, :width] @ other.v[:, :width].T
            d /= self.size[:, None]
            d /= other.size
            np.subtract(1.0, d, out=d)
            np.clip(d, 0.0, 2.0, out=d)
        if len(self) and len(other) and ((self.length != self.length[0]).any() or (other.length != self.length[0]).any()):
            d[self.length[:, None] != other.length] = np.nan
        return d


class Rows:
    """Vectors that are added one after the other."""

    def __init__(self):
        self.n, self.all = 0, Vectors(np.empty((0, 0)), np.empty(0), np.empty(0, int))

    def put(self, at: int, new: Vectors) -> None:
        """Sets rows from ``at`` on, which may be the next ones."""
        end, width = at + len(new), max(new.v.shape[1], self.all.v.shape[1])
        if end > len(self.all) or width > self.all.v.shape[1]:
            room = max(2 * len(self.all), end, STRIP)
            old, self.all = self.all, Vectors(np.zeros((room, width)), np.full(room, np.nan), np.zeros(room, int))
            for name in ("size", "length"):
                getattr(self.all, name)[: self.n] = getattr(old, name)[: self.n]
            self.all.v[: self.n, : old.v.shape[1]] = old.v[: self.n]
        self.all.v[at:end] = 0.0
        self.all.v[at:end, : new.v.shape[1]] = new.v
        self.all.size[at:end], self.all.length[at:end] = new.size, new.length
        self.n = max(self.n, end)

    def view(self) -> Vectors:
        return self.all.take(slice(0, self.n))


def _parts(df: DataFrame) -> int:
    """Tasks for work that is large for its bytes, which would else be put together again."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """The values of a sorted column with the rows they begin and end at."""
    values = column.to_pylist()
    begin = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[begin]:
            yield values[begin], begin, k
            begin = k


# ---- all pairs -------------------------------------------------------------------------------------------------------


def pair_blocks(df: DataFrame, key: str, fold: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]], schema: str, block: int = BLOCK) -> DataFrame:
    """key and what fold gives for the distances of each two blocks of a set of key, idx, e.

    fold gets the idx of both sides and their distances, NaN for what isn't a pair i < j with a distance, and gives tuples
    of columns of the schema. A set is cut into blocks in order of idx, and a task holds two of them, however large the set is.
    """
    x = df.select(c(key).alias("k"), "idx", "e").where((F.size("e") > 0) & c("idx").isNotNull()).withColumn("n", F.size("e"))
    w = Window.partitionBy("k", "n")
    x = x.withColumn("_b", F.floor((F.row_number().over(w.orderBy("idx")) - 1) / block).cast("int")).withColumn("_m", F.floor((F.count(F.lit(1)).over(w) - 1) / block).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), c("_m"))))
    x = x.select("k", "n", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"), (c("_b") > c("_o")).alias("second"), "idx", "e")
    of_key = kind(x, "k")
    out = to_arrow_schema(_parse_datatype_string(f"k {of_key}, {schema}"))

    def compared(k, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        second, idx = rows["second"].to_numpy(), rows["idx"].to_numpy()
        v, alone = Vectors.of(rows["e"].combine_chunks()), rows["lo"][0].as_py() == rows["hi"][0].as_py()
        a, b = (v, v) if alone else (v.take(~second), v.take(second))
        i, j = (idx, idx) if alone else (idx[~second], idx[second])
        d = a.distances(b)
        if alone or i[-1] >= j[0]:
            d[i[:, None] >= j] = np.nan
        for columns in fold(i, j, d):
            for at in range(0, len(columns[0]), OUT_ROWS):
                some = [pa.array(x[at : at + OUT_ROWS], f.type) for x, f in zip(columns, list(out)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, out[0].type), len(some[0])), *some], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            for g, begin, end in _runs(b.column(0)):
                if held and g != current:
                    yield from compared(current["k"], pa.Table.from_batches(held))
                    held = []
                current = g
                held.append(b.slice(begin, end - begin))
        if held:
            yield from compared(current["k"], pa.Table.from_batches(held))

    group = ["k", "n", "lo", "hi"]
    x = x.repartition(_parts(df), *group).sortWithinPartitions(*group, "idx")
    return x.select(F.struct(*group).alias("g"), "second", "idx", "e", "lo", "hi").mapInArrow(run, f"k {of_key}, {schema}").withColumnRenamed("k", key)


def all_pairs(df: DataFrame, key: str, limit: float | None = None, block: int = BLOCK) -> DataFrame:
    """key, i < j, d: the distances within each set of key, idx, e, those up to limit if there is one. They are as many as its square."""

    def fold(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
        step = max(1, 2_000_000 // max(1, d.shape[1]))
        for at in range(0, len(i), step):
            part = d[at : at + step]
            with np.errstate(invalid="ignore"):
                a, b = np.nonzero(part <= (2.0 if limit is None else limit))
            yield i[at + a], j[b], part[a, b]

    ids = kind(df, "idx")
    return pair_blocks(df, key, fold, f"i {ids}, j {ids}, d double", block)


# ---- greedy groups ---------------------------------------------------------------------------------------------------


def _streamed(df: DataFrame, key: str, order: list[str], make: Callable, schema: str) -> DataFrame:
    """What ``make()`` gives for the rows of each set, which it is fed in order: ``feed(batch)`` and ``end()`` give lists of columns without the key."""
    of_key = kind(df, key)
    out = to_arrow_schema(_parse_datatype_string(f"k {of_key}, {schema}"))

    def batch(k, columns: list) -> pa.RecordBatch:
        some = [pa.array(x, f.type) for x, f in zip(columns, list(out)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, out[0].type), len(some[0])), *some], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current = None, None
        for b in batches:
            for k, begin, end in _runs(b.column(0)):
                if machine is not None and k != current:
                    yield batch(current, machine.end())
                    machine = None
                machine, current = machine or make(), k
                for at in range(begin, end, STRIP):
                    yield batch(k, machine.feed(b.slice(at, min(STRIP, end - at))))
        if machine is not None:
            yield batch(current, machine.end())

    return df.repartition(_parts(df), key).sortWithinPartitions(key, *order).mapInArrow(run, f"k {of_key}, {schema}").withColumnRenamed("k", key)


class _Leaders:
    """Representatives so far; what streams past is compared with them and not kept."""

    def __init__(self, limit: float):
        self.limit, self.rows, self.ids, self.quality = limit, Rows(), [], []

    def feed(self, b: pa.RecordBatch) -> list:
        ids, quality, new = b.column(1).to_pylist(), b.column(2).to_pylist(), Vectors.of(b.column(4))
        m, apart = self.rows.n, new.distances(new)
        d = np.full((len(new), m + len(new)), np.nan)
        d[:, :m] = self.rows.view().distances(new).T
        holder: dict[int, int] = {}
        for k in range(len(new)):
            with np.errstate(invalid="ignore"):
                near = d[k, :m] <= self.limit
            at = int(near.argmax()) if near.any() else m
            if at == m:
                m += 1
                self.ids.append(ids[k])
                self.quality.append(quality[k])
            elif quality[k] is not None and (self.quality[at] is None or quality[k] > self.quality[at]):
                self.ids[at], self.quality[at] = ids[k], quality[k]
            else:
                continue
            holder[at] = k
            d[k + 1 :, at] = apart[k, k + 1 :]
        for at in sorted(holder):
            self.rows.put(at, new.take([holder[at]]))
        return [[], []]

    def end(self) -> list:
        return [self.ids, self.quality]


def leaders(candidates: DataFrame, key: str, limit: float, order: str = "idx") -> DataFrame:
    """key, idx, quality of the representatives of each set of key, idx, quality, e: ``greedy.leader_clusters`` by vectors, for sets of any size.

    A task holds the representatives of a set only.
    """
    if limit < 0:
        return candidates.select(key, "idx", "quality")
    x = candidates.select(key, "idx", c("quality").cast("double").alias("quality"), c(order).alias("o"), "e")
    return _streamed(x, key, ["o", "idx"], lambda: _Leaders(limit), f"idx {kind(x, 'idx')}, quality double")


class _Groups:
    """Vectors of the candidates so far, a row each copy, and the group that each is in."""

    def __init__(self, limit: float):
        self.limit, self.rows, self.groups, self.sizes, self.starts, self.plain = limit, Rows(), [], [], [], True

    def feed(self, b: pa.RecordBatch) -> list:
        ids, copies = b.column(1).to_pylist(), b.column(3)
        count = np.maximum(1, copies.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        lists = pa.array([x or [None] for x in copies.to_pylist()], copies.type) if copies.null_count or (count.sum() != len(copies.flatten())) else copies
        new = Vectors.of(lists.flatten())
        at = np.concatenate([[0], np.cumsum(count)])
        self.plain &= bool((count == 1).all())
        first, m = self.rows.n, len(self.groups)
        self.starts += (first + at[:-1]).tolist()
        self.rows.put(first, new)
        d = self.rows.view().distances(new).T
        starts = np.array(self.starts)
        if not self.plain:  # of several distances of a pair the largest counts
            d = np.fmax.reduceat(np.fmax.reduceat(d, at[:-1], axis=0), starts, axis=1)
        with np.errstate(invalid="ignore"):
            close = np.ascontiguousarray(d <= self.limit)
        room = m + len(ids)
        groups, sizes = np.empty(room, int), np.zeros(len(self.sizes) + len(ids), int)
        groups[:m], sizes[: len(self.sizes)] = self.groups, self.sizes
        used, member = len(self.sizes), []
        for k in range(len(ids)):
            met = np.bincount(groups[: m + k][close[k, : m + k]], minlength=used)
            fits = met == sizes[:used]
            g = int(fits.argmax()) if fits.any() else used
            used += g == used
            sizes[g] += 1
            groups[m + k] = g
            member.append(int(sizes[g]))
        self.groups, self.sizes = groups, sizes[:used]
        return [ids, (groups[m:] + 1).tolist(), member]

    def end(self) -> list:
        return [[], [], []]


def complete_link(ranked: DataFrame, vectors: DataFrame, key: str, limit: float) -> DataFrame:
    """key, idx, grp, member of candidates (key, idx, rank) by vectors (key, idx, e): ``photos.complete_link`` for sets of any size.

    A task holds the vectors of a set and the distances of a few candidates to them; no pairs are kept.
    """
    of = vectors.where(F.size("e") > 0).groupBy(key, "idx").agg(F.collect_list("e").alias("es"))
    x = ranked.select(key, "idx", "rank").join(of, [key, "idx"], "left").select(key, "idx", "rank", "es")
    return _streamed(x, key, ["rank"], lambda: _Groups(limit), f"idx {kind(x, 'idx')}, grp int, member int")
