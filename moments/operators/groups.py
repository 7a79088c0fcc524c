"""Python over groups that are small and many: groups stream past in sorted order, without a frame or a call for each one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

OUT_ROWS = 5000


def many(df: DataFrame) -> int:
    """Tasks for a sort of the widest rows, so that each holds little of them whatever the session's number is."""
    return 16 * df.sparkSession.sparkContext.defaultParallelism


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[tuple]], list[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """The rows that fn gives for each group's rows.

    fn gets a group's rows as tuples of df's columns, sorted by ``order``, and gives tuples of the schema. A group is held
    whole, so it has to be bounded by what it means: a stretch of a recording, one selection. ``parts`` is the number of tasks,
    where the session's would sort too many rows each.
    """
    at = [df.columns.index(k) for k in keys]
    out = to_arrow_schema(_parse_datatype_string(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        made: list[tuple] = []
        current = None
        for b in batches:
            for row in zip(*(column.to_pylist() for column in b.columns), strict=True):
                key = [row[k] for k in at]
                if group and key != current:
                    made += fn(group)
                    group = []
                    if len(made) >= OUT_ROWS:
                        yield batch(made)
                        made = []
                current = key
                group.append(row)
        if group:
            made += fn(group)
        if made:
            yield batch(made)

    return df.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
