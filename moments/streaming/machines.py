"""The state machines on streams: one keyed state each, kept as the machine's own text, so a restart goes on where it was.

Rows of a key are taken in time order within a batch. A row that comes later than a row of an earlier batch is a step back
in time, which the pose machines take as a break, as they do in batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from moments.operators import machines as M

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Machine(StatefulProcessor):
    def __init__(self, key: str, columns: tuple[str, ...], make: Callable, out: list[str]):
        self.key, self.columns, self.make, self.out = key, columns, make, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", StructType().add("text", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(rows).sort_values(["t", "id"])
        kept = self.state.get() if self.state.exists() else None
        machine = self.make()
        if kept:
            machine = type(machine).load(kept[0])
        got = [machine.observe(*v) for v in zip(*(x[n].tolist() for n in self.columns), strict=True)]
        self.state.update((machine.dump(),))
        yield pd.concat([pd.DataFrame({self.key: key[0], "id": x["id"].tolist(), "t": x["t"].tolist()}), pd.DataFrame(got, columns=self.out)], axis=1)

    def close(self) -> None:
        pass


class _Trigger(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trigger", StructType().add("text", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(rows).sort_values(["t", "ord", "id"])
        machine, out = M.Trigger(self.state.get()[0] if self.state.exists() else None), []
        for t, i, kind, a in x[["t", "id", "kind", "a"]].itertuples(index=False):
            if fired := machine.step(kind, t, [float(v) for v in a]):
                out.append((key[0], fired[0], i, t, fired[1]))
        self.state.update((machine.dump(),))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "kind", "id", "t", "confidence"])

    def close(self) -> None:
        pass


def _transform(stream: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = _parse_datatype_string(f"{key} {stream.schema[key].dataType.simpleString()}, {out}")
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")


def _signals(stream: DataFrame, key: str, columns: tuple[str, ...], make: Callable, out: str) -> DataFrame:
    names = [x.split()[0] for x in out.split(", ")]
    plain = [f"v{k}" for k in range(len(columns))]  # names that no language keeps for itself
    rows = stream.select(key, "id", "t", *[F.col(n).alias(v) for n, v in zip(columns, plain, strict=True)])
    return _transform(rows, key, _Machine(key, tuple(plain), make, names), f"id long, t double, {out}")


def motion_stream(stream: DataFrame, key: str) -> DataFrame:
    return _signals(stream, key, M.MOTION_COLUMNS, M.Motion, M.MOTION_OUT)


def swing_stream(stream: DataFrame, key: str) -> DataFrame:
    return _signals(stream, key, M.POSE_COLUMNS, M.Swing, M.SWING_OUT)


def putt_stream(stream: DataFrame, key: str) -> DataFrame:
    return _signals(stream, key, M.POSE_COLUMNS, M.Putt, M.PUTT_OUT)


def body_stream(stream: DataFrame, key: str) -> DataFrame:
    return _signals(stream, key, M.POSE_COLUMNS, M.Body, "tracked boolean")


def trigger_stream(rows: DataFrame, key: str) -> DataFrame:
    """What fires of the unioned inputs of ``machines.trigger_rows``."""
    return _transform(rows, key, _Trigger(key), M.TRIGGER_OUT)


def finish(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, into a table under a folder that all executors see, and gives the table."""
    spark: SparkSession = stream.sparkSession
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")
