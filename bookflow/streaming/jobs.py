"""Incremental work as Structured Streaming jobs."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle


def stream_unseen(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """The first row of each key in a stream.

    With `event_time` keys are forgotten `delay` behind the latest event, which bounds the state; without it the
    state grows with the keys, and the RocksDB state store should hold it.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def latest_stages(rows: DataFrame, key: str, stage: str = "stage") -> DataFrame:
    """Of each key the row of the highest stage."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), stage).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def stage_writer(stream: DataFrame, path: str, key: str, stage: str = "stage", every: int = 16) -> DataStreamWriter:
    """Keeps the highest stage of each key in folders below `path`, one for each batch.

    A batch writes its own rows as `part=<batch>`; every so many batches one writes `whole=<batch>`, the state with
    its rows, and folders that the last whole state before it made needless are removed. A batch replaces what a
    failed try of it has left, so it can be repeated. Read the state with `current_stages`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, latest_stages(batch, key, stage)
        if number % every:
            rows.write.mode("overwrite").parquet(f"{path}/part={number}")
            return
        before = current_stages(spark, path, key, stage, number)
        rows = rows if before is None else latest_stages(before.unionByName(rows), key, stage)
        rows.write.mode("overwrite").parquet(f"{path}/whole={number}")
        older = [n for kind, n in _folders(spark, path) if kind == "whole" and n < number]
        for kind, n in _folders(spark, path):
            if older and n < max(older):
                _store(spark, path)[1].delete(_store(spark, f"{path}/{kind}={n}")[0], True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/_checkpoint")


def _store(spark, path: str) -> tuple:
    """A path and its file system, in any store that Spark can read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark, path: str) -> list[tuple[str, int]]:
    """(kind, batch) of the finished folders below `path`."""
    folder, store = _store(spark, path)
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    done = [n for n in names if n.startswith(("part=", "whole=")) and store.exists(_store(spark, f"{path}/{n}/_SUCCESS")[0])]
    return [(n.split("=")[0], int(n.split("=")[1])) for n in done]


def current_stages(spark, path: str, key: str, stage: str = "stage", before: int | None = None) -> DataFrame | None:
    """The state of stages (of batches earlier than `before`): the last whole one with the parts after it; None if there is none."""
    found = [(kind, n) for kind, n in _folders(spark, path) if before is None or n < before]
    base = max((n for kind, n in found if kind == "whole"), default=-1)
    names = [f"{path}/{kind}={n}" for kind, n in found if (kind == "whole" and n == base) or (kind == "part" and n > base)]
    if not names:
        return None
    rows = spark.read.parquet(names[0])
    for name in names[1:]:
        rows = rows.unionByName(spark.read.parquet(name))
    return latest_stages(rows, key, stage)


class Stages(StatefulProcessor):
    """The highest stage of a key as its one value in the state store; a row goes out when it rises."""

    def __init__(self, key: str, stage: str, kept_ms: int | None):
        self.key, self.stage, self.kept_ms = key, stage, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "stage int", self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = max((int(m) for pdf in rows if not pd.isna(m := pdf[self.stage].max())), default=None)
        had = self.best.get()
        if top is not None and (had is None or had[0] < top):
            self.best.update((top,))
            yield pd.DataFrame({self.key: [key[0]], self.stage: [top]})

    def close(self) -> None:
        pass


def rising_stages(stream: DataFrame, key: str, stage: str = "stage", kept: str | None = None) -> DataFrame:
    """(key, stage) whenever a key reaches a higher stage than ever before in a stream.

    A key's state is one number. With `kept` (such as '30 days') it is forgotten so long after its last rise, which
    bounds the state by the keys that rose lately; a key that comes again then begins anew. Rows that come late or
    again with a lower stage change nothing; rows of null stages neither. Start the query within `keyed_state`.
    """
    kinds = dict(stream.dtypes)
    ms = None if kept is None else int(pd.Timedelta(kept).total_seconds() * 1000)
    rows = stream.select(key, F.col(stage).cast("int").alias(stage))
    return rows.groupBy(key).transformWithStateInPandas(Stages(key, stage, ms), f"`{key}` {kinds[key]}, `{stage}` int", "Append", "None" if ms is None else "ProcessingTime")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which keyed state asks for, and make no batches without rows, as a run that should end would make them for ever where state is forgotten by the clock. Others of the session are left as they are."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stream_links(stream: DataFrame, link: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """T3 on a stream: `link` (such as `incremental_links` with its subjects bound) on each batch, written below `path` by batch."""

    def write(batch: DataFrame, number: int) -> None:
        link(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_checkpoint")


def run_available(writer: DataStreamWriter) -> None:
    """Work off what a stream has at hand, and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
