"""Keyed state that expires: first rows, newest rows and a limiter over streams that never end.

Each keeps a few numbers a key and one timer. A timer is set when a key's state begins; when the watermark passes it, the state is
dropped, or, if the key has had rows since, the timer is set anew. Rows older than the watermark are left out by the engine, so what
has expired could not have changed a later result. State is in RocksDB on the executors and its changes in the checkpoint; a lost
executor's part is read from there. Rows without a time are left out; keys may be null; times without a zone are of the session's.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from math import ceil
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.graph import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The column that carries a row's time to the workers as microseconds, whatever the session's zone.
AT = "micros"


class _Expiring(StatefulProcessor):
    """State of a key that is dropped `span` seconds after its latest time, as the watermark has it."""

    state = "latest long"

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)

    def keep(self, values: tuple, latest: int, known: bool) -> None:
        self.kept.update(values)
        if not known:
            self.handle.registerTimer(latest // 1000 + self.span * 1000)

    def latest(self) -> int:
        return self.kept.get()[0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.latest() // 1000 + self.span * 1000 if self.kept.exists() else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Once(_Expiring):
    """Gives a key's earliest row of the batch in which it first appears."""

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.keep((initialState[AT],), initialState[AT], False)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.kept.get()
        before = kept[0] if kept else None
        first, latest = None, before
        for row in rows:
            at = row[AT]
            if first is None or at < first[AT]:
                first = row
            if latest is None or at > latest:
                latest = at
        if latest != before:
            self.keep((latest,), latest, kept is not None)
        # a timer fires after its batch's rows, so that what it would drop is told here
        if before is None or first[AT] > before + self.span * 1_000_000:
            yield first


class _Newest(_Expiring):
    """Gives a key's newest row whenever it isn't older than the newest so far."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.kept.exists()
        at, best = self.latest() if known else None, None
        for frame in rows:
            times = frame[AT].to_numpy()
            place = len(times) - 1 - int(times[::-1].argmax())
            if at is None or times[place] >= at:
                at, best = int(times[place]), frame.iloc[place : place + 1]
        if best is not None:
            self.keep((at,), at, known)
            yield best.drop(columns=AT)


class _Limited(_Expiring):
    """Admits a row if fewer than `limit` admitted ones are within the window on either side of it."""

    state = "latest long, admitted array<long>"

    def __init__(self, limit: int, seconds: int):
        super().__init__(seconds)
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window, known = self.span * 1_000_000, self.kept.exists()
        latest, admitted = self.kept.get() if known else (0, ())
        floor = timerValues.getCurrentWatermarkInMs() * 1000 - window
        admitted = [x for x in admitted if x > floor]
        batch = pd.concat([f[[AT, "c2"]] for f in rows]).sort_values([AT, "c2"], kind="stable")
        ok, retry = [], []
        for t in batch[AT].tolist():
            lo, hi = bisect_right(admitted, t - window), bisect_left(admitted, t + window)
            ok.append(hi - lo < self.limit)
            retry.append(0 if ok[-1] else ceil((admitted[hi - self.limit] + window - t) / 1_000_000))
            if ok[-1]:
                insort(admitted, t)
            latest = max(latest, t)
        self.keep((latest, admitted), latest, known)
        yield pd.DataFrame({"c0": [key[0]] * len(batch), "c2": batch["c2"].to_numpy(), "ok": ok, "retry_after": retry})


def _stamp(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")).alias(AT)


def _stateful(stream: DataFrame, keys: list[str], time: str, late: str, each: StatefulProcessor, schema: str | None = None, begun: DataFrame | None = None) -> DataFrame:
    """Rows of the stream's own columns, or of a schema, by a processor of the keys' rows. Processors see the columns as c0, c1 and so on,
    since Spark hands them over under other names where a name is no identifier."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    known = {c: f"c{i}" for i, c in enumerate(stream.columns)}
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in known.items()], _stamp(time))
    by = [known[k] for k in keys]
    start = begun.toDF(*by, AT).groupBy(*by) if begun is not None else None
    if isinstance(each, _Once):
        # a key has few rows, of which one goes on as it came: frames of a row each would cost more than the state
        out = rows.groupBy(*by).transformWithState(each, rows.schema, "append", "EventTime", start).drop(AT)
    else:
        out = rows.groupBy(*by).transformWithStateInPandas(each, schema or rows.drop(AT).schema, "append", "EventTime", start)
    return out if schema else out.toDF(*stream.columns).withColumn(time, F.col(time).cast(stream.schema[time].dataType))


def once(stream: DataFrame, keys: list[str], time: str, horizon: int, late: str = "1 hour", seen: DataFrame | None = None) -> DataFrame:
    """The first row of each key, and again when a key has had no row for `horizon` seconds. Of several rows of one micro-batch the
    earliest counts. `seen` (keys and time) starts the state: what a target holds already. It is read by the first batch
    alone; no later one reads the target, however large it has grown."""
    begun = seen.where(F.col(time).isNotNull()).select(*keys, _stamp(time)).groupBy(*keys).agg(F.max(AT).alias(AT)) if seen is not None else None
    return _stateful(stream, keys, time, late, _Once(horizon), begun=begun)


def newest(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """A change feed of each key's newest row: a row for every micro-batch in which it changed. Strictly older arrivals are ignored; of
    equal times the last counts. A key's state is one number, dropped as soon as the watermark has passed it: any
    row that comes later is newer."""
    return _stateful(stream, keys, time, late, _Newest(0))


def limited(stream: DataFrame, key: str, time: str, id_col: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, id, ok, retry_after): the sliding limiter. No window of `seconds` ever holds more than `limit` admitted rows of a key, in
    whatever order they come; rows of one micro-batch are taken by time and id. State is a key's admitted times since the
    watermark less the window. A task holds 16 bytes for each row that a key has in one micro-batch, which
    `maxFilesPerTrigger` bounds."""
    if limit < 1 or seconds < 1:
        raise ValueError("a limiter admits at least one row in at least a second")
    kinds = dict(stream.dtypes)
    schema = f"c0 {kinds[key]}, c2 {kinds[id_col]}, ok boolean, retry_after long"
    return _stateful(stream.select(key, time, id_col), [key], time, late, _Limited(limit, seconds), schema).toDF(key, "id", "ok", "retry_after")


def deliver(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a Parquet target, as a folder of its own under the query's; a batch that is run again overwrites what
    it wrote. With `once` before it, results that are delivered again are applied once."""

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{target}/query={query}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives from what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def replayed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files: a pattern, since a stream takes a lone file only by one."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
