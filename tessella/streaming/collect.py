"""Result files as a stream: applied once per key, whatever is delivered again; plus late rows and limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def results_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of JSON files as they appear; malformed and summary lines are left out."""
    rows = spark.readStream.schema(f"{schema}, summary boolean").option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)
    return rows.where(~F.coalesce("summary", F.lit(False))).drop("summary")


#: Targets are laid out by so many hashes of their keys, so that a batch reads again what has its own.
KEY_BUCKETS = 256


def apply_once(stream: DataFrame, keys: list[str], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to a Parquet target the rows whose keys it lacks. The checkpoint is the cursor; each batch writes its
    own subfolder, so a batch that is run again overwrites what it wrote. Of the target only the key buckets that a batch has
    rows of are read."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys).withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int"))
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            some = [r[0] for r in fresh.select("key_bucket").distinct().collect()]
            schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, batch long, key_bucket int"
            done = spark.read.option("basePath", target).schema(schema).parquet(target).where((F.col("batch") != number) & F.col("key_bucket").isin(some))
            fresh = fresh.join(done.select(*keys).distinct(), keys, "left_anti")
        fresh.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_lines(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Per key the newest row so far; strictly older arrivals are ignored. The watermark is an addition of this
    library: it bounds the state that windows downstream keep."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.withWatermark(time, late).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(time)).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}") for c in rest])


def limited(stream: DataFrame, key: str, time: str, limit: int, seconds: int = 3600) -> DataFrame:
    """The exact sliding limiter as a stateful stream: state is the admitted times of the trailing window."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for t in rows[time].astype("datetime64[us]").astype("int64") / 1e6:
            kept = [x for x in kept if x > t - seconds]
            ok = len(kept) < limit
            if ok:
                kept.append(float(t))
            out.append((k[0], pd.Timestamp(t, unit="s"), ok))
        state.update((kept,))
        yield pd.DataFrame(out, columns=[key, time, "ok"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, time).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, ok boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside run in a pool of Spark's fair scheduler (spark.scheduler.mode=FAIR; weights and least shares are the
    cluster's allocation file), so that a page someone waits for isn't behind a batch."""
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)


@dataclass
class Job:
    """A pluggable batch job: what to select, how to map it (pandas batches), where it goes. `keys` name a row when it fails."""

    name: str
    select: Callable[[SparkSession], DataFrame]
    run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    schema: str
    write: Callable[[DataFrame], None]
    keys: tuple[str, ...] = ()

    def go(self, spark: SparkSession, chunk_rows: int = 50) -> None:
        """Hands rows over in chunks. Where a chunk fails its rows are tried one by one, so that a row's failure is its own: it
        becomes a row of its keys, nulls and `error`. A run may also set `error` itself."""
        run, keys = self.run, self.keys
        names = [f.name for f in StructType.fromDDL(self.schema).fields]

        def shaped(out: pd.DataFrame) -> pd.DataFrame:
            # Pandas may keep texts in Arrow chunks, which Spark doesn't take
            return out.reindex(columns=[*names, "error"]).astype({"error": object})

        def tried(rows: pd.DataFrame) -> list[pd.DataFrame]:
            try:
                return [shaped(x) for x in run(iter([rows]))]
            except Exception as e:
                if len(rows) > 1:
                    return [x for i in range(len(rows)) for x in tried(rows.iloc[i : i + 1])]
                return [shaped(rows[[k for k in keys if k in names]].assign(error=f"{type(e).__name__}: {e}"))]

        def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), chunk_rows):
                    yield from tried(b.iloc[lo : lo + chunk_rows])

        self.write(self.select(spark).mapInPandas(chunks, f"{self.schema}, error string"))


REGISTRY: dict[str, Job] = {}


def register(job: Job) -> Job:
    REGISTRY[job.name] = job
    return job


def pending(inbox: DataFrame, completed: DataFrame, ref: str = "ref") -> DataFrame:
    return inbox.join(completed.select(ref).distinct(), ref, "left_anti")


def resumable(queue: DataFrame, priority: list[str]) -> DataFrame:
    """Unfinished jobs by a fixed priority of their kind, then by name."""
    from ..operators.paging import priority as rank

    return queue.where("status <> 'done'").orderBy(rank("kind", priority), "name")
