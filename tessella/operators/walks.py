"""Walks in order of time that no key's size can stop: sessions by gaps, then a stream through each session in bounded memory.

Rows are range-sorted by key, time and id, so that a key with most of the rows is many tasks. Each task numbers its sessions, in
which no two neighbours are further apart than a gap; where a task's first row goes on with the last session of the task before,
both get one number (the driver sees a first and a last row of each task, no more). What a walk decides never reaches over such a
gap. So sessions are then dealt to tasks, sorted, and streamed: a task holds the rows of one window, or the hits that still count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept_table

#: Sessions of a task are numbered from its number times this on.
_TASK = 1 << 33


def micros(df: DataFrame, time: str) -> Column:
    """A time as microseconds; numbers are taken as they are."""
    kind = dict(df.dtypes)[time]
    return F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(time).cast("long")


def sessions(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """rows (keys, t, id, ...) with `session`: the same for neighbours by t of one key at most `gap` apart, and for no others."""
    order = [*keys, "t", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    places = [rows.columns.index(c) for c in (*keys, "t")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = TaskContext.get().partitionId() * _TASK, None
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for i, (*key, t) in enumerate(zip(*(b.column(k).to_pylist() for k in places))):
                if last is not None and (last[0] != key or t - last[1] > gap):
                    session += 1
                out[i], last = session, (key, t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "session"])

    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", session long"
    found = kept_table(ranged.mapInArrow(number, schema), "sessions")
    ends = found.groupBy(F.floor(F.col("session") / _TASK).alias("task")).agg(F.min(F.struct(*keys, "t", "session")).alias("first"), F.max(F.struct(*keys, "t", "session")).alias("last"))
    root: dict[int, int] = {}
    before = None
    for r in sorted(ends.collect(), key=lambda r: r.task):  # a row for each task
        key = [r.first[k] for k in keys]
        if before is not None and [before[k] for k in keys] == key and r.first["t"] - before["t"] <= gap:
            root[r.first["session"]] = root.get(before["session"], before["session"])
        before = r.last
    if not root:
        return found
    joined = F.broadcast(rows.sparkSession.createDataFrame(list(root.items()), "session long, root long"))
    return found.join(joined, "session", "left").withColumn("session", F.coalesce("root", "session")).select(*found.columns)


def streamed(rows: DataFrame, walk, schema: str) -> DataFrame:
    """`walk` over rows of whole sessions, in order of session, t and id."""
    return rows.repartition("session").sortWithinPartitions("session", "t", "id").mapInArrow(walk, schema)


def burst_walk(window: int, least: int, most_bits: int):
    """Over rows (session, t, id[, limbs]): the rows within `window` of an anchor are a burst if they are enough and any two of them
    are close; then the next row is the anchor, else the row after the anchor."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, held, out = None, deque(), []  # held: (t, id, limbs, number of the last earlier row that is far from this)
        count = 0

        def settle(now: int | None) -> None:
            """Decides about anchors whose window is over."""
            while held and (now is None or now - held[0][0] > window):
                first = count - len(held)
                n = next((i for i, r in enumerate(held) if r[0] - held[0][0] > window), len(held))
                group = [held[i] for i in range(n)]
                if n >= least and max(r[3] for r in group) < first:
                    out.extend((r[1], group[0][1], n, (group[-1][0] - group[0][0]) / 1e6) for r in group)
                    for _ in range(n):
                        held.popleft()
                else:
                    held.popleft()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["id", "burst", "size", "span"])

        for b in batches:
            limbs = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            for own, t, i, h in zip(*(b.column(k).to_pylist() for k in range(3)), limbs):
                if own != session:
                    settle(None)
                    session = own
                settle(t)
                far = -1
                if h is not None:
                    h = np.array(h, np.int64).view(np.uint64)
                    if held:
                        bits = np.bitwise_count(np.stack([r[2] for r in held]) ^ h).sum(axis=1)
                        apart = np.flatnonzero(bits > most_bits)
                        far = count - len(held) + int(apart[-1]) if len(apart) else -1
                held.append((t, i, h, far))
                count += 1
            yield batch()
        settle(None)
        yield batch()

    return walk


def limit_walk(limit: int, seconds: int):
    """Over rows (session, t, id, key): a hit is admitted if fewer than `limit` admitted ones lie in the trailing window."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, kept = None, deque()
        for b in batches:
            ok, after = [], []
            for own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != session:
                    session = own
                    kept.clear()
                x = t / 1e6
                while kept and kept[0] <= x - seconds:
                    kept.popleft()
                ok.append(len(kept) < limit)
                after.append(0 if ok[-1] else int(-(-(kept[0] + seconds - x) // 1)))
                if ok[-1]:
                    kept.append(x)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(2), pa.array(ok, pa.bool_()), pa.array(after, pa.int64())], ["key", "id", "ok", "retry_after"])

    return walk
