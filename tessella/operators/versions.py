"""Versioned tables: an upsert writes its own rows and a delete vector, undo is an old version, two writers conflict.

A table is a list of parts (Parquet folders of rows) and, for each, delete vectors: the files and row numbers in it that later
commits replaced. A change reads the key columns of the table, and the other columns of the rows it may replace; it writes the
changed rows and the places of what they replace. Reading takes these places out by an equi-join on file and row number, and
only of parts that have any.

Keys identify a row; null keys are equal to each other. Of changes with one key the last by `newer` is taken (any of them, where
there is no such column). Columns are those of the first version; changes must have them all, and what else they have is ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import Snapshots

_PLACE = ("__file", "__row")


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.keys, self.log = spark, keys, Snapshots(spark, root)

    def create(self, df: DataFrame) -> int:
        """The first version."""
        part = self.log.new_part()
        df.write.parquet(part)
        return self.log.commit(None, {"schema": df.schema.json(), "parts": [{"path": part, "gone": []}], "what": "create", "rows": None})

    def _part(self, part: dict, schema: T.StructType, places: bool = False) -> DataFrame:
        """The live rows of a part, with their places if asked."""
        rows = self.spark.read.schema(schema).parquet(part["path"])
        if part["gone"] or places:
            # the name of a file is unique in its part; the row number is its place in the file, whatever is read of it
            rows = rows.select("*", F.col("_metadata.file_name").alias(_PLACE[0]), F.col("_metadata.row_index").alias(_PLACE[1]))
        if part["gone"]:
            rows = rows.join(self.spark.read.schema(f"{_PLACE[0]} string, {_PLACE[1]} long").parquet(*part["gone"]), list(_PLACE), "left_anti")
        return rows if places else rows.select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given."""
        state = self.log.read(version)
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        return reduce(DataFrame.unionByName, [self._part(p, schema) for p in state["parts"]])

    def _change(self, changes: DataFrame, kept: DataFrame | None, newer: str | None, what: str, base: int | None) -> int:
        base = self.log.latest() if base is None else base
        state = self.log.read(base)
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        looked = [*self.keys, *([newer] if newer and newer not in self.keys else [])]
        wanted = changes.select(*[F.col(c).alias(f"__w_{c}") for c in looked])
        same: Column = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in self.keys])
        slim = T.StructType([schema[c] for c in looked])
        parts, refused = [], []
        for p in state["parts"]:
            met = self._part(p, slim, places=True).join(wanted, same)
            late = F.coalesce(F.col(f"__w_{newer}") <= F.col(newer), F.lit(False)) if newer else F.lit(False)
            gone = self.log.new_part()
            met.where(~late).select(*_PLACE).write.parquet(gone)
            some = not self.spark.read.parquet(gone).isEmpty()
            parts.append({"path": p["path"], "gone": p["gone"] + [gone] * some})
            refused.append(met.where(late).select(*[F.col(f"__w_{k}") for k in self.keys]))
        if kept is not None:
            own = self.log.new_part()
            rows = kept.select(*schema.names)
            if newer:
                out = reduce(DataFrame.unionByName, refused)
                rows = rows.join(out, same, "left_anti")
            rows.write.parquet(own)
            if not self.spark.read.schema(schema).parquet(own).isEmpty():
                parts.append({"path": own, "gone": []})
        return self.log.commit(base, {"schema": state["schema"], "parts": parts, "what": what})

    def upsert(self, changes: DataFrame, newer: str | None = None, base: int | None = None) -> int:
        """Replaces rows by changes of their key and adds the others; with `newer`, only where a change is later than the row.
        base: the version that the changes were made from, the last one if none is given."""
        if newer:
            last = F.max_by(F.struct(*changes.columns), F.struct(F.col(newer).isNotNull(), newer))
        else:
            last = F.first(F.struct(*changes.columns))
        one = changes.groupBy(*[F.col(k).alias(f"__g_{k}") for k in self.keys]).agg(last.alias("__c")).select("__c.*")
        part = self.log.new_part()
        one.write.parquet(part)  # read several times
        one = self.spark.read.schema(one.schema).parquet(part)
        return self._change(one, one, newer, "upsert", base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Removes the rows of these keys."""
        return self._change(keys.select(*self.keys).distinct(), None, None, "delete", base)

    def undo(self, version: int) -> int:
        """Makes an old version the last one again: no row is read or written."""
        return self.log.commit(self.log.latest(), self.log.read(version) | {"what": f"undo to {version}"})

    def compact(self) -> int:
        """Writes the live rows as one part without delete vectors."""
        base = self.log.latest()
        part = self.log.new_part()
        self.read(base).write.parquet(part)
        return self.log.commit(base, {"schema": self.log.read(base)["schema"], "parts": [{"path": part, "gone": []}], "what": "compact"})

    def history(self) -> list[tuple[int, str]]:
        """Versions and what made them."""
        return [(v, self.log.read(v)["what"]) for v in range((self.log.latest() or 0) + 1)]
