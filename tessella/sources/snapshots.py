"""Numbered versions of something stored: each a small JSON file that names immutable parts, committed by one writer alone."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed the same version."""


class Snapshots:
    """Versions 0, 1, 2 ... under root/versions; parts, which nothing changes once written, under root/parts.

    A version is written under a temporary name and renamed, which fails where it exists already: of two writers that
    started from one version, the second gets a Conflict, and can read again and try again. Readers see whole versions
    only. Parts that no version names are left by writers that failed; they cost space and nothing else."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str) -> Any:
        return self.hadoop.Path(f"{self.root}/versions/{name}")

    def latest(self) -> int | None:
        """The highest version; None if there is none."""
        folder = self.hadoop.Path(f"{self.root}/versions")
        fs = folder.getFileSystem(self.conf)
        if not fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        found = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]
        return max(found, default=None)

    def read(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if version is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        place = self._path(f"{version:010d}.json")
        stream = place.getFileSystem(self.conf).open(place)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int | None, content: dict) -> int:
        """Writes the version after `base`."""
        version = 0 if base is None else base + 1
        draft, final = self._path(f".{uuid.uuid4().hex}.tmp"), self._path(f"{version:010d}.json")
        fs = draft.getFileSystem(self.conf)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(draft.toUri(), self.conf)
        try:
            options = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(draft, False)
            if self.latest() is not None and self.latest() >= version:
                raise Conflict(f"version {version} of {self.root} exists already") from e
            raise
        return version

    def new_part(self) -> str:
        return f"{self.root}/parts/{uuid.uuid4().hex}"


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of the files of a table: what is derived from it can be told from what is out of date."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = list(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place))
    return sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)
