"""Vector index: inverted lists under k-means centroids, probed for the nearest vectors by cosine, and exact where asked.

Centroids are fitted to a bounded sample (SAMPLE vectors, those whose keys hash lowest); every vector is put into the cell of its
nearest one, and of each cell the largest angle to its centroid is known. A query looks into the cells of its nearest centroids.
That is the fast answer, of which recall can be measured. The exact one looks further: angles obey the triangle inequality, so
a cell can hold nothing nearer than the query's angle to the centroid less the cell's largest angle, and only cells that may
beat the k-th distance so far are looked into as well.

Queries meet vectors by an equi-join on cells, whose vectors and queries are dealt in blocks, so that a cell that holds a
third of all is many tasks. Distances are cosine distances, rounded to 12 digits; ties go to the smaller key. A vector without
length is at distance 1 from all. Null vectors neither find nor are found; of repeated keys the nearest vector counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept_table

#: Vectors that centroids are fitted to, at most; vectors and queries of a cell that meet in one task.
SAMPLE, VECTORS, QUERIES = 20_000, 4096, 1024
PROBES = 8

#: Angles are computed from rounded cosines; what is nearer than this is looked into.
SLACK = 1e-6


def _unit(column: pa.Array | pd.Series) -> np.ndarray:
    """Rows of unit length; rows without length stay zero."""
    if isinstance(column, pd.Series):
        x = np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 1))
    else:
        x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1) if len(column) else np.empty((0, 1))
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _angles(u: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ centroids.T, -1, 1))


def fitted(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of unit length by spherical k-means, started from evenly spaced rows."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, np.divide(sums, length, out=np.zeros_like(sums), where=length > 0), centroids)
    return centroids


@dataclass
class Index:
    """vectors: (key, u, cell), a stored table of unit vectors; centroids and the largest angle in each cell; sizes: (cell,
    blocks), in how many blocks a cell's vectors are dealt; none: keys of vectors without length, and first: the smallest of all."""

    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    sizes: DataFrame
    none: DataFrame
    all_keys: DataFrame

    @staticmethod
    def build(vectors: DataFrame, cells: int | None = None, sample: int | None = None, carry: tuple[str, ...] = ()) -> Index:
        """An index of (key, vector), and of further columns to be carried along."""
        known = vectors.select("key", "vector", *carry).where("vector is not null")
        sample = sample or SAMPLE
        some = known.orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()
        units = _unit(some["vector"])
        units = units[np.abs(units).sum(axis=1) > 0]
        if cells is None:
            n = known.count()
            cells = int(min(np.sqrt(n), n / 512))
        cells = max(1, min(cells, max(1, len(units) // 8)))
        centroids = fitted(units, cells) if len(units) else np.zeros((1, units.shape[1]))
        shared = known.sparkSession.sparkContext.broadcast(centroids)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u = _unit(b.column(1))
                if len(u):
                    angles = _angles(u, shared.value)
                    cell = np.where(np.abs(u).sum(axis=1) > 0, np.argmin(angles, axis=1), -1).astype(np.int32)
                    own = angles[np.arange(len(u)), np.maximum(cell, 0)]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(u), pa.list_(pa.float64())), pa.array(cell), pa.array(own), *b.columns[2:]], ["key", "u", "cell", "angle", *carry])

        kinds = dict(vectors.dtypes)
        placed = kept_table(known.mapInArrow(place, f"key {kinds['key']}, u array<double>, cell int, angle double" + "".join(f", {c} {kinds[c]}" for c in carry)), "cells")
        table = placed.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        rows = table.collect()  # a row for each cell
        radius = np.full(len(centroids), -np.inf)
        for r in rows:
            radius[r.cell] = r.radius
        sizes = known.sparkSession.createDataFrame([(r.cell, -(-r.n // VECTORS)) for r in rows], "cell int, blocks int")
        return Index(placed.where("cell >= 0"), centroids, radius, sizes, placed.where("cell < 0").select("key"), placed.select("key"))

    def _meet(self, probes: DataFrame, pair, schema: str) -> DataFrame:
        """Groups of a block of a cell's vectors and a block of its queries (query, u, cell, ...), met by `pair`."""
        counts = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        sizes = kept_table(self.sizes.join(counts, "cell"), "sizes")  # a row for each cell
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = probes.join(F.broadcast(sizes), "cell").withColumn("query_block", dealt("query", "groups")).withColumn("block", upto("blocks")).drop("blocks", "groups")
        v = self.vectors.join(F.broadcast(sizes), "cell").withColumn("block", dealt("key", "blocks")).withColumn("query_block", upto("groups")).drop("blocks", "groups", "angle")
        keys = ["cell", "block", "query_block"]
        return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(pair, schema)

    def nearest(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True, most: float | None = None) -> DataFrame:
        """(query, key, distance, rank): the k nearest keys of each query (query, vector), within `most` if given."""
        kinds = dict(queries.dtypes) | {"key": dict(self.all_keys.dtypes)["key"]}
        shared = queries.sparkSession.sparkContext.broadcast((self.centroids, self.radius))
        schema = f"query {kinds['query']}, u array<double>, cell int"

        def looked(bound_at: int | None):
            """Cells of the first probes; with a column of k-th distances, further cells that may hold something nearer."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                centroids, radius = shared.value
                for b in batches:
                    u = _unit(b.column(1))
                    if not len(u) or not np.isfinite(radius).any():
                        continue
                    angles = _angles(u, centroids)
                    first = np.argsort(angles, axis=1, kind="stable")[:, :probes]
                    near = np.zeros(angles.shape, bool)
                    np.put_along_axis(near, first, True, axis=1)
                    if bound_at is not None:
                        bound = b.column(bound_at).to_numpy(zero_copy_only=False).astype(float)
                        reach = np.where(np.isnan(bound), np.pi, np.arccos(np.clip(1 - bound, -1, 1)))
                        near = ~near & (angles - radius[None, :] <= reach[:, None] + SLACK)
                    near &= (np.abs(u).sum(axis=1) > 0)[:, None] & np.isfinite(radius)[None, :]
                    for lo in range(0, len(u), 1000):
                        row, cell = np.nonzero(near[lo : lo + 1000])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + lo)), pa.array(list(u[row + lo]), pa.list_(pa.float64())), pa.array(cell.astype(np.int32))], ["query", "u", "cell"])

            return run

        def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(v):
                v = v.sort_values("key", kind="stable")
                keys = v["key"].to_numpy()
                d = np.clip(np.round(1 - np.stack(q["u"].to_numpy()) @ np.stack(v["u"].to_numpy()).T, 12), 0, 2)
                repeated = len(pd.unique(keys)) < len(keys)
                for i, query in enumerate(q["query"]):
                    best = np.argsort(d[i], kind="stable")
                    if repeated:
                        best = best[np.sort(np.unique(keys[best], return_index=True)[1])]
                    out += [(query, keys[j], d[i, j]) for j in best[:k]]
            return pd.DataFrame(out, columns=["query", "key", "distance"])

        asked = queries.select("query", "vector").where("vector is not null")
        result = f"query {kinds['query']}, key {kinds['key']}, distance double"
        found = self._meet(kept_table(asked.mapInArrow(looked(None), schema), "probes"), pair, result)
        if exact:
            found = kept_table(found, "found")
            kth = self._top(found, k).where(F.col("rank") == k).select(F.col("query").alias("__q"), F.col("distance").alias("bound"))
            bounded = asked.join(kth, F.col("query") == F.col("__q"), "left").select("query", "vector", (F.least("bound", F.lit(most)) if most is not None else F.col("bound")).alias("bound"))
            found = found.unionByName(self._meet(kept_table(bounded.mapInArrow(looked(2), schema), "further"), pair, result))
        # without length: such vectors are at distance 1 from every query, such queries from every vector
        empty = F.forall("vector", lambda x: x == 0)
        for who, keys in ((asked.where(~empty), self.none), (asked.where(empty), self.all_keys)):
            least = [r.key for r in keys.distinct().orderBy("key").limit(k).collect()]
            if least:
                found = found.unionByName(who.select("query", F.explode(F.array(*map(F.lit, least))).alias("key"), F.lit(1.0).alias("distance")))
        if most is not None:
            found = found.where(F.col("distance") <= most)
        return self._top(found, k)

    def all_within(self, distance: float, pair, schema: str, carry: tuple[str, ...] = (), some: DataFrame | None = None) -> DataFrame:
        """Groups of the index's own vectors (query, u, carried columns) and of those that may be within a distance of them (key, u,
        carried columns), met by `pair`. Only cells whose centroids' angle allows it meet. some: (key) of those that ask."""
        shared = self.vectors.sparkSession.sparkContext.broadcast((self.centroids, self.radius, float(np.arccos(np.clip(1 - distance, -1, 1)))))
        kinds = dict(self.vectors.dtypes)
        asks = self.vectors if some is None else self.vectors.join(some, "key", "left_semi")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, radius, reach = shared.value
            for b in batches:
                u = _unit(b.column(1))
                for lo in range(0, len(u), 1000):
                    row, cell = np.nonzero((_angles(u[lo : lo + 1000], centroids) - radius[None, :] <= reach + SLACK) & np.isfinite(radius)[None, :])
                    some_rows = b.slice(lo, 1000).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*some_rows.columns, pa.array(cell.astype(np.int32))], ["query", "u", *carry, "cell"])

        probes = asks.select("key", "u", *carry).mapInArrow(look, f"query {kinds['key']}, u array<double>" + "".join(f", {c} {kinds[c]}" for c in carry) + ", cell int")
        return self._meet(kept_table(probes, "probes"), pair, schema)

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        one = found.groupBy("query", "key").agg(F.min("distance").alias("distance"))
        w = Window.partitionBy("query").orderBy("distance", "key")
        return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
