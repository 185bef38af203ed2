"""Clusters of vectors: average linkage in rounds, prototypes per owner, centroids, likely owners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import cosine_distance, norm
from .aggregates import mean_vectors
from .graph import components, kept_table
from .joins import nearest_owner
from .vectors import Index


def average_linkage(vectors: np.ndarray, cut: float) -> np.ndarray:
    """Labels of agglomerative clustering by average cosine distance, merging while the least is at most the cut."""
    n = len(vectors)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = np.divide(vectors, length, out=np.zeros_like(vectors, dtype=float), where=length > 0)
    d = np.clip(1 - u @ u.T, 0, 2)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - 1):
        flat = np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))
        i, j = sorted(divmod(int(flat), n))
        if not alive[i] or not d[i, j] <= cut:
            break
        d[i] = d[:, i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def split_clusters(vectors: np.ndarray, cut: float, most: int = 300, factor: float = 0.8, depth: int = 5) -> np.ndarray:
    """average_linkage, with clusters of over `most` members cut again at a lower distance."""
    label = average_linkage(vectors, cut)
    if depth:
        for k in np.unique(label):
            own = np.flatnonzero(label == k)
            if len(own) > most:
                label[own] = own[split_clusters(vectors[own], cut * factor, most, factor, depth - 1)]
    return label


#: Components of at most so many vectors are clustered in one task; larger ones in rounds, with the same result.
IN_ONE_TASK = 2_000


def _spread_labels(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the graph between the rows and the columns of a matrix: a label of each row and column, -1 without a neighbour."""
    rows, columns = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for start in np.flatnonzero(near.any(axis=1)):
        if rows[start] < 0:
            rows[start], new = start, np.array([start])
            while len(new):
                to = np.flatnonzero(near[new].any(axis=0) & (columns < 0))
                columns[to] = start
                new = np.flatnonzero(near[:, to].any(axis=1) & (rows < 0)) if len(to) else to
                rows[new] = start
    return rows, columns


#: Vectors of a block, at least and at most, and blocks unless that makes them smaller or larger. A vector goes to as many tasks as
#: there are blocks, so up to BLOCKS blocks of the largest size what is shuffled grows as the table does.
LEAST, MOST, BLOCKS = 4096, 1 << 16, 16
#: Rows and columns of two blocks that are multiplied at once, and pairs that are looked at again at once.
TILE, AGAIN = (1024, 8192), 1 << 16


def _within(a: np.ndarray, b: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, near): the unit vectors of a that have any of b within the cut, and which. Single precision decides but for what its
    rounding leaves open, which is multiplied again in double precision."""
    slack = (a.shape[1] + 4) * 2.0**-23
    s = a.astype(np.float32) @ b.astype(np.float32).T
    near = s >= np.float32(1 - cut - slack)
    rows = np.flatnonzero(near.any(axis=1))
    near = near[rows]
    i, j = np.nonzero(near & (s[rows] < 1 - cut + slack))
    for lo in range(0, len(i), AGAIN):
        x, y = i[lo : lo + AGAIN], j[lo : lo + AGAIN]
        near[x, y] = 1 - np.einsum("ij,ij->i", a[rows[x]], b[y]) <= cut
    return rows, near


def _block_forest(t: pa.Table, cut: float) -> pa.Table:
    """Edges (a, b) that connect what is within the cut between two blocks x and y, or within one."""
    keys, block = t["key"].to_numpy(), t["block"].to_numpy()
    u = np.frombuffer(b"".join(t["u"].to_pylist())).reshape(len(keys), -1)
    x, y = t["x"][0].as_py(), t["y"][0].as_py()
    first, second, root = np.flatnonzero(block == x), np.flatnonzero(block == y), list(range(len(keys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lo in range(0, len(first), TILE[0]):
        own = first[lo : lo + TILE[0]]
        for at in range(lo if x == y else 0, len(second), TILE[1]):
            other = second[at : at + TILE[1]]
            rows, near = _within(u[own], u[other], cut)
            near[own[rows][:, None] == other[None, :]] = False
            for near_to, nodes in zip(_spread_labels(near), (own[rows], other)):
                has = np.flatnonzero(near_to >= 0)
                for i, j in zip(own[rows[near_to[has]]].tolist(), nodes[has].tolist()):
                    i, j = find(i), find(j)
                    root[max(i, j)] = min(i, j)
    to = np.array([find(i) for i in range(len(root))], int)
    moved = np.flatnonzero((to != np.arange(len(to))) & (keys[to] != keys))
    return pa.table({"a": pa.array(keys[to[moved]], pa.int64()), "b": pa.array(keys[moved], pa.int64())})


def linked(index: Index, cut: float) -> DataFrame:
    """(a, b): edges with the components of all pairs within the cut. Blocks of vectors meet, each with each, in a task; what a task
    finds is linked by a forest, not by pairs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in u], pa.binary())], ["key", "u"])

    n = index.vectors.count()
    k = max(1, min(-(-n // LEAST), max(BLOCKS, -(-n // MOST))))
    packed = index.vectors.select("key", "u").mapInArrow(pack, "key long, u binary").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(k)).cast("int"))
    each = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    pairs = each.select("key", "u", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return pairs.groupBy("x", "y").applyInArrow(lambda t: _block_forest(t, cut), "a long, b long").distinct()


def linkage_in_rounds(members: DataFrame, cut: float, rounds: int = 500) -> DataFrame:
    """(id, cluster) of (id, u, group): average linkage of unit vectors within groups, merging while the least distance is at most
    the cut; a cluster is named by its smallest id.

    The mean cosine distance between two clusters is 1 - the product of their mean vectors, so that a cluster is its sum and size. In
    each round every cluster looks for its nearest, and those that are each other's nearest merge. With average
    linkage a merged cluster is no nearer to others than its parts were, so this comes to the same clusters as merging one pair at a
    time, and only clusters that merged, or whose nearest did, look again. Ties go to the pair of smaller ids."""
    carry = ("length", "group", "n")
    state = kept_table(members.select("id", "group", F.col("u").alias("sum"), F.lit(1).cast("long").alias("n")), "linkage")
    belongs = kept_table(members.select("id", F.col("id").alias("cluster")), "belongs")
    nearest_of: DataFrame | None = None
    mean = F.transform("sum", lambda x: x / F.col("n"))

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values("key")
            scaled = lambda x: np.stack(x["u"].to_numpy()) * x["length"].to_numpy()[:, None]
            d = np.round(1 - scaled(q) @ scaled(v).T, 12)
            a, b = q["query"].to_numpy(), v["key"].to_numpy()
            d[(a[:, None] == b[None, :]) | (q["group"].to_numpy()[:, None] != v["group"].to_numpy()[None, :]) | (d > cut)] = np.inf
            for i, x in enumerate(a):
                ties = b[np.flatnonzero((d[i] == d[i].min()) & np.isfinite(d[i]))]
                if len(ties):
                    out.append((x, min(ties, key=lambda y: (min(x, y), max(x, y))), d[i].min()))
        return pd.DataFrame(out, columns=["a", "b", "distance"])

    changed: DataFrame | None = None
    for _ in range(rounds):
        vectors = state.select(F.col("id").alias("key"), "group", "n", mean.alias("vector")).withColumn("length", norm(F.col("vector")))
        index = Index.build(vectors, carry=carry)
        found = index.all_within(cut, pair, "a long, b long, distance double", carry, changed)
        best = found.groupBy("a").agg(F.min_by("b", F.struct("distance", F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
        if nearest_of is not None and changed is not None:
            best = best.unionByName(nearest_of.join(changed.withColumnRenamed("key", "a"), "a", "left_anti"))
        best = kept_table(best, "nearest")
        back = best.select(F.col("a").alias("x"), F.col("b").alias("y"))
        merges = kept_table(best.join(back, (F.col("a") == F.col("y")) & (F.col("b") == F.col("x"))).where("a < b").select(F.col("a").alias("into"), F.col("b").alias("gone")), "merges")
        if merges.isEmpty():
            return belongs
        into = F.coalesce("into", "id")
        moved = state.join(merges, F.col("id") == F.col("gone"), "left").select(into.alias("id"), "group", "sum", "n")
        both = moved.groupBy("id").agg(F.first("group").alias("group"), F.collect_list("sum").alias("s"), F.sum("n").alias("n"))  # two at most
        total = F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(F.zip_with(F.get("s", F.lit(0)), F.get("s", F.lit(1)), lambda x, y: x + y))
        state = kept_table(both.select("id", "group", total.alias("sum"), "n"), "linkage")
        belongs = kept_table(belongs.join(merges, F.col("cluster") == F.col("gone"), "left").select("id", F.coalesce("into", "cluster").alias("cluster")), "belongs")
        touched = merges.select(F.col("into").alias("t")).unionByName(merges.select(F.col("gone").alias("t")))
        gone = merges.select(F.col("gone").alias("a"))
        nearest_of = best.join(gone, "a", "left_anti")
        changed = kept_table(nearest_of.join(touched, F.col("b") == F.col("t"), "left_semi").select(F.col("a").alias("key")).unionByName(merges.select(F.col("into").alias("key"))).distinct(), "changed")
    raise RuntimeError(f"linkage did not settle in {rounds} rounds")


def clusters(df: DataFrame, id_col: str, vector: str, cut: float = 0.45, most: int = 300, factor: float = 0.8, depth: int = 5, in_one_task: int | None = None) -> DataFrame:
    """(id, cluster) of all rows with a vector: average linkage by cosine distance up to the cut; clusters of over `most` members are
    cut again at `factor` of it, and so on. Nothing merges across components of the pairs within the cut, as two clusters that
    merge have such a pair; small components are clustered in one task each, large ones in rounds."""
    limit = IN_ONE_TASK if in_one_task is None else in_one_task
    index = Index.build(df.select(F.col(id_col).cast("long").alias("key"), F.col(vector).alias("vector")), cells=1, sample=8)  # all blocks meet
    found = components(kept_table(linked(index, cut), "linked"))
    each = index.vectors.select(F.col("key").alias("id"), "u").join(found, "id")
    alone = index.all_keys.select(F.col("key").alias("id")).join(found, "id", "left_anti").select("id", F.col("id").alias("cluster"))
    each = kept_table(each, "members")
    sizes = kept_table(each.groupBy("group").agg(F.count("*").alias("members")), "components")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        label = split_clusters(np.stack(pdf["u"].to_numpy()).astype(float), cut, most, factor, depth)
        return pd.DataFrame({"id": ids, "cluster": pd.Series(ids).groupby(label).transform("min").to_numpy()})

    small = each.join(sizes.where(F.col("members") <= limit), "group", "left_semi")
    out = alone.unionByName(small.groupBy("group").applyInPandas(one, "id long, cluster long"))
    large = each.join(sizes.where(F.col("members") > limit), "group", "left_semi").select("id", "u", "group")
    now, level = cut, 0
    while not large.isEmpty():
        large = kept_table(large, "large")
        own = linkage_in_rounds(large, now)
        counts = own.groupBy("cluster").agg(F.count("*").alias("members"))
        over = counts.where((F.col("members") > most) & F.lit(level < depth)).select("cluster")
        out = out.unionByName(own.join(over, "cluster", "left_anti").select("id", "cluster"))
        large = large.drop("group").join(own.join(over, "cluster", "left_semi").select("id", F.col("cluster").alias("group")), "id")
        now, level = now * factor, level + 1
    return out


#: Vectors of an owner that k-means looks at together; the others stay as they came, four or eight bytes a number.
AT_ONCE = 4096


def prototypes(df: DataFrame, owner: str, id_col: str, vector: str, most: int = 5, rounds: int = 20) -> DataFrame:
    """(owner, n, vector): the mean of up to two vectors, else k-means with k = min(most, max(2, n // 4)), started
    from evenly spaced rows by id."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        t = t.filter(pc.is_valid(t[vector]))
        n, order = len(t), np.argsort(t[id_col].to_numpy(), kind="stable")
        x = t[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
        k = min(n, 1) if n <= 2 else min(most, max(2, n // 4))
        c = x[order[np.linspace(0, n - 1, k).astype(int)]].astype(float)
        for _ in range(rounds if n > 2 else min(n, 1)):
            sums, counts = np.zeros_like(c), np.zeros(k, int)
            for lo in range(0, n, AT_ONCE):
                some = x[order[lo : lo + AT_ONCE]].astype(float)
                label = ((some[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                counts += np.bincount(label, minlength=k)
                for i in range(k):
                    sums[i] += some[label == i].sum(axis=0)
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        return pa.table({"owner": pa.array([key[0].as_py()] * k, key[0].type), "n": pa.array(counts if n else [], pa.int64()), "vector": pa.array(list(c), pa.list_(pa.float64()))})

    return df.select(owner, id_col, vector).groupBy(owner).applyInArrow(one, f"owner {dict(df.dtypes)[owner]}, n long, vector array<double>")


def by_centroid(members: DataFrame, cluster: str, id_col: str, vector: str) -> DataFrame:
    """(cluster, id, distance, rank): members in order of distance to their cluster's mean."""
    c = mean_vectors(members, cluster, vector)
    d = members.join(c, cluster).select(cluster, F.col(id_col).alias("id"), cosine_distance(F.col(vector), F.col("mean")).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy("distance", "id")))


def ordered(size: str = "n", small: int = 3) -> list:
    """Sort key: large clusters first, those under `small` last."""
    return [F.col(size) < small, F.col(size).desc()]


def likely_owners(members: DataFrame, cluster: str, vector: str, protos: DataFrame, most: float) -> DataFrame:
    """(cluster, owner, distance) where the cluster's mean is within `most` of an owner's prototype."""
    c = mean_vectors(members, cluster, vector).select(F.col(cluster).alias("id"), F.col("mean").alias("vector"))
    return nearest_owner(c, protos, 1, most).select(F.col("query_id").alias("cluster"), "owner", "distance")
