"""Clustering operators: nearest center, Lloyd steps, inertia, silhouette,
K-Means fitting with restarts, choice of k, cluster labels.

Points are numeric arrays (``array<double>``/``array<float>``) or MLlib
vectors. Centers are small (k x d, k <= n_clusters, d <= max_features) and
travel as literals or broadcasts; everything row-sized stays distributed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from reasonscope import defaults as D
from reasonscope.session import bounded_broadcast, literal_table, ship_package


def _arr(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


def sq_distance(x: Column, center: list[float]) -> Column:
    """Squared Euclidean distance between an array column and a literal."""
    lit_c = F.array(*[F.lit(float(v)) for v in center])
    return F.aggregate(F.zip_with(x, lit_c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)


def assign_nearest(df: DataFrame, vec_col: str, centers: list[list[float]],
                   cluster_col: str = "cluster", dist_col: str = "dist2") -> DataFrame:
    """Nearest center by squared Euclidean distance, ties to the lowest index."""
    x = _arr(vec_col)
    ds = F.array(*[F.struct(sq_distance(x, c).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centers)])
    best = F.array_min(ds)
    return df.withColumn("_best", best).withColumn(cluster_col, F.col("_best.k")) \
             .withColumn(dist_col, F.col("_best.d")).drop("_best")


def assign_sparse(rows: DataFrame, weights: DataFrame, centers: DataFrame, max_center_rows: int | None = None,
                  digits: int = 9) -> DataFrame:
    """Nearest center of every row (row_id) from long tables: weights (row_id, term, weight)
    and centers (cluster, term, weight), both without negative weights. The centers are an
    inverted index: a row meets the centers it shares a term with and adds up its dot products;
    all others are as far as their norm says, so the shortest one stands for them.
    Distances are compared rounded to ``digits``, ties to the lowest cluster. No vocabulary is held
    as a block; ``max_center_rows`` is a proven bound of the center rows, which allows a broadcast."""
    listed = centers.select("cluster", "term", F.col("weight").alias("c"))
    norms = centers.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("weight")).alias("c2"))
    far = norms.agg(F.min(F.struct("c2", "cluster")).alias("s")).select("s.cluster", "s.c2")   # one row
    if max_center_rows is not None:
        listed, norms = bounded_broadcast(listed, max_center_rows), bounded_broadcast(norms, max_center_rows)
    own = rows.select("row_id").join(weights.groupBy("row_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("x2")), "row_id", "left")
    own = own.select("row_id", F.coalesce("x2", F.lit(0.0)).alias("x2"))
    dots = (weights.join(listed, "term").groupBy("row_id", "cluster").agg(F.sum(F.col("weight") * F.col("c")).alias("dot"))
            .join(norms, "cluster").select("row_id", "cluster", (F.col("c2") - 2 * F.col("dot")).alias("d")))
    met = dots.groupBy("row_id").agg(F.min(F.struct(F.round("d", digits).alias("d"), "cluster")).alias("near"))
    found = own.join(met, "row_id", "left").join(F.broadcast(far.select(F.struct(F.round("c2", digits).alias("d"), "cluster").alias("far"))))
    nearest = F.least(F.coalesce("near", "far"), F.col("far"))
    return found.select("row_id", nearest["cluster"].alias("cluster"), F.greatest(F.lit(0.0), F.col("x2") + nearest["d"]).alias("dist2"))


def _mean_rows(centers: np.ndarray):
    """Each partition's members and coordinate sums by nearest center (ties to the lowest index)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centers), centers.shape[1] + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                label = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
                np.add.at(total, label, np.column_stack([np.ones(len(x)), x]))
        own = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own].tolist(), pa.list_(pa.float64()))], names=["cluster", "sums"])
    return run


def cluster_means(arrays: DataFrame, centers: list[list[float]]) -> dict[int, list[float]]:
    """Mean of the points (an array column ``x``) nearest to each center; clusters without
    one are missing. A row per partition and cluster is sent, k rows reach the driver."""
    rows = arrays.mapInArrow(_mean_rows(np.array(centers, np.float64)), "cluster int, sums array<double>")
    d = len(centers[0])
    sums = rows.groupBy("cluster").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(d + 1)]).collect()
    return {r["cluster"]: [r[f"s{i}"] / r["s0"] for i in range(1, d + 1)] for r in sums}


def lloyd(df: DataFrame, vec_col: str, centers: list[list[float]], max_iter: int,
          atol: float = D.KMEANS_TOL) -> tuple[list[list[float]], int]:
    """Lloyd iterations from given centers; an empty cluster keeps its
    center; stops when no coordinate moves by more than ``atol``. Each
    iteration is one distributed pass over the persisted points; the centers travel with
    the task, so the plan is the same in every pass."""
    ship_package(df.sparkSession)
    arrays = df.select(_arr(vec_col).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    centers = [list(map(float, c)) for c in centers]
    it = 0
    for it in range(1, max_iter + 1):
        means = cluster_means(arrays, centers)
        new = [means.get(i, c) for i, c in enumerate(centers)]
        moved = max((abs(a - b) for c0, c1 in zip(centers, new) for a, b in zip(c0, c1)), default=0.0)
        centers = new
        if moved <= atol:
            break
    arrays.unpersist()
    return centers, it


def inertia(df: DataFrame, vec_col: str, centers: list[list[float]]) -> DataFrame:
    """Sum of squared distances to the nearest center (one row)."""
    return assign_nearest(df, vec_col, centers).agg(F.sum("dist2").alias("inertia"))


def silhouette(df: DataFrame, vec_col: str, label_col: str, weight_col: str | None = None) -> DataFrame:
    """Mean silhouette with squared Euclidean distances, with the original
    tool's conventions: a point's own-cluster mean includes the point itself,
    a singleton scores a = 0, one cluster only gives -1.

    Exact in O(n * k): the mean squared distance from x to cluster c is
    |x - mean_c|^2 + (Q_c / n_c - |mean_c|^2), with Q_c the sum of squared
    norms. (Plain Euclidean distances, as in the original, have no such
    decomposition and would need every pair of points.) With ``weight_col``
    each row stands for that many identical points.
    """
    spark = df.sparkSession
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    v = array_to_vector(_arr(vec_col))
    stats = (df.select(F.col(label_col).alias("_l"), v.alias("_v"), w.alias("_w"),
                       (w * F.aggregate(_arr(vec_col), F.lit(0.0), lambda a, x: a + x * x)).alias("_q"))
             .groupBy("_l").agg(Summarizer.metrics("sum").summary(F.col("_v"), F.col("_w")).alias("s"),
                                F.sum("_w").alias("n"), F.sum("_q").alias("q")).collect())    # one row per cluster
    if len(stats) <= 1:
        return literal_table(spark, [(-1.0,)], "silhouette double")
    labels, spread, means, sizes = [], [], [], []
    for r in stats:
        n = r["n"]
        mu = [float(x) / n for x in r["s"]["sum"].toArray()]
        labels.append(r["_l"])
        means.append(mu)
        sizes.append(n)
        spread.append(max(r["q"] / n - sum(m * m for m in mu), 0.0))
    x = _arr(vec_col)
    lab = F.col(label_col)
    per = [sq_distance(x, mu) + F.lit(t) for mu, t in zip(means, spread)]
    own = F.coalesce(*[F.when(lab == F.lit(l), F.lit(0.0) if n <= 1 else d) for l, n, d in zip(labels, sizes, per)])
    other = F.array_min(F.array(*[F.when(lab != F.lit(l), d) for l, d in zip(labels, per)]))
    scored = df.select(own.alias("a"), other.alias("b"), w.alias("w"))
    denom = F.greatest("a", "b")
    s = F.when(denom > 0, (F.col("b") - F.col("a")) / denom).otherwise(F.lit(0.0))
    return scored.agg((F.sum(s * F.col("w")) / F.sum("w")).alias("silhouette"))


GRID_BITS = 20
SEED_DIGITS = 15   # hex digits of the hash that picks the seeds
BLOCK_BYTES = 16 << 20
PACK_BYTES = 1 << 20    # of points that one step of a pass holds


def _dense(df: DataFrame, col: str) -> Column:
    return _arr(col) if isinstance(df.schema[col].dataType, ArrayType) else vector_to_array(col)


def _grid(values, unit: float) -> np.ndarray:
    """Rows of whole numbers (as doubles): sums and products of them are exact, so no
    result depends on the order or the partitions they are added in."""
    return np.rint(np.array(values, np.float64) / unit)


@dataclass
class FittedKMeans:
    """Centers (k x d) on a grid of step ``unit``, the weighted inertia, and the share of points
    whose distances weren't measured again in a Lloyd step (0 if the points fill several blocks)."""
    centers: np.ndarray
    unit: float
    cost: float
    skipped: float = 0.0

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, df: DataFrame, features_col: str = "features", cluster_col: str = "_cluster") -> DataFrame:
        """Nearest center of every row, ties to the lowest index."""
        ship_package(df.sparkSession)
        centers, unit = _grid(self.centers, self.unit), self.unit

        step = max(1, PACK_BYTES // (8 * centers.shape[1]))

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            out = np.empty(len(x), np.int32)
            for at in range(0, len(x), step):   # a part of the batch at a time
                part = _grid(x.iloc[at: at + step].tolist(), unit)
                out[at: at + step] = _distances(part, centers).argmin(axis=1)
            return pd.Series(out)

        return df.withColumn(cluster_col, nearest(_dense(df, features_col)))


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers * centers).sum(axis=1)[None, :]


def _pack_rows(unit: float, width: int):
    """Points on the grid as rows of at most ``PACK_BYTES``, read by every pass as they lie in memory."""
    step = max(1, PACK_BYTES // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
                x = _grid(flat.reshape(part.num_rows, -1), unit)
                w = part.column("w").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["x", "w"])
    return run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, w in zip(batch.column("x"), batch.column("w")):
            weights = np.frombuffer(w.as_buffer(), np.int64)
            yield np.frombuffer(x.as_buffer()).reshape(len(weights), -1), weights


def _seeds(points: np.ndarray, n: int, seed: int) -> dict[int, bytes]:
    """The n distinct points of smallest hash: the MD5 of "seed|index:value,..." over
    the nonzero grid coordinates."""
    best: dict[int, bytes] = {}
    worst = 0
    for point in points + 0.0:   # no negative zero
        at = np.flatnonzero(point)
        text = ",".join(f"{i}:{v}" for i, v in zip(at.tolist(), point[at].astype(np.int64).tolist()))
        value = int(md5(f"{seed}|{text}".encode()).hexdigest()[:SEED_DIGITS], 16)
        if value < worst or len(best) < n:
            best[value] = point.tobytes()
            if len(best) > n:
                del best[max(best)]
            worst = max(best)
    return best


def _seed_rows(n: int, seed: int):
    """Each partition's seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, bytes] = {}
        for points, _ in _batches(batches):
            best = dict(sorted({**best, **_seeds(points, n, seed)}.items())[:n])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.binary())],
                                         names=["value", "point"])
    return run


def _starts(grid: list[np.ndarray], fits: list[tuple[int, int]], runs: int) -> dict[int, np.ndarray]:
    """First centers of each fit (k, restart): the next k seeds, from the first again when
    the ``runs * k`` that count for k run out."""
    own = {k: grid[: runs * k] for k, _ in fits}
    return {n: np.array([own[k][(r * k + i) % len(own[k])] for i in range(min(k, len(own[k])))]) for n, (k, r) in enumerate(fits)}


def _fit_sums(points: np.ndarray, weights: np.ndarray, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By fit and cluster: count, inertia (upper and lower part) and coordinate sums."""
    out, at = {}, 0
    whole = points.astype(np.int64) * weights[:, None]
    every = _distances(points, np.concatenate(list(centers.values())))   # of all fits at once
    for n, own in centers.items():
        distances = every[:, at: at + len(own)]
        at += len(own)
        label = distances.argmin(axis=1)
        least = distances[np.arange(len(points)), label].astype(np.int64)
        total = np.zeros((len(own), points.shape[1] + 3), np.int64)
        columns = np.column_stack([weights, weights * (least >> GRID_BITS), weights * (least & (1 << GRID_BITS) - 1), whole])
        order = np.argsort(label, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(label[order]) > 0))
        total[label[order][begin]] += np.add.reduceat(columns[order], begin, axis=0)
        out[n] = total
    return out


def _step_sums(points: np.ndarray, weights: np.ndarray, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By fit and cluster: count and coordinate sums, in the places of ``_fit_sums`` (no inertia). The
    members are added up by a product with their 0/1 table, exact as long as no sum passes 2**53."""
    if int(weights.sum()) >= 1 << 32:
        return _fit_sums(points, weights, centers)
    every = np.concatenate(list(centers.values()))
    nearness = (every * every).sum(axis=1) - 2 * points @ every.T   # the distances without the points' norms
    member = np.zeros(nearness.shape)
    rows, at = np.arange(len(points)), 0
    for own in centers.values():
        member[rows, at + nearness[:, at: at + len(own)].argmin(axis=1)] = weights
        at += len(own)
    columns = np.column_stack([np.ones(len(points)), np.zeros((len(points), 2)), points])
    return dict(zip(centers, np.split((member.T @ columns).astype(np.int64), np.cumsum([len(c) for c in centers.values()])[:-1])))


def _moved(centers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means on the grid; an empty cluster keeps its center."""
    return np.where(sums[:, :1] > 0, np.rint(sums[:, 3:] / np.maximum(sums[:, :1], 1)), centers)


def _iterate(centers: dict[int, np.ndarray], step, unit: float, max_iter: int, tol: float) -> dict[int, np.ndarray]:
    """Lloyd steps of all fits that still move; ``step`` gives their sums."""
    moving = dict(centers)
    for _ in range(max_iter):
        if not moving:
            break
        for n, sums in step(moving).items():
            new = _moved(centers[n], sums)
            if np.abs(new - centers[n]).max() * unit <= tol:
                del moving[n]
            else:
                moving[n] = new
            centers[n] = new
    return centers


def _long(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Whole-number tables by fit as rows (fit, cluster, place, value), zeros left out."""
    for n, table in tables.items():
        cluster, place = np.nonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(place), n, np.int32)), pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)),
             pa.array(table[cluster, place].astype(np.int64))], names=["fit", "cluster", "place", "value"])


_LONG = "fit int, cluster int, place int, value long"


def _tables(rows: pa.Table, shapes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    out = {n: np.zeros(shape, np.int64) for n, shape in shapes.items()}
    fit, cluster, place, value = (rows[c].to_numpy() for c in ("fit", "cluster", "place", "value"))
    for n, table in out.items():
        own = fit == n
        table[cluster[own], place[own]] = value[own]
    return out


def _summed(arrays: DataFrame, per_partition) -> pa.Table:
    """Partition tables added up by Spark: a bounded size, whatever the rows."""
    return (arrays.mapInArrow(per_partition, _LONG).groupBy("fit", "cluster", "place")
            .agg(F.sum("value").alias("value")).toArrow())


def _step_rows(centers: dict[int, np.ndarray], sums_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for points, weights in _batches(batches):
            for n, sums in sums_of(points, weights, centers).items():
                totals[n] = totals[n] + sums if n in totals else sums
        yield from _long(totals)
    return run


class _Block:
    """Points of one partition, with what each fit knows of them: the nearest center, an upper
    bound of the distance to it and a lower bound of the distance to all others. Centers that
    move loosen the bounds; only points whose bounds then overlap are measured again."""

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self.points, self.weights = points, weights
        self.columns = np.column_stack([weights, np.zeros((len(points), 2), np.int64), points.astype(np.int64) * weights[:, None]])
        self.known: dict[int, tuple] = {}
        self.asked = self.made = 0

    def _nearest(self, rows, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distances = _distances(self.points[rows], centers)
        label = distances.argmin(axis=1)
        every = np.arange(len(label))
        best = distances[every, label]
        distances[every, label] = np.inf
        self.made += len(label)
        return label, np.sqrt(np.maximum(best, 0)), np.sqrt(np.maximum(distances.min(axis=1), 0))

    def step(self, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """By fit and cluster: count and coordinate sums (no inertia)."""
        out = {}
        for n, own in centers.items():
            self.asked += len(self.points)
            if n not in self.known:
                label, upper, lower = self._nearest(slice(None), own)
                sums = np.zeros((len(own), self.columns.shape[1]), np.int64)
                np.add.at(sums, label, self.columns)
            else:
                old, label, upper, lower, sums = self.known[n]
                drift = np.sqrt(((own - old) ** 2).sum(axis=1))
                upper, lower = (upper + drift[label]) * (1 + 1e-9), (lower - drift.max()) * (1 - 1e-9) - 1e-6
                rows = np.flatnonzero(upper >= lower)
                found, upper[rows], lower[rows] = self._nearest(rows, own)
                moved = rows[found != label[rows]]
                np.subtract.at(sums, label[moved], self.columns[moved])
                label[rows] = found
                np.add.at(sums, label[moved], self.columns[moved])
            self.known[n] = own, label, upper, lower, sums
            out[n] = sums.copy()
        return out


def _block_rows(unit: float, fits: list[tuple[int, int]], runs: int, seed: int, max_iter: int, tol: float):
    """All fits of points that lie in one partition of bounded size: final centers, and
    in the last two places their inertia (upper and lower part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(_batches(batches))
        if not parts:
            return
        points, weights = (np.concatenate(x) for x in zip(*parts))
        seeds = _seeds(points, runs * max(k for k, _ in fits), seed)
        grid = [np.frombuffer(seeds[v]) for v in sorted(seeds)]
        block = _Block(points, weights)
        centers = _iterate(_starts(grid, fits, runs), block.step, unit, max_iter, tol)
        costs = _fit_sums(points, weights, centers)
        yield from _long({-1: np.array([[block.asked, block.made]])})
        # as many rows as clusters, so that a center of zeros leaves its size behind
        yield from _long({n: np.column_stack([c, costs[n][:, 1:3], np.ones(len(c))]) for n, c in centers.items()})
    return run


@dataclass
class _Points:
    """Points packed on a grid of step ``unit`` (kept until ``arrays`` is unpersisted);
    ``block``: all fit in one block."""
    arrays: DataFrame
    unit: float
    width: int
    block: bool
    skipped: float = 0.0


def _on_grid(points: DataFrame, features_col: str, weight_col: str | None) -> _Points:
    spark = points.sparkSession
    ship_package(spark)
    weight = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    arrays = lambda df: df.select(_dense(df, features_col).alias("x"), weight.alias("w"))
    top, rows, width = arrays(points).select(F.max(F.array_max(F.transform("x", F.abs))), F.count(F.lit(1)), F.max(F.size("x"))).first()
    size = rows * (width or 1) * 8
    unit = 2.0 ** (int(np.ceil(np.log2(top or 1.0) - 1e-9)) - GRID_BITS)   # rows of norm 1 give one grid, whatever their last bit
    block = size < BLOCK_BYTES
    # each pass is a job: the points are dealt out once, evenly to all cores (no result depends on it)
    cores = spark.sparkContext.defaultParallelism
    dealt = points.coalesce(1) if block else points.repartition(cores * (1 + size // (cores * BLOCK_BYTES)))
    packed = arrays(dealt).mapInArrow(_pack_rows(unit, width or 0), "x binary, w binary")
    return _Points(packed.persist(StorageLevel.MEMORY_AND_DISK), unit, width or 0, block)


def _fit_all(data: _Points, fits: list[tuple[int, int]], runs: int, seed: int, max_iter: int, tol: float) -> dict[int, tuple[np.ndarray, int]]:
    """Centers and inertia (grid units) of each fit (k, restart)."""
    if data.block:
        rows = data.arrays.mapInArrow(_block_rows(data.unit, fits, runs, seed, max_iter, tol), _LONG).toArrow()
        sizes = Counter(rows["fit"].to_numpy()[(rows["place"].to_numpy() == data.width + 2) & (rows["fit"].to_numpy() >= 0)].tolist())
        found = _tables(rows, {-1: (1, 2), **{n: (size, data.width + 3) for n, size in sizes.items()}})
        asked, made = found.pop(-1)[0].tolist()
        data.skipped = 1 - made / asked if asked else 0.0
        return {n: (t[:, :data.width].astype(np.float64), (int(t[:, -3].sum()) << GRID_BITS) + int(t[:, -2].sum())) for n, t in found.items()}
    most = runs * max(k for k, _ in fits)
    seeds = (data.arrays.mapInArrow(_seed_rows(most, seed), "value long, point binary")
             .dropDuplicates(["value"]).orderBy("value").limit(most).collect())       # restarts x k rows

    def step(centers, sums_of=_step_sums):
        return _tables(_summed(data.arrays, _step_rows(centers, sums_of)), {n: (len(c), data.width + 3) for n, c in centers.items()})

    centers = _iterate(_starts([np.frombuffer(bytes(s["point"])) for s in seeds], fits, runs), step, data.unit, max_iter, tol)
    return {n: (centers[n], (int(s[:, 1].sum()) << GRID_BITS) + int(s[:, 2].sum())) for n, s in step(centers, _fit_sums).items()}


def _best(data: _Points, ks: list[int], n_init: int, seed: int, max_iter: int, tol: float) -> dict[int, FittedKMeans]:
    """For each k the fit of lowest inertia, ties to the earlier restart."""
    runs = max(1, n_init)
    fits = [(k, r) for k in ks for r in range(runs)]
    found = _fit_all(data, fits, runs, seed, max_iter, tol)
    least = {k: min((found[n][1], n) for n, (own, _) in enumerate(fits) if own == k)[1] for k in ks}
    return {k: FittedKMeans(found[n][0] * data.unit, data.unit, found[n][1] * data.unit * data.unit, data.skipped) for k, n in least.items()}


def fit_kmeans(points: DataFrame, k: int, features_col: str = "features", n_init: int = D.KMEANS_N_INIT,
               seed: int = D.KMEANS_SEED, max_iter: int = D.KMEANS_MAX_ITER, tol: float = D.KMEANS_TOL,
               weight_col: str | None = None) -> FittedKMeans:
    """K-Means with ``n_init`` restarts. In the order of a hash of (seed, point) each
    restart starts from the next k distinct points (from the first again when they
    run out), so restarts don't repeat each other's seeds. One pass over the points makes the
    Lloyd step of all restarts that still move; an empty cluster keeps its center.
    The lowest inertia wins, ties to the earlier restart.

    Coordinates are rounded to a grid of 2**-20 of the largest one. All sums are then
    whole numbers, so the fit is the same for any order, partitioning, and for a
    point of weight w or w equal points. Fewer distinct points than k give as many
    clusters. Points should be persisted. Points that fill less than ``BLOCK_BYTES`` are one
    partition, which makes all its passes within one job (the same sums)."""
    data = _on_grid(points, features_col, weight_col)
    try:
        return _best(data, [k], n_init, seed, max_iter, tol)[k]
    finally:
        data.arrays.unpersist()


def _members(points: np.ndarray, weights: np.ndarray, models: dict[int, np.ndarray]):
    labels = {n: _distances(points, c).argmin(axis=1) for n, c in models.items()}
    return (points * points).sum(axis=1), labels


def _member_rows(models: dict[int, np.ndarray]):
    """By model and cluster: members, coordinate sums, sum of squared norms (upper and lower part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros((len(c), c.shape[1] + 3), np.int64) for n, c in models.items()}
        for points, weights in _batches(batches):
            norms, labels = _members(points, weights, models)
            norms = norms.astype(np.int64)
            columns = np.column_stack([weights, weights * (norms >> GRID_BITS), weights * (norms & (1 << GRID_BITS) - 1),
                                       points.astype(np.int64) * weights[:, None]])
            for n, label in labels.items():
                np.add.at(totals[n], label, columns)
        yield from _long(totals)
    return run


def _score_rows(models: dict[int, np.ndarray], stats: dict[int, np.ndarray]):
    """By model: the members' silhouettes, summed in steps of 2**-40 (upper and lower part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros((1, 2), np.int64) for n in models}
        for points, weights in _batches(batches):
            norms, labels = _members(points, weights, models)
            rows = np.arange(len(points))
            for n, label in labels.items():
                count = np.maximum(stats[n][:, 0], 1).astype(np.float64)
                spread = (stats[n][:, 1] * float(1 << GRID_BITS) + stats[n][:, 2]) / count
                mean = np.maximum(norms[:, None] - 2 * points @ (stats[n][:, 3:] / count[:, None]).T + spread, 0.0)
                mean[:, stats[n][:, 0] == 0] = np.inf
                own = np.where(stats[n][label, 0] > 1, mean[rows, label], 0.0)
                mean[rows, label] = np.inf
                other = mean.min(axis=1)
                larger = np.maximum(own, other)
                scaled = np.rint(np.divide(other - own, larger, out=np.zeros(len(points)), where=larger > 0) * float(1 << 2 * GRID_BITS)).astype(np.int64)
                totals[n] += [[int((weights * (scaled >> GRID_BITS)).sum()), int((weights * (scaled & (1 << GRID_BITS) - 1)).sum())]]
        yield from _long(totals)
    return run


def _silhouettes(data: _Points, models: dict[int, FittedKMeans]) -> dict[int, float]:
    """Mean silhouette (squared distances, see :func:`silhouette`) of every model in two passes for all."""
    centers = {n: _grid(m.centers, m.unit) for n, m in models.items()}
    stats = _tables(_summed(data.arrays, _member_rows(centers)), {n: (len(c), data.width + 3) for n, c in centers.items()})
    sums = _tables(_summed(data.arrays, _score_rows(centers, stats)), {n: (1, 2) for n in centers})
    score = lambda n: ((int(sums[n][0, 0]) << GRID_BITS) + int(sums[n][0, 1])) / float(1 << 2 * GRID_BITS) / int(stats[n][:, 0].sum())
    return {n: score(n) if (stats[n][:, 0] > 0).sum() > 1 else -1.0 for n in centers}


def choose_k(points: DataFrame, n_points: int, features_col: str, min_k: int, max_k: int,
             weight_col: str | None = None, n_init: int = D.KMEANS_N_INIT, seed: int = D.KMEANS_SEED,
             max_iter: int = D.KMEANS_MAX_ITER, tol: float = D.KMEANS_TOL) -> tuple[int, FittedKMeans]:
    """k in min_k..max_k (below n) with the best silhouette, and its fit; strictly
    better scores win, so ties keep the smaller k. The fits of all k share their passes
    over the points, and so do their silhouettes: the number of jobs doesn't grow with the range."""
    data = _on_grid(points, features_col, weight_col)
    ks = [k for k in range(min_k, max_k + 1) if k < n_points]
    try:
        models = _best(data, ks or [min_k], n_init, seed, max_iter, tol)
        scores = _silhouettes(data, models) if ks else {}
    finally:
        data.arrays.unpersist()
    best, best_score = min_k, -1.0
    for k in ks:
        if scores[k] > best_score:
            best, best_score = k, scores[k]
    return best, models[best]


def label_for_center(center: list[float], terms: list[str], top: int) -> str:
    """Top positive-weight terms of a center joined by ', ' (ties by term),
    or 'miscellaneous'."""
    order = sorted(range(len(center)), key=lambda i: (-center[i], terms[i]))[:top]
    picked = [terms[i] for i in order if center[i] > 0]
    return ", ".join(picked) if picked else D.MISC_LABEL


def center_labels(centers: DataFrame, top: int, cluster_col: str = "cluster") -> DataFrame:
    """Label per cluster from a long center table (cluster, term, weight)."""
    from pyspark.sql import Window
    w = Window.partitionBy(cluster_col).orderBy(F.col("weight").desc(), F.col("term"))
    ranked = (centers.withColumn("_rn", F.row_number().over(w))
              .where((F.col("_rn") <= top) & (F.col("weight") > 0)))
    lab = (ranked.groupBy(cluster_col)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "term"))),
                                         lambda x: x["term"]), ", ").alias("label")))
    allc = centers.select(cluster_col).distinct()
    return allc.join(lab, cluster_col, "left").select(
        cluster_col, F.coalesce(F.col("label"), F.lit(D.MISC_LABEL)).alias("label"))
