"""Centroid clustering with geometric drift tightening.

Lloyd rounds over whole-number vectors (each component x becomes floor(scale * x)).
Every vector keeps its cluster, an upper bound on the distance to its centroid and
a lower bound for every other centroid. When centroids move, a lower bound must
shrink by as much as any vector of the cluster can have come nearer to the moved
centroid. That isn't its full drift D. The vectors of cluster i lie in the sphere of
radius r (the largest upper bound) around its centroid c; with m the middle of the
old place a and the new place b of another centroid,

    |x-a| - |x-b| = 2 (x-m).(b-a) / (|x-a| + |x-b|) <= D cos(angle of x-m and b-a)

as |x-a| + |x-b| >= 2 |x-m|. In the plane through m, b and c the sphere lies in a cone
of half angle asin(r / |c-m|) around c-m, so the cosine is at most that of the angle
between c-m and b-a less the half angle: the loosening is D times this, and nothing
where the whole cone points away from the move. A vector whose upper bound is below
all its lower bounds stays where it is; first the upper bound is made exact, and what
is still ambiguous is scanned exactly against all centroids.

Each round writes its state (vector, cluster, bounds) to the shared folder and reads it
again, so a lost executor costs a re-read. Coordinate sums are kept up by the vectors
that moved alone. The driver holds k centroids of d whole numbers and their sums.
Distances are exact whole numbers: in float64 while all values are small enough, else
as Python integers.

Defined cases: vectors of another length, with null or non-finite components, and null
vectors are left out. Fewer kept vectors than k make as many centroids. Repeated rows
and ids are kept; seeds are ordered by (hash, vector), a null id hashes as the empty
text. Equal centroids keep the smaller number. A distance over 2**63-1 is null, and so
are the sums it is part of. An empty table gives no rows. Other columns are carried;
the added columns replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField

from reasonscope.llm.common import append, drop_folder, extended, without, working_folder
from reasonscope.session import bounded_broadcast, literal_table, ship_package

SLACK = 1e-12        # relative room for rounding in every bound
NARROW = 1 << 15     # scaled components up to here are stored as 16-bit numbers
EXACT = 1 << 21      # up to here float64 distances of 64 components are exact
LIMB = 30            # sums travel as base 2**30 digits
LONGEST = (1 << 63) - 1
STATE = ("_x", "cluster", "_was", "_upper", "_lower", "_scanned", "distance")


@dataclass
class Clusters:
    """``rows``: the kept rows with ``cluster`` and ``distance``; ``centers``: whole
    numbers; ``scanned``: vectors scanned in full by each assignment, of ``total``."""
    rows: DataFrame
    centers: list[list[int]]
    total: int = 0
    scanned: list[int] = field(default_factory=list)


def usable(vec: Column, dim: int) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & finite


def _scaled(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2**40 else int(x) * scale


def _store(rows: np.ndarray, scale: int) -> list[bytes]:
    """A vector as 16-bit scaled numbers, or its own float64 components if they are too large."""
    with np.errstate(over="ignore"):
        whole = np.floor(rows * scale)
    small = np.abs(whole).max(axis=1, initial=0) < NARROW
    return [(whole[i].astype("<i2") if s else rows[i].astype("<f8")).tobytes() for i, s in enumerate(small)]


def _load(stored: list[bytes], dim: int, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Scaled vectors as float64 rows, and apart from them the wide ones by row."""
    if all(len(b) == 2 * dim for b in stored):
        return np.frombuffer(b"".join(stored), "<i2").reshape(-1, dim).astype(np.float64), {}
    out, wide = np.zeros((len(stored), dim)), {}
    for i, b in enumerate(stored):
        if len(b) == 2 * dim:
            out[i] = np.frombuffer(b, "<i2")
        else:
            wide[i] = [_scaled(v, scale) for v in np.frombuffer(b, "<f8").tolist()]
    return out, wide


def _far(centers: list[list[int]]) -> bool:
    return any(abs(v) > EXACT for c in centers for v in c)


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def _float(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.copysign(math.inf, x)


def drifts(old: list[list[int]], new: list[list[int]], radius: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Full drift of each centroid, and how much the lower bound of a vector of cluster
    i loosens for centroid j (see the module); infinite where no bound can be had."""
    k = len(old)
    if _far(old) or _far(new):
        return np.full(k, np.inf), np.full((k, k), np.inf)
    a, b = np.array(old, np.float64), np.array(new, np.float64)
    full = np.sqrt(((b - a) ** 2).sum(axis=1))
    loosen = np.zeros((k, k))
    for i in range(k):
        if not radius[i] < np.inf:
            loosen[i] = np.inf
            continue
        for j in np.flatnonzero(full):
            away = a[i] - (a[j] + b[j]) / 2
            h = math.sqrt(float(away @ away))
            if radius[i] >= h:
                loosen[i, j] = full[j]
                continue
            cos = max(-1.0, min(1.0, float(away @ (b[j] - a[j])) / (h * full[j])))
            sin_half = radius[i] / h
            cos_half = math.sqrt(1 - sin_half * sin_half)
            most = 1.0 if cos >= cos_half else cos * cos_half + math.sqrt(1 - cos * cos) * sin_half
            loosen[i, j] = full[j] * min(1.0, max(0.0, most + 1e-7))  # room for the square roots near 0
    return full * (1 + SLACK), loosen * (1 + SLACK)


def _assign(centers: list[list[int]], moved: tuple[np.ndarray, np.ndarray] | None, dim: int, scale: int, last: bool):
    """One assignment. ``moved`` None: there are no bounds yet."""
    k, far = len(centers), _far(centers)
    places = None if far else np.array(centers, np.float64)
    norms = None if far else (places * places).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                stored = batch.column("_x").to_pylist()
                x, wide = _load(stored, dim, scale)
                if moved is None:
                    was, upper, lower = np.full(n, -1), np.full(n, np.inf), np.full((n, k), -np.inf)
                else:
                    was = batch.column("cluster").to_numpy().astype(np.int64)
                    lower = np.frombuffer(b"".join(batch.column("_lower").to_pylist()), "<f8").reshape(n, k)
                    upper = batch.column("_upper").to_numpy() + moved[0][was]
                    loosen = moved[1][was]
                    with np.errstate(invalid="ignore"):
                        lower = np.nan_to_num(lower - loosen - SLACK * (np.abs(lower) + loosen), nan=-np.inf, neginf=-np.inf, posinf=np.inf)
                    lower[np.arange(n), was] = np.inf
                odd = np.zeros(n, bool)
                odd[list(wide) if not far else np.arange(n)] = True
                label = was.copy()
                own = [0] * n
                open_ = (upper >= lower.min(axis=1)) | (was < 0) | odd
                plain = np.flatnonzero(~odd)
                if moved is not None:   # the distance to the own centroid first, where it is asked for
                    near = plain if last else plain[open_[plain]]
                    exact = ((x[near] - places[was[near]]) ** 2).sum(axis=1) if len(near) else np.zeros(0)
                    upper[near] = np.sqrt(exact) * (1 + SLACK)
                    for i, d in zip(near.tolist(), exact.tolist()):
                        own[i] = int(d)
                    open_[near] = upper[near] >= lower[near].min(axis=1)
                scan = plain[open_[plain]]
                if len(scan):
                    v = x[scan]
                    distances = (v * v).sum(axis=1)[:, None] - 2 * v @ places.T + norms[None, :]
                    label[scan] = distances.argmin(axis=1)
                    roots = np.sqrt(distances)
                    lower[scan] = roots * (1 - SLACK)
                    best = distances[np.arange(len(scan)), label[scan]]
                    upper[scan] = np.sqrt(best) * (1 + SLACK)
                    lower[scan, label[scan]] = np.inf
                    for i, d in zip(scan.tolist(), best.tolist()):
                        own[i] = int(d)
                for i in np.flatnonzero(odd).tolist():
                    vector = wide.get(i) or [int(v) for v in x[i].tolist()]
                    found = [squared(vector, c) for c in centers]
                    own[i] = min(found)
                    label[i], upper[i], lower[i] = found.index(own[i]), np.inf, -np.inf
                scanned = odd.copy()
                scanned[scan] = True
                yield append(batch, cluster=pa.array(label.astype(np.int32)), _was=pa.array(was.astype(np.int32)),
                             _upper=pa.array(upper), _lower=pa.array([r.tobytes() for r in lower.astype("<f8")], pa.binary()),
                             _scanned=pa.array(scanned.astype(np.int32)),
                             distance=pa.array([d if last and d <= LONGEST else None for d in own], pa.int64()))
    return run


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2**30; the last digit has the sign."""
    place = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield place, value & (1 << LIMB) - 1
        value >>= LIMB
        place += 1
    yield place, value


def _moves(dim: int, scale: int):
    """What the moved vectors of a partition add to the sums of their new cluster and
    take from those of their old one; component -1 is the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}

        def add(cluster: int, values: list[int]) -> None:
            total[cluster] = [a + b for a, b in zip(total.get(cluster, [0] * (dim + 1)), values)]

        for batch in batches:
            x, wide = _load(batch.column("_x").to_pylist(), dim, scale)
            x = np.column_stack([x.astype(np.int64), np.ones(len(x), np.int64)])
            for column, sign in (("cluster", 1), ("_was", -1)):
                label = batch.column(column).to_numpy()
                for c in np.unique(label[label >= 0]).tolist():
                    add(c, (sign * x[label == c].sum(axis=0)).tolist())
                for i, v in wide.items():
                    if label[i] >= 0:
                        add(int(label[i]), [sign * w for w in v] + [0])
        rows = [(c, i if i < dim else -1, place, digit) for c, values in total.items() for i, v in enumerate(values)
                for place, digit in _digits(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "place", "digit"])
    return run


def _quantise(vec_col: str, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                stored = _store(flat.reshape(batch.num_rows, -1), scale)
                yield append(batch.select([c for c in batch.schema.names if c != vec_col]), _x=pa.array(stored, pa.binary()))
    return run


def cluster(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", k: int = 16, rounds: int = 3,
            dim: int = 64, scale: int = 64, seed: str = "1") -> Clusters:
    """``rounds`` rounds of assigning and moving centroids, and a last assignment. The
    first centroids are the k vectors of smallest sha256 of ``seed:id``."""
    spark = vectors.sparkSession
    ship_package(spark)
    kept = without(vectors, STATE).where(usable(F.col(vec_col), dim)).withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    first = kept.select(F.col(vec_col).alias("v"), name.alias("h")).orderBy("h", "v").limit(k).collect()  # k rows
    centers = [[_scaled(v, scale) for v in r["v"]] for r in first]
    if not centers:
        empty = kept.select(*[F.col(f"`{c}`") for c in kept.columns if c != vec_col])
        return Clusters(empty.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}), [])
    source = kept.mapInArrow(_quantise(vec_col, scale), extended(
        without(kept, (vec_col,)).schema, StructField("_x", BinaryType())))
    schema = extended(source.schema, StructField("cluster", IntegerType()), StructField("_was", IntegerType()),
                      StructField("_upper", DoubleType()), StructField("_lower", BinaryType()),
                      StructField("_scanned", IntegerType()), StructField("distance", LongType()))
    sums = [[0] * (dim + 1) for _ in centers]
    out, state, moved = Clusters(vectors, centers), source, None
    folder = working_folder(spark, "centroids")
    for turn in range(rounds + 1):
        state.mapInArrow(_assign(centers, moved, dim, scale, turn == rounds), schema).write.parquet(f"{folder}/{turn}")
        if turn:
            drop_folder(spark, f"{folder}/{turn - 1}")
        state = spark.read.parquet(f"{folder}/{turn}")
        seen = state.groupBy("cluster").agg(F.max("_upper").alias("r"), F.count(F.lit(1)).alias("n"), F.sum("_scanned").alias("s")).collect()
        out.total = sum(r["n"] for r in seen)
        out.scanned.append(sum(r["s"] for r in seen))
        if turn == rounds:
            break
        parts = (state.where(F.col("cluster") != F.col("_was")).select("_x", "cluster", "_was")
                 .mapInArrow(_moves(dim, scale), "cluster int, component int, place int, digit long")
                 .groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit")).collect())  # k x d numbers
        for p in parts:
            sums[p["cluster"]][p["component"]] += p["digit"] << LIMB * p["place"]
        new = [[v // s[-1] for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centers)]
        radius = {r["cluster"]: r["r"] for r in seen}
        moved = drifts(centers, new, [radius.get(i, 0.0) for i in range(len(centers))])
        centers = new
    out.centers = centers
    out.rows = state.drop("_x", "_was", "_upper", "_lower", "_scanned")
    return out


def with_inertia(found: Clusters) -> DataFrame:
    """The rows with ``cluster_inertia``, ``inertia`` (null where a distance or the sum
    exceeds a long) and ``center`` (the centroid's decimal components, comma-joined)."""
    rows = without(found.rows, ("cluster_inertia", "inertia", "center"))
    spark, k = rows.sparkSession, len(found.centers)
    whole = {r["cluster"]: r["s"] if r["n"] == r["m"] else None for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
    fits = lambda v: int(v) if v is not None and v <= LONGEST else None
    total = None if None in whole.values() else fits(sum(whole.values()))
    table = literal_table(spark, [(i, fits(whole.get(i, 0)), total, ",".join(map(str, c))) for i, c in enumerate(found.centers)],
                          "cluster int, cluster_inertia long, inertia long, center string")
    return rows.join(bounded_broadcast(table, k), "cluster", "left")
