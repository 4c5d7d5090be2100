"""k-means by repeated assignment, its error, and the library version."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.operators.actions import take_sample
from millrace.operators.grouping import vector_means, vector_sums

Centers = Sequence[Sequence[float]]
#: Numbers in a block of points: a megabyte.
BLOCK = 1 << 17


def nearest(vector: Column, centers: Centers) -> Column:
    """Number (from 1) and squared distance of the nearest centre; the lower number wins ties; both null for a null vector.

    A distance stops at the shorter vector. The centres travel with the function:
    they are the k x d numbers of the model, which the driver holds anyway. Array
    expressions say the same, but took about five times as long per vector.
    """
    fixed = [np.asarray(center, dtype=float) for center in centers]

    @F.arrow_udf("center int, distance double")
    def closest(vectors: pa.Array) -> pa.Array:
        best = np.zeros(len(vectors), dtype="int32")
        distance = np.zeros(len(vectors))
        for rows, points, _ in _by_length(vectors):
            best[rows], distance[rows] = _closest(points, fixed)
        missing = vectors.is_null().to_numpy(zero_copy_only=False)
        found = [pa.array(best + 1, mask=missing), pa.array(distance, mask=missing)]
        return pa.StructArray.from_arrays(found, ["center", "distance"])

    return closest(vector)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of vectors: their places, the matrix of them with NaN for null components, and where those are; no null vectors."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    absent = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else np.zeros(len(flat), bool)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        if len(rows) * length == len(values):  # all others are empty or null
            at = slice(None)
        else:
            at = (starts[rows][:, None] + np.arange(length)).reshape(-1)
        yield rows, values[at].reshape(len(rows), length), absent[at].reshape(len(rows), length)


def _closest(points: np.ndarray, centers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place (from 0) and squared distance of the nearest centre of each row."""
    squares = np.empty((len(centers), len(points)))
    for i, center in enumerate(centers):
        shared = min(points.shape[1], len(center))
        off = points[:, :shared] - center[:shared]
        squares[i] = np.einsum("ij,ij->i", off, off)
    return squares.argmin(axis=0), squares.min(axis=0)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors ``x`` of equal length as the bytes of a matrix of about ``BLOCK`` numbers; ``absent`` where it has nulls."""
    for batch in batches:
        for _, points, absent in _by_length(batch["x"]):
            length = points.shape[1]
            step = max(1, BLOCK // max(length, 1))
            for first in range(0, len(points) if length else 0, step):
                part, none = points[first : first + step], absent[first : first + step]
                yield pa.record_batch(
                    {
                        "length": pa.array([length], pa.int32()),
                        "points": pa.array([part.tobytes()], pa.binary()),
                        "absent": pa.array([none.tobytes() if none.any() else None], pa.binary()),
                    }
                )


def _sums(sent):
    """Per task, for each centre two vectors over the points nearest to it: ``counted`` false, sums; true, numbers of values."""

    def run(batches):
        centers = sent.value
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, points, absent in zip(*(batch[c] for c in ("length", "points", "absent")), strict=True):
                points = np.frombuffer(points.as_buffer(), float).reshape(-1, length.as_py())
                best = _closest(points, centers)[0]
                there = None
                if absent.is_valid:
                    there = ~np.frombuffer(absent.as_buffer(), bool).reshape(points.shape)
                    points = np.where(there, points, 0.0)
                for place in np.unique(best).tolist():
                    own = best == place
                    n = np.full(points.shape[1], own.sum(), float) if there is None else there[own].sum(axis=0, dtype=float)
                    part = np.stack([points[own].sum(axis=0), n])
                    known = found.get(place, part[:, :0])
                    short, long = sorted((known, part), key=lambda p: p.shape[1])
                    found[place] = long.copy()
                    found[place][:, : short.shape[1]] += short
        for place, both in found.items():
            yield pa.record_batch(
                {
                    "center": pa.array([place + 1] * 2, pa.int32()), "counted": pa.array([False, True]),
                    "sums": pa.array(both.tolist(), pa.list_(pa.float64())),
                }
            )

    return run


def seed_centers(points: DataFrame, k: int, seed: int) -> list[list[float]]:
    """``k`` points drawn without replacement as first centres."""
    return [list(row.x) for row in take_sample(points.select("id", "x"), k, "id", seed).collect()]


def lloyd(
    points: DataFrame,
    k: int,
    converge: float,
    seed: int = 42,
    max_rounds: int | None = None,
    centers: Centers | None = None,
) -> list[list[float]]:
    """Centres found from ``points(id, x)``.

    Rounds go on while the squared moves of the centres sum to more than
    ``converge``; that sum counts as 1.0 before the first round. A centre without
    points stays where it is, and so does a dimension of one whose points have no
    value there. The points are kept as blocks of numbers, each task sums up its
    own by centre, and only k x d means per round come to the driver.
    """
    current = [list(c) for c in centers or seed_centers(points, k, seed)]
    context = points.sparkSession.sparkContext
    blocks = points.select("x").mapInArrow(_blocks, "length int, points binary, absent binary").persist(StorageLevel.MEMORY_AND_DISK)
    shift, rounds = 1.0, 0
    try:
        while shift > converge and (max_rounds is None or rounds < max_rounds):
            sent = context.broadcast([np.asarray(c, dtype=float) for c in current])
            parts = blocks.mapInArrow(_sums(sent), "center int, counted boolean, sums array<double>")
            moved: dict[int, dict[int, dict[bool, float]]] = {}
            for row in vector_sums(parts, ["center", "counted"], "sums").collect():
                moved.setdefault(row.center, {}).setdefault(row.dim, {})[row.counted] = row.total
            sent.unpersist()
            shift = 0.0
            for number, found in moved.items():
                old = dict(enumerate(current[number - 1]))
                new = [found[d][False] / found[d][True] if found[d][True] else old.get(d, 0.0) for d in sorted(found)]
                shift += sum((a - b) ** 2 for a, b in zip(current[number - 1], new))
                current[number - 1] = new
            rounds += 1
    finally:
        blocks.unpersist()
    return current


def squared_error(points: DataFrame, centers: Centers) -> DataFrame:
    """Sum of squared distances to the nearest centre."""
    return points.select(nearest(F.col("x"), centers)["distance"].alias("d")).agg(
        F.sum("d").alias("wssse")
    )


def features(points: DataFrame) -> DataFrame:
    """``points(x)`` as the library's vectors; nulls have none."""
    return points.where(F.col("x").isNotNull()).select("x", array_to_vector("x").alias("features"))


def library_kmeans(points: DataFrame, k: int = 2, rounds: int = 20, seed: int = 42) -> KMeansModel:
    return KMeans(k=k, maxIter=rounds, seed=seed).fit(features(points))


def centers_off_means(points: DataFrame, model: KMeansModel) -> DataFrame:
    """Per centre: its dimensions and its squared distance to the mean of the points it is nearest to."""
    numbered = [(i, d, float(v)) for i, c in enumerate(model.clusterCenters()) for d, v in enumerate(c)]
    centers = points.sparkSession.createDataFrame(numbered, "center int, dim int, at double")
    means = vector_means(
        model.transform(features(points)).withColumnRenamed("prediction", "center"), ["center"], "x"
    )
    return centers.join(means, ["center", "dim"], "left").groupBy("center").agg(
        F.count("dim").cast("int").alias("dims"),
        F.sum((F.col("at") - F.col("mean")) ** 2).alias("off"),
    )
