"""Logistic regression by full-batch gradient steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.operators.grouping import vector_sums

# The 48-bit linear congruence behind the first weights.
MULTIPLIER = 25214903917
INCREMENT = 11
MODULUS = 1 << 48


def first_weights(dims: int, seed: int = 42) -> list[float]:
    """Uniform weights in [-1, 1), from the standard 48-bit congruential generator."""
    state = (seed ^ MULTIPLIER) % MODULUS

    def bits(n: int) -> int:
        nonlocal state
        state = (state * MULTIPLIER + INCREMENT) % MODULUS
        return state >> (48 - n)

    return [2 * (((bits(26) << 27) + bits(27)) / (1 << 53)) - 1 for _ in range(dims)]


def dimensions(points: DataFrame) -> int:
    """Length of the longest vector of ``points(x)``; 0 without vectors."""
    return max(points.agg(F.max(F.size("x"))).first()[0] or 0, 0)


def logistic_weights(points: DataFrame, weights: Sequence[float], rounds: int) -> list[float]:
    """Weights after ``rounds`` steps over ``points(y, x)`` with labels of +1 and -1.

    The step is 1, with no intercept and no penalty. A vector that is shorter than the
    weights has zeros at its end; a row with a null label, vector or component gives
    nothing. Each Arrow batch becomes one vector of sums, and those are added up by
    dimension; so neither the plan nor what comes back grows but with the dimensions.
    """
    if not weights:
        return []
    points = points.select("y", "x").persist(StorageLevel.MEMORY_AND_DISK)
    w = np.array(weights, float)
    try:
        for _ in range(rounds):
            pulls = points.mapInArrow(_gradients(points.sparkSession.sparkContext.broadcast(w)), "gradient array<double>")
            for row in vector_sums(pulls, [], "gradient").toLocalIterator():
                w[row.dim] -= row.total
    finally:
        points.unpersist()
    return w.tolist()


def _gradients(sent):
    """Per batch of ``y, x`` the sum of ``(1 / (1 + exp(-y * w.x)) - 1) * y * x``."""

    def run(batches):
        w = sent.value
        for batch in batches:
            batch = batch.filter(pc.and_(batch["y"].is_valid(), batch["x"].is_valid()))
            count, parent = batch.num_rows, pc.list_parent_indices(batch["x"]).to_numpy()
            value = pc.list_flatten(batch["x"]).to_numpy(zero_copy_only=False).astype(float)
            starts = np.searchsorted(parent, np.arange(count))
            dim = np.arange(len(value)) - starts[parent]
            inside = dim < len(w)
            parent, value, dim = parent[inside], value[inside], dim[inside]
            y = batch["y"].to_numpy(zero_copy_only=False).astype(float)
            margin = np.bincount(parent, value * w[dim], count)
            with np.errstate(over="ignore"):
                pull = (1 / (1 + np.exp(-y * margin)) - 1) * y
            known = ~np.isnan(pull[parent])
            sums = np.bincount(dim[known], (pull[parent] * value)[known], len(w))
            yield pa.record_batch({"gradient": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    return run
