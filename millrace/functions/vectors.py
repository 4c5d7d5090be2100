"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """Space-separated numbers to a vector."""
    return F.transform(F.split(text, " "), lambda token: token.cast("double"))


def parse_labelled(text: Column, dims: int | None = None) -> tuple[Column, Column]:
    """``label x0 x1 ...`` to the label and the first ``dims`` values, all of them by default."""
    numbers = parse_vector(text)
    length = F.size(numbers) - 1 if dims is None else F.lit(dims)
    return F.get(numbers, F.lit(0)), F.slice(numbers, F.lit(2), length)


def format_vector(vector: Column) -> Column:
    return F.concat_ws(" ", F.transform(vector, lambda x: x.cast("string")))


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences; stops at the shorter vector."""
    shared = F.least(F.size(a), F.size(b))
    return _fold(
        F.zip_with(F.slice(a, 1, shared), F.slice(b, 1, shared), lambda x, y: (x - y) * (x - y))
    )


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
