"""Vector expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero, null where the lengths differ or a vector is null."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def parse(json: Column) -> Column:
    """A vector from a JSON array of numbers only, else null."""
    v = F.from_json(json, "array<double>")
    return F.when(json.rlike(r"^\s*\[[^\[\]{}\"a-df-zA-DF-Z]*\]\s*$") & ~F.exists(v, lambda x: x.isNull()), v)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
