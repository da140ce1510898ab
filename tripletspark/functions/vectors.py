"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns, computed in doubles in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def is_bad_number(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def has_bad_numbers(v: Column | str) -> Column:
    return F.exists(_doubles(v), is_bad_number)


def sanitize_vectors(v: Column | str) -> Column:
    """NaN and infinities become 0."""
    return F.transform(_doubles(v), lambda x: F.when(is_bad_number(x), 0.0).otherwise(x))


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_doubles(v), lambda x: x * x)))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    v = _doubles(v)
    # The length is bound to a lambda variable; written inside the inner lambda it would be
    # computed again for every element.
    scaled = F.transform(F.array(norm(v)), lambda length: F.transform(
        v, lambda x: F.when(length > 0, x / length).otherwise(0.0)))
    return F.element_at(scaled, 1)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 when either vector is zero (a failed embedding)."""
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


DISTANCES = {
    "cosine": cosine_distance,
    "euclidean": euclidean_distance,
    "manhattan": manhattan_distance,
}


def distance(name: str, a: Column | str, b: Column | str) -> Column:
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; one of {sorted(DISTANCES)}")
    return DISTANCES[name](a, b)
