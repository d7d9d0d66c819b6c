"""Column expressions on ``ARRAY<DOUBLE>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from localexplain.functions.draws import double


def literal(values) -> Column:
    """A constant vector; the values come from a model or background of D numbers."""
    return F.expr("array(" + ", ".join(double(v) for v in values) + ")")


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))


# Sums over short vectors are written out: higher-order functions are interpreted per element,
# written-out terms are part of the generated code.
UNROLLED = 32


def dot_of(a: str, b: str, d: int) -> Column:
    """``dot`` of two vector columns of known length."""
    if d > UNROLLED:
        return dot(F.col(a), F.col(b))
    return F.expr(" + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(d)))


def squared_distance_of(a: str, b: str, d: int) -> Column:
    if d > UNROLLED:
        return squared_distance(F.col(a), F.col(b))
    return F.expr(" + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(d)))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def by_strength(coeff: Column) -> Column:
    """Structs (key, idx) of the features by falling |coefficient|, ties by feature index."""
    return F.array_sort(
        F.transform(coeff, lambda v, i: F.struct((-F.abs(v)).alias("key"), i.alias("idx")))
    )


def ordinal_ranks(vec: Column) -> Column:
    """0-based rank of every element, ties by position (ranks are never averaged)."""
    order = F.array_sort(F.transform(vec, lambda v, i: F.struct(v.alias("key"), i.alias("idx"))))
    places = F.array_sort(
        F.transform(order, lambda s, r: F.struct(s["idx"].alias("idx"), r.alias("rank")))
    )
    return F.transform(places, lambda s: s["rank"])


def tidy(col: Column, digits: int = 6) -> Column:
    """Rounded for reports; adding zero turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)
