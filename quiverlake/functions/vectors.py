"""Vector arithmetic as columns, summed in double precision in the order of components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values) -> Column:
    """A constant vector of doubles."""
    return F.lit([float(x) for x in values]).cast("array<double>")


def _pairwise(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of two vectors of one length; an error if the lengths differ, null if either is null."""

    def checked(a: Column, b: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" components"))).cast("double")
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), body(a, b)).otherwise(wrong)

    return let(F.struct(doubles(a).alias("a"), doubles(b).alias("b")), lambda p: checked(p["a"], p["b"]))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _pairwise(a, b, lambda a, b: _total(F.zip_with(a, b, lambda x, y: x * y)))


def squared_l2(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda a, b: _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector over its length, in float; a zero vector stays."""

    def scaled(p: Column) -> Column:
        return F.when(p["n"] == 0, p["v"].cast("array<float>")).otherwise(F.transform(p["v"], lambda x: (x / p["n"]).cast("float")))

    return let(doubles(v), lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def centred(v: Column) -> Column:
    """The vector less the mean of its components, in float."""
    mean = lambda v: (_total(v) / F.size(v)).cast("float").cast("double")
    return let(doubles(v), lambda v: let(F.struct(v.alias("v"), mean(v).alias("m")), lambda p: F.transform(p["v"], lambda x: (x - p["m"]).cast("float"))))


def rolled(v: Column, shift: int = 1) -> Column:
    """Components moved ``shift`` places to the right, the last ones to the front."""

    def cut(v: Column) -> Column:
        n = F.size(v)
        s = F.pmod(F.lit(shift), n)
        return F.when(s == 0, v).otherwise(F.concat(F.slice(v, n - s + 1, s), F.slice(v, F.lit(1), n - s)))

    return let(v, cut)


def mean_vector(v: Column, dim: int) -> Column:
    """The mean of a group's vectors, component by component."""
    return F.array(*[F.avg(F.element_at(v, k + 1).cast("double")) for k in range(dim)])
