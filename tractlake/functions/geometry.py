"""Geometry as column expressions, and the same registered for SQL. All stay in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def f32(value: float) -> Column:
    """A FLOAT literal, so that comparing it with a FLOAT column does not widen the column."""
    return F.lit(float(np.float32(value))).cast("float")


def lowest(points: Column, axis: str) -> Column:
    """Smallest coordinate without NaN; infinity where there is none. NaN sorts last, so it is the least only of NaNs."""
    least = F.array_min(points[axis])
    return F.when(least.isNull() | F.isnan(least), F.lit(float("inf")).cast("float")).otherwise(least.cast("float"))


def highest(points: Column, axis: str) -> Column:
    """Largest coordinate without NaN; only where there is one are the others picked out."""
    most = F.array_max(points[axis])
    others = F.array_max(F.filter(points[axis], lambda v: ~F.isnan(v)))
    return F.coalesce(F.when(F.isnan(most), others).otherwise(most), F.lit(float("-inf"))).cast("float")


def box(points: Column) -> list[Column]:
    """The six columns of a bounding box: x_min .. z_max."""
    return [lowest(points, a).alias(f"{a}_min") for a in AXES] + [highest(points, a).alias(f"{a}_max") for a in AXES]


def overlaps(low: list[float], high: list[float]) -> Column:
    """Whether a row's box meets a closed box, in single precision."""
    out = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        out = out & (F.col(f"{a}_min") <= f32(hi)) & (F.col(f"{a}_max") >= f32(lo))
    return out


def steps(points: Column) -> Column:
    """Pairs of neighbouring points."""
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(points: Column) -> Column:
    """Length in double precision: differences in single precision, then widened."""
    square = lambda s, a: F.pow((s["b"][a] - s["a"][a]).cast("double"), F.lit(2.0))
    return F.aggregate(steps(points), F.lit(0.0), lambda total, s: total + F.sqrt(square(s, "x") + square(s, "y") + square(s, "z")))


def distance32(a: Column, b: Column) -> Column:
    """Euclidean distance with every step in single precision."""
    d = [(a[x].cast("float") - b[x].cast("float")).cast("float") for x in AXES]
    return F.sqrt(((d[0] * d[0]).cast("float") + (d[1] * d[1]).cast("float") + (d[2] * d[2]).cast("float")).cast("float")).cast("float")


def length32(points: Column) -> Column:
    """Length in single precision throughout."""
    return F.aggregate(steps(points), F.lit(0.0).cast("float"), lambda total, s: (total + distance32(s["a"], s["b"])).cast("float"))


def affine(points: Column, matrix: list) -> Column:
    """Points through a 4x4 matrix in double precision, then FLOAT."""
    row = lambda p, r: (F.lit(r[0]) * p["x"] + F.lit(r[1]) * p["y"] + F.lit(r[2]) * p["z"] + F.lit(r[3])).cast("float")
    return F.transform(points, lambda p: F.struct(*(row(p, [float(v) for v in matrix[i]]).alias(a) for i, a in enumerate(AXES))))


def flip_lps(points: Column) -> Column:
    """LPS to RAS and back: x and y change sign."""
    return F.transform(points, lambda p: F.struct((-p["x"]).alias("x"), (-p["y"]).alias("y"), p["z"].alias("z")))


def translate(points: Column, by: float) -> Column:
    return F.transform(points, lambda p: F.struct(*((p[a] + f32(by)).cast("float").alias(a) for a in AXES)))


def minus_zeros(points: Column) -> Column:
    """Where coordinates are -0.0, as hashes and comparisons take it for 0.0: places times three, plus the axis."""
    minus = lambda v: (v == 0) & (v.cast("string") == "-0.0")

    def of(axis: str, k: int) -> Column:
        return F.filter(F.transform(points, lambda p, i: F.when(minus(p[axis]), i * 3 + k)), lambda v: v.isNotNull())

    # most axes have no zero at all, which is seen without a loop in lambdas
    some = lambda axis, k: F.when(F.array_contains(points[axis], f32(0.0)), of(axis, k)).otherwise(F.array().cast("array<int>"))
    return F.concat(*(some(a, k) for k, a in enumerate(AXES)))


def geometry_key(points: Column) -> Column:
    """128 bits (two numbers) that are equal where all coordinates are equal bit by bit, in this direction; NaNs are alike."""
    odd = minus_zeros(points)
    return F.struct(*(F.xxhash64(F.lit(seed), points, F.size(points), odd).alias(f"k{seed}") for seed in (1, 2)))


def canonical(points: Column) -> Column:
    """The points in the direction that sorts first; a palindrome stays."""
    return F.least(points, F.reverse(points))


def canonical_key(points: Column) -> Column:
    """A geometry key that does not depend on direction."""
    return F.least(geometry_key(points), geometry_key(F.reverse(points)))


def cell(value: Column, size: float) -> Column:
    """Grid cell of a coordinate, in single precision; NaN is in cell 0 and far values in the last one."""
    q = (value.cast("float") / f32(size)).cast("float")
    whole = F.when(F.isnan(q), F.lit(0.0)).otherwise(F.least(F.greatest(q.cast("double"), F.lit(float(INT_MIN))), F.lit(float(INT_MAX))))
    return F.floor(whole).cast("int")


def first_point(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last_point(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def rgb(packed: Column) -> Column:
    """0xRRGGBB as three numbers."""
    return F.array(*(F.shiftright(packed, s).bitwiseAND(F.lit(255)).cast("int") for s in (16, 8, 0)))


def safe_name(name: Column) -> Column:
    """A group's name without characters that paths can't hold."""
    return F.trim(F.translate(name, "/\\:\0", "____"))


def register(spark: SparkSession) -> None:
    """Make the helpers callable from SQL, as SQL functions that Catalyst sees through."""
    kind = "ARRAY<STRUCT<x: FLOAT, y: FLOAT, z: FLOAT>>"
    key = "array_join(transform(points, p -> concat_ws(',', string(p.x), string(p.y), string(p.z))), ';')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION geometry_key(points {kind}) RETURNS STRING RETURN {key}")
    back = key.replace("transform(points", "transform(reverse(points)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION canonical_key(points {kind}) RETURNS STRING RETURN least({key}, {back})")
    step = "aggregate(sequence(1, greatest(size(points) - 1, 1)), 0D, (t, i) -> t + coalesce(sqrt(" + " + ".join(f"pow(double(get(points, i).{a} - get(points, i - 1).{a}), 2)" for a in AXES) + "), 0D))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tract_length(points {kind}) RETURNS DOUBLE RETURN {step}")
    low = [f"coalesce(array_min(filter(transform(points, p -> p.{a}), v -> NOT isnan(v))), float('inf')) <= h{a}" for a in AXES]
    high = [f"coalesce(array_max(filter(transform(points, p -> p.{a}), v -> NOT isnan(v))), float('-inf')) >= l{a}" for a in AXES]
    box_ = ", ".join(f"l{a} FLOAT" for a in AXES) + ", " + ", ".join(f"h{a} FLOAT" for a in AXES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION aabb_overlaps(points {kind}, {box_}) RETURNS BOOLEAN RETURN {' AND '.join(low + high)}")
