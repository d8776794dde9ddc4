"""Validation, comparison and summaries of tractograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError
from tractlake.functions import geometry as G
from tractlake.model import Header, Tractogram
from tractlake.operators.setops import _ids, representatives
from tractlake.operators.subset import subset


def inverse(matrix: list) -> np.ndarray:
    """Inverse of an affine; a singular one is an error."""
    m = np.array(matrix, dtype=float)
    if abs(np.linalg.det(m[:3, :3])) < 1e-12:
        raise ArgumentError("the affine is singular")
    return np.linalg.inv(m)


def inside(points: Column, header: Header) -> Column:
    """Whether all points lie in the volume: 0 <= voxel < dimension on each axis. An empty streamline does."""
    inv = inverse(header.affine)

    def ok(p):
        out = F.lit(True)
        for r, d in zip(inv[:3], header.dimensions, strict=True):
            v = F.lit(float(r[0])) * p["x"].cast("double") + F.lit(float(r[1])) * p["y"].cast("double") + F.lit(float(r[2])) * p["z"].cast("double") + F.lit(float(r[3]))
            out = out & ~F.isnan(v) & (v >= 0.0) & (v < float(d))
        return out

    return F.forall(points, ok)


def validate(t: Tractogram, bounds: bool = True, duplicates: bool = True) -> tuple[Tractogram, DataFrame]:
    """What passes, first by volume and then without exact duplicates, and one row of counts."""
    rows = t.streamlines.where(inside(F.col("points"), t.header)) if bounds else t.streamlines
    passing = t.with_(streamlines=rows)
    ids = representatives(passing) if duplicates else rows.select("sl_id")
    counts = t.streamlines.agg(F.count(F.lit(1)).alias("n")).crossJoin(rows.agg(F.count(F.lit(1)).alias("b"))).crossJoin(ids.agg(F.count(F.lit(1)).alias("k")))
    counts = counts.select(F.col("n").alias("n_streamlines"), (F.col("n") - F.col("b")).alias("out_of_bounds"), (F.col("b") - F.col("k")).alias("duplicates"), F.col("k").alias("n_valid"))
    return subset(t, _ids(ids), check=False), counts


def summary(t: Tractogram) -> DataFrame:
    """One row: counts, dimensions and sorted names of what there is."""
    names = lambda kind: F.array(*(F.lit(n) for n in t.names(kind))).cast("array<string>").alias(kind)
    return t.counts().select("*", F.array(*(F.lit(int(d)) for d in t.header.dimensions)).alias("dimensions"), *(names(k) for k in ("dps", "dpv", "groups", "dpg")))


def compare(a: Tractogram, b: Tractogram, deep: bool = False) -> DataFrame:
    """(what, left, right, same, only_left, only_right) for counts, dimensions and names; the last two are names that one side has.

    ``deep`` adds the number of streamlines that differ.
    """
    x, y = summary(a).first().asDict(), summary(b).first().asDict()
    missing = lambda k, of, other: sorted(set(of[k]) - set(other[k])) if k in ("dps", "dpv", "groups", "dpg") else []
    rows = [(k, str(x[k]), str(y[k]), x[k] == y[k], missing(k, x, y), missing(k, y, x)) for k in x]
    if deep:
        key = lambda t: t.streamlines.select("sl_id", G.geometry_key(F.col("points")).alias("key"))
        left, right = key(a), key(b).withColumnsRenamed({"key": "other"})
        n = left.join(right, "sl_id", "full").where(~F.col("key").eqNullSafe(F.col("other"))).count()
        rows.append(("geometry", "", f"{n} differ", n == 0, [], []))
    return a.spark.createDataFrame(rows, "what string, left string, right string, same boolean, only_left array<string>, only_right array<string>")


def length_stats(t: Tractogram) -> DataFrame:
    """One row: smallest, mean and largest length; null without streamlines."""
    lengths = t.streamlines.select(G.length(F.col("points")).alias("l"))
    return lengths.agg(F.min("l").alias("min_mm"), F.avg("l").alias("mean_mm"), F.max("l").alias("max_mm"))


def update_affine(t: Tractogram, reference: Header) -> Tractogram:
    """Affine and dimensions of another header; extras stay and positions are not moved."""
    return t.with_(header=Header(reference.affine, reference.dimensions, t.header.extra))
