"""Connectivity of groups through streamlines they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError, MissingName
from tractlake.model import Tractogram


def connectivity(t: Tractogram, groups: list[str], weight: str | None = None, symmetric: bool = True) -> DataFrame:
    """(entry, i, j, value): the packed upper triangle over ``groups``, by count or by a summed attribute.

    As memberships are paired in both orders, an off-diagonal entry counts each shared streamline twice, and a diagonal
    one the square of a member's repeats. ``symmetric=False`` counts each pair once. Members that don't exist are passed
    over. A streamline's memberships are first summed up by group, so that repeats make no pairs.
    """
    have = set(t.names("groups"))
    for g in groups:
        if g not in have:
            raise MissingName(g)
    if weight is not None and weight not in t.dps:
        raise ArgumentError(f"no DPS '{weight}' to weigh by")
    n = len(groups)
    places = t.spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "grp string, i int")
    value = F.col(f"`dps_{weight}`").cast("float").cast("double") if weight else F.lit(1.0)
    if weight and t.dps[weight].ncols > 1:
        value = F.get(F.col(f"`dps_{weight}`"), F.lit(0)).cast("float").cast("double")
    members = t.groups.join(F.broadcast(places), "grp").groupBy("sl_id", "i").agg(F.count(F.lit(1)).alias("m"))
    lists = members.groupBy("sl_id").agg(F.collect_list(F.struct("i", "m")).alias("of"))  # at most one for each group
    rows = lists.join(t.streamlines.select("sl_id", value.alias("w")), "sl_id")
    left = rows.select("w", "of", F.explode("of").alias("a"))
    both = left.select("w", "a", F.explode("of").alias("b")).where("a.i <= b.i")
    twice = F.when(F.col("a.i") == F.col("b.i"), 1).otherwise(2 if symmetric else 1)
    sums = both.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("w") * F.col("a.m") * F.col("b.m") * twice).alias("v"))
    every = t.spark.createDataFrame([(i * n - i * (i + 1) // 2 + j, i, j) for i in range(n) for j in range(i, n)], "entry int, i int, j int")
    return every.join(sums, ["i", "j"], "left").select("entry", "i", "j", F.coalesce("v", F.lit(0.0)).alias("value"))
