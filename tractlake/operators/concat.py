"""Concatenation of tractograms, with checks that their arrays fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError, DTypeError
from tractlake.model import DPG, FLOATS, Tractogram
from tractlake.operators.cast import cast_positions


def fitting(inputs: list[Tractogram], kind: str, may_lack: bool) -> dict:
    """Arrays that all inputs have. A type or width that differs is an error; a missing one too, unless ``may_lack``."""
    out = {}
    for name in sorted({n for t in inputs for n in getattr(t, kind)}):
        found = [getattr(t, kind).get(name) for t in inputs]
        there = {a for a in found if a is not None}
        if len(there) > 1:
            raise ArgumentError(f"{kind.upper()} '{name}' differs between inputs: {sorted(map(str, there))}")
        if None not in found:
            out[name] = there.pop()
        elif not may_lack:
            raise ArgumentError(f"{kind.upper()} '{name}' is missing in an input")
    return out


def renamed(t: Tractogram, prefix: str | None) -> tuple[DataFrame, DataFrame]:
    """Groups and names under a prefix; an input without groups becomes one group of that name."""
    prefix = (prefix or "").strip()
    if not prefix:
        return t.groups, t.group_names
    if t.group_names.isEmpty():
        members = t.streamlines.select(F.lit(prefix).alias("grp"), F.col("sl_id").cast("int").alias("ord"), "sl_id")
        return members, t.spark.createDataFrame([(prefix, "uint32")], "grp string, dtype string")
    named = lambda df: df.withColumn("grp", F.concat(F.lit(prefix), F.col("grp")))
    return named(t.groups), named(t.group_names)


def concatenate(inputs: list[Tractogram], group_names: list[str | None] | None = None, dtype: str | None = None, drop_dps: bool = False, drop_dpv: bool = False, drop_groups: bool = False) -> Tractogram:
    """All inputs one after another; the first one's header. Attributes of groups are dropped.

    Inputs must agree on their attributes (``drop_*``: those that some lack are left out instead). Members of a group of
    several inputs follow one another. Positions of different types pass through single precision.
    """
    if not inputs:
        raise ArgumentError("nothing to concatenate")
    if group_names is not None and len(group_names) != len(inputs):
        raise ArgumentError(f"{len(group_names)} group names for {len(inputs)} inputs")
    dps, dpv = fitting(inputs, "dps", drop_dps), fitting(inputs, "dpv", drop_dpv)
    target = dtype or inputs[0].dtype
    if target not in FLOATS:
        raise DTypeError(f"positions can't be {target}")
    columns = ["sl_id", "points", *(f"dps_{n}" for n in dps), *(f"dpv_{n}" for n in dpv)]
    same = len({t.dtype for t in inputs} | {target}) == 1
    rows, members, names, base = [], [], [], 0
    # all inputs counted in one job
    sizes = dict(reduce(DataFrame.union, [t.streamlines.select(F.lit(i).alias("i")) for i, t in enumerate(inputs)]).groupBy("i").count().collect())
    for i, t in enumerate(inputs):
        part = t if same else cast_positions(t, target)
        rows.append(part.streamlines.select(*(F.col(f"`{c}`") for c in columns)).withColumn("sl_id", F.col("sl_id") + base))
        if not drop_groups:
            g, n = renamed(t, group_names[i] if group_names else None)
            members.append(g.select("grp", F.lit(i).alias("input"), "ord", (F.col("sl_id") + base).alias("sl_id")))
            names.append(n.select("grp", "dtype"))
        base += sizes.get(i, 0)
    streamlines = reduce(DataFrame.unionByName, rows)
    if drop_groups or not members:
        return Tractogram.of(streamlines, inputs[0].header, target, dps, dpv)
    every = reduce(DataFrame.union, names).distinct()
    clash = every.groupBy("grp").count().where("count > 1").head(1)
    if clash:
        raise ArgumentError(f"group '{clash[0]['grp']}' has different types")
    floats = every.where(F.col("dtype").isin(*FLOATS)).head(1)
    if floats:
        raise DTypeError(f"group '{floats[0]['grp']}' is {floats[0]['dtype']}")
    return Tractogram.of(streamlines, inputs[0].header, target, dps, dpv, joined_members(reduce(DataFrame.union, members)), every, inputs[0].spark.createDataFrame([], DPG))


def joined_members(members: DataFrame) -> DataFrame:
    """ord over all inputs: what the inputs before hold of a group, and the old ord. ord must be gapless in each input."""
    from pyspark.sql.window import Window

    sizes = members.groupBy("grp", "input").count()
    bases = sizes.select("grp", "input", (F.sum("count").over(Window.partitionBy("grp").orderBy("input")) - F.col("count")).alias("base"))
    return members.join(bases, ["grp", "input"]).select("grp", (F.col("base") + F.col("ord")).cast("int").alias("ord"), "sl_id")
