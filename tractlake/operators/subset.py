"""Subsets of streamlines, with groups and group attributes following."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError, MissingName
from tractlake.model import Tractogram
from tractlake.operators.numbering import renumbered


def indices(t: Tractogram, old_ids: list[int]) -> DataFrame:
    """A table of new and old ids in the order given."""
    return t.spark.createDataFrame(list(enumerate(map(int, old_ids))), "new_id bigint, old_id bigint")


def subset(t: Tractogram, ids: DataFrame | list[int], drop_empty: bool = False, check: bool = True) -> Tractogram:
    """The streamlines of ``ids`` (new_id, old_id) in that order; repeats are copied again.

    A group keeps its members' order; a member that was taken repeatedly follows its last copy; members not taken go.
    Groups left empty stay, unless ``drop_empty``; their attributes go either way. An id that is not there is an error.
    """
    ids = indices(t, ids) if isinstance(ids, list) else ids
    if check:
        missing = ids.join(t.streamlines, ids["old_id"] == t.streamlines["sl_id"], "left_anti").head(1)
        if missing:
            raise ArgumentError(f"streamline {missing[0]['old_id']} is out of range")
    rows = ids.join(t.streamlines, ids["old_id"] == t.streamlines["sl_id"]).drop("sl_id", "old_id").withColumnRenamed("new_id", "sl_id")
    groups, names, dpg = remap(t, ids, drop_empty)
    return t.with_(streamlines=rows, groups=groups, group_names=names, dpg=dpg)


def remap(t: Tractogram, ids: DataFrame, drop_empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, their names, and group attributes after a subset."""
    last = ids.groupBy("old_id").agg(F.max("new_id").alias("new_id"))
    members = t.groups.join(last, t.groups["sl_id"] == last["old_id"]).select("grp", "ord", F.col("new_id").alias("sl_id"))
    members = renumber_members(members)
    filled = members.select("grp").distinct()
    names = t.group_names.withColumn("dtype", F.lit("uint32"))
    return members, names.join(filled, "grp", "left_semi") if drop_empty else names, t.dpg.join(filled, "grp", "left_semi")


def renumber_members(members: DataFrame) -> DataFrame:
    """Members with a gapless ord; groups are numbered apart, each in chunks of the old ord."""
    from pyspark.sql.window import Window

    chunk = F.floor(F.col("ord") / (1 << 16))
    rows = members.withColumn("__c", chunk)
    bases = rows.groupBy("grp", "__c").count()
    bases = bases.select("grp", "__c", (F.sum("count").over(Window.partitionBy("grp").orderBy("__c")) - F.col("count")).alias("__b"))
    place = F.row_number().over(Window.partitionBy("grp", "__c").orderBy("ord")) - 1
    return rows.withColumn("__p", place).join(bases, ["grp", "__c"]).select("grp", (F.col("__b") + F.col("__p")).cast("int").alias("ord"), "sl_id")


def in_groups(t: Tractogram, groups: list[str]) -> DataFrame:
    """Ids of the members of any of the groups, each once; a group that does not exist is an error."""
    have = {r[0] for r in t.group_names.where(F.col("grp").isin(groups)).collect()} if groups else set()
    for g in groups:
        if g not in have:
            raise MissingName(g)
    return t.groups.where(F.col("grp").isin(groups)).select("sl_id").distinct()


def choose(t: Tractogram, groups: list[str] | None = None, n: int | None = None, seed: int | None = None) -> DataFrame:
    """Old and new ids of a selection: members of groups, then the first n, or n picked by a hash with a seed; ascending."""
    ids = in_groups(t, groups) if groups else t.streamlines.select("sl_id")
    if n is not None:
        order = [F.xxhash64("sl_id", F.lit(seed))] if seed is not None else []
        ids = ids.orderBy(*order, "sl_id").limit(n)
    return renumbered(ids, "sl_id", "new_id").select("new_id", F.col("sl_id").alias("old_id"))


def take(t: Tractogram, groups: list[str] | None = None, n: int | None = None, seed: int | None = None) -> Tractogram:
    """The subset command: a selection as a tractogram of its own."""
    return subset(t, choose(t, groups, n, seed), check=False)


def export_groups(t: Tractogram, pattern: str, names: list[str] | None = None, save=None) -> list[str]:
    """One file for each group, its members in their order with repeats; returns the paths. Empty or unknown groups are passed over."""
    if "{groupname}" not in pattern:
        raise ArgumentError("the pattern needs {groupname}")
    out = []
    for name in names or t.names("groups"):
        members = t.groups.where(F.col("grp") == name)
        if members.isEmpty():
            continue
        ids = renumber_members(members).select(F.col("ord").cast("bigint").alias("new_id"), F.col("sl_id").alias("old_id"))
        path = pattern.replace("{groupname}", name)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        save(subset(t, ids), path)
        out.append(path)
    return out
