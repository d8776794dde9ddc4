"""Copying attributes and groups between tractograms of the same streamlines, and editing them in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError, MissingName
from tractlake.model import Array, Tractogram


@dataclass(frozen=True)
class Selection:
    """What to copy: without any list, everything; with some, only the kinds that have a list (empty: all of the kind)."""

    dps: list | None = None
    dpv: list | None = None
    groups: list | None = None

    def of(self, kind: str, names: list[str]) -> list[str]:
        if self.dps is None and self.dpv is None and self.groups is None:
            return names
        wanted = getattr(self, kind)
        if wanted is None:
            return []
        for n in wanted:
            if n not in names:
                raise MissingName(f"{kind} '{n}'")
        return list(wanted) or names


_CALLED = {"dps": "DPS", "dpv": "DPV", "groups": "group"}


def _there(target: Tractogram, wanted: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Of the wanted names by kind, those that the target has: (kind, name)."""
    have = {kind: set(target.names(kind)) if names else set() for kind, names in wanted.items()}
    return [(kind, n) for kind, names in wanted.items() for n in names if n in have[kind]]


def conflicts(target: Tractogram, donor: Tractogram, select: Selection | None = None) -> list[tuple[str, str]]:
    """What ``copy_metadata`` would not copy unless it overwrites: (kind, name) of dps, dpv and groups on both sides."""
    select = select or Selection()
    return _there(target, {k: select.of(k, donor.names(k)) for k in _CALLED})


def copy_metadata(target: Tractogram, donor: Tractogram, select: Selection | None = None, dpg: bool = False, overwrite: bool = False) -> Tractogram:
    """The target with the donor's attributes and groups. Counts must agree; a name that is there is an error unless overwritten."""
    select = select or Selection()
    dps, dpv, groups = (select.of(k, donor.names(k)) for k in ("dps", "dpv", "groups"))
    (s, v), (ds, dv) = target.counts().first(), donor.counts().first()
    if (dps or groups) and s != ds:
        raise ArgumentError(f"streamline counts differ: {s} and {ds}")
    if dpv and v != dv:
        raise ArgumentError(f"vertex counts differ: {v} and {dv}")
    if groups:
        high = donor.groups.where(F.col("grp").isin(groups)).agg(F.max("sl_id")).first()[0]
        if high is not None and high >= s:
            raise ArgumentError(f"group member {high} is out of range")
    if not overwrite:
        for kind, n in _there(target, {"dps": dps, "dpv": dpv, "groups": groups}):
            raise ArgumentError(f"{_CALLED[kind]} '{n}' exists")
    out = target
    if dps or dpv:
        columns = [f"dps_{n}" for n in dps] + [f"dpv_{n}" for n in dpv]
        given = donor.streamlines.select("sl_id", *(F.col(f"`{c}`") for c in columns))
        rows = target.streamlines.drop(*columns).join(given, "sl_id", "left")
        out = out.with_(streamlines=rows, dps=target.dps | {n: donor.dps[n] for n in dps}, dpv=target.dpv | {n: donor.dpv[n] for n in dpv})
    if groups:
        out = add_groups(out, donor.groups.where(F.col("grp").isin(groups)), donor.group_names.where(F.col("grp").isin(groups)))
        if dpg:
            fields = donor.dpg.where(F.col("grp").isin(groups))
            old = out.dpg.join(fields.select("grp", "field").distinct(), ["grp", "field"], "left_anti")
            out = out.with_(dpg=old.select(*fields.columns).unionByName(fields))
    return out


def add_groups(t: Tractogram, members: DataFrame, names: DataFrame) -> Tractogram:
    fresh = names.select("grp").distinct()
    groups = t.groups.join(fresh, "grp", "left_anti").unionByName(members.select("grp", "ord", "sl_id"))
    return t.with_(groups=groups, group_names=t.group_names.join(fresh, "grp", "left_anti").unionByName(names.select("grp", "dtype")))


def append_dps(t: Tractogram, name: str, values: DataFrame, array: Array, overwrite: bool = False) -> Tractogram:
    """Add an attribute (sl_id, value). A name that is there keeps its old array unless overwritten; the row count must fit."""
    if name in t.dps and not overwrite:
        return t
    n, want = values.count(), t.streamlines.count()
    if n != want:
        raise ArgumentError(f"DPS '{name}' has {n} rows, expected {want}")
    rows = t.streamlines.drop(f"dps_{name}").join(values.select("sl_id", F.col("value").alias(f"dps_{name}")), "sl_id", "left")
    return t.with_(streamlines=rows, dps=t.dps | {name: array})


def append_dpv(t: Tractogram, name: str, values: DataFrame, array: Array, overwrite: bool = False) -> Tractogram:
    """Add an attribute of vertices (sl_id, v_idx, value)."""
    if name in t.dpv and not overwrite:
        return t
    n, want = values.count(), t.counts().first()[1]
    if n != want:
        raise ArgumentError(f"DPV '{name}' has {n} rows, expected {want}")
    lists = values.groupBy("sl_id").agg(F.array_sort(F.collect_list(F.struct("v_idx", "value"))).alias("v")).select("sl_id", F.col("v.value").alias(f"dpv_{name}"))
    rows = t.streamlines.drop(f"dpv_{name}").join(lists, "sl_id", "left")
    rows = rows.withColumn(f"dpv_{name}", F.coalesce(f"dpv_{name}", F.array().cast(rows.schema[f"dpv_{name}"].dataType)))
    return t.with_(streamlines=rows, dpv=t.dpv | {name: array})


def append_groups(t: Tractogram, members: DataFrame, names: DataFrame, overwrite: bool = False) -> Tractogram:
    """Add groups (grp, ord, sl_id); members must exist. Names that are there keep their members unless overwritten."""
    if not overwrite:
        names = names.join(t.group_names.select("grp"), "grp", "left_anti")
        members = members.join(names.select("grp"), "grp", "left_semi")
    odd = members.join(t.streamlines.select("sl_id"), "sl_id", "left_anti").head(1)
    if odd:
        raise ArgumentError(f"group member {odd[0]['sl_id']} is out of range")
    return add_groups(t, members, names)


def append_dpg(t: Tractogram, fields: DataFrame, overwrite: bool = False) -> Tractogram:
    """Add attributes of groups; the groups must exist."""
    odd = fields.join(t.group_names, "grp", "left_anti").head(1)
    if odd:
        raise ArgumentError(f"group '{odd[0]['grp']}' does not exist")
    keys = ["grp", "field"]
    if overwrite:
        return t.with_(dpg=t.dpg.join(fields.select(*keys).distinct(), keys, "left_anti").unionByName(fields))
    return t.with_(dpg=t.dpg.unionByName(fields.join(t.dpg.select(*keys).distinct(), keys, "left_anti")))


def delete(t: Tractogram, dps: list[str] = (), dpv: list[str] = (), groups: list[str] = (), dpg: dict[str, list[str] | None] | None = None) -> Tractogram:
    """Without these; unknown names are passed over. A group takes its attributes along; dpg: group to fields (none: all)."""
    out = t.with_(streamlines=t.streamlines.drop(*(f"dps_{n}" for n in dps if n in t.dps), *(f"dpv_{n}" for n in dpv if n in t.dpv)), dps={k: a for k, a in t.dps.items() if k not in dps}, dpv={k: a for k, a in t.dpv.items() if k not in dpv})
    if groups:
        stays = ~F.col("grp").isin(list(groups))
        out = out.with_(groups=out.groups.where(stays), group_names=out.group_names.where(stays), dpg=out.dpg.where(stays))
    for group, fields in (dpg or {}).items():
        gone = F.col("grp") == group
        out = out.with_(dpg=out.dpg.where(~(gone & F.col("field").isin(list(fields)) if fields else gone)))
    return out
