"""The data model: a tractogram is a handful of DataFrames, a header, and what types its arrays have."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError, DTypeError, MissingName
from tractlake.shipping import ship

# On-disk types, and the Spark types that hold them.
DTYPES = {
    "float16": "float", "float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int",
    "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
}
SHORT = {"f16": "float16", "f32": "float32", "f64": "float64"}
FLOATS = ("float16", "float32", "float64")
IDENTITY = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
GROUPS = "grp string, ord int, sl_id bigint"
GROUP_NAMES = "grp string, dtype string"
DPG = "grp string, field string, dtype string, ncols int, row_idx int, value array<double>"
ARRAYS = "kind string, grp string, name string, ncols int, nrows bigint, dtype string"


def dtype_of(name: str) -> str:
    """A dtype by its name or short name."""
    found = SHORT.get(name, name)
    if found not in DTYPES:
        raise DTypeError(f"unknown dtype '{name}'")
    return found


def points_type(dtype: str) -> str:
    kind = "double" if dtype == "float64" else "float"
    return f"array<struct<x:{kind},y:{kind},z:{kind}>>"


def column_type(dtype: str, ncols: int, per_vertex: bool = False) -> str:
    kind = DTYPES[dtype]
    kind = kind if ncols == 1 else f"array<{kind}>"
    return f"array<{kind}>" if per_vertex else kind


@dataclass(frozen=True)
class Array:
    """Type and width of a named array."""

    dtype: str
    ncols: int = 1


@dataclass(frozen=True)
class Header:
    affine: list = field(default_factory=lambda: [list(r) for r in IDENTITY])
    dimensions: list = field(default_factory=lambda: [1, 1, 1])
    extra: dict = field(default_factory=dict)

    @staticmethod
    def parse(text: str | bytes) -> Header:
        raw = json.loads(text)
        known = {"VOXEL_TO_RASMM", "DIMENSIONS", "NB_STREAMLINES", "NB_VERTICES"}
        try:
            affine = [[float(x) for x in row] for row in raw["VOXEL_TO_RASMM"]]
            return Header(affine, [int(x) for x in raw["DIMENSIONS"]], {k: v for k, v in raw.items() if k not in known})
        except (KeyError, TypeError) as e:
            raise ArgumentError(f"header lacks {e}") from e

    def dump(self, n_streamlines: int, n_vertices: int) -> str:
        fixed = {"VOXEL_TO_RASMM": self.affine, "DIMENSIONS": self.dimensions, "NB_STREAMLINES": n_streamlines, "NB_VERTICES": n_vertices}
        return json.dumps(fixed | self.extra, indent=2)


@dataclass(frozen=True)
class Tractogram:
    """Streamlines with attributes, groups, and attributes of groups.

    streamlines: sl_id, points, a column dps_<name> for each attribute of streamlines, and a column dpv_<name> for each
    attribute of vertices (an array parallel to points, so that it moves with its row). sl_id runs from 0; rows have no
    order but by it. groups is an ordered list of members that may repeat; group_names also has the empty ones.
    """

    streamlines: DataFrame
    groups: DataFrame
    group_names: DataFrame
    dpg: DataFrame
    header: Header = field(default_factory=Header)
    dtype: str = "float32"
    dps: dict = field(default_factory=dict)
    dpv: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.streamlines.sparkSession

    def with_(self, **parts) -> Tractogram:
        return replace(self, **parts)

    @staticmethod
    def of(streamlines: DataFrame, header: Header | None = None, dtype: str = "float32", dps: dict | None = None, dpv: dict | None = None, groups: DataFrame | None = None, group_names: DataFrame | None = None, dpg: DataFrame | None = None) -> Tractogram:
        """A tractogram of what is given; the rest is empty."""
        spark = ship(streamlines.sparkSession)
        groups = groups if groups is not None else spark.createDataFrame([], GROUPS)
        group_names = group_names if group_names is not None else groups.select("grp").distinct().withColumn("dtype", F.lit("uint32"))
        return Tractogram(streamlines, groups, group_names, dpg if dpg is not None else spark.createDataFrame([], DPG), header or Header(), dtype, dps or {}, dpv or {})

    @staticmethod
    def empty(spark: SparkSession, header: Header | None = None, dtype: str = "float32") -> Tractogram:
        return Tractogram.of(spark.createDataFrame([], f"sl_id bigint, points {points_type(dtype)}"), header, dtype)

    @staticmethod
    def from_lists(spark: SparkSession, lines: list, header: Header | None = None, dtype: str = "float32", dps: dict | None = None, dpv: dict | None = None, groups: dict | None = None, dpg: dict | None = None) -> Tractogram:
        """A small tractogram. lines: lists of points; dps/dpv: name to (dtype, values); groups: name to members; dpg: group to field to (dtype, rows)."""
        dps, dpv, groups, dpg = dps or {}, dpv or {}, groups or {}, dpg or {}
        width = lambda v: len(v[0]) if len(v) and isinstance(v[0], (list, tuple)) else 1
        kinds = {k: Array(dtype_of(t), width(v)) for k, (t, v) in {**dps}.items()}
        vkinds = {k: Array(dtype_of(t), width(v)) for k, (t, v) in dpv.items()}
        rows, at = [], 0
        for i, line in enumerate(lines):
            points = [tuple(float(np.dtype(dtype).type(c)) for c in p) for p in line]
            rows.append((i, points, *(v[i] for _, v in dps.values()), *(list(v[at : at + len(line)]) for _, v in dpv.values())))
            at += len(line)
        schema = ", ".join([f"sl_id bigint, points {points_type(dtype)}", *(f"`dps_{k}` {column_type(a.dtype, a.ncols)}" for k, a in kinds.items()), *(f"`dpv_{k}` {column_type(a.dtype, a.ncols, True)}" for k, a in vkinds.items())])
        members = spark.createDataFrame([(g, i, int(m)) for g, v in groups.items() for i, m in enumerate(v)], GROUPS)
        names = spark.createDataFrame([(g, "uint32") for g in groups], GROUP_NAMES)
        cells = [(g, f, dtype_of(t), width(v), i, [float(x) for x in (r if isinstance(r, (list, tuple)) else [r])]) for g, fs in dpg.items() for f, (t, v) in fs.items() for i, r in enumerate(v)]
        return Tractogram.of(spark.createDataFrame(rows, schema), header, dtype, kinds, vkinds, members, names, spark.createDataFrame(cells, DPG))

    # accessors

    def counts(self) -> DataFrame:
        """One row: nb_streamlines, nb_vertices, from the data and not from a header."""
        return self.streamlines.agg(F.count(F.lit(1)).alias("nb_streamlines"), F.coalesce(F.sum(F.size("points")), F.lit(0)).cast("bigint").alias("nb_vertices"))

    @property
    def nb_streamlines(self) -> int:
        return self.counts().first()[0]

    @property
    def nb_vertices(self) -> int:
        return self.counts().first()[1]

    def vertices(self) -> DataFrame:
        """sl_id, v_idx, x, y, z and a column for each attribute of vertices; empty streamlines have no rows."""
        zipped = F.arrays_zip("points", *(F.col(f"`dpv_{k}`") for k in self.dpv)) if self.dpv else F.transform("points", lambda p: F.struct(p.alias("points")))
        out = self.streamlines.select("sl_id", F.posexplode(zipped).alias("v_idx", "v"))
        return out.select("sl_id", "v_idx", "v.points.x", "v.points.y", "v.points.z", *(F.col("v").getField(f"dpv_{k}").alias(k) for k in self.dpv))

    def offsets(self) -> DataFrame:
        """sl_id and the vertex at which it starts."""
        from tractlake.operators.numbering import running

        return running(self.streamlines.select("sl_id", F.size("points").cast("bigint").alias("n")), "sl_id", "n", "off")

    def streamline(self, i: int) -> DataFrame:
        return self.streamlines.where(F.col("sl_id") == i)

    def dps_column(self, name: str) -> DataFrame:
        return self.streamlines.select("sl_id", F.col(f"`dps_{self._has(self.dps, name)}`").alias("value"))

    def dpv_column(self, name: str) -> DataFrame:
        self._has(self.dpv, name)
        return self.vertices().select("sl_id", "v_idx", F.col(f"`{name}`").alias("value"))

    @staticmethod
    def _scalar(name: str, array: Array) -> None:
        if array.ncols != 1:
            raise DTypeError(f"'{name}' has {array.ncols} columns")
        if array.dtype in ("int64", "uint64"):
            raise DTypeError(f"'{name}' is {array.dtype}")

    def scalar_dps(self, name: str) -> DataFrame:
        """A one-column attribute as float; 64-bit integers are refused, as they would lose digits."""
        self._scalar(name, self.dps[self._has(self.dps, name)])
        return self.dps_column(name).withColumn("value", F.col("value").cast("float"))

    def scalar_dpv(self, name: str) -> DataFrame:
        """The same for an attribute of vertices: sl_id, v_idx, value."""
        self._scalar(name, self.dpv[self._has(self.dpv, name)])
        return self.dpv_column(name).withColumn("value", F.col("value").cast("float"))

    def max_group_index(self) -> DataFrame:
        """The largest member of each group; null where it is empty."""
        return self.group_names.select("grp").join(self.groups, "grp", "left").groupBy("grp").agg(F.max("sl_id").alias("max_index"))

    def neutral(self) -> Tractogram:
        """Single precision, groups and their attributes, without attributes of streamlines and vertices."""
        from tractlake.operators.cast import cast_positions

        return cast_positions(self.with_(streamlines=self.streamlines.select("sl_id", "points"), dps={}, dpv={}), "float32")

    def container(self, dtype: str = "float32") -> Tractogram:
        """The neutral form as a container's content: positions of a type, group members as unsigned 32-bit numbers."""
        from tractlake.operators.cast import cast_positions

        return cast_positions(self.with_(group_names=self.group_names.withColumn("dtype", F.lit("uint32"))), dtype)

    def group(self, name: str) -> DataFrame:
        if self.group_names.where(F.col("grp") == name).isEmpty():
            raise MissingName(name)
        return self.groups.where(F.col("grp") == name).select("ord", "sl_id")

    def group_lists(self) -> DataFrame:
        """Each group with its members in order."""
        lists = self.groups.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "sl_id"))).alias("m"))
        return self.group_names.join(lists, "grp", "left").select("grp", F.coalesce(F.col("m.sl_id"), F.array().cast("array<bigint>")).alias("members"))

    def dpg_field(self, group: str, name: str) -> DataFrame:
        out = self.dpg.where((F.col("grp") == group) & (F.col("field") == name))
        if out.isEmpty():
            raise MissingName(f"{group}/{name}")
        return out.select("row_idx", "value")

    def arrays(self) -> DataFrame:
        """What arrays there are, with type, width and rows; sorted by kind, group and name when collected so."""
        s, v = self.counts().first()
        rows = [("dps", None, k, a.ncols, s, a.dtype) for k, a in self.dps.items()] + [("dpv", None, k, a.ncols, v, a.dtype) for k, a in self.dpv.items()]
        out = self.spark.createDataFrame(rows, ARRAYS)
        sizes = self.groups.groupBy("grp").count()
        groups = self.group_names.join(sizes, "grp", "left").select(F.lit("group"), F.lit(None).cast("string"), "grp", F.lit(1), F.coalesce("count", F.lit(0)).cast("bigint"), "dtype")
        fields = self.dpg.groupBy("grp", "field", "dtype", "ncols").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dpg"), "grp", "field", "ncols", "n", "dtype")
        return out.union(groups).union(fields)

    def names(self, kind: str) -> list[str]:
        """Sorted names of dps, dpv, groups or dpg groups."""
        if kind in ("dps", "dpv"):
            return sorted(getattr(self, kind))
        table = self.group_names if kind == "groups" else self.dpg
        return sorted(r[0] for r in table.select("grp").distinct().collect())

    def to_numpy(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and offsets (with the last one) of a small tractogram."""
        rows = self.streamlines.select("sl_id", "points").orderBy("sl_id").collect()
        lines = [[tuple(p) for p in r[1]] for r in rows]
        flat = np.array([p for line in lines for p in line], dtype=np.dtype(self.dtype)).reshape(-1, 3)
        return flat, np.cumsum([0, *(len(x) for x in lines)]).astype(np.uint32)

    @staticmethod
    def _has(names: dict, name: str) -> str:
        if name not in names:
            raise MissingName(name)
        return name
