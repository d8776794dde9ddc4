"""Spark data sources: format("trx"), "tck", "trk", "vtk" and "tt".

Option ``table``: streamlines (default), groups, group_names, dpg, header. A container is read by ranges of streamlines,
each task mapping its slices of the arrays; the other formats can't be split, so their files are one task each. TCK and
VTK files are read piece by piece.
"""

from __future__ import annotations

import bisect
import json

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tractlake.model import DPG, GROUP_NAMES, GROUPS, Header
from tractlake.sources import tck, trk, trx, tt, vtk
from tractlake.sources.parsed import Lines, batches, opened, read_bytes, read_head, schema_of

HEADER = "voxel_to_rasmm array<array<double>>, dimensions array<bigint>, nb_streamlines bigint, nb_vertices bigint, extra string"
SMALL = {"groups": GROUPS, "group_names": GROUP_NAMES, "dpg": DPG, "header": HEADER}
#: Vertices that a task reads of a container, about.
SPLIT = 4_000_000
#: Members of an Arrow batch.
MEMBERS = 65_536


class Range(InputPartition):
    """Streamlines of a container, or of one of its groups."""

    def __init__(self, lo: int, hi: int, group: str | None = None):
        super().__init__((lo, hi, group))
        self.lo, self.hi, self.group = lo, hi, group


def labels_of(path: str) -> list[str]:
    try:
        with open(f"{path}.txt", encoding="utf-8") as f:
            return [line.strip() for line in f.read().splitlines()]
    except FileNotFoundError:
        return []


def _space(options: dict | None) -> str:
    return (options or {}).get("vtkspace", (options or {}).get("vtkSpace", "ras")).lower()


#: Formats that are read piece by piece, each with its positions and offsets.
STREAMED = {"tck": lambda f, options: tck.pieces(f), "vtk": lambda f, options: vtk.pieces(f, _space(options))}


def parse_bytes(kind: str, data: bytes, options: dict | None = None, labels: list[str] | None = None) -> Lines:
    """The content of a file that is not a container, whole."""
    if kind == "tt":
        return tt.parse(data, labels=labels)
    if kind == "vtk":
        return vtk.parse(data, mode=_space(options))
    return {"tck": tck, "trk": trk}[kind].parse(data)


def parse(kind: str, path: str, options: dict | None = None) -> Lines:
    """A file that is not a container, whole."""
    return parse_bytes(kind, read_bytes(path), options, labels_of(path) if kind == "tt" else None)


def describe(kind: str, path: str) -> Lines:
    """Header and attributes of a file that is not a container, without its streamlines: what the driver needs to know."""
    if kind == "trk":
        return trk.parse(read_head(path, trk.SIZE), streamlines=False)
    if kind == "tt":
        return tt.parse(read_bytes(path), streamlines=False)
    read_head(path, 1)  # neither of the others says anything of its own
    return Lines.of(Header(), [])


def small_rows(kind: str, path: str, name: str, options: dict, lines: Lines | None = None):
    """Rows of groups, group_names, dpg or header, of a file or of what was parsed of one."""
    if kind == "trx":
        c = trx.Container(path)
        groups = {g: (a, c.array(e, a) if name == "groups" else None) for g, (e, a) in c.groups.items()}
        dpg = [(g, f, a, c.array(e, a).reshape(-1, a.ncols)) for g, fields in c.dpg.items() for f, (e, a) in fields.items()] if name == "dpg" else []
        header = c.header
        n, v = (c.n_streamlines(), c.n_vertices()) if name == "header" else (0, 0)
    elif kind != "tt" and name != "header":
        return  # the others have no groups, and are not parsed for that
    elif kind in STREAMED and lines is None:
        n = v = 0
        with opened(path) as f:
            for positions, offsets in STREAMED[kind](f, options):
                n, v = n + len(offsets) - 1, v + len(positions)
        header = Header()
    else:
        lines = lines or parse(kind, path, options)
        from tractlake.model import Array

        groups = {g: (Array("uint32"), np.array(m)) for g, m in lines.groups.items()}
        dpg = [(g, f, Array(t, len(rows[0])), np.array(rows)) for g, fields in lines.dpg.items() for f, (t, rows) in fields.items()]
        header, n, v = lines.header, len(lines.offsets) - 1, len(lines.positions)
    if name == "groups":
        yield from ((g, i, int(m)) for g, (_, members) in groups.items() for i, m in enumerate(members))
    elif name == "group_names":
        yield from ((g, a.dtype) for g, (a, _) in groups.items())
    elif name == "dpg":
        yield from ((g, f, a.dtype, a.ncols, i, [float(x) for x in row]) for g, f, a, rows in dpg for i, row in enumerate(rows))
    else:
        yield (header.affine, header.dimensions, n, v, json.dumps(header.extra))


class TractSource(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        table = self.options.get("table", "streamlines")
        if table in SMALL:
            return SMALL[table]
        if table != "streamlines":
            raise ValueError(f"unknown table '{table}'")
        if self.kind == "trx":
            c = trx.Container(self.options["path"])
            return schema_of(c.dtype, {n: a for n, (_, a) in c.dps.items()}, {n: a for n, (_, a) in c.dpv.items()})
        if self.kind == "trk":
            lines = describe(self.kind, self.options["path"])
            return schema_of("float32", lines.dps_arrays, lines.dpv_arrays)
        return schema_of("float32", {}, {})

    def reader(self, schema) -> DataSourceReader:
        return TractReader(self.kind, dict(self.options))


class TractReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options, self.path = kind, options, options["path"]
        self.table = options.get("table", "streamlines")

    def partitions(self):
        if self.kind != "trx" or self.table not in ("streamlines", "groups"):
            return [Range(0, 0)]
        c = trx.Container(self.path)
        if self.table == "groups":
            sizes = {g: c.rows(e, a) for g, (e, a) in c.groups.items()}
            return [Range(lo, min(n, lo + SPLIT), g) for g, n in sizes.items() for lo in range(0, n, SPLIT)] or [Range(0, 0)]
        n, found = c.n_streamlines(), c.raw_offsets()
        last = c.n_vertices() if n else 0
        # by vertices, and by streamlines, of which many may be empty
        edges = sorted({0, n, *(min(n, bisect.bisect_left(found, at)) for at in range(0, last + SPLIT, SPLIT)), *range(0, n, SPLIT)})
        return [Range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)] or [Range(0, 0)]

    def read(self, partition):
        if self.kind == "trx" and self.table == "groups":
            yield from self.members(partition)
            return
        if self.table != "streamlines":
            yield from small_rows(self.kind, self.path, self.table, self.options)
            return
        if self.kind == "trx":
            if partition.lo == partition.hi:
                return
            c = trx.Container(self.path)
            offsets = c.offsets(partition.lo, partition.hi)
            a, b = int(offsets[0]), int(offsets[-1])
            dps = {n: c.array(e, x)[partition.lo : partition.hi] for n, (e, x) in c.dps.items()}
            dpv = {n: c.array(e, x)[a:b] for n, (e, x) in c.dpv.items()}
            yield from batches(partition.lo, c.positions()[a:b], offsets - a, c.dtype, dps, dpv, {n: x for n, (_, x) in c.dps.items()}, {n: x for n, (_, x) in c.dpv.items()})
            return
        if self.kind in STREAMED:
            yield from self.streamed()
            return
        lines = parse(self.kind, self.path, self.options)
        yield from batches(0, lines.positions, lines.offsets, "float32", lines.dps, lines.dpv, lines.dps_arrays, lines.dpv_arrays)

    def members(self, partition):
        if partition.group is None:
            return
        c = trx.Container(self.path)
        ids = c.array(*c.groups[partition.group])
        for lo in range(partition.lo, partition.hi, MEMBERS):
            hi = min(partition.hi, lo + MEMBERS)
            columns = [pa.repeat(partition.group, hi - lo), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(np.asarray(ids[lo:hi]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "ord", "sl_id"])

    def streamed(self):
        first = 0
        with opened(self.path) as f:
            for positions, offsets in STREAMED[self.kind](f, self.options):
                yield from batches(first, positions, offsets, "float32", {}, {}, {}, {})
                first += len(offsets) - 1


class TrxSource(TractSource):
    kind = "trx"


class TckSource(TractSource):
    kind = "tck"


class TrkSource(TractSource):
    kind = "trk"


class VtkSource(TractSource):
    kind = "vtk"


class TtSource(TractSource):
    kind = "tt"


def register(spark) -> None:
    """Make the formats known to a session."""
    from tractlake.shipping import ship

    ship(spark)
    for source in (TrxSource, TckSource, TrkSource, VtkSource, TtSource):
        spark.dataSource.register(source)


