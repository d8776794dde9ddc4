"""Files in any store that Spark reads: their bytes come through Spark's own reader, and are parsed in tasks.

The driver learns header and attribute names from a job, and opens nothing. A file is at most what a binary column holds
(2 GB); larger containers belong on a mounted file system, where tasks map slices of them.
"""

from __future__ import annotations

import json
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tractlake.errors import FormatError
from tractlake.model import Array, Header, Tractogram
from tractlake.shipping import ship
from tractlake.sources import trx
from tractlake.sources.datasource import SMALL, parse_bytes, small_rows
from tractlake.sources.parsed import batches, maybe_gunzip, schema_of


def _container(data: bytes):
    """A container from an archive's bytes, in a file of the task's own that goes with it."""
    file = tempfile.NamedTemporaryFile(suffix=".trx")  # noqa: SIM115
    file.write(data)
    file.flush()
    out = trx.Container(file.name)
    out.file = file
    return out


def _described(kind: str, data: bytes, options: dict) -> dict:
    if kind == "trx":
        c = _container(data)
        dps, dpv, header, dtype = {n: a for n, (_, a) in c.dps.items()}, {n: a for n, (_, a) in c.dpv.items()}, c.header, c.dtype
    else:
        lines = parse_bytes(kind, maybe_gunzip(data), options)
        dps, dpv, header, dtype = lines.dps_arrays, lines.dpv_arrays, lines.header, "float32"
    plain = lambda arrays: {n: (a.dtype, a.ncols) for n, a in arrays.items()}
    return {"dtype": dtype, "affine": header.affine, "dimensions": header.dimensions, "extra": header.extra, "dps": plain(dps), "dpv": plain(dpv)}


def _rows(kind: str, data: bytes, options: dict):
    if kind == "trx":
        c = _container(data)
        arrays = [{n: a for n, (_, a) in of.items()} for of in (c.dps, c.dpv)]
        values = [{n: c.array(e, a) for n, (e, a) in of.items()} for of in (c.dps, c.dpv)]
        yield from batches(0, c.positions(), c.offsets(), c.dtype, *values, *arrays)
        return
    lines = parse_bytes(kind, maybe_gunzip(data), options)
    yield from batches(0, lines.positions, lines.offsets, "float32", lines.dps, lines.dpv, lines.dps_arrays, lines.dpv_arrays)


def load(spark: SparkSession, path: str, kind: str, options: dict, header: Header | None = None) -> Tractogram:
    """All of one file by its URI. Label files beside TinyTrack files are not read."""
    ship(spark)
    content = spark.read.format("binaryFile").load(path).select("content")

    def each(f, schema: str) -> DataFrame:
        def run(arrived):
            for batch in arrived:
                for value in batch.column(0):
                    yield from f(value.as_py())

        return content.mapInArrow(run, schema)

    def meta(data):
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(_described(kind, data, options))])], ["meta"])

    found = [json.loads(r[0]) for r in each(meta, "meta string").take(2)]
    if len(found) != 1:
        raise FormatError(f"{path} is {'more than one file' if found else 'no file'}")
    m = found[0]
    dps, dpv = ({n: Array(*a) for n, a in m[k].items()} for k in ("dps", "dpv"))

    def small(name: str) -> DataFrame:
        schema = to_arrow_schema(spark.createDataFrame([], SMALL[name]).schema)

        def rows(data):
            if kind == "trx":
                c = _container(data)
                out = list(small_rows(kind, c.path, name, options))
            else:
                out = list(small_rows(kind, "", name, options, parse_bytes(kind, maybe_gunzip(data), options)))
            for lo in range(0, len(out), 10_000):
                part = out[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(schema.types)], schema.names)

        return each(rows, SMALL[name])

    own = header if header is not None and kind in ("tck", "vtk") else Header(m["affine"], m["dimensions"], m["extra"])
    lines = each(lambda data: _rows(kind, data, options), schema_of(m["dtype"], dps, dpv))
    return Tractogram.of(lines, own, m["dtype"], dps, dpv, small("groups"), small("group_names"), small("dpg"))


def is_remote(path: str) -> bool:
    """Whether a path names a store rather than a place in mounted file systems."""
    scheme, sep, _ = path.partition("://")
    return bool(sep) and scheme.isalnum() and not os.path.exists(path)

