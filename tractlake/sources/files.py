"""Reading, writing and converting files of any supported format."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from tractlake.errors import ArgumentError, FormatError
from tractlake.model import Header, Tractogram
from tractlake.operators.cast import cast_positions
from tractlake.sources import datasource, nifti, parts, remote, tck, trx, vtk
from tractlake.sources.parsed import read_bytes

#: Streamlines whose point numbers are made into text at a time.
SIZES = 65_536
# Endings and what they mean; any folder is a container.
ENDINGS = {".trx": "trx", ".tck": "tck", ".tck.gz": "tck", ".trk": "trk", ".trk.gz": "trk", ".vtk": "vtk", ".tt.gz": "tt"}


@dataclass(frozen=True)
class Options:
    header: Header | None = None
    dtype: str = "float32"
    vtk_space: str = "ras"
    compress_groups: bool = False


def detect_format(path: str) -> str:
    if os.path.isdir(path):
        return "trx"
    for ending, kind in ENDINGS.items():
        if path.endswith(ending):
            return kind
    if path.endswith(".tt"):
        raise FormatError("TinyTrack files must be gzipped (.tt.gz)")
    raise FormatError(f"unknown format: {path}")


def load(spark: SparkSession, path: str, options: Options | None = None) -> Tractogram:
    """All of a file: attributes, groups, attributes of groups and header. A URI (hdfs://, s3a://, file://) goes through Spark's reader."""
    options = options or Options()
    if remote.is_remote(path):
        return remote.load(spark, path, detect_format(path), {"vtkspace": options.vtk_space}, options.header)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = detect_format(path)
    datasource.register(spark)
    read = lambda name: spark.read.format(kind).option("table", name).option("vtkSpace", options.vtk_space).load(path)
    if kind == "trx":
        c = trx.Container(path)
        dtype, header, dps, dpv = c.dtype, c.header, {n: a for n, (_, a) in c.dps.items()}, {n: a for n, (_, a) in c.dpv.items()}
    else:
        lines = datasource.describe(kind, path)
        dtype, header, dps, dpv = "float32", lines.header, lines.dps_arrays, lines.dpv_arrays
        if kind in ("tck", "vtk") and options.header is not None:
            header = options.header
    return Tractogram.of(read("streamlines"), header, dtype, dps, dpv, read("groups"), read("group_names"), read("dpg"))


def read_tractogram(spark: SparkSession, path: str, options: Options | None = None) -> Tractogram:
    """The neutral form: single precision, groups and their attributes, but none of streamlines or vertices."""
    t = load(spark, path, options)
    if detect_format(path) == "trk" and (t.dps or t.dpv):
        raise FormatError("TRK file has scalars or properties; convert it to keep them")
    return t.neutral()


def reference_header(path: str) -> Header:
    """Affine and dimensions of a container or a NIfTI image."""
    if path.endswith((".nii", ".nii.gz")):
        return nifti.parse(read_bytes(path))
    if os.path.isdir(path) or path.endswith(".trx"):
        header = trx.Container(path).header
        return Header(header.affine, header.dimensions)
    raise ArgumentError(f"no reference: {path}")


def _write_tck(t: Tractogram, path: str) -> None:
    zipped = path.endswith(".gz")

    def encode(batch) -> parts.Encoded:
        flat, sizes = trx.flat_points(batch.column("points"))
        return {"lines": tck.encoded(flat.astype(np.float32), sizes, zipped)}, {"n": batch.num_rows}

    with parts.folder_of(t.spark, path) as folder:
        found = parts.write(t.streamlines.select("sl_id", "points"), "sl_id", folder, encode)
        tck.write_encoded(path, parts.total(found, "n"), parts.blocks(found, "lines"))


def _write_vtk(t: Tractogram, path: str) -> None:
    """Points as text by tasks; then, as it is known how many stand before a part, the lines of their numbers."""

    def encode(batch) -> parts.Encoded:
        flat, sizes = trx.flat_points(batch.column("points"))
        return {"points": vtk.points_text(flat.astype(np.float32)), "sizes": sizes.astype("<u4").tobytes()}, {"n": batch.num_rows, "v": len(flat)}

    def number(given):
        own, at = given
        for _, source, _ in [x for x in own if x[0] == "sizes"]:
            with open(source, "rb") as f, open(f"{source}.lines", "wb") as out:
                while block := f.read(4 * SIZES):
                    sizes = np.frombuffer(block, "<u4")
                    out.write(vtk.lines_text(sizes, at))
                    at += int(sizes.sum())
            return [["lines", f"{source}.lines", os.path.getsize(f"{source}.lines")]]
        return []

    with parts.folder_of(t.spark, path) as folder:
        found = parts.write(t.streamlines.select("sl_id", "points"), "sl_id", folder, encode)
        bases = np.cumsum([0, *(p.numbers.get("v", 0) for p in found)]).tolist()
        given = [(p.files, at) for p, at in zip(found, bases, strict=False)]
        told = t.spark.sparkContext.parallelize(given, len(given)).map(number).collect() if folder.shared and given else map(number, given)
        lines = [parts.checked(parts.Part(files, {})) for files in told]
        vtk.write_texts(path, parts.total(found, "n"), parts.total(found, "v"), parts.blocks(found, "points"), parts.blocks(lines, "lines"))


def write_tractogram(t: Tractogram, path: str, options: Options | None = None) -> None:
    """Write to the format that the path's ending names; a path without a known ending is a container's folder."""
    options = options or Options(dtype=t.dtype)
    kind = "trx" if not os.path.splitext(path)[1] or os.path.isdir(path) else detect_format(path)
    if kind == "trx":
        out = t if t.dtype == options.dtype else cast_positions(t, options.dtype)
        if options.header is not None:
            out = out.with_(header=Header(options.header.affine, options.header.dimensions, t.header.extra))
        trx.write(path, out, options.compress_groups)
    elif kind in ("tck", "vtk"):
        (_write_tck if kind == "tck" else _write_vtk)(t, path)
    else:
        raise FormatError(f"writing {kind} is not supported")


def convert(spark: SparkSession, source: str, target: str, options: Options | None = None) -> None:
    """From any format to one that can be written; containers get all that the source has."""
    t = load(spark, source, options)
    chosen = options or Options(dtype=t.dtype)
    if detect_format(source) == "trk":
        chosen = Options(None, chosen.dtype, chosen.vtk_space, chosen.compress_groups)
    write_tractogram(t, target, chosen)


def save_in_place(t: Tractogram, path: str) -> None:
    """Replace a container by a tractogram that may read from it, keeping its kind."""
    side = f"{path}.new" + (".trx" if os.path.isfile(path) else "")
    trx.write(side, t)
    if os.path.isdir(path):
        import shutil

        shutil.rmtree(path)
    os.replace(side, path)
