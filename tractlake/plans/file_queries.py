"""Queries through files of every format: written, read back, converted and edited."""

from __future__ import annotations

import gzip
import os
import shutil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake import cli
from tractlake.model import Array, Header, Tractogram
from tractlake.operators import subset
from tractlake.operators.numbering import renumbered
from tractlake.plans.catalog import _points, folder, from_zero, query, sums
from tractlake.plans.geometry_tables import EVENTS_SQL, events, orders, table
from tractlake.plans.samples import nifti_header, polylines, trk_file, tt_file, vtk_binary
from tractlake.sources import datasource, edit, files

#: Ids from zero, as files have them, in SQL on either of the geometry tables.
_Z = ", z AS (SELECT sl_id AS old, (row_number() OVER (ORDER BY sl_id) - 1)::BIGINT AS new FROM (SELECT DISTINCT sl_id FROM {t}))"
ZS, ZV = _Z.format(t="s"), _Z.format(t="v")
_SUM_FA = "round(coalesce((SELECT sum(fa::DOUBLE) FROM v WHERE v.sl_id = old), 0.0), 4) AS sum_fa"
_COUNTS = "SELECT count(*) AS nb_streamlines, sum(n)::BIGINT AS nb_vertices FROM s"


def written(spark, sf, name: str = "lines.trx", compress: bool = False) -> str:
    """The orders tractogram with its attributes and priority groups, as a file of a new folder."""
    t = from_zero(orders(spark, sf, "priority"))
    path = os.path.join(folder(spark), name)
    files.write_tractogram(t, path, files.Options(dtype=t.dtype, compress_groups=compress))
    return path


def put(spark, name: str, data: bytes) -> str:
    path = os.path.join(folder(spark), name)
    with open(path, "wb") as f:
        f.write(gzip.compress(data, 1) if name.endswith(".gz") else data)
    return path


@query("SELECT kind, name, ncols, nrows, dtype FROM (SELECT 'dps' AS kind, 'weight' AS name, 1 AS ncols, count(*) AS nrows, 'float32' AS dtype FROM s UNION ALL SELECT 'dpv', 'fa', 1, sum(n)::BIGINT, 'float32' FROM s UNION ALL SELECT 'group', pri, 1, count(*), 'uint32' FROM s GROUP BY pri UNION ALL SELECT 'dpg', 'size', 1, 1, 'float64' FROM (SELECT DISTINCT pri FROM s))")
def trx_arrays(spark, sf):
    return files.load(spark, written(spark, sf, compress=True)).arrays().select("kind", "name", "ncols", "nrows", "dtype")


def attributes(t: Tractogram) -> DataFrame:
    total = F.aggregate("dpv_fa", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return t.streamlines.select("sl_id", F.round(F.col("dps_weight").cast("double"), 2).alias("weight"), F.round(total, 4).alias("sum_fa"))


@query(ZS + " SELECT new AS sl_id, round(weight::DOUBLE, 2) AS weight, " + _SUM_FA + " FROM z JOIN s ON s.sl_id = old")
def trx_attributes(spark, sf):
    return attributes(files.load(spark, written(spark, sf, "lines")))


@query(ZS + " SELECT pri AS grp, (row_number() OVER (PARTITION BY pri ORDER BY new) - 1)::INT AS ord, new AS sl_id FROM z JOIN s ON s.sl_id = old")
def trx_members(spark, sf):
    return files.load(spark, written(spark, sf, compress=True)).groups


@query("SELECT pri AS grp, 'size' AS field, count(*)::DOUBLE AS value FROM s GROUP BY 1")
def trx_group_attributes(spark, sf):
    return files.load(spark, written(spark, sf, "lines")).dpg.select("grp", "field", F.get("value", F.lit(0)).alias("value"))


@query("SELECT count(*) AS nb_streamlines, sum(n)::BIGINT AS nb_vertices, '30,60,12' AS dimensions, 1.0::DOUBLE AS corner, 'orders' AS made_of FROM s")
def trx_header(spark, sf):
    path = written(spark, sf)
    t = files.load(spark, path)
    files.save_in_place(t.with_(header=Header(t.header.affine, t.header.dimensions, {"MADE_OF": {"table": "orders"}})), path)
    head = spark.read.format("trx").option("table", "header").load(path)
    made = F.get_json_object("extra", "$.MADE_OF.table").alias("made_of")
    return head.select("nb_streamlines", "nb_vertices", F.array_join(F.col("dimensions").cast("array<string>"), ",").alias("dimensions"), F.col("voxel_to_rasmm")[3][3].alias("corner"), made)


@query(ZS + " SELECT new AS sl_id, n::BIGINT AS n FROM z JOIN s ON s.sl_id = old")
def trx_offsets_without_last(spark, sf):
    """Offsets of 64 bits that lack the last one."""
    path = written(spark, sf, "lines")
    old = np.fromfile(f"{path}/offsets.uint32", "<u4")
    old[:-1].astype("<u8").tofile(f"{path}/offsets.uint64")
    os.remove(f"{path}/offsets.uint32")
    return files.load(spark, path).streamlines.select("sl_id", F.size("points").cast("bigint").alias("n"))


@query(_COUNTS.replace("sum(n)::BIGINT AS nb_vertices", "sum(n)::BIGINT AS nb_vertices, 0 AS n_dps, 0 AS n_dpv, count(DISTINCT pri)::INT AS n_groups"))
def neutral_form(spark, sf):
    t = files.read_tractogram(spark, written(spark, sf))
    back = t.container("float64")
    assert back.dtype == "float64" and "double" in back.streamlines.schema["points"].dataType.simpleString()
    return back.counts().select("*", F.lit(len(t.dps)).alias("n_dps"), F.lit(len(t.dpv)).alias("n_dpv"), F.lit(len(t.names("groups"))).alias("n_groups"))


# formats that are read


def events_lines(spark, sf) -> tuple[Tractogram, list[np.ndarray]]:
    t = from_zero(events(spark, sf))
    return t, polylines(t)


def _world(digits: int = 2, x: str = "x", y: str = "y", z: str = "z", more: str = "") -> str:
    cells = ", ".join(f"round(({e})::DOUBLE, {digits}) + 0.0 AS {a}" for a, e in zip("xyz", (x, y, z), strict=True))
    return f"{ZV} SELECT new AS sl_id, v_idx::INT AS v_idx, {cells}{more} FROM v JOIN z ON old = sl_id"


def _rounded(df: DataFrame, digits: int = 2, *more) -> DataFrame:
    return df.select("sl_id", "v_idx", *((F.round(F.col(a).cast("double"), digits) + 0.0).alias(a) for a in "xyz"), *more)


@query(_world(more=", round((x / 8 + v_idx::FLOAT)::DOUBLE, 2) AS fa"), EVENTS_SQL)
def trk_vertices(spark, sf):
    """TrackVis with a scalar, read as vertices."""
    _, lines = events_lines(spark, sf)
    scalars = [x[:, 0] / np.float32(8) + np.arange(len(x), dtype=np.float32) for x in lines]
    path = put(spark, "lines.trk", trk_file(lines, scalars))
    return _rounded(files.load(spark, path).vertices(), 2, F.round(F.col("fa").cast("double"), 2).alias("fa"))


@query(ZV + " SELECT new AS sl_id, round((new::FLOAT / 4)::DOUBLE, 2) AS curv FROM z", EVENTS_SQL)
def trk_properties(spark, sf):
    _, lines = events_lines(spark, sf)
    path = put(spark, "lines.trk.gz", trk_file(lines, properties=[i / 4 for i in range(len(lines))]))
    return files.load(spark, path).dps_column("curv").select("sl_id", F.round(F.col("value").cast("double"), 2).alias("curv"))


@query(_world(), EVENTS_SQL)
def trk_big_endian_lps(spark, sf):
    """Voxels of 2 mm, two axes flipped, bytes the other way round."""
    _, lines = events_lines(spark, sf)
    path = put(spark, "lines.trk.gz", trk_file(lines, order="LPS", end=">", dims=(100, 110, 120), voxel=(2.0, 2.0, 2.0)))
    return _rounded(files.load(spark, path).vertices())


@query("SELECT 'dpv' AS kind, 'fa' AS name, 1 AS ncols, count(*) AS nrows, 'float32' AS dtype FROM v UNION ALL SELECT 'dps', 'curv', 1, count(DISTINCT sl_id), 'float32' FROM v", EVENTS_SQL)
def trk_to_trx(spark, sf):
    """A conversion keeps scalars and properties; the neutral form refuses them."""
    _, lines = events_lines(spark, sf)
    path = put(spark, "lines.trk", trk_file(lines, [x[:, 0] for x in lines], [0.5] * len(lines)))
    target = path.replace(".trk", ".trx")
    files.convert(spark, path, target)
    try:
        files.read_tractogram(spark, path)
    except files.FormatError:
        return files.load(spark, target).arrays().select("kind", "name", "ncols", "nrows", "dtype")
    raise AssertionError("scalars were lost")


#: Voxel coordinates in steps that a TinyTrack file can hold.
_TT = ("v_idx::FLOAT", "y / 8", "z / 16")


def tiny(spark, sf) -> str:
    t = from_zero(events(spark, sf))
    points = F.transform("points", lambda p, i: F.struct(i.cast("float").alias("x"), (p["y"] / 8).cast("float").alias("y"), (p["z"] / 16).cast("float").alias("z")))
    lines = polylines(t.with_(streamlines=t.streamlines.withColumn("points", points)))
    path = put(spark, "lines.tt.gz", tt_file(lines, [i % 3 for i in range(len(lines))], [0x3CA0FF, 0x010203, 0xFFFFFF]))
    with open(f"{path}.txt", "w") as f:
        f.write("Left/Arc\n\nLeft:Arc\n")
    return path


@query(_world(4, f"78 - {_TT[0]}", f"76 - {_TT[1]}", f"{_TT[2]} - 50"), EVENTS_SQL)
def tt_vertices(spark, sf):
    return _rounded(files.load(spark, tiny(spark, sf)).vertices(), 4)


_CLUSTER = "CASE new % 3 WHEN 0 THEN 'Left_Arc' WHEN 1 THEN 'cluster_1' ELSE 'Left_Arc_1' END"


@query(ZV + f" SELECT {_CLUSTER} AS grp, (new // 3)::INT AS ord, new AS sl_id FROM z", EVENTS_SQL)
def tt_groups(spark, sf):
    """Clusters named by the file of labels beside it: made safe, blank ones numbered, taken ones counted."""
    return files.load(spark, tiny(spark, sf)).groups


@query(ZV + f" SELECT {_CLUSTER} AS grp, CASE new % 3 WHEN 0 THEN '60,160,255' WHEN 1 THEN '1,2,3' ELSE '255,255,255' END AS color, 'made of events' AS report FROM z GROUP BY ALL", EVENTS_SQL)
def tt_colors(spark, sf):
    t = files.load(spark, tiny(spark, sf))
    color = F.array_join(F.transform("value", lambda v: v.cast("int").cast("string")), ",")
    return t.dpg.select("grp", color.alias("color"), F.lit(t.header.extra["tt_report"]).alias("report"))


@query(_world(4), EVENTS_SQL)
def vtk_binary_double(spark, sf):
    _, lines = events_lines(spark, sf)
    return _rounded(files.load(spark, put(spark, "lines.vtk", vtk_binary(lines, "double"))).vertices(), 4)


@query(_world(4, "-x", "-y"), EVENTS_SQL)
def vtk_declared_lps(spark, sf):
    """A file that declares LPS, read as its header says."""
    _, lines = events_lines(spark, sf)
    path = put(spark, "lines.vtk", vtk_binary(lines, space="LPS"))
    return _rounded(files.load(spark, path, files.Options(vtk_space="header")).vertices(), 4)


_TURN = "SELECT r_regionkey::INT AS k, (10 + r_regionkey)::INT AS dim0, length(r_name)::INT AS dim1, "


@query(_TURN + "CASE r_regionkey % 3 WHEN 0 THEN 2.0 + r_regionkey WHEN 1 THEN -1.5 ELSE 1.5 + r_regionkey END AS a00, CASE r_regionkey % 3 WHEN 0 THEN -3.0 WHEN 1 THEN r_regionkey ELSE 0.0 END AS shift FROM region", None)
def nifti_references(spark, sf):
    """Affine from the sform, the qform (half a turn about z) or the voxel sizes; both byte orders."""
    rows = []
    for r in table(spark, sf, "region").collect():  # five rows
        k, dims = int(r["r_regionkey"]), [10 + int(r["r_regionkey"]), len(r["r_name"]), 7]
        if k % 3 == 0:
            raw = nifti_header(dims, sform=[[2 + k, 0, 0, -3], [0, 2, 0, 1], [0, 0, 2, 1]])
        elif k % 3 == 1:
            raw = nifti_header(dims, qform=[0, 0, 1, k, 2, 3], pixdim=(1.5, 1.5, 1.5), end=">")
        else:
            raw = nifti_header(dims, pixdim=(1.5 + k, 1, 1))
        h = files.reference_header(put(spark, "image.nii.gz" if k % 2 else "image.nii", raw))
        rows.append((k, h.dimensions[0], h.dimensions[1], round(h.affine[0][0], 6), round(h.affine[0][3], 6)))
    return spark.createDataFrame(rows, "k int, dim0 int, dim1 int, a00 double, shift double")


_ENDING = "['.trx', '.tck', '.tck.gz', '.trk', '.trk.gz', '.vtk', '.tt.gz']"


@query(f"SELECT n_name || {_ENDING}[n_nationkey % 7 + 1] AS path, ['trx', 'tck', 'tck', 'trk', 'trk', 'vtk', 'tt'][n_nationkey % 7 + 1] AS kind FROM nation", None)
def formats_detected(spark, sf):
    endings = list(files.ENDINGS)
    paths = [r["n_name"] + endings[r["n_nationkey"] % 7] for r in table(spark, sf, "nation").collect()]  # 25 rows
    return spark.createDataFrame([(p, files.detect_format(p)) for p in paths], "path string, kind string")


@query(_world(4), EVENTS_SQL)
def converted(spark, sf):
    """Single precision text, to a container in double precision, to compressed binary."""
    t, _ = events_lines(spark, sf)
    at = folder(spark)
    files.write_tractogram(t, f"{at}/a.vtk")
    files.convert(spark, f"{at}/a.vtk", f"{at}/b.trx", files.Options(dtype="float64"))
    files.convert(spark, f"{at}/b.trx", f"{at}/c.tck.gz")
    return _rounded(files.load(spark, f"{at}/c.tck.gz").vertices(), 4)


# editing


@query(ZS + " SELECT new AS sl_id, (3 * new)::BIGINT AS value, round(2 * weight::DOUBLE, 1) AS weight FROM z JOIN s ON s.sl_id = old")
def archive_append(spark, sf):
    """One attribute appended to an archive, another replaced by one of a wider type."""
    path = written(spark, sf)
    old = files.load(spark, path).streamlines
    # kept apart, as the archive changes under a frame that reads it
    double = spark.read.parquet(_kept(spark, old.select("sl_id", (F.col("dps_weight").cast("double") * 2).alias("value"))))
    edit.append_dps(path, {"thrice": ("int64", old.select("sl_id", (F.col("sl_id") * 3).alias("value"))), "weight": ("float32", np.zeros(3))}, overwrite=False)
    edit.append_dps(path, {"weight": ("float64", double)}, overwrite=True)
    t = files.load(spark, path)
    assert t.dps == {"thrice": Array("int64"), "weight": Array("float64")}
    return t.streamlines.select("sl_id", F.col("dps_thrice").alias("value"), F.round("dps_weight", 1).alias("weight"))


def _kept(spark, df: DataFrame) -> str:
    path = os.path.join(folder(spark), "kept")
    df.write.parquet(f"file://{path}")
    return f"file://{path}"


@query(ZS + " SELECT new AS sl_id, v_idx::INT AS v_idx, round(x::DOUBLE, 4) AS value FROM v JOIN z ON old = sl_id")
def folder_append_vertices(spark, sf):
    path = written(spark, sf, "lines")
    values = files.load(spark, path).vertices().select("sl_id", "v_idx", F.col("x").alias("value"))
    edit.append_dpv(path, {"copy": ("float32", values)})
    return files.load(spark, path).scalar_dpv("copy").select("sl_id", "v_idx", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("SELECT kind, name FROM (SELECT 'group' AS kind, pri AS name FROM s UNION SELECT 'dpg', pri FROM s) WHERE name NOT IN ('1-URGENT') AND NOT (kind = 'dpg' AND name = '2-HIGH') UNION ALL SELECT 'group', 'evens' UNION ALL SELECT 'dpg', 'evens' UNION ALL SELECT 'dps', 'weight'")
def archive_groups(spark, sf):
    """Groups added and deleted in an archive with what belongs to them; an attribute of vertices deleted."""
    path = written(spark, sf, compress=True)
    n = files.load(spark, path).nb_streamlines
    edit.append_groups(path, {"evens": np.arange(0, n, 2)}, deflate=True)
    edit.append_dpg(path, "evens", {"step": ("uint8", [2])})
    edit.delete_groups(path, ["1-URGENT", "unknown"])
    edit.delete_dpg(path, "2-HIGH")
    edit.delete_dpv(path, ["fa", "unknown"])
    found = files.load(spark, path).arrays()
    return found.select("kind", F.when(F.col("kind") == "dpg", F.col("grp")).otherwise(F.col("name")).alias("name"))


@query("SELECT 'group' AS kind, pri AS name FROM s GROUP BY 2 UNION ALL SELECT 'dpv', 'fa' UNION ALL SELECT 'dps', 'n'")
def folder_delete(spark, sf):
    path = written(spark, sf, "lines")
    edit.append_dps(path, {"n": ("uint16", files.load(spark, path).streamlines.select("sl_id", F.size("points").alias("value")))})
    edit.delete_dps(path, ["weight"])
    for g in files.load(spark, path).names("groups"):
        edit.delete_dpg(path, g)
    return files.load(spark, path).arrays().select("kind", "name")


@query(ZS + " SELECT new AS sl_id, n::BIGINT AS n FROM z JOIN s ON s.sl_id = old WHERE new % 3 <> 0")
def saved_in_place(spark, sf):
    """A container replaced by a part of itself; ids of what is left are given anew."""
    path = written(spark, sf)
    t = files.load(spark, path)
    keep = renumbered(t.streamlines.where("sl_id % 3 <> 0").select("sl_id"), "sl_id", "new_id").select("new_id", F.col("sl_id").alias("old_id"))
    files.save_in_place(subset.subset(t, keep, check=False), path)
    back = F.floor(F.col("sl_id") / 2) * 3 + F.col("sl_id") % 2 + 1  # the id it had
    return files.load(spark, path).streamlines.select(back.cast("bigint").alias("sl_id"), F.size("points").cast("bigint").alias("n"))


@query("SELECT pri AS grp, count(*) AS nb_streamlines, sum(n)::BIGINT AS nb_vertices FROM s WHERE pri <> '5-LOW' GROUP BY 1")
def exported_groups(spark, sf):
    """A file for each of some groups; names that are unknown give none."""
    t, at = orders(spark, sf, "priority"), folder(spark)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "unknown"]
    paths = subset.export_groups(t, f"{at}/of_{{groupname}}.trx", names, files.write_tractogram)
    parts = [files.load(spark, p).counts().select(F.lit(os.path.basename(p)[3:-4]).alias("grp"), "*") for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# commands


@query(ZS + " SELECT (new + k * (SELECT count(*) FROM s))::BIGINT AS sl_id, n::BIGINT AS n FROM z JOIN s ON s.sl_id = old, range(2) t(k)")
def command_concatenate(spark, sf):
    path = written(spark, sf)
    out = path.replace(".trx", "2.trx")
    assert cli.run(spark, ["concatenate", path, path, "--output", out]) == 0
    return files.load(spark, out).streamlines.select("sl_id", F.size("points").cast("bigint").alias("n"))


@query("SELECT count(*) AS nb_streamlines, sum(n)::BIGINT AS nb_vertices, 'float16' AS dtype FROM s WHERE pri IN ('1-URGENT', '5-LOW')")
def command_subset_and_dtype(spark, sf):
    path = written(spark, sf)
    out, half = path.replace(".trx", "s.trx"), path.replace(".trx", "h.trx")
    assert cli.run(spark, ["subset", path, out, "--group", "1-URGENT", "5-LOW"]) == 0
    assert cli.run(spark, ["manipulate-dtype", out, half, "--positions-dtype", "float16"]) == 0
    t = files.load(spark, half)
    return t.counts().withColumn("dtype", F.lit(t.dtype))


@query("SELECT (SELECT count(*) FROM nation)::BIGINT AS dim0, (SELECT count(*) FROM region)::BIGINT AS dim1, (SELECT count(*) FROM region) / 2.0 AS a00, (SELECT count(*) FROM orders) AS nb_streamlines", None)
def command_update_affine(spark, sf):
    """Affine and dimensions from an image made of table sizes; counts stay."""
    path = written(spark, sf)
    n, r = table(spark, sf, "nation").count(), table(spark, sf, "region").count()
    image = put(spark, "image.nii", nifti_header([n, r, 9], sform=[[r / 2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]))
    assert cli.run(spark, ["update-affine", path, image, path.replace(".trx", "u.trx")]) == 0
    datasource.register(spark)
    head = spark.read.format("trx").option("table", "header").load(path.replace(".trx", "u.trx"))
    return head.select(F.col("dimensions")[0].alias("dim0"), F.col("dimensions")[1].alias("dim1"), F.col("voxel_to_rasmm")[0][0].alias("a00"), "nb_streamlines")


@query("SELECT count(*) AS nb_streamlines, 1 AS conflict, 0 AS copied FROM s")
def command_copy_metadata(spark, sf):
    """Names that are there stop the command, unless they are overwritten."""
    path = written(spark, sf)
    other = path.replace(".trx", "o.trx")
    shutil.copyfile(path, other)
    conflict = cli.run(spark, ["copy-metadata", path, other])
    copied = cli.run(spark, ["copy-metadata", path, other, "--overwrite", "--dps", "weight"])
    return files.load(spark, path).counts().select("nb_streamlines", F.lit(conflict).alias("conflict"), F.lit(copied).alias("copied"))


@query(ZS + " SELECT new AS sl_id, n, round(coalesce((SELECT sum(x::DOUBLE) FROM v WHERE v.sl_id = old), 0.0), 4) AS sum_x FROM z JOIN s ON s.sl_id = old")
def command_convert(spark, sf):
    path = written(spark, sf)
    out = path.replace(".trx", ".tck")
    assert cli.run(spark, ["convert", path, out]) == 0
    assert cli.run(spark, ["convert", out, f"{out}.trx", "--reference", path]) == 0
    return sums(files.load(spark, f"{out}.trx"))
