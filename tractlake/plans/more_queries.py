"""Queries on operators that need no file: metadata, near duplicates, streams, SQL functions, accessors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.functions import geometry as G
from tractlake.model import Array, Header, Tractogram
from tractlake.operators import boxes, checks, concat, metadata, near, subset
from tractlake.plans import catalog
from tractlake.plans.catalog import query
from tractlake.plans.geometry_tables import EVENTS_SQL, events, orders, table

_FIRST = ", f AS (SELECT min(sl_id) AS k FROM s WHERE n > 0)"


@query(_FIRST + " SELECT sl_id, v_idx::INT AS v_idx, x, y, z FROM v JOIN f ON sl_id = k")
def one_streamline(spark, sf):
    t = catalog.orders(spark, sf)
    k = t.streamlines.where(F.size("points") > 0).agg(F.min("sl_id")).first()[0]
    return t.with_(streamlines=t.streamline(k)).vertices().drop("fa")


@query("SELECT sl_id, v_idx::INT AS v_idx, fa AS value FROM v")
def scalar_dpv(spark, sf):
    return orders(spark, sf).scalar_dpv("fa")


@query("SELECT 0::BIGINT AS nb_streamlines, 0::BIGINT AS nb_vertices, count(*) AS other FROM orders", None)
def empty_and_union(spark, sf):
    """An empty tractogram, and that adding it to another changes nothing."""
    t = orders(spark, sf)
    empty = Tractogram.empty(spark, t.header)
    plain = t.with_(streamlines=t.streamlines.select("sl_id", "points"), dps={}, dpv={})
    n = concat.concatenate([empty, plain, empty]).nb_streamlines
    return empty.counts().withColumn("other", F.lit(n).cast("bigint"))


@query("SELECT pri AS grp, count(*) AS n FROM s WHERE sl_id IN (SELECT sl_id FROM s WHERE pri IN ('1-URGENT', '3-MEDIUM') ORDER BY sl_id LIMIT 40) GROUP BY 1")
def neutral_subset(spark, sf):
    """A subset of the neutral form drops groups that it empties."""
    t = orders(spark, sf, "priority").neutral()
    out = subset.subset(t, subset.choose(t, ["1-URGENT", "3-MEDIUM"], 40), drop_empty=True, check=False)
    return out.group_names.join(out.groups, "grp", "left").groupBy("grp").agg(F.count("sl_id").alias("n"))


# metadata


def _bare(t: Tractogram) -> Tractogram:
    return Tractogram.of(t.streamlines.select("sl_id", "points"), t.header, t.dtype)


@query("SELECT sl_id, v_idx::INT AS v_idx, fa FROM v")
def copy_metadata_vertices(spark, sf):
    donor = orders(spark, sf)
    out = metadata.copy_metadata(_bare(donor), donor, metadata.Selection(dpv=["fa"]))
    assert out.dps == {} and out.dpv == {"fa": Array("float32")}
    return out.vertices().select("sl_id", "v_idx", "fa")


_RANKED = ", z AS (SELECT sl_id, pri, n, (row_number() OVER (ORDER BY sl_id) - 1)::BIGINT AS new FROM s)"


@query(_RANKED + " SELECT pri AS grp, (row_number() OVER (PARTITION BY pri ORDER BY new) - 1)::INT AS ord, new AS sl_id FROM z WHERE pri IN ('2-HIGH', '5-LOW')")
def copy_metadata_groups(spark, sf):
    donor = catalog.from_zero(orders(spark, sf, "priority"))
    return metadata.copy_metadata(_bare(donor), donor, metadata.Selection(groups=["2-HIGH", "5-LOW"])).groups


@query("SELECT pri AS grp, 'size' AS field, count(*)::DOUBLE AS value FROM s WHERE pri IN ('2-HIGH', '5-LOW') GROUP BY 1 UNION ALL SELECT '2-HIGH', 'mark', 1.0")
def copy_metadata_group_attributes(spark, sf):
    """Attributes of the chosen groups come along; those of the target that are not overwritten stay."""
    donor = catalog.from_zero(orders(spark, sf, "priority"))
    mark = spark.createDataFrame([("2-HIGH", "mark", "uint8", 1, 0, [1.0]), ("2-HIGH", "size", "float64", 1, 0, [-1.0])], "grp string, field string, dtype string, ncols int, row_idx int, value array<double>")
    few = metadata.copy_metadata(_bare(donor), donor, metadata.Selection(groups=["2-HIGH"]))
    target = metadata.append_dpg(few, mark)
    out = metadata.copy_metadata(target, donor, metadata.Selection(groups=["2-HIGH", "5-LOW"]), dpg=True, overwrite=True)
    return out.dpg.select("grp", "field", F.get("value", F.lit(0)).alias("value"))


@query("SELECT 'dps' AS kind, 'weight' AS name UNION ALL SELECT 'group', grp FROM (SELECT DISTINCT pri AS grp FROM s)")
def copy_metadata_selection(spark, sf):
    """A list of one kind takes only that kind; an empty list, all of it."""
    donor = catalog.from_zero(orders(spark, sf, "priority"))
    out = metadata.copy_metadata(_bare(donor), donor, metadata.Selection(dps=["weight"], groups=[]))
    return out.arrays().select("kind", "name")


@query("SELECT 'odd' AS grp, count(*) AS n, 1.0 AS mark FROM s WHERE sl_id % 2 = 1 UNION ALL SELECT pri, count(*), NULL FROM s WHERE pri <> '1-URGENT' GROUP BY 1")
def insert_groups(spark, sf):
    """A group and an attribute of it inserted, another group replaced by nothing and deleted."""
    t = orders(spark, sf, "priority")
    odd = t.streamlines.where("sl_id % 2 = 1").select(F.lit("odd").alias("grp"), F.col("sl_id").alias("ord"), "sl_id")
    t = metadata.append_groups(t, subset.renumber_members(odd), spark.createDataFrame([("odd", "uint32")], "grp string, dtype string"))
    fields = spark.createDataFrame([("odd", "mark", "float32", 1, 0, [1.0])], "grp string, field string, dtype string, ncols int, row_idx int, value array<double>")
    t = metadata.delete(metadata.append_dpg(t, fields), groups=["1-URGENT"])
    mark = t.dpg.where("field = 'mark'").select("grp", F.get("value", F.lit(0)).alias("mark"))
    return t.groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(mark, "grp", "left")


@query("SELECT 'dpv' AS kind, 'fa' AS name, sum(n)::BIGINT AS nrows FROM s")
def concat_shared_arrays(spark, sf):
    """Inputs of which one lacks an attribute: refused, unless such attributes may go."""
    a, b = catalog._halves(spark, sf, None)
    b = metadata.delete(b, dps=["weight"])
    try:
        concat.concatenate([a, b])
    except checks.ArgumentError:
        return concat.concatenate([a, b], drop_dps=True).arrays().select("kind", "name", "nrows")
    raise AssertionError("an attribute was lost")


@query("SELECT (SELECT count(*) FROM nation)::INT AS dim0, (SELECT max(r_regionkey) + 0.5 FROM region) AS x0, 'kept' AS extra, count(*) AS nb_streamlines FROM orders", None)
def update_affine(spark, sf):
    """Another header's affine and dimensions, made of table sizes; extras and streamlines stay."""
    n, r = table(spark, sf, "nation").count(), table(spark, sf, "region").agg(F.max("r_regionkey")).first()[0]
    t = orders(spark, sf)
    t = t.with_(header=Header(t.header.affine, t.header.dimensions, {"NOTE": "kept"}))
    out = checks.update_affine(t, Header([[r + 0.5, 0.0, 0.0, 0.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 2.0, 0.0], [0.0, 0.0, 0.0, 1.0]], [n, 90, 60]))
    return out.streamlines.agg(F.count(F.lit(1)).alias("nb_streamlines")).select(F.lit(out.header.dimensions[0]).alias("dim0"), F.lit(out.header.affine[0][0]).alias("x0"), F.lit(out.header.extra["NOTE"]).alias("extra"), "nb_streamlines")


_TILT = [[2.0, 0.0, 0.0, -4.0], [0.0, 0.0, 3.0, 1.0], [0.0, -1.0, 0.0, 9.0], [0.0, 0.0, 0.0, 1.0]]


@query(", o AS (SELECT s.sl_id, coalesce(bool_and((x::DOUBLE + 4) / 2 >= 0 AND (x::DOUBLE + 4) / 2 < 20 AND 9 - z::DOUBLE >= 0 AND 9 - z::DOUBLE < 8 AND (y::DOUBLE - 1) / 3 >= 0 AND (y::DOUBLE - 1) / 3 < 25), true) AS ok FROM s LEFT JOIN v USING (sl_id) GROUP BY 1) SELECT sl_id FROM o WHERE ok")
def validate_bounds_tilted(spark, sf):
    """A header whose affine scales, swaps and mirrors axes."""
    t = orders(spark, sf)
    return t.streamlines.where(checks.inside(F.col("points"), Header(_TILT, [20, 8, 25]))).select("sl_id")


# near duplicates


def jittered(spark, sf) -> Tractogram:
    """Streamlines from customers: ten bases apart, each with copies moved by hundredths, every other one reversed."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("sl_id"))
    base, shift = F.col("sl_id") % 150, (F.col("sl_id") % 7) * 0.01
    point = lambda i: F.struct((base * 10 + 0.2 + shift + i).cast("float").alias("x"), (F.lit(0.2) + shift).cast("float").alias("y"), (F.lit(0.2) + i * 0).cast("float").alias("z"))
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), point)
    return Tractogram.of(c.select("sl_id", F.when(F.col("sl_id") % 2 == 0, F.reverse(points)).otherwise(points).alias("points")))


@query("SELECT min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY c_custkey % 150", None)
def dedupe_near_copies(spark, sf):
    """The first of each family stays; which family it is is told by its place."""
    t = jittered(spark, sf)
    params = near.NearParams(tolerance=0.5, end_tolerance=1.0, shared_voxels=0.5)
    family = lambda df: F.floor(F.array_min(df["points.x"]) / 10)
    kept = near.remove_near_duplicates(t, params).streamlines
    kept = kept.select(family(kept).alias("f"), F.round((F.array_min("points.x") - F.floor(F.array_min("points.x") / 10) * 10 - 0.2) * 100).cast("int").alias("s"))
    all_ = t.streamlines.select(F.col("sl_id"), family(t.streamlines).alias("f"), (F.col("sl_id") % 7).cast("int").alias("s"))
    sizes = all_.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    first = all_.join(kept, ["f", "s"]).groupBy("f").agg(F.min("sl_id").alias("first"))
    return kept.join(first, "f").join(sizes, "f").select("first", "n")


_NEAR_LENGTH = ", st AS (SELECT sl_id, v_idx, sqrt(((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS d FROM v WINDOW w AS (PARTITION BY sl_id ORDER BY v_idx))"


@query(_NEAR_LENGTH + " SELECT sl_id, round(coalesce(list_reduce(list(d::FLOAT ORDER BY v_idx) FILTER (WHERE d IS NOT NULL), lambda a, b: (a + b)::FLOAT), 0.0)::DOUBLE, 2) AS len, round(min(x)::DOUBLE, 3) AS x_min, round(max(y)::DOUBLE, 3) AS y_max FROM v JOIN st USING (sl_id, v_idx) GROUP BY 1", EVENTS_SQL)
def near_descriptors(spark, sf):
    rows = near.described(events(spark, sf).streamlines, near.NearParams())
    return rows.select("sl_id", F.round(F.col("len").cast("double"), 2).alias("len"), F.round(F.col("x_min").cast("double"), 3).alias("x_min"), F.round(F.col("y_max").cast("double"), 3).alias("y_max"))


#: Cells of 20 that polylines pass, sampled at half a cell in single precision.
_VOXELS = """, st AS (SELECT sl_id, v_idx, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz
       FROM v WINDOW w AS (PARTITION BY sl_id ORDER BY v_idx)),
  sg AS (SELECT *, greatest(1, ceil(sqrt((dx * dx + dy * dy) + dz * dz)::FLOAT / 10.0::FLOAT))::INT AS n FROM st WHERE ax IS NOT NULL),
  pt AS (SELECT sl_id, x, y, z FROM v WHERE v_idx = 0 UNION ALL
         SELECT sl_id, ax + dx * (k::FLOAT / n::FLOAT), ay + dy * (k::FLOAT / n::FLOAT), az + dz * (k::FLOAT / n::FLOAT) FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM sg))
SELECT sl_id, count(*) AS n_voxels FROM (SELECT DISTINCT sl_id, floor(x / 20.0::FLOAT) AS a, floor(y / 20.0::FLOAT) AS b, floor(z / 20.0::FLOAT) AS c FROM pt) GROUP BY 1"""


@query(_VOXELS, EVENTS_SQL)
def voxel_sets(spark, sf):
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sizes = []
            for i in range(batch.num_rows):
                points = batch.column(1)[i].values
                flat = np.column_stack([points.field(a).to_numpy(zero_copy_only=False) for a in G.AXES]).astype(np.float32)
                sizes.append(len(near.voxels(flat, np.float32(20))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["sl_id", "n_voxels"])

    return events(spark, sf).streamlines.select("sl_id", "points").mapInArrow(run, "sl_id bigint, n_voxels bigint")


# SQL functions and streams


@query(", " + catalog._STEP + ", " + catalog._AABB + " SELECT sl_id, round(l, 4) AS length_mm, coalesce(x0 <= 15 AND x1 >= 5 AND y0 <= 40 AND y1 >= 20 AND z0 <= 6 AND z1 >= 2, false) AS meets, true AS same_backwards FROM len LEFT JOIN b USING (sl_id)")
def sql_functions(spark, sf):
    """The helpers called from SQL."""
    G.register(spark)
    view = f"lines_{id(sf) & 0xFFFFFF}"
    orders(spark, sf).streamlines.createOrReplaceTempView(view)
    meets = "aabb_overlaps(points, float(5), float(20), float(2), float(15), float(40), float(6))"
    return spark.sql(f"SELECT sl_id, round(tract_length(points), 4) AS length_mm, {meets} AS meets, canonical_key(points) = canonical_key(reverse(points)) AS same_backwards FROM {view}")


_SESSIONS = """, gaps AS (SELECT sl_id AS user_id, ts, x, y, z, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS fresh
       FROM (SELECT user_id AS sl_id, ts, value::FLOAT AS x, hour(ts)::FLOAT AS y, day(ts)::FLOAT AS z FROM events) WINDOW w AS (PARTITION BY sl_id ORDER BY ts)),
  k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM gaps)
SELECT user_id, count(*)::INT AS n, round(sum(x::DOUBLE), 2) AS sum_x FROM k GROUP BY user_id, no"""


def _event_points(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", F.col("value").alias("x"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("z"))


@query(_SESSIONS, EVENTS_SQL)
def session_polylines(spark, sf):
    """Polylines of sessions; the same plan runs on a stream."""
    from tractlake.streaming.builder import polylines

    lines = polylines(_event_points(spark, sf), gap="6 hours")
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"].cast("double"))
    return lines.select("user_id", F.size("points").alias("n"), F.round(total, 2).alias("sum_x"))


@query("SELECT count(*) AS nb_streamlines, sum(n)::BIGINT AS nb_vertices, (max(rn))::BIGINT AS last_id FROM (SELECT n, row_number() OVER () - 1 AS rn FROM s)")
def stream_build(spark, sf):
    """A stream over files, some in each micro-batch, run into a builder and read back as a tractogram."""
    from tractlake.streaming.builder import StreamBuilder

    source, out = (catalog._shared(spark, name) for name in ("stream", "built"))
    rows = orders(spark, sf).streamlines.select("points")
    rows.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    builder = StreamBuilder(spark, out)
    run = builder.start(stream, catalog._shared(spark, "checkpoint"))
    run.awaitTermination()
    t = builder.finalize()
    return t.counts().crossJoin(t.streamlines.agg(F.max("sl_id").alias("last_id")))


@query(", " + catalog._AABB + ", q AS (SELECT range::INT AS q, (range * 2)::FLOAT AS lo, (range * 2 + 2)::FLOAT AS hi FROM range(25)) SELECT q, count(sl_id) AS n FROM q LEFT JOIN b ON x0 <= hi AND x1 >= lo AND y0 <= hi AND y1 >= lo GROUP BY 1")
def aabb_many_counts(spark, sf):
    """Boxes that meet squares along the diagonal of two axes."""
    at = F.col("id") * 2
    squares = spark.range(25).select(F.col("id").cast("int").alias("q"), *(v.cast("float").alias(c) for c, v in (("x_lo", at), ("y_lo", at), ("x_hi", at + 2), ("y_hi", at + 2), ("z_lo", F.lit(-1e9)), ("z_hi", F.lit(1e9)))))
    found = boxes.query_many(boxes.build(orders(spark, sf)), squares)
    return squares.select("q").join(found, "q", "left").groupBy("q").agg(F.count("sl_id").alias("n"))
