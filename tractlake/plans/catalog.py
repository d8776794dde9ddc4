"""Queries by name, and SQL for each that SQL can express."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError
from tractlake.functions import geometry as G
from tractlake.model import Tractogram
from tractlake.operators import boxes, checks, concat, metadata, near, setops, subset
from tractlake.operators.cast import cast_positions
from tractlake.operators.connectivity import connectivity
from tractlake.operators.numbering import renumbered
from tractlake.plans.geometry_tables import EVENTS_SQL, ORDERS_SQL, events, orders, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
BOX = ([5.0, 20.0, 2.0], [15.0, 40.0, 6.0])
MATRIX = [[0.0, 2.0, 0.0, 1.0], [1.5, 0.0, 0.0, -3.0], [0.0, 0.0, -1.0, 10.0], [0.0, 0.0, 0.0, 1.0]]


def query(sql: str | None = None, base: str | None = ORDERS_SQL):
    """Register a query, with SQL built on one of the geometry tables."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {base.strip()} {sql}" if base else sql
        return f

    return put


def r4(c):
    return F.round(c.cast("double"), 4)


def sums(t: Tractogram) -> DataFrame:
    """sl_id, n, and x summed up: enough to tell streamlines apart."""
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"].cast("double"))
    return t.streamlines.select("sl_id", F.size("points").cast("bigint").alias("n"), F.round(total, 4).alias("sum_x"))


SUMS = "round(coalesce((SELECT sum(x::DOUBLE) FROM v WHERE v.sl_id = {k}), 0.0), 4) AS sum_x"


@query("SELECT (SELECT count(*) FROM orders) AS nb_streamlines, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS nb_vertices", None)
def info_counts(spark, sf):
    return orders(spark, sf).counts()


@query(", w AS (SELECT sl_id, n FROM s) SELECT sl_id, n FROM w")
def streamline_lengths(spark, sf):
    return orders(spark, sf).streamlines.select("sl_id", F.size("points").cast("bigint").alias("n"))


@query("SELECT sl_id, (sum(n) OVER (ORDER BY sl_id) - n)::BIGINT AS off FROM s")
def offsets(spark, sf):
    return orders(spark, sf).offsets().select("sl_id", "off")


@query("SELECT sl_id, v_idx::INT AS v_idx, x, y, z, fa FROM v")
def vertices(spark, sf):
    return orders(spark, sf).vertices()


_AABB = "b AS (SELECT sl_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM v GROUP BY 1)"


@query(", " + _AABB + " SELECT sl_id, round(x0::DOUBLE, 4) + 0.0 AS x_min, round(y0::DOUBLE, 4) + 0.0 AS y_min, round(z0::DOUBLE, 4) + 0.0 AS z_min, round(x1::DOUBLE, 4) + 0.0 AS x_max, round(y1::DOUBLE, 4) + 0.0 AS y_max, round(z1::DOUBLE, 4) + 0.0 AS z_max FROM b")
def aabb_build(spark, sf):
    names = [f"{a}_{m}" for m in ("min", "max") for a in G.AXES]
    return boxes.build(orders(spark, sf)).where("x_min <= x_max").select("sl_id", *((r4(F.col(c)) + 0.0).alias(c) for c in names))


_MEETS = "x0 <= {1} AND x1 >= {0} AND y0 <= {3} AND y1 >= {2} AND z0 <= {5} AND z1 >= {4}"


@query(", " + _AABB + " SELECT sl_id FROM b WHERE " + _MEETS.format(*(v for pair in zip(*BOX, strict=True) for v in pair)))
def aabb_query(spark, sf):
    return boxes.query(boxes.build(orders(spark, sf)), *BOX)


@query(", " + _AABB + ", q AS (SELECT range::INT AS q, (5 * range)::FLOAT AS lo, (5 * range + 5)::FLOAT AS hi FROM range(20)) SELECT q, sl_id FROM b JOIN q ON y0 <= hi AND y1 >= lo")
def aabb_slabs20(spark, sf):
    slabs = spark.range(20).select(F.col("id").cast("int").alias("q"), *(F.lit(v).cast("float").alias(c) for c, v in (("x_lo", -1e9), ("x_hi", 1e9), ("z_lo", -1e9), ("z_hi", 1e9))), (F.col("id") * 5).cast("float").alias("y_lo"), (F.col("id") * 5 + 5).cast("float").alias("y_hi"))
    return boxes.query_many(boxes.build(orders(spark, sf)), slabs)


_STEP = "st AS (SELECT sl_id, sqrt(pow((x - lag(x) OVER w)::DOUBLE, 2) + pow((y - lag(y) OVER w)::DOUBLE, 2) + pow((z - lag(z) OVER w)::DOUBLE, 2)) AS d FROM v WINDOW w AS (PARTITION BY sl_id ORDER BY v_idx)), len AS (SELECT s.sl_id, coalesce(sum(d), 0.0) AS l FROM s LEFT JOIN st USING (sl_id) GROUP BY 1)"


@query(", " + _STEP + " SELECT sl_id, round(l, 4) AS length_mm FROM len")
def length_mm(spark, sf):
    return orders(spark, sf).streamlines.select("sl_id", F.round(G.length(F.col("points")), 4).alias("length_mm"))


@query(", " + _STEP + " SELECT round(min(l), 3) AS min_mm, round(avg(l), 3) AS mean_mm, round(max(l), 3) AS max_mm FROM len")
def length_stats(spark, sf):
    return checks.length_stats(orders(spark, sf)).select(*(F.round(c, 3).alias(c) for c in ("min_mm", "mean_mm", "max_mm")))


def _tenth(t: Tractogram) -> DataFrame:
    """New and old ids of every tenth streamline."""
    placed = renumbered(t.streamlines.select("sl_id"), "sl_id", "place")
    return placed.where("place % 10 = 0").select((F.col("place") / 10).cast("bigint").alias("new_id"), F.col("sl_id").alias("old_id"))


_TENTH = "i AS (SELECT sl_id AS old_id, (p // 10)::BIGINT AS new_id FROM (SELECT sl_id, row_number() OVER (ORDER BY sl_id) - 1 AS p FROM s) WHERE p % 10 = 0)"


@query(", " + _TENTH + " SELECT new_id AS sl_id, n, " + SUMS.format(k="old_id") + " FROM i JOIN s ON sl_id = old_id")
def subset_every10th(spark, sf):
    t = orders(spark, sf)
    return sums(subset.subset(t, _tenth(t), check=False))


@query(", " + _TENTH + " SELECT new_id AS sl_id, round(weight::DOUBLE, 2) AS weight, round(coalesce((SELECT sum(fa::DOUBLE) FROM v WHERE v.sl_id = old_id), 0.0), 4) AS sum_fa FROM i JOIN s ON sl_id = old_id")
def subset_dps_dpv(spark, sf):
    t = orders(spark, sf)
    out = subset.subset(t, _tenth(t), check=False).streamlines
    total = F.aggregate("dpv_fa", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return out.select("sl_id", F.round(F.col("dps_weight").cast("double"), 2).alias("weight"), F.round(total, 4).alias("sum_fa"))


@query(", " + _TENTH + " SELECT pri AS grp, (row_number() OVER (PARTITION BY pri ORDER BY old_id) - 1)::INT AS ord, new_id AS sl_id FROM i JOIN s ON sl_id = old_id")
def remap_groups(spark, sf):
    t = orders(spark, sf, "priority")
    return subset.subset(t, _tenth(t), check=False).groups


@query("SELECT pri AS grp, 'size' AS field, count(*)::DOUBLE AS value FROM s GROUP BY 1 HAVING pri IN ('1-URGENT', '2-HIGH')")
def remap_dpg(spark, sf):
    t = orders(spark, sf, "priority")
    return subset.take(t, ["1-URGENT", "2-HIGH"]).dpg.select("grp", "field", F.get("value", F.lit(0)).alias("value"))


@query("SELECT sl_id FROM s WHERE pri IN ('1-URGENT', '2-HIGH')")
def subset_group_union(spark, sf):
    return subset.in_groups(orders(spark, sf, "priority"), ["1-URGENT", "2-HIGH"])


@query("SELECT (row_number() OVER (ORDER BY sl_id) - 1)::BIGINT AS new_id, sl_id AS old_id FROM s WHERE pri = '1-URGENT' ORDER BY sl_id LIMIT 50")
def subset_first_n(spark, sf):
    return subset.choose(orders(spark, sf, "priority"), ["1-URGENT"], 50)


@query("SELECT least(50, count(*))::BIGINT AS n, least(50, count(*))::BIGINT AS n_known, true AS ascending, true AS same_again, true AS other_seed_differs FROM s")
def sample_random(spark, sf):
    """Picks by a hash can't be told in SQL; what holds for them can: size, order, and that a seed decides."""
    t = orders(spark, sf)
    picked, again, other = (subset.choose(t, n=50, seed=k) for k in (7, 7, 8))
    known = picked.join(t.streamlines.select("sl_id"), F.col("old_id") == F.col("sl_id"), "left_semi").select(F.count(F.lit(1)).alias("n_known"))
    lists = picked.select(F.array_sort(F.collect_list(F.struct("new_id", "old_id"))).alias("l"))
    digest = lambda df, name: df.select(F.bit_xor(F.xxhash64("new_id", "old_id")).alias(name))
    rows = lists.crossJoin(known).crossJoin(digest(picked, "p")).crossJoin(digest(again, "a")).crossJoin(digest(other, "o"))
    ascending = F.col("l.old_id") == F.array_sort("l.old_id")
    return rows.select(F.size("l").cast("bigint").alias("n"), "n_known", ascending.alias("ascending"), (F.col("p") == F.col("a")).alias("same_again"), (F.col("p") != F.col("o")).alias("other_seed_differs"))


@query("SELECT pri AS grp, md5(string_agg(sl_id::VARCHAR, ' ' ORDER BY sl_id)) AS members, count(*) AS n FROM s GROUP BY 1")
def group_lists(spark, sf):
    lists = orders(spark, sf, "priority").group_lists()
    return lists.select("grp", F.md5(F.array_join(F.col("members").cast("array<string>"), " ").cast("binary")).alias("members"), F.size("members").cast("bigint").alias("n"))


def _sides(spark, sf) -> tuple[Tractogram, Tractogram]:
    t = orders(spark, sf)
    part = lambda cond: t.with_(streamlines=t.streamlines.where(cond))
    a = part("sl_id % 10 < 7")
    # b repeats some of its own, under new ids
    twice = t.streamlines.where("sl_id % 10 = 9").withColumn("sl_id", F.col("sl_id") + 1_000_000_000)
    return a, part("sl_id % 10 >= 3").with_(streamlines=t.streamlines.where("sl_id % 10 >= 3").unionByName(twice))


_KEYS = "k AS (SELECT s.sl_id, list(struct_pack(x := x, y := y, z := z) ORDER BY v_idx) FILTER (v_idx IS NOT NULL) AS g FROM s LEFT JOIN v USING (sl_id) GROUP BY 1), kk AS (SELECT sl_id, coalesce(g::VARCHAR, '') AS g FROM k), a AS (SELECT * FROM kk WHERE sl_id % 10 < 7), b AS (SELECT * FROM kk WHERE sl_id % 10 >= 3 UNION ALL SELECT sl_id + 1000000000, g FROM kk WHERE sl_id % 10 = 9)"


@query(", " + _KEYS + ", o AS (SELECT sl_id AS old FROM a WHERE g IN (SELECT g FROM b)) SELECT (row_number() OVER (ORDER BY old) - 1)::BIGINT AS sl_id, n, " + SUMS.format(k="old") + " FROM o JOIN s ON s.sl_id = old")
def set_intersection(spark, sf):
    return sums(setops.intersection(*_sides(spark, sf)))


@query(", " + _KEYS + ", o AS (SELECT sl_id AS old FROM a WHERE g NOT IN (SELECT g FROM b)) SELECT (row_number() OVER (ORDER BY old) - 1)::BIGINT AS sl_id, n, " + SUMS.format(k="old") + " FROM o JOIN s ON s.sl_id = old")
def set_difference(spark, sf):
    return sums(setops.difference(*_sides(spark, sf)))


@query(", " + _KEYS + ", o AS (SELECT sl_id AS old, 0 AS side FROM a UNION ALL SELECT sl_id, 1 FROM b WHERE g NOT IN (SELECT g FROM a)) SELECT n, " + SUMS.format(k="old % 1000000000") + " FROM o JOIN s ON s.sl_id = old % 1000000000")
def set_union(spark, sf):
    return sums(setops.union(*_sides(spark, sf))).drop("sl_id")


@query(", " + _KEYS + ", r AS (SELECT sl_id, coalesce(g::VARCHAR, '') AS f, coalesce(list_reverse(g)::VARCHAR, '') AS e FROM k), u AS (SELECT sl_id, least(f, e) AS c FROM r UNION ALL SELECT sl_id + 1000000000, least(f, e) FROM r) SELECT min(sl_id) AS sl_id FROM u GROUP BY c")
def dedupe_exact(spark, sf):
    t = orders(spark, sf)
    back = t.streamlines.withColumns({"sl_id": F.col("sl_id") + 1_000_000_000, "points": F.reverse("points"), "dpv_fa": F.reverse("dpv_fa")})
    return setops.representatives(t.with_(streamlines=t.streamlines.unionByName(back)))


_NEAR = near.NearParams(tolerance=20.0, end_tolerance=40.0, shared_voxels=0.1)


def _ends(spark, sf) -> DataFrame:
    return near.described(events(spark, sf).streamlines, _NEAR)


_CELLS = "e AS (SELECT sl_id, floor(arg_min(x, v_idx) / 40.0::FLOAT)::INT AS fx, floor(arg_min(y, v_idx) / 40.0::FLOAT)::INT AS fy, floor(arg_min(z, v_idx) / 40.0::FLOAT)::INT AS fz, floor(arg_max(x, v_idx) / 40.0::FLOAT)::INT AS lx, floor(arg_max(y, v_idx) / 40.0::FLOAT)::INT AS ly, floor(arg_max(z, v_idx) / 40.0::FLOAT)::INT AS lz FROM v GROUP BY 1)"


@query(", " + _CELLS + " SELECT sl_id, fx AS first_x, fy AS first_y, fz AS first_z, lx AS last_x, ly AS last_y, lz AS last_z FROM e", EVENTS_SQL)
def endpoint_cells(spark, sf):
    return _ends(spark, sf).select("sl_id", *(f"{e}_{a}" for e in ("first", "last") for a in G.AXES))


@query(", " + _CELLS + " SELECT p.sl_id AS a, q.sl_id AS b FROM e p JOIN e q ON p.sl_id < q.sl_id AND abs(p.fx - q.fx) <= 1 AND abs(p.fy - q.fy) <= 1 AND abs(p.fz - q.fz) <= 1 AND abs(p.lx - q.lx) <= 1 AND abs(p.ly - q.ly) <= 1 AND abs(p.lz - q.lz) <= 1", EVENTS_SQL)
def near_candidates(spark, sf):
    return near.candidates(_ends(spark, sf)).select(F.col("a_sl_id").alias("a"), F.col("b_sl_id").alias("b"))


@query()
def dedupe_near(spark, sf):
    return sums(near.remove_near_duplicates(events(spark, sf), _NEAR))


@query("SELECT sl_id, round(arg_min(x, v_idx)::DOUBLE, 4) AS x0, round(arg_min(y, v_idx)::DOUBLE, 4) AS y0, round(arg_max(x, v_idx)::DOUBLE, 4) AS x1, round(arg_max(y, v_idx)::DOUBLE, 4) AS y1 FROM v GROUP BY 1", EVENTS_SQL)
def endpoints(spark, sf):
    p = F.col("points")
    first, last = G.first_point(p), G.last_point(p)
    return events(spark, sf).streamlines.select("sl_id", r4(first["x"]).alias("x0"), r4(first["y"]).alias("y0"), r4(last["x"]).alias("x1"), r4(last["y"]).alias("y1"))


def _halves(spark, sf, groups="priority") -> list[Tractogram]:
    t = orders(spark, sf, groups)
    out = []
    for i in (0, 1):
        ids = renumbered(t.streamlines.where(F.col("sl_id") % 2 == i).select("sl_id"), "sl_id", "new_id").select("new_id", F.col("sl_id").alias("old_id"))
        out.append(subset.subset(t, ids, check=False))
    return out


_HALVES = "h AS (SELECT sl_id AS old, pri, n, (row_number() OVER (ORDER BY sl_id % 2, sl_id) - 1)::BIGINT AS sl_id, sl_id % 2 AS side FROM s)"


@query(", " + _HALVES + " SELECT sl_id, n, " + SUMS.format(k="old") + " FROM h")
def concat_streamlines(spark, sf):
    return sums(concat.concatenate(_halves(spark, sf)))


@query(", " + _HALVES + " SELECT CASE side WHEN 0 THEN 'even_' ELSE 'odd_' END || pri AS grp, (row_number() OVER (PARTITION BY side, pri ORDER BY sl_id) - 1)::INT AS ord, sl_id FROM h")
def concat_groups_prefix(spark, sf):
    return concat.concatenate(_halves(spark, sf), ["even_", "odd_"]).groups


@query(", " + _HALVES + " SELECT pri AS grp, (row_number() OVER (PARTITION BY pri ORDER BY side, sl_id) - 1)::INT AS ord, sl_id FROM h")
def concat_groups_aggregate(spark, sf):
    return concat.concatenate(_halves(spark, sf)).groups


@query("SELECT sl_id, round(weight::DOUBLE, 2) AS weight FROM s")
def copy_metadata_merge(spark, sf):
    donor = orders(spark, sf)
    target = donor.with_(streamlines=donor.streamlines.select("sl_id", "points"), dps={}, dpv={})
    out = metadata.copy_metadata(target, donor, metadata.Selection(dps=["weight"]))
    return out.streamlines.select("sl_id", F.round(F.col("dps_weight").cast("double"), 2).alias("weight"))


@query("SELECT kind, name FROM (SELECT 'dps' AS kind, 'weight' AS name UNION ALL SELECT 'dpv', 'fa' UNION ALL SELECT 'groups', grp FROM (SELECT DISTINCT l_returnflag AS grp FROM lineitem INTERSECT SELECT DISTINCT substr(o_orderpriority, 3, 1) FROM orders))")
def copy_metadata_conflicts(spark, sf):
    """Names on both sides: groups by flag in the target, by the first letter of the priority in the donor."""
    target, donor = orders(spark, sf, "flag"), orders(spark, sf, "priority")
    letter = F.substring("grp", 3, 1)
    names = donor.group_names.withColumn("grp", letter).distinct()
    donor = donor.with_(groups=subset.renumber_members(donor.groups.select(letter.alias("grp"), F.col("sl_id").alias("ord"), "sl_id")), group_names=names)
    return spark.createDataFrame(metadata.conflicts(target, donor), "kind string, name string")


_HALF_COUNTS = "h2 AS (SELECT (SELECT count(*) FROM s WHERE sl_id % 2 = 0) AS sa, (SELECT sum(n)::BIGINT FROM s WHERE sl_id % 2 = 0) AS va, (SELECT count(*) FROM s WHERE sl_id % 2 = 1 AND pri <> '5-LOW') AS sb, (SELECT sum(n)::BIGINT FROM s WHERE sl_id % 2 = 1 AND pri <> '5-LOW') AS vb)"


@query(", " + _HALF_COUNTS + " SELECT 'nb_streamlines' AS what, sa::VARCHAR AS left, sb::VARCHAR AS right, sa = sb AS same, '' AS only_left FROM h2 UNION ALL SELECT 'nb_vertices', va::VARCHAR, vb::VARCHAR, va = vb, '' FROM h2 UNION ALL SELECT 'groups', a, b, a = b, '5-LOW' FROM (SELECT '[' || string_agg(quoted, ', ' ORDER BY quoted) || ']' AS a, '[' || string_agg(quoted, ', ' ORDER BY quoted) FILTER (pri <> '5-LOW') || ']' AS b FROM (SELECT DISTINCT pri, chr(39) || pri || chr(39) AS quoted FROM s)) UNION ALL SELECT 'dps', '[''weight'']', '[''weight'']', true, ''")
def compare_summary(spark, sf):
    """Two halves, one without a group: counts, and names that only one has."""
    t = orders(spark, sf, "priority")
    low = t.groups.where("grp = '5-LOW'").select("sl_id")
    a = t.with_(streamlines=t.streamlines.where("sl_id % 2 = 0"))
    b = metadata.delete(t.with_(streamlines=t.streamlines.where("sl_id % 2 = 1").join(low, "sl_id", "left_anti")), groups=["5-LOW"])
    found = checks.compare(a, b).where(F.col("what").isin("nb_streamlines", "nb_vertices", "groups", "dps"))
    return found.select("what", "left", "right", "same", F.array_join("only_left", ",").alias("only_left"))


_FLAGS = ", g AS (SELECT DISTINCT l_orderkey AS sl_id, l_returnflag AS grp FROM lineitem), p AS (SELECT a.grp AS gi, b.grp AS gj, a.sl_id FROM g a JOIN g b ON a.sl_id = b.sl_id AND a.grp <= b.grp), n AS (SELECT * FROM (VALUES ('A', 0), ('N', 1), ('R', 2)) AS t(grp, i))"
_PAIRS = "SELECT (x.i * 3 - x.i * (x.i + 1) // 2 + y.i)::INT AS entry, x.i::INT AS i, y.i::INT AS j, {v} AS value FROM p JOIN n x ON x.grp = gi JOIN n y ON y.grp = gj JOIN s USING (sl_id) GROUP BY x.i, y.i"


@query(_FLAGS + " " + _PAIRS.format(v="(count(*) * CASE WHEN x.i = y.i THEN 1 ELSE 2 END)::DOUBLE"))
def connectivity_count(spark, sf):
    return connectivity(orders(spark, sf, "flag"), ["A", "N", "R"])


@query(_FLAGS + " " + _PAIRS.format(v="round(sum(weight::DOUBLE) * CASE WHEN x.i = y.i THEN 1 ELSE 2 END, 1)"))
def connectivity_weighted(spark, sf):
    return connectivity(orders(spark, sf, "flag"), ["A", "N", "R"], "weight").withColumn("value", F.round("value", 1))


_IN = ", o AS (SELECT s.sl_id, coalesce(bool_and(x >= 0 AND x < 30 AND y >= 0 AND y < 60 AND z >= 0 AND z < 12), true) AS ok FROM s LEFT JOIN v USING (sl_id) GROUP BY 1)"


@query(_IN + " SELECT sl_id FROM o WHERE ok")
def validate_bounds(spark, sf):
    t = orders(spark, sf)
    return t.streamlines.where(checks.inside(F.col("points"), t.header)).select("sl_id")


@query(_IN + ", " + _KEYS + ", r AS (SELECT o.sl_id, least(coalesce(g::VARCHAR, ''), coalesce(list_reverse(g)::VARCHAR, '')) AS c FROM o JOIN k USING (sl_id) WHERE ok) SELECT (SELECT count(*) FROM s) AS n_streamlines, (SELECT count(*) FROM o WHERE NOT ok) AS out_of_bounds, count(*) - count(DISTINCT c) AS duplicates, count(DISTINCT c) AS n_valid FROM r")
def validate_dedupe(spark, sf):
    return checks.validate(orders(spark, sf))[1]


def _points(df: DataFrame) -> DataFrame:
    return df.select("sl_id", F.posexplode("points").alias("v_idx", "p")).select("sl_id", "v_idx", *((r4(F.col("p")[a]) + 0.0).alias(a) for a in G.AXES))


def _points_sql(x: str, y: str, z: str) -> str:
    return "SELECT sl_id, v_idx::INT AS v_idx, " + ", ".join(f"round(({e})::FLOAT::DOUBLE, 4) + 0.0 AS {a}" for a, e in zip("xyz", (x, y, z), strict=True)) + " FROM v"


@query(_points_sql("2.0::DOUBLE * y + 1.0::DOUBLE", "1.5::DOUBLE * x - 3.0::DOUBLE", "10.0::DOUBLE - z"), EVENTS_SQL)
def affine_apply(spark, sf):
    return _points(events(spark, sf).streamlines.withColumn("points", G.affine(F.col("points"), MATRIX)))


@query(_points_sql("-x", "-y", "z"), EVENTS_SQL)
def lps_flip(spark, sf):
    return _points(events(spark, sf).streamlines.withColumn("points", G.flip_lps(F.col("points"))))


@query(_points_sql("x + 1.0::FLOAT", "y + 1.0::FLOAT", "z + 1.0::FLOAT"), EVENTS_SQL)
def translate(spark, sf):
    return _points(events(spark, sf).streamlines.withColumn("points", G.translate(F.col("points"), 1.0)))


@query("SELECT pri AS grp, max(sl_id) AS max_index FROM s GROUP BY 1")
def max_group_index(spark, sf):
    return orders(spark, sf, "priority").max_group_index()


@query("SELECT grp, round(avg(x::DOUBLE), 4) AS mean_x FROM g JOIN v USING (sl_id) GROUP BY 1", EVENTS_SQL)
def group_mean_x(spark, sf):
    t = events(spark, sf)
    return t.groups.join(t.vertices(), "sl_id").groupBy("grp").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean_x"))


@query("SELECT grp, count(*) AS n FROM g GROUP BY 1", EVENTS_SQL)
def group_sizes(spark, sf):
    return events(spark, sf).groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, (((p_partkey * 7919) >> 16) & 255)::INT AS r, (((p_partkey * 7919) >> 8) & 255)::INT AS g, ((p_partkey * 7919) & 255)::INT AS b FROM part", None)
def rgb_unpack(spark, sf):
    rgb = table(spark, sf, "part").select("p_partkey", G.rgb(F.col("p_partkey") * 7919).alias("rgb"))
    return rgb.select("p_partkey", *(F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


@query("SELECT p_partkey, trim(replace(replace(replace(' ' || replace(p_name, ' ', '/') || ':', '/', '_'), '\\', '_'), ':', '_')) AS name FROM part", None)
def sanitize_name(spark, sf):
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(":"))
    return table(spark, sf, "part").select("p_partkey", G.safe_name(raw).alias("name"))


_HALF = "CASE WHEN {v} = 0 THEN 0.0 ELSE round_even({v}::DOUBLE / pow(2, floor(log2(abs({v}::DOUBLE))) - 10), 0) * pow(2, floor(log2(abs({v}::DOUBLE))) - 10) END"


@query(_points_sql(*(_HALF.format(v=a) for a in "xyz")), EVENTS_SQL)
def cast_f16(spark, sf):
    """Eleven bits, ties to even: in SQL by powers of two, as all coordinates are normal numbers."""
    return _points(cast_positions(events(spark, sf), "float16").streamlines)


@query("SELECT sl_id, v_idx::INT AS v_idx, x, y, z FROM (SELECT sl_id, v_idx, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM v)", EVENTS_SQL)
def cast_f64(spark, sf):
    """Positions pass through single precision, so doubles are exactly the old floats."""
    return cast_positions(events(spark, sf), "float64").vertices()


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{near.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """A new folder for files that the driver writes and executors read: it must be mounted."""
    found = urlsplit(_shared(spark, "through"))
    if found.scheme not in ("", "file"):
        raise ArgumentError(f"files are written and read through a mounted folder: {found.geturl()}")
    os.makedirs(found.path)
    return found.path


def from_zero(t: Tractogram) -> Tractogram:
    """With ids 0, 1, 2, .. in the old order, as files have them."""
    ids = renumbered(t.streamlines.select("sl_id"), "sl_id", "new_id").select("new_id", F.col("sl_id").alias("old_id"))
    return subset.subset(t, ids, check=False)


def _through(spark: SparkSession, sf: str, ending: str) -> DataFrame:
    """A tractogram written by the driver to a file in the shared folder, and read back."""
    from tractlake.sources import files

    path = os.path.join(folder(spark), f"lines{ending}")
    files.write_tractogram(from_zero(events(spark, sf)), path)
    return _points(files.load(spark, path).streamlines)


_FROM_ZERO = ", i AS (SELECT sl_id AS old, (row_number() OVER (ORDER BY sl_id) - 1)::BIGINT AS new FROM (SELECT DISTINCT sl_id FROM v)) SELECT new AS sl_id, v_idx::INT AS v_idx, round(x::DOUBLE, 4) + 0.0 AS x, round(y::DOUBLE, 4) + 0.0 AS y, round(z::DOUBLE, 4) + 0.0 AS z FROM v JOIN i ON old = sl_id"


@query(_FROM_ZERO, EVENTS_SQL)
def trx_roundtrip(spark, sf):
    return _through(spark, sf, ".trx")


@query(_FROM_ZERO, EVENTS_SQL)
def trx_folder_roundtrip(spark, sf):
    return _through(spark, sf, "")


@query(_FROM_ZERO, EVENTS_SQL)
def tck_roundtrip(spark, sf):
    return _through(spark, sf, ".tck.gz")


@query(_FROM_ZERO, EVENTS_SQL)
def vtk_roundtrip(spark, sf):
    return _through(spark, sf, ".vtk")


@query("SELECT kind, name, nrows, dtype FROM (SELECT 'dps' AS kind, 'weight' AS name, count(*) AS nrows, 'float32' AS dtype FROM s UNION ALL SELECT 'dpv', 'fa', sum(n)::BIGINT, 'float32' FROM s UNION ALL SELECT 'group', pri, count(*), 'uint32' FROM s GROUP BY pri UNION ALL SELECT 'dpg', 'size', 1, 'float64' FROM (SELECT DISTINCT pri FROM s))")
def arrays(spark, sf):
    return orders(spark, sf, "priority").arrays().select("kind", "name", "nrows", "dtype")


@query("SELECT sl_id, round(weight::DOUBLE, 2) AS weight FROM s WHERE pri = '3-MEDIUM'")
def scalar_dps(spark, sf):
    t = orders(spark, sf, "priority")
    return t.scalar_dps("weight").join(t.group("3-MEDIUM").select("sl_id"), "sl_id").select("sl_id", F.round(F.col("value").cast("double"), 2).alias("weight"))


@query("SELECT sl_id, (2 * n)::BIGINT AS value FROM s")
def append_dps(spark, sf):
    from tractlake.model import Array

    t = orders(spark, sf)
    out = metadata.append_dps(t, "twice", t.streamlines.select("sl_id", (F.size("points") * 2).cast("bigint").alias("value")), Array("int64"))
    return metadata.delete(out, dps=["weight"]).dps_column("twice")


# queries in modules of their own register themselves
from tractlake.plans import file_queries, more_queries  # noqa: E402, F401
