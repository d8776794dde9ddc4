"""Tractograms made of the driver's tables.

orders: a streamline for each order, its line items as points; empty where there are none. events: a streamline for
each user, events in time as points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.model import DPG, Array, Header, Tractogram
from tractlake.operators.subset import renumber_members

TIE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _point(x, y, z):
    return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"))


def orders(spark: SparkSession, sf_dir: str, groups: str | None = None, dimensions: tuple = (30, 60, 12)) -> Tractogram:
    """groups: "priority" (disjoint) or "flag" (overlapping)."""
    items = table(spark, sf_dir, "lineitem")
    point = _point(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*TIE, point.alias("p"), F.col("l_tax").cast("float").alias("fa")))).alias("v"))
    heads = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    joined = heads.join(rows, heads["o_orderkey"] == rows["l_orderkey"], "left")
    nothing = F.array()
    lines = joined.select(F.col("o_orderkey").alias("sl_id"), F.coalesce("v.p", nothing.cast("array<struct<x:float,y:float,z:float>>")).alias("points"), F.col("o_totalprice").cast("float").alias("dps_weight"), F.coalesce("v.fa", nothing.cast("array<float>")).alias("dpv_fa"))
    members = None
    if groups == "priority":
        members = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("sl_id"))
    elif groups == "flag":
        members = items.select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("sl_id")).distinct()
    names = dpg = None
    if members is not None:
        names = members.select("grp").distinct().withColumn("dtype", F.lit("uint32"))
        dpg = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select("grp", F.lit("size").alias("field"), F.lit("float64").alias("dtype"), F.lit(1).alias("ncols"), F.lit(0).alias("row_idx"), F.array(F.col("n").cast("double")).alias("value"))
        members = renumber_members(members.withColumn("ord", F.col("sl_id")))
    out = Tractogram.of(lines, Header(dimensions=list(dimensions)), "float32", {"weight": Array("float32")}, {"fa": Array("float32")}, members, names, dpg if dpg is not None else spark.createDataFrame([], DPG))
    return out


def events(spark: SparkSession, sf_dir: str) -> Tractogram:
    rows = table(spark, sf_dir, "events")
    point = _point(F.col("value"), F.hour("ts"), F.dayofmonth("ts"))
    lines = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", point.alias("p")))).alias("v"))
    members = rows.select(F.col("event_type").alias("grp"), F.col("user_id").alias("sl_id")).distinct()
    return Tractogram.of(lines.select(F.col("user_id").alias("sl_id"), F.col("v.p").alias("points")), groups=renumber_members(members.withColumn("ord", F.col("sl_id"))))


#: The same tables in SQL, to build on.
ORDERS_SQL = """
v AS (SELECT l_orderkey AS sl_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS v_idx,
             l_quantity::FLOAT AS x, (l_extendedprice / 1000)::FLOAT AS y, (l_discount * 100)::FLOAT + 0.0::FLOAT AS z, l_tax::FLOAT AS fa FROM lineitem),
s AS (SELECT o_orderkey AS sl_id, o_totalprice::FLOAT AS weight, o_orderpriority AS pri, (SELECT count(*) FROM v WHERE v.sl_id = o_orderkey) AS n FROM orders)
"""
EVENTS_SQL = """
v AS (SELECT user_id AS sl_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS v_idx, value::FLOAT AS x, hour(ts)::FLOAT AS y, day(ts)::FLOAT AS z FROM events),
g AS (SELECT DISTINCT event_type AS grp, user_id AS sl_id FROM events)
"""
