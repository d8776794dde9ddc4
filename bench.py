"""Times the headline queries after a warm-up, over tables written once, and prints one JSON line.

The tractogram that the queries work on is made of the driver's tables and written as Parquet first, so that what is
timed is the operator. The sweeps are over boxes in Parquet's cache, twenty slabs on each axis in one job, with the ids
of all hits gathered; medians of five.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADLINE = ("aabb_build", "aabb_query", "aabb_slabs20", "subset_every10th", "length_mm", "vertices", "concat_streamlines", "set_intersection", "dedupe_exact", "connectivity_count", "validate_dedupe")
AXES = ("x", "y", "z")


def run(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def written_once(spark: SparkSession, sf: str, folder: str) -> None:
    """From now on the catalog's orders tractogram is read from Parquet."""
    from tractlake.plans import catalog
    from tractlake.plans.geometry_tables import orders

    made = {}

    def stored(spark: SparkSession, sf: str, groups: str | None = None, **options):
        if groups not in made:
            t = orders(spark, sf, groups, **options)
            parts = {}
            for name in ("streamlines", "groups", "group_names", "dpg"):
                path = os.path.join(folder, f"{groups}-{name}")
                getattr(t, name).write.mode("overwrite").parquet(path)
                parts[name] = spark.read.parquet(path)
            made[groups] = t.with_(**parts)
        return made[groups]

    catalog.orders = stored


def slabs(spark: SparkSession, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Twenty slabs along each axis."""
    parts = None
    for k, axis in enumerate(AXES):
        step = (high[axis] - low[axis]) / 20
        bounds = []
        for a in AXES:
            own = a == axis
            bounds += [(F.lit(low[axis]) + F.col("id") * step if own else F.lit(-1e9)).cast("float").alias(f"{a}_lo"), (F.lit(low[axis]) + (F.col("id") + 1) * step if own else F.lit(1e9)).cast("float").alias(f"{a}_hi")]
        part = spark.range(20).select((F.col("id") + 20 * k).cast("int").alias("q"), *bounds)
        parts = part if parts is None else parts.union(part)
    return parts


def sweep(spark: SparkSession, boxes_: DataFrame, n: int) -> dict[str, float]:
    """Seconds for twenty slabs (the mean of three axes in one job) and box tests a second; all ids of hits are written out."""
    from tractlake.operators import boxes

    cached = boxes_.cache()
    assert cached.count() == n
    row = cached.where("x_min <= x_max").agg(*(F.min(f"{a}_min") for a in AXES), *(F.max(f"{a}_max") for a in AXES)).first()
    queries = slabs(spark, dict(zip(AXES, row[:3], strict=True)), dict(zip(AXES, row[3:], strict=True)))
    took = statistics.median(run(boxes.query_many(cached, queries)) for _ in range(5)) / 3
    cached.unpersist()
    return {"boxes": n, "sweep20_sec": round(took, 4), "box_tests_per_sec": round(20 * n / took)}


def random_boxes(spark: SparkSession, n: int) -> DataFrame:
    at = [F.rand(7 + i) * 130 - 65 for i in range(3)]
    size = [F.rand(17 + i) * 20 for i in range(3)]
    return spark.range(n).select(F.col("id").alias("sl_id"), *(c.cast("float").alias(f"{a}_min") for a, c in zip(AXES, at, strict=True)), *((c + s).cast("float").alias(f"{a}_max") for a, c, s in zip(AXES, at, size, strict=True)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="tractlake-bench-")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tractlake.operators import boxes
    from tractlake.plans import catalog

    written_once(spark, sf, folder)
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            run(catalog.QUERIES[name](spark, sf))
            seconds[name] = round(time.time() - began, 4)
    own = boxes.build(catalog.orders(spark, sf))
    sweeps = [sweep(spark, own, own.count()), sweep(spark, random_boxes(spark, 1_000_000), 1_000_000), sweep(spark, random_boxes(spark, 10_000_000), 10_000_000)]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1], "sweeps": sweeps}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
