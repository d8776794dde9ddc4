"""What the operators share: scratch tables in the shared folder, safe columns, components of a graph."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.shipping import ship

ROW = "__row"
#: Up to so many ids a table of them is broadcast, after counting it; beyond, joins shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of the Arrow batches that Python operators get: texts are long, and a task holds several batches.
BATCH_ROWS = 1_000
BATCH, CLEANUP = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tractlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before.

    Tables that a result still reads stay until ``drop`` or the end of the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = ship(spark), f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    @contextlib.contextmanager
    def cleaning(self):
        """Within it, texts come in small batches, and what a job shuffled is deleted once its result is written."""
        before = {c: self.spark.conf.get(c) for c in (BATCH, CLEANUP)}
        rows = int(before[BATCH])
        self.spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            for c, value in before.items():
                self.spark.conf.set(c, value)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with self.cleaning():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``save`` returned and that nothing reads any more."""
        path, _ = self.paths.pop(id(df))
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, *own: str) -> list[Column]:
    """The input's columns, without those named like a column the operator adds."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in {o.lower() for o in own}]


def counted(ids: DataFrame) -> DataFrame:
    """A saved table of ids, to be broadcast in a join if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def total(df: DataFrame, *what: Column) -> tuple:
    return tuple(df.agg(*what).first())


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Label every vertex of ``edges`` (a, b: long) with the smallest vertex it reaches: (v, component).

    Alternating large-star and small-star rounds; each is two aggregations, and the rounds grow with the logarithm of
    the longest chain. Every round's edges are written to the shared folder. A vertex's neighbours are never
    gathered: only their minimum is, so a star of any size is spread over tasks. Nulls are not vertices; loops vanish.
    """
    edges = scratch.save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: neighbours above the vertex point to its minimum
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large, "large")
        # small star: the vertex and its neighbours below point to their minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(small, "small")
        state = total(new, F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        scratch.drop(large)
        scratch.drop(edges)
        edges = new
        if state == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
        before = state
