"""Building a tractogram from a stream of polylines.

Each micro-batch is written to a folder of its own, named after its id, so that a batch that is retried replaces itself;
ids are given when the tractogram is read back, from the counts of the batches before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.model import Header, Tractogram, points_type
from tractlake.operators.numbering import renumbered


class StreamBuilder:
    """Appends batches of rows with a column ``points`` under a path; ``finalize`` reads them as one tractogram."""

    def __init__(self, spark: SparkSession, path: str, header: Header | None = None, dtype: str = "float32"):
        self.spark, self.path, self.header, self.dtype = spark, path.rstrip("/"), header or Header(), dtype

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """The function for foreachBatch: exactly once, as a retry overwrites its folder."""
        rows = batch.select(F.col("points").cast(points_type(self.dtype)))
        rows.select(F.monotonically_increasing_id().alias("place"), "points").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run the stream into the builder."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def push(self, lines: list) -> None:
        """Append a few polylines as a batch of their own."""
        rows = self.spark.createDataFrame([([tuple(map(float, p)) for p in line],) for line in lines], f"points {points_type(self.dtype)}")
        self.append(rows.coalesce(1), self._next())

    def _next(self) -> int:
        try:
            found = self.spark.read.parquet(self.path).agg(F.max("batch")).first()[0]
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return 0
        return 0 if found is None else int(found) + 1

    def finalize(self) -> Tractogram:
        """All batches in order as one tractogram."""
        rows = self.spark.read.parquet(self.path)
        counts = rows.groupBy("batch").count().orderBy("batch").collect()  # a row for each batch
        base, bases = 0, []
        for b, n in counts:
            bases.append((b, base))
            base += n
        placed = rows.join(F.broadcast(self.spark.createDataFrame(bases, "batch int, base bigint")), "batch")
        # places in a batch rise with partitions but have gaps: numbered in order of (batch, place)
        partition, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = placed.groupBy("batch", partition.alias("part")).agg(F.max(row).alias("m")).collect()
        starts, at, last = [], 0, None
        for b, p, m in sorted(sizes):
            at = 0 if b != last else at
            starts.append((b, p, at))
            at, last = at + m + 1, b
        starts = self.spark.createDataFrame(starts, "batch int, part bigint, start bigint")
        out = placed.withColumns({"part": partition, "row": row}).join(F.broadcast(starts), ["batch", "part"])
        out = out.select((F.col("base") + F.col("start") + F.col("row")).alias("__o"), "points")
        return Tractogram.of(renumbered(out, "__o", "sl_id").select("sl_id", "points"), self.header, self.dtype)


def polylines(events: DataFrame, gap: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Polylines from a stream of events (user_id, ts, x, y, z): a session of a user is a streamline, its points in order."""
    sessions = events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap))
    points = sessions.agg(F.array_sort(F.collect_list(F.struct("ts", "x", "y", "z"))).alias("p"))
    return points.select("user_id", F.transform("p", lambda v: F.struct(v["x"].cast("float").alias("x"), v["y"].cast("float").alias("y"), v["z"].cast("float").alias("z"))).alias("points"))
