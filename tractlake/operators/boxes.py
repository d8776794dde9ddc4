"""Bounding boxes of streamlines and queries by box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.functions import geometry as G
from tractlake.model import Tractogram


def build(t: Tractogram) -> DataFrame:
    """sl_id and six columns. NaN is skipped; an empty streamline gives (+inf, -inf), which meets no finite box."""
    return t.streamlines.select("sl_id", *G.box(F.col("points")))


def query(boxes: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Ids whose box meets the closed box, compared in single precision. Six comparisons that reach a Parquet scan."""
    return boxes.where(G.overlaps(low, high)).select("sl_id")


#: Query boxes that are broadcast at most; beyond, both sides meet by cells.
FEW = 10_000
#: Smallest cell of the grid along x, and how often cells double: the last ones are wider than any coordinate.
CELL, LEVELS = 1.0, 40


def query_many(boxes: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, sl_id) of all boxes that meet each of the query boxes (q, x_lo .. z_hi), in one job.

    A list counted as short is broadcast; a longer one is joined by cells along x. A query without a number meets nothing.
    """
    meets = F.lit(True)
    for a in G.AXES:
        meets = meets & (F.col(f"{a}_min") <= F.col(f"{a}_hi")) & (F.col(f"{a}_max") >= F.col(f"{a}_lo"))
    if queries.count() <= FEW:
        return boxes.join(F.broadcast(queries), meets).select("q", "sl_id")
    left, right = _celled(boxes, "x_min", "x_max", "a"), _celled(queries, "x_lo", "x_hi", "b")
    on = meets & (left["a_level"] == right["b_level"]) & (left["a_cell"] == right["b_cell"]) & (F.greatest("a_own", "b_own") == F.col("a_level"))
    # a pair may share two cells: it counts in the one where the later of both begins
    begins = F.greatest("a_from", "b_from")
    return left.join(right, on & (F.col("a_cell") == begins)).select("q", "sl_id")


def _celled(df: DataFrame, low: str, high: str, side: str) -> DataFrame:
    """Rows for the one or two cells of an interval, on its own level (cells at least as wide as it is) and all above."""
    far = CELL * float(1 << (LEVELS - 2))
    at = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(-far)), F.lit(far))
    own = F.least(F.greatest(F.ceil(F.log2(F.greatest((at(high) - at(low)) / CELL, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    cell = lambda c: F.floor(at(c) / (F.lit(CELL) * F.pow(F.lit(2.0), F.col(f"{side}_level")))).cast("bigint")
    out = df.where(F.col(low) <= F.col(high)).withColumn(f"{side}_own", own).withColumn(f"{side}_level", F.explode(F.sequence(f"{side}_own", F.lit(LEVELS - 1))))
    return out.withColumn(f"{side}_from", cell(low)).withColumn(f"{side}_cell", F.explode(F.sequence(F.col(f"{side}_from"), cell(high))))


def stored(boxes: DataFrame, path: str, cell: float = 10.0) -> DataFrame:
    """Boxes on disk, near ones together, so that a query's comparisons prune row groups by their statistics."""
    centre = [((F.col(f"{a}_min") + F.col(f"{a}_max")) / 2) for a in G.AXES]
    cells = [G.cell(F.when(F.abs(c) < 1e9, c).otherwise(0.0), cell) + 512 for c in centre]
    morton = F.lit(0).cast("bigint")
    for bit in range(10):
        for i, c in enumerate(cells):
            morton = morton + F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)).cast("bigint"), 3 * bit + i)
    boxes.withColumn("__m", morton).repartitionByRange("__m").sortWithinPartitions("__m").drop("__m").write.mode("overwrite").parquet(path)
    return boxes.sparkSession.read.parquet(path)
