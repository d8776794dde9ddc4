"""Removal of near duplicates.

Kept are, in order of ids, the streamlines that match no kept one before them: the lexicographically first maximal
independent set of the graph of matches. Candidates share grid cells at both ends, up to one cell's difference; cheap
tests on lengths, boxes and ends run in the JVM, exact ones on voxels and segments in Arrow batches of pairs.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError
from tractlake.functions import geometry as G
from tractlake.model import Tractogram
from tractlake.operators.setops import _ids, representatives
from tractlake.operators.subset import subset
from tractlake.shipping import ship

#: Rows of a cell beyond which it is split by where its rows end.
CROWDED = 1_000
#: Rows of a block of either side whose pairs one task makes at a time, and tasks at most.
BLOCK, TASKS = 2_000, 50_000
#: A cell itself, and half of its neighbours: those that come later in order.
HALF = [d for d in itertools.product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]
#: Points that are tested first, point-to-segment distances at a time, and voxels that a task remembers.
FIRST_POINTS, DISTANCES, KNOWN_CELLS = 8, 1 << 18, 5_000_000
#: Pairs of which a task makes the exact tests, about.
PAIRS = 5_000
#: Edges that one task can decide by itself.
EDGES = 2_000_000
ORIENTED = "sl_id bigint, points array<struct<x:float,y:float,z:float>>"


@dataclass(frozen=True)
class NearParams:
    tolerance: float = 0.5
    end_tolerance: float = 1.0
    shared_voxels: float = 1.0


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = found or (jdir.get() if jdir.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ArgumentError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tractlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/near-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def oriented(t: Tractogram) -> DataFrame:
    """sl_id and points in single precision, in the direction that sorts first."""
    points = F.transform("points", lambda p: F.struct(*(p[a].cast("float").alias(a) for a in G.AXES)))
    return t.streamlines.select("sl_id", G.canonical(points).alias("points"))


def described(rows: DataFrame, params: NearParams) -> DataFrame:
    """With length, box (zeros if empty), ends and the ends' cells."""
    size = max(params.end_tolerance, 1e-3)
    p = F.col("points")
    zero = F.struct(*(F.lit(0.0).cast("float").alias(a) for a in G.AXES))
    out = rows.withColumns({"len": G.length32(p), "first": F.coalesce(G.first_point(p), zero), "last": F.coalesce(G.last_point(p), zero)})
    boxes = {c: F.when(F.size("points") == 0, F.lit(0.0).cast("float")).otherwise(b) for c, b in zip([f"{a}_{m}" for m in ("min", "max") for a in G.AXES], G.box(p), strict=True)}
    out = out.withColumns(boxes)
    return out.withColumns({f"{e}_{a}": G.cell(F.col(f"{e}.{a}"), size) for e in ("first", "last") for a in G.AXES})


def _grown_apart(a: str, b: str) -> Column:
    return F.abs(F.col(a).cast("bigint") - F.col(b)) <= 1


def candidates(rows: DataFrame, passes: Column | None = None) -> DataFrame:
    """Pairs of ids (a_sl_id < b_sl_id) of described rows whose end cells differ by one at most, and that ``passes``.

    A row meets the 13 cells of a half space around its first cell, and those of its own cell with a larger id, so each
    pair is met once. Cells with more than CROWDED rows are split by the cells of the last end, two by two. What then
    still meets in very many pairs is dealt out by blocks of BLOCK rows of either side, so that no task has more than its
    share, whatever its rows weigh. Only descriptors travel: points are fetched for the pairs that are left. ``passes`` is
    on columns a_* and b_*, either way round.
    """
    own = saved(rows.drop("points"))
    cell = [f"c_{a}" for a in G.AXES]
    placed = own.withColumns({c: F.col(f"first_{a}").cast("bigint") for c, a in zip(cell, G.AXES, strict=True)})
    crowded = saved(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select(*cell, F.lit(True).alias("crowded")))
    coarse = lambda value: F.floor(value / 2).cast("bigint")
    both_ways = lambda a: F.array_distinct(F.array(*(coarse(F.col(f"last_{a}").cast("bigint") + d) for d in (-1, 1))))
    split = lambda keys: F.when(F.col("crowded"), keys).otherwise(F.array(F.lit(0).cast("bigint")))

    half = F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip("xyz", d, strict=True))) for d in HALF))
    left = own.withColumn("d", F.explode(half))
    left = left.withColumns({c: F.col(f"first_{a}").cast("bigint") + F.col(f"d.{a}") for c, a in zip(cell, G.AXES, strict=True)}).join(crowded, cell, "left")
    right = placed.join(crowded, cell, "left")
    for a in G.AXES:
        left = left.withColumn(f"k_{a}", F.explode(split(both_ways(a))))
        right = right.withColumn(f"k_{a}", F.get(split(F.array(coarse(F.col(f"last_{a}").cast("bigint")))), F.lit(0)))
    keys = [*cell, *(f"k_{a}" for a in G.AXES)]
    meeting = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr")), keys)
    meeting = saved(meeting.select(*keys, (F.col("nl") * F.col("nr")).alias("pairs"), *(F.ceil(F.col(n) / BLOCK).cast("int").alias(b) for n, b in (("nl", "blocks_l"), ("nr", "blocks_r")))))
    met = meeting.agg(F.sum(F.col("pairs").cast("double"))).first()[0] or 0
    tasks = int(min(max(met // BLOCK**2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), TASKS))
    many = meeting.where("blocks_l * blocks_r > 1").drop("pairs")
    # each row is in one block of its side, and meets all of the other's
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    one = lambda n: F.pmod(F.xxhash64("sl_id"), F.coalesce(n, F.lit(1))).cast("int")
    left = left.join(many, keys, "left").withColumns({"block_l": one(F.col("blocks_l")), "block_r": every(F.col("blocks_r"))})
    right = right.join(many, keys, "left").withColumns({"block_r": one(F.col("blocks_r")), "block_l": every(F.col("blocks_l"))})
    keys += ["block_l", "block_r"]
    # by number, as Spark would put small rows into few tasks, however many pairs they make
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    side = lambda df, s, more: df.select(*keys, *more, *(F.col(c).alias(f"{s}_{c}") for c in own.columns))
    same = (F.col("d.x") == 0) & (F.col("d.y") == 0) & (F.col("d.z") == 0)
    near = F.col("same_cell") & (F.col("a_sl_id") < F.col("b_sl_id")) | ~F.col("same_cell")
    for a in G.AXES:
        near = near & _grown_apart(f"a_last_{a}", f"b_last_{a}")
    a_side, b_side = side(left, "a", [same.alias("same_cell")]), side(right, "b", [])
    on = near if passes is None else near & passes
    for k in keys:
        on = on & (a_side[k] == b_side[k])
    pairs = a_side.join(b_side, on)
    return pairs.select(F.least("a_sl_id", "b_sl_id").alias("a_sl_id"), F.greatest("a_sl_id", "b_sl_id").alias("b_sl_id"))


def cheap(params: NearParams) -> Column:
    """Whether lengths are compatible, boxes meet when grown, and ends are close together, in this order."""
    short, long_ = F.least("a_len", "b_len"), F.greatest("a_len", "b_len")
    slack = (short * G.f32(0.1) + G.f32(2 * params.end_tolerance) + G.f32(2 * params.tolerance)).cast("float")
    ok = (long_ - short) <= slack
    tol = G.f32(params.tolerance)
    for a in G.AXES:
        ok = ok & ((F.col(f"a_{a}_min") - tol) <= (F.col(f"b_{a}_max") + tol)) & ((F.col(f"b_{a}_min") - tol) <= (F.col(f"a_{a}_max") + tol))
    for e in ("first", "last"):
        ok = ok & (G.distance32(F.col(f"a_{e}"), F.col(f"b_{e}")) <= G.f32(params.end_tolerance))
    return ok


def voxels(points: np.ndarray, size: np.float32) -> set[tuple[int, int, int]]:
    """Cells that a polyline passes, sampled at half a cell."""
    if len(points) == 0:
        return set()
    d = points[1:] - points[:-1]
    with np.errstate(invalid="ignore"):
        steps = np.ceil(np.sqrt((d * d).sum(axis=1, dtype=np.float32)) / (size * np.float32(0.5)))
    if np.isinf(steps).any():
        raise ArgumentError("a segment without end has no cells")
    steps = np.maximum(1, np.nan_to_num(steps)).astype(np.int64)
    segment = np.repeat(np.arange(len(d)), steps)
    place = np.arange(1, len(segment) + 1) - np.repeat(np.cumsum(steps) - steps, steps)
    share = place.astype(np.float32) / steps.astype(np.float32)[segment]
    sampled = np.concatenate([points[:1], points[segment] + d[segment] * share[:, None]])
    with np.errstate(invalid="ignore"):
        cells = np.clip(np.nan_to_num(np.floor(sampled / size)), G.INT_MIN, G.INT_MAX).astype(np.int64)
    return set(map(tuple, cells.tolist()))


def within(points: np.ndarray, line: np.ndarray, tolerance: float) -> bool:
    """Whether every point lies near a segment of the line, or near its point if it has no segment."""
    if len(points) == 0:
        return True
    if len(line) == 0:
        return False
    limit = np.float32(tolerance) * np.float32(tolerance)
    if len(line) == 1:
        d = points - line[0]
        return bool(((d * d).sum(axis=1) <= limit).all())
    start, d = line[:-1].T, (line[1:] - line[:-1]).T
    squared = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    short = squared <= np.float32(1e-12)
    safe = np.where(short, np.float32(1), squared)
    lo, n = 0, FIRST_POINTS
    while lo < len(points):  # few points at first, as most pairs fail early; never more than a bounded table
        p = points[lo : lo + n].T[:, :, None]
        along = np.clip(((p[0] - start[0]) * d[0] + (p[1] - start[1]) * d[1] + (p[2] - start[2]) * d[2]) / safe, 0, 1)
        along[:, short] = 0
        off = [p[i] - (start[i] + d[i] * along) for i in range(3)]
        if not (off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= limit).any(axis=1).all():
            return False
        lo, n = lo + n, max(1, min(4 * n, DISTANCES // len(squared)))
    return True


def matches(a: np.ndarray, b: np.ndarray, params: NearParams, va: set | None = None, vb: set | None = None) -> bool:
    """The exact tests: enough shared voxels, and each line's points near the other. va, vb: their voxels, where known."""
    size = np.float32(max(params.tolerance, 1e-3))
    va, vb = voxels(a, size) if va is None else va, voxels(b, size) if vb is None else vb
    if va and vb and len(va & vb) / min(len(va), len(vb)) < np.float32(params.shared_voxels):
        return False
    if bool(va) != bool(vb):
        return False
    return within(a, b, params.tolerance) and within(b, a, params.tolerance)


def edges(rows: DataFrame, params: NearParams) -> DataFrame:
    """Matching pairs (lo, hi)."""
    ship(rows.sparkSession)
    size = np.float32(max(params.tolerance, 1e-3))

    def lines(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        points = column.flatten()
        flat = np.column_stack([points.field(x).to_numpy(zero_copy_only=False) for x in G.AXES]).astype(np.float32)
        return flat, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])

    def run(batches):
        known: dict[int, set] = {}  # a line is in many pairs
        held = 0

        def cells(i: int, points: np.ndarray) -> set:
            nonlocal held
            if i not in known:
                if held > KNOWN_CELLS:
                    known.clear()
                    held = 0
                known[i] = voxels(points, size)
                held += len(known[i])
            return known[i]

        for batch in batches:
            keep = []
            (a, at), (b, bt) = lines(batch.column(2)), lines(batch.column(3))
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                p, q = a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]
                if matches(p, q, params, cells(x, p), cells(y, q)):
                    keep.append(i)
            out = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(out.columns, ["lo", "hi"])

    # kept as a table, to be counted and then dealt out by blocks of either end: tasks are even, and each knows few lines
    pairs = saved(candidates(described(rows, params), cheap(params)))
    side = max(1, min(int(np.ceil(np.sqrt(pairs.count() / PAIRS))), 300))
    points = lambda k: rows.select(F.col("sl_id").alias(f"{k}_sl_id"), F.col("points").alias(f"{k}_points"))
    block = F.pmod(F.xxhash64("a_sl_id"), F.lit(side)) * side + F.pmod(F.xxhash64("b_sl_id"), F.lit(side))
    given = pairs.join(points("a"), "a_sl_id").join(points("b"), "b_sl_id").select("a_sl_id", "b_sl_id", "a_points", "b_points")
    return given.repartitionById(side * side, block.cast("int")).mapInArrow(run, "lo bigint, hi bigint")


def first_independent(ids: DataFrame, edges_: DataFrame) -> DataFrame:
    """The lexicographically first maximal independent set: an id stays if no smaller neighbour stays.

    In rounds: ids whose smaller neighbours are all out stay, larger neighbours of those that stay go. The smallest id
    left is decided in every round, most often a large share of them. One task decides the last EDGES edges in their order.
    """
    left = saved(edges_.distinct())
    kept = ids.join(left.select(F.col("hi").alias("sl_id")).distinct(), "sl_id", "left_anti")  # no smaller neighbour at all
    frontier = saved(kept)
    decided = [frontier]
    while n := left.count():
        gone = saved(left.join(frontier, left["lo"] == frontier["sl_id"]).select(F.col("hi").alias("sl_id")).distinct())
        was = left.select("hi").distinct()
        rest = left.join(gone, left["hi"] == gone["sl_id"], "left_anti").join(gone.withColumnRenamed("sl_id", "g"), F.col("lo") == F.col("g"), "left_anti")
        # what stays is final: an edge from it has either gone with its larger end or leads to one that goes
        rest = saved(rest)
        undecided = was.join(gone, was["hi"] == gone["sl_id"], "left_anti").select(F.col("hi").alias("sl_id"))
        if n <= EDGES:
            decided.append(saved(_in_order(undecided, rest)))
            break
        frontier = saved(undecided.join(rest.select(F.col("hi").alias("sl_id")).distinct(), "sl_id", "left_anti"))
        decided.append(frontier)
        left = rest
    return reduce(DataFrame.union, decided)


def _in_order(undecided: DataFrame, edges_: DataFrame) -> DataFrame:
    """Of undecided ids, those that stay, decided by one task in order of ids. Both ends of the edges are undecided."""

    def run(batches):
        stays, last, free = set(), None, False  # free: no smaller neighbour of the last id stays
        for batch in batches:
            out = []
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hi != last:
                    last, free = hi, True
                free = free and lo not in stays
                if lo == hi and free:  # an id's own row is its last
                    stays.add(hi)
                    out.append(hi)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["sl_id"])

    own = undecided.select(F.col("sl_id").alias("lo"), F.col("sl_id").alias("hi"))
    return edges_.select("lo", "hi").union(own).repartition(1).sortWithinPartitions("hi", "lo").mapInArrow(run, "sl_id bigint")


def remove_near_duplicates(t: Tractogram, params: NearParams | None = None) -> Tractogram:
    """Exact duplicates go first, then near ones; what stays keeps its attributes."""
    params = params or NearParams()
    ids = saved(representatives(t))
    rows = saved(oriented(t).join(ids, "sl_id", "left_semi"))
    return subset(t, _ids(first_independent(ids, edges(rows, params))), check=False)
