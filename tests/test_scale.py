"""What larger tables showed: work that grew faster than the input, or met in one place."""

import numpy as np
import pytest

from tractlake.operators import near


def test_near_tests_are_done_on_whole_arrays():
    """The same voxels and distances as by loops; a line without a number has cells too; known voxels are used."""
    rng = np.random.default_rng(5)
    lines = [(rng.normal(size=(n, 3)) * 3).astype(np.float32) for n in (0, 1, 2, 9, 60)]
    size = np.float32(0.7)
    for points in lines:
        want = {tuple(np.floor(p / size).astype(int).tolist()) for p in points[:1]}
        for a, b in zip(points[:-1], points[1:], strict=True):
            n = max(1, int(np.ceil(np.sqrt(((b - a) * (b - a)).sum(dtype=np.float32)) / (size * np.float32(0.5)))))
            want |= {tuple(np.floor((a + (b - a) * (np.float32(k) / np.float32(n))) / size).astype(int).tolist()) for k in range(1, n + 1)}
        assert near.voxels(points, size) == want
    assert near.voxels(np.array([[0, 0, 0], [np.nan, 0, 0], [1, 1, 1]], np.float32), size)

    def far(p, line):
        parts = [np.linalg.norm(p - a - (b - a) * np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)) for a, b in zip(line[:-1].astype(float), line[1:].astype(float), strict=True)]
        return min(parts) if parts else np.linalg.norm(p - line[0])

    for points in lines[1:]:
        for line in lines[1:]:
            most = max(far(p, line) for p in points.astype(float))
            assert near.within(points, line, most + 1e-3) and (most < 1e-2 or not near.within(points, line, most - 1e-3))
    params = near.NearParams(0.5, 1.0, 0.5)
    assert near.matches(lines[3], lines[3], params, {(0, 0, 0)}, {(0, 0, 0)}) and not near.matches(lines[3], lines[3], params, {(0, 0, 0)}, {(0, 0, 1)})


@pytest.mark.parametrize("edges", [0, 30, 1_000])
def test_the_last_edges_are_decided_at_once(spark, monkeypatch, edges):
    """A chain of 12 takes a round for two of its ends, or one task; other ids are drawn."""
    monkeypatch.setattr(near, "EDGES", edges)
    rounds = []
    monkeypatch.setattr(near, "saved", lambda df, f=near.saved: rounds.append(1) or f(df))
    rng = np.random.default_rng(2)
    pairs = {(i, i + 1) for i in range(12)} | {(int(a), int(b)) for a, b in rng.integers(13, 40, (60, 2)) if a < b}
    kept: set = set()
    for v in range(40):
        if not any((u, v) in pairs for u in kept):
            kept.add(v)
    out = near.first_independent(spark.range(40).withColumnRenamed("id", "sl_id"), spark.createDataFrame(sorted(pairs), "lo bigint, hi bigint"))
    assert sorted(r[0] for r in out.collect()) == sorted(kept)
    assert edges < 1_000 or len(rounds) == 5


def lines_of(spark, n=1_000):
    """Streamlines of 0 to 4 points with an attribute of each kind, a group and a wide attribute."""
    from tractlake.model import Array, Tractogram

    from pyspark.sql import functions as F

    rows = spark.range(n, numPartitions=7).withColumnRenamed("id", "sl_id")
    points = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct(*((F.col("sl_id") + k * m).cast("float").alias(a) for m, a in enumerate("xyz"))))
    rows = rows.withColumn("points", F.slice(points, 1, (F.col("sl_id") % 5).cast("int")))
    rows = rows.withColumns({"dps_w": F.col("sl_id").cast("float"), "dps_big": F.col("sl_id").cast("decimal(20,0)"), "dpv_fa": F.transform("points", lambda p: p["x"])})
    members = spark.range(0, n, 3).select(F.lit("third").alias("grp"), (F.col("id") / 3).cast("int").alias("ord"), F.col("id").alias("sl_id"))
    return Tractogram.of(rows, dps={"w": Array("float32"), "big": Array("uint64")}, dpv={"fa": Array("float32")}, groups=members)


@pytest.fixture
def driver_streams_nothing(monkeypatch):
    from tractlake.sources import trx

    def refuse(*a, **b):
        raise AssertionError("rows stream through the driver")

    monkeypatch.setattr(trx, "arrow_in_order", refuse)


@pytest.mark.parametrize("name", ["a.trx", "a", "a.tck", "a.tck.gz", "a.vtk"])
def test_tasks_write_files(spark, tmp_path, driver_streams_nothing, name):
    """F2 to F8, F12 to F18, F20, F21: no row goes to the driver, and the file is whole."""
    from tractlake.sources import files

    t, path = lines_of(spark), str(tmp_path / name)
    files.write_tractogram(t, path, files.Options(compress_groups=True))
    assert [p.name for p in tmp_path.iterdir()] == [name]  # no part is left
    back = files.load(spark, path)
    got = {r[0]: [tuple(p) for p in r[1]] for r in back.streamlines.select("sl_id", "points").collect()}
    assert got == {i: [(float(i), float(i + k), float(i + 2 * k)) for k in range(1, i % 5 + 1)] for i in range(1_000)}
    if name in ("a.trx", "a"):
        values = {r[0]: tuple(r[1:]) for r in back.streamlines.select("sl_id", "dps_w", "dps_big", "dpv_fa").collect()}
        assert values == {i: (float(i), i, [float(i)] * (i % 5)) for i in range(1_000)}
        assert [tuple(r) for r in back.groups.orderBy("ord").collect()] == [("third", k, i) for k, i in enumerate(range(0, 1_000, 3))]


@pytest.mark.parametrize("name", ["a.trx", "a"])
def test_tasks_write_edits(spark, tmp_path, driver_streams_nothing, name):
    """F9 to F11: arrays of frames are put in without their rows going to the driver."""
    from pyspark.sql import functions as F

    from tractlake.errors import ArgumentError
    from tractlake.sources import edit, files, trx

    t, path = lines_of(spark), str(tmp_path / name)
    files.write_tractogram(t, path)
    ids = t.streamlines.select("sl_id")
    edit.append_dps(path, {"thrice": ("int64", ids.select("sl_id", (F.col("sl_id") * 3).alias("value")))})
    edit.append_groups(path, {"back": ids.select((-F.col("sl_id")).alias("ord"), F.col("sl_id").alias("value"))})
    with pytest.raises(ArgumentError, match="expected 1000"):
        edit.append_dps(path, {"short": ("int64", ids.where("sl_id > 5").withColumn("value", F.col("sl_id")))})
    with pytest.raises(ArgumentError, match="member 1000 is out of range"):
        edit.append_groups(path, {"bad": spark.createDataFrame([(0, 1000)], "ord long, value long")})
    c = trx.Container(path)
    assert c.array(*c.dps["thrice"]).tolist() == [3 * i for i in range(1_000)] and c.array(*c.groups["back"]).tolist() == [*range(999, -1, -1)]
    assert [p.name for p in tmp_path.iterdir()] == [name]


def test_a_task_reads_its_slice_of_offsets(spark, tmp_path, monkeypatch):
    """Groups and streamlines are split, empty streamlines too; a task does not look at all offsets."""
    from tractlake.sources import datasource, files, trx

    path = str(tmp_path / "a.trx")
    files.write_tractogram(lines_of(spark), path)
    monkeypatch.setattr(datasource, "SPLIT", 100)
    reader = datasource.TractReader("trx", {"path": path})
    ranges = reader.partitions()
    monkeypatch.setattr(trx.Container, "n_streamlines", lambda self: pytest.fail("a task checks all offsets"))
    got = [x for p in ranges for batch in reader.read(p) for x in zip(batch.column(0).to_pylist(), map(len, batch.column(1).to_pylist()), strict=True)]
    assert got == [(i, i % 5) for i in range(1_000)] and len(ranges) >= 20
    groups = datasource.TractReader("trx", {"path": path, "table": "groups"})
    parts = groups.partitions()
    assert [i for p in parts for batch in groups.read(p) for i in batch.column(2).to_pylist()] == [*range(0, 1_000, 3)] and len(parts) == 4


def test_rows_stream_where_no_folder_is_shared(spark, tmp_path, monkeypatch):
    from tractlake.sources import files, parts

    monkeypatch.setattr(parts, "folder_of", lambda spark, path, f=parts.folder_of: _unshared(f(spark, path)))
    for name in ("a.trx", "a.vtk"):
        files.write_tractogram(lines_of(spark, 50), str(tmp_path / name))
        assert files.load(spark, str(tmp_path / name)).nb_vertices == 100


def _unshared(opened):
    from contextlib import contextmanager

    from tractlake.sources.parts import Folder

    @contextmanager
    def own():
        with opened as folder:
            yield Folder(folder.path, False)

    return own()


def test_texts_are_read_in_pieces(tmp_path, monkeypatch):
    """what is held at once does not grow with a file; pieces of any size give the same lines."""
    import tracemalloc

    from tractlake.sources import datasource, tck, vtk

    lines = [np.full((n % 4, 3), n, np.float32) for n in range(300)]
    tck.write(str(tmp_path / "a.tck"), 300, lines)
    vtk.write(str(tmp_path / "a.vtk"), 300, sum(map(len, lines)), lines)
    for size in (5, 300, 1 << 20):
        monkeypatch.setattr(vtk, "READ_BYTES", size)
        monkeypatch.setattr(vtk, "FETCH", 0)
        with open(tmp_path / "a.tck", "rb") as f, open(tmp_path / "a.vtk", "rb") as g:
            for found in (list(tck.pieces(f, size)), list(vtk.pieces(g))):
                assert np.concatenate([p for p, _ in found]).tolist() == np.concatenate(lines).tolist()
                assert np.concatenate([np.diff(o) for _, o in found]).tolist() == [len(x) for x in lines]
    monkeypatch.undo()
    many = [np.zeros((50, 3), np.float32)] * 20_000
    tck.write(str(tmp_path / "b.tck"), 20_000, many)
    monkeypatch.setattr(tck, "ROWS", 1 << 14)
    count = lambda name: sum(b.num_rows for b in datasource.TractReader("tck", {"path": str(tmp_path / name)}).read(datasource.Range(0, 0)))
    assert count("a.tck") == 300  # what is imported on the way is not counted
    tracemalloc.start()
    try:
        assert count("b.tck") == 20_000
        assert tracemalloc.get_traced_memory()[1] < 5_000_000  # of 12 MB of points
    finally:
        tracemalloc.stop()


def test_pairs_of_one_cell_are_dealt_out(spark, monkeypatch):
    """all lines of one cell; each pair once, and no task has more than the pairs of a few blocks."""
    from pyspark.sql import functions as F

    from tractlake.model import Tractogram

    monkeypatch.setattr(near, "CROWDED", 10)
    monkeypatch.setattr(near, "BLOCK", 8)
    t = Tractogram.from_lists(spark, [[(0.1 + i / 1000, 0.1, 0.1), (0.5, 0.5, 0.5)] for i in range(80)])
    pairs = near.candidates(near.described(near.oriented(t), near.NearParams()))
    got = pairs.select("a_sl_id", "b_sl_id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r[0], r[1]) for r in got) == [(i, j) for i in range(80) for j in range(i + 1, 80)]
    sizes = [sum(r["task"] == k for r in got) for k in {r["task"] for r in got}]
    assert len(sizes) >= 20 and max(sizes) <= len(got) / 5


def test_groups_of_files_that_have_none_need_no_parsing(tmp_path, monkeypatch):
    """whole files were parsed in a task to learn that they have no groups."""
    from tractlake.sources import datasource, tck

    path = str(tmp_path / "a.tck")
    tck.write(path, 2, [np.zeros((2, 3), np.float32), np.ones((1, 3), np.float32)])
    monkeypatch.setattr(datasource, "parse", lambda *a: pytest.fail("a file is parsed whole"))
    found = {name: list(datasource.TractReader("tck", {"path": path, "table": name}).read(datasource.Range(0, 0))) for name in ("groups", "group_names", "dpg", "header")}
    assert [found[k] for k in ("groups", "group_names", "dpg")] == [[], [], []] and found["header"][0][2:4] == (2, 3)
