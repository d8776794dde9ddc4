import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractlake.errors import ArgumentError, DTypeError, MissingName
from tractlake.functions import geometry as G
from tractlake.model import Header, Tractogram
from tractlake.operators import boxes, checks, concat, metadata, near, setops, subset
from tractlake.operators.cast import cast_positions
from tractlake.operators.connectivity import connectivity


def lines(t):
    return [[tuple(p) for p in r["points"]] for r in t.streamlines.orderBy("sl_id").collect()]


def members(t):
    return {r["grp"]: list(r["members"]) for r in t.group_lists().collect()}


@pytest.fixture(scope="module")
def three(spark):
    return Tractogram.from_lists(spark, [[(0, 0, 0), (1, 1, 1)], [(10, 10, 10), (11, 11, 11), (12, 12, 12)], [(20, 20, 20)]], dps={"w": ("float32", [1.0, 2.0, 3.0]), "big": ("int64", [1, 2, 3])}, dpv={"fa": ("float32", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])}, groups={"a": [0, 1], "b": [2], "none": []}, dpg={"a": {"color": ("uint8", [[1, 2, 3]])}, "b": {"color": ("uint8", [[4, 5, 6]])}})


def test_counts_and_accessors(three):
    assert tuple(three.counts().first()) == (3, 6)
    assert [r["off"] for r in three.offsets().orderBy("sl_id").collect()] == [0, 2, 5]
    assert three.vertices().count() == 6
    assert [r["value"] for r in three.scalar_dps("w").orderBy("sl_id").collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(DTypeError):
        three.scalar_dps("big")
    with pytest.raises(MissingName):
        three.dps_column("nothing")
    with pytest.raises(MissingName):
        three.group("nothing")
    assert three.names("groups") == ["a", "b", "none"]


def test_subset_order_repeats_and_groups(three):
    out = subset.subset(three, [2, 0, 0])
    assert [len(x) for x in lines(out)] == [1, 2, 2]
    assert [r["dps_w"] for r in out.streamlines.orderBy("sl_id").collect()] == [3.0, 1.0, 1.0]
    assert members(out) == {"a": [2], "b": [0], "none": []}  # a repeat follows its last copy
    out = subset.subset(three, [1])
    assert members(out) == {"a": [0], "b": [], "none": []}
    assert [r["grp"] for r in out.dpg.collect()] == ["a"]
    assert sorted(members(subset.subset(three, [1], drop_empty=True))) == ["a"]
    with pytest.raises(ArgumentError):
        subset.subset(three, [7])


def test_selection(three):
    assert sorted(r[0] for r in subset.in_groups(three, ["a", "b"]).collect()) == [0, 1, 2]
    with pytest.raises(MissingName):
        subset.in_groups(three, ["x"])
    pick = lambda: sorted(r["old_id"] for r in subset.choose(three, n=2, seed=5).collect())
    assert len(pick()) == 2 and pick() == pick()


def test_boxes_with_nan_and_empty(spark, three):
    b = boxes.build(three)
    ids = lambda lo, hi: sorted(r[0] for r in boxes.query(b, lo, hi).collect())
    assert ids([9] * 3, [15] * 3) == [1] and ids([-1] * 3, [25] * 3) == [0, 1, 2]
    odd = boxes.build(Tractogram.from_lists(spark, [[(float("nan"), 0, 0), (2, 5, 5)], []])).orderBy("sl_id").collect()
    assert (odd[0]["x_min"], odd[0]["x_max"]) == (2, 2)
    assert odd[1]["x_min"] == float("inf") and odd[1]["x_max"] == float("-inf")


def test_stored_boxes_prune(three, tmp_path):
    kept = boxes.stored(boxes.build(three), str(tmp_path / "boxes"))
    assert sorted(r[0] for r in boxes.query(kept, [9] * 3, [15] * 3).collect()) == [1]


def test_set_operations_keep_duplicates_and_negative_zero(spark):
    p, q, z = [(0.0, 0, 0), (1, 0, 0)], [(5, 5, 5)], [(-0.0, 0, 0), (1, 0, 0)]
    a, b = Tractogram.from_lists(spark, [p, p, q, []]), Tractogram.from_lists(spark, [p, z, z])
    assert [len(x) for x in lines(setops.intersection(a, b))] == [2, 2]
    assert lines(setops.difference(a, b)) == [[(5, 5, 5)], []]
    assert tuple(setops.union(a, b).counts().first())[0] == 6  # -0.0 is not 0.0, and repeats stay


def test_exact_duplicates(spark):
    a = [(0, 0, 0), (1, 0, 0)]
    t = Tractogram.from_lists(spark, [a, a[::-1], [(0, 1, 0), (1, 1, 0)]])
    assert sorted(r[0] for r in setops.representatives(t).collect()) == [0, 2]


@pytest.mark.parametrize(
    ("rows", "params", "kept"),
    [
        ([[(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0.1, 0, 0), (1.1, 0, 0), (2.1, 0, 0)], [(0, 1, 0), (1, 1, 0), (2, 1, 0)]], near.NearParams(0.35, 0.5, 0.1), [0, 2]),
        ([[(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0, 0, 0), (1, 0.1, 0), (3, 0, 0)]], near.NearParams(0.35, 0.5, 0.75), [0, 1]),
        ([[(x, 0, 0) for x in range(4)], [(x, 1.5, 0) for x in range(4)]], near.NearParams(0.5, 0.75, 0.8), [0, 1]),
        ([[(0, 0, 0)], [(0.2, 0, 0)], [(9, 9, 9)]], near.NearParams(0.5, 1.0, 0.1), [0, 2]),
    ],
)
def test_near_duplicates(spark, rows, params, kept):
    t = Tractogram.from_lists(spark, rows, dps={"i": ("int32", list(range(len(rows))))})
    assert [r["dps_i"] for r in near.remove_near_duplicates(t, params).streamlines.orderBy("sl_id").collect()] == kept


@pytest.mark.parametrize("crowded", [1, 5, 1000])
def test_near_duplicates_in_crowded_cells(spark, monkeypatch, crowded):
    """Many short lines from few cells, against all pairs and a greedy choice in order of ids."""
    import random

    monkeypatch.setattr(near, "CROWDED", crowded)
    rng = random.Random(crowded)
    params = near.NearParams(0.4, 1.0, 0.3)
    at = lambda: tuple(round(rng.uniform(-1.5, 1.5), 2) for _ in range(3))
    rows = [[at(), at()] for _ in range(60)]
    rows += [[tuple(c + rng.uniform(-0.05, 0.05) for c in p) for p in (reversed(r) if i % 2 else r)] for i, r in enumerate(rows[:40])]
    t = Tractogram.from_lists(spark, rows)
    described = near.described(near.oriented(t), params)
    cells = {r["sl_id"]: [tuple(r[f"{e}_{a}"] for a in "xyz") for e in ("first", "last")] for r in described.collect()}
    close = lambda a, b: all(abs(x - y) <= 1 for x, y in zip(a, b, strict=True))
    want = {(i, j) for i in cells for j in cells if i < j and all(map(close, cells[i], cells[j]))}
    got = [(r["a_sl_id"], r["b_sl_id"]) for r in near.candidates(described).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = {(r["lo"], r["hi"]) for r in near.edges(near.oriented(t), params).collect()}
    assert len(pairs) >= 30
    kept = []
    for i in range(len(rows)):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    out = near.first_independent(t.streamlines.select("sl_id"), near.edges(near.oriented(t), params))
    assert sorted(r[0] for r in out.collect()) == kept


def test_geometry_keys(spark):
    from tractlake.functions import geometry as G

    nan = float("nan")
    rows = [[(0, 0, 0), (1, 2, 3)], [(-0.0, 0, 0), (1, 2, 3)], [(0, -0.0, 0), (1, 2, 3)], [(1, 2, 3), (0, 0, 0)], [(nan, 0, 0)], [(nan, 0, 0)], [], [(1, 2, 3)], [(1, 2, 3), (1, 2, 3)]]
    lines = Tractogram.from_lists(spark, rows).streamlines
    keys = {r[0]: (tuple(r[1]), tuple(r[2])) for r in lines.select("sl_id", G.geometry_key(F.col("points")), G.canonical_key(F.col("points"))).collect()}
    same = lambda k: {(i, j) for i in keys for j in keys if i < j and keys[i][k] == keys[j][k]}
    assert same(0) == {(4, 5)} and same(1) == {(0, 3), (4, 5)}


def test_first_independent_set_equals_greedy(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a < b}
    kept: set = set()
    for v in range(40):
        if not any((u, v) in pairs for u in kept):
            kept.add(v)
    ids = spark.range(40).select(F.col("id").alias("sl_id"))
    out = near.first_independent(ids, spark.createDataFrame(sorted(pairs), "lo bigint, hi bigint"))
    assert {r[0] for r in out.collect()} == kept


def test_concatenate(spark):
    make = lambda group, w="float32": Tractogram.from_lists(spark, [[(1, 2, 3)], [(4, 5, 6), (7, 8, 9)]], Header(dimensions=[10, 20, 30]), dps={"weight": (w, [1.0, 2.0] if w == "float32" else [1, 2])}, groups={group: [1]}, dpg={group: {"c": ("uint8", [1])}})
    out = concat.concatenate([make("left"), make("right")])
    assert members(out) == {"left": [1], "right": [3]} and out.dpg.isEmpty() and tuple(out.counts().first()) == (4, 6)
    assert members(concat.concatenate([make("g"), make("g")])) == {"g": [1, 3]}
    assert sorted(members(concat.concatenate([make("b"), make("b")], ["Prefix", " "]))) == ["Prefixb", "b"]
    bare = Tractogram.from_lists(spark, [[(0, 0, 0)]])
    assert members(concat.concatenate([bare, bare], ["One", "Two"])) == {"One": [0], "Two": [1]}
    with pytest.raises(ArgumentError):
        concat.concatenate([make("a"), bare])
    assert concat.concatenate([make("a"), bare], drop_dps=True).dps == {}
    with pytest.raises(ArgumentError):
        concat.concatenate([make("a"), make("a", "uint16")], drop_dps=True)


def test_copy_metadata(spark, three):
    bare = three.with_(streamlines=three.streamlines.select("sl_id", "points"), dps={}, dpv={}, groups=three.groups.limit(0), group_names=three.group_names.limit(0), dpg=three.dpg.limit(0))
    out = metadata.copy_metadata(bare, three, dpg=True)
    assert sorted(out.dps) == ["big", "w"] and members(out) == members(three) and out.dpg.count() == 2
    assert sorted(metadata.copy_metadata(bare, three, metadata.Selection(dps=["w"])).dpv) == []
    with pytest.raises(ArgumentError, match="DPS 'w'"):
        metadata.copy_metadata(three, three, metadata.Selection(dps=["w"]))
    with pytest.raises(ArgumentError, match="streamline counts differ"):
        metadata.copy_metadata(Tractogram.from_lists(spark, [[(0, 0, 0)]]), three)


def test_copy_metadata_conflicts(spark, three):
    some = metadata.delete(three, dps=["w"], groups=["b"])
    want = [(k, n) for k in ("dps", "dpv", "groups") for n in some.names(k)]
    assert sorted(metadata.conflicts(some, three)) == sorted(want) and {k for k, _ in want} >= {"dps", "groups"}
    assert metadata.conflicts(some, three, metadata.Selection(dps=["w"], groups=["b"])) == []
    with pytest.raises(ArgumentError, match="group 'a'"):
        metadata.copy_metadata(some, three, metadata.Selection(groups=["a"]))


def test_append_and_delete(spark, three):
    from tractlake.model import Array

    with pytest.raises(ArgumentError, match="expected 3"):
        metadata.append_dps(three, "x", three.streamlines.limit(1).select("sl_id", F.lit(1).alias("value")), Array("int32"))
    out = metadata.delete(three, dps=["w", "unknown"], groups=["a"])
    assert sorted(out.dps) == ["big"] and out.names("groups") == ["b", "none"] and out.names("dpg") == ["b"]


def test_connectivity(spark):
    t = Tractogram.from_lists(spark, [[(0, 0, 0)]] * 3, dps={"w": ("float32", [1.0, 10.0, 100.0])}, groups={"a": [0, 1, 9], "b": [1, 2], "c": [2, 2]})
    value = lambda **k: [r["value"] for r in connectivity(t, ["a", "b", "c"], **k).orderBy("entry").collect()]
    assert value() == [2, 2, 0, 2, 4, 4]
    assert value(symmetric=False) == [2, 1, 0, 2, 2, 4]
    assert value(weight="w") == [11, 20, 0, 110, 400, 400]


def test_validate_compare_lengths(spark, three):
    t = Tractogram.from_lists(spark, [[(0, 0, 0), (3, 4, 0)], [(3, 4, 0), (0, 0, 0)], [(50, 0, 0)], []], Header(dimensions=[10, 10, 10]))
    assert tuple(checks.validate(t)[1].first()) == (4, 1, 1, 2)
    assert tuple(checks.length_stats(t).first()) == (0.0, 2.5, 5.0)
    assert all(r["same"] for r in checks.compare(t, t, deep=True).collect())
    with pytest.raises(ArgumentError):
        checks.inverse([[0.0] * 4] * 4)


def test_casts_and_sql_functions(spark):
    t = Tractogram.from_lists(spark, [[(1.1, 0, 0), (4.1, 4, 0)], []])
    assert lines(cast_positions(t, "f16"))[0][0][0] == pytest.approx(float(np.float16(1.1)))
    with pytest.raises(DTypeError):
        cast_positions(t, "int8")
    G.register(spark)
    t.streamlines.createOrReplaceTempView("lines_")
    rows = spark.sql("SELECT tract_length(points) AS l, canonical_key(points) = canonical_key(reverse(points)) AS k FROM lines_ ORDER BY sl_id").collect()
    assert rows[0]["l"] == pytest.approx(5.0) and rows[0]["k"] and rows[1]["l"] == 0.0


def test_stream_builder(spark, tmp_path):
    from tractlake.streaming.builder import StreamBuilder

    source = str(tmp_path / "in")
    spark.createDataFrame([([(0.0, 0.0, 0.0)],), ([(1.0, 1.0, 1.0), (2.0, 2.0, 2.0)],)], "points array<struct<x:float,y:float,z:float>>").write.parquet(source)
    builder = StreamBuilder(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema("points array<struct<x:float,y:float,z:float>>").parquet(source)
    builder.start(stream, str(tmp_path / "check")).awaitTermination(60)
    builder.push([[(5, 5, 5)]])
    out = builder.finalize()
    assert tuple(out.counts().first()) == (3, 4)
    assert [r[0] for r in out.streamlines.select("sl_id").orderBy("sl_id").collect()] == [0, 1, 2]


def test_many_query_boxes_by_cells(spark, monkeypatch):
    """A long list of queries gives what a short one does, wide and degenerate boxes included."""
    import random

    rng = random.Random(3)

    def box():
        low = [rng.uniform(-40, 40) for _ in range(3)]
        return [(a, a + rng.choice([0.0, 0.5, 8.0, 300.0, 1e12])) for a in low]

    some = lambda n, names: spark.createDataFrame([(i, *(float(v) for p in box() for v in p)) for i in range(n)], f"{names[0]} long, " + ", ".join(f"{a}_{e} float" for a in "xyz" for e in names[1:]))
    lines, queries = some(80, ("sl_id", "min", "max")), some(40, ("q", "lo", "hi"))
    empty = spark.createDataFrame([(900, *[float("inf")] * 3, *[float("-inf")] * 3)], "sl_id long, x_min float, y_min float, z_min float, x_max float, y_max float, z_max float")
    lines = lines.unionByName(empty)
    want = sorted(map(tuple, boxes.query_many(lines, queries).collect()))
    monkeypatch.setattr(boxes, "FEW", 0)
    assert sorted(map(tuple, boxes.query_many(lines, queries).collect())) == want and len(want) > 100


def test_shared_folder_must_be_shared(spark, monkeypatch):
    from tractlake.errors import ArgumentError

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    with pytest.raises(ArgumentError, match="share"):
        near.shared_dir(Elsewhere)
