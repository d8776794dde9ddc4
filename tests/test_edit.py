import os
import zipfile

import numpy as np
import pytest

from tractlake.errors import ArgumentError
from tractlake.model import Array, Tractogram
from tractlake.sources import edit, files, trx


@pytest.fixture(params=["a.trx", "folder"])
def container(spark, tmp_path, request):
    t = Tractogram.from_lists(spark, [[(0, 0, 0), (1, 0, 0)], [(0, 1, 0)]], dps={"weight": ("float32", [1.0, 2.0])}, dpv={"fa": ("float32", [0.1, 0.2, 0.3])}, groups={"bundle": [0]}, dpg={"bundle": {"color": ("uint8", [[7, 8, 9]])}})
    path = str(tmp_path / request.param)
    files.write_tractogram(t, path)
    return path


def entries(path):
    if os.path.isdir(path):
        return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs}
    return set(zipfile.ZipFile(path).namelist())


def test_overwrite_changes_type_and_keeps_the_rest(container):
    before = entries(container)
    edit.append_dps(container, {"weight": ("uint16", [5, 6])})
    assert entries(container) == before  # kept, as it is there
    edit.append_dps(container, {"weight": ("uint16", [5, 6]), "more": ("float64", [[1, 2], [3, 4]])}, overwrite=True)
    assert entries(container) == before - {"dps/weight.float32"} | {"dps/weight.uint16", "dps/more.2.float64"}
    c = trx.Container(container)
    assert c.array(*c.dps["weight"]).tolist() == [5, 6] and c.array(*c.dps["more"]).tolist() == [[1, 2], [3, 4]]
    assert c.positions().tolist() == [[0, 0, 0], [1, 0, 0], [0, 1, 0]]
    with pytest.raises(ArgumentError, match="expected 2"):
        edit.append_dps(container, {"short": ("float32", [1])})
    with pytest.raises(ArgumentError, match="expected 3"):
        edit.append_dpv(container, {"short": ("float32", [1, 2])})
    assert not any("short" in e for e in entries(container)) and not [f for f in os.listdir(os.path.dirname(container)) if f.startswith(".edit")]


def test_groups_and_their_attributes(container):
    edit.append_groups(container, {"two": [1, 0, 1]}, deflate=True)
    edit.append_dpg(container, "two", {"size": ("uint32", [3])})
    c = trx.Container(container)
    assert c.array(*c.groups["two"]).tolist() == [1, 0, 1] and set(c.dpg) == {"bundle", "two"}
    for bad in ([2], [-1]):
        with pytest.raises(ArgumentError, match="out of range"):
            edit.append_groups(container, {"bad": bad})
    with pytest.raises(ArgumentError, match="does not exist"):
        edit.append_dpg(container, "none", {"x": ("uint8", [1])})
    with pytest.raises(ArgumentError):
        edit.append_groups(container, {"../up": [0]})
    edit.delete_dpg(container, "two", ["size", "unknown"])
    edit.delete_groups(container, ["bundle", "unknown"])
    c = trx.Container(container)
    assert set(c.groups) == {"two"} and c.dpg == {}


def test_delete_and_frames(spark, container):
    n = spark.createDataFrame([(1, 20), (0, 10)], "sl_id long, value int")
    v = spark.createDataFrame([(1, 0, 3.5), (0, 1, 2.5), (0, 0, 1.5)], "sl_id long, v_idx int, value double")
    edit.append_dps(container, {"n": ("int32", n)})
    edit.append_dpv(container, {"v": (Array("float64"), v)})
    edit.delete_dps(container, ["weight", "unknown"])
    edit.delete_dpv(container, ["fa"])
    c = trx.Container(container)
    assert set(c.dps) == {"n"} and set(c.dpv) == {"v"}
    assert c.array(*c.dps["n"]).tolist() == [10, 20] and c.array(*c.dpv["v"]).tolist() == [1.5, 2.5, 3.5]
    edit.delete_dpg(container, "bundle")
    assert trx.Container(container).dpg == {}


def test_archive_engine(tmp_path):
    path, new = str(tmp_path / "x.zip"), str(tmp_path / "new")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"1" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("d/b", b"2")
    np.arange(3, dtype="u1").tofile(new)
    before = open(path, "rb").read()
    edit.apply(path, [edit.Put("c", new)])
    assert open(path, "rb").read()[: before.index(b"PK\1\2")] == before[: before.index(b"PK\1\2")]  # appended to
    with pytest.raises(ArgumentError, match="exists"):
        edit.apply(path, [edit.Put("c", new, fresh=True)])
    with pytest.raises(ArgumentError, match="two changes"):
        edit.apply(path, [edit.Put("e", new), edit.Put("e", new)])
    broken = open(path, "rb").read()
    with pytest.raises(FileNotFoundError):
        edit.apply(path, [edit.Put("f", new), edit.Put("g", new + "none")])
    assert open(path, "rb").read() == broken
    edit.apply(path, [edit.Delete("d/"), edit.Delete("unknown"), edit.Put("a2", new, deflate=True)])
    with zipfile.ZipFile(path) as z:
        assert set(z.namelist()) == {"a", "c", "a2"} and z.read("a") == b"1" * 1000 and z.getinfo("a").compress_type == zipfile.ZIP_DEFLATED
    edit.apply(path, [])
