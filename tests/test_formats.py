import gzip
import json
import os
import struct
import zipfile

import numpy as np
import pytest

from tractlake import cli
from tractlake.errors import FormatError
from tractlake.model import Array, Header, Tractogram
from tractlake.sources import files, nifti, tck, trk, trx, tt, vtk

LINES = [[(0.0, 1.0, 2.0)], [(0.0, 1.0, 2.0), (3.0, 4.0, 5.0)], [(v, v + 1, v + 2) for v in (0.0, 3.0, 6.0, 9.0, 12.0)]]


def lines(t):
    return [[tuple(p) for p in r["points"]] for r in t.streamlines.orderBy("sl_id").collect()]


@pytest.fixture(scope="module")
def full(spark):
    return Tractogram.from_lists(spark, [[(0, 0, 0), (1, 0, 0)], [(0, 1, 0), (0, 2, 0), (0, 3, 0)], []], Header(dimensions=[20, 20, 20], extra={"CUSTOM": {"name": "fixture"}}), dps={"weights": ("float32", [1.5, 2.5, 3.5])}, dpv={"fa": ("float16", [0.5, 0.25, 0.5, 0.25, 0.125])}, groups={"bundle": [1], "none": []}, dpg={"bundle": {"color": ("uint8", [[255, 128, 0]])}})


@pytest.mark.parametrize("name", ["x.trx", "folder"])
def test_container_round_trip(spark, full, tmp_path, name):
    path = str(tmp_path / name)
    files.write_tractogram(full, path)
    back = files.load(spark, path)
    assert lines(back) == lines(full) and back.header == full.header and back.dps == full.dps and back.dpv == full.dpv
    assert [r["dps_weights"] for r in back.streamlines.orderBy("sl_id").collect()] == [1.5, 2.5, 3.5]
    assert [list(r["dpv_fa"]) for r in back.streamlines.orderBy("sl_id").collect()] == [[0.5, 0.25], [0.5, 0.25, 0.125], []]
    assert {r["grp"]: list(r["members"]) for r in back.group_lists().collect()} == {"bundle": [1], "none": []}
    assert [list(r["value"]) for r in back.dpg.collect()] == [[255.0, 128.0, 0.0]]
    container = trx.Container(path)
    assert container.core["offsets"] == "offsets.uint32" and "groups/bundle.uint32" == container.groups["bundle"][0]
    files.save_in_place(back.with_(dps={}, streamlines=back.streamlines.drop("dps_weights")), path)
    assert os.path.isfile(path) == (name == "x.trx") and files.load(spark, path).dps == {}


def test_offsets_without_last_and_bad(spark, full, tmp_path):
    path = str(tmp_path / "d")
    files.write_tractogram(full, path)
    np.array([0, 2, 5], "<u8").tofile(f"{path}/offsets.uint64")
    os.remove(f"{path}/offsets.uint32")
    assert [len(x) for x in lines(files.load(spark, path))] == [2, 3, 0]
    np.array([0, 2], "<u8").tofile(f"{path}/offsets.uint64")
    with pytest.raises(FormatError):
        trx.Container(path).offsets()


def test_unsafe_and_odd_names(tmp_path):
    assert trx.parse_name("my.metric.1.float64") == ("my.metric", Array("float64", 1))
    assert trx.parse_name("positions.3.float32") == ("positions", Array("float32", 3))
    for bad in ("noext", "foo.bar"):
        with pytest.raises(FormatError):
            trx.parse_name(bad)
    with zipfile.ZipFile(tmp_path / "bad.trx", "w") as z:
        z.writestr("../evil.float32", b"")
    with pytest.raises(FormatError):
        trx.Container(str(tmp_path / "bad.trx"))


def test_tck(spark, tmp_path):
    path = str(tmp_path / "a.tck.gz")
    tck.write(path, 3, [np.array(x, np.float32) for x in LINES])
    assert lines(files.load(spark, path)) == LINES
    data = gzip.open(path).read()
    for bad in (data[:-12], data[:-5], data.replace(b"0000000003", b"0000000004"), data.replace(b"Float32LE", b"Float32BE"), b"other" + data):
        with pytest.raises(FormatError):
            tck.parse(bad)


def test_vtk(spark, tmp_path):
    text = b"# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 2 float\n-1 -2 3\n-4 -5 6\nLINES 1 3\n2 0 1\n"
    points = np.array([[-1, -2, 3], [-4, -5, 6]], np.float32)
    assert (vtk.parse(text).positions == points).all() and (vtk.parse(text, mode="lps").positions == points * [-1, -1, 1]).all()
    assert (vtk.parse(text, mode="header").positions == points * [-1, -1, 1]).all() and vtk.warnings(text, "header")
    for kind, name in ((">f4", b"float"), (">f8", b"double")):
        binary = b"# vtk DataFile Version 3.0\nSPACE=RAS\nBINARY\nDATASET POLYDATA\nPOINTS 2 " + name + b"\n" + points.astype(kind).tobytes() + b"\nLINES 1 3\n" + np.array([2, 0, 1], ">i4").tobytes() + b"\n"
        assert (vtk.parse(binary, mode="header").positions == points).all()
    with pytest.raises(FormatError):
        vtk.parse(text.replace(b"2 0 1", b"2 0 7"))
    path = str(tmp_path / "a.vtk")
    vtk.write(path, 3, 8, [np.array(x, np.float32) for x in LINES])
    assert lines(files.load(spark, path)) == LINES


def trk_bytes(end="<", order=b"RAS", affine=None, fields=True):
    head = np.zeros(1, np.dtype({**trk.FIELDS, "formats": [trk._ended(f, end) for f in trk.FIELDS["formats"]]}))
    h = head[0]
    h["magic"], h["dim"], h["voxel"], h["count"], h["version"], h["size"] = b"TRACK", (10, 11, 12), (1, 2, 3), 3, 2, 1000
    h["affine"] = np.diag([1, 2, 3, 1]) if affine is None else affine
    raw = bytearray(head.tobytes())
    raw[948:951] = order
    if fields:
        struct.pack_into(end + "h", raw, 36, 4)
        raw[38:46] = b"colors\x003"
        raw[58:60] = b"fa"
        struct.pack_into(end + "h", raw, 238, 1)
        raw[240:244] = b"curv"
    n = 0
    for i, line in enumerate(LINES):
        raw += struct.pack(end + "i", len(line))
        for p in line:
            voxel = np.array(p) / [1, 2, 3]
            flip = [(d - 1) - v if c != r else v for v, d, c, r in zip(voxel, (10, 11, 12), order.decode(), "RAS", strict=True)]
            raw += struct.pack(end + "3f", *((np.array(flip) + 0.5) * [1, 2, 3]))
            raw += struct.pack(end + "4f", n, n, n, n / 10) if fields else b""
            n += 1
        raw += struct.pack(end + "f", i + 0.5) if fields else b""
    return bytes(raw)


@pytest.mark.parametrize(("end", "order"), [("<", b"RAS"), (">", b"RAS"), ("<", b"LPS")])
def test_trk(spark, tmp_path, end, order):
    path = str(tmp_path / "a.trk")
    with open(path, "wb") as f:
        f.write(trk_bytes(end, order))
    t = files.load(spark, path)
    assert np.allclose(np.concatenate([np.array(x) for x in lines(t)]), np.concatenate([np.array(x) for x in LINES]), atol=1e-5)
    assert t.dpv == {"colors": Array("float32", 3), "fa": Array("float32", 1)} and t.dps == {"curv": Array("float32", 1)}
    assert [r["dps_curv"] for r in t.streamlines.orderBy("sl_id").collect()] == [0.5, 1.5, 2.5]
    with pytest.raises(FormatError):
        files.read_tractogram(spark, path)
    files.convert(spark, path, str(tmp_path / "a.trx"))
    assert files.load(spark, str(tmp_path / "a.trx")).dpv == t.dpv


def test_trk_errors():
    with pytest.raises(FormatError, match="vox_to_ras is missing or zero"):
        trk.parse(trk_bytes(affine=np.zeros((4, 4))))
    with pytest.raises(FormatError):
        trk.parse(trk_bytes()[:-4])


def tt_bytes():
    def rec(name, kind, values, rows=None):
        raw = np.asarray(values, tt.KINDS[kind])
        return struct.pack("<5I", kind, rows or len(raw), len(raw) // (rows or len(raw)), 0, len(name) + 1) + name.encode() + b"\0" + raw.tobytes()

    track = struct.pack("<I3i", 6, 32, 64, 96) + np.array([32, 0, -32], np.int8).tobytes() + struct.pack("<I3i", 3, 0, 0, 0)
    affine = [-1, 0, 0, 78, 0, -1, 0, 76, 0, 0, 1, -50, 0, 0, 0, 1]
    return rec("dimension", 20, [157, 189, 136]) + rec("voxel_size", 10, [1, 1, 1]) + rec("trans_to_mni", 10, affine) + rec("track", 50, np.frombuffer(track, np.uint8)) + rec("cluster", 40, [1, 0]) + rec("color", 20, [0x3CA0FF, 1]) + rec("report", 50, np.frombuffer(b"text\0", np.uint8))


def test_tt(spark, tmp_path):
    path = str(tmp_path / "a.tt.gz")
    with gzip.open(path, "wb") as f:
        f.write(tt_bytes())
    t = files.load(spark, path)
    assert lines(t) == [[(77.0, 74.0, -47.0), (76.0, 74.0, -48.0)], [(78.0, 76.0, -50.0)]]
    assert t.names("groups") == ["cluster_0", "cluster_1"] and t.header.extra["tt_report"] == "text"
    assert list(t.dpg_field("cluster_0", "color").first()["value"]) == [60.0, 160.0, 255.0]
    with open(path + ".txt", "w") as f:
        f.write("A/B\nA:B\n")
    assert files.load(spark, path).names("groups") == ["A_B", "A_B_1"]
    with pytest.raises(FormatError, match="truncated"):
        tt.parse(tt_bytes()[:-3])


def test_reference(tmp_path):
    raw = bytearray(352)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 3, 7, 8, 9, 1, 1, 1, 1)
    struct.pack_into("<2h", raw, 252, 0, 1)
    struct.pack_into("<12f", raw, 280, 2, 0, 0, -1, 0, 2, 0, -2, 0, 0, 2, -3)
    header = nifti.parse(bytes(raw))
    assert header.dimensions == [7, 8, 9] and header.affine[1] == [0, 2, 0, -2]


def test_command_line(spark, full, tmp_path, capsys):
    a, b, c = (str(tmp_path / f"{n}.trx") for n in "abc")
    files.write_tractogram(full, a)
    run = lambda *argv: cli.run(spark, list(argv))
    assert run("convert", a, b) == 0 and run("compare", a, b, "--deep") == 0
    assert run("concatenate", a, b, "--output", c) == 0 and tuple(files.load(spark, c).counts().first()) == (6, 10)
    assert run("compare", a, c) == 1
    assert run("manipulate-dtype", a, b, "--positions-dtype", "float16") == 0 and files.load(spark, b).dtype == "float16"
    assert run("subset", a, b, "--group", "bundle") == 0 and len(lines(files.load(spark, b))) == 1
    assert run("subset", a, b, "--export-groups", str(tmp_path / "g_{groupname}.trx")) == 0 and os.path.exists(tmp_path / "g_bundle.trx")
    assert run("update-affine", a, c, b) == 0 and run("validate", a, "--output", b) == 0
    assert run("info", a, "--stats") == 0 and "length mean" in capsys.readouterr().out
    assert run("copy-metadata", a, a, "--output", b) == 1 and "exists" in capsys.readouterr().err
    assert run("copy-metadata", a, a, "--overwrite") == 0
    assert run("info", str(tmp_path / "none.trx")) == 1
    assert json.loads(trx.Container(a).bytes("header.json"))["NB_STREAMLINES"] == 3


@pytest.mark.parametrize("name", ["a.trx", "a.tck.gz", "a.trk", "a.tt.gz", "a.vtk"])
def test_by_uri(spark, full, tmp_path, name):
    """The same through Spark's reader as from a mounted path, for every format."""
    path = str(tmp_path / name)
    if name in ("a.trk", "a.tt.gz"):
        data = trk_bytes() if name == "a.trk" else gzip.compress(tt_bytes())
        with open(path, "wb") as f:
            f.write(data)
    else:
        files.write_tractogram(full, path)
    here, there = files.load(spark, path), files.load(spark, f"file://{path}")
    assert lines(here) == lines(there) and here.header == there.header and here.dps == there.dps and here.dpv == there.dpv
    assert sorted(here.streamlines.columns) == sorted(there.streamlines.columns)
    columns = sorted(here.streamlines.columns)
    rows = lambda t: [tuple(map(str, r)) for r in t.streamlines.select(columns).orderBy("sl_id").collect()]
    assert rows(here) == rows(there)
    for table in ("groups", "group_names", "dpg"):
        assert sorted(map(str, getattr(here, table).collect())) == sorted(map(str, getattr(there, table).collect()))
