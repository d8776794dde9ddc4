"""Files in formats that are read but not written, made of tractograms, for queries and tests."""

from __future__ import annotations

import struct

import numpy as np

from tractlake.model import Tractogram
from tractlake.sources import trk, tt
from tractlake.sources.trx import arrow_in_order


def polylines(t: Tractogram) -> list[np.ndarray]:
    """Points of all streamlines in order, in single precision."""
    out: list[np.ndarray] = []
    for batch in arrow_in_order(t.streamlines.select("sl_id", "points"), "sl_id"):
        points = batch.column("points")
        flat = np.column_stack([points.flatten().field(a).to_numpy(zero_copy_only=False) for a in "xyz"]).astype(np.float32)
        out += np.split(flat, np.cumsum(np.diff(points.offsets.to_numpy()))[:-1]) if len(points) else []
    return out


def trk_file(lines: list[np.ndarray], scalars: list[np.ndarray] | None = None, properties: list[float] | None = None, order: str = "RAS", end: str = "<", dims: tuple = (100, 110, 120), voxel: tuple = (1.0, 1.0, 1.0)) -> bytes:
    """TrackVis bytes of world coordinates; an axis against ``order`` is written flipped. One scalar "fa", one property "curv"."""
    head = np.zeros(1, np.dtype({**trk.FIELDS, "formats": [trk._ended(f, end) for f in trk.FIELDS["formats"]]}))
    h = head[0]
    h["magic"], h["dim"], h["voxel"], h["count"], h["version"], h["size"] = b"TRACK", dims, voxel, len(lines), 2, trk.SIZE
    h["affine"] = np.diag([*voxel, 1.0])
    raw = bytearray(head.tobytes())
    raw[948:951] = order.encode()
    if scalars is not None:
        struct.pack_into(f"{end}h", raw, 36, 1)
        raw[38:40] = b"fa"
    if properties is not None:
        struct.pack_into(f"{end}h", raw, 238, 1)
        raw[240:244] = b"curv"
    size, flips = np.array(voxel, np.float32), [c != r for c, r in zip(order, "RAS", strict=True)]
    parts = [bytes(raw)]
    for i, line in enumerate(lines):
        at = line / size
        at = np.where(flips, np.array(dims, np.float32) - 1 - at, at)
        rows = (at + np.float32(0.5)) * size
        if scalars is not None:
            rows = np.column_stack([rows, scalars[i]])
        parts += [struct.pack(f"{end}i", len(line)), rows.astype(f"{end}f4").tobytes()]
        if properties is not None:
            parts.append(struct.pack(f"{end}f", properties[i]))
    return b"".join(parts)


def tt_file(lines: list[np.ndarray], clusters: list[int], colors: list[int], dims: tuple = (157, 189, 136), affine: tuple = (-1, 0, 0, 78, 0, -1, 0, 76, 0, 0, 1, -50, 0, 0, 0, 1), blocks: int = 2) -> bytes:
    """TinyTrack bytes of voxel coordinates that are whole 32nds, in track blocks."""

    def record(name: str, kind: int, values) -> bytes:
        raw = np.asarray(values, tt.KINDS[kind])
        return struct.pack("<5I", kind, len(raw), 1, 0, len(name) + 1) + name.encode() + b"\0" + raw.tobytes()

    def track(line: np.ndarray) -> bytes:
        q = np.rint(line * 32).astype(np.int64)
        return struct.pack("<I3i", 3 * len(q), *q[0].tolist()) + np.diff(q, axis=0).astype(np.int8).tobytes()

    out = [record("dimension", 20, dims), record("voxel_size", 10, [1, 1, 1]), record("trans_to_mni", 10, affine)]
    step = -(-len(lines) // blocks)
    for b in reversed(range(blocks)):  # out of order: blocks are sorted by their number
        out.append(record(f"track{b}" if b else "track", 50, np.frombuffer(b"".join(map(track, lines[b * step : (b + 1) * step])), np.uint8)))
    return b"".join([*out, record("cluster", 40, clusters), record("color", 20, colors), record("report", 50, np.frombuffer(b"made of events\0", np.uint8)), record("parameter_id", 50, np.frombuffer(b"p1\0", np.uint8))])


def vtk_binary(lines: list[np.ndarray], kind: str = "float", space: str = "RAS") -> bytes:
    points = np.concatenate(lines) if lines else np.empty((0, 3), np.float32)
    starts = np.cumsum([0, *map(len, lines)])
    index = np.concatenate([np.concatenate([[len(x)], np.arange(a, a + len(x))]) for x, a in zip(lines, starts[:-1], strict=True)]) if lines else np.empty(0)
    head = f"# vtk DataFile Version 3.0\nSPACE={space}\nBINARY\nDATASET POLYDATA\nPOINTS {len(points)} {kind}\n".encode()
    return head + points.astype(">f4" if kind == "float" else ">f8").tobytes() + f"\nLINES {len(lines)} {len(index)}\n".encode() + index.astype(">i4").tobytes() + b"\n"


def nifti_header(dims: list[int], sform: list | None = None, qform: list | None = None, pixdim: tuple = (1.0, 1.0, 1.0), end: str = "<") -> bytes:
    """A NIfTI-1 header with an affine as sform (3 x 4), as qform (b, c, d, shifts), or in its voxel sizes only."""
    raw = bytearray(352)
    struct.pack_into(f"{end}i", raw, 0, 348)
    struct.pack_into(f"{end}8h", raw, 40, 3, *dims, 1, 1, 1, 1)
    struct.pack_into(f"{end}8f", raw, 76, 1, *pixdim, 0, 0, 0, 0)
    struct.pack_into(f"{end}2h", raw, 252, int(qform is not None), int(sform is not None))
    if qform is not None:
        struct.pack_into(f"{end}6f", raw, 256, *qform)
    if sform is not None:
        struct.pack_into(f"{end}12f", raw, 280, *(v for row in sform for v in row))
    return bytes(raw)
