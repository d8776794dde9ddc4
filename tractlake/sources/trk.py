"""TrackVis version 2: a 1000-byte header, then streamlines with scalars and properties, in voxel millimetres."""

from __future__ import annotations

import numpy as np

from tractlake.errors import FormatError
from tractlake.model import Array, Header
from tractlake.sources.parsed import Lines

SIZE = 1000
# The fields of the header that are read, with their places.
FIELDS = {"names": ["magic", "dim", "voxel", "n_scalars", "scalars", "n_properties", "properties", "affine", "order", "count", "version", "size"], "formats": ["S6", ("i2", 3), ("f4", 3), "i2", ("V20", 10), "i2", ("V20", 10), ("f4", (4, 4)), "V4", "i4", "i4", "i4"], "offsets": [0, 6, 12, 36, 38, 238, 240, 440, 948, 988, 992, 996], "itemsize": SIZE}
AXES = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}


def name_slices(slots: np.ndarray, total: int, rest: str) -> dict[str, tuple[int, int]]:
    """Columns of each named field; a slot is a name, or a name, a zero byte and the number of columns."""
    out, at = {}, 0
    for slot in slots:
        parts = bytes(slot).rstrip(b"\0").decode("latin-1").split("\0")
        if parts == [""]:
            continue
        if len(parts) > 2 or (len(parts) == 2 and not parts[1].isdigit()):
            raise FormatError(f"invalid TrackVis name {parts}")
        n = int(parts[1]) if len(parts) == 2 else 1
        if n:
            out[parts[0]] = (at, at + n)
            at += n
    if at < total:
        out[rest] = (at, total)
        at = total
    if at != total:
        raise FormatError(f"TrackVis names have {at} columns, declared are {total}")
    return out


def axis_codes(affine: np.ndarray) -> list[tuple[int, int]]:
    """World axis and direction of each voxel axis."""
    out = []
    for column in affine[:3, :3].T:
        axis = int(np.argmax(np.abs(column)))
        if abs(column[axis]) <= np.finfo(np.float32).eps or axis in (a for a, _ in out):
            raise FormatError("TRK affine is ambiguous or singular")
        out.append((axis, 1 if column[axis] >= 0 else -1))
    return out


def to_world(points: np.ndarray, head, order: list[tuple[int, int]], codes: list[tuple[int, int]]) -> np.ndarray:
    """Voxel millimetres to RAS millimetres, in single precision."""
    voxel = (points / head["voxel"].astype(np.float32) - np.float32(0.5)).astype(np.float32)
    turned = np.empty_like(voxel)
    families = [a for a, _ in order]
    for i, (axis, sign) in enumerate(codes):
        if axis not in families:
            raise FormatError("TRK voxel order does not match the affine")
        j = families.index(axis)
        turned[:, i] = voxel[:, j] if order[j][1] == sign else np.float32(head["dim"][j] - 1) - voxel[:, j]
    m = head["affine"].astype(np.float32)
    return np.column_stack([((turned[:, 0] * m[r, 0] + turned[:, 1] * m[r, 1]) + turned[:, 2] * m[r, 2]) + m[r, 3] for r in range(3)])


def parse(data: bytes, header: Header | None = None, fields: bool = True, streamlines: bool = True) -> Lines:
    """All streamlines; with ``fields`` False a file with scalars or properties is refused. A header given is ignored.

    With ``streamlines`` False only the header is read, and only it need be in ``data``.
    """
    if len(data) < SIZE or data[:5] != b"TRACK":
        raise FormatError("not a TrackVis file")
    for end in "<>":
        head = np.frombuffer(data[:SIZE], np.dtype({**FIELDS, "formats": [_ended(f, end) for f in FIELDS["formats"]]}))[0]
        if head["size"] == SIZE:
            break
    else:
        raise FormatError("TRK header size is invalid")
    if head["version"] != 2:
        raise FormatError(f"unsupported TrackVis version {head['version']}")
    if (head["dim"] <= 0).any() or not (np.isfinite(head["voxel"]) & (head["voxel"] > 0)).all():
        raise FormatError("TRK dimensions and voxel sizes must be positive")
    ns, np_ = int(head["n_scalars"]), int(head["n_properties"])
    if ns < 0 or np_ < 0:
        raise FormatError("TRK numbers of fields can't be negative")
    if not np.isfinite(head["affine"]).all():
        raise FormatError("TRK vox_to_ras has values that are not finite")
    if (np.abs(head["affine"]) <= np.finfo(np.float32).eps).all():
        raise FormatError("TRK vox_to_ras is missing or zero")
    codes = axis_codes(head["affine"])
    letters = bytes(head["order"]).split(b"\0")[0].decode("latin-1").strip().upper()
    if len(letters) < 3 or any(c not in AXES for c in letters[:3]):
        raise FormatError("TRK voxel order is missing or unknown")
    scalars, properties = name_slices(head["scalars"], ns, "scalars"), name_slices(head["properties"], np_, "properties")
    if not fields and (ns or np_):
        raise FormatError("TRK file has scalars or properties; convert it to keep them")
    floats, ints = np.dtype(end + "f4"), np.dtype(end + "i4")
    at, rows, props, declared = SIZE, [], [], int(head["count"])
    if not streamlines:
        data, declared = data[:SIZE], 0
    while at < len(data) and not (declared > 0 and len(rows) >= declared):
        if at + 4 > len(data):
            raise FormatError("TRK payload ends in a streamline's length")
        n = int(np.frombuffer(data, ints, 1, at)[0])
        need = n * (3 + ns) * 4 + np_ * 4
        if n < 0 or at + 4 + need > len(data):
            raise FormatError("TRK payload ends in a streamline")
        rows.append(np.frombuffer(data, floats, n * (3 + ns), at + 4).reshape(n, 3 + ns).astype(np.float32))
        props.append(np.frombuffer(data, floats, np_, at + 4 + n * (3 + ns) * 4).astype(np.float32))
        at += 4 + need
    if declared > 0 and len(rows) != declared:
        raise FormatError(f"TRK header declares {declared} streamlines but holds {len(rows)}")
    flat = np.concatenate(rows) if rows else np.empty((0, 3 + ns), np.float32)
    table = np.array(props, np.float32).reshape(len(rows), np_)
    world = to_world(flat[:, :3], head, [AXES[c] for c in letters[:3]], codes)
    own = Header([[float(x) for x in r] for r in head["affine"]], [int(d) for d in head["dim"]])
    return Lines(
        own, world, np.cumsum([0, *map(len, rows)]),
        dps={k: table[:, a:b] for k, (a, b) in properties.items()}, dpv={k: flat[:, 3 + a : 3 + b] for k, (a, b) in scalars.items()},
        dps_arrays={k: Array("float32", b - a) for k, (a, b) in properties.items()}, dpv_arrays={k: Array("float32", b - a) for k, (a, b) in scalars.items()},
    )


def _ended(kind, end: str):
    if isinstance(kind, tuple):
        return (_ended(kind[0], end), kind[1])
    return kind if kind[0] in "SV" else end + kind
