"""TinyTrack: gzipped records of numbers; streamlines as a first point and byte steps, in 1/32 of a voxel."""

from __future__ import annotations

import struct

import numpy as np

from tractlake.errors import FormatError
from tractlake.model import Header
from tractlake.sources.parsed import Lines

# Type codes of records.
KINDS = {0: "<f8", 10: "<f4", 20: "<u4", 30: "<i2", 40: "<u2", 50: "u1", 60: "<u8"}


def records(data: bytes) -> dict[str, tuple[int, np.ndarray]]:
    """Type code and values of each record; a later one of the same name wins."""
    out, at = {}, 0
    while at < len(data):
        if at + 20 > len(data):
            raise FormatError("truncated TT record header")
        kind, rows, cols, _, length = struct.unpack_from("<5I", data, at)
        at += 20
        if kind not in KINDS:
            raise FormatError(f"unsupported TT type code {kind}")
        if not length or at + length > len(data):
            raise FormatError("truncated TT record name")
        try:
            name = data[at : at + length].split(b"\0")[0].decode()
        except UnicodeDecodeError as e:
            raise FormatError("invalid TT record name") from e
        at += length
        n = rows * cols
        if at + n * np.dtype(KINDS[kind]).itemsize > len(data):
            raise FormatError(f"truncated TT payload for '{name}'")
        out[name] = (kind, np.frombuffer(data, KINDS[kind], n, at))
        at += n * np.dtype(KINDS[kind]).itemsize
    return out


def record(found: dict, name: str, kind: int, n: int | None = None) -> np.ndarray:
    if name not in found:
        raise FormatError(f"missing TT record '{name}'")
    if found[name][0] != kind or (n is not None and len(found[name][1]) != n):
        raise FormatError(f"invalid TT record '{name}'")
    return found[name][1]


def track(block: np.ndarray) -> list[np.ndarray]:
    """Streamlines of a block: each is a count of numbers, a first point, and signed steps from three numbers back."""
    raw, at, out = block.tobytes(), 0, []
    while at < len(raw):
        if at + 16 > len(raw):
            raise FormatError("truncated TT streamline")
        count, *first = struct.unpack_from("<I3i", raw, at)
        at += 16
        if count < 3 or count % 3:
            if count < 3:
                raise FormatError(f"invalid TT count {count}")
        if at + count - 3 > len(raw):
            raise FormatError("truncated TT steps")
        steps = np.frombuffer(raw, np.int8, count - 3, at).astype(np.int32)
        at += count - 3
        whole = len(steps) // 3 * 3
        points = np.cumsum(np.vstack([np.array([first], np.int32), steps[:whole].reshape(-1, 3)]), axis=0, dtype=np.int32)
        out.append(points.astype(np.float32) / np.float32(32))
    return out


def group_names(clusters: list[int], labels: list[str]) -> dict[int, str]:
    """A name for each cluster: its label made safe, or cluster_n; taken names get a number."""
    used, out = set(), {}
    for c in clusters:
        label = labels[c] if c < len(labels) else ""
        base = label.translate({ord(x): "_" for x in "/\\:\0"}).strip() or f"cluster_{c}"
        name, n = base, 1
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out[c] = name
    return out


def parse(data: bytes, header: Header | None = None, labels: list[str] | None = None, streamlines: bool = True) -> Lines:
    """Streamlines with a group for each cluster and a colour for each group. A header given is ignored.

    With ``streamlines`` False tracks are not decoded.
    """
    found = records(data)
    dims = record(found, "dimension", 20, 3)
    record(found, "voxel_size", 10, 3)
    affine = record(found, "trans_to_mni", 10, 16).astype(np.float64).reshape(4, 4)
    blocks = []
    for name in found:
        if name.startswith("track"):
            if name != "track" and not name[5:].isdigit():
                raise FormatError(f"invalid TT track block name '{name}'")
            blocks.append((int(name[5:] or 0), name))
    if not blocks:
        raise FormatError("missing TT track payload")
    lines = [x for _, name in sorted(blocks) for x in track(record(found, name, 50))] if streamlines else []
    cluster = record(found, "cluster", 40) if "cluster" in found else np.empty(0, np.uint16)
    colors = record(found, "color", 20) if "color" in found else np.empty(0, np.uint32)
    if streamlines and len(cluster) and len(cluster) != len(lines):
        raise FormatError(f"TT cluster count {len(cluster)} does not match streamline count {len(lines)}")
    extra = {}
    for key, name in (("tt_report", "report"), ("tt_parameter_id", "parameter_id")):
        if name in found:
            extra[key] = record(found, name, 50).tobytes().split(b"\0")[0].decode()
    if len(colors):
        extra["tt_raw_colors"] = [f"0x{int(c):08x}" for c in colors]
    world = [(x.astype(np.float64) @ affine[:3, :3].T + affine[:3, 3]).astype(np.float32) for x in lines]
    names = group_names(sorted(set(cluster.tolist())), labels or [])
    groups = {names[c]: np.flatnonzero(cluster == c).tolist() for c in names}
    dpg = {names[c]: {"color": ("uint8", [[int(colors[c]) >> s & 255 for s in (16, 8, 0)]])} for c in names if c < len(colors)}
    return Lines.of(Header(affine.tolist(), [int(d) for d in dims], extra), world, groups=groups, dpg=dpg)
