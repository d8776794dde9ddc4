"""What a file's bytes turn into before they are rows, and the rows that they turn into."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from tractlake.errors import FormatError
from tractlake.model import Array, Header, column_type, points_type

#: Streamlines of an Arrow batch.
BATCH = 4096
ARROW = {"float16": pa.float32(), "float32": pa.float32(), "float64": pa.float64(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0)}


@dataclass
class Lines:
    """Streamlines as arrays: positions (N x 3), offsets (with the last one), and attributes by name."""

    header: Header
    positions: np.ndarray
    offsets: np.ndarray
    dtype: str = "float32"
    dps: dict[str, np.ndarray] = field(default_factory=dict)
    dpv: dict[str, np.ndarray] = field(default_factory=dict)
    dps_arrays: dict[str, Array] = field(default_factory=dict)
    dpv_arrays: dict[str, Array] = field(default_factory=dict)
    groups: dict[str, list[int]] = field(default_factory=dict)
    dpg: dict[str, dict[str, tuple[str, list]]] = field(default_factory=dict)

    @staticmethod
    def of(header: Header, lines: list[np.ndarray], **parts) -> Lines:
        flat = np.concatenate([np.asarray(x, dtype=np.float32).reshape(-1, 3) for x in lines]) if lines else np.empty((0, 3), np.float32)
        return Lines(header, flat, np.cumsum([0, *(len(x) for x in lines)]), **parts)


def maybe_gunzip(data: bytes) -> bytes:
    """The bytes of all members of a gzip file, or the bytes as they are."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_bytes(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return maybe_gunzip(f.read())
    except (EOFError, gzip.BadGzipFile) as e:
        raise FormatError(f"{path}: {e}") from e


@contextmanager
def opened(path: str):
    """A file's content to read from, gunzipped as it is read if need be."""
    with open(path, "rb") as f:
        zipped = f.read(2) == b"\x1f\x8b"
    try:
        with (gzip.open if zipped else open)(path, "rb") as f:
            yield f
    except (EOFError, gzip.BadGzipFile) as e:
        raise FormatError(f"{path}: {e}") from e


def joined(header: Header, pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> Lines:
    """All pieces of a file, whole."""
    positions, sizes = [np.empty((0, 3), np.float32)], [np.zeros(1, np.int64)]
    for flat, offsets in pieces:
        positions.append(flat)
        sizes.append(np.diff(offsets))
    return Lines(header, np.concatenate(positions), np.cumsum(np.concatenate(sizes)))


def read_head(path: str, n: int) -> bytes:
    """The first n bytes of a file's content, gunzipped if need be."""
    with open(path, "rb") as f:
        zipped = f.read(2) == b"\x1f\x8b"
    try:
        with (gzip.open if zipped else open)(path, "rb") as f:
            return f.read(n)
    except (EOFError, gzip.BadGzipFile) as e:
        raise FormatError(f"{path}: {e}") from e


def schema_of(dtype: str, dps: dict[str, Array], dpv: dict[str, Array]) -> str:
    parts = ["sl_id bigint", f"points {points_type(dtype)}"]
    parts += [f"`dps_{n}` {column_type(a.dtype, a.ncols)}" for n, a in sorted(dps.items())]
    return ", ".join(parts + [f"`dpv_{n}` {column_type(a.dtype, a.ncols, True)}" for n, a in sorted(dpv.items())])


def values(data: np.ndarray, array: Array) -> pa.Array:
    """Rows of an attribute as an Arrow column."""
    kind = ARROW[array.dtype]
    flat = np.ascontiguousarray(data).reshape(-1)
    flat = pa.array([int(x) for x in flat], kind) if array.dtype == "uint64" else pa.array(flat.astype(np.float32) if array.dtype == "float16" else flat).cast(kind)
    return flat if array.ncols == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, array.ncols, dtype=np.int32)), flat)


def batches(first: int, positions: np.ndarray, offsets: np.ndarray, dtype: str, dps: dict[str, np.ndarray], dpv: dict[str, np.ndarray], dps_arrays: dict[str, Array], dpv_arrays: dict[str, Array]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of streamlines from ``first`` on; offsets are into the positions given."""
    kind = np.float64 if dtype == "float64" else np.float32
    n = len(offsets) - 1
    for lo in range(0, n, BATCH):
        hi = min(n, lo + BATCH)
        a, b = int(offsets[lo]), int(offsets[hi])
        part = np.asarray(positions[a:b]).astype(kind)
        where = pa.array((np.asarray(offsets[lo : hi + 1]) - a).astype(np.int32))
        points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(part[:, i])) for i in range(3)], ["x", "y", "z"])
        columns, names = [pa.array(np.arange(first + lo, first + hi, dtype=np.int64)), pa.ListArray.from_arrays(where, points)], ["sl_id", "points"]
        for name in sorted(dps_arrays):
            columns.append(values(dps[name][lo:hi], dps_arrays[name]))
            names.append(f"dps_{name}")
        for name in sorted(dpv_arrays):
            columns.append(pa.ListArray.from_arrays(where, values(dpv[name][a:b], dpv_arrays[name])))
            names.append(f"dpv_{name}")
        yield pa.RecordBatch.from_arrays(columns, names)
