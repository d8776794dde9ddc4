"""TCK: a text header, then float triples; a row of NaN ends a streamline and a row of infinities the file."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np

from tractlake.errors import FormatError
from tractlake.model import Header
from tractlake.sources.parsed import Lines, joined

MAGIC = "mrtrix tracks"
#: Rows of a file that are read at a time.
ROWS = 1 << 18


def _start(f: BinaryIO) -> tuple[bytes, dict[str, str]]:
    """What stands before the end of the header and has been read, and the header's fields."""
    data = b""
    while (end := data.find(b"\nEND")) < 0:
        more = f.read(1 << 16)
        data += more
        if not data.startswith(MAGIC.encode()) or not more:
            raise FormatError("not a TCK file")
    if not data.startswith(MAGIC.encode()):
        raise FormatError("not a TCK file")
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\n")[1:]:
        key, sep, value = line.partition(":")
        if sep:
            fields[key.strip()] = value.strip()
    if fields.get("datatype") != "Float32LE":
        raise FormatError(f"unsupported TCK datatype {fields.get('datatype')}")
    place = fields.get("file", "").split()
    if len(place) != 2 or place[0] != "." or not place[1].isdigit():
        raise FormatError("TCK data must be in the same file")
    return data, fields


def pieces(f: BinaryIO, rows: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and offsets of whole streamlines, as many as some rows hold, one after another."""
    rows, (data, fields) = rows or ROWS, _start(f)
    at = int(fields["file"].split()[1])
    while len(data) < at and (more := f.read(min(ROWS, at - len(data)))):
        data += more
    rest, data, ended, count = data[at:], b"", False, 0
    left = np.empty((0, 3), np.float32)  # of a streamline whose end is still to come
    while more := rest or f.read(rows * 12):
        rest = b""
        data += more
        whole = len(data) - len(data) % 12
        part, data = np.frombuffer(data[:whole], "<f4").reshape(-1, 3), data[whole:]
        if ended:
            continue  # only its size matters
        last = np.flatnonzero(np.isinf(part).all(axis=1))
        if len(last):
            ended, part = True, part[: last[0]]
        marks = np.isnan(part).all(axis=1)
        ends = np.flatnonzero(marks)
        if len(ends):
            own = np.concatenate([left, part[: ends[-1]][~marks[: ends[-1]]]])
            offsets = np.concatenate([[0], len(left) + ends - np.arange(len(ends))])
            count += len(ends)
            yield own, offsets
            left, part = np.empty((0, 3), np.float32), part[ends[-1] + 1 :]
        left = np.concatenate([left, part])
    if data:
        raise FormatError("TCK payload is not made of triples")
    if not ended:
        raise FormatError("TCK payload has no end")
    if len(left):  # what stands behind the last mark
        count += 1
        yield left, np.array([0, len(left)])
    if fields.get("count", "").isdigit() and int(fields["count"]) != count:
        raise FormatError(f"TCK header declares {fields['count']} streamlines but holds {count}")


def parse(data: bytes, header: Header | None = None) -> Lines:
    return joined(header or Header(), pieces(io.BytesIO(data)))


def encoded(flat: np.ndarray, sizes: np.ndarray, zipped: bool = False) -> bytes:
    """Streamlines with their marks; a member of a gzip file by itself if zipped."""
    out = np.full((len(flat) + len(sizes), 3), np.nan, "<f4")
    out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    return gzip.compress(out.tobytes()) if zipped else out.tobytes()


def write(path: str, count: int, lines: Iterable[np.ndarray]) -> None:
    """Write streamlines one after another, without holding them."""
    write_encoded(path, count, (encoded(line, np.array([len(line)]), path.endswith(".gz")) for line in lines))


def write_encoded(path: str, count: int, lines: Iterable[bytes]) -> None:
    """The same for streamlines that are encoded, and zipped if the path says so."""
    fixed = f"{MAGIC}\ncount: {count:010d}\ndatatype: Float32LE\nfile: . "
    offset = len(fixed) + len("\nEND\n")
    while len(str(offset)) + len(fixed) + len("\nEND\n") > offset:
        offset += 1
    own = gzip.compress if path.endswith(".gz") else bytes
    with open(path, "wb") as out:
        out.write(own(f"{fixed}{offset}\nEND\n".encode().ljust(offset, b"\n")[:offset]))
        out.writelines(lines)
        out.write(own(np.full((1, 3), np.inf, "<f4").tobytes()))
