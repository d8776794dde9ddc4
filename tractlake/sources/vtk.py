"""Legacy VTK poly data: points, then lines of point numbers, as text or big-endian binary."""

from __future__ import annotations

import io
import re
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np

from tractlake.errors import FormatError
from tractlake.model import Header
from tractlake.sources.parsed import Lines, joined

#: Bytes that are read at a time, and points that a fetch may read in vain.
READ_BYTES, FETCH = 1 << 22, 1 << 17
LAST_BLANK = re.compile(rb"\s\S*\Z")
MODES = ("ras", "lps", "header")


def declared_space(data: bytes) -> str | None:
    """Space that the text up to the POINTS line declares; RAS wins."""
    m = re.search(rb"POINTS[^\n]*\n", data)
    head = data[: m.end() if m else 1024].upper()
    return "ras" if re.search(rb"SPACE\s*[=:]\s*RAS", head) else "lps" if re.search(rb"SPACE\s*[=:]\s*LPS", head) else None


def warnings(data: bytes, mode: str) -> list[str]:
    return ["VTK file declares no space; LPS is assumed"] if mode == "header" and declared_space(data) is None else []


class _Reader:
    """A file's lines, numbers and bytes in order; never more than a piece of it is held."""

    def __init__(self, f: BinaryIO):
        self.f, self.data, self.at, self.over = f, b"", 0, False

    def more(self) -> bool:
        self.data, self.at = self.data[self.at :], 0
        found = self.f.read(READ_BYTES)
        self.data += found
        self.over = not found
        return bool(found)

    def raw_line(self) -> bytes:
        """The next line that is not blank."""
        while True:
            end = self.data.find(b"\n", self.at)
            if end < 0 and self.more():
                continue
            if self.at >= len(self.data):
                raise FormatError("VTK file ends early")
            end = len(self.data) if end < 0 else end
            text, self.at = self.data[self.at : end], end + 1
            if text.strip():
                return text

    def line(self) -> str:
        return self.raw_line().decode("latin-1").strip()

    def numbers(self, until: re.Pattern | None = None, most: int | None = None) -> Iterator[list[bytes]]:
        """Words in pieces, up to where a pattern begins, or so many."""
        while most is None or most > 0:
            if self.at >= len(self.data) and not self.more():
                return
            stop = until.search(self.data, self.at) if until else None
            end = stop.start() if stop else self.whole()
            if end is None:
                if self.more():
                    continue
                end = len(self.data)
            words = self.data[self.at : end].split()
            self.at = end
            if most is not None:
                words = words[:most]
                most -= len(words)
            yield words
            if stop:
                return

    def whole(self) -> int | None:
        """Where the last word that is surely whole ends; None if there is none."""
        m = LAST_BLANK.search(self.data[self.at :]) if len(self.data) - self.at < 4096 else LAST_BLANK.search(self.data[-4096:])
        if m is None:
            return None
        return (self.at if len(self.data) - self.at < 4096 else len(self.data) - 4096) + m.start() + 1

    def bytes(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at >= len(self.data) and not self.more():
                return
            piece = self.data[self.at : self.at + n]
            self.at, n = self.at + len(piece), n - len(piece)
            yield piece


def _in_whole(arrived: Iterator[bytes], kind: np.dtype) -> Iterator[np.ndarray]:
    """Bytes as numbers, whatever pieces they come in."""
    rest = b""
    for piece in arrived:
        rest += piece
        cut = len(rest) - len(rest) % kind.itemsize
        yield np.frombuffer(rest[:cut], kind)
        rest = rest[cut:]


def _numbers(words: list[bytes], kind: type) -> np.ndarray:
    try:
        return np.array(words, dtype=kind)
    except ValueError as e:
        raise FormatError(f"VTK file has a word in place of a number: {e}") from e


class _Points:
    """Points in a file of the task's own, from which lines fetch theirs."""

    def __init__(self):
        self.file, self.numbers = tempfile.TemporaryFile(), 0  # noqa: SIM115

    def add(self, flat: np.ndarray) -> None:
        self.file.write(flat.astype("<f4").tobytes())
        self.numbers += len(flat)

    def fetch(self, index: np.ndarray) -> np.ndarray:
        if not len(index):
            return np.empty((0, 3), np.float32)
        lo, hi = int(index.min()), int(index.max()) + 1
        if hi - lo > 4 * len(index) + FETCH:  # far apart
            self.file.flush()
            return np.asarray(np.memmap(self.file, "<f4", "r", 0, (self.numbers // 3, 3))[index])
        self.file.seek(lo * 12)
        return np.frombuffer(self.file.read((hi - lo) * 12), "<f4").reshape(-1, 3)[index - lo]


def pieces(f: BinaryIO, mode: str = "ras") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and offsets of whole lines, as many as some bytes hold, one after another."""
    if mode not in MODES:
        raise ValueError(f"unknown VTK mode '{mode}'")
    r, head = _Reader(f), []

    def line() -> str:
        head.append(r.raw_line())
        return head[-1].decode("latin-1").strip()

    if not line().startswith("# vtk DataFile"):
        raise FormatError("not a VTK file")
    line()
    kind = line().upper()
    if line().upper().split() != ["DATASET", "POLYDATA"]:
        raise FormatError("only POLYDATA is read")
    words = line().split()
    if len(words) != 3 or words[0].upper() != "POINTS" or words[2].lower() not in ("float", "double"):
        raise FormatError("POINTS must follow the data set")
    n, points = int(words[1]), _Points()
    if kind == "BINARY":
        for part in _in_whole(r.bytes(n * 3 * (size := np.dtype(">f4" if words[2].lower() == "float" else ">f8")).itemsize), size):
            points.add(part)
        if points.numbers < n * 3:
            raise FormatError("VTK points are cut short")
    elif kind == "ASCII":
        for part in r.numbers(re.compile(rb"LINES\b", re.I)):
            points.add(_numbers(part, np.float64).astype(np.float32))
        if points.numbers != n * 3:
            raise FormatError("VTK points don't fit their number")
    else:
        raise FormatError(f"unknown VTK encoding '{kind}'")
    words = r.line().split()
    if len(words) != 3 or words[0].upper() != "LINES":
        raise FormatError("LINES must follow the points")
    count, total = int(words[1]), int(words[2])
    arrived = _in_whole(r.bytes(total * 4), np.dtype(">i4")) if kind == "BINARY" else (_numbers(part, np.int64) for part in r.numbers(most=total))
    lps = (mode if mode != "header" else declared_space(b"\n".join([*head, b""])) or "lps") == "lps"
    turn = np.array([-1, -1, 1], np.float32) if lps else None
    left, found, got = np.empty(0, np.int64), 0, 0
    for part in arrived:
        got += len(part)
        left = np.concatenate([left, part.astype(np.int64)])
        numbers, starts, at = left.tolist(), [], 0
        while found < count and at < len(numbers) and at + 1 + numbers[at] <= len(numbers):
            if numbers[at] < 0:
                raise FormatError("VTK lines are cut short")
            starts.append(at)
            at, found = at + 1 + numbers[at], found + 1
        if starts:
            own, sizes = np.delete(left[:at], starts), left[starts]
            if len(own) and (own.min() < 0 or own.max() >= n):
                raise FormatError("VTK line has a point that does not exist")
            flat = points.fetch(own)
            yield flat if turn is None else flat * turn, np.concatenate([[0], np.cumsum(sizes)])
            left = left[at:]
    if found < count or kind == "BINARY" and got < total:
        raise FormatError("VTK lines are cut short")


def parse(data: bytes, header: Header | None = None, mode: str = "ras") -> Lines:
    """mode: coordinates are RAS, LPS, or as the header says (LPS if it does not)."""
    return joined(header or Header(), pieces(io.BytesIO(data), mode))


def points_text(flat: np.ndarray) -> bytes:
    return "".join(f"{x!s} {y!s} {z!s}\n" for x, y, z in np.asarray(flat, np.float32)).encode()


def lines_text(sizes: np.ndarray, at: int) -> bytes:
    """Lines of point numbers that follow one another."""
    out = []
    for n in sizes.tolist():
        out.append(" ".join(map(str, [n, *range(at, at + n)])) + "\n")
        at += n
    return "".join(out).encode()


def write_texts(path: str, count: int, n_points: int, points: Iterable[bytes], lines: Iterable[bytes]) -> None:
    """Text with the space declared, of points and lines that are texts already."""
    with open(path, "wb") as out:
        out.write(f"# vtk DataFile Version 3.0\nTractogram SPACE=RAS\nASCII\nDATASET POLYDATA\nPOINTS {n_points} float\n".encode())
        out.writelines(points)
        out.write(f"LINES {count} {count + n_points}\n".encode())
        out.writelines(lines)


def write(path: str, count: int, n_points: int, lines: Iterable[np.ndarray]) -> None:
    """The same of lines given one after another; their lengths are kept while the points are written."""
    sizes: list[int] = []

    def points() -> Iterator[bytes]:
        for line in lines:
            sizes.append(len(line))
            yield points_text(line)

    # evaluated when the points are written
    write_texts(path, count, n_points, points(), (lines_text(np.array(x), 0) for x in [sizes]))
