"""TRX containers: a folder or zip archive with a header and one file for each array, its name telling type and width."""

from __future__ import annotations

import os
import shutil
import struct
import time
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tractlake.errors import FormatError
from tractlake.model import DTYPES, FLOATS, Array, Header
from tractlake.sources import parts

MAX_ID = (1 << 32) - 1
#: Offsets that are looked at together.
PIECE = 1 << 20


def parse_name(name: str) -> tuple[str, Array]:
    """name.dtype or name.ncols.dtype; the name may hold dots."""
    base, dot, dtype = name.rpartition(".")
    if not dot or not base or dtype not in DTYPES:
        raise FormatError(f"invalid array file name '{name}'")
    front, dot, cols = base.rpartition(".")
    if dot and front and cols.isdigit():
        return front, Array(dtype, int(cols))
    return base, Array(dtype)


def file_name(name: str, array: Array) -> str:
    return f"{name}.{array.dtype}" if array.ncols == 1 else f"{name}.{array.ncols}.{array.dtype}"


class Container:
    """The arrays of a folder or archive by logical name; nothing is read but names until an array is asked for."""

    def __init__(self, path: str):
        self.path, self.zip = path, None
        if os.path.isdir(path):
            found = [os.path.relpath(os.path.join(d, f), path).replace(os.sep, "/") for d, _, fs in os.walk(path) for f in fs]
        elif os.path.isfile(path):
            if not zipfile.is_zipfile(path):
                raise FormatError(f"{path} is neither a folder nor an archive")
            with zipfile.ZipFile(path) as z:
                self.zip = {i.filename: i for i in z.infolist() if not i.is_dir()}
                if len(self.zip) != sum(not i.is_dir() for i in z.infolist()):
                    raise FormatError(f"{path} has entries of the same name")
            found = list(self.zip)
            for name in found:
                if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name.split("/")[0]:
                    raise FormatError(f"unsafe entry name '{name}'")
        else:
            raise FileNotFoundError(path)
        self.dps, self.dpv, self.groups, self.dpg, self.core = {}, {}, {}, {}, {}
        for entry in sorted(found):
            parts = entry.split("/")
            if parts[0] in ("dps", "dpv", "groups") and len(parts) == 2:
                name, array = parse_name(parts[1])
                getattr(self, parts[0])[name] = (entry, array)
            elif parts[0] == "dpg" and len(parts) == 3:
                name, array = parse_name(parts[2])
                self.dpg.setdefault(parts[1], {})[name] = (entry, array)
            elif len(parts) == 1 and parts[0] != "header.json" and "." in parts[0]:
                self.core.setdefault(parts[0].split(".")[0], parts[0])
        if "header.json" not in found:
            raise FormatError(f"{path} has no header.json")
        self.header = Header.parse(self.bytes("header.json"))
        if "positions" not in self.core or "offsets" not in self.core:
            raise FormatError(f"{path} lacks positions or offsets")
        _, positions = parse_name(self.core["positions"])
        if positions.dtype not in FLOATS or positions.ncols != 3:
            raise FormatError(f"positions must be three floats, not {positions}")
        self.dtype = positions.dtype
        _, offsets = parse_name(self.core["offsets"])
        if offsets.dtype not in ("uint32", "uint64"):
            raise FormatError(f"offsets can't be {offsets.dtype}")

    def bytes(self, entry: str) -> bytes:
        if self.zip is None:
            with open(os.path.join(self.path, entry), "rb") as f:
                return f.read()
        with zipfile.ZipFile(self.path) as z:
            return z.read(entry)

    def array(self, entry: str, array: Array) -> np.ndarray:
        """An array as rows; mapped from a folder or a stored entry, read from a compressed one."""
        kind = np.dtype(array.dtype).newbyteorder("<")
        if self.zip is None:
            path, at, size = os.path.join(self.path, entry), 0, os.path.getsize(os.path.join(self.path, entry))
        else:
            info = self.zip[entry]
            if info.compress_type != zipfile.ZIP_STORED:
                return self._shaped(np.frombuffer(self.bytes(entry), kind), array)
            with open(self.path, "rb") as f:
                f.seek(info.header_offset)
                head = struct.unpack("<IHHHHHIIIHH", f.read(30))
            path, at, size = self.path, info.header_offset + 30 + head[9] + head[10], info.file_size
        if size % (kind.itemsize * max(1, array.ncols)):
            raise FormatError(f"{entry} is not made of whole rows")
        if not size:
            return self._shaped(np.empty(0, kind), array)
        return self._shaped(np.memmap(path, kind, "r", at, (size // kind.itemsize,)), array)

    def rows(self, entry: str, array: Array) -> int:
        """Rows of an array, by its size."""
        size = self.zip[entry].file_size if self.zip is not None else os.path.getsize(os.path.join(self.path, entry))
        return size // (np.dtype(array.dtype).itemsize * max(1, array.ncols))

    @staticmethod
    def _shaped(flat: np.ndarray, array: Array) -> np.ndarray:
        return flat if array.ncols == 1 else flat.reshape(-1, array.ncols)

    def positions(self) -> np.ndarray:
        return self.array(self.core["positions"], parse_name(self.core["positions"])[1])

    def raw_offsets(self) -> np.ndarray:
        """Offsets as they are in the file."""
        return self.array(self.core["offsets"], parse_name(self.core["offsets"])[1])

    def n_streamlines(self) -> int:
        """How many streamlines there are; offsets of a wrong length or order are an error. They are looked at in pieces."""
        found, n, declared = self.raw_offsets(), self.n_vertices(), self.declared()
        if not len(found):
            return 0
        lacks = declared is not None and len(found) == declared
        if declared is not None and not lacks and len(found) != declared + 1:
            raise FormatError(f"{len(found)} offsets for {declared} streamlines")
        last = 0
        for lo in range(0, len(found), PIECE):
            piece = np.asarray(found[lo : lo + PIECE]).astype(np.int64)
            if (lo == 0 and piece[0] != 0) or piece[0] < last or (np.diff(piece) < 0).any():
                raise FormatError("offsets don't fit the positions")
            last = int(piece[-1])
        if last > n or not lacks and last != n:
            raise FormatError("offsets don't fit the positions")
        if n > MAX_ID:
            raise FormatError("offsets exceed 32 bits")
        return len(found) if lacks else len(found) - 1

    def offsets(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Offsets with the last one, which files may lack. Those of some streamlines are taken as they are, once checked."""
        if hi is None:
            hi = self.n_streamlines()
            if not hi:
                return np.zeros(1, np.int64)
        found = np.asarray(self.raw_offsets()[lo : hi + 1]).astype(np.int64)
        return np.append(found, self.n_vertices()) if len(found) < hi - lo + 1 else found

    def n_vertices(self) -> int:
        return len(self.positions())

    def declared(self) -> int | None:
        import json

        return json.loads(self.bytes("header.json")).get("NB_STREAMLINES")


def write(path: str, tractogram, compress_groups: bool = False) -> None:
    """Write a tractogram as a folder, or an archive if the path ends in .trx.

    Tasks write streamlines in order of id, and members of groups, as parts of the arrays' files; the driver joins them,
    as a container is one file for each array, however many rows it has. The container appears under its name when whole.
    """
    t = tractogram
    work = f"{path}.writing"
    shutil.rmtree(work, ignore_errors=True)
    files = {f"dps_{n}": (f"dps/{file_name(n, a)}", a) for n, a in t.dps.items()} | {f"dpv_{n}": (f"dpv/{file_name(n, a)}", a) for n, a in t.dpv.items()}
    kinds = {r["grp"]: r["dtype"] for r in t.group_names.collect()}
    with parts.folder_of(t.streamlines.sparkSession, path) as folder:
        lines = parts.write(t.streamlines.select("sl_id", "points", *(f"`{c}`" for c in files)), "sl_id", folder, _streamlines(t.dtype, files))
        n, v = parts.total(lines, "n"), parts.total(lines, "v")
        if v > MAX_ID:
            raise FormatError("more vertices than 32-bit offsets hold")
        members = parts.write(t.groups.select("grp", "ord", "sl_id"), ["grp", "ord"], folder, _members(kinds))
        put = _Zip(f"{path}.part", compress_groups) if path.endswith(".trx") else _Folder(work)
        try:
            put.entry(f"positions.3.{t.dtype}", parts.blocks(lines, "positions"))
            put.entry("offsets.uint32", _offsets(parts.blocks(lines, "sizes")))
            for entry, _ in files.values():
                put.entry(entry, parts.blocks(lines, entry))
            for g, d in kinds.items():
                put.entry(f"groups/{g}.{d}", parts.blocks(members, g))
            fields: dict[str, list[bytes]] = {}
            for r in t.dpg.orderBy("grp", "field", "row_idx").toLocalIterator():
                entry = f"dpg/{r['grp']}/{file_name(r['field'], Array(r['dtype'], r['ncols']))}"
                fields.setdefault(entry, []).append(_raw(np.array(r["value"]), r["dtype"]))
            for entry, rows in fields.items():
                put.entry(entry, rows)
            put.entry("header.json", [t.header.dump(n, v).encode()])
        finally:
            put.close()
    if not path.endswith(".trx"):
        if os.path.isdir(path):
            shutil.rmtree(path)
        os.replace(work, path)
        return
    os.replace(f"{path}.part", path)


class _Folder:
    def __init__(self, path: str):
        self.path = path
        os.makedirs(path)

    def entry(self, name: str, blocks: Iterable[bytes]) -> None:
        full = os.path.join(self.path, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.writelines(blocks)

    def close(self) -> None:
        pass


class _Zip:
    def __init__(self, path: str, compress_groups: bool):
        self.zip, self.compress_groups = zipfile.ZipFile(path, "w", zipfile.ZIP_STORED), compress_groups

    def entry(self, name: str, blocks: Iterable[bytes]) -> None:
        info = zipfile.ZipInfo(name, time.localtime()[:6])
        info.external_attr = 0o644 << 16
        info.compress_type = zipfile.ZIP_DEFLATED if self.compress_groups and name.startswith("groups/") else zipfile.ZIP_STORED
        with self.zip.open(info, "w", force_zip64=True) as f:
            for block in blocks:
                f.write(block)

    def close(self) -> None:
        self.zip.close()


def _raw(values: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(values).astype(np.dtype(dtype).newbyteorder("<")).tobytes()


def numbers(column: pa.Array, dtype: str) -> np.ndarray:
    """The numbers of a column, of lists too, as a flat array."""
    while pa.types.is_list(column.type):
        column = column.flatten()
    if column.null_count or pa.types.is_decimal(column.type):
        return np.array(column.to_pylist(), dtype=np.dtype(dtype))
    return column.to_numpy(zero_copy_only=False).astype(np.dtype(dtype))


def flat_points(points: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a batch's streamlines as rows, and how many each has."""
    flat = points.flatten()
    return np.column_stack([flat.field(a).to_numpy(zero_copy_only=False) for a in "xyz"]), np.diff(points.offsets.to_numpy())


def _streamlines(dtype: str, files: dict):
    """Of a batch of streamlines, bytes of each array; sizes stand for offsets, which need what comes before."""

    def encode(batch: pa.RecordBatch) -> parts.Encoded:
        flat, sizes = flat_points(batch.column("points"))
        out = {"positions": _raw(flat.astype(dtype), dtype), "sizes": sizes.astype("<u4").tobytes()}
        for c, (entry, a) in files.items():
            out[entry] = _raw(numbers(batch.column(c), a.dtype), a.dtype)
        return out, {"n": batch.num_rows, "v": int(sizes.sum())}

    return encode


def _members(kinds: dict[str, str]):
    def encode(batch: pa.RecordBatch) -> parts.Encoded:
        names, ids = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("sl_id").to_numpy()
        if not len(names):
            return {}, {}
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        found = zip(names[np.concatenate([[0], cuts])], np.split(ids, cuts), strict=True)
        return {str(name): _raw(part, kinds[name]) for name, part in found if name in kinds}, {}

    return encode


def _offsets(sizes: Iterable[bytes]) -> Iterator[bytes]:
    """Where each streamline begins, and the end, from their sizes."""
    at = 0
    for block in sizes:
        ends = at + np.cumsum(np.frombuffer(block, "<u4"), dtype=np.int64)
        yield np.concatenate([[at], ends[:-1]]).astype("<u4").tobytes()
        at = int(ends[-1])
    yield np.array([at], "<u4").tobytes()


def arrow_in_order(df, key: str | list[str], rows: int = 4096):
    """Arrow batches of a frame in order of a key, one partition of it at a time on the driver.

    Rows are put into Arrow by executors, a row for each batch, in its order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def pack(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = df.sparkSession.conf.get(setting)
    df.sparkSession.conf.set(setting, str(rows))
    try:
        packed = df.orderBy(*([key] if isinstance(key, str) else key)).mapInArrow(pack, "batch binary").toLocalIterator()
    finally:
        df.sparkSession.conf.set(setting, before)
    for row in packed:
        for batch in pa.ipc.open_stream(row[0]):
            yield batch.cast(schema)
