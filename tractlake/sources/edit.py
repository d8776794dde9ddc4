"""Editing containers where they are: adding, replacing and deleting single arrays.

Only the arrays that change are written. A folder gets new files beside the old ones; an archive that only gains entries
is appended to, and any other is copied entry by entry without decoding its arrays. Either way the container is the old
one until the edit is whole.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tractlake.errors import ArgumentError, FormatError
from tractlake.model import Array, dtype_of
from tractlake.sources import parts
from tractlake.sources.trx import Container, file_name, numbers

COPY_BYTES = 1 << 22


@dataclass(frozen=True)
class Put:
    """A new content for an entry, from a file; ``fresh`` ones may not be there yet."""

    entry: str
    source: str
    deflate: bool = False
    fresh: bool = False


@dataclass(frozen=True)
class Delete:
    """An entry, or with a slash at its end all that begin with it; what is not there is passed over."""

    entry: str

    def covers(self, name: str) -> bool:
        return name.startswith(self.entry) if self.entry.endswith("/") else name == self.entry


def apply(path: str, changes: list[Put | Delete]) -> None:
    """All changes to a container, or none. Two that write or delete the same entry are an error."""
    written = [c.entry for c in changes if isinstance(c, Put)]
    if len(set(written)) != len(written):
        raise ArgumentError(f"two changes of one entry: {sorted(written)}")
    gone = [c for c in changes if isinstance(c, Delete)]
    (_edit_folder if os.path.isdir(path) else _edit_archive)(path, [c for c in changes if isinstance(c, Put)], gone)


def _edit_folder(path: str, puts: list[Put], gone: list[Delete]) -> None:
    there = [os.path.relpath(os.path.join(d, f), path).replace(os.sep, "/") for d, _, fs in os.walk(path) for f in fs]
    _refuse_taken(puts, gone, there)
    staged = []
    try:
        for put in puts:
            target = os.path.join(path, put.entry)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            staged.append((f"{target}.new-array", target))
            shutil.copyfile(put.source, staged[-1][0])
    except OSError:
        for new, _ in staged:
            if os.path.exists(new):
                os.remove(new)
        raise
    for new, target in staged:
        os.replace(new, target)
    fresh = {p.entry for p in puts}
    for name in there:
        if name not in fresh and any(d.covers(name) for d in gone):
            os.remove(os.path.join(path, name))
            folder = os.path.dirname(os.path.join(path, name))
            if os.path.dirname(name) and not os.listdir(folder):
                os.rmdir(folder)


def _edit_archive(path: str, puts: list[Put], gone: list[Delete]) -> None:
    with zipfile.ZipFile(path) as z:
        there = z.namelist()
        end = z.start_dir
    _refuse_taken(puts, gone, there)
    fresh = {p.entry for p in puts}
    dropped = {n for n in there if n in fresh or any(d.covers(n) for d in gone)}
    if not dropped:
        if puts:
            _append(path, puts, end)
        return
    part = f"{path}.part"
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(part, "w", allowZip64=True) as new:
        for info in old.infolist():
            if info.filename not in dropped and not info.is_dir():
                with old.open(info) as src, new.open(_like(info), "w", force_zip64=info.file_size >= 1 << 31) as out:
                    shutil.copyfileobj(src, out, COPY_BYTES)
        for put in puts:
            new.write(put.source, put.entry, _method(put))
    os.replace(part, path)


def _append(path: str, puts: list[Put], end: int) -> None:
    """New entries behind the old ones; where that fails, the old directory is put back."""
    with open(path, "rb") as f:
        f.seek(end)
        directory = f.read()
    try:
        with zipfile.ZipFile(path, "a", allowZip64=True) as z:
            for put in puts:
                z.write(put.source, put.entry, _method(put))
    except BaseException:
        with open(path, "r+b") as f:
            f.seek(end)
            f.write(directory)
            f.truncate()
        raise


def _method(put: Put) -> int:
    return zipfile.ZIP_DEFLATED if put.deflate else zipfile.ZIP_STORED


def _like(info: zipfile.ZipInfo) -> zipfile.ZipInfo:
    out = zipfile.ZipInfo(info.filename, info.date_time)
    out.compress_type, out.external_attr = info.compress_type, info.external_attr
    return out


def _refuse_taken(puts: list[Put], gone: list[Delete], there: list[str]) -> None:
    for put in puts:
        if put.fresh and put.entry in there and not any(d.covers(put.entry) for d in gone):
            raise ArgumentError(f"entry '{put.entry}' exists")


# arrays


def _encoded(rows: np.ndarray, array: Array) -> parts.Encoded:
    """Bytes of rows in any shape, how many they are, and the largest whole number."""
    rows = rows.astype(np.dtype(array.dtype).newbyteorder("<")).reshape(-1, array.ncols)
    high = {"max": int(rows.max())} if rows.size and array.dtype not in ("float16", "float32", "float64") else {}
    return {"value": rows.tobytes()}, {"n": len(rows), **high}


def _array(kind: str | Array, values) -> Array:
    if isinstance(kind, Array):
        return kind
    width = np.asarray(values).shape[1] if not isinstance(values, DataFrame) and np.asarray(values).ndim == 2 else 1
    return Array(dtype_of(kind), width)


class _Staged:
    """Arrays written to files of their own before a container is touched."""

    def __init__(self, folder: str):
        self.folder, self.count = folder, 0

    def write(self, values, array: Array) -> tuple[str, int, int]:
        """Path, rows and largest value of numbers given, or of a frame (value, in order of its other columns)."""
        self.count += 1
        path = os.path.join(self.folder, str(self.count))
        if not isinstance(values, DataFrame):
            data, found = _encoded(np.asarray(values), array)
            with open(path, "wb") as out:
                out.write(data["value"])
            return path, found["n"], found.get("max", -1)
        encode = lambda batch: _encoded(numbers(batch.column("value"), array.dtype), array)
        with parts.folder_of(values.sparkSession, path) as folder, open(path, "wb") as out:
            found = parts.write(values, [c for c in values.columns if c != "value"], folder, encode)
            out.writelines(parts.blocks(found, "value"))
        return path, parts.total(found, "n"), parts.total(found, "max", -1)


@contextmanager
def _staging(path: str):
    folder = tempfile.mkdtemp(prefix=".edit-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        yield _Staged(folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _append_arrays(path: str, kind: str, arrays: Mapping, want: int, have: Mapping, overwrite: bool) -> None:
    """Attributes: name to (dtype or Array, values). Names that are there keep their array unless overwritten."""
    with _staging(path) as staged:
        changes: list[Put | Delete] = []
        for name, (dtype, values) in arrays.items():
            _check_name(name)
            if name in have and not overwrite:
                continue
            array = _array(dtype, values)
            source, n, _ = staged.write(values, array)
            if n != want:
                raise ArgumentError(f"{kind.upper()} '{name}' has {n} rows, expected {want}")
            entry = f"{kind}/{file_name(name, array)}"
            if name in have and have[name][0] != entry:
                changes.append(Delete(have[name][0]))
            changes.append(Put(entry, source))
        apply(path, changes)


def _check_name(name: str) -> None:
    if not name or any(c in name for c in "/\\:\0") or name in (".", ".."):
        raise ArgumentError(f"'{name}' can't name an array")


def append_dps(path: str, arrays: Mapping, overwrite: bool = False) -> None:
    """Add attributes of streamlines: name to (dtype or Array, values as numbers or a frame (sl_id, value))."""
    c = Container(path)
    _append_arrays(path, "dps", arrays, c.n_streamlines(), c.dps, overwrite)


def append_dpv(path: str, arrays: Mapping, overwrite: bool = False) -> None:
    """Add attributes of vertices: name to (dtype or Array, values as numbers or a frame (sl_id, v_idx, value))."""
    c = Container(path)
    _append_arrays(path, "dpv", arrays, c.n_vertices(), c.dpv, overwrite)


def append_groups(path: str, groups: Mapping, overwrite: bool = False, deflate: bool = False, dtype: str = "uint32") -> None:
    """Add groups: name to members, as numbers or a frame (ord, value). Members must exist."""
    c = Container(path)
    n, array = c.n_streamlines(), Array(dtype_of(dtype))
    with _staging(path) as staged:
        changes: list[Put | Delete] = []
        for name, members in groups.items():
            _check_name(name)
            if name in c.groups and not overwrite:
                continue
            if not isinstance(members, DataFrame) and len(members) and int(np.min(members)) < 0:
                raise ArgumentError(f"group member {int(np.min(members))} is out of range")
            source, _, high = staged.write(members, array)
            if high >= n:
                raise ArgumentError(f"group member {high} is out of range")
            entry = f"groups/{file_name(name, array)}"
            if name in c.groups and c.groups[name][0] != entry:
                changes.append(Delete(c.groups[name][0]))
            changes.append(Put(entry, source, deflate))
        apply(path, changes)


def append_dpg(path: str, group: str, arrays: Mapping, overwrite: bool = False) -> None:
    """Add attributes of a group, which must exist: name to (dtype or Array, values)."""
    c = Container(path)
    if group not in c.groups:
        raise ArgumentError(f"group '{group}' does not exist")
    have = c.dpg.get(group, {})
    with _staging(path) as staged:
        changes: list[Put | Delete] = []
        for name, (dtype, values) in arrays.items():
            _check_name(name)
            if name in have and not overwrite:
                continue
            array = _array(dtype, values)
            source, n, _ = staged.write(values, array)
            if not n:
                raise FormatError(f"attribute '{name}' of a group has no rows")
            entry = f"dpg/{group}/{file_name(name, array)}"
            if name in have and have[name][0] != entry:
                changes.append(Delete(have[name][0]))
            changes.append(Put(entry, source))
        apply(path, changes)


def delete_dps(path: str, names: list[str]) -> None:
    """Delete attributes of streamlines; unknown names are passed over, here and below."""
    have = Container(path).dps
    apply(path, [Delete(have[n][0]) for n in dict.fromkeys(names) if n in have])


def delete_dpv(path: str, names: list[str]) -> None:
    have = Container(path).dpv
    apply(path, [Delete(have[n][0]) for n in dict.fromkeys(names) if n in have])


def delete_groups(path: str, names: list[str]) -> None:
    """Groups go with their attributes."""
    have = Container(path).groups
    found = [n for n in dict.fromkeys(names) if n in have]
    apply(path, [c for n in found for c in (Delete(have[n][0]), Delete(f"dpg/{n}/"))])


def delete_dpg(path: str, group: str, names: list[str] | None = None) -> None:
    """Attributes of a group: those named, or all without names."""
    have = Container(path).dpg.get(group, {})
    apply(path, [Delete(have[n][0]) for n in dict.fromkeys(names) if n in have] if names else [Delete(f"dpg/{group}/")])
