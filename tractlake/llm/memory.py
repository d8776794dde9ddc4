"""Memory that a process has freed but not given back."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system: allocators keep the peak of what a process once held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function over batches that trims its process when it is done: idle Python workers count as an executor's memory."""

    def out(batches):
        yield from run(batches)
        trim()

    return out
