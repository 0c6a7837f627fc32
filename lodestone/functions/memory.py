"""Keeping Python workers small: they are reused, so what one batch leaves allocated stays for the next stage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL(None)
        library.malloc_trim
        return library
    except (OSError, AttributeError):  # not glibc
        return None


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if library := _libc():
        library.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A batch function that gives freed memory back when it begins and after its last batch."""

    def own(batches: Iterator) -> Iterator:
        trim()
        yield from run(batches)
        trim()

    return own
