"""Giving memory back between tasks: Python workers stay after their task, and several share an executor."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc

import pyarrow as pa


def release() -> None:
    """Free what is no longer used and return it to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c") or "libc.so.6"
    try:
        ctypes.CDLL(name).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        return
