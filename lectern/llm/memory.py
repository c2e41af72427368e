"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")


def settled(rows: Iterator[T]) -> Iterator[T]:
    """``rows``; once they are through, what the task has freed goes back to the system, not to the worker's next task."""
    yield from rows
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        return
