"""Reachability inside one tile, and memory that Python workers give back."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Free memory of this process returned to the system: Arrow's pool and the C library's heap.

    Workers are used again and wait between stages beside the executor's JVM; what they keep for later counts against its memory.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over one or two tables, or over batches, that gives back free memory before and after."""

    def done(*args):
        give_back()
        try:
            return run(*args)
        finally:
            give_back()

    def batches(rows: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(rows)
        finally:
            give_back()

    if run.__code__.co_flags & 0x20:  # a generator
        return batches
    # Spark counts the arguments.
    return (lambda a: done(a)) if run.__code__.co_argcount == 1 else (lambda a, b: done(a, b))


def reached(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each of n nodes reaches over edges (a, b); rows with equal ids are joined elsewhere."""
    low = ids.copy()
    while n:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        if (low == before).all():
            break
    return low
