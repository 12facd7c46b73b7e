"""What the Python workers of the operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns a worker's free memory to the system, as it lives on beside others; called at the end of tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
