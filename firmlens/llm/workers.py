"""Memory of Python workers, which outlive their tasks and wait beside an executor's next stage."""

from __future__ import annotations

import ctypes

import pyarrow


def release() -> None:
    """Give memory that a task has freed back to the system; called when its last row is out."""
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
