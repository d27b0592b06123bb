"""Giving memory back at the end of a Python task.

Workers are reused by later stages, whatever those are; what one task has freed
stays with the allocators unless it is asked for.
"""

from __future__ import annotations

import ctypes
import gc


def release() -> None:
    """Return freed memory of Python, Arrow and the C library to the system."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
