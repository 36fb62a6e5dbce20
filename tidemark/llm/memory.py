"""Memory that a Python worker keeps between tasks, and its return to the system when another operator begins.

Two workers of an executor share its memory with a JVM that never gives its heap back, so a worker that has grown in one
operator is still as large in the next. ``release`` therefore also has arrays allocated so that they go back when freed.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext

#: glibc's mallopt: arrays from a megabyte on are mapped and unmapped one by one (by default that bound rises to 32 MB),
#: a free end of the heap goes back from 8 MB on, and all threads allocate from one heap.
MALLOPT = ((-3, 1 << 20), (-1, 8 << 20), (-8, 1))

_clear: list[Callable[[], None]] = []
_used = False
_settled = False


def on_release(clear: Callable[[], None]) -> None:
    """Call ``clear`` when an operator that has no use for it begins in this worker."""
    _clear.append(clear)


def used() -> None:
    """Say that something is cached now."""
    global _used
    _used = True


def release(keep: Callable[[], None] | None = None) -> None:
    """Empty the caches of other operators, all but the one that ``keep`` clears, and give free memory back."""
    global _used
    if TaskContext.get():
        _settle()
    if _used:
        for clear in _clear:
            if clear != keep:  # a method is another object each time
                clear()
        gc.collect()
    _used = _used and keep is not None
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _settle() -> None:
    """Once in a worker: Arrow and numpy allocate by MALLOPT, and libraries use the one core that a task has."""
    global _settled
    if _settled:
        return
    _settled = True
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        for name, value in MALLOPT:
            mallopt(name, value)
    pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what its threads have freed
    pa.set_cpu_count(1)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
