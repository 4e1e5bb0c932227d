"""Memory of Python workers, which Spark uses again for one stage after another."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

from . import words


def fresh() -> None:
    """Give back what earlier stages left in this worker: the tokenizer with its words, and memory that is free but held by allocators. Stages that
    don't tokenise call it as a task begins; else an executor holds what every stage needs at the same time."""
    words.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)
