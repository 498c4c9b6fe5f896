"""Python workers live on from stage to stage; what a function has freed goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa

#: Bytes of results after which a function gives freed memory back.
GIVE_BACK_BYTES = 64 << 20


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``function`` for mapInArrow, with memory given back now and then and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        try:
            for batch in function(batches):
                size += batch.nbytes
                yield batch
                if size > GIVE_BACK_BYTES:
                    size = 0
                    _give_back()
        finally:
            _give_back()

    return run
