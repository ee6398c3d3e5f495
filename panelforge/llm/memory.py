"""What a worker holds of Arrow batches at once, and what it gives back to the system.

Workers of Python serve many tasks, of any stage and query, and stand beside the JVM in an executor's memory.  So batches
are worked on in slices, and what a task has freed goes back to the system instead of staying with the worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext

#: Bytes of a slice, on average over its batch.
SLICE_BYTES = 4 << 20
_seen: list[int | None] = [None]


def release() -> None:
    """Free memory that allocators keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def begin_task() -> None:
    """Once in a task: give back what the tasks before have left."""
    task = TaskContext.get()
    if task and task.taskAttemptId() != _seen[0]:
        _seen[0] = task.taskAttemptId()
        release()


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in their order, by slices of about ``most`` bytes."""
    begin_task()
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
    release()
