"""Memo tables of bounded memory for work on the distinct words of a Python worker.

A worker keeps its tables over the tasks of a stage; the first batch of another stage lets them go. A table counts the bytes of its keys and values; when it is
full it starts anew, so memory has a bound whatever the corpus. Keys and values too large to pay for their
place, such as long texts without blanks, are made each time and not kept.
"""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

from pyspark import TaskContext

ENTRY_BYTES = 100  # of a dictionary's own storage for an entry
LARGEST_BYTES = 1_000  # of a key and its value that are kept


class Memo(dict):
    """key -> make(key), made once; keys and values (strings, bytes, numbers) take ``limit`` bytes at most."""

    def __init__(self, make: Callable, limit: int = 48_000_000):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        size = getsizeof(key) + getsizeof(value)
        if size <= LARGEST_BYTES:
            size += ENTRY_BYTES
            if self.size + size > self.limit:
                self.clear()
                self.size = 0
            self.size += size
            self[key] = value
        return value


_kept: dict = {}  # key -> (stage that used it last, object)


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def per_worker(key: tuple, make: Callable):
    """An object that a Python worker makes once and keeps for the tasks of a stage."""
    made = _kept[key][1] if key in _kept else make()
    _kept[key] = _stage(), made
    return made


def let_go() -> None:
    """Drop what only earlier stages used, so that the next one has a worker's memory for itself."""
    now = _stage()
    for key in [k for k, (stage, _) in _kept.items() if stage != now]:
        del _kept[key]
