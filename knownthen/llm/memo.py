"""A bounded memo of words for the Python side of tasks."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """`memo[word]` computes each word once; emptied when it holds `limit` words, so that memory stays bounded.
    Words over `longest` are not kept."""

    def __init__(self, compute: Callable, limit: int = 400_000, longest: int = 48):
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def slices(batch, rows: int = 256):
    """An Arrow batch in pieces, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
