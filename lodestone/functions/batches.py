"""Pieces of a batch, for tasks that hold little at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def pieces(sizes: Sequence[int], rows: int, total: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive stretches of at most ``rows`` rows whose sizes add up to ``total`` at most; a larger row stands alone."""
    begin, sum_ = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin == rows or sum_ + n > total):
            yield begin, i
            begin, sum_ = i, 0
        sum_ += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)
