"""Ranges of the UUID space."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_START, FULL_END = 0, (1 << 128) - 1


class Range:
    """[start, end) split in near-equal parts; the last part ends at `end`."""

    def __init__(self, start: str, end: str, parts: int):
        low, high = uuid.UUID(start).int, uuid.UUID(end).int
        if low >= high:
            raise ValueError("range start must be below range end")
        if parts < 1:
            raise ValueError("at least one part is needed")
        size = (high - low + 1) // parts
        self.start = str(uuid.UUID(int=low))
        self.splits = [str(uuid.UUID(int=low + size * (i + 1))) for i in range(parts - 1)] + [str(uuid.UUID(int=high))]

    @classmethod
    def full(cls, parts: int) -> Range:
        return cls(str(uuid.UUID(int=FULL_START)), str(uuid.UUID(int=FULL_END)), parts)

    @property
    def extents(self) -> tuple[str, str]:
        return self.start, self.splits[-1]

    def part(self, index: int) -> tuple[str, str]:
        """[from, to) of one part."""
        if not 0 <= index < len(self.splits):
            raise IndexError("no such part")
        return (self.splits[index - 1] if index else self.start), self.splits[index]

    def part_of(self, key: str) -> int:
        if not self.start <= key < self.splits[-1]:
            raise ValueError("id is outside the range")
        return next(i for i, split in enumerate(self.splits) if key < split)

    def column(self, key: Column) -> Column:
        """The part of each id; null outside the range. UUID strings sort as their values do."""
        splits = F.array(*[F.lit(s) for s in self.splits])
        inside = (key >= self.start) & (key < self.splits[-1])
        return F.when(inside, F.size(F.filter(splits, lambda s: s <= key)))
