"""Ids: deterministic UUIDs, and even ranges of the UUID space."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO, LAST = uuid.UUID(int=0), uuid.UUID(int=2**128 - 1)


def uuid_of(value: Column) -> Column:
    """A UUID that depends on the value only, so that retries give the same id."""
    h = F.md5(value.cast("string").cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def to_bytes(value: Column) -> Column:
    """16 bytes; null for what is no UUID."""
    raw = F.unhex(F.replace(value, F.lit("-"), F.lit("")))
    return F.when(F.octet_length(raw) == 16, raw)


def from_bytes(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(F.octet_length(raw) == 16, made)


def in_range(value: Column, start: str, end: str) -> Column:
    """``[start, end)``: the end itself is never inside."""
    return (value >= start) & (value < end)


@dataclass(frozen=True)
class Range:
    """``parts`` ranges of equal size from ``start``; the last one ends at ``end``."""

    parts: int
    start: uuid.UUID = ZERO
    end: uuid.UUID = LAST

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ValueError("a range starts below its end")
        if self.parts < 1:
            raise ValueError("a range has one part at least")

    def part(self, i: int) -> tuple[str, str]:
        if not 0 <= i < self.parts:
            raise IndexError("no such part")
        size = (self.end.int - self.start.int + 1) // self.parts
        edge = lambda k: self.end if k == self.parts else uuid.UUID(int=self.start.int + k * size)
        return str(edge(i)), str(edge(i + 1))

    def bounds(self) -> list[tuple[str, str]]:
        return [self.part(i) for i in range(self.parts)]

    def index(self, value: Column) -> Column:
        """The part that a UUID is in, by halving; null outside."""
        edges = self.bounds()

        def within(low: int, high: int) -> Column:
            if high - low == 1:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(value < edges[middle][0], within(low, middle)).otherwise(within(middle, high))

        return F.when(in_range(value, edges[0][0], edges[-1][1]), within(0, self.parts))


def part_of_host(name: Column) -> Column:
    """The number after the last dash of a host name, or null."""
    return F.regexp_extract(name, r"-([0-9]+)$", 1).try_cast("int")


class NoPartitionDataError(LookupError):
    """It isn't known yet how many parts there are."""


def partition_info(host: str, members: Callable[[], Sequence] | int) -> tuple[int, int]:
    """The part of the machine named ``host`` and how many there are.

    ``members`` gives the service's current members, or is their fixed number.
    """
    end = host.rpartition("-")[2]
    if not end.isdecimal():
        raise ValueError(f"no part's number at the end of {host!r}")
    if isinstance(members, int):
        return int(end), members
    try:
        return int(end), len(members())
    except (OSError, LookupError) as e:
        raise NoPartitionDataError(str(e)) from e
