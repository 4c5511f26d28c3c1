"""Key bounds: nine combinations, prefixes as ranges, overlap tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

UNBOUNDED, INCLUDED, EXCLUDED = "unbounded", "included", "excluded"


@dataclass(frozen=True)
class Bound:
    """One end of a key range."""

    kind: str = UNBOUNDED
    key: bytes = b""

    @staticmethod
    def included(key: bytes) -> Bound:
        return Bound(INCLUDED, bytes(key))

    @staticmethod
    def excluded(key: bytes) -> Bound:
        return Bound(EXCLUDED, bytes(key))


def prefix_successor(prefix: bytes) -> bytes | None:
    """Smallest key above every key that begins with ``prefix``; None if there is none."""
    stem = bytes(prefix).rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def prefix_bounds(prefix: bytes) -> tuple[Bound, Bound]:
    """The range of a prefix. Plain comparisons reach the Parquet scan; startswith on binary doesn't."""
    end = prefix_successor(prefix)
    return Bound.included(prefix) if prefix else Bound(), Bound() if end is None else Bound.excluded(end)


def within(low: Bound, high: Bound, key: str = "key") -> Column:
    """The predicate of a range; an inverted range is simply empty."""
    c, test = F.col(key), F.lit(True)
    if low.kind != UNBOUNDED:
        test = test & (c >= F.lit(low.key) if low.kind == INCLUDED else c > F.lit(low.key))
    if high.kind != UNBOUNDED:
        test = test & (c <= F.lit(high.key) if high.kind == INCLUDED else c < F.lit(high.key))
    return test


def holds(low: Bound, high: Bound, key: bytes) -> bool:
    """The same test on the driver."""
    above = low.kind == UNBOUNDED or key > low.key or (low.kind == INCLUDED and key == low.key)
    return above and (high.kind == UNBOUNDED or key < high.key or (high.kind == INCLUDED and key == high.key))


def overlaps(low: Bound, high: Bound, least: bytes | None, most: bytes | None) -> bool:
    """Can keys in [least, most] lie in the range? False for an empty run."""
    if least is None or most is None:
        return False
    from_below = low.kind == UNBOUNDED or most > low.key or (low.kind == INCLUDED and most == low.key)
    return from_below and (high.kind == UNBOUNDED or least < high.key or (high.kind == INCLUDED and least == high.key))
