"""Lots drawn from content: the same for the same seed and row, however rows are partitioned, and in any language."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def lot(seed: int, *columns: str) -> Column:
    """32 hexadecimal digits (MD5) of the columns and the seed, for a random order."""
    return F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary"))


def chance(seed: int | None, *columns: str) -> Column:
    """A number from 0 to 1 (below) for each row, of its content if a seed is given."""
    if seed is None:
        return F.rand()
    return F.conv(F.substring(lot(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def drawn(seed: int, *values: int) -> float:
    """The same number for values on the driver or in a task."""
    return int(hashlib.md5(",".join(map(str, [*values, seed])).encode()).hexdigest()[:13], 16) / (1 << 52)
