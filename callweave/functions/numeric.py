"""Rounding, ladders and decibels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady(value: Column, digits: int) -> Column:
    """Round half up after removing summation noise below 1e-10.

    Partial sums arrive in any order, so a value that sits on a rounding tie could fall on either
    side of it from run to run. Dropping the noise first makes the result independent of the order.
    """
    return F.round(F.round(value.cast("double"), 10), digits)


def ladder(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First step whose lower bound the value reaches, in the order given."""
    out = None
    for bound, result in steps:
        hit = value >= F.lit(bound)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def decibels(signal: Column, noise: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(signal, F.lit(floor)) / F.greatest(noise, F.lit(floor)))


def block_of(index: Column, rows: int) -> Column:
    """Number of the block of ``rows`` consecutive positions that ``index`` falls into."""
    return F.floor(index / F.lit(rows)).cast("long")
