"""Joins on numbers that lie within a distance of each other."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, distance: Decimal | int, also: tuple[str, str] | None = None) -> DataFrame:
    """Pairs with abs(left_key - right_key) <= distance, as an equi-join; also: a column of each side that must be equal too, and goes.

    For a distance of 0 the keys are joined as they are. Otherwise both sides
    are dealt to stripes as wide as the distance; the right side, meant to be
    the smaller, stands in its own stripe and both neighbours, so each pair
    meets once, and the exact predicate decides. Plans as a hash or sort-merge
    join, never as a product of the sides.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    same = F.col(also[0]) == F.col(also[1]) if also else F.lit(True)
    gone = also or ()
    if not distance:
        return left.join(right, (left[left_key] == right[right_key]) & same).drop(*gone)
    width = F.lit(Decimal(distance)).cast("decimal(18,6)")
    stripe = lambda c: F.floor(c / width).cast("bigint")
    a = left.withColumn("_stripe", stripe(F.col(left_key)))
    b = right.withColumn("_near", F.explode(F.sequence(stripe(F.col(right_key)) - 1, stripe(F.col(right_key)) + 1)))
    met = a.join(b, (a["_stripe"] == b["_near"]) & same).drop(*gone)
    return met.where(F.abs(F.col(left_key) - F.col(right_key)) <= F.lit(Decimal(distance))).drop("_stripe", "_near")
