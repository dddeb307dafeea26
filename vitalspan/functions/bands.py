"""Health-band coding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three health bands, unhealthy ones first.
LOW_BANDS = ("Red", "Yellow")
HIGH_BAND = "Green"

# Change types and their report order.
CHANGE_ORDER = {
    "Stayed Red/Yellow": 1,
    "Green to Red/Yellow": 2,
    "Red/Yellow to Green": 3,
    "Stayed Green": 4,
}


def band_code(band: Column, low: int = 1, high: int = 2) -> Column:
    """``low`` for an unhealthy band, ``high`` for a healthy one, NULL for any other text."""
    return F.when(band.isin(*LOW_BANDS), low).when(band == HIGH_BAND, high)


def change_outcome(code: Column, lowest: Column, highest: Column, green, other) -> Column:
    """Pick from ``green``/``other`` = (stayed, moved) by comparing a code with what follows.

    A healthy row is compared with the lowest later code; any other row, a NULL code
    included, with the highest. No later code at all gives NULL.
    """

    def settle(later: Column, stayed, moved) -> Column:
        return F.when(later.isNull(), F.lit(None)).when(code == later, stayed).otherwise(moved)

    return F.when(code == 2, settle(lowest, *green)).otherwise(settle(highest, *other))


def change_order(change_type: Column) -> Column:
    order = None
    for name, rank in CHANGE_ORDER.items():
        hit = change_type == name
        order = F.when(hit, rank) if order is None else order.when(hit, rank)
    return order
