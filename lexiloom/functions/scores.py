"""Rating arithmetic (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, HIGHEST = 1, 5
# The colour of each rating.
PALETTE = {1: (139, 0, 0), 2: (255, 0, 0), 3: (255, 165, 0), 4: (144, 238, 144), 5: (0, 100, 0)}


def stars(rating: Column) -> Column:
    """Whole stars: the rating truncated towards zero; null counts as 0."""
    return F.coalesce(rating, F.lit(0.0)).cast("int")


def valid(rating: Column) -> Column:
    return stars(rating).between(LOWEST, HIGHEST)


def clamp(x: Column) -> Column:
    return F.least(F.lit(float(HIGHEST)), F.greatest(F.lit(float(LOWEST)), x))


def colour(average: Column) -> Column:
    """rgb(r,g,0) from red at 1 to green at 5; an unknown average counts as 3."""
    share = (clamp(F.coalesce(average, F.lit(3.0))) - 1) / 4
    return F.format_string("rgb(%d,%d,0)", (255 * (1 - share)).cast("int"), (255 * share).cast("int"))


def sentiment(average: Column, mean: Column) -> Column:
    """Squared distance from the mean with its sign."""
    d = average - mean
    return F.signum(d) * d * d


def dead_zone(error: Column) -> Column:
    """Squared error, 0 where the error is under half a star. Errors are rounded to 9 places first, so that
    the order of a sum doesn't decide at the edge."""
    d = F.round(error, 9)
    return F.when(F.abs(d) >= 0.5, d * d).otherwise(F.lit(0.0))


def whole(prediction: Column) -> Column:
    """Nearest whole star, halves to the even one."""
    return F.bround(F.round(prediction, 9), 0).cast("int")


def agreement(a: Column, b: Column, top: Column) -> Column:
    return 1 - F.abs(a - b) / top
