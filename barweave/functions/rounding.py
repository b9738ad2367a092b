"""Rounding as the queries' SQL does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int = 8) -> Column:
    """x, a double, to places: scaled, rounded half away from zero and scaled back, so that a half is one of the scaled number.

    Spark's own rounding to places takes a half from the number's shortest decimal form, and fractions such as 2.51 / 128 then
    differ by a last digit.  Zero keeps the sign of what was rounded."""
    scale = float(10**places)
    y = (F.col(x) if isinstance(x, str) else x) * scale
    return F.when((y > -0.5) & (y <= 0), y * 0.0).otherwise(F.round(y)) / scale
