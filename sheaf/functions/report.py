"""Number formats of the printed report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Ratio; null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def percent(ratio: Column) -> Column:
    """Two decimals and a percent sign, without a thousands separator."""
    digits = F.replace(F.format_number(ratio * 100, 2), F.lit(","), F.lit(""))
    return F.concat(digits, F.lit("%"))
