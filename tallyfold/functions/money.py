"""Exact money arithmetic: sums run on decimals and leave as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_amount(unit_price: str = "unit_price", discount: str = "discount", quantity: str = "quantity") -> Column:
    """What one order line costs: price less discount, times quantity."""
    return (F.col(unit_price) - F.col(discount)) * F.col(quantity)


def as_number(amount: Column, digits: int = 4) -> Column:
    """An exact decimal as a double. Summing before the cast keeps the result free of row order."""
    return F.round(amount.cast("double"), digits)


def ratio(top: Column, bottom: Column) -> Column:
    """Full quotient as a double, fit for ranking; NULL for an empty or zero denominator instead of an error."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def rounded_ratio(top: Column, bottom: Column, digits: int = 6) -> Column:
    """A quotient that is only shown."""
    return F.round(ratio(top, bottom), digits)
