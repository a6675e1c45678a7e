"""Areas, ratios and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hectares covered by one cell.
CELL_HECTARES = "0.09"


def hectares(cells: Column) -> Column:
    """Exact decimal area of a number of cells."""
    return cells * F.lit(CELL_HECTARES).cast("decimal(2,2)")


def _quotient(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def expanded_share_pct(tight: Column, expanded: Column) -> Column:
    """Percentage of the expanded habitat that the tight habitat lacks."""
    return (1 - _quotient(tight, expanded)) * 100


def growth_pct(tight: Column, expanded: Column) -> Column:
    """Growth from tight to expanded habitat in percent of the tight habitat."""
    return (_quotient(expanded, tight) - 1) * 100


def ratio_pct(part: Column, whole: Column) -> Column:
    return _quotient(part, whole) * 100


def fixed(value: Column, digits: int) -> Column:
    """Text with thousands separators, rounded half away from zero."""
    return F.format_number(F.round(value, digits), digits)


def parse_fixed(text: Column, as_type: str) -> Column:
    """Number written by :func:`fixed`."""
    return F.regexp_replace(F.trim(text), ",", "").cast(as_type)
