"""Expressions over species, submodel, season and region codes.

A submodel code is ``<species>-<season letter><region digit>``. Species codes
have a fixed width; six characters unless the caller says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UC_WIDTH = 6

# Season letters and region digits of a submodel code.
SEASON_NAMES = {"y": "year-round", "s": "summer", "w": "winter"}
REGION_NAMES = {
    "1": "Northwest",
    "2": "Upper Midwest",
    "3": "Northeast",
    "4": "Southwest",
    "5": "Great Plains",
    "6": "Southeast",
}

# Season codes of a range record.
RANGE_SEASONS = {1: "Y", 3: "W", 4: "S"}

# One bit per submodel season. A year-round range serves every season, so it
# carries all bits; "some season of the submodel lies in range" is then a
# bitwise AND instead of one row per season and a DISTINCT afterwards.
SEASON_BITS = {"S": 1, "W": 2, "Y": 4}
ALL_SEASONS = 7


def fold(code: Column | str) -> Column:
    """Form of a code in which case and trailing blanks do not matter."""
    return F.lower(F.rtrim(F.col(code) if isinstance(code, str) else code))


def species_part(smc: Column, width: int = UC_WIDTH) -> Column:
    return F.substring(smc, 1, width)


def submodel_code(uc: Column, season: Column, region: Column) -> Column:
    return F.concat(uc, F.lit("-"), season, region.cast("string"))


def _decode(value: Column, names: dict) -> Column:
    first, *rest = names.items()
    return reduce(
        lambda chain, item: chain.when(value == item[0], item[1]),
        rest,
        F.when(value == first[0], first[1]),
    )


def season_name(smc: Column, width: int = UC_WIDTH) -> Column:
    """Season named by the letter after the dash, null for any other letter."""
    return _decode(F.lower(F.substring(smc, width + 2, 1)), SEASON_NAMES)


def region_name(smc: Column, width: int = UC_WIDTH) -> Column:
    """Region named by the digit after the season letter, null for any other."""
    return _decode(F.substring(smc, width + 3, 1), REGION_NAMES)


def range_season(seas: Column) -> Column:
    return _decode(seas, RANGE_SEASONS).otherwise("x")


def season_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def submodel_season_bit(code: Column) -> Column:
    return _decode(season_code(code), SEASON_BITS)


def range_season_bits(code: Column) -> Column:
    return _decode(season_code(code), {**SEASON_BITS, "Y": ALL_SEASONS})
