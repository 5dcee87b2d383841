"""Column functions that take apart file and season names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FORCING_<yyyymmddhh>_<yyyymmddhh>.nc pairs with PRO_<same>.nc.
FORCING_PREFIX = "FORCING"
PROFILE_PREFIX = "PRO"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def profile_name(forcing_name: str | Column) -> Column:
    """Name of the profile file that belongs to a forcing file."""
    name = _col(forcing_name)
    tail = F.substr(name, F.lit(len(FORCING_PREFIX) + 1))
    return F.concat(F.lit(PROFILE_PREFIX), tail)


def season_of_forcing(forcing_name: str | Column) -> Column:
    """``Y1_Y2`` cut out of the two dates in a forcing file name."""
    dates = F.split(_col(forcing_name), "_")
    return F.concat_ws("_", F.substring(dates[1], 1, 4), F.substring(dates[2], 1, 4))


def unit_name(geo: str | Column, season: str | Column, month: str | Column) -> Column:
    return F.concat_ws("_", _col(geo), _col(season), _col(month).cast("string"))


def is_season(season: str | Column) -> Column:
    """Nine characters, two consecutive years."""
    season = _col(season)
    years = F.split(season, "_")
    first, second = (F.get(years, F.lit(k)).try_cast("int") for k in (0, 1))
    return (F.length(season) == 9) & F.coalesce(second == first + 1, F.lit(False))
