"""Cosine of the solar zenith angle as one column expression.

Declination and equation of time follow Spencer (1971); the incidence on a
tilted plane follows Duffie and Beckman.  Times are UTC, angles in degrees.
Arguments are SQL expressions, so a whole formula reaches Spark in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spencer's Fourier coefficients, constant term first, then
# (cosine, sine) pairs of the first, second and third harmonic.
DECLINATION = (0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))
EQUATION_OF_TIME = (0.000075, (0.001868, -0.032077), (-0.014615, -0.04089))
MINUTES_PER_RADIAN = 229.18


def _double(value: float) -> str:
    return f"{value!r}D"


def _series(coefficients, angle: str) -> str:
    constant, *harmonics = coefficients
    terms = [_double(constant)]
    for k, (c, s) in enumerate(harmonics, start=1):
        terms.append(f"{_double(c)} * cos({k} * {angle}) + {_double(s)} * sin({k} * {angle})")
    return "(" + " + ".join(terms) + ")"


def _year_angle(time: str) -> str:
    return f"((dayofyear({time}) - 1) * 2 * pi() / 365)"


def declination(time: str) -> str:
    return _series(DECLINATION, _year_angle(time))


def equation_of_time(time: str) -> str:
    """Apparent minus mean solar time, in minutes."""
    return f"({_double(MINUTES_PER_RADIAN)} * {_series(EQUATION_OF_TIME, _year_angle(time))})"


def hour_angle(time: str, lon: str) -> str:
    solar = f"hour({time}) + minute({time}) / 60D + (4 * {lon} + {equation_of_time(time)}) / 60D"
    return f"radians(15 * ({solar} - 12))"


def cos_sza(
    time: str = "time",
    lat: str = "lat",
    lon: str = "lon",
    slope: str | None = None,
    aspect: str | None = None,
) -> Column:
    """Horizontal cosine, or the cosine of incidence when slope and aspect are given."""
    delta, omega, phi = declination(time), hour_angle(time, lon), f"radians({lat})"
    upright = f"sin({delta}) * sin({phi}) + cos({delta}) * cos({phi}) * cos({omega})"
    if slope is None or aspect is None:
        return F.expr(upright)
    beta, gamma = f"radians({slope})", f"radians({aspect} - 180)"
    north_south = f"cos({delta}) * sin({phi}) * cos({omega}) - sin({delta}) * cos({phi})"
    east_west = f"cos({delta}) * sin({omega})"
    return F.expr(
        f"({upright}) * cos({beta})"
        f" + sin({beta}) * (({north_south}) * cos({gamma}) + {east_west} * sin({gamma}))"
    )
