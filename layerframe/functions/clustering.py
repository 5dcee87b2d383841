"""Order of rows inside a file, so that look-ups on any site column skip most of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(column: str, low: float, width: float, bits: int) -> Column:
    """Number of the equal-width cell a value lies in; ends take what lies beyond, NULL is 0."""
    at = F.floor((F.col(column) - low) / width)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), at)), F.lit(0)).cast("long")


def interleaved(cells: Sequence[tuple[Column, int]]) -> Column:
    """One number from several, their bits taken in turn from the highest down.

    Rows that are near in any of the numbers are near in this one, so the range
    of each within a row group or page stays narrow.
    """
    out, place = F.lit(0).cast("long"), 0
    most = max(bits for _, bits in cells)
    for level in range(most):
        # the lowest bits first; a number with fewer bits ends earlier
        for value, bits in reversed(cells):
            if level < bits:
                bit = F.shiftright(value, level).bitwiseAND(F.lit(1).cast("long"))
                out = out.bitwiseOR(F.shiftleft(bit, place))
                place += 1
    return out


def site_order() -> Column:
    """Altitude, massif, aspect and slope interleaved, at the steps the published sites have."""
    # 300 m, 45 and 20 degrees are the steps between sites; massifs are numbered below 64.
    return interleaved([
        (cell("zs", 0, 300, 4), 4),
        (cell("massif_number", 0, 1, 6), 6),
        (cell("aspect", 0, 45, 3), 3),
        (cell("slope", 0, 20, 2), 2),
    ])
