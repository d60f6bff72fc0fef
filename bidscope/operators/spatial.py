"""Box queries on coordinates by layout.

A listing's coordinates become one number by interleaving their bits (Z-order), and the published table is written in the order of that
number, so a file or row group holds a small area. A box is covered by a bounded number of ranges of the number; a scan filtered by them
skips row groups by their statistics, and the exact bounds decide on what is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import in_bounds

#: Bits of each coordinate: steps of about 0.00001 degrees of latitude.
BITS = 24
#: Ranges that cover a box at most; more fit it closer.
MAX_RANGES = 32
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _step(value, low: float, span: float):
    """The step of a coordinate, for a column or a number; what lies outside is in the outermost step."""
    last = (1 << BITS) - 1
    if isinstance(value, Column):
        return F.least(F.greatest(F.floor((value - low) / span * (1 << BITS)), F.lit(0)), F.lit(last)).cast("long")
    return min(max(int((value - low) / span * (1 << BITS) // 1), 0), last)


def _spread(x: Column) -> Column:
    for by, mask in _MASKS:
        x = (x.bitwiseOR(F.shiftleft(x, by))).bitwiseAND(F.lit(mask))
    return x


def cell(lat="lat", lng="lng") -> Column:
    """The Z-order number of a point; null without coordinates."""
    y, x = _step(F.col(lat), -90.0, 180.0), _step(F.col(lng), -180.0, 360.0)
    return F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)))


def _z(x: int, y: int) -> int:
    return sum(((x >> k & 1) << (2 * k)) | ((y >> k & 1) << (2 * k + 1)) for k in range(BITS))


def box_ranges(south: float, west: float, north: float, east: float, max_ranges: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most ``max_ranges`` ranges of cells (ends included) that hold every point of a box: squares are split, largest first, where
    they are partly outside."""
    if south > north or west > east:
        return []
    y0, y1, x0, x1 = _step(south, -90.0, 180.0), _step(north, -90.0, 180.0), _step(west, -180.0, 360.0), _step(east, -180.0, 360.0)
    inside, partly = [], [(BITS, 0, 0)]
    while partly and len(inside) + len(partly) + 3 <= max_ranges:
        partly.sort()
        level, x, y = partly.pop()
        if not level:
            inside.append((level, x, y))
            continue
        half = 1 << (level - 1)
        for cx, cy in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
            if cx > x1 or cy > y1 or cx + half - 1 < x0 or cy + half - 1 < y0:
                continue
            whole = x0 <= cx and cx + half - 1 <= x1 and y0 <= cy and cy + half - 1 <= y1
            (inside if whole else partly).append((level - 1, cx, cy))
    ranges: list[tuple[int, int]] = []
    for a, b in sorted((_z(x, y), _z(x, y) + (1 << (2 * level)) - 1) for level, x, y in inside + partly):
        if ranges and ranges[-1][1] + 1 == a:
            ranges[-1] = (ranges[-1][0], b)
        else:
            ranges.append((a, b))
    return ranges


def write_by_cell(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write a table with ``lat`` and ``lng`` in the order of its cells (column ``cell``); rows without coordinates come first."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.withColumn("cell", cell()).repartitionByRange(n, "cell").sortWithinPartitions("cell").write.parquet(path)


def boxed(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """C13 on a table of :func:`write_by_cell`: the rows in the box, by ranges of ``cell`` and the exact bounds."""
    ranges = box_ranges(south, west, north, east)
    if not ranges:
        return df.where("false").drop("cell")
    near = F.lit(False)
    for a, b in ranges:
        near = near | F.col("cell").between(a, b)
    return in_bounds(df.where(near), south, west, north, east).drop("cell")
