"""Coordinates: snapping, boxes, named regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]

# Where a ridge or trough is said to sit, as (name, latitude from, to,
# longitude from, to), specific regions before broad ones.
NAMED_REGIONS: list[tuple[str, float, float, float, float]] = [
    ("Iceland", 62, 68, -26, -12),
    ("the Norwegian Sea", 62, 74, -12, 4),
    ("the Barents Sea", 68, 74, 15, 40),
    ("the British Isles", 49.5, 61, -11, 2),
    ("the North Sea", 53, 62, 2, 8),
    ("Scandinavia", 58, 72, 4, 32),
    ("the Baltic", 53, 58, 8, 30),
    ("the Alps", 45, 48, 6, 16),
    ("France", 43, 51, -5, 8),
    ("Iberia", 36, 44, -10, 4),
    ("Italy", 37, 45, 7, 19),
    ("Central Europe", 47, 55, 5, 19),
    ("the Balkans", 39, 47, 18, 29),
    ("the Black Sea", 40, 47, 27, 42),
    ("Turkey", 36, 42, 26, 42),
    ("the eastern Mediterranean", 30, 40, 22, 36),
    ("the central Mediterranean", 32, 40, 8, 22),
    ("the western Mediterranean", 35, 43, -2, 10),
    ("Eastern Europe", 45, 60, 19, 40),
    ("North Africa", 30, 36, -10, 30),
    ("the Atlantic west of Iberia", 30, 45, -30, -10),
    ("the Atlantic west of Ireland", 45, 62, -30, -11),
    ("the North Atlantic", 30, 74, -30, 40),
]


def snap_coord(c: Column, res: float) -> Column:
    """Coordinate onto the grid of step ``res`` so that float keys join."""
    return F.round(c.cast("double") / res) * res


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    la0, la1, lo0, lo1 = box
    return lat.between(la0, la1) & lon.between(lo0, lo1)


def bbox_area(lat: Column, lon: Column, boxes: Mapping[str, Box]) -> Column:
    """Code of the first box that holds the point."""
    out = None
    for code, box in boxes.items():
        hit = in_box(lat, lon, box)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def coordinate_text(lat: Column, lon: Column) -> Column:
    return F.concat(F.bround(F.abs(lat)).cast("int").cast("string"), F.lit("°"),
                    F.when(lat >= 0, "N").otherwise("S"), F.lit(" "),
                    F.bround(F.abs(lon)).cast("int").cast("string"), F.lit("°"),
                    F.when(lon >= 0, "E").otherwise("W"))


def named_region(lat: Column, lon: Column,
                 regions: Sequence[tuple[str, float, float, float, float]] = NAMED_REGIONS) -> Column:
    return F.coalesce(bbox_area(lat, lon, {r[0]: r[1:] for r in regions}), coordinate_text(lat, lon))
