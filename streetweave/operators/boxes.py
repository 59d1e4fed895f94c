"""Boxes in a grid of many levels. A box lies at the level whose cells are just as wide as it is, so it touches
four cells there at most, whatever its size; joins are equi-joins on (level, cell). Only a counted, bounded number of boxes is
broadcast, to points.

A box has west, south, east and north, edges belong to it. Boxes with a null, or turned inside out, meet nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels by binary exponent; boxes without a size lie at the finest.
FINEST, COARSEST = -40, 60
SIDES = ("west", "south", "east", "north")
#: Boxes that are sent to the points, in four rows at most each.
FEW = 20_000


def _level(west: Column, south: Column, east: Column, north: Column) -> Column:
    size = F.greatest(east - west, north - south)
    return F.when(size <= 2.0**FINEST, F.lit(FINEST)).otherwise(F.least(F.lit(COARSEST), F.ceil(F.log2(size)))).cast("int")


def _whole(boxes: DataFrame) -> DataFrame:
    return boxes.where("west <= east AND south <= north").withColumn("own", _level(*[F.col(c) for c in SIDES]))


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels at which there are boxes: a hundred at most."""
    return sorted(r.own for r in _whole(boxes).select("own").distinct().collect())


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _in_cells(boxes: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """The boxes once for each cell they touch at their own level or, given levels, at these from their own on."""
    rows = _whole(boxes)
    each = F.col("own") if levels is None else F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own")))
    rows = rows.withColumn("level", each)
    rows = rows.withColumn("cx", F.explode(F.sequence(_cell(F.col("west"), F.col("level")), _cell(F.col("east"), F.col("level")))))
    return rows.withColumn("cy", F.explode(F.sequence(_cell(F.col("south"), F.col("level")), _cell(F.col("north"), F.col("level")))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keep: list[str], x: str = "lon", y: str = "lat", few: int = FEW) -> DataFrame:
    """The points with the columns ``keep`` of each box they lie in: a point probes one cell for each level.
    Boxes that are counted to be no more than ``few`` go to the points, so a box that holds most points makes no
    busy task; more of them meet by a join that sorts."""
    found = {r.own: r.n for r in _whole(boxes).groupBy("own").agg(F.count("*").alias("n")).collect()}  # a row for each level
    levels = sorted(found) or [0]
    probes = points.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    probes = probes.withColumn("cx", _cell(F.col(x), F.col("level"))).withColumn("cy", _cell(F.col(y), F.col("level")))
    held = _in_cells(boxes).select("level", "cx", "cy", *SIDES, *[c for c in keep if c not in SIDES])
    held = F.broadcast(held) if sum(found.values()) <= few else held.hint("merge")
    met = probes.join(held, ["level", "cx", "cy"]).where(F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north")))
    return met.drop("level", "cx", "cy", *[c for c in SIDES if c not in keep])


def meeting_boxes(a: DataFrame, b: DataFrame, keep_a: list[str], keep_b: list[str]) -> DataFrame:
    """a_..., b_... for each pair of boxes that share a point: they meet at the level of the larger one, in the
    cell where the south-western corner of what they share lies, so a pair comes once."""
    levels = sorted({*levels_of(a), *levels_of(b)}) or [0]

    def side(boxes: DataFrame, p: str, keep: list[str]) -> DataFrame:
        return _in_cells(boxes, levels).select("level", "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys([*keep, *SIDES, "own"])])

    # a guess of sizes knows neither shapes nor repeated rows, so neither side may be broadcast for it
    met = side(a, "a", keep_a).join(side(b, "b", keep_b).hint("merge"), ["level", "cx", "cy"]).where(F.col("level") == F.greatest("a_own", "b_own"))
    west, south = F.greatest("a_west", "b_west"), F.greatest("a_south", "b_south")
    met = met.where((west <= F.least("a_east", "b_east")) & (south <= F.least("a_north", "b_north")))
    met = met.where((F.col("cx") == _cell(west, F.col("level"))) & (F.col("cy") == _cell(south, F.col("level"))))
    return met.drop("level", "cx", "cy", "a_own", "b_own")
