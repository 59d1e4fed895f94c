"""Joins and choices by position. All radius joins go through one grid: an equi-join on cells, then the
exact distance; nothing compares all pairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetweave.functions.geo import angle_between, bearing_deg, haversine_m
from streetweave.operators.boxes import points_in_boxes
from streetweave.operators.dealing import dealt
from streetweave.operators.ranks import ranked

# Radii in metres, neighbours kept, angles and distances of a good view, tile scale.
NEAR_M, NEAR_K, TRACK_M, LOAD_M, SHIFT_M = 45.0, 7, (1.0, 30.0), 140.0, 50.0
AOV_DEG, VIEW_M, VIEWS_PER_BUILDING = (10.0, 120.0), 50.0, 5
M_PER_DEG_LAT, M_PER_DEG_LON, CELL_DEG = 110_574.0, 111_320.0, 0.001
#: Degrees of latitude whose cells share one width in degrees of longitude.
BAND_DEG = 1.0
#: Width of a cell of a radius join, in radii.
CELL_RADII = 4.0
#: Pairs of a radius join that a task sorts, where they are sorted.
PAIRS_PER_TASK = 2_000_000
#: Rounds of thinning whose dropped captures are read from as many tables.
ROUNDS_READ = 16
#: Levels of the cells in space that the search for far captures goes down: cells of level n are 19,113 km / 2^n wide.
SPACE_LEVELS = (3, 6, 9, 12, 15, 18)


def _lat_cell(lat: Column, cell_m: float) -> Column:
    return F.floor((lat + 90) * (111_000.0 / cell_m))


def _lon_place(lat_row: Column, lon: Column, cell_m: float) -> Column:
    """The place in the row, in cells; their width is that of the whole row's band, so neighbours in a row agree."""
    band_edge = F.abs((lat_row + 1) * (cell_m / 111_000.0) - 90) + F.lit(2 * cell_m / 111_000.0)
    width = F.lit(cell_m) / (F.lit(111_000.0) * F.greatest(F.cos(F.radians(F.least(F.ceil(band_edge / BAND_DEG) * BAND_DEG, F.lit(89.0)))), F.lit(0.01)))
    return (lon + 180) / width


def with_cell(points: DataFrame, cell_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The points with their cell (``cy``, ``cx``)."""
    rows = points.withColumn("cy", _lat_cell(F.col(lat), cell_m))
    return rows.withColumn("cx", F.floor(_lon_place(F.col("cy"), F.col(lon), cell_m)))


def with_reached_cells(points: DataFrame, cell_m: float, reach_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point once for every cell that can hold a point within ``reach_m`` of it."""
    share = reach_m / cell_m
    y = (F.col(lat) + 90) * (111_000.0 / cell_m)
    rows = points.withColumn("cy", F.explode(F.sequence(F.floor(y - share), F.floor(y + share))))
    x = _lon_place(F.col("cy"), F.col(lon), cell_m)
    return rows.withColumn("cx", F.explode(F.sequence(F.floor(x - share), F.floor(x + share))))


def pair_tasks(a: DataFrame, b: DataFrame, radius_m: float, per_task: int = PAIRS_PER_TASK) -> int:
    """How many tasks a radius join takes if each makes about so many pairs, which are counted by cells: sizes of
    the rows that are exchanged don't tell. At least as many as the session runs at once."""
    cell_m = CELL_RADII * radius_m
    n, m = (with_cell(x.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon"), cell_m).groupBy("cy", "cx").agg(F.count("*").alias(c)) for x, c in ((a, "n"), (b, "m")))
    # a row meets those of its cell and of what the radius adds around it, and of these the share within the circle
    pairs = math.pi / CELL_RADII**2 * (n.join(m.hint("merge"), ["cy", "cx"]).agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("p")).first().p or 0.0)
    return max(a.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / per_task))


def radius_join(a: DataFrame, b: DataFrame, radius_m: float, a_keys: list[str], b_keys: list[str], same: tuple[str, ...] = (), tasks: int | None = None, first: Column | None = None) -> DataFrame:
    """a_keys, b_keys as b_<key>, lat, lon, b_lat, b_lon, distance_m of all pairs within the radius. A row of ``a``
    lies in one cell, where it meets all it can, so what is kept for each row is chosen before it is exchanged;
    a row of ``b`` goes to the cells its radius touches, 2.25 on average. The join sorts: sizes that the planner
    guesses don't tell how often rows are repeated, so it would broadcast. Adaptive execution splits busy cells.
    ``same`` names columns of both sides that have to be equal; they come once. Where pairs are sorted after this,
    ``tasks`` (:func:`pair_tasks`) deals the cells to so many tasks that the pairs of each fit its memory.
    ``first`` is asked of a pair before its distance, which costs more than all else here."""
    cell_m = CELL_RADII * radius_m
    left = with_cell(a.where("lat IS NOT NULL AND lon IS NOT NULL").select(*a_keys, *same, "lat", "lon"), cell_m)
    right = b.where("lat IS NOT NULL AND lon IS NOT NULL").select(*[F.col(k).alias(f"b_{k}") for k in b_keys], *same, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    right = with_reached_cells(right, cell_m, radius_m, "b_lat", "b_lon")
    if tasks is not None:
        left, right = left.repartition(tasks, "cy", "cx", *same), right.repartition(tasks, "cy", "cx", *same)
    met = left.join(right.hint("merge"), ["cy", "cx", *same]).drop("cy", "cx")
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    near = (F.abs(F.col("lat") - F.col("b_lat")) <= radius_m / 111_000.0) & (distance <= radius_m)
    return met.where(near if first is None else first & near).withColumn("distance_m", distance)


def nearby(captures: DataFrame, radius_m: float = NEAR_M, k: int = NEAR_K) -> DataFrame:
    """image_id, other_id, distance_m, rn: each capture's k nearest, itself at distance nought."""
    pairs = radius_join(captures, captures, radius_m, ["image_id"], ["image_id"], tasks=pair_tasks(captures, captures, radius_m))
    own = F.when(F.col("image_id") == F.col("b_image_id"), 0.0).otherwise(F.col("distance_m"))
    rows = pairs.select("image_id", F.col("b_image_id").alias("other_id"), own.alias("distance_m"))
    order = Window.partitionBy("image_id").orderBy("distance_m", "other_id")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def track_neighbours(captures: DataFrame, max_m: float = TRACK_M[1]) -> DataFrame:
    """Pairs of captures from one metre to the limit apart that may follow one another, with bearing:
    different known sequences never connect."""
    pairs = radius_join(captures, captures, max_m, ["image_id", "sequence_id"], ["image_id", "sequence_id"])
    apart = F.col("sequence_id").isNotNull() & F.col("b_sequence_id").isNotNull() & (F.col("sequence_id") != F.col("b_sequence_id"))
    kept = pairs.where((F.col("image_id") != F.col("b_image_id")) & ~apart & (F.col("distance_m") >= TRACK_M[0]))
    bearing = bearing_deg(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    return kept.select("image_id", F.col("b_image_id").alias("other_id"), "distance_m", bearing.alias("bearing"))


def nearest_by_bearing(neighbours: DataFrame, min_deg: float = 10.0) -> DataFrame:
    """Of each capture's neighbours, nearest first, those at least ``min_deg`` away from all taken."""
    sorted_ = F.array_sort(F.collect_list(F.struct("distance_m", "other_id", "bearing")))
    none = F.array().cast("array<struct<distance_m:double,other_id:string,bearing:double>>")

    def take(kept: Column, x: Column) -> Column:
        free = F.forall(kept, lambda o: angle_between(x["bearing"], o["bearing"]) >= min_deg)
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    rows = neighbours.groupBy("image_id").agg(F.aggregate(sorted_, none, take).alias("kept"))
    return rows.select("image_id", F.explode("kept").alias("n")).select("image_id", "n.other_id", "n.distance_m", "n.bearing")


def affected_captures(captures: DataFrame, changed: DataFrame, radius_m: float = LOAD_M + SHIFT_M) -> DataFrame:
    """Captures that load a changed footprint: its centre lies within the radius."""
    pairs = radius_join(captures, changed, radius_m, ["image_id"], ["building_id"])
    return captures.join(pairs.select("image_id").distinct(), "image_id", "left_semi")


def reassociation_worklist(captures: DataFrame, changed: DataFrame, analyses: DataFrame) -> DataFrame:
    """Affected captures with a heading that have an analysis."""
    return affected_captures(captures.where("heading IS NOT NULL"), changed).join(analyses.select("image_id").distinct(), "image_id", "left_semi")


def nearest_capture(points: DataFrame, captures: DataFrame, radius_m: float, land=None) -> DataFrame:
    """point_id, image_id, distance_m: the nearest capture of each point that has a position, however far it is.
    Distances that agree to six places are ties, which go to the smaller id. Captures within the radius come from
    the grid join; points that have none there look farther. ``land`` writes what was found within the radius and
    reads it back, since it is used twice."""
    pairs = radius_join(points, captures, radius_m, ["point_id"], ["image_id"], tasks=pair_tasks(points, captures, radius_m))
    found = _nearest(pairs)
    found = found if land is None else land(found)
    missed = points.join(found.select("point_id").hint("merge"), "point_id", "left_anti")
    return _nearest(found.withColumnRenamed("image_id", "b_image_id").unionByName(_nearest(_farther(missed, captures)).withColumnRenamed("image_id", "b_image_id")))


def _nearest(pairs: DataFrame) -> DataFrame:
    best = F.min(F.struct(F.round("distance_m", 6).alias("about"), F.col("b_image_id").alias("image_id"), "distance_m")).alias("n")
    return pairs.groupBy("point_id").agg(best).select("point_id", "n.image_id", "n.distance_m")


def _farther(points: DataFrame, captures: DataFrame) -> DataFrame:
    """point_id, b_image_id, distance_m: the captures that may be the nearest of a point, among them the nearest.

    Positions are points of the unit sphere, captures lie in cells of space of several levels. A point goes from
    the whole down to ever smaller cells that hold captures; at each level it keeps those whose box of captures
    begins no farther off than some other box ends."""
    axes, cell = ("x", "y", "z"), ("cx", "cy", "cz")
    finest = SPACE_LEVELS[-1]

    def placed(rows: DataFrame) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        there = rows.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
        return there.withColumn("x", F.cos(lat) * F.cos(lon)).withColumn("y", F.cos(lat) * F.sin(lon)).withColumn("z", F.sin(lat))

    there = placed(captures.select("image_id", "lat", "lon"))
    there = there.select(F.col("image_id").alias("b_image_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), *axes, *[F.floor((F.col(a) + 1.5) / 3 * 2**finest).alias(c) for a, c in zip(axes, cell, strict=True)])
    boxes = there.groupBy(*cell).agg(*[f(a).alias(f"{a}_{f.__name__}") for a in axes for f in (F.min, F.max)])
    rows = placed(points.select("point_id", "lat", "lon")).select("*", *[F.lit(0).cast("long").alias(c) for c in cell])
    above = 0
    for level in SPACE_LEVELS:
        at = boxes.groupBy(*[F.shiftright(c, finest - level).alias(c) for c in cell]).agg(*[f(f"{a}_{f.__name__}").alias(f"{a}_{f.__name__}") for a in axes for f in (F.min, F.max)])
        at = at.select("*", *[F.shiftright(c, level - above).alias(f"up_{c}") for c in cell])
        ups = [f"up_{c}" for c in cell]
        # few bytes meet to many rows here
        met = dealt(rows.withColumnsRenamed(dict(zip(cell, ups, strict=True))), *ups).join(dealt(at, *ups).hint("merge"), ups)
        low = sum((F.pow(F.greatest(F.col(f"{a}_min") - F.col(a), F.col(a) - F.col(f"{a}_max"), F.lit(0.0)), F.lit(2.0)) for a in axes), F.lit(0.0))
        high = sum((F.pow(F.greatest(F.col(a) - F.col(f"{a}_min"), F.col(f"{a}_max") - F.col(a)), F.lit(2.0)) for a in axes), F.lit(0.0))
        met = met.select("point_id", "lat", "lon", *axes, *cell, *ups, F.sqrt(low).alias("low"), F.sqrt(high).alias("high"))
        # first among the cells of one cell above, which lie together, then among what is left of all; the margin is
        # some micrometres, for ties and the last bits of positions
        for told in (["point_id", *ups], ["point_id"]):
            met = met.withColumn("end", F.min("high").over(Window.partitionBy(*told))).where(F.col("low") <= F.col("end") + 1e-12).drop("end", *told[1:])
        rows, above = met.drop("low", "high"), level
    met = rows.drop(*axes).join(there.drop(*axes).hint("merge"), list(cell))
    return met.select("point_id", "b_image_id", haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")).alias("distance_m"))


def select_panoramas(visibility: DataFrame, aov: tuple[float, float] = AOV_DEG, max_m: float = VIEW_M, n: int = VIEWS_PER_BUILDING) -> DataFrame:
    """building_id, image_id, rn of the widest acceptable views of each building."""
    good = visibility.where(F.col("aov_deg").between(*aov) & (F.col("distance_m") <= max_m))
    order = Window.partitionBy("building_id").orderBy(F.desc("aov_deg"), "distance_m", "image_id")
    return good.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("building_id", "image_id", "rn")


def expected_views(visibility: DataFrame, surveyed: DataFrame, max_m: float = VIEW_M) -> DataFrame:
    """building_id, image_id: which surveyed captures should show a building."""
    return visibility.where(F.col("distance_m") <= max_m).join(surveyed.select("image_id").distinct(), "image_id", "left_semi").select("building_id", "image_id")


def smallest_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """point_id and region of the smallest box around each point, however many boxes there are."""
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    met = points_in_boxes(points.select("point_id", "lon", "lat"), regions.withColumn("area", area), ["region", "area"])
    # the least of rows with texts is found by sorting: after the exchange, in parts of even size, not in whole splits before it
    return met.select("point_id", "area", "region").repartition("point_id").groupBy("point_id").agg(F.min(F.struct("area", "region")).alias("m")).select("point_id", "m.region")


def region_at(points: DataFrame, boxes: DataFrame, excluded: DataFrame, key: str = "image_id") -> DataFrame:
    """The points, told apart by ``key``, inside any box and outside all excluded ones."""
    places = points.select(key, "lon", "lat")
    inside, out = (points_in_boxes(places, b, []).select(key).distinct() for b in (boxes, excluded))
    return points.join(inside, key, "left_semi").join(out, key, "left_anti")


def plan_tiles(captures: DataFrame, tile_m: float = 250.0) -> DataFrame:
    """row, col, images, place of the tiles that hold captures, in serpentine order from the south-west."""
    box = captures.agg(F.min("lon").alias("w"), F.min("lat").alias("s")).first()
    if box.w is None:
        box_w, box_s = 0.0, 0.0
    else:
        box_w, box_s = box.w, box.s
    scale = M_PER_DEG_LON * math.cos(math.radians(box_s))
    cells = captures.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.floor((F.col("lat") - box_s) * M_PER_DEG_LAT / tile_m).alias("row"), F.floor((F.col("lon") - box_w) * scale / tile_m).alias("col")
    )
    tiles = cells.groupBy("row", "col").agg(F.count("*").alias("images"))
    # rows of tiles are few: the square root of the area, so ranking them alone is cheap
    rows = tiles.select("row").distinct().withColumn("turn", F.row_number().over(Window.orderBy("row")) - 1)
    ordered = tiles.join(F.broadcast(rows), "row").withColumn("key", F.when(F.col("turn") % 2 == 0, F.col("col")).otherwise(-F.col("col")))
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy("key"))).select("row", "col", "images", "turn", "place")


def area_cells(captures: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """cy, cx of the grid cells that hold a capture, with one cell around."""
    own = captures.select(F.floor(F.col("lat") / cell).alias("y"), F.floor(F.col("lon") / cell).alias("x")).distinct()
    rows = own.select(F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("cy"), "x")
    return rows.select("cy", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("cx")).distinct()


def extent(captures: DataFrame, margin: float = 0.003) -> DataFrame:
    return captures.groupBy("dataset").agg(
        (F.min("lon") - margin).alias("west"), (F.min("lat") - margin).alias("south"), (F.max("lon") + margin).alias("east"), (F.max("lat") + margin).alias("north")
    )


def median_position(captures: DataFrame, land) -> DataFrame:
    """dataset, lon, lat: the upper middle value of each. ``land`` writes a table and reads it back."""

    def middle(c: str) -> DataFrame:
        there = captures.where(F.col(c).isNotNull()).select("dataset", c)
        n = there.groupBy("dataset").agg((F.floor(F.count("*") / 2) + 1).alias("rn"))
        return ranked(there, ["dataset"], [F.col(c)], land).join(n, ["dataset", "rn"]).select("dataset", c)

    return middle("lon").join(middle("lat"), "dataset")


def bbox_around(lat: Column, lon: Column, radius_m: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) around a point."""
    dlat = radius_m / M_PER_DEG_LON
    dlon = dlat / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def tile_bbox(boxes: DataFrame, max_area: float) -> DataFrame:
    """The boxes cut into equal parts, each no larger than ``max_area`` square degrees."""
    parts = F.ceil(F.sqrt((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")) / max_area))
    parts = F.greatest(parts, F.lit(1))
    dx, dy = (F.col("east") - F.col("west")) / F.col("__n"), (F.col("north") - F.col("south")) / F.col("__n")
    rows = boxes.withColumn("__n", parts).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    keep = [c for c in boxes.columns if c not in ("west", "south", "east", "north")]
    return rows.select(
        *keep, "i", "j",
        (F.col("west") + F.col("i") * dx).alias("west"), (F.col("south") + F.col("j") * dy).alias("south"),
        (F.col("west") + (F.col("i") + 1) * dx).alias("east"), (F.col("south") + (F.col("j") + 1) * dy).alias("north"),
    )


def plan_tour(summary: DataFrame, order: DataFrame, least: float, fallback: int = 3) -> DataFrame:
    """building_id, place: buildings of a curated route that score enough, in its order; without any, the
    best few by score."""
    routed = order.join(summary.where(F.col("score") >= least), "building_id").select("building_id", F.col("place").cast("long").alias("place"))
    best = summary.orderBy(F.desc("score"), "building_id").limit(fallback)
    numbered = best.select("building_id", F.row_number().over(Window.orderBy(F.desc("score"), "building_id")).cast("long").alias("place"))
    return routed.union(numbered.where(F.lit(routed.isEmpty())))


def far_captures(points: DataFrame, kept: DataFrame | None, spacing_m: float, land) -> DataFrame:
    """The points (image_id, captured_at_ms, lat, lon; no id twice), landed before, that stay if one goes through
    them from the earliest and keeps each that is at least the spacing away from ``kept`` (image_id, lat, lon)
    and from all points kept before.

    Conflicting pairs come from the grid join. In rounds, a point all of whose earlier rivals are dropped is
    kept, and one with a kept rival is dropped; that fixpoint is the sequential result."""
    mine = points.select("image_id", F.coalesce("captured_at_ms", F.lit(0)).alias("t"), "lat", "lon")
    others = mine.withColumn("old", F.lit(False))
    if kept is not None:
        others = others.union(kept.select("image_id", F.lit(0).cast("long").alias("t"), "lat", "lon", F.lit(True).alias("old")))
    same_time = (F.col("t") == F.col("b_t")) & (F.col("image_id") > F.col("b_image_id"))
    pairs = radius_join(mine, others, spacing_m, ["image_id", "t"], ["image_id", "t", "old"], first=F.col("b_old") | (F.col("t") > F.col("b_t")) | same_time)
    rivals = land(pairs.where(F.col("distance_m") < spacing_m).select("image_id", F.col("b_image_id").alias("rival")))
    gone: list[DataFrame] = []
    while not rivals.isEmpty():
        blocked = rivals.select(F.col("image_id").alias("rival"))
        free = rivals.join(blocked, "rival", "left_anti")
        dropped = land(free.select("image_id").distinct())
        gone.append(dropped)
        if len(gone) == ROUNDS_READ:
            gone = [land(reduce(DataFrame.union, gone))]
        # pairs of a dropped capture are settled, whether it was blocked or did the blocking
        rivals = land(rivals.join(dropped, "image_id", "left_anti").join(dropped.select(F.col("image_id").alias("rival")), "rival", "left_anti").select("image_id", "rival"))
    return points.join(reduce(DataFrame.union, gone), "image_id", "left_anti") if gone else points


def thin_captures(captures: DataFrame, spacing_m: float, land, max_images: int | None = None) -> DataFrame:
    """The captures kept by going through them from the earliest and keeping each that is at least the
    spacing away from all kept before.

    ``land`` writes a round's table and reads it back, so no lineage builds up."""
    out = far_captures(land(captures.dropDuplicates(["image_id"])), None, spacing_m, land)
    if max_images is not None:
        out = out.orderBy(F.coalesce("captured_at_ms", F.lit(0)), "image_id").limit(max_images)
    return out
