"""Walls of footprints as rows: edges around cameras, facing and visible walls, overlap of footprints.

A footprint is polygons -> rings -> closed lists of [x, y]. Everything is keyed by the camera (or the
footprint) and joined on it, so a camera's scene, some hundred edges, is the largest group there is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetweave.functions.geo import crossing_fraction, local_metres, segment_distance
from streetweave.operators.spatial import CELL_RADII, radius_join, with_cell, with_reached_cells

# Also names of this module: the operators on whole scenes.
from streetweave.operators.sweep import MAX_SAMPLES, SAMPLE_M, clear_counts, dealt, facing_walls, scene_scores, scenes_in_cells, unshared_walls, visible_facades, visible_samples, wall_zbuffer

# Fixed value: radius of a scene, in metres.
SCENE_M = 140.0


def edges(footprints: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """keys, polygon_no, ring_no, edge_no, x1, y1, x2, y2 of all walls."""
    polygons = footprints.select(*keys, F.posexplode(geometry).alias("polygon_no", "rings"))
    rings = polygons.select(*keys, "polygon_no", F.posexplode("rings").alias("ring_no", "points"))
    pairs = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = rings.select(*keys, "polygon_no", "ring_no", F.posexplode(pairs).alias("edge_no", "e"))
    return each.select(*keys, "polygon_no", "ring_no", "edge_no", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def near_footprints(cameras: DataFrame, footprints: DataFrame, reach_m: float, radius_m: float = SCENE_M) -> DataFrame:
    """image_id, building_id, distance_m: footprints whose nearest wall is within the radius of a camera.
    ``footprints``: building_id, lat, lon (a centre), geometry; ``reach_m`` bounds the distance of a wall
    from its centre, so candidates come from the grid."""
    pairs = radius_join(cameras, footprints, radius_m + reach_m, ["image_id"], ["building_id"]).select("image_id", "lat", "lon", F.col("b_building_id").alias("building_id"))
    walls = edges(footprints, ["building_id"])
    rows = pairs.join(walls, "building_id")
    x1, y1 = local_metres(F.col("lat"), F.col("lon"), F.col("y1"), F.col("x1"))
    x2, y2 = local_metres(F.col("lat"), F.col("lon"), F.col("y2"), F.col("x2"))
    nought = F.lit(0.0)
    distance = segment_distance(nought, nought, x1, y1, x2, y2)
    return rows.groupBy("image_id", "building_id").agg(F.min(distance).alias("distance_m")).where(F.col("distance_m") <= radius_m)


def crossings(points: DataFrame, walls: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """keys, polygon_no and whether the point lies in the polygon (even-odd, so holes are out)."""
    rows = points.join(walls, on)
    straddles = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    at = F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hit = F.count_if(straddles & (F.col("px") < at))
    return rows.groupBy(*keys, "building_id", "polygon_no").agg((hit % 2 == 1).alias("inside"))


def inside_footprint(points: DataFrame, footprints: DataFrame, reach_m: float) -> DataFrame:
    """point_id, building_id of points (lat, lon) inside a footprint."""
    pairs = radius_join(points, footprints, reach_m, ["point_id"], ["building_id"]).select("point_id", F.col("lon").alias("px"), F.col("lat").alias("py"), F.col("b_building_id").alias("building_id"))
    parity = crossings(pairs, edges(footprints, ["building_id"]), ["building_id"], ["point_id"])
    return parity.where("inside").select("point_id", "building_id").distinct()


def wall_samples(walls: DataFrame) -> DataFrame:
    """The walls' columns with sample, fraction, sx, sy: points at the middles of equal parts."""
    n = F.greatest(F.lit(1), F.least(F.lit(MAX_SAMPLES), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / SAMPLE_M))).cast("int")
    rows = walls.withColumn("samples", n).withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)))
    fraction = (F.col("sample") + 0.5) / F.col("samples")
    rows = rows.withColumn("fraction", fraction)
    return rows.withColumn("sx", F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("fraction")).withColumn("sy", F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("fraction"))


def facade_bearings(facades: DataFrame) -> DataFrame:
    """The facades with width_deg, length_m and centre_deg as seen from the camera."""
    first, second = F.pmod(F.degrees(F.atan2("x1", "y1")), F.lit(360.0)), F.pmod(F.degrees(F.atan2("x2", "y2")), F.lit(360.0))
    turn = F.pmod(second - first + 180, F.lit(360.0)) - 180
    return facades.select("*", F.abs(turn).alias("width_deg"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length_m"), F.pmod(first + turn / 2, F.lit(360.0)).alias("centre_deg"))


def visibility(bearings: DataFrame) -> DataFrame:
    """image_id, building_id, aov_deg, distance_m, visible_wall_m, bearing_deg."""
    return bearings.groupBy("image_id", "building_id").agg(
        F.round(F.least(F.sum("width_deg"), F.lit(360.0)), 2).alias("aov_deg"), F.round(F.min("distance"), 2).alias("distance_m"),
        F.round(F.sum("length_m"), 2).alias("visible_wall_m"), F.round(F.max_by("centre_deg", F.struct(F.round("width_deg", 9), -F.round("centre_deg", 9))), 2).alias("bearing_deg"),
    )


def visibility_index(cameras: DataFrame, footprints: DataFrame, reach_m: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visibility rows, nearby, skipped) of cameras (image_id, lat, lon, and heading if known). ``nearby`` has
    building_id, captures of every footprint within the radius of some camera, seen or not; ``skipped`` has
    image_id, reason of cameras that can't be indexed: no_id, no_position, bad_position, bad_heading.

    Cameras and walls meet in the cells of the grid, a cell at a time, so neither pairs nor the walls of scenes are
    exchanged, and nothing is broadcast."""
    heading = F.isnan("heading") | (F.abs("heading") == float("inf")) if "heading" in cameras.columns else F.lit(False)
    reason = (
        F.when(F.col("image_id").isNull() | (F.col("image_id") == ""), "no_id")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "no_position")
        .when(~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)) | F.isnan("lat") | F.isnan("lon"), "bad_position")
        .when(F.coalesce(heading, F.lit(False)), "bad_heading")
    )
    told = cameras.withColumn("reason", reason)
    sound = told.where("reason IS NULL").drop("reason")
    cell_m = CELL_RADII * (SCENE_M + reach_m)
    placed = with_cell(sound.select("image_id", "lat", "lon"), cell_m)
    around = with_reached_cells(footprints.where("building_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("building_id", "lat", "lon", "geometry"), cell_m, SCENE_M + reach_m)
    around = edges(around, ["cy", "cx", "building_id", "lat", "lon"]).select("cy", "cx", "building_id", "polygon_no", "lat", "lon", "x1", "y1", "x2", "y2")
    seen, nearby = scenes_in_cells(placed, around, SCENE_M, SCENE_M + reach_m)
    rounded = [F.round(F.least("aov_deg", F.lit(360.0)) if c == "aov_deg" else F.col(c), 2).alias(c) for c in ("aov_deg", "distance_m", "visible_wall_m", "bearing_deg")]
    return seen.select("image_id", "building_id", *rounded), nearby.groupBy("building_id").agg(F.sum("captures").alias("captures")), told.where("reason IS NOT NULL").select("image_id", "reason")


def mutual_best(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """a_id, b_id, iou of pairs that are each other's best match; exact ties go to the smaller id."""
    best_a = overlaps.groupBy("a_id").agg(F.min(F.struct((-F.col("iou")).alias("o"), F.col("b_id").alias("x"))).alias("m")).select("a_id", F.col("m.x").alias("b_id"))
    best_b = overlaps.groupBy("b_id").agg(F.min(F.struct((-F.col("iou")).alias("o"), F.col("a_id").alias("x"))).alias("m")).select("b_id", F.col("m.x").alias("a_id"))
    return overlaps.where(F.col("iou") >= least).join(best_a, ["a_id", "b_id"], "left_semi").join(best_b, ["a_id", "b_id"], "left_semi")


def drop_group_boxes(boxes: DataFrame, coverage: float = 0.6, slack: float = 2.0) -> DataFrame:
    """The boxes (view, box, x1, y1, x2, y2) without those mostly made of two or more smaller ones in them."""
    s = boxes.select("view", F.col("box").alias("inner"), *[F.col(c).alias(f"i_{c}") for c in ("x1", "y1", "x2", "y2")])
    area, inner = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), (F.col("i_x2") - F.col("i_x1")) * (F.col("i_y2") - F.col("i_y1"))
    inside = (F.col("i_x1") >= F.col("x1") - slack) & (F.col("i_y1") >= F.col("y1") - slack) & (F.col("i_x2") <= F.col("x2") + slack) & (F.col("i_y2") <= F.col("y2") + slack)
    met = boxes.join(s, "view").where((F.col("box") != F.col("inner")) & inside & (inner < area))
    groups = met.groupBy("view", "box").agg(F.count("*").alias("n"), F.sum(inner).alias("covered"), F.max(area).alias("area"))
    return boxes.join(groups.where((F.col("n") >= 2) & (F.col("covered") >= coverage * F.col("area"))), ["view", "box"], "left_anti")


def face_pairs(faces: DataFrame, near: DataFrame, max_deg: float = 110.0) -> DataFrame:
    """a_image, a_face, b_image, b_face: faces of near captures that look less than ``max_deg`` apart, and
    adjacent faces of one capture. ``faces``: image_id, face (0..3), yaw_deg; near: image_id, other_id."""
    each = faces.groupBy("image_id").agg(F.collect_list(F.struct("face", "yaw_deg")).alias("faces"))
    other = each.select(F.col("image_id").alias("other_id"), F.col("faces").alias("b_faces"))
    # a pair travels with the faces of both ends, not once for each two of them
    met = near.where("image_id < other_id").select("image_id", "other_id").join(each.hint("merge"), "image_id").join(other.hint("merge"), "other_id")
    across = met.select("image_id", "other_id", F.explode("faces").alias("a"), "b_faces").select("image_id", "other_id", "a", F.explode("b_faces").alias("b"))
    apart = F.abs(F.pmod(F.col("a.yaw_deg") - F.col("b.yaw_deg") + 180, F.lit(360.0)) - 180)
    across = across.where(apart < max_deg).select("image_id", F.col("a.face").alias("face"), "other_id", F.col("b.face").alias("b_face"))
    own = faces.select("image_id", "face", F.col("image_id").alias("other_id"), ((F.col("face") + 1) % 4).alias("b_face"))
    return across.union(own)


def depth_conflicts(samples: DataFrame, depth: DataFrame, reach: int = 1, least_m: float = 3.0, share: float = 0.2) -> DataFrame:
    """image_id, row, col, kind of projected wall pixels near a sparse depth sample: agree, foreground (the
    sample lies in front of the wall) or background. ``samples``: image_id, row, col, depth."""
    around = samples.select("image_id", "row", "col", F.col("depth").alias("seen")).withColumn("dy", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("dx", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    spots = around.select("image_id", (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col"), "seen")
    met = spots.join(depth.select("image_id", "row", "col", "depth"), ["image_id", "row", "col"])
    band = F.greatest(F.lit(least_m), F.col("depth") * share)
    kind = F.when(F.col("seen") < F.col("depth") - band, "foreground").when(F.col("seen") > F.col("depth") + band, "background").otherwise("agree")
    return met.groupBy("image_id", "row", "col").agg(F.min_by(kind, "seen").alias("kind"))


def rig_poses(centres: DataFrame, max_spread: float = 0.5, max_shift: float = 12.0, least_faces: int = 3) -> DataFrame:
    """rig, x, y, z, spread, faces, accepted: the median of a rig's face centres. ``centres``: rig, x, y, z and
    the recorded position x0, y0, z0. A spread or shift of the limit itself is accepted: it is compared as rounded
    to nine places, or the last bit of a root would decide."""
    middle = centres.groupBy("rig").agg(*[F.median(c).alias(f"m{c}") for c in ("x", "y", "z", "x0", "y0", "z0")])
    off = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), F.lit(2.0)) for c in ("x", "y", "z")), F.lit(0.0)))
    shift = F.sqrt(sum((F.pow(F.col(f"m{c}") - F.col(f"m{c}0"), F.lit(2.0)) for c in ("x", "y", "z")), F.lit(0.0)))
    sums = centres.join(middle, "rig").groupBy("rig").agg(F.max(off).alias("spread"), F.count("*").alias("faces"), F.max(shift).alias("shift"), *[F.max(f"m{c}").alias(c) for c in ("x", "y", "z")])
    ok = (F.col("faces") >= least_faces) & (F.round("spread", 9) <= max_spread) & (F.round("shift", 9) <= max_shift)
    return sums.withColumn("accepted", ok)


def depth_samples(observations: DataFrame, track: int = 2, error: float = 8.0, captures: int = 2) -> DataFrame:
    """image_id, u, v, depth: the nearest good point at each rounded place. ``observations``: point_id,
    image_id, u, v, depth, track, error, accepted."""
    good = observations.where((F.col("track") >= track) & (F.col("error") <= error) & F.col("accepted"))
    seen = good.groupBy("point_id").agg(F.count_distinct("image_id").alias("n")).where(F.col("n") >= captures)
    kept = good.join(seen, "point_id", "left_semi")
    return kept.groupBy("image_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v")).agg(F.min("depth").alias("depth"))


def _wall_columns(facades: DataFrame, width: int, height: int, camera_m: float) -> DataFrame:
    """The facades once for each column of the panorama they are met in, with col, depth, top and bottom (rows).
    A wall is looked for in the columns between its corners' bearings and one more at either side, the
    shorter way round; only one that runs through the camera is looked for in all."""
    bearing = [F.atan2(F.col(f"x{k}"), F.col(f"y{k}")) for k in (1, 2)]
    rows = _held(facades, "__b", F.struct(bearing[0].alias("one"), bearing[1].alias("two"), (F.pmod(bearing[1] - bearing[0] + F.pi(), 2 * F.pi()) - F.pi()).alias("turn")))
    turn = F.col("__b.turn")
    first = F.floor(F.when(turn < 0, F.col("__b.two")).otherwise(F.col("__b.one")) * width / (2 * F.pi()) - 0.5) - 1
    span = F.ceil(F.abs(turn) * width / (2 * F.pi())) + 3
    every = (F.abs(turn) > math.pi - 1e-6) | (span >= width)
    columns = F.sequence(F.when(every, F.lit(0)).otherwise(first), F.when(every, F.lit(width - 1)).otherwise(first + span))
    rows = rows.withColumn("__c", F.explode(columns)).withColumn("col", F.pmod("__c", F.lit(width)).cast("int"))
    angle = F.radians((F.col("col") + 0.5) * 360.0 / width)
    far = 1e4
    rows = _held(rows, "__ray", F.struct((F.sin(angle) * far).alias("u"), (F.cos(angle) * far).alias("v")))
    at = crossing_fraction(F.lit(0.0), F.lit(0.0), F.col("__ray.u"), F.col("__ray.v"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = _held(rows, "__at", at)
    depth = F.col("__at") * far
    rows = _held(rows, "depth", F.when(depth > 0.25, depth))

    def row(elevation: Column) -> Column:
        return F.floor((0.5 - elevation / F.pi()) * height).cast("int")

    top = F.greatest(F.lit(0), row(F.atan2(F.col("top_m") - camera_m, F.col("depth"))))
    bottom = F.least(F.lit(height - 1), row(F.atan2(F.lit(-camera_m), F.col("depth"))))
    rows = _held(rows, "__r", F.struct(top.alias("top"), bottom.alias("bottom"))).withColumn("top", F.col("__r.top")).withColumn("bottom", F.col("__r.bottom"))
    return rows.where("top <= bottom").drop("__b", "__c", "__ray", "__at", "__r")


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is worked out once for each, where it isn't null. The optimizer does not
    look through ``explode``; without it every use of a column repeats all that the column is made of."""
    return rows.withColumn(name, F.explode(F.when(value.isNotNull(), F.array(value))))


def _ones(low: Column, high: Column) -> Column:
    """A long with the bits from ``low`` to ``high`` (0 to 63) set."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), low).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - high))


def wall_masks(facades: DataFrame, keys: list[str], width: int, height: int, camera_m: float = 1.7) -> DataFrame:
    """keys, col, word, mask: the rows of a column in which some wall is, as bits; 64 rows to a word. Walls of a
    scene unite by ``bit_or``, so neither cells nor depths are made."""
    runs = _wall_columns(facades, width, height, camera_m).withColumn("word", F.explode(F.sequence(F.shiftright("top", 6), F.shiftright("bottom", 6))))
    low, high = F.greatest(F.lit(0), F.col("top") - F.col("word") * 64), F.least(F.lit(63), F.col("bottom") - F.col("word") * 64)
    return runs.groupBy(*keys, "col", "word").agg(F.bit_or(_ones(low, high)).alias("mask"))


def cell_masks(cells: DataFrame) -> DataFrame:
    """image_id, col, word, mask of single cells (image_id, row, col)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("row").cast("int"), F.lit(64)))
    return cells.groupBy("image_id", F.col("col").cast("int").alias("col"), F.shiftright(F.col("row").cast("int"), 6).alias("word")).agg(F.bit_or(bit).alias("mask"))


def pose_scores(observed: DataFrame, facades: DataFrame, candidates: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, candidate, shift_m, turn_deg, score: how well the projected walls meet the observed cells
    for each candidate (dx, dy, turn_deg) of a fixed table of at most 1,000. ``observed``: image_id, col, word,
    mask, as :func:`cell_masks` and :func:`wall_masks` give them.

    A scene is one exchange: walls are projected once for each offset, and a turn only shifts the columns that
    are compared. All that is grouped and joined after it keeps to the partitioning by image."""
    fixed = candidates.limit(1001).collect()
    if len(fixed) > 1000:
        raise ValueError("candidates are a fixed table of at most 1,000 rows")
    offsets = sorted({(c.dx, c.dy) for c in fixed})
    turns = sorted({c.turn_deg for c in fixed})
    number = {(c.dx, c.dy, c.turn_deg): c.candidate for c in fixed}
    moved = dealt(facades.select("image_id", "x1", "y1", "x2", "y2", "top_m"))
    moved = moved.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(offsets)])))
    moved = moved.select("image_id", F.col("o.k").alias("offset"), "top_m", *[(F.col(f"x{k}") - F.col("o.dx")).alias(f"x{k}") for k in (1, 2)], *[(F.col(f"y{k}") - F.col("o.dy")).alias(f"y{k}") for k in (1, 2)])
    walls = wall_masks(moved, ["image_id", "offset"], width, height)
    words = (height + 63) // 64
    place = F.col("col") * words + F.col("word")
    seen = observed.where("mask <> 0").groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("p"), "mask"))).alias("seen"), F.sum(F.bit_count("mask")).alias("n_seen"))

    def both(turn: float) -> Column:
        there = F.pmod(F.col("col") - round(turn / 360.0 * width), F.lit(width)) * words + F.col("word")
        return F.sum(F.bit_count(F.col("mask").bitwiseAND(F.coalesce(F.element_at("seen", there.cast("int")), F.lit(0).cast("long")))))

    sums = walls.join(seen, "image_id").groupBy("image_id", "offset").agg(F.max("n_seen").alias("n_seen"), F.sum(F.bit_count("mask")).alias("n_walls"), *[both(t).alias(f"both{k}") for k, t in enumerate(turns)])
    each = F.array(*[F.struct(F.lit(k).alias("turn"), F.col(f"both{k}").alias("both")) for k in range(len(turns))])
    rows = sums.select("image_id", "offset", "n_seen", "n_walls", F.explode(each).alias("t"))
    table = F.array(*[F.struct(F.lit(number.get((dx, dy, t))).cast("int").alias("candidate"), F.lit(math.hypot(dx, dy)).alias("shift_m"), F.lit(t).alias("turn_deg")) for dx, dy in offsets for t in turns])
    rows = rows.withColumn("c", F.element_at(table, (F.col("offset") * len(turns) + F.col("t.turn") + 1).cast("int"))).where("c.candidate IS NOT NULL")
    score = F.col("t.both") / (F.col("n_walls") + F.col("n_seen") - F.col("t.both"))
    return rows.select("image_id", "c.candidate", "c.shift_m", "c.turn_deg", score.alias("score"))


def pose_grid(offsets=(-4.0, 0.0, 4.0), turns=(-6.0, 0.0, 6.0)) -> list[tuple[float, float, float]]:
    """The candidates (dx, dy, turn_deg) in order of their numbers."""
    return sorted(((x, y, t) for x in offsets for y in offsets for t in turns), key=lambda c: (c != (0.0, 0.0, 0.0), c))


def pose_candidates(spark, offsets=(-4.0, 0.0, 4.0), turns=(-6.0, 0.0, 6.0)) -> DataFrame:
    """The fixed table of candidates; number 0 is the recorded pose."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(pose_grid(offsets, turns))], "candidate int, dx double, dy double, turn_deg double")
