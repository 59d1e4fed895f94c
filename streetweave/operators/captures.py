"""Captures: records, coordinates, filters and sets of independent views."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetweave.functions.fields import finite, normal_heading
from streetweave.functions.geo import haversine_m
from streetweave.operators.independent import first_largest
from streetweave.operators.masks import connected
from streetweave.operators.spatial import radius_join

# Fixed value: metres between views that count as independent.
BASELINE_M = 3.0


def valid_point(point: Column) -> Column:
    """The point if it is a position on Earth, else null."""
    lon, lat = finite(point["lon"]), finite(point["lat"])
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat")))


def effective_point(columns: list[str], mode: str = "first_present") -> Column:
    """The first point that is there, if valid; or, with first_valid, the first that is valid."""
    if mode == "first_valid":
        return F.coalesce(*[valid_point(F.col(c)) for c in columns])
    return valid_point(F.coalesce(*[F.col(c) for c in columns]))


def filter_captures(
    captures: DataFrame, bbox: tuple | None = None, center: tuple | None = None, radius_m: float | None = None, captured_after_ms: int | None = None, panoramas: bool = False
) -> DataFrame:
    """Captures inside the box (west, south, east, north) and the circle around (lat, lon), not older than
    the limit, with a usable heading where they have the column."""
    rows = captures
    if panoramas:
        rows = rows.where("is_pano")
    if bbox:
        rows = rows.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    if captured_after_ms is not None:
        rows = rows.where(F.col("captured_at_ms") >= captured_after_ms)
    if center and radius_m:
        rows = rows.where(haversine_m(F.lit(center[0]), F.lit(center[1]), F.col("lat"), F.col("lon")) <= radius_m)
    if "heading" in captures.columns:
        rows = rows.where(normal_heading(F.col("heading")).isNotNull())
    return rows


def pick_derivative(columns: dict[int, str], size: int) -> Column:
    """The wanted size or the next smaller one that is there."""
    return F.coalesce(*[F.col(columns[s]) for s in sorted(columns, reverse=True) if s <= size])


def capture_record(images: DataFrame) -> DataFrame:
    """The images as capture records: ids as strings, a sequence given as an object or a scalar."""
    kind = dict(images.dtypes)["sequence"]
    sequence = F.col("sequence.id") if kind.startswith("struct") else F.col("sequence")
    return images.select(
        F.col("id").cast("string").alias("id"), sequence.cast("string").alias("sequence_id"), F.col("captured_at").cast("long").alias("captured_at_ms"), normal_heading(F.col("computed_compass_angle")).alias("computed_compass_angle_deg")
    )


def dataset_summaries(captures: DataFrame) -> DataFrame:
    """dataset, images, newest, newest first."""
    return captures.groupBy("dataset").agg(F.count("*").alias("images"), F.max("captured_at_ms").alias("newest")).orderBy(F.desc("newest"), "dataset")


def ordered_captures(captures: DataFrame) -> DataFrame:
    return captures.orderBy(F.coalesce("captured_at_ms", F.lit(0)), "image_id")


def page(rows: DataFrame, order: list, n: int) -> tuple[DataFrame, int, bool]:
    """(the first n rows, how many there are, whether that is not all)."""
    total = rows.count()
    return rows.orderBy(*order).limit(n), total, total > n


def dedupe_captures(captures: DataFrame) -> DataFrame:
    """One row for each image id: the earliest, so that the choice doesn't depend on partitions."""
    rest = [c for c in captures.columns if c != "image_id"]
    return captures.groupBy("image_id").agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("captured_at_ms", F.lit(0)), "dataset")).alias("c")).select("image_id", "c.*")


def attribution_lines(captures: DataFrame) -> DataFrame:
    name = F.coalesce("username", F.col("creator_id").cast("string"), F.lit("unknown"))
    return captures.select(F.format_string("%s by %s", "image_id", name).alias("value"))


def independent_views(views: DataFrame, land: Callable[[DataFrame], DataFrame], least_m: float = BASELINE_M, sums: dict[str, Column] | None = None) -> DataFrame:
    """building_id, image_id: a largest set of views pairwise at least ``least_m`` apart, the first such set in
    the order of image ids. ``views``: building_id, image_id, lat, lon. ``land`` writes a table and reads
    it back. ``sums`` are aggregates over the rows of a view, returned as further columns.

    Views nearer to one another than that are links; the first largest set of a building is that of each
    connected piece, so only a piece has to fit a task. A view has none if the next ones of its building, by
    latitude, are farther off; of these, which are most, no more than the ids are kept."""
    sums = sums or {}
    located = views.where("lat IS NOT NULL AND lon IS NOT NULL").repartition("building_id").groupBy("building_id", "image_id")
    order, reach = Window.partitionBy("building_id").orderBy("p.lat"), least_m / 111_000.0
    north, south = F.lead("p.lat").over(order) - F.col("p.lat"), F.col("p.lat") - F.lag("p.lat").over(order)
    near = F.coalesce(north <= reach, F.lit(False)) | F.coalesce(south <= reach, F.lit(False))
    marked = located.agg(F.min(F.struct("lat", "lon")).alias("p"), *[v.alias(c) for c, v in sums.items()]).withColumn("near", near)
    points = land(marked.select("building_id", "image_id", F.when(F.col("near"), F.col("p")).alias("p"), *sums))
    suspects = points.where("p IS NOT NULL").select("building_id", "image_id", "p.lat", "p.lon")
    close = radius_join(suspects, suspects, least_m, ["image_id"], ["image_id"], ("building_id",))
    close = close.where((F.col("image_id") != F.col("b_image_id")) & (F.col("distance_m") < least_m))
    links = land(close.select("building_id", "image_id", "lat", "lon", F.col("b_image_id").alias("other")))
    if links.isEmpty():
        return points.select("building_id", "image_id", *sums)
    node = lambda c: F.to_json(F.array("building_id", c))
    roots = connected(links.select(node("image_id").alias("u"), node("other").alias("v")), land)
    placed = links.withColumn("node", node("image_id")).join(roots, "node").select("root", "building_id", "image_id", "lat", "lon", "other")

    def choose(piece: pd.DataFrame) -> pd.DataFrame:
        ends = piece.drop_duplicates("image_id").sort_values("image_id")
        names = ends["image_id"].tolist()
        number = {n: k for k, n in enumerate(names)}
        near: list[set[int]] = [set() for _ in names]
        for a, b in zip(piece["image_id"].map(number), piece["other"].map(number), strict=True):
            near[a].add(b)
        # degrees of longitude are shorter: metres, up to a factor
        across = math.cos(math.radians(float(ends["lat"].iloc[0])))
        kept = first_largest(near, list(zip(ends["lat"], ends["lon"] * across, strict=True)))
        return pd.DataFrame({"building_id": piece["building_id"].iloc[0], "image_id": [names[k] for k in kept]})

    chosen = placed.groupBy("root").applyInPandas(choose, "building_id string, image_id string")
    linked = links.select("building_id", "image_id").distinct()
    dropped = land(linked.join(chosen, ["building_id", "image_id"], "left_anti"))
    return points.select("building_id", "image_id", *sums).join(dropped, ["building_id", "image_id"], "left_anti")


def fuse_nearby(views: DataFrame, captures: DataFrame, land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per building: sources, revisions of its footprint that were used, captures, observed_pixels,
    inferred_pixels, independent views, their ids and their mean coverage. ``views``: building_id, image_id,
    source, pixels, coverage and, if known, inferred_pixels and revision."""
    known = {c: F.col(c) if c in views.columns else F.lit(None).cast("long") for c in ("inferred_pixels", "revision")}
    rows = views.select("building_id", "image_id", "source", "pixels", "coverage", *[v.alias(c) for c, v in known.items()])
    sums = rows.groupBy("building_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.array_sort(F.collect_set("revision")).alias("revisions"),
        F.count_distinct("image_id").alias("captures"), F.sum("pixels").alias("observed_pixels"), F.coalesce(F.sum("inferred_pixels"), F.lit(0)).alias("inferred_pixels"),
    )
    # a capture that comes twice is one place; a view's coverages are added up where the view is looked at
    places = captures.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("image_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("image_id", "p.lat", "p.lon")
    parts = {"s": F.sum("coverage"), "n": F.count("coverage")}
    met = independent_views(rows.select("building_id", "image_id", "coverage").join(places, "image_id"), land, sums=parts).groupBy("building_id")
    # a mean half way between two roundings goes up, in whatever order the coverages are added
    mean = F.round(F.round(F.sum("s"), 9) / F.nullif(F.sum("n"), F.lit(0)), 3)
    means = met.agg(F.count("*").alias("views"), F.array_sort(F.collect_list("image_id")).alias("independent_ids"), mean.alias("confidence"))
    joined = sums.join(means, "building_id", "left").fillna(0, ["views"]).fillna(0.0, ["confidence"])
    return joined.withColumn("independent_ids", F.coalesce("independent_ids", F.array().cast("array<string>")))
