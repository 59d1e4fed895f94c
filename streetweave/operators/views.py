"""Views of buildings: scores, quality, ranking, and one row per building."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least share of the picture for a usable view, weight of a flagged one, quality limits.
MIN_FRACTION, FLAGGED_WEIGHT = 0.005, 0.5
QUALITY_LIMITS = {"blurry": 100.0, "dark": 20.0, "overexposed": 200.0, "small_file": 20 * 1024}
# Limits of the mask rules.
MASK_LIMITS = {
    "pixel_share": 0.002, "overhead_share": 0.4, "outside_share": 0.3, "above_roof_share": 0.25, "components": 4, "fill": 0.45,
    "projected_share": 0.01, "coverage": 0.15,
}


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())


def quality_flags(sharpness: Column, brightness: Column, file_bytes: Column, limits: dict = QUALITY_LIMITS) -> Column:
    return reasons(
        ("blurry", sharpness < limits["blurry"]),
        ("dark", brightness < limits["dark"]),
        ("overexposed", brightness > limits["overexposed"]),
        ("small_file", file_bytes < limits["small_file"]),
    )


def rank_weight(flags: Column) -> Column:
    return F.when(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0, F.lit(FLAGGED_WEIGHT)).otherwise(F.lit(1.0))


def view_score(fraction: Column, coverage: Column, flags: Column) -> Column:
    return fraction * (0.25 + 0.75 * coverage) * rank_weight(flags)


def collect_views(views: DataFrame, min_fraction: float = MIN_FRACTION) -> DataFrame:
    """The views with fraction (six decimals), score (eight) and usable. Views of captures without a
    size, and without pixels or coverage, are left out."""
    whole = views.where("width > 0 AND height > 0 AND pixels IS NOT NULL AND coverage IS NOT NULL")
    fraction = F.col("pixels") / (F.col("width") * F.col("height"))
    return whole.select(
        "*",
        F.round(fraction, 6).alias("observed_fraction"),
        F.round("coverage", 4).alias("projection_coverage"),
        F.round(view_score(fraction, F.col("coverage"), F.col("flags")), 8).alias("score"),
        ((F.size("flags") == 0) & (fraction >= min_fraction)).alias("usable"),
    )


def association_status(usable_captures: Column) -> Column:
    return F.when(usable_captures >= 2, "multi_view").when(usable_captures == 1, "single_view").otherwise("weak_views_only")


def building_rows(collected: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a building: its best view (largest score, then smallest image id), counts and status.
    ``keep`` names further columns to take over from the best view."""
    best = F.min_by(F.struct("image_id", "score", "observed_fraction", "projection_coverage", *keep), F.struct(-F.col("score"), "image_id"))
    # the status asks for none, one or more usable captures: first and last tell, without sorting for a distinct count
    usable = F.when(F.col("usable"), F.col("image_id"))
    some = F.when(F.col("first_usable").isNull(), 0).when(F.col("first_usable") == F.col("last_usable"), 1).otherwise(2)
    rows = collected.groupBy("building_id").agg(
        F.count("*").alias("views"),
        F.count_if("usable").alias("clean_views"),
        F.count_if(F.size("flags") > 0).alias("flagged_views"),
        F.min(usable).alias("first_usable"),
        F.max(usable).alias("last_usable"),
        F.min("captured_at_ms").alias("first_captured_ms"),
        F.max("captured_at_ms").alias("last_captured_ms"),
        best.alias("best"),
    )
    return rows.select(
        "building_id",
        association_status(some).alias("association_status"),
        "views",
        "clean_views",
        "flagged_views",
        F.col("best.image_id").alias("best_image_id"),
        F.col("best.score").alias("best_score"),
        F.col("best.observed_fraction").alias("best_observed_fraction"),
        F.col("best.projection_coverage").alias("best_projection_coverage"),
        "first_captured_ms",
        "last_captured_ms",
        *[F.col(f"best.{k}").alias(k) for k in keep],
    )


def ranked_views(views: DataFrame) -> DataFrame:
    """The views with ``rank`` within their building, by the score as it is, then pixels, coverage, time
    (unknown last) and id."""
    score = view_score(F.col("pixels") / (F.col("width") * F.col("height")), F.col("coverage"), F.col("flags"))
    order = [F.desc("raw_score"), F.desc("pixels"), F.desc("coverage"), F.col("captured_at_ms").asc_nulls_last(), "image_id"]
    return views.withColumn("raw_score", score).withColumn("rank", F.row_number().over(Window.partitionBy("building_id").orderBy(*order)))


def ranking_reasons(views: DataFrame) -> DataFrame:
    """A text for each view: what speaks for it and against it."""
    share = F.format_string("%.2f%% of the picture", F.col("pixels") * 100.0 / (F.col("width") * F.col("height")))
    parts = [
        share,
        F.when(F.col("coverage") < 0.5, F.lit("less than half of the projection")),
        F.when(F.size("flags") > 0, F.concat(F.lit("quality: "), F.concat_ws(", ", "flags"))),
    ]
    return views.withColumn("why", F.concat_ws("; ", *parts))


def select_views(ranked: DataFrame, n: int = 3, vouched: DataFrame | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, set aside): the ``n`` best views of each building without flags, and those with flags.
    ``vouched`` (building_id, image_id) are taken despite their flags; ``only`` limits the choice."""
    keys = ["building_id", "image_id"]
    rows = ranked if only is None else ranked.join(only, keys, "left_semi")
    good = F.size("flags") == 0
    if vouched is not None:
        rows = rows.join(vouched.select(*keys, F.lit(True).alias("vouched")).distinct(), keys, "left")
        good = good | F.coalesce("vouched", F.lit(False))
    order = Window.partitionBy("building_id").orderBy("rank")
    chosen = rows.where(good).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return chosen, rows.where(~good)


def only_flagged(views: DataFrame) -> DataFrame:
    """Buildings none of whose views is free of flags."""
    return views.groupBy("building_id").agg(F.min(F.size("flags")).alias("least")).where("least > 0").select("building_id")


ISSUES = ("no_image", "no_building", "bad_size", "bad_pixels", "bad_coverage", "stale")


def validate_views(views: DataFrame, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with issues as ``issues``, an array of codes)."""
    stale = F.lit(False) if version is None else ~F.col("version").eqNullSafe(F.lit(version))
    found = reasons(
        ("no_image", F.col("image_id").isNull() | (F.col("image_id") == "")),
        ("no_building", ~F.coalesce(F.col("building_id").rlike(r"^(node|way|relation)/[1-9][0-9]*(/part-[1-9][0-9]*)?$"), F.lit(False))),
        ("bad_size", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))),
        ("bad_pixels", ~F.coalesce((F.col("pixels") >= 0) & (F.col("pixels") <= F.col("width") * F.col("height")), F.lit(False))),
        ("bad_coverage", ~F.coalesce(F.col("coverage").between(0, 1), F.lit(False))),
        ("stale", stale),
    )
    rows = views.withColumn("issues", found)
    return rows.where(F.size("issues") == 0).drop("issues"), rows.where(F.size("issues") > 0)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.select(F.explode("issues").alias("code")).groupBy("code").count()


def assess_mask(s: dict[str, Column], limits: dict = MASK_LIMITS) -> Column:
    """The mask rules that signals break, surest first. An empty mask breaks none beyond its size."""
    some = s["pixels"] > 0
    return reasons(
        ("interior", s["camera_inside"]),
        ("sliver", s["pixel_share"] < limits["pixel_share"]),
        ("overhead", some & (s["overhead_share"] > limits["overhead_share"])),
        ("neighbor", some & (s["outside_share"] > limits["outside_share"])),
        ("street", some & (s["runs"] > 1)),
        ("sky", some & (F.coalesce(s["above_roof_share"], F.lit(0.0)) > limits["above_roof_share"])),
        ("speckle", some & ((s["components"] > limits["components"]) | (s["fill"] < limits["fill"]))),
        ("missing", some & s["coverage"].isNotNull() & (s["projected_share"] >= limits["projected_share"]) & (s["coverage"] < limits["coverage"])),
    )


def flag_counts(views: DataFrame) -> DataFrame:
    return views.select(F.explode("flags").alias("reason")).groupBy("reason").agg(F.count("*").alias("views"))


def small_views(views: DataFrame, min_pixels: int) -> DataFrame:
    """Removal edits for views of too few pixels."""
    return views.where(F.col("pixels") < min_pixels).select("image_id", "building_id", F.lit(True).alias("remove"))


def coverage_report(rows: DataFrame, nearby: DataFrame, visible: DataFrame) -> DataFrame:
    """One row: how many buildings are matched, near and in sight, shares, statuses and view counts."""
    sets = (
        rows.select("building_id", "association_status", "views", "clean_views", F.lit(True).alias("m"))
        .join(nearby.select("building_id", F.lit(True).alias("n")).distinct(), "building_id", "full")
        .join(visible.select("building_id", F.lit(True).alias("v")).distinct(), "building_id", "full")
    )
    n = F.count_if("n")
    return sets.agg(
        F.count_if("m").alias("matched"),
        n.alias("near"),
        F.count_if("v").alias("in_sight"),
        F.round(F.count_if(F.col("m") & F.col("n")) / F.nullif(n, F.lit(0)), 4).alias("matched_of_near"),
        F.round(F.count_if(F.col("v") & F.col("n")) / F.nullif(n, F.lit(0)), 4).alias("in_sight_of_near"),
        F.count_if(F.col("v") & F.col("m").isNull()).alias("seen_not_matched"),
        F.round(F.count_if(F.col("clean_views") > 0) / F.nullif(n, F.lit(0)), 4).alias("usable_of_near"),
        *[F.count_if(F.col("association_status") == s).alias(s) for s in ("multi_view", "single_view", "weak_views_only")],
        F.count_if(F.col("views") == 1).alias("views_1"),
        F.count_if(F.col("views") == 2).alias("views_2"),
        F.count_if(F.col("views").between(3, 5)).alias("views_3_5"),
        F.count_if(F.col("views") >= 6).alias("views_6"),
    )


def assess_footprints(
    views: DataFrame, land: Callable[[DataFrame], DataFrame], inputs: DataFrame | None = None, captures: DataFrame | None = None
) -> DataFrame:
    """Per building: geometry variants, sources, revisions, views far enough apart to be independent, alignment,
    depth samples, the status of each of seven checks and a conclusion. ``views``: building_id, image_id, lat,
    lon, geometry, source, revision (null: not corrected), facade_iou, depth_samples, depth_conflicts. Views
    without a position are no independent ones; ``captures`` (image_id, lat, lon) has the positions if ``views``
    hasn't, so that only the ids go to them. ``inputs`` counts the analyses that were read: compatible,
    stale, incomplete, invalid; without it the inputs are taken as complete."""
    from streetweave.operators.captures import independent_views

    placed = views if captures is None else views.select("building_id", "image_id").join(captures, "image_id")
    far = independent_views(placed.select("building_id", "image_id", "lat", "lon"), land).groupBy("building_id").agg(F.count("*").alias("independent_views"))
    sums = views.groupBy("building_id").agg(
        F.count("*").alias("views"),
        F.count_distinct("geometry").alias("variants"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("revision")).alias("revisions"),
        F.min("facade_iou").alias("least_iou"),
        F.max("facade_iou").alias("largest_iou"),
        F.coalesce(F.sum("depth_samples"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("depth_conflicts"), F.lit(0)).alias("conflicts"),
    )
    rows = sums.join(far, "building_id", "left").fillna(0, ["independent_views"])
    read = ("compatible", "stale", "incomplete", "invalid")
    counts = None if inputs is None else inputs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in read]).first()
    complete = counts is None or not (counts.stale or counts.incomplete or counts.invalid)
    conclusion = (
        F.when(F.col("variants") > 1, "mixed_geometry_association")
        .when(F.col("independent_views") > 1, "consistent_multi_view_association")
        .otherwise("single_view_association")
    )
    return rows.select(
        "*",
        F.when(F.col("independent_views") > 1, "supporting").otherwise("caution").alias("multi_view_support"),
        F.when(F.col("variants") == 1, "supporting").otherwise("caution").alias("geometry_consistency"),
        F.lit("informational").alias("geometry_provenance"),
        F.when(F.size("revisions") > 0, "caution").otherwise("informational").alias("footprint_correction"),
        F.when(F.col("least_iou").isNotNull(), "informational").otherwise("not_available").alias("pose_alignment"),
        F.when(F.col("conflicts") > 0, "caution").when(F.col("samples") > 0, "supporting").otherwise("not_available").alias("depth_evidence"),
        F.lit("supporting" if complete else "caution").alias("input_completeness"),
        conclusion.alias("conclusion"),
    )


def building_reports(ranked: DataFrame) -> DataFrame:
    """building_id and a JSON document of its views in rank order."""
    view = F.struct("rank", "image_id", "pixels", "coverage")
    return ranked.groupBy("building_id").agg(
        F.to_json(F.struct(F.count("*").alias("n"), F.array_sort(F.collect_list(view)).alias("views"))).alias("report")
    )


def view_links(views: DataFrame, base: str) -> DataFrame:
    link = F.concat(F.lit(base), F.lit("?image="), F.url_encode("image_id"), F.lit("&building="), F.url_encode("building_id"))
    return views.withColumn("url", link)
