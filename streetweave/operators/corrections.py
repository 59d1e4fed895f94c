"""Reviewed corrections of footprints: revisions, their states, and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least captures, consistency and metres of a systematic offset.
OFFSET_CAPTURES, OFFSET_CONSISTENCY, OFFSET_M = 3, 0.7, 2.0


def fold_revisions(events: DataFrame) -> DataFrame:
    """osm_id, revision, kind, base_version, seq, status: each revision after all decisions. ``events`` has
    a decision per revision; an acceptance supersedes every earlier one of its element."""
    later = Window.partitionBy("osm_id").orderBy("revision").rowsBetween(1, Window.unboundedFollowing)
    accepted = F.col("decision") == "accepted"
    status = F.when(accepted & (F.coalesce(F.sum(F.when(accepted, 1)).over(later), F.lit(0)) > 0), "superseded").otherwise(F.col("decision"))
    return events.withColumn("status", status)


def active_revision(revisions: DataFrame) -> DataFrame:
    """The last accepted revision of each element that has one."""
    own = revisions.where("status = 'accepted'")
    rest = [c for c in revisions.columns if c != "osm_id"]
    return own.groupBy("osm_id").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("osm_id", "r.*")


def latest_revision(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("osm_id").agg(F.max_by(F.struct("revision", "status"), "revision").alias("r")).select("osm_id", "r.*")


def apply_corrections(footprints: DataFrame, active: DataFrame, parts: str | None = None) -> DataFrame:
    """The footprints with state (none, applied, stale) and correction (the revision). A correction applies
    to the version it was made for; an applied split gives a row for each of its ``parts`` (an array
    column of ``active``), named building/part-n."""
    chosen = active.select(F.col("osm_id").alias("building_id"), F.col("revision").alias("correction"), F.col("kind").alias("__kind"), "base_version", *([F.col(parts).alias("__parts")] if parts else []))
    rows = footprints.join(chosen, "building_id", "left")
    state = F.when(F.col("correction").isNull(), "none").when(F.col("base_version") == F.col("osm_version"), "applied").otherwise("stale")
    rows = rows.withColumn("state", state)
    if not parts:
        return rows.drop("__kind", "base_version")
    split = (F.col("state") == "applied") & (F.col("__kind") == "split")
    whole = rows.where(~split).withColumn("part", F.lit(None).cast("int"))
    cut = rows.where(split).select("*", F.posexplode("__parts").alias("__n", "__part"))
    cut = cut.withColumn("part", F.col("__n") + 1).withColumn("building_id", F.concat("building_id", F.lit("/part-"), F.col("part").cast("string"))).drop("__n", "__part")
    return whole.unionByName(cut).drop("__kind", "__parts", "base_version")


def footprint_issues(diagnostics: DataFrame) -> DataFrame:
    """osm_id, unsupported, merged, supporting (distinct captures), most supported first."""
    own = diagnostics.where(F.col("type").isin("unsupported_footprint", "merged_footprint"))
    return own.groupBy("osm_id").agg(
        F.count_if(F.col("type") == "unsupported_footprint").alias("unsupported"),
        F.count_if(F.col("type") == "merged_footprint").alias("merged"),
        F.count_distinct("dataset", "image").alias("supporting"),
    ).orderBy(F.desc("supporting"), "osm_id")


def systematic_offsets(diagnostics: DataFrame) -> DataFrame:
    """dataset, captures, mean_east_m, mean_north_m, consistency of datasets whose accepted poses all moved
    alike."""
    east, north = F.avg("east_m"), F.avg("north_m")
    sums = diagnostics.where("pose_accepted").groupBy("dataset").agg(
        F.count("*").alias("captures"), east.alias("e"), north.alias("n"), F.avg(F.hypot("east_m", "north_m")).alias("mean_length")
    )
    length = F.hypot("e", "n")
    consistency = F.coalesce(length / F.nullif(F.col("mean_length"), F.lit(0.0)), F.lit(0.0))
    kept = sums.where((F.col("captures") >= OFFSET_CAPTURES) & (consistency >= OFFSET_CONSISTENCY) & (length >= OFFSET_M))
    return kept.select("dataset", "captures", F.round("e", 2).alias("mean_east_m"), F.round("n", 2).alias("mean_north_m"), F.round(consistency, 3).alias("consistency"))


def correction_status(issues: DataFrame, revisions: DataFrame) -> DataFrame:
    """The issues with the latest revision and status of their element; parts count as their element."""
    element = F.split("osm_id", "/part-")[0]
    latest = latest_revision(revisions).withColumnRenamed("osm_id", "__element")
    return issues.withColumn("__element", element).join(latest, "__element", "left").drop("__element")


def merge_footprints(base: DataFrame, analysed: DataFrame) -> DataFrame:
    """building_id, geometry, state, origin: the base map with the analysed footprints over it; ids that
    aren't elements or parts are dropped."""
    a = analysed.select("building_id", F.col("geometry").alias("g2"), F.col("state").alias("s2"), F.lit(True).alias("there"))
    rows = base.select("building_id", "geometry").join(a, "building_id", "full").where(F.col("building_id").rlike(r"^(node|way|relation)/[1-9][0-9]*(/part-[1-9][0-9]*)?$"))
    return rows.select("building_id", F.coalesce("g2", "geometry").alias("geometry"), F.coalesce("s2", F.lit("none")).alias("state"), F.when(F.col("there"), "analysed").otherwise("base").alias("origin"))


def pose_offsets(poses: DataFrame, least_m: float = 1.0) -> DataFrame:
    """The poses that moved at least ``least_m`` (east_m, north_m, distance_m)."""
    distance = F.hypot("east_m", "north_m")
    return poses.withColumn("distance_m", distance).where(F.col("distance_m") >= least_m)


def choose_pose(candidates: DataFrame, far_m: float = 4.5, far_deg: float = 6.5, gain: float = 0.03, least: float = 0.08, margin: float = 0.01) -> DataFrame:
    """image_id, candidate, score, gain, runner_up, accepted, reason: the best of a capture's candidate
    poses. ``candidates``: image_id, candidate, score, shift_m, turn_deg; candidate 0 is the recorded pose.
    The runner-up is the best among poses clearly different from the chosen one."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), F.abs("shift_m"), F.abs("turn_deg"), "candidate")
    best = candidates.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(
        "image_id", F.col("candidate").alias("b"), F.col("score").alias("bs"), F.col("shift_m").alias("bm"), F.col("turn_deg").alias("bd")
    )
    rows = candidates.join(best, "image_id")
    far = (F.abs(F.col("shift_m") - F.col("bm")) >= far_m) | (F.abs(F.col("turn_deg") - F.col("bd")) >= far_deg)
    sums = rows.groupBy("image_id", "b", "bs").agg(F.max(F.when(F.col("candidate") == 0, F.col("score"))).alias("start"), F.max(F.when(far, F.col("score"))).alias("runner_up"))
    rise = F.col("bs") - F.coalesce("start", F.lit(0.0))
    reason = (
        F.when(F.col("b") == 0, "recorded pose is best")
        .when(F.col("bs") < least, "alignment too weak")
        .when(rise < gain, "gain too small")
        .when(F.col("bs") - F.coalesce("runner_up", F.lit(0.0)) < margin, "ambiguous")
    )
    return sums.select("image_id", F.col("b").alias("candidate"), F.col("bs").alias("score"), rise.alias("gain"), "runner_up", reason.isNull().alias("accepted"), reason.alias("reason"))


def status_text(column: Column) -> Column:
    return F.coalesce(column, F.lit("none"))
