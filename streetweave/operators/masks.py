"""Label rasters as pixel rows: contingency, separation, diagnostics, runs and fills."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from streetweave.operators.dealing import dealt

# Least pixels and share of an event, upper band, acceptance of a footprint, naming shares,
# diagnostics' shares.
EVENT_PIXELS, EVENT_SHARE, TOP_BAND = 500, 0.2, 0.25
ACCEPT_PIXELS, ACCEPT_SHARE = 16, 0.025
PROJECTED_SHARE, OWNER_SHARE = 0.3, 0.6
DIAGNOSTIC_SHARE, UNSUPPORTED_BUILDING, UNSUPPORTED_VEGETATION = 0.005, 0.1, 0.5
MERGE_IOU, MERGE_PIXELS = 0.5, 200


def separation_scores(pixels: DataFrame, event_pixels: int = EVENT_PIXELS) -> DataFrame:
    """Per image: completeness, purity, separation_f, detected, leak, merges, splits, buildings of the
    predicted labels against the truth (nought is none, below nought ignored)."""
    table = pixels.where("truth >= 0").groupBy("image_id", "truth", "label").agg(F.count("*").alias("c"))
    on = table.where("truth > 0")
    named = F.when(F.col("label") > 0, F.col("c"))

    def second(rows: DataFrame, key: str) -> DataFrame:
        """Per image: the keys whose second largest count is an event."""
        w = Window.partitionBy("image_id", key).orderBy(F.desc("c"))
        ranked = rows.withColumn("rn", F.row_number().over(w)).groupBy("image_id", key).agg(F.max(F.when(F.col("rn") == 2, F.col("c"))).alias("two"), F.sum("c").alias("all"))
        event = (F.col("two") >= event_pixels) & (F.col("two") >= EVENT_SHARE * F.col("all"))
        return ranked.groupBy("image_id").agg(F.count_if(event).alias("n"))

    both = on.where("label > 0")
    buildings = on.groupBy("image_id", "truth").agg(F.sum("c").alias("size"), F.coalesce(F.max(named), F.lit(0)).alias("dominant"), F.coalesce(F.sum(named), F.lit(0)).alias("hit"))
    per_building = buildings.groupBy("image_id").agg(F.count("*").alias("buildings"), F.sum("size").alias("size"), F.sum("dominant").alias("dominant"), F.sum("hit").alias("hit"))
    labels = table.where("label > 0").groupBy("image_id", "label").agg(
        F.sum("c").alias("all"), F.sum(F.when(F.col("truth") > 0, F.col("c"))).alias("inside"), F.max(F.when(F.col("truth") > 0, F.col("c"))).alias("most")
    )
    per_label = labels.groupBy("image_id").agg(F.sum("all").alias("all"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"), F.coalesce(F.sum("most"), F.lit(0)).alias("most"))
    merges, splits = second(both, "label").withColumnRenamed("n", "merges"), second(both, "truth").withColumnRenamed("n", "splits")
    images = table.select("image_id").distinct()
    rows = images
    for part in (per_building, per_label, merges, splits):
        rows = rows.join(part, "image_id", "left")
    rows = rows.fillna(0)
    one = F.lit(1)
    completeness, purity = F.col("dominant") / F.greatest("size", one), F.col("most") / F.greatest("inside", one)
    return rows.select(
        "image_id",
        completeness.alias("completeness"),
        purity.alias("purity"),
        (2 * purity * completeness / F.greatest(purity + completeness, F.lit(1e-9))).alias("separation_f"),
        (F.col("hit") / F.greatest("size", one)).alias("detected"),
        ((F.col("all") - F.col("inside")) / F.greatest("all", one)).alias("leak"),
        "merges",
        "splits",
        "buildings",
    )


def top_band_detected(pixels: DataFrame) -> DataFrame:
    """Per image: the labelled share of each building's upper quarter, column by column."""
    own = pixels.where("truth > 0")
    w = Window.partitionBy("image_id", "truth", "col")
    top, bottom = F.min("row").over(w), F.max("row").over(w)
    band = own.withColumn("in_band", F.col("row") <= top + TOP_BAND * (bottom - top)).where("in_band")
    return band.groupBy("image_id").agg((F.count_if(F.col("label") > 0) / F.count("*")).alias("top_detected"))


def summarize_scores(scores: DataFrame) -> DataFrame:
    rates = [F.round(F.avg(c), 4).alias(c) for c in ("completeness", "purity", "separation_f", "detected", "leak")]
    return scores.agg(*rates, *[F.sum(c).alias(c) for c in ("merges", "splits", "buildings")])


def association_counts(pixels: DataFrame) -> DataFrame:
    """image_id, ordinal, available, claimed, agreeing, confidence, accepted: how far the projection of a
    footprint is backed by pixels of its label."""
    by_owner = pixels.where("owner > 0").groupBy("image_id", F.col("owner").alias("ordinal")).agg(
        F.count("*").alias("available"), F.count_if(F.col("building") & (F.col("label") == F.col("owner"))).alias("agreeing"), F.count_if("vegetation").alias("inferred")
    )
    by_label = pixels.where("label > 0").groupBy("image_id", F.col("label").alias("ordinal")).agg(F.count_if("building").alias("claimed"))
    rows = by_owner.join(by_label, ["image_id", "ordinal"], "full").fillna(0)
    least = F.greatest(F.lit(ACCEPT_PIXELS), F.floor(F.col("available") * ACCEPT_SHARE))
    return rows.select(
        "image_id", "ordinal", "available", "claimed", "agreeing", "inferred",
        F.round(F.col("agreeing") / F.greatest("available", F.lit(1)), 3).alias("confidence"),
        ((F.col("available") > 0) & (F.col("claimed") >= least)).alias("accepted"),
    )


def unsupported_footprints(pixels: DataFrame, least_pixels: int) -> DataFrame:
    """Projected facades with hardly a building pixel that vegetation doesn't explain."""
    rows = pixels.where("owner > 0").groupBy("image_id", "owner").agg(
        F.count("*").alias("projected"), F.avg(F.col("building").cast("double")).alias("building_share"), F.avg(F.col("vegetation").cast("double")).alias("vegetation_share")
    )
    return rows.where((F.col("projected") >= least_pixels) & (F.col("building_share") < UNSUPPORTED_BUILDING) & (F.col("vegetation_share") < UNSUPPORTED_VEGETATION))


def name_instances(pixels: DataFrame) -> DataFrame:
    """image_id, instance, evidence, projected_share, owner, owner_share, mode of every visual instance."""
    votes = pixels.where("instance > 0 AND building").groupBy("image_id", "instance", "owner").agg(F.count("*").alias("c"))
    own = F.when(F.col("owner") > 0, F.col("c"))
    rows = votes.groupBy("image_id", "instance").agg(
        F.sum("c").alias("evidence"), F.coalesce(F.sum(own), F.lit(0)).alias("projected"), F.max_by(F.when(F.col("owner") > 0, F.col("owner")), F.struct(own, -F.col("owner"))).alias("owner"), F.max(own).alias("most")
    )
    share = F.col("projected") / F.col("evidence")
    owner_share = F.coalesce(F.col("most") / F.nullif(F.col("projected"), F.lit(0)), F.lit(0.0))
    mode = F.when(share < PROJECTED_SHARE, "abstain").when(owner_share >= OWNER_SHARE, "whole").otherwise("columns")
    return rows.select("image_id", "instance", "evidence", F.round(share, 3).alias("projected_share"), "owner", F.round(owner_share, 3).alias("owner_share"), mode.alias("mode"))


def footprint_diagnostics(instances: DataFrame, least_pixels: int) -> DataFrame:
    """image_id, type, subject, n: instances without a footprint, and footprints that name several."""
    big = instances.where(F.col("evidence") >= least_pixels)
    unexplained = big.where("mode = 'abstain'").select("image_id", F.lit("unexplained_instance").alias("type"), F.col("instance").alias("subject"), F.lit(1).cast("long").alias("n"))
    merged = big.where("mode = 'whole'").groupBy("image_id", F.col("owner").alias("subject")).agg(F.count("*").alias("n")).where("n >= 2")
    return unexplained.union(merged.select("image_id", F.lit("merged_footprint"), "subject", "n"))


def islands(rows: DataFrame, part: list[str], order: str, min_gap: int = 1, circular: int | None = None) -> DataFrame:
    """part, start, end, n of the runs of an ordinal; gaps of fewer than ``min_gap`` steps don't part them.
    With ``circular`` the ordinal wraps at that value, and a run over the seam is one: it starts where it
    starts and ends below its start."""
    w = Window.partitionBy(*part).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > min_gap, 1).otherwise(0)
    runs = rows.select(*part, order).distinct().withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    out = runs.groupBy(*part, "__run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    if circular is None:
        return out.drop("__run")
    whole = Window.partitionBy(*part)
    marked = out.withColumn("__first", F.min("start").over(whole)).withColumn("__last", F.max("end").over(whole))
    joins = (F.col("__first") + circular - F.col("__last") <= min_gap) & (F.count("*").over(whole) > 1)
    marked = marked.withColumn("__joins", joins)
    key = F.when(F.col("__joins") & (F.col("start") == F.col("__first")), F.col("__last")).otherwise(F.col("end"))
    joined = marked.withColumn("__key", key)
    return joined.groupBy(*part, "__key").agg(F.max("start").alias("start"), F.min("end").alias("end"), F.sum("n").alias("n")).drop("__key")


def bearing_range(columns: DataFrame, part: list[str], width: int) -> DataFrame:
    """part, from_deg, to_deg: the circle without its widest gap of columns."""
    w = Window.partitionBy(*part).orderBy("col")
    angles = columns.select(*part, "col").distinct().withColumn("angle", (F.col("col") + 0.5) / width * 360.0)
    after = F.coalesce(F.lead("angle").over(w), F.min("angle").over(Window.partitionBy(*part)) + 360.0)
    gaps = angles.withColumn("after", after).withColumn("gap", F.col("after") - F.col("angle"))
    widest = gaps.groupBy(*part).agg(F.max_by(F.struct("angle", "after"), F.struct("gap", -F.col("angle"))).alias("g"))
    return widest.select(*part, F.pmod(F.col("g.after"), F.lit(360.0)).alias("from_deg"), F.col("g.angle").alias("to_deg"))


def mask_frame(pixels: DataFrame, part: list[str], width: int, height: int) -> DataFrame:
    """part, yaw_deg, pitch_deg, fov_deg of a picture that shows a mask, wherever the seam is."""
    angle = ((F.col("col") + 0.5) / width - 0.5) * 2 * F.pi()
    rows = pixels.withColumn("angle", angle).withColumn("pitch", (0.5 - (F.col("row") + 0.5) / height) * 180)
    # rounded, so that opposite columns cancel to nought alike in any order of summation
    mean = rows.groupBy(*part).agg(F.atan2(F.round(F.avg(F.sin("angle")), 9), F.round(F.avg(F.cos("angle")), 9)).alias("mean"))
    off = F.pmod(F.col("angle") - F.col("mean") + F.pi(), 2 * F.pi()) - F.pi()
    spans = rows.join(mean, part).groupBy(*part, "mean").agg(F.min(off).alias("lo"), F.max(off).alias("hi"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    yaw = F.pmod(F.degrees(F.col("mean") + (F.col("lo") + F.col("hi")) / 2) + 180, F.lit(360.0)) - 180
    span = F.greatest(F.degrees(F.col("hi") - F.col("lo")), F.col("high") - F.col("low"))
    pitch = F.greatest(F.lit(-75.0), F.least(F.lit(75.0), (F.col("low") + F.col("high")) / 2))
    fov = F.greatest(F.lit(45.0), F.least(F.lit(100.0), span * 1.25))
    return spans.select(*part, F.round(yaw, 2).alias("yaw_deg"), F.round(pitch, 2).alias("pitch_deg"), F.round(fov, 2).alias("fov_deg"))


def drop_narrow_labels(pixels: DataFrame, least_columns: int) -> DataFrame:
    """The pixels without labels outside instances that cover too few columns of their image."""
    outside = pixels.where("instance = 0 AND building AND label > 0")
    narrow = outside.groupBy("image_id", "label").agg(F.count_distinct("col").alias("n")).where(F.col("n") < least_columns)
    hit = narrow.select("image_id", "label", F.lit(True).alias("narrow"))
    rows = pixels.join(hit, ["image_id", "label"], "left")
    return rows.withColumn("label", F.when((F.col("instance") == 0) & F.coalesce("narrow", F.lit(False)), 0).otherwise(F.col("label"))).drop("narrow")


def fill_nearest(rows: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """The rows with ``value`` filled from the nearest known one along the ordinal; ties to the left."""
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    w = Window.partitionBy(*part).orderBy(order)
    left = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("__l", left).withColumn("__r", right)
    near_left = F.col("__r").isNull() | (F.col(order) - F.col("__l.o") <= F.col("__r.o") - F.col(order))
    return both.withColumn(value, F.when(F.col("__l").isNotNull() & near_left, F.col("__l.v")).otherwise(F.col("__r.v"))).drop("__l", "__r")


def carry_up(pixels: DataFrame) -> DataFrame:
    """The pixels with labels carried up their column through free building pixels, without gaps."""
    w = Window.partitionBy("image_id", "col").orderBy(F.desc("row"))
    free = F.col("building") & (F.col("label") == 0) & (F.col("owner") == 0)
    step = F.when(F.lag("row").over(w) - F.col("row") == 1, 0).otherwise(1)
    rows = pixels.withColumn("__free", free).withColumn("__brk", F.when(~F.col("__free"), 1).otherwise(step))
    run = F.sum("__brk").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("label").over(Window.partitionBy("image_id", "col", "__run").orderBy(F.desc("row")))
    rows = rows.withColumn("__run", run).withColumn("__up", first)
    return rows.withColumn("label", F.when(F.col("__free"), F.col("__up")).otherwise(F.col("label"))).drop("__free", "__brk", "__run", "__up")


def absorb_runs(runs: DataFrame, part: list[str], least: int) -> DataFrame:
    """part, start, n, value of the runs left when the narrowest goes to its wider neighbour again and
    again until all hold ``least`` columns. ``runs``: part, start, n, value. A group is an array, and Python works
    on a batch of them at a time; groups whose runs are all wide enough go to it as nulls."""
    fields = {f.name: f.dataType.simpleString() for f in runs.schema}
    run = ", ".join(f"{c}: {fields[c]}" for c in ("start", "n", "value"))

    @arrow_udf(f"array<struct<{run}>>")
    def absorb(groups: pa.Array) -> pa.Array:
        flat, lengths = groups.flatten(), groups.value_lengths().fill_null(0).to_pylist()
        starts, ns = (flat.field(c).to_pylist() for c in ("start", "n"))
        at, kept, kept_starts, kept_ns, offsets = 0, [], [], [], [0]
        for length in lengths:
            start, n, row = starts[at : at + length], ns[at : at + length], list(range(at, at + length))
            at += length
            while len(n) > 1 and (low := min(n)) < least:
                k = n.index(low)
                j = k + 1 if k == 0 or (k + 1 < len(n) and n[k + 1] > n[k - 1]) else k - 1
                n[j] += low
                start[j] = min(start[j], start[k])
                del start[k], n[k], row[k]
            kept += row
            kept_starts += start
            kept_ns += n
            offsets.append(len(kept))
        values = flat.field("value").take(pa.array(kept, pa.int64()))
        columns = [pa.array(kept_starts, flat.field("start").type), pa.array(kept_ns, flat.field("n").type), values]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "n", "value"]))

    groups = dealt(runs.select(*part, "start", "n", "value"), *part).groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("start", "n", "value"))).alias("runs"))
    narrow = F.exists("runs", lambda x: x["n"] < least) & (F.size("runs") > 1)
    # not deterministic: or it would run a second time, to leave out empty arrays
    left = F.when(narrow, absorb.asNondeterministic()(F.when(narrow, F.col("runs")))).otherwise(F.col("runs"))
    return groups.select(*part, left.alias("runs")).select(*part, F.explode("runs").alias("r")).select(*part, "r.start", "r.n", "r.value")


def instance_overlaps(mask_pixels: DataFrame, least_pixels: int = MERGE_PIXELS, least_iou: float = MERGE_IOU) -> DataFrame:
    """u, v: masks of different views of an image whose overlap over their shared pixels is large.
    ``mask_pixels``: image_id, view, mask, row, col; a mask is named within its view."""
    mask, placed = F.struct("view", "mask"), F.col("row").isNotNull() & F.col("col").isNotNull()
    rows = mask_pixels.repartition("image_id")
    pixels = rows.where(placed).groupBy("image_id", "row", "col").agg(F.collect_list(mask).alias("masks")).select("image_id", "masks")
    return pixel_overlaps(pixels.union(rows.where(~placed).select("image_id", F.array(mask))), least_pixels, least_iou)


def pixel_overlaps(pixels: DataFrame, least_pixels: int = MERGE_PIXELS, least_iou: float = MERGE_IOU) -> DataFrame:
    """u, v, both, iou like :func:`instance_overlaps`, where a pixel holds its masks. ``pixels``: image_id, masks (array
    of view, mask). Where they are dealt by image, nothing is exchanged: a mask's size is its overlap with itself."""
    first = pixels.select("image_id", "masks", F.posexplode("masks").alias("i", "a"))
    pairs = first.select("image_id", "i", "a", F.posexplode("masks").alias("j", "b")).where((F.col("i") == F.col("j")) | (F.col("a.view") < F.col("b.view")))
    flat = pairs.select("image_id", F.col("i") == F.col("j"), "a.view", "a.mask", "b.view", "b.mask").toDF("image_id", "own", "view", "mask", "view2", "mask2")
    counts = flat.groupBy(*flat.columns).agg(F.count("*").alias("both"))
    size = F.max(F.when(F.col("own"), F.col("both")))
    sizes = {"n": size.over(Window.partitionBy("image_id", "view", "mask")), "n2": size.over(Window.partitionBy("image_id", "view2", "mask2"))}
    iou = F.col("both") / (F.col("n") + F.col("n2") - F.col("both"))
    rows = counts.withColumns(sizes).where(~F.col("own") & (F.least("n", "n2") >= least_pixels) & (iou >= least_iou))
    return rows.select(F.concat_ws("/", "image_id", "view", "mask").alias("u"), F.concat_ws("/", "image_id", "view2", "mask2").alias("v"), "both", F.round(iou, 6).alias("iou"))


def connected(edges: DataFrame, land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root: the least node that each is connected with, by handing the least label on along the
    edges and along labels until nothing changes. ``land`` writes a round and reads it back."""
    # not a union, for which the edges would be made twice
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = land(edges.select(F.explode(ways).alias("e")).select("e.u", "e.v").distinct())
    labels = land(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        better = labels.join(heard, "node").select("node", F.least("root", "heard").alias("root"))
        jumped = better.join(better.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        now = land(jumped.select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = now.join(labels, ["node", "root"], "left_anti").isEmpty()
        labels = now
        if changed:
            return labels


def pick(pixels: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """point_id, owner, label, instance at the points' (u, v) of an image."""
    at = points.select("point_id", "image_id", F.least(F.floor(F.col("u") * width), F.lit(width - 1)).cast("int").alias("col"), F.least(F.floor(F.col("v") * height), F.lit(height - 1)).cast("int").alias("row"))
    return at.join(pixels, ["image_id", "row", "col"], "left").select("point_id", "owner", "label", "instance")


def labels_from_edits(views: DataFrame, edits: DataFrame, shown: DataFrame, sliver_pixels: int) -> DataFrame:
    """image_id, building_id, label, reason: edited views are bad, shown ones good unless too small, and
    views never shown have no label."""
    edited = edits.groupBy("image_id", "building_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("reason"))).alias("reason"))
    rows = views.select("image_id", "building_id", "pixels").join(edited, ["image_id", "building_id"], "left").join(shown.select("image_id", "building_id", F.lit(True).alias("shown")).distinct(), ["image_id", "building_id"], "left")
    label = F.when(F.col("reason").isNotNull(), "bad").when(F.col("shown"), F.when(F.col("pixels") < sliver_pixels, "bad").otherwise("good"))
    reason = F.coalesce("reason", F.when(F.col("shown") & (F.col("pixels") < sliver_pixels), F.lit("sliver")))
    return rows.select("image_id", "building_id", label.alias("label"), reason.alias("reason")).where("label IS NOT NULL")


def mask_signals(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Per (image, label): pixels, shares of the picture, of columns outside the projection and of what is
    high above the horizon, fill of the column spans, and coverage of the projection."""
    mask = pixels.where("label > 0")
    projected = pixels.where("owner > 0").groupBy("image_id", F.col("owner").alias("label"), "col").agg(F.count("*").alias("p"))
    columns = mask.groupBy("image_id", "label", "col").agg(
        F.count("*").alias("n"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.count_if(F.col("owner") == F.col("label")).alias("both"),
        F.count_if(F.lit(90.0) - (F.col("row") + 0.5) / height * 180.0 > 50.0).alias("high"),
    )
    joined = columns.join(projected, ["image_id", "label", "col"], "left")
    whole = projected.groupBy("image_id", "label").agg(F.sum("p").alias("expected"))
    sums = joined.groupBy("image_id", "label").agg(
        F.sum("n").alias("pixels"), F.count("*").alias("columns"), F.sum(F.when(F.col("p").isNull(), F.col("n")).otherwise(0)).alias("outside"),
        F.sum("high").alias("high"), F.sum(F.col("bottom") - F.col("top") + 1).alias("span"), F.sum("both").alias("both"),
    )
    rows = sums.join(whole, ["image_id", "label"], "left")
    return rows.select(
        "image_id", "label", "pixels",
        F.round(F.col("pixels") / F.lit(width * height), 5).alias("pixel_share"),
        F.round(F.col("columns") * 360.0 / width, 2).alias("width_degrees"),
        F.round(F.col("outside") / F.col("pixels"), 3).alias("outside_share"),
        F.round(F.col("pixels") / F.col("span"), 3).alias("fill"),
        F.round(F.col("high") / F.col("pixels"), 3).alias("overhead_share"),
        F.round(F.col("both") / F.col("expected"), 3).alias("coverage"),
    )


def diagnostic_scores(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """type, hits, found, wanted, precision, recall of diagnostics against the truth."""
    rows = found.select("type", *keys, F.lit(True).alias("f")).distinct().join(wanted.select("type", *keys, F.lit(True).alias("w")).distinct(), ["type", *keys], "full")
    hit = F.count_if(F.col("f") & F.col("w"))
    return rows.groupBy("type").agg(
        hit.alias("hits"), F.count_if("f").alias("found"), F.count_if("w").alias("wanted"),
        F.round(hit / F.nullif(F.count_if("f"), F.lit(0)), 4).alias("precision"), F.round(hit / F.nullif(F.count_if("w"), F.lit(0)), 4).alias("recall"),
    )


def circle_column(bearing: Column, heading: Column, width: int) -> Column:
    """The panorama column that faces a bearing; the middle one faces the heading."""
    return F.floor(F.pmod((bearing - heading) / 360.0 + 0.5, F.lit(1.0)) * width)
