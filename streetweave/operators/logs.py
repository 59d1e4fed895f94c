"""Append-only logs of work: latest state, what is done, progress, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetweave.operators.ranks import ranked

# Completions a rate is taken from, attempts and failures in a row that end a run.
RATE_WINDOW, MAX_ATTEMPTS, MAX_FAILURES = 40, 6, 10
PERMANENT = ("missing_file", "no_coordinates", "no_heading", "invalid_image")


def latest_by_key(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e")).select(*keys, "e.*")


def is_done(latest: DataFrame, inventory: DataFrame, fingerprint: Column) -> DataFrame:
    """The inventory (stage, image, size, mtime_ns) with done: the last entry says so for the same settings
    and the same file."""
    entry = latest.select("stage", "image", "status", "settings", F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"))
    rows = inventory.join(entry, ["stage", "image"], "left")
    done = (F.col("status") == "done") & (F.col("settings") == fingerprint) & F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime_ns").eqNullSafe(F.col("__mtime"))
    return rows.select("stage", "image", F.coalesce(done, F.lit(False)).alias("done"))


def analysis_status(captures: DataFrame, analyses: DataFrame, version: int) -> DataFrame:
    """image_id, status: current, stale or missing."""
    own = analyses.select("image_id", F.col("version").alias("__v"))
    rows = captures.select("image_id").join(own, "image_id", "left")
    return rows.select("image_id", F.when(F.col("__v").isNull(), "missing").when(F.col("__v") == version, "current").otherwise("stale").alias("status"))


def capture_status(latest: DataFrame, captures: DataFrame) -> DataFrame:
    """status, captures: done, failed, skipped or pending."""
    known = F.when(F.col("status").isin("done", "failed", "skipped"), F.col("status")).otherwise("pending")
    rows = captures.select(F.col("image_id").alias("image")).join(latest.select("image", "status"), "image", "left")
    return rows.groupBy(known.alias("status")).agg(F.count("*").alias("captures"))


def progress(log: DataFrame, group: list[str], total: Column, window: int = RATE_WINDOW) -> DataFrame:
    """group, completed, rate_per_minute, eta_s from the last completions. ``log``: group, at_ms, seq."""
    order = Window.partitionBy(*group).orderBy(F.desc("at_ms"), F.desc("seq"))
    recent = log.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= window)
    span = F.max("at_ms") - F.min("at_ms")
    rate = F.when((F.count("*") > 1) & (span > 0), (F.count("*") - 1) / (span / 1000.0))
    rates = recent.groupBy(*group).agg(rate.alias("rate"))
    done = log.groupBy(*group).agg(F.count("*").alias("completed"))
    rows = done.join(rates, group)
    left = total - F.col("completed")
    return rows.select(*group, "completed", F.round(F.col("rate") * 60, 2).alias("rate_per_minute"), F.when(left <= 0, 0.0).otherwise(F.round(left / F.col("rate"), 0)).alias("eta_s"))


def failure_class(reason: Column) -> Column:
    return F.when(reason.isin(*PERMANENT), "permanent").otherwise("transient")


def retry_candidates(log: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """stage, image, attempts of work whose last entry failed and that hasn't failed too often."""
    last = F.max_by("status", "seq")
    rows = log.groupBy("stage", "image").agg(last.alias("status"), F.count_if(F.col("status") == "failed").alias("attempts"))
    return rows.where((F.col("status") == "failed") & (F.col("attempts") < limit)).select("stage", "image", "attempts")


def failures_in_a_row(log: DataFrame, part: list[str], land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """part, longest: the longest run of failures in log order. ``land`` writes a table and reads it back."""
    every = ranked(log.select(*part, "seq", "status"), part, [F.col("seq")], land).where("status = 'failed'").withColumnRenamed("rn", "__n")
    rows = ranked(every, part, [F.col("seq")], land).withColumn("__run", F.col("__n") - F.col("rn"))
    runs = rows.groupBy(*part, "__run").agg(F.count("*").alias("n"))
    return runs.groupBy(*part).agg(F.max("n").alias("longest"))


def should_abort(log: DataFrame, part: list[str], land: Callable[[DataFrame], DataFrame], limit: int = MAX_FAILURES) -> DataFrame:
    return failures_in_a_row(log, part, land).select(*part, (F.col("longest") >= limit).alias("abort"))


def fold_reviews(events: DataFrame) -> DataFrame:
    """building_id, attribute, value of the reviews in force: the last value of each attribute after the
    building's last withdrawal. ``events``: building_id, action, attribute, value, seq."""
    withdrawn = events.where("action = 'withdraw'").groupBy("building_id").agg(F.max("seq").alias("since"))
    rows = events.where("action = 'review'").join(withdrawn, "building_id", "left").where("since IS NULL OR seq > since")
    return rows.groupBy("building_id", "attribute").agg(F.max_by("value", "seq").alias("value"))


def ready_buildings(expected: DataFrame, latest: DataFrame) -> DataFrame:
    """building_id, done_set: buildings all of whose expected captures are visited and one at least done;
    ``done_set`` is a hash of those, so a change can be told."""
    rows = expected.join(latest.select(F.col("image").alias("image_id"), "status"), "image_id", "left")
    sums = rows.groupBy("building_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status").isin("done", "skipped", "failed")).alias("visited"), F.count_if(F.col("status") == "done").alias("done"),
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("status") == "done", F.col("image_id"))))), 256).alias("done_set"),
    )
    return sums.where("visited = n AND done > 0").select("building_id", "done", "done_set")


def settings_agreement(analyses: DataFrame) -> DataFrame:
    """dataset, settings, agree: how many configurations a dataset's analyses have."""
    return analyses.groupBy("dataset").agg(F.count_distinct("settings").alias("settings")).select("dataset", "settings", (F.col("settings") == 1).alias("agree"))


def input_fingerprint(rows: DataFrame, group: list[str], key: str, value: str, land: Callable[[DataFrame], DataFrame], width: int = 1024) -> DataFrame:
    """group, inputs_sha256, rows: a tree of hashes over the sorted ``key:value`` lines. ``width`` lines in a
    row make a hash, as many of these the next one, and the hashes of that level the last; so no task sees
    more than ``width`` lines of a group. ``land`` writes a table and reads it back."""
    lines = rows.select(*group, F.concat(F.col(key), F.lit(":"), F.col(value)).alias("x"))
    now = ranked(lines, group, [F.col("x")], land).select(*group, (F.col("rn") - 1).alias("at"), "x", F.lit(1).cast("long").alias("rows"))

    def hashed(level: DataFrame, keys: list) -> DataFrame:
        inside = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"])
        return level.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", inside), 256).alias("x"), F.sum("rows").alias("rows"))

    for _ in range(2):
        now = hashed(now, [*group, F.floor(F.col("at") / width).alias("up")]).withColumnRenamed("up", "at")
    return hashed(now, group).select(*group, F.col("x").alias("inputs_sha256"), "rows")
