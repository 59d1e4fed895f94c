"""Scores of predictions against reference values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.operators.ranks import ranked


def categorical_scores(rows: DataFrame, group: list[str]) -> DataFrame:
    """group and n, answered, coverage, accuracy, balanced_accuracy, macro_f1, majority_baseline over
    rows of (group, truth, predicted); a null prediction is an abstention. The confusion counts are
    made where the rows are, so later steps see a row per pair of classes."""
    counts = rows.groupBy(*group, "truth", "predicted").agg(F.count("*").alias("c"))
    totals = counts.groupBy(*group).agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("predicted").isNotNull(), F.col("c"))), F.lit(0)).alias("answered"),
        F.coalesce(F.sum(F.when(F.col("predicted") == F.col("truth"), F.col("c"))), F.lit(0)).alias("right"),
    )
    said = counts.where("predicted IS NOT NULL")
    both = said.select(*group, F.col("truth").alias("class"), F.col("c").alias("support"), F.when(F.col("truth") == F.col("predicted"), F.col("c")).otherwise(0).alias("tp"), F.lit(0).alias("guessed")).union(
        said.select(*group, F.col("predicted").alias("class"), F.lit(0), F.lit(0), F.col("c"))
    )
    classes = both.groupBy(*group, "class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "guessed")])
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("guessed"))
    summary = classes.groupBy(*group).agg(F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), F.max("support").alias("most"))
    return totals.join(summary, group, "left").select(
        *group,
        "n",
        "answered",
        F.round(F.col("answered") / F.col("n"), 4).alias("coverage"),
        F.round(F.col("right") / F.nullif(F.col("answered"), F.lit(0)), 4).alias("accuracy"),
        F.round("balanced_accuracy", 4).alias("balanced_accuracy"),
        F.round("macro_f1", 4).alias("macro_f1"),
        F.round(F.col("most") / F.nullif(F.col("answered"), F.lit(0)), 4).alias("majority_baseline"),
    )


def numeric_scores(rows: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """group and n, answered, mae, bias, r2, median_baseline_mae, within_tolerance of (group, truth_value,
    predicted_value)."""
    said = rows.where("predicted_value IS NOT NULL")
    middle = said.groupBy(*group).agg(F.median("truth_value").alias("middle"))
    off = F.col("predicted_value") - F.col("truth_value")
    sums = said.join(middle, group).groupBy(*group).agg(
        F.count("*").alias("answered"),
        F.round(F.avg(F.abs(off)), 3).alias("mae"),
        F.round(F.avg(off), 3).alias("bias"),
        F.when(F.var_pop("truth_value") > 0, F.round(1 - F.avg(off * off) / F.var_pop("truth_value"), 4)).alias("r2"),
        F.round(F.avg(F.abs(F.col("truth_value") - F.col("middle"))), 3).alias("median_baseline_mae"),
        F.round(F.avg(F.when(F.abs(off) <= tolerance, 1.0).otherwise(0.0)), 4).alias("within_tolerance"),
    )
    n = rows.groupBy(*group).agg(F.count("*").alias("n"))
    return n.join(sums, group, "left").fillna(0, ["answered"])


def risk_coverage(rows: DataFrame, group: list[str], order: list[str], land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """group, share, coverage, accuracy of the most confident answers at a quarter, half, three quarters
    and all of them. ``rows``: group, truth, predicted, confidence; order breaks ties. ``land`` writes a
    table and reads it back."""
    said = ranked(rows.where("predicted IS NOT NULL"), group, [F.desc("confidence"), *map(F.col, order)], land)
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count("predicted").alias("answered"))
    shares = counts.withColumn("share", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0)))))
    kept = F.greatest(F.lit(1), F.bround(F.col("answered") * F.col("share")).cast("long"))
    cuts = shares.where("answered > 0").withColumn("kept", kept)
    right = F.avg(F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0))
    joined = said.join(cuts, group).where(F.col("rn") <= F.col("kept"))
    out = joined.groupBy(*group, "share", "n", "kept").agg(F.round(right, 4).alias("accuracy"))
    return out.select(*group, "share", F.round(F.col("kept") / F.col("n"), 4).alias("coverage"), "accuracy")


def common_subset(rows: DataFrame, key: str, run: str, answered: str) -> DataFrame:
    """The keys answered by every run that answers at least half of them. ``rows``: run, key, answered."""
    n = rows.select(key).distinct().count()
    per_run = rows.where(answered).groupBy(run).agg(F.count_distinct(key).alias("c"))
    deciding = per_run.where(F.col("c") * 2 >= n).select(run)
    said = rows.where(answered).join(deciding, run, "left_semi").select(run, key).distinct()
    return said.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") == deciding.count()).select(key)


def evaluate_flags(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: bad and good views, unscored ones, recall and false alarms of the mask rules. ``labels``:
    image_id, building_id, label; ``scored``: image_id, building_id, ok."""
    rows = labels.join(scored, ["image_id", "building_id"], "left")
    bad, good = F.col("label") == "bad", F.col("label") == "good"
    there = F.col("ok").isNotNull()
    share = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 3)
    return rows.agg(
        F.count_if(bad & there).alias("bad"),
        F.count_if(good & there).alias("good"),
        F.count_if(~there).alias("unscored"),
        share(bad & ~F.col("ok"), bad & there).alias("recall"),
        share(good & ~F.col("ok"), good & there).alias("false_alarms"),
    )


def relative_degradation(rows: DataFrame) -> DataFrame:
    """corruption and the error above the clean error, summed over severities, of (corruption, error, clean)."""
    return rows.groupBy("corruption").agg(F.sum(F.col("error") - F.col("clean")).alias("degradation"))


def relative_mce(own: DataFrame, reference: DataFrame) -> DataFrame:
    """The mean over corruptions of the degradation over the reference's; undefined ratios are skipped."""
    both = own.join(reference.withColumnRenamed("degradation", "theirs"), "corruption")
    return both.agg(F.avg(F.col("degradation") / F.nullif(F.col("theirs"), F.lit(0.0))).alias("relative_mce"))


def truth_coverage(truth: DataFrame, attributes: list[str]) -> DataFrame:
    return truth.groupBy("source").pivot("attribute", attributes).agg(F.count(F.lit(1))).fillna(0)


def experiment_report(rows: DataFrame) -> DataFrame:
    """Categorical scores by run for all buildings, the common subset and each use. ``rows``: run,
    building_id, truth, predicted, use."""
    shared = common_subset(rows.withColumn("said", F.col("predicted").isNotNull()), "building_id", "run", "said")
    common = rows.join(shared, "building_id", "left_semi").withColumn("subset", F.lit("common"))
    every = rows.withColumn("subset", F.explode(F.array(F.lit("all"), F.concat(F.lit("use "), "use"))))
    return categorical_scores(every.unionByName(common), ["run", "subset"])


def run_summary(events: DataFrame) -> DataFrame:
    """status, buildings, median seconds."""
    return events.groupBy("status").agg(F.count("*").alias("buildings"), F.median("seconds").alias("median_seconds"))
