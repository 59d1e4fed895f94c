"""Answers of views: parsing, votes, and weighted fusion with abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a second choice, and accepted ranges of an answer's numbers.
ALTERNATE_WEIGHT, MAX_FLOORS, YEARS, OBSERVATION_CHARS = 0.5, 150, (1000, 2100), 400
ANSWER = "observations string, floors string, construction_year string, building_type string, alternate_building_type string, gem_material string, alternate_gem_material string"


def visible_reasoning(text: Column) -> Column:
    """The notes before the JSON of an answer, without reasoning blocks."""
    ends = [F.when(F.locate(m, text) > 0, F.locate(m, text) - 1) for m in ("```", "\n{", '{"')]
    cut = F.when(F.ltrim(text).startswith("{"), F.lit(0)).otherwise(F.least(*ends, F.length(text)))
    notes = F.regexp_replace(F.substr(text, F.lit(1), cut), r"(?s)<think>.*?(</think>|$)", "")
    return F.regexp_replace(notes, r"^\s+|\s+$", "")


def last_object(text: Column) -> Column:
    """The last flat JSON object in a text that parses, as its fields; raw line breaks are allowed."""
    spans = F.reverse(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)))
    options = {"allowUnquotedControlChars": "true", "allowNumericLeadingZeros": "true"}
    parsed = F.transform(spans, lambda s: F.from_json(s, ANSWER + ", _bad string", {**options, "columnNameOfCorruptRecord": "_bad"}))
    return F.get(F.filter(parsed, lambda p: p["_bad"].isNull()), F.lit(0))


def choice(value: Column, classes: tuple[str, ...]) -> Column:
    """The class that a value names, without regard to case, spaces and hyphens."""
    name = F.replace(F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return F.get(F.filter(F.array(*map(F.lit, classes)), lambda c: F.lower(c) == name), F.lit(0))


def parse_answers(answers: DataFrame, classes: dict[str, tuple[str, ...]], text: str = "text") -> DataFrame:
    """The answers with their validated fields; what is missing or invalid is null."""
    rows = answers.withColumn("__a", last_object(F.col(text)))
    floors, year = F.col("__a.floors").try_cast("double"), F.col("__a.construction_year").try_cast("double")
    fields = [
        F.nullif(F.substring(F.trim(F.regexp_replace("__a.observations", r"\s+", " ")), 1, OBSERVATION_CHARS), F.lit("")).alias("observations"),
        F.when((floors > 0) & (floors <= MAX_FLOORS), floors).alias("floors"),
        F.when(year.between(*YEARS), year).alias("construction_year"),
    ]
    for name, own in classes.items():
        fields += [choice(F.col(f"__a.{name}"), own).alias(name), choice(F.col(f"__a.alternate_{name}"), own).alias(f"alternate_{name}")]
    return rows.select("*", *fields).drop("__a")


def view_votes(answers: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """keys, class, score: a vote for the first choice and half a vote for another second, adding up to one."""
    a, b = F.col(first), F.col(second)
    two = b.isNotNull() & ~b.eqNullSafe(a)
    total = F.when(a.isNotNull(), 1.0).otherwise(0.0) + F.when(two, ALTERNATE_WEIGHT).otherwise(0.0)
    votes = F.array(
        F.when(a.isNotNull(), F.struct(a.alias("class"), (1.0 / total).alias("score"))),
        F.when(two, F.struct(b.alias("class"), (ALTERNATE_WEIGHT / total).alias("score"))),
    )
    return answers.select(*keys, F.explode(F.filter(votes, lambda v: v.isNotNull())).alias("v")).select(*keys, "v.class", "v.score")


def fuse_categorical(
    votes: DataFrame, group: list[str], view: list[str], classes: tuple[str, ...], min_views: int = 1, min_share: float = 0.5
) -> DataFrame:
    """group, top, share, views, abstained, reason: the weighted mean of the views' distributions.

    ``votes``: group, view, class, score, weight. A view counts with its weight even if it names unknown
    classes only; the shares are those among the known. Equal shares go to the first of ``classes``.
    Each (group, class) is summed where it is read, so a group of any size costs a row per class."""
    rows = votes.where("weight > 0")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("class"))
    sums = rows.groupBy(*group, "class").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    counted = rows.select(*group, *view).distinct().groupBy(*group).agg(F.count("*").alias("views"))
    known = sums.withColumn("place", place).where("place > 0")
    ranked = known.groupBy(*group).agg(F.sum("s").alias("mass"), F.max_by(F.struct("class", "s"), F.struct("s", -F.col("place"))).alias("t"))
    joined = counted.join(ranked, group, "left")
    share = F.round(F.col("t.s") / F.nullif(F.col("mass"), F.lit(0.0)), 6)
    reason = (
        F.when(F.col("views") < min_views, F.concat(F.col("views").cast("string"), F.lit(f" usable views, {min_views} required")))
        .when(share.isNull(), "views named no known class")
        .when(share < min_share, F.format_string(f"top share %.2f is below {min_share:.2f}", share))
    )
    return joined.select(*group, F.when(share.isNotNull(), F.col("t.class")).alias("top"), share.alias("share"), "views", reason.isNotNull().alias("abstained"), reason.alias("reason"))


def _reached(group: list[str], value: str, weight: str, order: list[str]) -> Column:
    """The value where the weight of the rows up to it, in order, has come to half of the group's."""
    run = F.sum(weight).over(Window.partitionBy(*group).orderBy(value, *order).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(run >= F.sum(weight).over(Window.partitionBy(*group)) / 2, F.col(value))


def weighted_median(rows: DataFrame, group: list[str], value: str, weight: str, order: list[str]) -> DataFrame:
    """group, median: the first value at which the running weight reaches half of all."""
    return rows.withColumn("__at", _reached(group, value, weight, order)).groupBy(*group).agg(F.min("__at").alias("median"))


def fuse_numeric(values: DataFrame, group: list[str], order: list[str], min_views: int = 1) -> DataFrame:
    """group, value, spread, views: weighted median and weighted median absolute deviation. All windows are
    over the group, which is exchanged once."""
    rows = values.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('inf') AND weight > 0").select(*group, "value", "weight", *order)
    middle = rows.withColumn("__at", _reached(group, "value", "weight", order)).withColumn("__middle", F.min("__at").over(Window.partitionBy(*group)))
    off = middle.withColumn("off", F.abs(F.col("value") - F.col("__middle")))
    sums = off.withColumn("__off", _reached(group, "off", "weight", order)).groupBy(*group).agg(
        F.round(F.min("__middle"), 3).alias("value"), F.round(F.min("__off"), 3).alias("spread"), F.count("*").alias("views")
    )
    return sums.where(F.col("views") >= min_views)


def abstain_all(buildings: DataFrame, attributes: tuple[str, ...], reason: Column) -> DataFrame:
    """An abstention on every attribute for buildings without a clean view."""
    return buildings.select("building_id", F.explode(F.array(*map(F.lit, attributes))).alias("attribute"), F.lit(True).alias("abstained"), reason.alias("reason"))
