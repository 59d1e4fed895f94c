"""Attributes of buildings from several providers: tags, models and reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetweave.functions.fields import plausible_year

# Classes of the attributes, tag values that name a class, and limits of the review queue.
BUILDING_TYPES = ("apartments", "house", "retail", "office", "hotel", "industrial", "religious", "education", "public", "garage")
SURFACE_MATERIALS = ("brick", "wood", "concrete", "metal", "stone", "glass", "plaster")
GEM_MATERIALS = ("CR", "CU", "C99", "SRC", "S", "ME", "MUR", "MCF", "MR", "M99", "EU", "ER", "E99", "W")
GEM_LLRS = ("LFM", "LFINF", "LFBR", "LPB", "LWAL", "LDUAL", "LFLS", "LFLSINF", "LH", "LN")
TYPE_TAGS = {
    "apartments": ("apartments", "dormitory"),
    "house": ("house", "detached", "semidetached_house", "terrace", "bungalow"),
    "retail": ("retail", "supermarket", "kiosk"),
    "office": ("office", "commercial"),
    "hotel": ("hotel",),
    "industrial": ("industrial", "warehouse", "factory"),
    "religious": ("church", "chapel", "cathedral", "mosque", "temple", "synagogue", "religious", "monastery"),
    "education": ("school", "university", "college", "kindergarten"),
    "public": ("public", "civic", "government", "hospital", "train_station", "fire_station"),
    "garage": ("garage", "garages", "parking", "carport"),
}
MATERIAL_TAGS = {
    "brick": ("brick",),
    "wood": ("wood", "timber_framing"),
    "concrete": ("concrete", "reinforced_concrete"),
    "metal": ("metal", "steel"),
    "stone": ("stone",),
    "glass": ("glass",),
    "plaster": ("plaster", "stucco"),
}
ATTRIBUTES = ("building_type", "surface_material", "gem_material", "gem_llrs", "floors", "construction_year")
WEAK_SHARE, STOREY_TOLERANCE, YEAR_TOLERANCE = 0.7, 0.5, 10.0


def tag_class(tag: Column, table: dict[str, tuple[str, ...]]) -> Column:
    value = F.lower(F.trim(tag))
    out = F.lit(None).cast("string")
    for name, own in table.items():
        out = F.when(value.isin(*own), name).otherwise(out)
    return out


def tag_floors(tag: Column) -> Column:
    value = F.replace(F.trim(tag), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value >= 0, value)


def tags_to_attributes(footprints: DataFrame) -> DataFrame:
    """The footprints with building_type, surface_material, floors and construction_year from their tags."""
    return footprints.select(
        "*",
        tag_class(F.col("building_tag"), TYPE_TAGS).alias("building_type"),
        tag_class(F.col("material_tag"), MATERIAL_TAGS).alias("surface_material"),
        tag_floors(F.col("levels_tag")).alias("floors"),
        plausible_year(F.col("start_tag")).alias("construction_year"),
    )


def tag_prior(footprints: DataFrame) -> DataFrame:
    """building_id, attribute, top, value, abstained, reason: the tags as a provider; structure has no tag."""
    rows = tags_to_attributes(footprints)
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def entry(name: str, top: Column, value: Column, reason: str) -> Column:
        missing = top.isNull() & value.isNull()
        return F.struct(F.lit(name).alias("attribute"), top.alias("top"), value.alias("value"), missing.alias("abstained"), F.when(missing, reason).alias("reason"))

    entries = F.array(
        entry("building_type", F.col("building_type"), number, "no unambiguous building tag"),
        entry("surface_material", F.col("surface_material"), number, "no unambiguous building:material tag"),
        entry("gem_material", none, number, "no tag for structural material"),
        entry("gem_llrs", none, number, "no tag for structural system"),
        entry("floors", none, F.col("floors"), "no building:levels tag"),
        entry("construction_year", none, F.col("construction_year").cast("double"), "no start_date tag"),
    )
    return rows.select("building_id", F.explode(entries).alias("e")).select("building_id", "e.*")


def taxonomy_string(material: Column, llrs: Column, floors: Column) -> Column:
    """MAT/LLRS/HEX:n with the codes for unknown; storeys are rounded half to even."""
    storeys = F.when(floors >= 1, F.concat(F.lit("HEX:"), F.bround(floors).cast("long").cast("string"))).otherwise("H99")
    return F.concat_ws("/", F.coalesce(material, F.lit("MAT99")), F.coalesce(llrs, F.lit("L99")), storeys)


def provider_rank(provider: Column) -> Column:
    return F.when(provider == "human-review", 0).when(provider == "osm-tag-prior", 1).otherwise(2)


def preferred_values(predictions: DataFrame) -> DataFrame:
    """One row per (building, attribute): the review if there is one, else the first usable value in the
    order tags, then models from the newest, else the last of all; ``others`` counts the rest."""
    order = [provider_rank(F.col("provider")), F.desc("modified"), "provider"]
    whole = Window.partitionBy("building_id", "attribute")
    usable = ~F.col("abstained") & F.coalesce(F.col("top"), F.col("value").cast("string")).isNotNull()
    place = F.row_number().over(whole.orderBy(*order))
    pick = F.when(F.col("provider") == "human-review", -1).when(usable, F.col("place")).otherwise(1_000_000 - F.col("place"))
    rows = predictions.withColumn("place", place).withColumn("pick", pick)
    best = rows.withColumn("rn", F.row_number().over(whole.orderBy("pick"))).withColumn("others", F.count("*").over(whole) - 1)
    return best.where("rn = 1").drop("rn", "pick", "place")


def attribute_columns(predictions: DataFrame, categorical: tuple[str, ...], numeric: tuple[str, ...]) -> DataFrame:
    """A wide row per building from one prediction per (building, attribute)."""
    cols = []
    for a in categorical:
        own = F.col("attribute") == a
        cols += [
            F.max(F.when(own & ~F.col("abstained"), F.col("top"))).alias(a),
            F.round(F.max(F.when(own, F.col("share"))), 4).alias(f"{a}_score"),
            F.max(F.when(own, F.col("abstained"))).alias(f"{a}_abstained"),
        ]
    for a in numeric:
        own = F.col("attribute") == a
        cols += [F.max(F.when(own, F.col("value"))).alias(a), F.max(F.when(own, F.col("abstained"))).alias(f"{a}_abstained")]
    return predictions.groupBy("building_id").agg(*cols)


def top_classes(scores: Column, k: int) -> Column:
    """The k largest entries of a map of scores, ties by name, as an array of (class, score)."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("class"), e["value"].alias("score")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["class"].alias("class"), e["score"].alias("score")))


def observations(answers: DataFrame, n: int = 3) -> DataFrame:
    """building_id, text: the first n different observations of a building, best view first."""
    first = answers.where("text IS NOT NULL").groupBy("building_id", "text").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("building_id").orderBy("rank", "text")
    return first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("building_id", "text", "rn")


def reference_check(rows: DataFrame) -> DataFrame:
    """Disagreements with the reference: storeys by more than half, years by more than ten, uses by name."""
    return rows.select(
        "*",
        (F.abs(F.col("floors") - F.col("ref_floors")) > STOREY_TOLERANCE).alias("floors_differ"),
        (F.abs(F.col("construction_year") - F.col("ref_year")) > YEAR_TOLERANCE).alias("year_differs"),
        (F.col("building_type") != F.col("ref_type")).alias("type_differs"),
    )


def reference_type(use: Column, dwellings: Column) -> Column:
    """The class of a cadastral use; homes need the number of dwellings."""
    return (
        F.when((use == "1_residential") & (dwellings == 1), "house")
        .when((use == "1_residential") & (dwellings > 1), "apartments")
        .when(use == "3_industrial", "industrial")
        .when(use == "4_1_office", "office")
        .when(use == "4_2_retail", "retail")
        .when(use == "4_3_publicServices", "public")
    )


def attribute_summary(card: DataFrame) -> DataFrame:
    """Per building: values, reviewed, why a reviewer should look, and urgency (lower first). ``card`` is
    :func:`preferred_values` of all attributes."""

    def of(name: str, what: Column) -> Column:
        return F.max(F.when((F.col("attribute") == name) & ~F.col("abstained"), what))

    model = F.col("provider").startswith("vlm:")
    weak = model & (F.col("attribute") == "gem_material") & ~F.col("abstained") & (F.col("share") < WEAK_SHARE)
    split = model & (F.col("attribute") == "gem_material") & F.col("abstained") & F.col("top").isNotNull()
    sums = card.groupBy("building_id").agg(
        of("gem_material", F.col("top")).alias("gem_material"),
        of("building_type", F.col("top")).alias("building_type"),
        of("floors", F.col("value")).alias("floors"),
        F.max(F.col("provider") == "human-review").alias("reviewed"),
        F.max(weak).alias("weak"),
        F.max(split).alias("split"),
        F.min(F.when(weak | split, F.coalesce("share", F.lit(0.0)))).alias("least"),
    )
    open_ = ~F.col("reviewed")
    reason = F.nullif(F.concat_ws("; ", F.when(F.col("split"), "split vote on the material"), F.when(F.col("weak"), "weak agreement on the material")), F.lit(""))
    return sums.select(
        "building_id", "gem_material", "building_type", "floors", "reviewed",
        F.when(open_, reason).alias("reason"),
        F.when(open_, F.coalesce("least", F.lit(1.0))).otherwise(1.0).alias("urgency"),
    )


def attribute_class(value: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The family of a code for colouring; unknown codes are "other", none is "none"."""
    out = F.when(value.isNull(), F.lit("none")).otherwise("other")
    for name, codes in families.items():
        out = F.when(value.isin(*codes), name).otherwise(out)
    return out


def floors_class(floors: Column) -> Column:
    return F.when(floors.isNull(), "none").when(floors <= 2, "1-2").when(floors <= 5, "3-5").when(floors <= 8, "6-8").otherwise("9+")


def class_counts(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """class, place, n for every class of ``order``, also those without rows."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "class string, place int")
    counts = rows.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    return fixed.join(counts, "class", "left").fillna(0, ["n"])


def review_queue(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All items in one list: the kinds in the order given, each by its own ``urgency``, then id.
    A source has dataset, item_id, urgency, resolved."""
    out = None
    for rank, (kind, items) in enumerate(sources):
        own = items.select("dataset", "item_id", F.col("urgency").cast("double").alias("urgency"), "resolved", F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"))
        out = own if out is None else out.unionByName(own)
    return out.orderBy("kind_rank", "urgency", "item_id")


def changed_inputs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """The (building_id, provider, fingerprint) rows whose work isn't stored for these inputs."""
    return wanted.join(stored, ["building_id", "provider", "fingerprint"], "left_anti")
