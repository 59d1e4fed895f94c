"""Documents on disk as tables: capture manifests, analyses, predictions, logs, labels, files, maps.

All are read with a schema, so a bad field is a null and a broken document a row that is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "struct<type: string, coordinates: array<double>>"
MANIFEST = f"""query struct<provider: string, acquired_at: string>, images array<struct<id: string, source_page: string, local_file: string, captured_at_ms: bigint,
sequence_id: string, is_pano: boolean, selected_geometry: {_POINT}, computed_geometry: {_POINT}, geometry: {_POINT}, computed_compass_angle_deg: double,
computed_rotation: array<double>, camera_up: array<double>, width: int, height: int, sha256: string, creator: struct<id: string, username: string>, license: string>>"""
ANALYSIS = """version int, image_id string, width int, height int, image_quality struct<sharpness: double, brightness: double, file_bytes: bigint, flags: array<string>>,
building_ids map<string, struct<osm_id: string, pixels: bigint, inferred_pixels: bigint, confidence: double, osm_version: int>>,
footprint_diagnostics array<struct<type: string, osm_id: string, instance: int, evidence_pixels: bigint, east_m: double, north_m: double, pose_accepted: boolean>>"""
PREDICTIONS = """provider string, building struct<id: string>,
predictions map<string, struct<type: string, scores: map<string, double>, score_kind: string, value: double, spread: double, abstained: boolean, reason: string>>"""
LEDGER = "image string, stage string, status string, settings string, size bigint, mtime_ns bigint, at string, attempts int, error string"
LABELS = "dataset string, analysis_versions array<int>, views array<struct<image: string, building: string, label: string, reasons: array<string>>>"


def _dataset():
    """The folder that holds a file."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def read_captures(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A row per image of every manifest; documents without an image list give none."""
    docs = spark.read.schema(MANIFEST).option("multiLine", multi_line).json(path)
    rows = docs.select(_dataset().alias("dataset"), F.explode("images").alias("i"))
    chosen = F.coalesce("i.selected_geometry", "i.computed_geometry", "i.geometry")
    return rows.where("i.id IS NOT NULL").select("dataset", F.col("i.id").alias("image_id"), chosen["coordinates"][0].alias("lon"), chosen["coordinates"][1].alias("lat"), "i.*").drop("id")


def read_views(spark: SparkSession, path: str, version: int, multi_line: bool = True) -> DataFrame:
    """A row per building of every analysis of the wanted version."""
    docs = spark.read.schema(ANALYSIS).option("multiLine", multi_line).json(path).where(F.col("version") == version)
    rows = docs.select(_dataset().alias("dataset"), "image_id", "width", "height", F.coalesce("image_quality.flags", F.array().cast("array<string>")).alias("flags"), F.explode("building_ids").alias("ordinal", "b"))
    return rows.select("dataset", "image_id", "width", "height", "flags", F.col("b.osm_id").alias("building_id"), "b.pixels", F.col("b.confidence").alias("coverage"), "b.osm_version")


def read_predictions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """building_id, provider, attribute, the prediction's fields and when its file changed."""
    docs = spark.read.schema(PREDICTIONS).option("multiLine", multi_line).json(path)
    rows = docs.select(F.col("building.id").alias("building_id"), "provider", F.col("_metadata.file_modification_time").alias("modified_at"), F.explode("predictions").alias("attribute", "p"))
    return rows.select("building_id", "provider", "attribute", "modified_at", "p.*")


def read_ledger(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The entries of JSON-lines logs; torn and foreign lines are left out."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("image IS NOT NULL AND stage IS NOT NULL")


def read_view_labels(spark: SparkSession, path: str) -> DataFrame:
    """dataset, version, image_id, building_id, label, reasons."""
    docs = spark.read.schema(LABELS).option("multiLine", True).json(path)
    rows = docs.select("dataset", F.explode("analysis_versions").alias("version"), F.col("views").alias("vs"))
    return rows.select("dataset", "version", F.explode("vs").alias("v")).select("dataset", "version", F.col("v.image").alias("image_id"), F.col("v.building").alias("building_id"), "v.label", "v.reasons")


def guarded_labels(labels: DataFrame, analyses: DataFrame) -> DataFrame:
    """The labels made for the analysis versions that a dataset has."""
    return labels.join(analyses.select("dataset", "version").distinct(), ["dataset", "version"], "left_semi")


def file_inventory(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """path, size, modified and, if wanted, the SHA-256 of each file; without it no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*columns, *([F.sha2("content", 256).alias("sha256")] if hashed else []))
