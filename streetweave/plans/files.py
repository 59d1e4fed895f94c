"""Queries of the sources, sinks and streams. What they read is first written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.operators import corrections
from streetweave.plans import records
from streetweave.plans import registry as r
from streetweave.plans.registry import query
from streetweave.plans.scenes import boxes
from streetweave.sources import documents, maps, sinks
from streetweave.sources.landing import landing
from streetweave.streaming import logs as streams


#: Rows of a file of XML, which one task reads whole.
FILE_ROWS = 100_000


def _path(spark: SparkSession, name: str) -> str:
    landing(spark, name)  # sets the shared folder where there is none
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _texts(rows: DataFrame, name: str) -> str:
    path = _path(rows.sparkSession, name)
    rows.select("value").write.text(path)
    return path


@query("S1", "SELECT image_id, round(lon, 7) AS lon, round(lat, 7) AS lat, captured_at_ms FROM captures", ("captures",))
def s1(spark: SparkSession, d: str) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    image = F.struct(F.col("image_id").alias("id"), "captured_at_ms", "sequence_id", point.alias("computed_geometry"), F.col("heading").alias("computed_compass_angle_deg"))
    docs = r.captures(spark, d).groupBy(F.floor(F.col("k") / 500)).agg(F.collect_list(image).alias("images"))
    rows = documents.read_captures(spark, _texts(docs.select(F.to_json(F.struct("images")).alias("value")), "manifest"), multi_line=False)
    return rows.select("image_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "captured_at_ms")


@query("S2", "SELECT image_id, building_id, pixels FROM views WHERE CAST(image_id AS BIGINT) % 5 > 0", ("views",))
def s2(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct(F.col("building_id").alias("osm_id"), "pixels", F.col("coverage").alias("confidence"))
    v = r.views(spark, d).groupBy("image_id").agg(F.collect_list(record).alias("rs"))
    ids = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("rs")), lambda i: i.cast("string")), F.col("rs"))
    version = F.when(F.col("image_id").cast("long") % 5 == 0, 32).otherwise(33)
    docs = v.select(F.to_json(F.struct(version.alias("version"), "image_id", F.lit(2000).alias("width"), F.lit(1000).alias("height"), ids.alias("building_ids"))).alias("value"))
    return documents.read_views(spark, _texts(docs, "analyses"), 33, multi_line=False).select("image_id", "building_id", "pixels")


@query("S6", "SELECT building_id, provider, attribute, value, abstained FROM predictions", ("predictions",))
def s6(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct("attribute", F.struct(F.lit("numeric").alias("type"), "value", "abstained"))
    p = r.predictions(spark, d).groupBy("building_id", "provider").agg(F.map_from_entries(F.collect_list(entry)).alias("predictions"))
    docs = p.select(F.to_json(F.struct("provider", F.struct(F.col("building_id").alias("id")).alias("building"), "predictions")).alias("value"))
    return documents.read_predictions(spark, _texts(docs, "predictions"), multi_line=False).select("building_id", "provider", "attribute", "value", "abstained")


@query("S7", "SELECT image, stage, status FROM ledger", ("ledger",))
def s7(spark: SparkSession, d: str) -> DataFrame:
    lines = r.ledger(spark, d).select(F.to_json(F.struct("image", "stage", "status", "settings")).alias("value"), "seq")
    torn = lines.where(F.col("seq") % 10 == 0).select(F.substring("value", 1, 20).alias("value"))
    return documents.read_ledger(spark, _texts(lines.select("value").union(torn), "ledger")).select("image", "stage", "status")


@query("S9", "SELECT count(*) AS lines FROM orders")
def s9(spark: SparkSession, d: str) -> DataFrame:
    path = _texts(r.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("value")), "files")
    files = documents.file_inventory(spark, path).where(F.col("path").endswith(".txt") & (F.length("sha256") == 64))
    return files.agg(F.lit(1)).select(F.lit(spark.read.text(path).count()).alias("lines"))


@query("S10", "SELECT building_id, image_id, CASE WHEN blurry THEN 'blurry' END AS flags FROM views", ("views",))
def s10(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "csv")
    sinks.write_csv(r.views(spark, d), ["building_id", "image_id", "flags"], path)
    return spark.read.csv(path, header=True, schema="building_id string, image_id string, flags string")


@query("S11", "SELECT image_id AS id, captured_at_ms, round(lon, 7) AS lon FROM captures", ("captures",))
def s11(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "geojson")
    rows = r.captures(spark, d).select("image_id", "captured_at_ms", sinks.point_geometry(F.col("lon"), F.col("lat")).alias("geometry"))
    sinks.write_geojson(rows, "image_id", "geometry", path)
    read = spark.read.schema("type string, id string, geometry struct<type: string, coordinates: array<double>>, properties struct<captured_at_ms: bigint>").json(path)
    return read.select("id", "properties.captured_at_ms", F.round(F.col("geometry.coordinates")[0], 7).alias("lon"))


@query("S12", "SELECT building_id, 102 AS bytes FROM footprints", ("footprints",))
def s12(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "geoparquet")
    sinks.write_geoparquet(boxes(spark, d).select("building_id", "geometry"), "geometry", path)
    return spark.read.parquet(path).select("building_id", F.length("geometry").alias("bytes"))


def accepted_outlines(spark: SparkSession, d: str) -> DataFrame:
    """osm_id, number, geometry of footprints whose active correction is of their version."""
    active = corrections.active_revision(corrections.fold_revisions(r.revisions(spark, d)))
    own = r.footprints(spark, d).select("building_id", "osm_version").join(active.hint("merge"), (F.col("osm_id") == F.col("building_id")) & (F.col("base_version") == F.col("osm_version")))
    # sizes guessed from small files would send whole tables, with their shapes, through the driver
    rows = boxes(spark, d).join(own.select("building_id").hint("merge"), "building_id")
    return rows.select(F.col("building_id").alias("osm_id"), F.col("k").alias("number"), "geometry")


@query("S13", "SELECT count(*) * 4 AS nodes, count(*) AS ways FROM footprints f JOIN active a ON a.osm_id = f.building_id AND a.base_version = f.osm_version", ("footprints", "active"))
def s13(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "osm")
    sinks.write_corrections_xml(accepted_outlines(spark, d), path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id bigint").load(f"{path}/nodes")
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id bigint").load(f"{path}/ways")
    return nodes.select(F.lit(1).alias("n"), F.lit(0).alias("w")).union(ways.select(F.lit(0), F.lit(1))).agg(F.sum("n").alias("nodes"), F.sum("w").alias("ways"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Ways of closed squares; every fifth is also the only member of a relation."""
    ring = F.transform(F.get(F.get("geometry", F.lit(0)), F.lit(0)), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    ways = boxes(spark, d).select("k", ring.alias("ring"))
    tags = F.create_map(F.lit("building"), F.lit("yes"))
    none = F.lit(None).cast("array<struct<type: string, ref: bigint, role: string, geometry: array<struct<lon: double, lat: double>>>>")
    one = ways.select(F.lit("way").alias("type"), F.col("k").cast("long").alias("id"), tags.alias("tags"), F.lit(1).alias("version"), F.lit("t").alias("timestamp"), F.col("ring").alias("geometry"), none.alias("members"))
    # a member's outline arrives in two pieces that meet at both ends
    halves = [F.struct(F.lit("way").alias("type"), F.col("k").cast("long").alias("ref"), F.lit("outer").alias("role"), x.alias("geometry")) for x in (F.slice("ring", 1, 3), F.reverse(F.slice("ring", 3, 3)))]
    two = ways.where(F.col("k") % 5 == 0).select(
        F.lit("relation").alias("type"), F.col("k").cast("long").alias("id"), tags.alias("tags"), F.lit(2).alias("version"), F.lit("t").alias("timestamp"), F.lit(None).cast("array<struct<lon: double, lat: double>>").alias("geometry"), F.array(*halves).alias("members")
    )
    return one.union(two)


@query("S3", "SELECT CASE WHEN k % 5 = 0 THEN 'relation/' ELSE 'way/' END || CAST(k AS VARCHAR) AS building_id, 5 AS corners FROM footprints", ("footprints",))
def s3(spark: SparkSession, d: str) -> DataFrame:
    out = maps.read_footprints(_elements(spark, d))
    return out.select("building_id", F.size(F.get(F.get("geometry", F.lit(0)), F.lit(0))).alias("corners"))


@query("S4", "SELECT 'way/' || CAST(k + 1 AS VARCHAR) AS building_id FROM footprints", ("footprints",))
def s4(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select((F.col("k") + 1).alias("k"), F.posexplode(F.get(F.get("geometry", F.lit(0)), F.lit(0))).alias("pos", "p"))
    nodes = b.where("pos < 4").select((F.col("k") * 10 + F.col("pos")).alias("_id"), F.col("p")[1].alias("_lat"), F.col("p")[0].alias("_lon"))
    refs = F.transform(F.array(*map(F.lit, (0, 1, 2, 3, 0))), lambda i: F.struct((F.col("k") * 10 + i).alias("_ref")))
    tag = F.array(F.struct(F.lit("building").alias("_k"), F.lit("yes").alias("_v")))
    ways = b.where("pos = 0").select(F.col("k").alias("_id"), F.lit(1).alias("_version"), F.lit("t").alias("_timestamp"), refs.alias("nd"), tag.alias("tag"))
    path = _path(spark, "mapxml")
    for name, rows in (("node", nodes), ("way", ways)):
        rows.write.option("maxRecordsPerFile", FILE_ROWS).format("xml").option("rowTag", name).option("rootTag", "osm").save(f"{path}/{name}s")
    return maps.read_footprints_xml(spark, f"{path}/*").select("building_id")


@query(
    "S5",
    "SELECT CAST(p_partkey AS VARCHAR) AS reference, '1_residential' AS use, CASE WHEN p_size >= 10 THEN 1900 + p_size END AS construction_year, p_size % 4 AS dwellings, p_size % 7 + 1 AS floors FROM part",
)
def s5(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    year = F.when(s >= 10, F.concat((1900 + s).cast("string"), F.lit("-01-01"))).otherwise("-")
    part = r.table(spark, d, "part")
    buildings = part.select(k.alias("reference"), F.lit("1_residential").alias("currentUse"), year.alias("beginning"), (s % 4).alias("numberOfDwellings"), F.lit("0 0 1 0 1 1 0 0").alias("posList"))
    parts = part.select(k.alias("k"), F.posexplode(F.array(s % 7 + 1, F.lit(1))).alias("i", "numberOfFloorsAboveGround"))
    parts = parts.select(F.concat("k", F.lit("_part"), (F.col("i") + 1).cast("string")).alias("localId"), "numberOfFloorsAboveGround")
    path = _path(spark, "gml")
    for name, rows in (("Building", buildings), ("BuildingPart", parts)):
        rows.write.option("maxRecordsPerFile", FILE_ROWS).format("xml").option("rowTag", name).option("rootTag", "collection").save(f"{path}/{name}")
    return maps.read_reference_buildings(spark, f"{path}/*", (0.5, 0.5, 2.0, 2.0)).select("reference", "use", "construction_year", "dwellings", "floors")


def _streamed(rows: DataFrame, order: str, name: str, files: int = 4) -> DataFrame:
    """The rows as a stream of a few batches, in the order of a column."""
    spark = rows.sparkSession
    path = _path(spark, name)
    rows.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _outcome(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    path = _path(stream.sparkSession, f"{name}-out")
    streams.run_available(stream, path)
    return streams.last_word(stream.sparkSession.read.parquet(path), keys)


@query("T1", "SELECT stage, image, arg_max(status, seq) AS status, max(seq) AS seq FROM ledger GROUP BY stage, image", ("ledger",))
def t1(spark: SparkSession, d: str) -> DataFrame:
    rows = r.ledger(spark, d).select("stage", "image", "status", "seq")
    path = _path(spark, "t1-states")
    streams.run_upsert(streams.stream_ledger_state(_streamed(rows, "seq", "ledger-stream")), path, ["stage", "image"], "seq")
    return streams.current_states(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@query(
    "T2",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY at_ms DESC, seq DESC) AS rn FROM ledger WHERE status = 'done')
    SELECT stage, count(*) AS completed, round((count(*) FILTER (rn <= 40) - 1) / ((max(at_ms) FILTER (rn <= 40) - min(at_ms) FILTER (rn <= 40)) / 1000.0) * 60, 6) AS rate_per_minute FROM k GROUP BY stage""",
    ("ledger",),
)
def t2(spark: SparkSession, d: str) -> DataFrame:
    rows = r.ledger(spark, d).where("status = 'done'").select("stage", "at_ms", "seq")
    out = _outcome(streams.stream_progress(_streamed(rows, "seq", "progress-stream")), ["stage"], "t2")
    return out.select("stage", "completed", F.round("rate_per_minute", 6).alias("rate_per_minute"))


@query("T4_stream", records._FOLD_SQL, ("review_events",))
def t4_stream(spark: SparkSession, d: str) -> DataFrame:
    out = _outcome(streams.stream_reviews(_streamed(records.review_events(spark, d), "seq", "review-stream")), ["building_id"], "t4")
    return out.select("building_id", F.explode(F.from_json("review", "map<string, string>")).alias("attribute", "value"))


@query("T3_stream", r.ORACLES["T3"])
def t3_stream(spark: SparkSession, d: str) -> DataFrame:
    expected = r.table(spark, d, "lineitem").select(F.concat(F.lit("way/"), F.col("l_partkey").cast("string")).alias("building_id"), (F.col("l_suppkey") % 300).cast("string").alias("image_id")).distinct()
    log = _streamed(r.ledger(spark, d).where("stage = 'view'").select(F.col("image").alias("image_id"), "status", "seq"), "seq", "visit-stream")
    path = _path(spark, "t3-out")
    streams.run_ready_buildings(log, landing(spark, "expected")(expected), path)
    return streams.last_word(spark.read.parquet(path), ["building_id"]).where("done > 0").select("building_id", "done")


@query("T6", None)
def t6(spark: SparkSession, d: str) -> DataFrame:
    """Three batches, each of all files that have come: its tasks are as many as the rows ask for."""
    rows = r.captures(spark, d).select("image_id", "captured_at_ms", "lat", "lon")
    path, source = _path(spark, "thinned"), _path(spark, "capture-stream")
    cuts = rows.agg(F.percentile_approx("captured_at_ms", [1 / 3, 2 / 3], 100)).first()[0] or [0, 0]
    turn = F.when(F.col("captured_at_ms") > cuts[1], 2).when(F.col("captured_at_ms") > cuts[0], 1).otherwise(0)
    for k in range(3):
        rows.where(turn == k).write.mode("append").parquet(source)
        streams.stream_thin(spark.readStream.schema(rows.schema).parquet(source), 10.0, path, landing(spark, "thin"))
    return spark.read.schema("image_id string").parquet(path).select("image_id")

