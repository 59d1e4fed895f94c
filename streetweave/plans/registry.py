"""The registry of queries, and the logical tables that they read, derived from the given tables.

The given tables hold no geometry, captures or views, so adapters derive those by arithmetic that SQL
can repeat: each adapter comes as a function and as a common table expression of the same content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query under an operator's id, with SQL over the named common table expressions."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            used: list[str] = []
            for c in ctes:
                for part in (*NEEDS.get(c, ()), c):
                    if part not in used:
                        used.append(part)
            body = sql.strip()
            prefix = ", ".join(f"{c} AS ({CTES[c].strip()})" for c in used)
            if body.startswith("WITH ") and prefix:
                body = f"WITH {prefix}, {body[5:]}"
            elif prefix:
                body = f"WITH {prefix} {body}"
            ORACLES[name] = body
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


CTES: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}

CTES["views"] = """
SELECT 'd' || CAST(l_suppkey % 3 AS VARCHAR) AS dataset, CAST(l_orderkey AS VARCHAR) AS image_id,
  'way/' || CAST(l_partkey * 16 + l_suppkey % 16 AS VARCHAR) AS building_id, CAST(l_quantity * 400 AS BIGINT) AS pixels,
  2000 AS width, 1000 AS height, l_discount * 10 AS coverage, l_returnflag = 'R' AS blurry, epoch_ms(l_shipdate) AS captured_at_ms
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey * 16 + l_suppkey % 16, l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_shipdate, l_suppkey, l_returnflag) = 1
"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of buildings in captures: a line item is one view, the first of its (building, image). The line items
    are exchanged as they are, once and by building, so what is grouped by building needs no exchange of its own."""
    number = F.col("l_partkey") * 16 + F.col("l_suppkey") % 16
    place = ("l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_suppkey", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("way/"), number.cast("string")).alias("building_id"), "l_orderkey", *place)
    first = rows.repartition("building_id").groupBy("building_id", "l_orderkey").agg(F.min(F.struct(*place)).alias("v"))
    return first.select(
        "building_id",
        F.col("l_orderkey").cast("string").alias("image_id"),
        F.concat(F.lit("d"), (F.col("v.l_suppkey") % 3).cast("string")).alias("dataset"),
        (F.col("v.l_quantity") * 400).cast("long").alias("pixels"),
        F.lit(2000).alias("width"),
        F.lit(1000).alias("height"),
        (F.col("v.l_discount") * 10).alias("coverage"),
        F.when(F.col("v.l_returnflag") == "R", F.array(F.lit("blurry"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        millis(F.col("v.l_shipdate")).alias("captured_at_ms"),
    )


# capture positions: a fixed point and a scatter by key, with as many captures per area at any scale
CTES["captures"] = """
SELECT 'd' || CAST(o_orderkey % 3 AS VARCHAR) AS dataset, CAST(o_orderkey AS VARCHAR) AS image_id, o_orderkey AS k,
  epoch_ms(o_orderdate) AS captured_at_ms, CAST((o_orderkey * 37) % 360 AS DOUBLE) AS heading, CAST(o_custkey AS VARCHAR) AS sequence_id,
  -0.38 + CAST((o_orderkey * 7919) % 2003 + 2003 * ((o_orderkey // 20000) % 500) AS DOUBLE) * 1e-5 AS lon,
  39.47 + CAST((o_orderkey * 104729) % 1999 + 1999 * (o_orderkey // 10000000) AS DOUBLE) * 1e-5 AS lat
FROM orders
"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dataset"),
        k.cast("string").alias("image_id"),
        k.alias("k"),
        millis(F.col("o_orderdate")).alias("captured_at_ms"),
        ((k * 37) % 360).cast("double").alias("heading"),
        F.col("o_custkey").cast("string").alias("sequence_id"),
        (F.lit(-0.38) + ((k * 7919) % 2003 + F.floor(k / 20000) % 500 * 2003).cast("double") * 1e-5).alias("lon"),
        (F.lit(39.47) + ((k * 104729) % 1999 + F.floor(k / 10000000) * 1999).cast("double") * 1e-5).alias("lat"),
    )


CTES["footprints"] = """
SELECT 'way/' || CAST(p_partkey AS VARCHAR) AS building_id, p_partkey AS k, 1 + p_size % 3 AS osm_version,
  -0.38 + CAST((p_partkey * 7919) % 2003 + 2003 * ((p_partkey // 2000) % 500) AS DOUBLE) * 1e-5 AS lon,
  39.47 + CAST((p_partkey * 104729) % 1999 + 1999 * (p_partkey // 1000000) AS DOUBLE) * 1e-5 AS lat,
  CAST(3 + p_size % 8 AS DOUBLE) * 1e-5 AS half,
  CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_size AS VARCHAR) || ',5 m'
    WHEN 3 THEN CAST(p_size AS VARCHAR) || ' ft' WHEN 4 THEN 'tall' ELSE NULL END AS height_tag,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 12 AS VARCHAR) END AS levels_tag,
  CASE p_size % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'Apartments' WHEN 2 THEN 'house' WHEN 3 THEN 'roof' WHEN 4 THEN 'church' WHEN 5 THEN 'no' ELSE 'warehouse' END AS building_tag,
  CASE p_size % 4 WHEN 0 THEN 'brick' WHEN 1 THEN 'stucco' WHEN 2 THEN 'mud' ELSE NULL END AS material_tag,
  CASE p_size % 3 WHEN 0 THEN '~' || CAST(1850 + p_size AS VARCHAR) WHEN 1 THEN CAST(1900 + p_size AS VARCHAR) || '-03-01' ELSE 'C19' END AS start_tag
FROM part
"""


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square footprints: centre (lon, lat), half a side in degrees, and tags."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = size.cast("string")

    def choose(n: int, *values):
        out = F.when(size % n == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(size % n == i, v)
        return out

    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("way/"), k.cast("string")).alias("building_id"),
        k.alias("k"),
        (1 + size % 3).alias("osm_version"),
        (F.lit(-0.38) + ((k * 7919) % 2003 + F.floor(k / 2000) % 500 * 2003).cast("double") * 1e-5).alias("lon"),
        (F.lit(39.47) + ((k * 104729) % 1999 + F.floor(k / 1000000) * 1999).cast("double") * 1e-5).alias("lat"),
        ((3 + size % 8).cast("double") * 1e-5).alias("half"),
        choose(6, none, text, F.concat(text, F.lit(",5 m")), F.concat(text, F.lit(" ft")), F.lit("tall"), none).alias("height_tag"),
        F.when(size % 5 != 0, (size % 12).cast("string")).alias("levels_tag"),
        choose(7, *map(F.lit, ("yes", "Apartments", "house", "roof", "church", "no", "warehouse"))).alias("building_tag"),
        choose(4, F.lit("brick"), F.lit("stucco"), F.lit("mud"), none).alias("material_tag"),
        choose(3, F.concat(F.lit("~"), (1850 + size).cast("string")), F.concat((1900 + size).cast("string"), F.lit("-03-01")), F.lit("C19")).alias("start_tag"),
    )


CTES["votes"] = """
SELECT 'way/' || CAST(l_partkey * 16 + l_suppkey % 16 AS VARCHAR) AS building_id, l_returnflag AS class, CAST(1.0 AS DOUBLE) AS score,
  l_quantity AS weight, CAST(l_linenumber AS DOUBLE) AS value, l_orderkey * 10 + l_linenumber AS id
FROM lineitem
"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_partkey") * 16 + F.col("l_suppkey") % 16
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("way/"), number.cast("string")).alias("building_id"),
        F.col("l_returnflag").alias("class"),
        F.lit(1.0).alias("score"),
        F.col("l_quantity").alias("weight"),
        F.col("l_linenumber").cast("double").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


CTES["ledger"] = """
SELECT CAST(user_id AS VARCHAR) AS image, event_type AS stage,
  CASE WHEN value < 3 THEN 'failed' WHEN value < 6 THEN 'skipped' ELSE 'done' END AS status, props AS settings, event_id AS seq, epoch_ms(ts) AS at_ms, value
FROM events
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("image"),
        F.col("event_type").alias("stage"),
        F.when(F.col("value") < 3, "failed").when(F.col("value") < 6, "skipped").otherwise("done").alias("status"),
        F.col("props").alias("settings"),
        F.col("event_id").alias("seq"),
        millis(F.col("ts")).alias("at_ms"),
        "value",
    )


# append-only revisions of a footprint: a user's events, in order
CTES["revisions"] = """
SELECT 'way/' || CAST(user_id AS VARCHAR) AS osm_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision,
  CASE event_type WHEN 'purchase' THEN 'split' ELSE 'geometry' END AS kind, 1 + event_id % 3 AS base_version, event_id AS seq,
  CASE WHEN value < 8 THEN 'accepted' WHEN value < 12 THEN 'rejected' ELSE 'proposed' END AS decision
FROM events
"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("way/"), F.col("user_id").cast("string")).alias("osm_id"),
        F.row_number().over(order).alias("revision"),
        F.when(F.col("event_type") == "purchase", "split").otherwise("geometry").alias("kind"),
        (1 + F.col("event_id") % 3).alias("base_version"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") < 8, "accepted").when(F.col("value") < 12, "rejected").otherwise("proposed").alias("decision"),
    )


# label rasters: a line item is one pixel of a 12-row raster whose columns are order lines
CTES["pixels"] = """
SELECT CAST(l_partkey AS VARCHAR) AS image_id, CAST(l_suppkey % 12 AS INTEGER) AS "row", CAST(l_orderkey % 90 AS INTEGER) AS col,
  CAST(min(l_linenumber) % 5 AS INTEGER) AS owner, CAST(max(l_linenumber) % 4 AS INTEGER) AS label, CAST(min(l_orderkey) % 4 AS INTEGER) AS instance,
  CAST(max(l_quantity) AS DOUBLE) AS depth, CAST(min(l_suppkey) % 4 AS INTEGER) AS truth, max(l_returnflag) = 'N' AS building, min(l_returnflag) = 'A' AS vegetation
FROM lineitem GROUP BY 1, 2, 3
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images. The line items are exchanged as they are, once and by image, so what is grouped by image needs
    no exchange of its own."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("image_id"),
        (F.col("l_suppkey") % 12).cast("int").alias("row"),
        (F.col("l_orderkey") % 90).cast("int").alias("col"),
        *("l_linenumber", "l_orderkey", "l_quantity", "l_suppkey", "l_returnflag"),
    )
    return rows.repartition("image_id").groupBy("image_id", "row", "col").agg(
        (F.min("l_linenumber") % 5).cast("int").alias("owner"),
        (F.max("l_linenumber") % 4).cast("int").alias("label"),
        (F.min("l_orderkey") % 4).cast("int").alias("instance"),
        F.max("l_quantity").alias("depth"),
        (F.min("l_suppkey") % 4).cast("int").alias("truth"),
        (F.max("l_returnflag") == "N").alias("building"),
        (F.min("l_returnflag") == "A").alias("vegetation"),
    )


# predictions of providers for buildings
CTES["predictions"] = """
SELECT 'way/' || CAST(l_partkey AS VARCHAR) AS building_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'human-review' WHEN 1 THEN 'osm-tag-prior' WHEN 2 THEN 'vlm:a' ELSE 'vlm:b' END AS provider,
  CASE l_suppkey % 3 WHEN 0 THEN 'building_type' WHEN 1 THEN 'gem_material' ELSE 'floors' END AS attribute,
  CASE WHEN l_suppkey % 3 = 2 THEN NULL ELSE l_returnflag END AS top, CASE WHEN l_suppkey % 3 = 2 THEN NULL ELSE l_discount * 10 END AS share,
  CASE WHEN l_suppkey % 3 = 2 THEN l_quantity END AS value, l_tax > 0.06 AS abstained, l_orderkey * 10 + l_linenumber AS modified
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber % 4, l_suppkey % 3 ORDER BY l_orderkey DESC, l_linenumber DESC, l_returnflag DESC, l_discount DESC, l_quantity DESC, l_tax DESC) = 1
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building, provider, attribute, top class and share or value, abstained, modified; one per provider."""
    n, a = F.col("l_linenumber") % 4, F.col("l_suppkey") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("way/"), F.col("l_partkey").cast("string")).alias("building_id"),
        F.when(n == 0, "human-review").when(n == 1, "osm-tag-prior").when(n == 2, "vlm:a").otherwise("vlm:b").alias("provider"),
        F.when(a == 0, "building_type").when(a == 1, "gem_material").otherwise("floors").alias("attribute"),
        F.when(a != 2, F.col("l_returnflag")).alias("top"),
        F.when(a != 2, F.col("l_discount") * 10).alias("share"),
        F.when(a == 2, F.col("l_quantity")).alias("value"),
        (F.col("l_tax") > 0.06).alias("abstained"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("modified"),
        F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity", "l_tax").alias("place"),
    )
    last = F.max_by(F.struct("top", "share", "value", "abstained", "modified"), F.col("place"))
    return rows.groupBy("building_id", "provider", "attribute").agg(last.alias("p")).select("building_id", "provider", "attribute", "p.*")


# reference values of buildings, and what a run says of them
CTES["scored"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS building_id, 'r' || CAST(o_custkey % 3 AS VARCHAR) AS run, o_orderpriority AS truth,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '1-URGENT' END AS predicted,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence, CAST(o_custkey % 50 AS DOUBLE) AS truth_value,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 47 AS DOUBLE) END AS predicted_value
FROM orders
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("building_id"),
        F.concat(F.lit("r"), (c % 3).cast("string")).alias("run"),
        F.col("o_orderpriority").alias("truth"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.col("o_orderpriority")).otherwise("1-URGENT").alias("predicted"),
        ((k % 101).cast("double") / 100).alias("confidence"),
        (c % 50).cast("double").alias("truth_value"),
        F.when(k % 7 != 0, (c % 47).cast("double")).alias("predicted_value"),
    )
