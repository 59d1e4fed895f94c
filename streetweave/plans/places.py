"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.operators import spatial
from streetweave.plans import registry as r
from streetweave.plans.registry import query
from streetweave.sources.landing import landing

_DIST = (
    "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
)
_BOX = "abs(b.lat - a.lat) < {m} / 110000.0 AND abs(b.lon - a.lon) < {m} / 80000.0"


def _pairs(a: str, b: str, m: float, extra: str = "") -> str:
    """All pairs within a radius, in SQL: cells of about the radius as an equi-join, then the distance."""
    c = m / 80000.0
    return (
        f"SELECT a.*, b.*, {_DIST} AS dist FROM (SELECT *, unnest(range(CAST(floor(lat / {c}) AS BIGINT) - 1, CAST(floor(lat / {c}) AS BIGINT) + 2)) AS cy FROM {a}) a "
        f"JOIN (SELECT *, CAST(floor(lat / {c}) AS BIGINT) AS cy2 FROM {b}) b ON a.cy = b.cy2 AND {_BOX.format(m=m)} WHERE {_DIST} <= {m} {extra}"
    )


@query(
    "J2",
    f"""WITH p AS (SELECT image_id, image_id_1 AS other_id, CASE WHEN image_id = image_id_1 THEN 0.0 ELSE dist END AS d FROM ({_pairs("captures", "captures", 45)}))
    SELECT image_id, other_id, round(d, 6) AS distance_m, rn FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, other_id) AS rn FROM p) WHERE rn <= 7""",
    ("captures",),
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearby(r.captures(spark, d)).select("image_id", "other_id", F.round("distance_m", 6).alias("distance_m"), F.col("rn").cast("long").alias("rn"))


r.CTES["tracks"] = f"""
SELECT image_id, image_id_1 AS other_id, dist FROM ({_pairs("(SELECT * REPLACE (CAST(k % 7 AS VARCHAR) AS sequence_id) FROM captures)", "(SELECT * REPLACE (CAST(k % 7 AS VARCHAR) AS sequence_id) FROM captures)", 30)})
WHERE image_id <> image_id_1 AND sequence_id = sequence_id_1 AND dist >= 1
"""
r.NEEDS["tracks"] = ("captures",)


def _sequenced(spark: SparkSession, d: str) -> DataFrame:
    return r.captures(spark, d).withColumn("sequence_id", (F.col("k") % 7).cast("string"))


@query("J3", "SELECT image_id, other_id, round(dist, 6) AS distance_m FROM tracks", ("tracks",))
def j3(spark: SparkSession, d: str) -> DataFrame:
    return spatial.track_neighbours(_sequenced(spark, d)).select("image_id", "other_id", F.round("distance_m", 6).alias("distance_m"))


@query("W12", None)
def w12(spark: SparkSession, d: str) -> DataFrame:
    kept = spatial.nearest_by_bearing(spatial.track_neighbours(_sequenced(spark, d)))
    return kept.select("image_id", "other_id", F.round("distance_m", 6).alias("distance_m"))


r.CTES["changed"] = "SELECT building_id, lon, lat FROM footprints WHERE k % 50 = 0"
r.NEEDS["changed"] = ("footprints",)


def _changed(spark: SparkSession, d: str) -> DataFrame:
    return r.footprints(spark, d).where(F.col("k") % 50 == 0).select("building_id", "lon", "lat")


@query("J5", f"SELECT DISTINCT image_id FROM ({_pairs('captures', 'changed', 190)})", ("captures", "changed"))
def j5(spark: SparkSession, d: str) -> DataFrame:
    return spatial.affected_captures(r.captures(spark, d), _changed(spark, d)).select("image_id")


@query("G13", f"SELECT DISTINCT image_id FROM ({_pairs('captures', 'changed', 190)}) WHERE heading IS NOT NULL AND image_id IN (SELECT image_id FROM views)", ("captures", "changed", "views"))
def g13(spark: SparkSession, d: str) -> DataFrame:
    return spatial.reassociation_worklist(r.captures(spark, d), _changed(spark, d), r.views(spark, d)).select("image_id")


@query(
    "J11",
    f"""SELECT point_id, arg_min(image_id, ROW(round(dist, 6), image_id)) AS image_id, round(min(dist), 6) AS distance_m
    FROM (SELECT a.building_id AS point_id, b.image_id, {_DIST} AS dist FROM footprints a, captures b) GROUP BY point_id""",
    ("captures", "footprints"),
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    points = r.footprints(spark, d).select(F.col("building_id").alias("point_id"), "lat", "lon")
    best = spatial.nearest_capture(points, r.captures(spark, d), 60.0, landing(spark, "nearest"))
    return best.select("point_id", "image_id", F.round("distance_m", 6).alias("distance_m"))


_REGIONS = (("all", -10.0, 30.0, 10.0, 50.0), ("city", -0.385, 39.465, -0.36, 39.485), ("block", -0.375, 39.475, -0.37, 39.48))
_REGION_SQL = "(VALUES " + ", ".join(f"('{n}', {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {t}::DOUBLE)" for n, w, s, e, t in _REGIONS) + ") g(region, west, south, east, north)"


def _regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_REGIONS), "region string, west double, south double, east double, north double")


@query(
    "J13",
    f"SELECT image_id AS point_id, arg_min(region, ROW((east - west) * (north - south), region)) AS region FROM captures JOIN {_REGION_SQL} ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY image_id",
    ("captures",),
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    return spatial.smallest_region(r.captures(spark, d).select(F.col("image_id").alias("point_id"), "lon", "lat"), _regions(spark))


@query("J14", "SELECT image_id FROM captures WHERE lon BETWEEN -0.385 AND -0.36 AND lat BETWEEN 39.465 AND 39.485 AND NOT (lon BETWEEN -0.375 AND -0.37 AND lat BETWEEN 39.475 AND 39.48)", ("captures",))
def j14(spark: SparkSession, d: str) -> DataFrame:
    boxes = _regions(spark)
    return spatial.region_at(r.captures(spark, d), boxes.where("region = 'city'"), boxes.where("region = 'block'")).select("image_id")


@query(
    "W14",
    """WITH b AS (SELECT min(lon) AS w, min(lat) AS s FROM captures), c AS (SELECT CAST(floor((lat - s) * 110574.0 / 250) AS BIGINT) AS "row",
        CAST(floor((lon - w) * (111320.0 * cos(radians(s))) / 250) AS BIGINT) AS col FROM captures, b),
    t AS (SELECT "row", col, count(*) AS images FROM c GROUP BY 1, 2), o AS (SELECT "row", row_number() OVER (ORDER BY "row") - 1 AS turn FROM (SELECT DISTINCT "row" FROM t))
    SELECT t."row", col, images, turn, row_number() OVER (PARTITION BY t."row" ORDER BY CASE WHEN turn % 2 = 0 THEN col ELSE -col END) AS place FROM t JOIN o ON o."row" = t."row" """,
    ("captures",),
)
def w14(spark: SparkSession, d: str) -> DataFrame:
    return spatial.plan_tiles(r.captures(spark, d))


@query(
    "P35",
    "SELECT DISTINCT y + dy AS cy, x + dx AS cx FROM (SELECT DISTINCT CAST(floor(lat / 0.001) AS BIGINT) AS y, CAST(floor(lon / 0.001) AS BIGINT) AS x FROM captures), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)",
    ("captures",),
)
def p35(spark: SparkSession, d: str) -> DataFrame:
    return spatial.area_cells(r.captures(spark, d))


@query("A44", "SELECT dataset, min(lon) - 0.003 AS west, min(lat) - 0.003 AS south, max(lon) + 0.003 AS east, max(lat) + 0.003 AS north FROM captures GROUP BY dataset", ("captures",))
def a44(spark: SparkSession, d: str) -> DataFrame:
    return spatial.extent(r.captures(spark, d))


@query(
    "A35",
    """SELECT x.dataset, lon, lat FROM (SELECT dataset, lon FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY lon) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM captures) WHERE rn = n // 2 + 1) x
    JOIN (SELECT dataset, lat FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY lat) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM captures) WHERE rn = n // 2 + 1) y ON x.dataset = y.dataset""",
    ("captures",),
)
def a35(spark: SparkSession, d: str) -> DataFrame:
    return spatial.median_position(r.captures(spark, d), landing(spark, "positions"))


@query("P3", "SELECT image_id FROM captures WHERE lon BETWEEN -0.375 AND -0.365 AND lat BETWEEN 39.472 AND 39.485 AND captured_at_ms >= 852076800000 AND heading < 180", ("captures",))
def p3(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators.captures import filter_captures

    rows = r.captures(spark, d).where("heading < 180")
    return filter_captures(rows, bbox=(-0.375, 39.472, -0.365, 39.485), captured_after_ms=852076800000).select("image_id")


@query(
    "P1",
    """SELECT image_id, CASE WHEN k % 3 > 0 THEN (CASE WHEN k % 7 = 0 THEN NULL ELSE lon END) WHEN k % 5 > 0 THEN lon + 1 ELSE lon + 2 END AS lon_first_present,
      CASE WHEN k % 3 > 0 AND k % 7 > 0 THEN lon WHEN k % 5 > 0 THEN lon + 1 ELSE lon + 2 END AS lon_first_valid FROM captures""",
    ("captures",),
)
def p1(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators.captures import effective_point

    def point(lon, lat, there):
        return F.when(there, F.struct(lon.alias("lon"), lat.alias("lat")))

    k, lon, lat = F.col("k"), F.col("lon"), F.col("lat")
    rows = r.captures(spark, d).select(
        "image_id", point(F.when(k % 7 == 0, 999.0).otherwise(lon), lat, k % 3 > 0).alias("selected"), point(lon + 1, lat, k % 5 > 0).alias("computed"), point(lon + 2, lat, F.lit(True)).alias("raw")
    )
    order = ["selected", "computed", "raw"]
    return rows.select("image_id", effective_point(order, "first_present")["lon"].alias("lon_first_present"), effective_point(order, "first_valid")["lon"].alias("lon_first_valid"))


@query("P2", "SELECT image_id, (heading * 5) % 360 AS heading FROM captures", ("captures",))
def p2(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.functions.fields import normal_heading

    return r.captures(spark, d).select("image_id", normal_heading(F.col("heading") * 5 - 720).alias("heading"))


@query("P24", "SELECT image_id, CASE WHEN k % 2 = 0 THEN 'u1024' WHEN k % 3 = 0 THEN 'u256' END AS url FROM captures", ("captures",))
def p24(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators.captures import pick_derivative

    k = F.col("k")
    rows = r.captures(spark, d).select("image_id", F.when(k % 2 == 0, "u1024").alias("thumb_1024_url"), F.when(k % 3 == 0, "u256").alias("thumb_256_url"), F.lit("u2048").alias("thumb_2048_url"))
    return rows.select("image_id", pick_derivative({2048: "thumb_2048_url", 1024: "thumb_1024_url", 256: "thumb_256_url"}, 1024).alias("url"))


@query("P25", "SELECT image_id, sequence_id, captured_at_ms, heading AS computed_compass_angle_deg FROM captures", ("captures",))
def p25(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators.captures import capture_record

    rows = r.captures(spark, d).select(F.col("k").alias("id"), F.struct(F.col("sequence_id").alias("id")).alias("sequence"), F.col("captured_at_ms").alias("captured_at"), F.col("heading").alias("computed_compass_angle"))
    return capture_record(rows).select(F.col("id").alias("image_id"), "sequence_id", "captured_at_ms", "computed_compass_angle_deg")


@query(
    "P26",
    """SELECT image_id, i, j, round(w + i * (e - w) / 3, 9) AS west FROM (SELECT image_id, lon - 1000.0 / 111320.0 / cos(radians(lat)) AS w, lon + 1000.0 / 111320.0 / cos(radians(lat)) AS e FROM captures),
      (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)""",
    ("captures",),
)
def p26(spark: SparkSession, d: str) -> DataFrame:
    w, s, e, n = spatial.bbox_around(F.col("lat"), F.col("lon"), F.lit(1000.0))
    boxes = r.captures(spark, d).select("image_id", w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    return spatial.tile_bbox(boxes, 0.00006).select("image_id", "i", "j", F.round("west", 9).alias("west"))


@query(
    "P36",
    """SELECT image_id, x, round(x / 65536.0 * 360 - 180, 9) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 65536.0)))), 9) AS north FROM
      (SELECT image_id, floor((lon + 180) / 360 * 65536) AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536) AS y FROM captures)""",
    ("captures",),
)
def p36(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.functions.geo import tile_bounds, tile_of

    z = F.lit(16)
    x, y = tile_of(z, F.col("lat"), F.col("lon"))
    rows = r.captures(spark, d).select("image_id", x.alias("x"), y.alias("y"))
    west, _, _, north = tile_bounds(z, F.col("x"), F.col("y"))
    return rows.select("image_id", F.col("x").cast("double").alias("x"), F.round(west, 9).alias("west"), F.round(north, 9).alias("north"))


r.CTES["visibility"] = """
SELECT 'way/' || CAST(l_partkey AS VARCHAR) AS building_id, CAST(l_orderkey AS VARCHAR) AS image_id, max(l_quantity * 3) AS aov_deg, min(l_tax * 1000) AS distance_m FROM lineitem GROUP BY l_partkey, l_orderkey
"""


def visibility(spark: SparkSession, d: str) -> DataFrame:
    rows = r.table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max(F.col("l_quantity") * 3).alias("aov_deg"), F.min(F.col("l_tax") * 1000).alias("distance_m"))
    return rows.select(F.concat(F.lit("way/"), F.col("l_partkey").cast("string")).alias("building_id"), F.col("l_orderkey").cast("string").alias("image_id"), "aov_deg", "distance_m")


@query(
    "W16",
    """SELECT building_id, image_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY aov_deg DESC, distance_m, image_id) AS rn FROM visibility
      WHERE aov_deg BETWEEN 10 AND 120 AND distance_m <= 50) WHERE rn <= 5""",
    ("visibility",),
)
def w16(spark: SparkSession, d: str) -> DataFrame:
    return spatial.select_panoramas(visibility(spark, d)).select("building_id", "image_id", F.col("rn").cast("long").alias("rn"))


@query("J21", "SELECT building_id, image_id FROM visibility WHERE distance_m <= 50 AND image_id IN (SELECT image_id FROM captures WHERE k % 2 = 0)", ("visibility", "captures"))
def j21(spark: SparkSession, d: str) -> DataFrame:
    return spatial.expected_views(visibility(spark, d), r.captures(spark, d).where(F.col("k") % 2 == 0))


@query(
    "A4",
    """WITH m AS (SELECT * FROM (SELECT building_id, count(*) AS views, count(*) FILTER (usable) AS clean, count(DISTINCT CASE WHEN usable THEN image_id END) AS u FROM collected GROUP BY building_id)),
    n AS (SELECT DISTINCT building_id FROM views WHERE pixels % 3 > 0), v AS (SELECT DISTINCT building_id FROM views WHERE pixels % 4 > 0 UNION SELECT building_id FROM footprints WHERE k % 100 = 0),
    s AS (SELECT coalesce(m.building_id, n.building_id, v.building_id) AS id, m.views, m.clean, m.u, m.building_id IS NOT NULL AS im, n.building_id IS NOT NULL AS i_n, v.building_id IS NOT NULL AS iv
      FROM m FULL JOIN n ON n.building_id = m.building_id FULL JOIN v ON v.building_id = coalesce(m.building_id, n.building_id))
    SELECT count(*) FILTER (im) AS matched, count(*) FILTER (i_n) AS near, count(*) FILTER (iv) AS in_sight, round(CAST(count(*) FILTER (im AND i_n) AS DOUBLE) / count(*) FILTER (i_n), 4) AS matched_of_near,
      count(*) FILTER (iv AND NOT im) AS seen_not_matched, count(*) FILTER (u >= 2) AS multi_view, count(*) FILTER (u = 1) AS single_view, count(*) FILTER (u = 0) AS weak_views_only,
      count(*) FILTER (views = 1) AS views_1, count(*) FILTER (views = 2) AS views_2, count(*) FILTER (views BETWEEN 3 AND 5) AS views_3_5, count(*) FILTER (views >= 6) AS views_6 FROM s""",
    ("collected", "footprints"),
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators import views as v

    rows = r.views(spark, d)
    near = rows.where(F.col("pixels") % 3 > 0).select("building_id")
    seen = rows.where(F.col("pixels") % 4 > 0).select("building_id").union(r.footprints(spark, d).where(F.col("k") % 100 == 0).select("building_id"))
    report = v.coverage_report(v.building_rows(v.collect_views(rows)), near, seen)
    return report.drop("in_sight_of_near", "usable_of_near")


@query("W13", None)
def w13(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.sources.landing import landing

    return spatial.thin_captures(r.captures(spark, d), 10.0, landing(spark, "thin")).select("image_id")


@query(
    "W15",
    """WITH s AS (SELECT building_id, count(*) AS score FROM views GROUP BY building_id), o AS (SELECT building_id, k AS place FROM footprints WHERE k % 20 = 0)
    SELECT o.building_id, place FROM o JOIN s ON s.building_id = o.building_id WHERE score >= 1""",
    ("views", "footprints"),
)
def w15(spark: SparkSession, d: str) -> DataFrame:
    summary = r.views(spark, d).groupBy("building_id").agg(F.count("*").alias("score"))
    route = r.footprints(spark, d).where(F.col("k") % 20 == 0).select("building_id", F.col("k").alias("place"))
    return spatial.plan_tour(summary, route, 1)


@query("A8", None)
def a8(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators.captures import independent_views

    rows = r.captures(spark, d).select(F.floor(F.col("k") / 8).cast("string").alias("building_id"), "image_id", "lat", "lon")
    return independent_views(rows, landing(spark, "views"), 300.0)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.operators.captures import fuse_nearby

    v, c = r.views(spark, d), r.captures(spark, d).select("image_id", "lat", "lon")
    v = v.withColumn("revision", F.when(F.col("pixels") % 3 == 0, F.col("pixels") % 5)).withColumn("inferred_pixels", F.floor(F.col("pixels") / 7))
    return fuse_nearby(v.withColumnRenamed("dataset", "source"), c, landing(spark, "views"))


@query(
    "A7",
    """SELECT building_id, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS sources, coalesce(string_agg(DISTINCT CAST(CASE WHEN pixels % 3 = 0 THEN pixels % 5 END AS VARCHAR), ',' ORDER BY CAST(CASE WHEN pixels % 3 = 0 THEN pixels % 5 END AS VARCHAR)), '') AS revisions,
      sum(pixels) AS observed_pixels, sum(pixels // 7) AS inferred_pixels, count(DISTINCT image_id) AS captures FROM views GROUP BY building_id""",
    ("views",),
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("building_id", "sources", F.concat_ws(",", F.col("revisions").cast("array<string>")).alias("revisions"), "observed_pixels", "inferred_pixels", "captures")


@query("A7_independent", None)
def a7_independent(spark: SparkSession, d: str) -> DataFrame:
    """A7's independent views and their mean coverage, which SQL does not express."""
    return _fused(spark, d).select("building_id", "views", F.concat_ws(",", "independent_ids").alias("independent_ids"), "confidence")
