"""Queries of the correction, log, card and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.operators import captures as cap
from streetweave.operators import cards, corrections, fusion, logs, views
from streetweave.plans import registry as r
from streetweave.plans.registry import query
from streetweave.sources.landing import landing

r.CTES["folded"] = """
SELECT *, CASE WHEN decision = 'accepted' AND coalesce(sum(CASE WHEN decision = 'accepted' THEN 1 END) OVER (PARTITION BY osm_id ORDER BY revision ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) > 0 THEN 'superseded' ELSE decision END AS status FROM revisions
"""
r.NEEDS["folded"] = ("revisions",)
r.CTES["active"] = "SELECT osm_id, max(revision) AS revision, arg_max(kind, revision) AS kind, arg_max(base_version, revision) AS base_version FROM folded WHERE status = 'accepted' GROUP BY osm_id"
r.NEEDS["active"] = ("revisions", "folded")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return corrections.fold_revisions(r.revisions(spark, d))


@query("W6", "SELECT osm_id, revision, status FROM folded", ("folded",))
def w6(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("osm_id", F.col("revision").cast("long").alias("revision"), "status")


@query("W5", "SELECT osm_id, revision, kind, base_version FROM active", ("active",))
def w5(spark: SparkSession, d: str) -> DataFrame:
    return corrections.active_revision(_folded(spark, d)).select("osm_id", F.col("revision").cast("long").alias("revision"), "kind", "base_version")


@query(
    "J10",
    """WITH f AS (SELECT f.building_id, osm_version, a.revision AS correction, CASE WHEN a.revision IS NULL THEN 'none' WHEN a.base_version = osm_version THEN 'applied' ELSE 'stale' END AS state, a.kind FROM footprints f LEFT JOIN active a ON a.osm_id = f.building_id)
    SELECT building_id, correction, state, CAST(NULL AS INTEGER) AS part FROM f WHERE NOT (state = 'applied' AND coalesce(kind, '') = 'split')
    UNION ALL SELECT building_id || '/part-' || CAST(n AS VARCHAR), correction, state, n FROM f, (SELECT unnest([1, 2]) AS n) WHERE state = 'applied' AND kind = 'split'""",
    ("footprints", "active"),
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    active = corrections.active_revision(_folded(spark, d)).withColumn("parts", F.array(F.lit("a"), F.lit("b")))
    out = corrections.apply_corrections(r.footprints(spark, d), active, "parts")
    return out.select("building_id", F.col("correction").cast("long").alias("correction"), "state", "part")


r.CTES["diagnostics"] = """
SELECT CASE l_linenumber % 3 WHEN 0 THEN 'unsupported_footprint' WHEN 1 THEN 'merged_footprint' ELSE 'pose_offset' END AS type, 'way/' || CAST(l_partkey AS VARCHAR) AS osm_id, 'd' || CAST(l_suppkey % 40 AS VARCHAR) AS dataset,
  CAST(l_orderkey AS VARCHAR) AS image, CAST((l_suppkey % 5) * 2 AS DOUBLE) + l_discount AS east_m, CAST(l_suppkey % 3 AS DOUBLE) - l_tax AS north_m, l_returnflag <> 'R' AS pose_accepted FROM lineitem
"""


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("l_linenumber") % 3, F.col("l_suppkey")
    return r.table(spark, d, "lineitem").select(
        F.when(n == 0, "unsupported_footprint").when(n == 1, "merged_footprint").otherwise("pose_offset").alias("type"), F.concat(F.lit("way/"), F.col("l_partkey").cast("string")).alias("osm_id"),
        F.concat(F.lit("d"), (s % 40).cast("string")).alias("dataset"), F.col("l_orderkey").cast("string").alias("image"), ((s % 5 * 2).cast("double") + F.col("l_discount")).alias("east_m"),
        ((s % 3).cast("double") - F.col("l_tax")).alias("north_m"), (F.col("l_returnflag") != "R").alias("pose_accepted"),
    )


_ISSUES = "SELECT osm_id, count(*) FILTER (type = 'unsupported_footprint') AS unsupported, count(*) FILTER (type = 'merged_footprint') AS merged, count(DISTINCT dataset || '/' || image) AS supporting FROM diagnostics WHERE type <> 'pose_offset' GROUP BY osm_id"


@query("A9", _ISSUES, ("diagnostics",))
def a9(spark: SparkSession, d: str) -> DataFrame:
    return corrections.footprint_issues(_diagnostics(spark, d))


@query(
    "A10",
    """SELECT dataset, captures, round(e, 2) AS mean_east_m, round(n, 2) AS mean_north_m, round(sqrt(e * e + n * n) / l, 3) AS consistency FROM (
      SELECT dataset, count(*) AS captures, avg(east_m) AS e, avg(north_m) AS n, avg(sqrt(east_m * east_m + north_m * north_m)) AS l FROM diagnostics WHERE type = 'pose_offset' AND pose_accepted GROUP BY dataset)
    WHERE captures >= 3 AND sqrt(e * e + n * n) / l >= 0.7 AND sqrt(e * e + n * n) >= 2""",
    ("diagnostics",),
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return corrections.systematic_offsets(_diagnostics(spark, d).where("type = 'pose_offset'"))


@query(
    "J22",
    f"""SELECT i.osm_id, i.supporting, l.revision, l.status FROM ({_ISSUES}) i LEFT JOIN (SELECT osm_id, max(revision) AS revision, arg_max(status, revision) AS status FROM folded GROUP BY osm_id) l ON l.osm_id = split_part(i.osm_id, '/part-', 1)""",
    ("diagnostics", "folded"),
)
def j22(spark: SparkSession, d: str) -> DataFrame:
    out = corrections.correction_status(corrections.footprint_issues(_diagnostics(spark, d)), _folded(spark, d))
    return out.select("osm_id", "supporting", F.col("revision").cast("long").alias("revision"), "status")


@query(
    "J12",
    """SELECT coalesce(f.building_id, a.building_id) AS building_id, CASE WHEN a.building_id IS NOT NULL THEN 'analysed' ELSE 'base' END AS origin, CASE WHEN a.building_id IS NOT NULL THEN 'applied' ELSE 'none' END AS state
    FROM (SELECT building_id FROM footprints WHERE k % 2 = 0) f FULL JOIN (SELECT building_id FROM footprints WHERE k % 3 = 0) a ON a.building_id = f.building_id WHERE coalesce(f.building_id, a.building_id) <> 'way/0'""",
    ("footprints",),
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    rows = r.footprints(spark, d).select("k", "building_id", F.col("lon").alias("geometry"))
    return corrections.merge_footprints(rows.where(F.col("k") % 2 == 0), rows.where(F.col("k") % 3 == 0).withColumn("state", F.lit("applied"))).select("building_id", "origin", "state")


@query(
    "W3",
    "SELECT stage, image, arg_max(status, seq) AS status, max(seq) AS seq FROM ledger GROUP BY stage, image",
    ("ledger",),
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest_by_key(r.ledger(spark, d), ["stage", "image"], "seq").select("stage", "image", "status", "seq")


@query(
    "P33",
    """SELECT stage, image, status = 'done' AND seq % 2 = 0 AND settings LIKE '{"k": %' AS done FROM (SELECT stage, image, arg_max(status, seq) AS status, max(seq) AS seq, arg_max(settings, seq) AS settings FROM ledger GROUP BY stage, image)""",
    ("ledger",),
)
def p33(spark: SparkSession, d: str) -> DataFrame:
    last = logs.latest_by_key(r.ledger(spark, d), ["stage", "image"], "seq").withColumn("size", F.col("seq") % 2).withColumn("mtime_ns", F.col("seq"))
    inventory = last.select("stage", "image", F.lit(0).cast("long").alias("size"), "mtime_ns")
    return logs.is_done(last, inventory, F.col("settings"))


@query("P30", "SELECT event_type AS reason, CASE WHEN event_type IN ('click') THEN 'permanent' ELSE 'transient' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def p30(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "click", "missing_file").otherwise(F.col("event_type"))
    rows = r.table(spark, d, "events").select(F.col("event_type").alias("reason"), logs.failure_class(reason).alias("class"))
    return rows.groupBy("reason", "class").agg(F.count("*").alias("n"))


@query("P34", "SELECT image_id, CASE WHEN k % 4 = 0 THEN 'missing' WHEN k % 4 = 1 THEN 'stale' ELSE 'current' END AS status FROM captures", ("captures",))
def p34(spark: SparkSession, d: str) -> DataFrame:
    c = r.captures(spark, d)
    analyses = c.where(F.col("k") % 4 > 0).select("image_id", F.when(F.col("k") % 4 == 1, 32).otherwise(33).alias("version"))
    return logs.analysis_status(c, analyses, 33)


@query(
    "A32",
    """SELECT coalesce(status, 'pending') AS status, count(*) AS captures FROM captures c LEFT JOIN (SELECT image, arg_max(status, seq) AS status FROM ledger WHERE stage = 'view' GROUP BY image) l ON l.image = c.image_id GROUP BY 1""",
    ("captures", "ledger"),
)
def a32(spark: SparkSession, d: str) -> DataFrame:
    latest = logs.latest_by_key(r.ledger(spark, d).where("stage = 'view'"), ["image"], "seq")
    return logs.capture_status(latest, r.captures(spark, d))


@query(
    "A33",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY at_ms DESC, seq DESC) AS rn FROM ledger WHERE status = 'done'),
    x AS (SELECT stage, (count(*) - 1) / ((max(at_ms) - min(at_ms)) / 1000.0) AS rate FROM k WHERE rn <= 40 GROUP BY stage), n AS (SELECT stage, count(*) AS completed FROM k GROUP BY stage)
    SELECT n.stage, completed, round(rate * 60, 2) AS rate_per_minute, round((completed + 1 - completed) / rate, 0) AS eta_s FROM n JOIN x ON x.stage = n.stage""",
    ("ledger",),
)
def a33(spark: SparkSession, d: str) -> DataFrame:
    return logs.progress(r.ledger(spark, d).where("status = 'done'"), ["stage"], F.col("completed") + 1)


@query(
    "T5",
    """SELECT stage, image, attempts FROM (SELECT stage, image, arg_max(status, seq) AS status, count(*) FILTER (status = 'failed') AS attempts FROM ledger GROUP BY stage, image) WHERE status = 'failed' AND attempts < 6""",
    ("ledger",),
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    return logs.retry_candidates(r.ledger(spark, d))


@query(
    "T5_abort",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq) AS a FROM ledger), f AS (SELECT *, a - row_number() OVER (PARTITION BY stage ORDER BY seq) AS run FROM n WHERE status = 'failed'),
    g AS (SELECT stage, run, count(*) AS n FROM f GROUP BY stage, run) SELECT stage, max(n) >= 5 AS abort FROM g GROUP BY stage""",
    ("ledger",),
)
def t5_abort(spark: SparkSession, d: str) -> DataFrame:
    return logs.should_abort(r.ledger(spark, d), ["stage"], landing(spark, "log"), 5)


r.CTES["review_events"] = """
SELECT 'way/' || CAST(user_id % 50 AS VARCHAR) AS building_id, CASE WHEN value > 40 THEN 'withdraw' ELSE 'review' END AS action, event_type AS attribute, props AS value, event_id AS seq FROM events
"""


def review_events(spark: SparkSession, d: str) -> DataFrame:
    return r.table(spark, d, "events").select(
        F.concat(F.lit("way/"), (F.col("user_id") % 50).cast("string")).alias("building_id"), F.when(F.col("value") > 40, "withdraw").otherwise("review").alias("action"), F.col("event_type").alias("attribute"),
        F.col("props").alias("value"), F.col("event_id").alias("seq"),
    )


_FOLD_SQL = """WITH w AS (SELECT building_id, max(seq) AS since FROM review_events WHERE action = 'withdraw' GROUP BY building_id)
SELECT e.building_id, attribute, arg_max(value, seq) AS value FROM review_events e LEFT JOIN w ON w.building_id = e.building_id WHERE action = 'review' AND (since IS NULL OR seq > since) GROUP BY ALL"""


@query("T4", _FOLD_SQL, ("review_events",))
def t4(spark: SparkSession, d: str) -> DataFrame:
    return logs.fold_reviews(review_events(spark, d))


@query(
    "T3",
    """WITH e AS (SELECT 'way/' || CAST(l_partkey AS VARCHAR) AS building_id, CAST(l_suppkey % 300 AS VARCHAR) AS image_id FROM lineitem GROUP BY ALL), l AS (SELECT image, arg_max(status, seq) AS status FROM ledger WHERE stage = 'view' GROUP BY image)
    SELECT building_id, count(*) FILTER (status = 'done') AS done FROM e LEFT JOIN l ON l.image = e.image_id GROUP BY building_id HAVING count(*) = count(status) AND count(*) FILTER (status = 'done') > 0""",
    ("ledger",),
)
def t3(spark: SparkSession, d: str) -> DataFrame:
    expected = r.table(spark, d, "lineitem").select(F.concat(F.lit("way/"), F.col("l_partkey").cast("string")).alias("building_id"), (F.col("l_suppkey") % 300).cast("string").alias("image_id")).distinct()
    latest = logs.latest_by_key(r.ledger(spark, d).where("stage = 'view'"), ["image"], "seq")
    return logs.ready_buildings(expected, latest).select("building_id", "done")


@query("A42", "SELECT dataset, count(DISTINCT pixels % 3) AS settings, count(DISTINCT pixels % 3) = 1 AS agree FROM views GROUP BY dataset", ("views",))
def a42(spark: SparkSession, d: str) -> DataFrame:
    return logs.settings_agreement(r.views(spark, d).select("dataset", (F.col("pixels") % 3).alias("settings")))


@query(
    "S14",
    """WITH l AS (SELECT dataset, line, row_number() OVER (PARTITION BY dataset ORDER BY line) - 1 AS i FROM (SELECT dataset, image_id || ':' || building_id AS line FROM views)),
    a AS (SELECT dataset, i // 1024 AS j, sha256(string_agg(line, chr(10) ORDER BY i)) AS h, count(*) AS n FROM l GROUP BY 1, 2),
    b AS (SELECT dataset, j // 1024 AS k, sha256(string_agg(h, chr(10) ORDER BY j)) AS h, sum(n) AS n FROM a GROUP BY 1, 2)
    SELECT dataset, sha256(string_agg(h, chr(10) ORDER BY k)) AS inputs_sha256, CAST(sum(n) AS BIGINT) AS rows FROM b GROUP BY dataset""",
    ("views",),
)
def s14(spark: SparkSession, d: str) -> DataFrame:
    return logs.input_fingerprint(r.views(spark, d), ["dataset"], "image_id", "building_id", landing(spark, "lines"))


r.CTES["preferred"] = """
SELECT * EXCLUDE (pick, rn) FROM (SELECT *, row_number() OVER (PARTITION BY building_id, attribute ORDER BY pick) AS rn, count(*) OVER (PARTITION BY building_id, attribute) - 1 AS others FROM (
  SELECT *, CASE WHEN provider = 'human-review' THEN -1 WHEN NOT abstained AND coalesce(top, CAST(value AS VARCHAR)) IS NOT NULL THEN place ELSE 1000000 - place END AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY building_id, attribute ORDER BY CASE provider WHEN 'human-review' THEN 0 WHEN 'osm-tag-prior' THEN 1 ELSE 2 END, modified DESC, provider) AS place FROM predictions))) WHERE rn = 1
"""
r.NEEDS["preferred"] = ("predictions",)


@query("W4", "SELECT building_id, attribute, provider, CASE WHEN NOT abstained THEN top END AS top, CASE WHEN NOT abstained THEN value END AS value, abstained, others FROM preferred", ("preferred",))
def w4(spark: SparkSession, d: str) -> DataFrame:
    rows = cards.preferred_values(r.predictions(spark, d))
    return rows.select("building_id", "attribute", "provider", F.when(~F.col("abstained"), F.col("top")).alias("top"), F.when(~F.col("abstained"), F.col("value")).alias("value"), "abstained", F.col("others").cast("long").alias("others"))


@query(
    "P20",
    """SELECT building_id, max(CASE WHEN attribute = 'gem_material' AND NOT abstained THEN top END) AS gem_material, round(max(CASE WHEN attribute = 'gem_material' THEN share END), 4) AS gem_material_score, max(CASE WHEN attribute = 'floors' THEN value END) AS floors
    FROM predictions WHERE provider = 'vlm:a' GROUP BY building_id""",
    ("predictions",),
)
def p20(spark: SparkSession, d: str) -> DataFrame:
    rows = r.predictions(spark, d).where("provider = 'vlm:a'")
    return cards.attribute_columns(rows, ("building_type", "gem_material"), ("floors",)).select("building_id", "gem_material", "gem_material_score", "floors")


@query(
    "J1",
    """SELECT b.building_id, p.top AS building_type FROM (SELECT DISTINCT building_id FROM predictions) b LEFT JOIN (SELECT building_id, max(top) AS top FROM predictions WHERE provider = 'vlm:b' AND attribute = 'building_type' AND NOT abstained GROUP BY building_id) p ON p.building_id = b.building_id""",
    ("predictions",),
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    p = r.predictions(spark, d)
    wide = cards.attribute_columns(p.where("provider = 'vlm:b'"), ("building_type",), ())
    return p.select("building_id").distinct().join(wide, "building_id", "left").select("building_id", "building_type")


_SUMMARY = """
SELECT building_id, max(CASE WHEN attribute = 'gem_material' AND NOT abstained THEN top END) AS gem_material, max(CASE WHEN attribute = 'floors' AND NOT abstained THEN value END) AS floors, bool_or(provider = 'human-review') AS reviewed,
  bool_or(provider LIKE 'vlm:%' AND attribute = 'gem_material' AND NOT abstained AND share < 0.7) AS weak, bool_or(provider LIKE 'vlm:%' AND attribute = 'gem_material' AND abstained AND top IS NOT NULL) AS split,
  min(CASE WHEN provider LIKE 'vlm:%' AND attribute = 'gem_material' AND ((NOT abstained AND share < 0.7) OR (abstained AND top IS NOT NULL)) THEN coalesce(share, 0) END) AS least FROM preferred GROUP BY building_id
"""


@query(
    "A30",
    f"""SELECT building_id, gem_material, floors, reviewed, CASE WHEN NOT reviewed AND (weak OR split) THEN concat_ws('; ', CASE WHEN split THEN 'split vote on the material' END, CASE WHEN weak THEN 'weak agreement on the material' END) END AS reason,
      CASE WHEN reviewed THEN 1.0 ELSE coalesce(least, 1.0) END AS urgency FROM ({_SUMMARY})""",
    ("preferred",),
)
def a30(spark: SparkSession, d: str) -> DataFrame:
    return cards.attribute_summary(cards.preferred_values(r.predictions(spark, d))).drop("building_type")


@query("A31", "SELECT c.class, place, coalesce(n, 0) AS n FROM (VALUES ('A', 0), ('N', 1), ('X', 2)) c(class, place) LEFT JOIN (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1) l ON l.class = c.class")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return cards.class_counts(r.table(spark, d, "lineitem"), "l_returnflag", ("A", "N", "X"))


@query(
    "U1",
    f"""SELECT 'd' AS dataset, osm_id AS item_id, CAST(-revision AS DOUBLE) AS urgency, status <> 'proposed' AS resolved, 'correction' AS kind, 0 AS kind_rank FROM folded
    UNION ALL SELECT 'd', osm_id, CAST(-supporting AS DOUBLE), false, 'issue', 1 FROM ({_ISSUES})
    UNION ALL SELECT 'd', building_id, coalesce(least, 1.0), reviewed, 'attribute', 2 FROM (SELECT building_id, reviewed, CASE WHEN reviewed THEN NULL ELSE least END AS least FROM ({_SUMMARY}))""",
    ("folded", "diagnostics", "preferred"),
)
def u1(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("d").alias("dataset")
    fixes = _folded(spark, d).select(at, F.col("osm_id").alias("item_id"), (-F.col("revision")).alias("urgency"), (F.col("status") != "proposed").alias("resolved"))
    issues = corrections.footprint_issues(_diagnostics(spark, d)).select(at, F.col("osm_id").alias("item_id"), (-F.col("supporting")).alias("urgency"), F.lit(False).alias("resolved"))
    summary = cards.attribute_summary(cards.preferred_values(r.predictions(spark, d))).select(at, F.col("building_id").alias("item_id"), "urgency", F.col("reviewed").alias("resolved"))
    return cards.review_queue([("correction", fixes), ("issue", issues), ("attribute", summary)])


@query(
    "L5",
    """WITH f AS (SELECT 'b' || CAST(conv_id AS VARCHAR) AS building_id, text, min(turn) AS rk FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
    SELECT building_id, text, rn FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY rk, text) AS rn FROM f) WHERE rn <= 3""",
)
def l5(spark: SparkSession, d: str) -> DataFrame:
    rows = r.table(spark, d, "conversations").select(F.concat(F.lit("b"), F.col("conv_id").cast("string")).alias("building_id"), "text", F.col("turn").alias("rank"))
    return cards.observations(rows).select("building_id", "text", F.col("rn").cast("long").alias("rn"))


@query("L1", "SELECT image_id, pixels FROM views WHERE building_id = (SELECT min(building_id) FROM views) ORDER BY pixels DESC, image_id", ("views",))
def l1(spark: SparkSession, d: str) -> DataFrame:
    v = r.views(spark, d)
    one = v.agg(F.min("building_id").alias("building_id"))
    return v.join(F.broadcast(one), "building_id", "left_semi").select("image_id", "pixels").orderBy(F.desc("pixels"), "image_id")


@query("L2", "SELECT image_id, captured_at_ms FROM captures ORDER BY coalesce(captured_at_ms, 0), image_id", ("captures",))
def l2(spark: SparkSession, d: str) -> DataFrame:
    return cap.ordered_captures(r.captures(spark, d)).select("image_id", "captured_at_ms")


@query("L3", "SELECT *, (SELECT count(*) FROM captures) AS total, (SELECT count(*) FROM captures) > 20 AS truncated FROM (SELECT image_id FROM captures ORDER BY image_id LIMIT 20)", ("captures",))
def l3(spark: SparkSession, d: str) -> DataFrame:
    first, total, cut = cap.page(r.captures(spark, d), ["image_id"], 20)
    return first.select("image_id", F.lit(total).alias("total"), F.lit(cut).alias("truncated"))


@query("S15", "SELECT dataset, count(*) AS images, max(captured_at_ms) AS newest FROM captures GROUP BY dataset", ("captures",))
def s15(spark: SparkSession, d: str) -> DataFrame:
    return cap.dataset_summaries(r.captures(spark, d))


@query("S16", "SELECT image_id || ' by ' || coalesce(CASE WHEN k % 3 = 0 THEN 'u' || sequence_id END, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END, 'unknown') AS value FROM captures", ("captures",))
def s16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = r.captures(spark, d).withColumn("username", F.when(k % 3 == 0, F.concat(F.lit("u"), "sequence_id"))).withColumn("creator_id", F.when(k % 2 == 0, k))
    return cap.attribution_lines(rows)


@query("U3", "SELECT DISTINCT building_id FROM views EXCEPT SELECT building_id FROM views WHERE blurry", ("views",))
def u3(spark: SparkSession, d: str) -> DataFrame:
    v = r.views(spark, d)
    return v.select("building_id").subtract(v.where(F.size("flags") > 0).select("building_id"))


@query("U4", "SELECT CAST(l_orderkey AS VARCHAR) AS image_id, min(epoch_ms(l_shipdate)) AS captured_at_ms FROM lineitem GROUP BY l_orderkey")
def u4(spark: SparkSession, d: str) -> DataFrame:
    rows = r.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_id"), r.millis(F.col("l_shipdate")).alias("captured_at_ms"), F.col("l_suppkey").cast("string").alias("dataset"))
    return cap.dedupe_captures(rows).select("image_id", "captured_at_ms")


@query("U5", "SELECT source, count(*) AS n FROM (SELECT 'labels' AS source FROM labels UNION ALL SELECT 'tags' FROM footprints) GROUP BY source", ("footprints",))
def u5(spark: SparkSession, d: str) -> DataFrame:
    a = r.table(spark, d, "labels").select(F.lit("labels").alias("source"), F.col("doc_id").cast("string").alias("id"))
    return a.unionByName(r.footprints(spark, d).select(F.lit("tags").alias("source"), F.col("building_id").alias("id"))).groupBy("source").agg(F.count("*").alias("n"))


@query("J16", "SELECT DISTINCT building_id FROM views WHERE building_id NOT IN (SELECT building_id FROM views WHERE NOT blurry)", ("views",))
def j16(spark: SparkSession, d: str) -> DataFrame:
    v = r.views(spark, d)
    return v.select("building_id").distinct().join(v.where(F.size("flags") == 0), "building_id", "left_anti")


@query("J23", "SELECT v.building_id, v.image_id, f.building_tag FROM (SELECT 'way/' || CAST(l_partkey AS VARCHAR) AS building_id, CAST(l_orderkey AS VARCHAR) AS image_id FROM lineitem GROUP BY ALL) v LEFT JOIN footprints f ON f.building_id = v.building_id", ("footprints",))
def j23(spark: SparkSession, d: str) -> DataFrame:
    v = r.table(spark, d, "lineitem").select(F.concat(F.lit("way/"), F.col("l_partkey").cast("string")).alias("building_id"), F.col("l_orderkey").cast("string").alias("image_id")).distinct()
    return v.join(r.footprints(spark, d).select("building_id", "building_tag"), "building_id", "left")


@query("X2", "SELECT building_id, provider FROM predictions WHERE NOT (attribute = 'floors' AND modified % 2 = 0) GROUP BY building_id, provider, attribute", ("predictions",))
def x2(spark: SparkSession, d: str) -> DataFrame:
    p = r.predictions(spark, d).select("building_id", "provider", F.concat_ws("/", "attribute", "modified").alias("fingerprint"), "attribute", "modified")
    stored = p.where("attribute = 'floors' AND modified % 2 = 0").select("building_id", "provider", "fingerprint")
    return cards.changed_inputs(p, stored).select("building_id", "provider")


@query("X4", "SELECT CASE WHEN o_orderstatus LIKE 'O%' THEN 'residential' ELSE 'non-residential' END AS grp, count(*) AS n FROM orders GROUP BY 1")
def x4(spark: SparkSession, d: str) -> DataFrame:
    groups = {"residential": F.col("use").startswith("O"), "non-residential": ~F.col("use").startswith("O")}
    rows = r.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "use")
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(named).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query("X6", "SELECT run, count(*) AS n FROM (SELECT 'prior' AS run FROM tagged WHERE building_type IS NOT NULL UNION ALL SELECT 'saved' FROM predictions WHERE provider = 'vlm:a' AND attribute = 'building_type') GROUP BY run", ("tagged", "predictions"))
def x6(spark: SparkSession, d: str) -> DataFrame:
    prior = cards.tag_prior(r.footprints(spark, d)).where("attribute = 'building_type' AND NOT abstained").select(F.lit("prior").alias("run"))
    saved = r.predictions(spark, d).where("provider = 'vlm:a' AND attribute = 'building_type'").select(F.lit("saved").alias("run"))
    return prior.union(saved).groupBy("run").agg(F.count("*").alias("n"))


@query("X1", "SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE upper(role) END AS answer, CASE WHEN length(text) % 5 = 0 THEN 'ValueError' END AS error FROM conversations")
def x1(spark: SparkSession, d: str) -> DataFrame:
    from streetweave.functions.providers import answered_by

    def provider(image: str, prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ValueError("no answer")
        return image.upper()

    rows = r.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("image"), F.col("text").alias("prompt"))
    out = rows.select("id", answered_by(provider)(F.col("image"), F.col("prompt")).alias("a"))
    return out.select("id", "a.answer", "a.error")


@query(
    "A20",
    """WITH v AS (SELECT building_id, w.image_id, w.dataset AS source, w.pixels // 400 AS n, w.coverage, lat, lon, CASE WHEN (w.pixels // 400) % 7 = 0 THEN (w.pixels // 400) % 3 END AS revision FROM views w LEFT JOIN captures c ON c.image_id = w.image_id),
    f AS (SELECT a.building_id, max(2 * 6371008.8 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) >= 3) AS far
      FROM v a JOIN v b ON a.building_id = b.building_id GROUP BY a.building_id),
    g AS (SELECT building_id, count(*) AS views, count(DISTINCT n % 2) AS variants, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(revision) AS corrected, sum(n) AS samples, sum(CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END) AS conflicts,
      count(lat) AS located FROM v GROUP BY building_id), s AS (SELECT count(*) FILTER (WHERE quality = 0) AS stale FROM labels)
    SELECT building_id, views, sources, CASE WHEN variants > 1 THEN 'mixed_geometry_association' WHEN coalesce(far, false) THEN 'consistent_multi_view_association' ELSE 'single_view_association' END AS conclusion,
      CASE WHEN coalesce(far, false) THEN 'supporting' ELSE 'caution' END AS multi_view_support, CASE WHEN variants = 1 THEN 'supporting' ELSE 'caution' END AS geometry_consistency, 'informational' AS geometry_provenance,
      CASE WHEN corrected > 0 THEN 'caution' ELSE 'informational' END AS footprint_correction, 'informational' AS pose_alignment,
      CASE WHEN conflicts > 0 THEN 'caution' WHEN samples > 0 THEN 'supporting' ELSE 'not_available' END AS depth_evidence, CASE WHEN stale > 0 THEN 'caution' ELSE 'supporting' END AS input_completeness FROM g LEFT JOIN f USING (building_id), s""",
    ("views", "captures"),
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("pixels") / 400)
    rows = r.views(spark, d).select(
        "building_id", "image_id", (n % 2).alias("geometry"), F.col("dataset").alias("source"), F.when(n % 7 == 0, n % 3).alias("revision"), F.col("coverage").alias("facade_iou"),
        n.alias("depth_samples"), F.when(n % 3 == 2, 1).otherwise(0).alias("depth_conflicts"),
    )
    good = F.col("quality") == 1
    read = r.table(spark, d, "labels").select(F.when(good, 1).otherwise(0).alias("compatible"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("stale"), F.lit(0).alias("incomplete"), F.lit(0).alias("invalid"))
    checks = ("multi_view_support", "geometry_consistency", "geometry_provenance", "footprint_correction", "pose_alignment", "depth_evidence", "input_completeness")
    return views.assess_footprints(rows, landing(spark, "views"), read, r.captures(spark, d).select("image_id", "lat", "lon")).select("building_id", "views", F.concat_ws(",", "sources").alias("sources"), "conclusion", *checks)


@query("A41", "SELECT building_id, count(*) AS n FROM views GROUP BY building_id", ("views",))
def a41(spark: SparkSession, d: str) -> DataFrame:
    reports = views.building_reports(views.ranked_views(r.views(spark, d)))
    return reports.select("building_id", F.get_json_object("report", "$.n").cast("long").alias("n"))


_ = fusion
