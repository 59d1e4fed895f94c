"""Queries of the view, fusion and scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.functions import fields, geo
from streetweave.operators import cards, fusion, scoring, views
from streetweave.plans import registry as r
from streetweave.plans.registry import query
from streetweave.sources.landing import landing

_FRACTION = "CAST(pixels AS DOUBLE) / (width * height)"
_SCORE = f"({_FRACTION}) * (0.25 + 0.75 * coverage) * CASE WHEN blurry THEN 0.5 ELSE 1.0 END"
r.CTES["collected"] = f"""
SELECT *, round({_FRACTION}, 6) AS observed_fraction, round(coverage, 4) AS projection_coverage, round({_SCORE}, 8) AS score,
  NOT blurry AND {_FRACTION} >= 0.005 AS usable FROM views
"""
r.NEEDS["collected"] = ("views",)


@query("A1", "SELECT building_id, image_id, captured_at_ms, observed_fraction, projection_coverage, score, usable FROM collected", ("collected",))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return views.collect_views(r.views(spark, d)).select("building_id", "image_id", "captured_at_ms", "observed_fraction", "projection_coverage", "score", "usable")


_ROWS = """
SELECT building_id,
  CASE WHEN count(DISTINCT CASE WHEN usable THEN image_id END) >= 2 THEN 'multi_view'
    WHEN count(DISTINCT CASE WHEN usable THEN image_id END) = 1 THEN 'single_view' ELSE 'weak_views_only' END AS association_status,
  count(*) AS views, count(*) FILTER (usable) AS clean_views, count(*) FILTER (blurry) AS flagged_views,
  arg_min(image_id, ROW(-score, image_id)) AS best_image_id, max(score) AS best_score,
  min(captured_at_ms) AS first_captured_ms, max(captured_at_ms) AS last_captured_ms
FROM collected GROUP BY building_id
"""
_ROW_COLUMNS = ("building_id", "association_status", "views", "clean_views", "flagged_views", "best_image_id", "best_score", "first_captured_ms", "last_captured_ms")


@query("A2", _ROWS, ("collected",))
def a2(spark: SparkSession, d: str) -> DataFrame:
    return views.building_rows(views.collect_views(r.views(spark, d))).select(*_ROW_COLUMNS)


@query(
    "A3",
    f"SELECT building_id, association_status FROM ({_ROWS})",
    ("collected",),
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    return views.building_rows(views.collect_views(r.views(spark, d))).select("building_id", "association_status")


@query(
    "W1",
    f"""SELECT building_id, image_id, CAST(row_number() OVER (PARTITION BY building_id
      ORDER BY {_SCORE} DESC, pixels DESC, coverage DESC, captured_at_ms ASC NULLS LAST, image_id) AS BIGINT) AS "rank" FROM views""",
    ("views",),
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    return views.ranked_views(r.views(spark, d)).select("building_id", "image_id", F.col("rank").cast("long").alias("rank"))


@query(
    "W2",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY building_id
      ORDER BY {_SCORE} DESC, pixels DESC, coverage DESC, captured_at_ms ASC NULLS LAST, image_id) AS rk FROM views),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY rk) AS place FROM ranked WHERE NOT blurry OR image_id LIKE '%7')
    SELECT building_id, image_id, CAST(place AS BIGINT) AS place FROM chosen WHERE place <= 3""",
    ("views",),
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    rows = r.views(spark, d)
    vouched = rows.where(F.col("image_id").endswith("7")).select("building_id", "image_id")
    chosen, _ = views.select_views(views.ranked_views(rows), 3, vouched)
    return chosen.select("building_id", "image_id", F.col("place").cast("long").alias("place"))


@query(
    "P13",
    """SELECT l_orderkey * 10 + l_linenumber AS id, concat_ws(',', CASE WHEN l_quantity * 4 < 100 THEN 'blurry' END,
      CASE WHEN l_discount * 2500 < 20 THEN 'dark' END, CASE WHEN l_discount * 2500 > 200 THEN 'overexposed' END,
      CASE WHEN l_extendedprice < 20480 THEN 'small_file' END) AS flags,
      CASE WHEN l_quantity * 4 < 100 OR l_discount * 2500 < 20 OR l_discount * 2500 > 200 OR l_extendedprice < 20480 THEN 0.5 ELSE 1.0 END AS weight
    FROM lineitem""",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    flags = views.quality_flags(F.col("l_quantity") * 4, F.col("l_discount") * 2500, F.col("l_extendedprice"))
    rows = r.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), flags.alias("f"))
    return rows.select("id", F.concat_ws(",", "f").alias("flags"), views.rank_weight(F.col("f")).alias("weight"))


@query("P14", f"SELECT building_id, image_id, {_SCORE} AS score FROM views", ("views",))
def p14(spark: SparkSession, d: str) -> DataFrame:
    score = views.view_score(F.col("pixels") / (F.col("width") * F.col("height")), F.col("coverage"), F.col("flags"))
    return r.views(spark, d).select("building_id", "image_id", score.alias("score"))


@query(
    "P12",
    """WITH rows AS (SELECT image_id, building_id, CASE WHEN pixels % 7 = 0 THEN -pixels ELSE pixels END AS p, coverage * 1.2 AS c,
        CASE WHEN pixels % 5 = 0 THEN 0 ELSE width END AS w, CAST(30 + pixels % 4 AS BIGINT) AS version FROM views),
    issues AS (
      SELECT unnest(list_filter([CASE WHEN NOT w > 0 THEN 'bad_size' END, CASE WHEN NOT (p >= 0 AND p <= w * 1000) THEN 'bad_pixels' END,
        CASE WHEN NOT (c >= 0 AND c <= 1) THEN 'bad_coverage' END, CASE WHEN version <> 33 THEN 'stale' END, CASE WHEN building_id = 'way/0' THEN 'no_building' END], lambda x: x IS NOT NULL)) AS code FROM rows)
    SELECT code, count(*) AS n FROM issues GROUP BY code""",
    ("views",),
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pixels")
    rows = r.views(spark, d).select(
        "image_id", "building_id", F.when(p % 7 == 0, -p).otherwise(p).alias("pixels"), (F.col("coverage") * 1.2).alias("coverage"),
        F.when(p % 5 == 0, 0).otherwise(F.col("width")).alias("width"), "height", (30 + p % 4).alias("version"),
    )
    _, issues = views.validate_views(rows, version=33)
    return views.issue_counts(issues).withColumnRenamed("count", "n")


_SIGNALS = """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity - 1 AS BIGINT) AS pixels, l_quantity / 10000 AS pixel_share, l_discount * 8 AS overhead_share,
  l_tax * 8 AS outside_share, l_linenumber AS runs, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax * 5 END AS above_roof_share, l_linenumber AS components,
  l_quantity / 50 AS fill, l_discount * 10 AS projected_share, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax * 4 END AS coverage, l_suppkey % 10 = 0 AS inside
FROM lineitem
"""


@query(
    "P15",
    f"""SELECT id, concat_ws(',', CASE WHEN inside THEN 'interior' END, CASE WHEN pixel_share < 0.002 THEN 'sliver' END,
      CASE WHEN pixels > 0 AND overhead_share > 0.4 THEN 'overhead' END, CASE WHEN pixels > 0 AND outside_share > 0.3 THEN 'neighbor' END,
      CASE WHEN pixels > 0 AND runs > 1 THEN 'street' END, CASE WHEN pixels > 0 AND coalesce(above_roof_share, 0) > 0.25 THEN 'sky' END,
      CASE WHEN pixels > 0 AND (components > 4 OR fill < 0.45) THEN 'speckle' END,
      CASE WHEN pixels > 0 AND coverage IS NOT NULL AND projected_share >= 0.01 AND coverage < 0.15 THEN 'missing' END) AS reasons
    FROM ({_SIGNALS})""",
)
def p15(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("l_returnflag")
    rows = r.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") - 1).cast("long").alias("pixels"), (F.col("l_quantity") / 10000).alias("pixel_share"),
        (F.col("l_discount") * 8).alias("overhead_share"), (F.col("l_tax") * 8).alias("outside_share"), F.col("l_linenumber").alias("runs"),
        F.when(f != "R", F.col("l_tax") * 5).alias("above_roof_share"), F.col("l_linenumber").alias("components"), (F.col("l_quantity") / 50).alias("fill"),
        (F.col("l_discount") * 10).alias("projected_share"), F.when(f != "A", F.col("l_tax") * 4).alias("coverage"), (F.col("l_suppkey") % 10 == 0).alias("camera_inside"),
    )
    signals = {c: F.col(c) for c in rows.columns if c != "id"}
    return rows.select("id", F.concat_ws(",", views.assess_mask(signals)).alias("reasons"))


@query("A19", "SELECT 'blurry' AS reason, count(*) AS views FROM views WHERE blurry", ("views",))
def a19(spark: SparkSession, d: str) -> DataFrame:
    return views.flag_counts(r.views(spark, d))


@query("P31", "SELECT image_id, building_id, true AS remove FROM views WHERE pixels < 4000", ("views",))
def p31(spark: SparkSession, d: str) -> DataFrame:
    return views.small_views(r.views(spark, d), 4000)


@query(
    "P32",
    """SELECT building_id, image_id, concat_ws('; ', printf('%.2f%% of the picture', pixels * 100.0 / (width * height)),
      CASE WHEN coverage < 0.5 THEN 'less than half of the projection' END, CASE WHEN blurry THEN 'quality: blurry' END) AS why FROM views""",
    ("views",),
)
def p32(spark: SparkSession, d: str) -> DataFrame:
    return views.ranking_reasons(r.views(spark, d)).select("building_id", "image_id", "why")


@query("P27", "SELECT building_id, image_id, '/viewer/?image=' || image_id || '&building=' || replace(building_id, '/', '%2F') AS url FROM views", ("views",))
def p27(spark: SparkSession, d: str) -> DataFrame:
    return views.view_links(r.views(spark, d), "/viewer/").select("building_id", "image_id", "url")


r.CTES["fused"] = """
SELECT building_id, views, CASE WHEN mass IS NULL THEN NULL ELSE top END AS top, round(s / mass, 6) AS share FROM (
  SELECT building_id, views, arg_max(class, ROW(s, -p)) AS top, max(s) AS s, sum(s) AS mass FROM (
    SELECT v.building_id, v.class, sum(score * weight) AS s, CASE v.class WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS p, n.views
    FROM votes v JOIN (SELECT building_id, count(DISTINCT id) AS views FROM votes WHERE weight > 0 GROUP BY building_id) n ON n.building_id = v.building_id
    WHERE weight > 0 GROUP BY v.building_id, v.class, n.views) GROUP BY building_id, views)
"""
r.NEEDS["fused"] = ("votes",)


@query("A5", "SELECT building_id, top, share, views, share < 0.5 AS abstained FROM fused", ("fused",))
def a5(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.fuse_categorical(r.votes(spark, d), ["building_id"], ["id"], ("A", "N", "R"))
    return out.select("building_id", "top", "share", "views", "abstained")


@query(
    "A6",
    """WITH m AS (SELECT building_id, min(value) AS median FROM (SELECT *, sum(weight) OVER (PARTITION BY building_id ORDER BY value, id) AS run,
        sum(weight) OVER (PARTITION BY building_id) AS everything FROM votes) WHERE run >= everything / 2 GROUP BY building_id),
    o AS (SELECT v.building_id, abs(value - median) AS off, weight, id FROM votes v JOIN m ON m.building_id = v.building_id),
    s AS (SELECT building_id, min(off) AS spread FROM (SELECT *, sum(weight) OVER (PARTITION BY building_id ORDER BY off, id) AS run,
        sum(weight) OVER (PARTITION BY building_id) AS everything FROM o) WHERE run >= everything / 2 GROUP BY building_id)
    SELECT m.building_id, round(median, 3) AS value, round(spread, 3) AS spread, n.views FROM m JOIN s ON m.building_id = s.building_id
    JOIN (SELECT building_id, count(*) AS views FROM votes GROUP BY building_id) n ON n.building_id = m.building_id""",
    ("votes",),
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_numeric(r.votes(spark, d), ["building_id"], ["id"])


@query(
    "P19",
    """SELECT o_orderkey AS id, class, score FROM (
      SELECT o_orderkey, o_orderstatus AS class, CASE WHEN two THEN 1.0 / 1.5 ELSE 1.0 END AS score
      FROM (SELECT *, substr(o_orderpriority, 3, 1) <> o_orderstatus AS two FROM orders)
      UNION ALL SELECT o_orderkey, substr(o_orderpriority, 3, 1), 0.5 / 1.5 FROM orders WHERE substr(o_orderpriority, 3, 1) <> o_orderstatus)""",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    rows = r.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"), F.substring("o_orderpriority", 3, 1).alias("b"))
    return fusion.view_votes(rows, "a", "b", ["id"])


_ANSWER = """
SELECT event_id AS id, 'Notes <think>hm</think> first.' || chr(10) || '{"floors": 3}' || ' then {"floors": "' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ||
  '", "building_type": "' || CASE event_type WHEN 'click' THEN 'Office' WHEN 'view' THEN 'HOUSE' ELSE 'castle' END || '", "observations": "two   words' || chr(10) || props_k || '"}' AS text
FROM (SELECT *, replace(replace(replace(props, '{', ''), '}', ''), '"', '') AS props_k FROM events)
"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.translate("props", '{}"', "")
    kind = F.when(F.col("event_type") == "click", "Office").when(F.col("event_type") == "view", "HOUSE").otherwise("castle")
    text = F.concat(
        F.lit('Notes <think>hm</think> first.\n{"floors": 3} then {"floors": "'), F.floor("value").cast("string"),
        F.lit('", "building_type": "'), kind, F.lit('", "observations": "two   words\n'), k, F.lit('"}'),
    )
    return r.table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("text"))


@query(
    "P17",
    f"""SELECT id, CASE WHEN f > 0 AND f <= 150 THEN CAST(f AS DOUBLE) END AS floors,
      CASE WHEN t LIKE '%Office%' THEN 'office' WHEN t LIKE '%HOUSE%' THEN 'house' END AS building_type, 'two words ' || regexp_extract(t, 'words\\s(k: [0-9]+)', 1) AS observations
    FROM (SELECT id, text AS t, CAST(regexp_extract(text, 'then .."floors": "([0-9]+)"', 1) AS BIGINT) AS f FROM ({_ANSWER.replace("then {", "then {")}))""".replace('then .."floors"', 'then ."floors"'),
)
def p17(spark: SparkSession, d: str) -> DataFrame:
    return fusion.parse_answers(_answers(spark, d), {"building_type": cards.BUILDING_TYPES}).select("id", "floors", "building_type", "observations")


@query("P18", f"SELECT id, 'Notes  first.' AS notes FROM ({_ANSWER})")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("id", fusion.visible_reasoning(F.col("text")).alias("notes"))


_CAT = """
WITH a AS (SELECT * FROM scored WHERE predicted IS NOT NULL),
cl AS (SELECT run, class, sum(s) AS support, sum(tp) AS tp, sum(g) AS guessed FROM (
  SELECT run, truth AS class, 1 AS s, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS tp, 0 AS g FROM a
  UNION ALL SELECT run, predicted, 0, 0, 1 FROM a) GROUP BY run, class),
per AS (SELECT run, round(avg(CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support END), 4) AS balanced_accuracy,
  round(avg(2.0 * tp / (support + guessed)), 4) AS macro_f1, max(support) AS most FROM cl GROUP BY run)
SELECT s.run, count(*) AS n, count(predicted) AS answered, round(CAST(count(predicted) AS DOUBLE) / count(*), 4) AS coverage,
  round(CAST(count(*) FILTER (predicted = truth) AS DOUBLE) / count(predicted), 4) AS accuracy, any_value(balanced_accuracy) AS balanced_accuracy,
  any_value(macro_f1) AS macro_f1, round(CAST(any_value(most) AS DOUBLE) / count(predicted), 4) AS majority_baseline
FROM scored s JOIN per ON per.run = s.run GROUP BY s.run
"""


@query("A13", _CAT, ("scored",))
def a13(spark: SparkSession, d: str) -> DataFrame:
    return scoring.categorical_scores(r.scored(spark, d), ["run"])


@query(
    "A14",
    """WITH a AS (SELECT run, truth_value AS t, predicted_value AS p FROM scored WHERE predicted_value IS NOT NULL),
    m AS (SELECT run, median(t) AS m FROM a GROUP BY run),
    s AS (SELECT a.run, count(*) AS answered, round(avg(abs(p - t)), 3) AS mae, round(avg(p - t), 3) AS bias,
      round(1 - avg((p - t) * (p - t)) / var_pop(t), 4) AS r2, round(avg(abs(t - m)), 3) AS median_baseline_mae,
      round(avg(CASE WHEN abs(p - t) <= 10 THEN 1.0 ELSE 0.0 END), 4) AS within_tolerance FROM a JOIN m ON m.run = a.run GROUP BY a.run)
    SELECT s.*, n.n FROM s JOIN (SELECT run, count(*) AS n FROM scored GROUP BY run) n ON n.run = s.run""",
    ("scored",),
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    return scoring.numeric_scores(r.scored(spark, d), ["run"], 10.0)


@query(
    "A15",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY confidence DESC, building_id) AS rn FROM scored WHERE predicted IS NOT NULL),
    c AS (SELECT run, count(*) AS n, count(predicted) AS answered FROM scored GROUP BY run),
    k AS (SELECT run, n, share, greatest(1, CAST(round_even(answered * share, 0) AS BIGINT)) AS kept FROM c, (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS share))
    SELECT k.run, CAST(share AS DOUBLE) AS share, round(CAST(kept AS DOUBLE) / n, 4) AS coverage, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 4) AS accuracy
    FROM a JOIN k ON k.run = a.run AND rn <= kept GROUP BY k.run, share, kept, n""",
    ("scored",),
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    return scoring.risk_coverage(r.scored(spark, d), ["run"], ["building_id"], landing(spark, "answers"))


r.CTES["run_answers"] = """
SELECT 'r' || CAST(l_linenumber % 3 AS VARCHAR) AS run, l_suppkey AS building_id, max(CASE WHEN l_linenumber % 3 = 2 AND l_suppkey % 3 > 0 THEN NULL ELSE l_returnflag END) AS predicted,
  max(l_linestatus) AS truth, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'other' END AS use FROM lineitem GROUP BY l_linenumber % 3, l_suppkey
"""


def _run_answers(spark: SparkSession, d: str) -> DataFrame:
    """One row for each run and building, landed, since what builds on it reads it several times."""
    k, s = F.col("l_linenumber") % 3, F.col("l_suppkey")
    # the greatest of texts is found by sorting: of the few that are distinct, which hashing tells
    said = r.table(spark, d, "lineitem").select(k.alias("k"), s.alias("building_id"), "l_returnflag", "l_linestatus").distinct()
    rows = said.groupBy("k", "building_id").agg(F.max("l_returnflag").alias("p"), F.max("l_linestatus").alias("truth"))
    answers = rows.select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("run"), "building_id",
        F.when(~((F.col("k") == 2) & (F.col("building_id") % 3 > 0)), F.col("p")).alias("predicted"), "truth",
        F.when(F.col("building_id") % 2 == 0, "home").otherwise("other").alias("use"),
    )
    return landing(spark, "runs")(answers)


_COMMON = """
SELECT building_id FROM run_answers WHERE predicted IS NOT NULL AND run IN
  (SELECT run FROM run_answers WHERE predicted IS NOT NULL GROUP BY run HAVING count(DISTINCT building_id) * 2 >= (SELECT count(DISTINCT building_id) FROM run_answers))
GROUP BY building_id HAVING count(DISTINCT run) = (SELECT count(*) FROM (
  SELECT run FROM run_answers WHERE predicted IS NOT NULL GROUP BY run HAVING count(DISTINCT building_id) * 2 >= (SELECT count(DISTINCT building_id) FROM run_answers)))
"""


@query("A16", _COMMON, ("run_answers",))
def a16(spark: SparkSession, d: str) -> DataFrame:
    return scoring.common_subset(_run_answers(spark, d).withColumn("said", F.col("predicted").isNotNull()), "building_id", "run", "said")


@query("U2", _COMMON, ("run_answers",))
def u2(spark: SparkSession, d: str) -> DataFrame:
    rows = _run_answers(spark, d)
    deciding = scoring.common_subset(rows.withColumn("said", F.col("predicted").isNotNull()), "building_id", "run", "said")
    return rows.where("predicted IS NOT NULL").select("building_id").intersect(deciding)


@query(
    "A17",
    f"""WITH common AS ({_COMMON}), e AS (
      SELECT run, 'all' AS subset, truth, predicted FROM run_answers UNION ALL SELECT run, 'use ' || use, truth, predicted FROM run_answers
      UNION ALL SELECT run, 'common', truth, predicted FROM run_answers WHERE building_id IN (SELECT building_id FROM common))
    SELECT run, subset, count(*) AS n, count(predicted) AS answered, round(CAST(count(*) FILTER (truth = predicted) AS DOUBLE) / nullif(count(predicted), 0), 4) AS accuracy
    FROM e GROUP BY run, subset""",
    ("run_answers",),
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    return scoring.experiment_report(_run_answers(spark, d)).select("run", "subset", "n", "answered", "accuracy")


@query(
    "A18",
    """WITH l AS (SELECT image_id, building_id, CASE WHEN pixels % 3 = 0 THEN 'bad' ELSE 'good' END AS label FROM views),
    s AS (SELECT image_id, building_id, NOT blurry AS ok FROM views WHERE pixels % 5 > 0)
    SELECT count(*) FILTER (label = 'bad' AND ok IS NOT NULL) AS bad, count(*) FILTER (label = 'good' AND ok IS NOT NULL) AS good, count(*) FILTER (ok IS NULL) AS unscored,
      round(CAST(count(*) FILTER (label = 'bad' AND NOT ok) AS DOUBLE) / greatest(count(*) FILTER (label = 'bad' AND ok IS NOT NULL), 1), 3) AS recall,
      round(CAST(count(*) FILTER (label = 'good' AND NOT ok) AS DOUBLE) / greatest(count(*) FILTER (label = 'good' AND ok IS NOT NULL), 1), 3) AS false_alarms
    FROM l LEFT JOIN s ON l.image_id = s.image_id AND l.building_id = s.building_id""",
    ("views",),
)
def a18(spark: SparkSession, d: str) -> DataFrame:
    v = r.views(spark, d)
    labels = v.select("image_id", "building_id", F.when(F.col("pixels") % 3 == 0, "bad").otherwise("good").alias("label"))
    return scoring.evaluate_flags(labels, v.where(F.col("pixels") % 5 > 0).select("image_id", "building_id", (F.size("flags") == 0).alias("ok")))


_ERRORS = "SELECT l_shipmode_like AS corruption, l_quantity AS error, l_discount * 100 AS clean, l_suppkey % 2 AS half FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem)"


@query(
    "A25",
    f"""WITH d AS (SELECT half, corruption, sum(error - clean) AS g FROM ({_ERRORS}) GROUP BY half, corruption)
    SELECT round(avg(a.g / nullif(b.g, 0)), 6) AS relative_mce FROM d a JOIN d b ON a.corruption = b.corruption AND a.half = 0 AND b.half = 1""",
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    rows = r.table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("corruption"), F.col("l_quantity").alias("error"), (F.col("l_discount") * 100).alias("clean"), (F.col("l_suppkey") % 2).alias("half")
    )
    own, other = (scoring.relative_degradation(rows.where(F.col("half") == h)) for h in (0, 1))
    return scoring.relative_mce(own, other).select(F.round("relative_mce", 6).alias("relative_mce"))


@query(
    "A34",
    """SELECT o_orderstatus AS source, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH"
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus""",
)
def a34(spark: SparkSession, d: str) -> DataFrame:
    rows = r.table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return scoring.truth_coverage(rows.select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("attribute")), ["1-URGENT", "2-HIGH"])


@query("A40", "SELECT status, count(*) AS buildings, median(value) AS median_seconds FROM ledger GROUP BY status", ("ledger",))
def a40(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_summary(r.ledger(spark, d).select("status", F.col("value").alias("seconds")))


@query("J15", "SELECT run, building_id, truth, coalesce(predicted, 'abstained') AS answer FROM scored", ("scored",))
def j15(spark: SparkSession, d: str) -> DataFrame:
    rows = r.scored(spark, d)
    truth, said = rows.select("run", "building_id", "truth"), rows.where("predicted IS NOT NULL").select("run", "building_id", "predicted")
    return truth.join(said, ["run", "building_id"], "left").select("run", "building_id", "truth", F.coalesce("predicted", F.lit("abstained")).alias("answer"))


_FIELDS = """
SELECT building_id, CASE p_size % 6 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5 WHEN 3 THEN p_size * 0.3048 END AS h,
  CASE WHEN levels_tag IS NOT NULL AND CAST(levels_tag AS INTEGER) > 0 THEN CAST(levels_tag AS DOUBLE) END AS lv, f.building_tag, f.material_tag, f.levels_tag, f.start_tag, p_size
FROM footprints f JOIN part ON p_partkey = k
"""
r.CTES["parsed"] = _FIELDS
r.NEEDS["parsed"] = ("footprints",)


@query("P5", "SELECT building_id, round(h, 9) AS height, lv AS levels FROM parsed", ("parsed",))
def p5(spark: SparkSession, d: str) -> DataFrame:
    return r.footprints(spark, d).select("building_id", F.round(fields.parse_height(F.col("height_tag")), 9).alias("height"), fields.parse_levels(F.col("levels_tag")).alias("levels"))


@query(
    "P6",
    """SELECT building_id, round(coalesce(h, greatest(lv * 3.2, 3.0), 10.0), 9) AS height_m, CASE WHEN h IS NOT NULL THEN 'height' WHEN lv IS NOT NULL THEN 'levels' ELSE 'default' END AS height_source,
      round(CASE WHEN h IS NULL AND lv IS NULL THEN 32.0 ELSE coalesce(h, greatest(lv * 3.2, 3.0), 10.0) END, 9) AS drawn_m FROM parsed""",
    ("parsed",),
)
def p6(spark: SparkSession, d: str) -> DataFrame:
    height, source, drawn = fields.building_height(fields.parse_height(F.col("height_tag")), fields.parse_levels(F.col("levels_tag")))
    return r.footprints(spark, d).select("building_id", F.round(height, 9).alias("height_m"), source.alias("height_source"), F.round(drawn, 9).alias("drawn_m"))


@query(
    "P7",
    "SELECT building_id, building_tag <> 'no' AS is_building, building_tag = 'roof' OR p_size % 4 = 3 AS is_overhead FROM parsed",
    ("parsed",),
)
def p7(spark: SparkSession, d: str) -> DataFrame:
    size = r.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    bottom = F.when(F.col("p_size") % 4 == 3, 3.2)
    rows = r.footprints(spark, d).join(size, "k")
    return rows.select("building_id", fields.is_building(F.col("building_tag")).alias("is_building"), fields.is_overhead(F.col("building_tag"), bottom).alias("is_overhead"))


r.CTES["tagged"] = """
SELECT building_id, CASE lower(building_tag) WHEN 'apartments' THEN 'apartments' WHEN 'house' THEN 'house' WHEN 'church' THEN 'religious' WHEN 'warehouse' THEN 'industrial' END AS building_type,
  CASE material_tag WHEN 'brick' THEN 'brick' WHEN 'stucco' THEN 'plaster' END AS surface_material, CAST(levels_tag AS DOUBLE) AS floors,
  CASE WHEN start_tag LIKE '~%' THEN CAST(substr(start_tag, 2, 4) AS INTEGER) WHEN start_tag LIKE '%-%' THEN CAST(substr(start_tag, 1, 4) AS INTEGER) END AS construction_year FROM footprints
"""
r.NEEDS["tagged"] = ("footprints",)


@query("P8", "SELECT * FROM tagged", ("tagged",))
def p8(spark: SparkSession, d: str) -> DataFrame:
    return cards.tags_to_attributes(r.footprints(spark, d)).select("building_id", "building_type", "surface_material", "floors", "construction_year")


@query(
    "P9",
    """SELECT building_id, a AS attribute, t AS top, v AS value, t IS NULL AND v IS NULL AS abstained FROM (
      SELECT building_id, 'building_type' AS a, building_type AS t, CAST(NULL AS DOUBLE) AS v FROM tagged UNION ALL SELECT building_id, 'surface_material', surface_material, NULL FROM tagged
      UNION ALL SELECT building_id, 'gem_material', NULL, NULL FROM tagged UNION ALL SELECT building_id, 'gem_llrs', NULL, NULL FROM tagged
      UNION ALL SELECT building_id, 'floors', NULL, floors FROM tagged UNION ALL SELECT building_id, 'construction_year', NULL, CAST(construction_year AS DOUBLE) FROM tagged)""",
    ("tagged",),
)
def p9(spark: SparkSession, d: str) -> DataFrame:
    return cards.tag_prior(r.footprints(spark, d)).select("building_id", "attribute", "top", "value", "abstained")


@query(
    "P10",
    """SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'CR' END, 'MAT99') || '/' || coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'LFINF' END, 'L99') || '/' ||
      CASE WHEN p_size / 4.0 >= 1 THEN 'HEX:' || CAST(CAST(round_even(p_size / 4.0, 0) AS BIGINT) AS VARCHAR) ELSE 'H99' END AS taxonomy FROM part""",
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    text = cards.taxonomy_string(F.when(s % 3 != 0, "CR"), F.when(s % 4 != 0, "LFINF"), s / 4.0)
    return r.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("taxonomy"))


@query(
    "P11",
    """SELECT id, CASE WHEN split_part(id, '/', 2) <> '' THEN split_part(id, '/', 1) END AS kind, CAST(split_part(id, '/', 2) AS BIGINT) AS number,
      CASE WHEN split_part(id, '/', 3) <> '' THEN split_part(id, '/', 1) || '/' || split_part(id, '/', 2) END AS parent
    FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'way/' ELSE 'relation/' END || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN '/part-' || CAST(p_size AS VARCHAR) ELSE '' END AS id FROM part WHERE p_size > 0)""",
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    name = F.concat(F.when(s % 2 == 0, "way/").otherwise("relation/"), F.col("p_partkey").cast("string"), F.when(s % 3 == 0, F.concat(F.lit("/part-"), s.cast("string"))).otherwise(""))
    kind, number, parent = fields.building_parts(F.col("id"))
    return r.table(spark, d, "part").where("p_size > 0").select(name.alias("id")).select("id", kind.alias("kind"), number.alias("number"), parent.alias("parent"))


@query(
    "P16",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_custkey % 4 = 1 THEN 'house' WHEN o_orderstatus = 'O' AND o_custkey % 4 > 1 THEN 'apartments'
      WHEN o_orderstatus = 'F' THEN 'industrial' END AS building_type FROM orders""",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    use = F.when(F.col("o_orderstatus") == "O", "1_residential").when(F.col("o_orderstatus") == "F", "3_industrial").otherwise("x")
    return r.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cards.reference_type(use, F.col("o_custkey") % 4).alias("building_type"))


@query("P21", "SELECT image_id, printf('%.4f, %.4f, %s', lat + 0.000001, lon + 0.000001, strftime(make_timestamp(captured_at_ms * 1000), '%Y-%m')) AS context FROM captures", ("captures",))
def p21(spark: SparkSession, d: str) -> DataFrame:
    return r.captures(spark, d).select("image_id", F.format_string("%.4f, %.4f, %s", F.col("lat") + 0.000001, F.col("lon") + 0.000001, fields.month(F.col("captured_at_ms"))).alias("context"))


@query(
    "P23",
    """SELECT building_id, sha256('{"id":"' || building_id || '","version":' || CAST(osm_version AS VARCHAR) || ',"levels":' || coalesce('"' || levels_tag || '"', 'null') || '}') AS fingerprint FROM footprints""",
    ("footprints",),
)
def p23(spark: SparkSession, d: str) -> DataFrame:
    value = F.struct(F.col("building_id").alias("id"), F.col("osm_version").alias("version"), F.col("levels_tag").alias("levels"))
    return r.footprints(spark, d).select("building_id", fields.canonical_sha256(value).alias("fingerprint"))


@query(
    "P28",
    """SELECT coalesce(surface_material, 'none') AS class, CASE WHEN floors IS NULL THEN 'none' WHEN floors <= 2 THEN '1-2' WHEN floors <= 5 THEN '3-5' WHEN floors <= 8 THEN '6-8' ELSE '9+' END AS floors_class, count(*) AS n
    FROM (SELECT building_id, floors, CASE surface_material WHEN 'brick' THEN 'masonry' WHEN 'plaster' THEN 'other' END AS surface_material FROM tagged) GROUP BY 1, 2""",
    ("tagged",),
)
def p28(spark: SparkSession, d: str) -> DataFrame:
    rows = cards.tags_to_attributes(r.footprints(spark, d))
    classes = cards.attribute_class(F.col("surface_material"), {"masonry": ("brick", "stone"), "frame": ("concrete", "metal")})
    return rows.groupBy(classes.alias("class"), cards.floors_class(F.col("floors")).alias("floors_class")).agg(F.count("*").alias("n"))


@query(
    "P29",
    """SELECT building_id, abs(floors - p_size % 9) > 0.5 AS floors_differ, abs(construction_year - (1890 + p_size)) > 10 AS year_differs, building_type <> 'house' AS type_differs
    FROM tagged t JOIN part ON 'way/' || CAST(p_partkey AS VARCHAR) = building_id""",
    ("tagged",),
)
def p29(spark: SparkSession, d: str) -> DataFrame:
    ref = r.table(spark, d, "part").select(F.concat(F.lit("way/"), F.col("p_partkey").cast("string")).alias("building_id"), (F.col("p_size") % 9).alias("ref_floors"), (1890 + F.col("p_size")).alias("ref_year"), F.lit("house").alias("ref_type"))
    return cards.reference_check(cards.tags_to_attributes(r.footprints(spark, d)).join(ref, "building_id")).select("building_id", "floors_differ", "year_differs", "type_differs")


@query("P4", None)
def p4(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = fields.camera_up(F.col("l_discount") * 10, F.col("l_tax") * 10 - 0.4, F.col("l_quantity") / 50)
    return r.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("up_x"), y.alias("up_y"), z.alias("up_z"))


r.ORACLES["P4"] = """
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * 10 AS x, l_tax * 10 - 0.4 AS y, l_quantity / 50 AS z FROM lineitem),
w AS (SELECT *, sqrt(x * x + y * y + z * z) AS a FROM v)
SELECT id, round((y / a) * sin(a) + (x / a) * (z / a) * (1 - cos(a)), 6) AS up_x, round(-(x / a) * sin(a) + (y / a) * (z / a) * (1 - cos(a)), 6) AS up_y,
  round(cos(a) + (z / a) * (z / a) * (1 - cos(a)), 6) AS up_z FROM w
"""


@query(
    "F1",
    """SELECT image_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(39.48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(39.48)) * pow(sin(radians(-0.37 - lon) / 2), 2)))), 4) AS distance_m,
      round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing FROM (SELECT *, degrees(atan2(sin(radians(-0.37 - lon)) * cos(radians(39.48)),
        cos(radians(lat)) * sin(radians(39.48)) - sin(radians(lat)) * cos(radians(39.48)) * cos(radians(-0.37 - lon)))) AS b FROM captures)""",
    ("captures",),
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(39.48), F.lit(-0.37)
    return r.captures(spark, d).select("image_id", F.round(geo.haversine_m(lat, lon, a, b), 4).alias("distance_m"), F.round(geo.bearing_deg(lat, lon, a, b), 6).alias("bearing"))


@query(
    "F2",
    """SELECT image_id, round(radians(lon + 0.38) * p * cos(radians(39.47)), 5) AS east_m, round(radians(lat - 39.47) * p * (1 - 0.0066943799901413165) / w, 5) AS north_m
    FROM (SELECT *, 6378137.0 / sqrt(w) AS p FROM (SELECT *, 1 - 0.0066943799901413165 * sin(radians(39.47)) * sin(radians(39.47)) AS w FROM captures))""",
    ("captures",),
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    east, north = geo.local_metres(F.lit(39.47), F.lit(-0.38), F.col("lat"), F.col("lon"))
    return r.captures(spark, d).select("image_id", F.round(east, 5).alias("east_m"), F.round(north, 5).alias("north_m"))


@query(
    "F3",
    """SELECT image_id, ((heading * 3 + 180) % 360) - 180 AS signed, (heading * 2 + 90) % 360 AS centre, (350 - heading + 360) % 360 <= (100 - heading + 360) % 360 AS inside
    FROM captures""",
    ("captures",),
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("heading")
    centre = geo.interval_centre(geo.wrap_360(h * 2), geo.wrap_360(h * 2 + 180))
    return r.captures(spark, d).select("image_id", geo.wrap_180(h * 3).alias("signed"), centre.alias("centre"), geo.in_interval(F.lit(350.0), h, F.lit(100.0)).alias("inside"))


@query("F7", "SELECT p_partkey AS id, replace(replace(lower(p_type), ' ', '_'), '-', '_') AS class, CASE WHEN p_size < 60 THEN CAST(p_size AS VARCHAR) || ' s' END AS took FROM part")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return r.table(spark, d, "part").select(F.col("p_partkey").alias("id"), fields.enumeration(F.col("p_type")).alias("class"), fields.duration_text(F.col("p_size")).alias("took"))


@query("F8", "SELECT image_id, strftime(make_timestamp(captured_at_ms * 1000), '%Y-%m') AS month, captured_at_ms >= 820454400000 AS recent FROM captures", ("captures",))
def f8(spark: SparkSession, d: str) -> DataFrame:
    return r.captures(spark, d).select("image_id", fields.month(F.col("captured_at_ms")).alias("month"), (F.col("captured_at_ms") >= fields.date_cutoff_ms("1996-01-01")).alias("recent"))


@query("F9", "SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def f9(spark: SparkSession, d: str) -> DataFrame:
    last = F.get(F.reverse(F.regexp_extract_all("text", F.lit(r"\{[^{}]*\}"), F.lit(0))), F.lit(0))
    rows = r.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"k": -1} and '), "props").alias("text"))
    return rows.select("id", F.from_json(last, "k long")["k"].alias("k"))


@query(
    "F10",
    """SELECT building_id, string_agg(class, ',' ORDER BY class) AS classes, round(max(w) / sum(w), 6) AS top_share FROM
      (SELECT building_id, class, sum(weight) AS w FROM votes GROUP BY building_id, class) GROUP BY building_id""",
    ("votes",),
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    sums = r.votes(spark, d).groupBy("building_id", "class").agg(F.sum("weight").alias("w"))
    maps = sums.groupBy("building_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("m"))
    whole = F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x)
    return maps.select("building_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("classes"), F.round(F.array_max(F.map_values("m")) / whole, 6).alias("top_share"))


@query(
    "L4",
    """SELECT building_id, class, rn FROM (SELECT building_id, class, row_number() OVER (PARTITION BY building_id ORDER BY w DESC, class) AS rn FROM
      (SELECT building_id, class, sum(weight) AS w FROM votes GROUP BY building_id, class)) WHERE rn <= 2""",
    ("votes",),
)
def l4(spark: SparkSession, d: str) -> DataFrame:
    sums = r.votes(spark, d).groupBy("building_id", "class").agg(F.sum("weight").alias("w"))
    maps = sums.groupBy("building_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("m"))
    top = maps.select("building_id", F.posexplode(cards.top_classes(F.col("m"), 2)).alias("p", "t"))
    return top.select("building_id", "t.class", (F.col("p") + 1).cast("long").alias("rn"))


@query(
    "X3",
    """SELECT building_id, a AS attribute, true AS abstained FROM (SELECT building_id FROM views GROUP BY building_id HAVING bool_and(blurry)),
      (SELECT unnest(['building_type', 'surface_material', 'gem_material', 'gem_llrs', 'floors', 'construction_year']) AS a)""",
    ("views",),
)
def x3(spark: SparkSession, d: str) -> DataFrame:
    return fusion.abstain_all(views.only_flagged(r.views(spark, d)), cards.ATTRIBUTES, F.lit("only flagged views")).select("building_id", "attribute", "abstained")
