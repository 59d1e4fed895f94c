"""Operators against hand-computed values and brute force."""

import json
import math
import random
import uuid
from pathlib import Path

import pyarrow.parquet as pq
import numpy as np
import pytest
from pyspark.sql import functions as F

from streetweave.functions import fields, geo
from streetweave.operators import captures, cards, corrections, fusion, logs, mask_edits, masks, polygons, ranks, scoring, spatial, sweep, views, walls
from streetweave.sources import documents, maps, sinks
from streetweave.sources.landing import landing, shared_dir
from streetweave.streaming import logs as streams


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_numeric_fusion_is_a_weighted_median(spark):
    rows = spark.createDataFrame([("b", 4.0, 1.0, 1), ("b", 5.0, 1.0, 2), ("b", 30.0, 0.2, 3), ("b", None, 1.0, 4), ("b", float("nan"), 1.0, 5)], "g string, value double, weight double, id int")
    got = one(fusion.fuse_numeric(rows, ["g"], ["id"]))
    assert (got["value"], got["spread"], got["views"]) == (5.0, 1.0, 3)


def test_categorical_fusion_and_abstention(spark):
    rows = [("b", 1, "house", 1.0, 3.0), ("b", 2, "office", 1.0, 1.0), ("c", 1, "castle", 1.0, 1.0), ("d", 1, "house", 1.0, 1.0), ("d", 2, "office", 1.0, 1.0), ("d", 3, "retail", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v int, class string, score double, weight double")
    got = {r.g: r for r in fusion.fuse_categorical(df, ["g"], ["v"], cards.BUILDING_TYPES).collect()}
    assert (got["b"].top, got["b"].share, got["b"].abstained) == ("house", 0.75, False)
    assert got["c"].abstained and got["c"].reason == "views named no known class"
    assert got["d"].abstained and got["d"].top == "house"


def test_categorical_scores(spark):
    df = spark.createDataFrame([("x", "a", "a"), ("x", "a", "b"), ("x", "b", None), ("x", "b", "b")], "g string, truth string, predicted string")
    got = one(scoring.categorical_scores(df, ["g"]))
    assert (got.n, got.answered, got.coverage, got.accuracy) == (4, 3, 0.75, 0.6667)


def test_common_subset_leaves_out_a_run_that_rarely_answers(spark):
    rows = [("bold", b, True) for b in range(4)] + [("careful", b, b < 2) for b in range(4)] + [("rare", b, b == 3) for b in range(4)]
    df = spark.createDataFrame(rows, "run string, b int, said boolean")
    assert sorted(r.b for r in scoring.common_subset(df, "b", "run", "said").collect()) == [0, 1]


def test_mask_rule_evaluation(spark):
    labels = spark.createDataFrame([("1", "a", "bad"), ("2", "a", "bad"), ("3", "a", "good"), ("4", "a", "bad")], "image_id string, building_id string, label string")
    scored = spark.createDataFrame([("1", "a", False), ("2", "a", True), ("3", "a", False)], "image_id string, building_id string, ok boolean")
    got = one(scoring.evaluate_flags(labels, scored))
    assert (got.recall, got.false_alarms, got.unscored) == (0.5, 1.0, 1)


def test_answers_take_the_last_object_that_parses(spark):
    texts = [
        'so {"floors": 2} and {"floors": "4", "building_type": "Semi Detached", "observations": "a\nb  c"}',
        '{"building_type": "APARTMENTS", "floors": -3} {broken',
        "no object",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in fusion.parse_answers(df, {"building_type": cards.BUILDING_TYPES}).collect()}
    assert (got[0].floors, got[0].building_type, got[0].observations) == (4.0, None, "a b c")
    assert (got[1].floors, got[1].building_type) == (None, "apartments")
    assert got[2].floors is None


def test_visible_reasoning(spark):
    df = spark.createDataFrame([("  x <think>y\nz</think> w\n{\"a\": 1}",), ('{"a": 1} tail',), ("open <think>never",)], "t string")
    assert [r[0] for r in df.select(fusion.visible_reasoning(F.col("t"))).collect()] == ["x  w", "", "open"]


def test_heights_of_tags(spark):
    tags = ["12", "12,5 m", "10 ft", "tall", "-3", "501", None, ".5m"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    got = [r[0] for r in df.select(fields.parse_height(F.col("t"))).collect()]
    assert got[:2] == [12.0, 12.5] and got[2] == pytest.approx(3.048) and got[3:7] == [None] * 4 and got[7] == 0.5


def test_taxonomy_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.4,)], "f double")
    assert [r[0] for r in df.select(cards.taxonomy_string(F.lit("CR"), F.lit(None), F.col("f"))).collect()] == ["CR/L99/HEX:2", "CR/L99/HEX:4", "CR/L99/H99"]


def test_review_beats_tag_beats_newest_model(spark):
    rows = [
        ("b", "m", "human-review", None, None, None, True, 1), ("b", "m", "osm-tag-prior", "CR", 1.0, None, False, 2), ("c", "m", "vlm:a", "CR", 0.6, None, False, 1), ("c", "m", "vlm:b", "W", 0.9, None, False, 2),
        ("d", "m", "osm-tag-prior", None, None, None, True, 9), ("d", "m", "vlm:a", "S", 0.5, None, False, 1),
    ]
    df = spark.createDataFrame(rows, "building_id string, attribute string, provider string, top string, share double, value double, abstained boolean, modified long")
    got = {r.building_id: r.provider for r in cards.preferred_values(df).collect()}
    assert got == {"b": "human-review", "c": "vlm:b", "d": "vlm:a"}


def test_select_panoramas(spark):
    rows = [("way/1", "a", 30.0, 10.0), ("way/1", "b", 25.0, 12.0), ("way/1", "c", 5.0, 9.0), ("way/2", "d", 40.0, 20.0), ("way/3", "e", 130.0, 5.0), ("way/3", "f", 20.0, 60.0)]
    df = spark.createDataFrame(rows, "building_id string, image_id string, aov_deg double, distance_m double")
    assert {r.image_id for r in spatial.select_panoramas(df).collect()} == {"a", "b", "d"}


def test_tiles_go_back_and_forth(spark):
    lat0, lon0 = 39.47, -0.38
    step_lat, step_lon = 250 / 110_574.0, 250 / (111_320.0 * math.cos(math.radians(lat0)))
    rows = [(lat0 + (r + 0.5 * (r + c > 0)) * step_lat, lon0 + (c + 0.5 * (r + c > 0)) * step_lon) for r in range(2) for c in range(3)]
    got = spatial.plan_tiles(spark.createDataFrame(rows + [(None, None)], "lat double, lon double")).orderBy("turn", "place").collect()
    assert [f"{r['row']}{r['col']}" for r in got] == ["00", "01", "02", "12", "11", "10"]


def test_independent_views_prefer_the_first_largest_set(spark):
    m = 1 / 111_195.0
    rows = [("b", str(i), 39.0 + 2.0 * i * m, 0.0) for i in range(3)]
    kept = captures.independent_views(spark.createDataFrame(rows, "building_id string, image_id string, lat double, lon double"), landing(spark, "t"))
    assert {r.image_id for r in kept.collect()} == {"0", "2"}


def test_views_of_other_buildings_at_the_same_place_are_no_candidates(spark):
    m, landed = 1 / 111_195.0, []
    rows = [(f"b{k}", str(k), 39.0, 0.0) for k in range(50)] + [("b0", "n", 39.0 + 2 * m, 0.0), ("b1", "n", 39.0 + 2 * m, 9.0)]

    def land(df):
        landed.append(landing(spark, "t")(df))
        return landed[-1]

    kept = captures.independent_views(spark.createDataFrame(rows, "building_id string, image_id string, lat double, lon double"), land).collect()
    assert {(r.building_id, r.image_id) for r in kept} == {(b, i) for b, i, *_ in rows} - {("b0", "n")}
    # b0's two are near, b1's two as near by latitude; no other position is kept
    assert landed[0].where("p IS NOT NULL").count() == 4


def test_a_mean_half_way_goes_up_in_any_order(spark):
    # 0.38749.. in this order of addition
    shares = [0.3, 0.3, 0.7, 0.5, 0.0, 0.0, 0.6, 0.7]
    assert sum(shares) / 8 < 0.3875
    seen = spark.createDataFrame([("b", str(k), "s", 10, c) for k, c in enumerate(shares)], "building_id string, image_id string, source string, pixels long, coverage double")
    places = spark.createDataFrame([(str(k), 39.0 + k, 0.0) for k in range(8)] + [("0", 39.0, 0.0)], "image_id string, lat double, lon double")
    r = one(captures.fuse_nearby(seen, places, landing(spark, "t")))
    assert (r.confidence, r.views, r.independent_ids) == (0.388, 8, [str(k) for k in range(8)])


def test_rows_of_buildings_need_one_exchange(spark):
    from streetweave.plans.catalogue import QUERIES

    plan = QUERIES["A2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["A16", "A17", "U2"])
def test_answers_of_runs_are_read_from_the_line_items_once(spark, name):
    from streetweave.plans.catalogue import QUERIES

    assert not [f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def first_largest(points, least):
    """By trying every point in and out, with the rest of the order as it is."""
    apart = [[haversine(a, b) >= least for b in points] for a in points]

    def best(free):
        if not free:
            return ()
        i, rest = free[0], free[1:]
        taken = (i, *best(tuple(j for j in rest if apart[i][j])))
        if all(apart[i][j] for j in rest):
            return taken
        without = best(rest)
        return taken if len(taken) >= len(without) else without

    return best(tuple(range(len(points))))


def test_independent_views_are_the_largest_at_any_number(spark):
    m, rng = 1 / 111_195.0, random.Random(21)
    crowd = [(39.0 + rng.uniform(0, 16) * m, rng.uniform(0, 16) * m) for _ in range(30)]
    street = [(39.0 + rng.uniform(0, 260) * m, 0.0) for _ in range(200)]
    rows = [("crowd", f"{k:03d}", *p) for k, p in enumerate(crowd)] + [("street", f"{k:03d}", *p) for k, p in enumerate(street)] + [("none", "1", None, None), ("one", "1", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "building_id string, image_id string, lat double, lon double")
    got = {}
    for r in captures.independent_views(df, landing(spark, "t")).collect():
        got.setdefault(r.building_id, []).append(int(r.image_id))
    assert sorted(got["crowd"]) == list(first_largest(crowd, 3.0)) and got["one"] == [1] and "none" not in got
    # on a line the largest number is that of going along and taking each that is far enough
    n, last = 0, -1e9
    for lat, _ in sorted(street):
        if (lat - last) / m >= 3.0 * 111_195.0 / 111_195.08:
            n, last = n + 1, lat
    chosen = [street[k] for k in got["street"]]
    assert len(chosen) == n and all(haversine(a, b) >= 3.0 for k, a in enumerate(chosen) for b in chosen[:k])


def test_a_radius_join_whose_pairs_are_sorted_takes_tasks_by_its_pairs(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(str(k), 40.0 + rng.uniform(0, 0.01), rng.uniform(0, 0.01)) for k in range(3000)] + [("no", None, None)], "image_id string, lat double, lon double")
    pairs = spatial.radius_join(points, points, 60.0, ["image_id"], ["image_id"]).count()
    assert 0.7 * pairs < spatial.pair_tasks(points, points, 60.0, 1) < 1.4 * pairs
    assert spatial.pair_tasks(points.where("lat > 50"), points, 60.0) == spark.sparkContext.defaultParallelism
    assert spatial.radius_join(points, points, 60.0, ["image_id"], ["image_id"], tasks=77).count() == pairs
    for found in (spatial.nearby(points), spatial.nearest_capture(points.withColumnRenamed("image_id", "point_id"), points, 60.0)):
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lat0", [0.0, 40.0, 60.0, -89.3])
def test_radius_join_equals_all_pairs(spark, lat0):
    rng = random.Random(int(lat0) + 7)
    points = [(str(i), lat0 + rng.uniform(-0.002, 0.002), 179.0 + rng.uniform(-0.004, 0.004)) for i in range(200)]
    df = spark.createDataFrame(points, "image_id string, lat double, lon double")
    got = {(r.image_id, r.b_image_id) for r in spatial.radius_join(df, df, 45.0, ["image_id"], ["image_id"]).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if haversine(a[1:], b[1:]) <= 45.0}


def test_radius_joins_are_not_broadcast(spark):
    rows = [(str(i), 39.0 + i * 1e-5, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "image_id string, lat double, lon double")
    best = spatial.nearest_capture(df.withColumnRenamed("image_id", "point_id"), df, 30.0)
    assert {(r.point_id, r.image_id) for r in best.collect()} == {(i, i) for i, _, _ in rows}
    assert "Broadcast" not in best._jdf.queryExecution().toString()


def test_the_nearest_capture_is_found_however_far_it_is(spark):
    rng = random.Random(9)
    near = [(f"c{k:03d}", 39.0 + rng.uniform(0, 0.02), rng.uniform(0, 0.02)) for k in range(150)]
    odd = [("tie2", 60.0, 100.0002), ("tie1", 60.0, 99.9998), ("pole", 89.99, -120.0), ("date", -17.0, 179.999), ("none", None, 1.0)]
    wanted = [(f"p{k:03d}", 39.0 + rng.uniform(-0.05, 0.07), rng.uniform(-0.05, 0.07)) for k in range(60)] + [(f"q{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)]
    wanted += [("tie", 60.0, 100.0), ("over the pole", 89.9, 60.0), ("over the date line", -17.0, -179.9)]
    known = near + odd[:-1]
    points = spark.createDataFrame([*wanted, ("nowhere", None, None)], "point_id string, lat double, lon double")
    df = spark.createDataFrame(near + odd, "image_id string, lat double, lon double")
    got = {r.point_id: (r.image_id, round(r.distance_m, 5)) for r in spatial.nearest_capture(points, df, 60.0, landing(spark, "nearest")).collect()}
    want = {p[0]: min((round(haversine(p[1:], c[1:]), 5), c[0]) for c in known)[::-1] for p in wanted}
    assert got == want and want["tie"][0] == "tie1" and want["over the pole"][0] == "pole" and want["over the date line"][0] == "date"
    assert spatial.nearest_capture(points, df.where("lat > 95"), 60.0).count() == 0


def test_thinning_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    points = [(f"{i:03d}", rng.choice([None, rng.randrange(50)]), 39.0 + rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for i in range(400)]
    df = spark.createDataFrame(points, "image_id string, captured_at_ms long, lat double, lon double").repartition(5)
    kept = []
    for p in sorted(points, key=lambda p: (p[1] or 0, p[0])):
        if all(haversine(p[2:], q[2:]) >= 30.0 for q in kept):
            kept.append(p)
    assert {r.image_id for r in spatial.thin_captures(df, 30.0, landing(spark, "t")).collect()} == {p[0] for p in kept}


def test_thinning_beside_kept_captures_looks_for_rivals_of_new_ones_only(spark):
    rng, landed = random.Random(4), []
    points = [(f"{i:03d}", rng.choice([None, -5, rng.randrange(50)]), 39.0 + rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for i in range(300)]
    old = [(f"k{i}", 39.0 + 0.0008 * i, 0.0008 * i) for i in range(5)]
    kept = []
    for p in sorted(points, key=lambda p: (p[1] or 0, p[0])):
        if all(haversine(p[2:], q[-2:]) >= 30.0 for q in old + kept):
            kept.append(p)

    def land(df):
        landed.append(landing(spark, "t")(df))
        return landed[-1]

    df = spark.createDataFrame(points, "image_id string, captured_at_ms long, lat double, lon double").repartition(5)
    out = spatial.far_captures(df, spark.createDataFrame(old, "image_id string, lat double, lon double"), 30.0, land)
    assert sorted(r.image_id for r in out.collect()) == sorted(p[0] for p in kept)
    place, before = {p[0]: p[-2:] for p in points + old}, {p[0]: (p[1] or 0, p[0]) for p in points} | {o[0]: (-math.inf,) for o in old}
    want = sorted((a[0], b[0]) for a in points for b in points + old if before[b[0]] < before[a[0]] and haversine(place[a[0]], place[b[0]]) < 30.0)
    assert sorted((r.image_id, r.rival) for r in landed[0].collect()) == want


def test_a_batch_of_thinned_captures_is_read_by_many_tasks(spark, tmp_path):
    """T6: each of the three batches has files of its own from all tasks; together they thin like the sequential rule."""
    from streetweave.plans import registry
    from streetweave.plans.catalogue import QUERIES

    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    shared, before = Path(shared_dir(spark)), spark.conf.get("spark.sql.files.openCostInBytes")
    there = set(shared.iterdir())
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = sorted(r.image_id for r in QUERIES["T6"](spark, str(tmp_path)).collect())
        want = sorted(r.image_id for r in spatial.thin_captures(registry.captures(spark, str(tmp_path)), 10.0, landing(spark, "t")).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got == want and len(got) > 100
    new = set(shared.iterdir()) - there
    assert len([f for d in new if d.name.startswith("capture-stream-") for f in d.glob("*.parquet")]) == 12
    assert len([f for d in new if d.name.endswith("-checkpoint") for f in d.glob("commits/[0-9]*")]) == 3


def test_nearest_by_bearing(spark):
    rows = [("a", "x", 5.0, 0.0), ("a", "y", 6.0, 5.0), ("a", "z", 7.0, 355.0), ("a", "w", 8.0, 90.0)]
    got = spatial.nearest_by_bearing(spark.createDataFrame(rows, "image_id string, other_id string, distance_m double, bearing double"))
    assert {r.other_id for r in got.collect()} == {"x", "w"}


def test_islands_over_the_seam(spark):
    df = spark.createDataFrame([("i", c) for c in [*range(340, 360), *range(0, 20), *range(100, 110)]], "g string, c int")
    got = sorted((r.start, r.end, r.n) for r in masks.islands(df, ["g"], "c", circular=360).collect())
    assert got == [(100, 109, 10), (340, 19, 40)]
    whole = masks.islands(spark.createDataFrame([("i", c) for c in range(8)], "g string, c int"), ["g"], "c", circular=8).collect()
    assert [(r.start, r.end, r.n) for r in whole] == [(0, 7, 8)]


def test_absorb_runs_gives_slivers_to_the_wider_neighbour(spark):
    df = spark.createDataFrame([("i", 0, 10, 1), ("i", 10, 2, 2), ("i", 12, 5, 3), ("i", 17, 1, 1)], "g string, start int, n int, value int")
    got = sorted((r.start, r.n, r.value) for r in masks.absorb_runs(df, ["g"], 3).collect())
    assert got == [(0, 12, 1), (12, 6, 3)]


def test_groups_of_a_batch_absorb_their_runs_each_alone(spark):
    """Also a single run, and groups that are wide enough; and no group is a Python call of its own."""
    rng, rows, want = random.Random(3), [], set()
    for g in range(60):
        lengths = [5 + g % 3] if g < 5 else [rng.randrange(1, 7) + (6 if g < 10 else 0) for _ in range(rng.randrange(2, 12))]
        runs = [[sum(lengths[:k]), n, k % 4] for k, n in enumerate(lengths)]
        rows += [(str(g), *r) for r in runs]
        while len(runs) > 1 and min(r[1] for r in runs) < 4:
            k = min(range(len(runs)), key=lambda i: runs[i][1])
            into = runs[max([i for i in (k - 1, k + 1) if 0 <= i < len(runs)], key=lambda i: runs[i][1])]
            into[0], into[1] = min(into[0], runs[k][0]), into[1] + runs[k][1]
            del runs[k]
        want |= {(str(g), *r) for r in runs}
    got = masks.absorb_runs(spark.createDataFrame(rows, "g string, start int, n int, value int"), ["g"], 4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_labels_are_carried_up_without_gaps(spark):
    rows = [("i", 5, 0, 7, True), ("i", 4, 0, 0, True), ("i", 3, 0, 0, True), ("i", 2, 0, 0, False), ("i", 1, 0, 0, True)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, label int, building boolean").withColumn("owner", F.lit(0))
    got = {r["row"]: r.label for r in masks.carry_up(df).collect()}
    assert got == {5: 7, 4: 7, 3: 7, 2: 0, 1: 0}


def test_connected_masks_and_small_pieces(spark):
    land = landing(spark, "t")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("d", "f")], "u string, v string")
    assert {(r.node, r.root) for r in masks.connected(edges, land).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d")}
    cells = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (5, 5)]
    df = spark.createDataFrame([("i", r, c) for r, c in cells], "image_id string, row int, col int").select("*", F.lit(0).alias("instance"), F.lit(1).alias("label"), F.lit(True).alias("building"))
    got = {(r["row"], r["col"]) for r in mask_edits.clean_fallback(df, 3, land).where("NOT building").collect()}
    assert got == {(5, 5)}


def test_revisions_supersede_revert_and_go_stale(spark):
    events = [("way/1", 1, "accepted"), ("way/1", 2, "accepted"), ("way/1", 3, "proposed"), ("way/2", 1, "rejected")]
    df = spark.createDataFrame([(o, n, "geometry", 4, n, d) for o, n, d in events], "osm_id string, revision int, kind string, base_version int, seq int, decision string")
    folded = corrections.fold_revisions(df)
    assert {(r.osm_id, r.revision): r.status for r in folded.collect()} == {("way/1", 1): "superseded", ("way/1", 2): "accepted", ("way/1", 3): "proposed", ("way/2", 1): "rejected"}
    active = corrections.active_revision(folded)
    feet = spark.createDataFrame([("way/1", 4), ("way/2", 1)], "building_id string, osm_version int")
    assert {r.building_id: r.state for r in corrections.apply_corrections(feet, active).collect()} == {"way/1": "applied", "way/2": "none"}
    newer = feet.withColumn("osm_version", F.lit(5))
    assert {r.building_id: r.state for r in corrections.apply_corrections(newer, active).collect()} == {"way/1": "stale", "way/2": "none"}


def test_a_wall_across_the_street(spark):
    """One square ahead, one behind it: the first hides the second."""

    def square(x, y, h):
        return [[[[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]]]

    df = spark.createDataFrame([("i", "near", square(0.0, 16.0, 5.0)), ("i", "far", square(0.0, 40.0, 5.0)), ("i", "side", square(30.0, 0.0, 4.0))], "image_id string, building_id string, geometry array<array<array<array<double>>>>")
    seen = {r.building_id: r for r in walls.visibility(walls.facade_bearings(walls.visible_facades(walls.edges(df, ["image_id", "building_id"])))).collect()}
    assert set(seen) == {"near", "side"}
    assert seen["near"].distance_m == 11.0 and seen["near"].aov_deg == pytest.approx(2 * math.degrees(math.atan(5 / 11)), abs=0.1)
    depth = walls.wall_zbuffer(walls.edges(df, ["image_id", "building_id"]).withColumn("top_m", F.lit(10.0)), 36, 18)
    assert {r.owner for r in depth.where("col IN (0, 35)").collect()} == {"near"}


def test_the_wall_zbuffer_keeps_to_its_scenes_and_equals_brute_force(spark):
    width, height, camera = 40, 20, 1.7
    rng = random.Random(13)
    rows = [(f"i{k}", f"b{j}", *[rng.uniform(-25, 25) for _ in range(4)], rng.uniform(1, 14)) for k in range(30) for j in range(6)]
    rows += [("tie", "b", 5.0, 7.0, -5.0, 7.0, 9.0), ("tie", "a", 5.0, 7.0, -5.0, 7.0, 6.0), ("through", "b", -3.0, 0.0, 3.0, 0.0, 9.0), ("off", "b", None, 1.0, 2.0, 3.0, 4.0)]
    want = {}
    for image, building, x1, y1, x2, y2, top_m in rows[:-1]:
        for col in range(width):
            a = math.radians((col + 0.5) * 360 / width)
            u, v = math.sin(a), math.cos(a)
            cross = u * (y2 - y1) - v * (x2 - x1)
            t, s = (x1 * (y2 - y1) - y1 * (x2 - x1)) / cross, (x1 * v - y1 * u) / cross
            if t > 0.25 and 0 <= s <= 1:
                first, last = (math.floor((0.5 - math.atan2(h, t) / math.pi) * height) for h in (top_m - camera, -camera))
                for row in range(max(0, first), min(height - 1, last) + 1):
                    want[image, row, col] = min(want.get((image, row, col), (math.inf, "")), (round(t, 9), building))
    facades = spark.createDataFrame(rows, "image_id string, building_id string, x1 double, y1 double, x2 double, y2 double, top_m double")
    together = facades.coalesce(1)
    for depth in (walls.wall_zbuffer(facades.repartition(7), width, height), walls.wall_zbuffer(together, width, height, together=True)):
        got = {(r.image_id, r.row, r.col): (round(r.depth, 9), r.owner) for r in depth.collect()}
        assert got == want
    assert any(owner == "b" for (image, _, _), (_, owner) in want.items() if image == "tie") and "Exchange" not in depth._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_the_only_exchange_of_the_wall_zbuffer(spark):
    from streetweave.plans.catalogue import QUERIES

    assert QUERIES["G6"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_visibility_index_of_a_camera(spark):
    """The scene above in degrees: a hidden house is near but not seen, one far away is neither."""
    m = 1 / 111_195.08

    def house(name, east, north, half):
        y, x = 39.0 + north * m, east * m / math.cos(math.radians(39.0))
        dy, dx = half * m, half * m / math.cos(math.radians(39.0))
        return (name, y, x, [[[[x - dx, y - dy], [x + dx, y - dy], [x + dx, y + dy], [x - dx, y + dy], [x - dx, y - dy]]]])

    rows = [house("near", 0.0, 16.0, 5.0), house("far", 0.0, 40.0, 5.0), house("side", 30.0, 0.0, 4.0), house("away", 400.0, 0.0, 4.0)]
    footprints = spark.createDataFrame(rows, "building_id string, lat double, lon double, geometry array<array<array<array<double>>>>")
    odd = [("j", None, None, 1.0), ("k", 39.0, 200.0, 1.0), ("l", 39.0, 0.0, float("nan")), (None, 39.0, 0.0, 1.0)]
    cameras = spark.createDataFrame([("i", 39.0, 0.0, None), *odd], "image_id string, lat double, lon double, heading double")
    seen, nearby, skipped = walls.visibility_index(cameras, footprints, 20.0)
    got = {(r.image_id, r.building_id): r for r in seen.collect()}
    assert set(got) == {("i", "near"), ("i", "side")}
    assert got["i", "near"].distance_m == pytest.approx(11.0, abs=0.1) and got["i", "near"].aov_deg == pytest.approx(2 * math.degrees(math.atan(5 / 11)), abs=0.5)
    assert {(r.building_id, r.captures) for r in nearby.collect()} == {("near", 1), ("far", 1), ("side", 1)}
    assert {(r.image_id, r.reason) for r in skipped.collect()} == {("j", "no_position"), ("k", "bad_position"), ("l", "bad_heading"), (None, "no_id")}


def test_a_visibility_index_exchanges_no_pairs_and_broadcasts_nothing(spark):
    """Equal to walls made for each pair of camera and footprint; cameras lie on all sides of the cells' borders."""
    rng = random.Random(11)
    d = 1e-5

    def square(lat, lon, half):
        return [[[[lon + half * x, lat + half * y] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]]

    places = [(f"way/{k}", 39.47 + rng.uniform(0, 900) * d, -0.38 + rng.uniform(0, 900) * d, rng.randint(3, 10) * d) for k in range(150)]
    footprints = spark.createDataFrame([(n, y, x, square(y, x, h)) for n, y, x, h in places], "building_id string, lat double, lon double, geometry array<array<array<array<double>>>>")
    cameras = spark.createDataFrame([(f"i{k}", 39.47 + rng.uniform(0, 900) * d, -0.38 + rng.uniform(0, 900) * d) for k in range(120)], "image_id string, lat double, lon double")
    seen, nearby, _ = walls.visibility_index(cameras, footprints, 20.0)
    pairs = walls.near_footprints(cameras, footprints, 20.0)
    e = pairs.join(cameras, "image_id").join(walls.edges(footprints, ["building_id"]), "building_id")
    a, b = (geo.local_metres(F.col("lat"), F.col("lon"), F.col(f"y{k}"), F.col(f"x{k}")) for k in (1, 2))
    e = e.select("image_id", *sweep.EDGE, a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    want = walls.visibility(walls.facade_bearings(walls.visible_facades(e)))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, want.select(seen.columns).collect()))
    assert sorted(map(tuple, nearby.collect())) == sorted(map(tuple, pairs.groupBy("building_id").count().collect()))
    for part in (seen, nearby):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan


def test_attached_walls_are_no_facades(spark):
    def box(x):
        return [[[[x, 10.0], [x + 10, 10.0], [x + 10, 20.0], [x, 20.0], [x, 10.0]]]]

    df = spark.createDataFrame([("i", "a", box(0.0)), ("i", "b", box(10.0))], "image_id string, building_id string, geometry array<array<array<array<double>>>>")
    kept = {(r.building_id, r.edge_no) for r in walls.unshared_walls(walls.edges(df, ["image_id", "building_id"])).collect()}
    assert ("a", 1) not in kept and ("b", 3) not in kept and len(kept) == 6


def test_holes_are_outside(spark):
    ring = lambda h: [[x * h, y * h] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    feet = spark.createDataFrame([("way/1", 0.0, 0.0, [[ring(0.001), ring(0.0005)]])], "building_id string, lat double, lon double, geometry array<array<array<array<double>>>>")
    points = spark.createDataFrame([("in", 0.0007, 0.0001), ("hole", 0.0001, 0.0001), ("out", 0.002, 0.0)], "point_id string, lat double, lon double")
    assert {r.point_id for r in walls.inside_footprint(points, feet, 400.0).collect()} == {"in"}


def test_mutual_best_overlap(spark):
    box = lambda w, s, e, n: [[[[w, s], [e, s], [e, n], [w, n], [w, s]]]]
    schema = "id string, geometry array<array<array<array<double>>>>"
    a = spark.createDataFrame([("a", box(0.0, 0.0, 10.0, 10.0)), ("b", box(20.0, 0.0, 30.0, 10.0)), ("c", box(50.0, 0.0, 60.0, 10.0))], schema)
    b = spark.createDataFrame([("x", box(0.5, 0.0, 10.5, 10.0)), ("y", box(20.0, 0.0, 30.0, 5.0)), ("z", box(58.0, 0.0, 68.0, 10.0))], schema)
    got = {(r.a_id, r.b_id): round(r.iou, 4) for r in walls.mutual_best(polygons.polygon_overlaps(a, b)).collect()}
    assert got == {("a", "x"): 0.9048, ("b", "y"): 0.5}


def test_local_frame_agrees_with_the_sphere_nearby(spark):
    df = spark.createDataFrame([(39.47, -0.38, 39.4709, -0.3791)], "a double, b double, c double, d double")
    east, north = geo.local_metres(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    row = one(df.select(east.alias("e"), north.alias("n")))
    assert math.hypot(row.e, row.n) == pytest.approx(haversine((39.47, -0.38), (39.4709, -0.3791)), rel=0.005)


def test_degenerate_geometry_is_dropped(spark):
    nan = float("nan")
    polygons = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]], [[[0.0, nan], [1.0, 0.0], [1.0, 1.0]]], [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    df = spark.createDataFrame([(polygons,)], "g array<array<array<array<double>>>>")
    got = one(df.select(geo.normal_polygons(F.col("g")).alias("g"))).g
    assert [len(p[0]) for p in got] == [4, 4]


def test_validation_names_what_is_wrong(spark):
    rows = [("1", "way/1", 100, 10, 10, 0.5), ("", "way/1", 100, 10, 10, 0.5), ("1", "x", None, 0, 10, 1.5), ("1", "way/1", 101, 10, 10, 0.5)]
    df = spark.createDataFrame(rows, "image_id string, building_id string, pixels long, width int, height int, coverage double")
    good, bad = views.validate_views(df)
    assert good.count() == 1 and sorted(tuple(r.issues) for r in bad.collect()) == [("bad_pixels",), ("no_building", "bad_size", "bad_pixels", "bad_coverage"), ("no_image",)]


def test_reviews_and_retries(spark):
    events = [("b", "review", "m", "CR", 1), ("b", "withdraw", None, None, 2), ("b", "review", "f", "3", 3), ("b", "review", "f", "4", 4)]
    df = spark.createDataFrame(events, "building_id string, action string, attribute string, value string, seq int")
    assert [(r.attribute, r.value) for r in logs.fold_reviews(df).collect()] == [("f", "4")]
    log = spark.createDataFrame([("s", "i", "failed", n) for n in range(7)] + [("s", "j", "failed", 8), ("s", "k", "failed", 9), ("s", "k", "done", 10)], "stage string, image string, status string, seq int")
    assert [(r.image, r.attempts) for r in logs.retry_candidates(log).collect()] == [("j", 1)]


def test_torn_logs_manifests_and_files(spark, tmp_path):
    (tmp_path / "ds").mkdir()
    good = json.dumps({"image": "1", "stage": "a", "status": "done"})
    (tmp_path / "log.jsonl").write_text(good + "\nnot json\n" + good[:9])
    assert documents.read_ledger(spark, str(tmp_path / "log.jsonl")).count() == 1
    manifest = {"images": [{"id": "7", "selected_geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}, {"no": "id"}]}
    (tmp_path / "ds" / "manifest.json").write_text(json.dumps(manifest))
    row = one(documents.read_captures(spark, str(tmp_path / "*" / "manifest.json")))
    assert (row.dataset, row.image_id, row.lon, row.lat) == ("ds", "7", 1.5, 2.5)
    files = documents.file_inventory(spark, str(tmp_path))
    assert sorted(r.size for r in files.collect()) == sorted([len(good) + len("\nnot json\n") + 9, len(json.dumps(manifest))])


def test_relations_with_holes_take_their_ways(spark):
    def line(*points):
        return [{"lon": float(x), "lat": float(y)} for x, y in points]

    square = line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    hole = line((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    relation = [{"type": "way", "ref": 1, "role": "outer", "geometry": square[:3]}, {"type": "way", "ref": 2, "role": "outer", "geometry": square[:1:-1]}, {"type": "way", "ref": 3, "role": "inner", "geometry": hole}]
    cut = [{"type": "way", "ref": 9, "role": "outer", "geometry": square[:3]}]
    rows = [
        ("way", 1, {"building": "yes"}, 1, "t", square, None), ("way", 9, {"building": "yes"}, 1, "t", square, None), ("way", 8, {"building": "no"}, 1, "t", square, None),
        ("relation", 5, {"building": "yes"}, 1, "t", None, relation), ("relation", 6, {"building": "yes"}, 1, "t", None, cut),
    ]
    got = {r.building_id: r.geometry for r in maps.read_footprints(spark.createDataFrame(rows, maps.ELEMENTS)).collect()}
    assert set(got) == {"way/9", "relation/5"} and len(got["relation/5"][0]) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("way/1", ["a", "b"], [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]])], "building_id string, flags array<string>, geometry array<array<array<array<double>>>>")
    sinks.write_csv(df, ["building_id", "flags"], str(tmp_path / "csv"))
    assert one(spark.read.csv(str(tmp_path / "csv"), header=True)).flags == "a;b"
    sinks.write_geojson(df.withColumn("geometry", sinks.polygon_geometry(F.col("geometry"))), "building_id", "geometry", str(tmp_path / "gj"))
    assert json.loads(one(spark.read.text(str(tmp_path / "gj"))).value)["geometry"]["type"] == "MultiPolygon"
    sinks.write_geoparquet(df, "geometry", str(tmp_path / "gp"))
    raw = one(spark.read.parquet(str(tmp_path / "gp"))).geometry
    assert raw[:9] == bytes([1, 6, 0, 0, 0, 1, 0, 0, 0]) and len(raw) == 9 + 9 + 4 + 64
    parts = [f for f in (tmp_path / "gp").iterdir() if f.suffix == ".parquet"]
    assert parts and all(json.loads(pq.read_schema(f).metadata[b"geo"])["primary_column"] == "geometry" for f in parts)


def test_geoparquet_leaves_nothing_of_the_table_before(spark, tmp_path):
    path = str(tmp_path / "gp")
    shape = "array<array<array<array<double>>>>"
    rows = lambda first, n: spark.createDataFrame([(f"way/{first + k}", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]) for k in range(n)], f"building_id string, geometry {shape}")
    sinks.write_geoparquet(rows(0, 80).repartition(8), "geometry", path)
    assert spark.read.parquet(path).count() == 80
    (tmp_path / "gp" / "_part-00003-lost-7.parquet").write_bytes(b"a draft of an attempt that was lost")
    sinks.write_geoparquet(rows(500, 20).repartition(2), "geometry", "file:" + path)
    assert {r.building_id for r in spark.read.parquet(path).collect()} == {f"way/{500 + k}" for k in range(20)}
    assert len(list((tmp_path / "gp").glob("*.parquet"))) == 2
    sinks.write_geoparquet(rows(0, 0), "geometry", path)
    assert spark.read.parquet(path).columns == ["building_id", "geometry"] and spark.read.parquet(path).count() == 0


def test_ranks_of_large_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("a", "a", "a", None, "b")), rng.randrange(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = {(r.g, r.k): r.rn for r in ranks.ranked(df, ["g"], [F.desc("v"), F.col("k")], landing(spark, "t")).collect()}
    want = {}
    for g in ("a", "b", None):
        for n, (v, k) in enumerate(sorted((-v, k) for x, v, k in rows if x == g), 1):
            want[g, k] = n
    assert got == want


def test_overlaps_of_masks_equal_all_pairs_in_one_exchange(spark):
    """Masks of three views, a pixel that comes twice, pixels without a place, and an image without overlaps."""
    rng = random.Random(6)
    rows = [(i, v, rng.randrange(1, 4), rng.randrange(4), rng.randrange(5)) for i in ("a", "b") for v in (1, 2, 3) for _ in range(40)]
    rows += [("a", 1, 1, None, 2), ("a", 2, 1, None, 2), ("b", 1, 2, 3, None), ("c", 1, 1, 0, 0), rows[0]]
    n, both = {}, {}
    for x in rows:
        n[x[:3]] = n.get(x[:3], 0) + 1
        for y in rows:
            if x[0] == y[0] and x[3:] == y[3:] and None not in x[3:] and x[1] < y[1]:
                both[x[:3], y[:3]] = both.get((x[:3], y[:3]), 0) + 1
    name = lambda m: "/".join(map(str, m))
    want = [(name(u), name(v), c, round(c / (n[u] + n[v] - c), 6)) for (u, v), c in both.items() if min(n[u], n[v]) >= 8 and c / (n[u] + n[v] - c) >= 0.2]
    out = masks.instance_overlaps(spark.createDataFrame(rows, "image_id string, view int, mask int, row int, col int").repartition(3), 8, 0.2)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and 3 < len(want) < len(both)
    pixels = spark.createDataFrame([("a", [(1, 1), (2, 5)]), ("a", [(1, 1)]), ("a", [])], "image_id string, masks array<struct<view: int, mask: int>>").repartition("image_id")
    met = masks.pixel_overlaps(pixels, 1, 0.1)
    assert [tuple(r) for r in met.collect()] == [("a/1/1", "a/2/5", 1, 0.5)]
    assert met._jdf.queryExecution().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_edges_of_components_are_made_once(spark):
    """J19, A7's views, G8: what makes the edges is long work."""
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x")], "u string, v string").mapInArrow(count, "u string, v string")
    roots = masks.connected(edges, landing(spark, "t"))
    assert {(r.node, r.root) for r in roots.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")}
    assert met.value == 3


def test_failures_in_a_row(spark):
    said = "f f d f f f d f".split()
    log = spark.createDataFrame([("s", k, "failed" if x == "f" else "done") for k, x in enumerate(said)] + [("t", 1, "done")], "stage string, seq int, status string")
    assert [(r.stage, r.longest) for r in logs.failures_in_a_row(log, ["stage"], landing(spark, "t")).collect()] == [("s", 3)]


def test_thinning_of_a_stream_survives_a_batch_that_runs_again(spark, tmp_path):
    m = 1 / 111_195.0
    # the second batch: two far from all, one beside a capture kept before, one seen before
    batches = [[(f"a{k}", k, 39.0 + 40 * k * m, 0.0) for k in range(5)], [("b0", 1, 41.0, 1.0), ("b1", 2, 41.0 + 90 * m, 1.0), ("b2", 0, 39.0 + 2 * m, 0.0), ("a3", 3, 39.0 + 120 * m, 0.0)]]
    source, out = tmp_path / "in", str(tmp_path / "kept")
    schema = "image_id string, captured_at_ms long, lat double, lon double"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        streams.stream_thin(stream, 10.0, out, landing(spark, "t"))
        return {(r.image_id, r.captured_at_ms) for r in spark.read.parquet(out).collect()}

    want = {(f"a{k}", k) for k in range(5)}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        got = run()
        want |= {("b0", 1), ("b1", 2)} if k else set()
        assert got == want
    commits = tmp_path / "kept-checkpoint" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()
    assert run() == want


def test_near_footprints_equal_all_pairs(spark):
    rng = random.Random(5)
    cameras = [(f"c{k}", 39.0 + rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for k in range(12)]
    boxes = []
    for k in range(15):
        y, x, h = 39.0 + rng.uniform(0, 0.004), rng.uniform(0, 0.004), 0.00008
        boxes.append((f"b{k}", y, x, [[[[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]]]))
    c = spark.createDataFrame(cameras, "image_id string, lat double, lon double")
    f = spark.createDataFrame(boxes, "building_id string, lat double, lon double, geometry array<array<array<array<double>>>>")
    got = {(r.image_id, r.building_id): r.distance_m for r in walls.near_footprints(c, f, 20.0, 90.0).collect()}

    def distance(camera, ring):
        best = math.inf
        px, py = 0.0, 0.0
        metres = [((x - camera[2]) * 111_195.08 * math.cos(math.radians(camera[1])), (y - camera[1]) * 111_195.08) for x, y in ring]
        for (x1, y1), (x2, y2) in zip(metres, metres[1:], strict=False):
            t = max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            best = min(best, math.hypot(x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
        return best

    every = {(a[0], b[0]): distance(a, b[3][0][0]) for a in cameras for b in boxes}
    assert {k for k, v in every.items() if v <= 89.5} <= set(got) <= {k for k, v in every.items() if v <= 90.5} and got
    assert all(got[k] == pytest.approx(every[k], abs=0.5) for k in got)


def test_face_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    faces = [(f"i{k}", n, (90.0 * n + rng.uniform(0, 360)) % 360) for k in range(6) for n in range(4)]
    near = [(a, b) for a in ("i0", "i1", "i2") for b in ("i1", "i2", "i3") if a != b]
    got = sorted(tuple(r) for r in walls.face_pairs(spark.createDataFrame(faces, "image_id string, face int, yaw_deg double"), spark.createDataFrame(near, "image_id string, other_id string")).collect())
    want = [(a, f, a, (f + 1) % 4) for a, f, _ in faces]
    for a, f, y in faces:
        for b, g, z in faces:
            if (a, b) in near and a < b and abs((y - z + 180) % 360 - 180) < 110.0:
                want.append((a, f, b, g))
    assert got == sorted(want)


def test_rows_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(f"way/{rng.randrange(1, 9)}", f"{i:03d}", rng.randrange(100, 5000), 100, 100, rng.random(), [] if rng.random() < 0.7 else ["blurry"], rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "building_id string, image_id string, pixels long, width int, height int, coverage double, flags array<string>, captured_at_ms long")
    runs = []
    for n in (1, 7):
        shuffled = df.repartition(n, F.rand(n))
        runs.append((sorted(map(tuple, views.building_rows(views.collect_views(shuffled)).collect())), sorted(map(tuple, views.ranked_views(shuffled).select("building_id", "image_id", "rank").collect()))))
    assert runs[0] == runs[1]


def test_pose_scores_equal_brute_force(spark):
    width, height, camera = 72, 36, 1.7
    rng = random.Random(7)
    scenes = {f"i{k}": [(f"b{j}", *[rng.uniform(-25, 25) for _ in range(4)], rng.uniform(4, 14)) for j in range(3)] for k in range(4)}
    candidates = walls.pose_candidates(spark)
    poses = [tuple(c) for c in candidates.collect()]

    def cells(facades, dx=0.0, dy=0.0):
        out = set()
        for _, x1, y1, x2, y2, top_m in facades:
            x1, y1, x2, y2 = x1 - dx, y1 - dy, x2 - dx, y2 - dy
            for col in range(width):
                a = math.radians((col + 0.5) * 360 / width)
                u, v = math.sin(a), math.cos(a)
                cross = u * (y2 - y1) - v * (x2 - x1)
                t, s = (x1 * (y2 - y1) - y1 * (x2 - x1)) / cross, (x1 * v - y1 * u) / cross
                if t <= 0.25 or not 0 <= s <= 1:
                    continue
                row = [math.floor((0.5 - math.atan2(h, t) / math.pi) * height) for h in (top_m - camera, -camera)]
                out |= {(r, col) for r in range(max(0, row[0]), min(height - 1, row[1]) + 1)}
        return out

    seen = {i: cells(f, -2.0) for i, f in scenes.items()}
    want = {}
    for i, f in scenes.items():
        for k, dx, dy, turn in poses:
            shift = round(turn / 360 * width)
            got = {(r, (c - shift) % width) for r, c in cells(f, dx, dy)}
            if got:
                want[i, k] = len(got & seen[i]) / len(got | seen[i])
    facades = spark.createDataFrame([(i, *w) for i, f in scenes.items() for w in f], "image_id string, building_id string, x1 double, y1 double, x2 double, y2 double, top_m double")
    observed = spark.createDataFrame([(i, r, c) for i, s in seen.items() for r, c in s], "image_id string, row int, col int")
    scores = {(r.image_id, r.candidate): r.score for r in walls.pose_scores(walls.cell_masks(observed), facades, candidates, width, height).collect()}
    assert scores == pytest.approx(want, abs=1e-12) and len(want) == 4 * 27


@pytest.mark.parametrize("height", [36, 100])
def test_scene_scores_equal_those_of_masks(spark, height):
    rng = random.Random(height)
    rows = [(f"i{k}", *[rng.uniform(-25, 25) for _ in range(4)], rng.uniform(2, 14), seen) for k in range(20) for seen in (True, False) for _ in range(rng.randrange(1, 5))]
    rows += [("unseen", 5.0, 7.0, -5.0, 7.0, 9.0, False), ("only seen", 5.0, 7.0, -5.0, 7.0, 9.0, True), ("low", 5.0, 7.0, -5.0, 7.0, -300.0, False), ("low", 5.0, 7.0, -5.0, 7.0, 9.0, True)]
    df = spark.createDataFrame(rows, "image_id string, x1 double, y1 double, x2 double, y2 double, top_m double, seen boolean")
    want = walls.pose_scores(walls.wall_masks(df.where("seen"), ["image_id"], 72, height), df.where("NOT seen"), walls.pose_candidates(spark), 72, height)
    want = {(r.image_id, r.candidate): r.score for r in want.collect()}
    for found in (walls.scene_scores(df.repartition(5), walls.pose_grid(), 72, height), walls.scene_scores(df.coalesce(1), walls.pose_grid(), 72, height, together=True)):
        assert {(r.image_id, r.candidate): r.score for r in found.collect()} == pytest.approx(want, abs=1e-12)
    assert {i for i, _ in want} == {f"i{k}" for k in range(20)} and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_every_scene_is_scored(spark):
    from streetweave.plans.catalogue import QUERIES

    folder = "/root/testdata/sf0.001"
    ids = lambda name: {r.image_id for r in QUERIES[name](spark, folder).select("image_id").distinct().collect()}
    assert ids("G7") == ids("G4")


def test_current_states_survive_a_batch_that_runs_again(spark):
    landing(spark, "t")
    path, schema = f"{spark.conf.get('spark.checkpoint.dir')}/states-{uuid.uuid4().hex}", "stage string, image string, status string, seq long"
    rng = random.Random(11)
    log = [(rng.choice("ab"), str(rng.randrange(30)), rng.choice(("done", "failed", None)), n) for n in range(240)]
    parts = [log[:100], log[180:], [], log[100:180]]  # the third is late: it must not undo what came before
    add = streams.upsert(path, ["stage", "image"], "seq", n_buckets=5)
    seen = []
    for number, part in enumerate(parts):
        seen += part
        for _ in range(2):  # the driver is lost after the batch, which runs again
            add(spark.createDataFrame(part, schema), number)
        want = {}
        for row in seen:
            if row[3] > want.get(row[:2], (0, 0, 0, -1))[3]:
                want[row[:2]] = row
        assert sorted(map(tuple, streams.current_states(spark, path, schema).collect()), key=str) == sorted(want.values(), key=str)
    # what the last but one manifest has replaced is gone
    folders = [p for p in Path(path.removeprefix("file:"), "states").glob("batch=*/bucket=*")]
    assert len(folders) <= 10


def test_progress_of_a_stream_over_batches_without_a_span(spark, tmp_path):
    schema, source = "stage string, at_ms long, seq long", tmp_path / "in"
    rows = [("one", 5, 1)] + [("s", 1000 * n, n) for n in range(100)]
    for part in (rows[:31], rows[31:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = streams.stream_progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    streams.run_available(stream, str(tmp_path / "out"))
    got = streams.last_word(spark.read.parquet(str(tmp_path / "out")), ["stage"])
    assert {r.stage: (r.completed, r.rate_per_minute) for r in got.collect()} == {"one": (1, None), "s": (100, 60.0)}


def _streets(spark, n, seed=4):
    """Scenes of up to seven squares beside a street, some of them touching."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for b in range(rng.randrange(1, 8)):
            x, y, h = b * 14.0 - 40.0, rng.choice([12.0, -15.0]) + rng.randrange(5), rng.choice([5.0, 7.0])
            rows.append((f"{i:05d}", str(b), [[[[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]]]))
    df = spark.createDataFrame(rows, "image_id string, building_id string, geometry array<array<array<array<double>>>>")
    return walls.edges(df, ["image_id", "building_id"])


def test_scenes_of_a_batch_equal_scenes_alone(spark):
    """Thousands of scenes in batches of any size see what each of them sees alone."""
    scenes = _streets(spark, 300).cache()
    wanted: dict[str, set] = {"facing": set(), "unshared": set(), "clear": set()}
    for _, rows in scenes.toPandas().groupby("image_id"):
        edges = rows[["x1", "y1", "x2", "y2"]].to_numpy()
        names = list(zip(rows.image_id, rows.building_id, rows.edge_no, strict=True))
        building = rows.building_id.astype(int).to_numpy()
        wanted["facing"] |= {k for k, yes in zip(names, sweep.facing(edges, building), strict=True) if yes}
        wanted["unshared"] |= {k for k, no in zip(names, sweep.shared(edges, building), strict=True) if not no}
        for k, e in zip(names, edges, strict=True):
            n = int(min(64, max(1, math.ceil(math.hypot(e[2] - e[0], e[3] - e[1]) / 1.5))))
            at = ((np.arange(n) + 0.5) / n)[:, None]
            wanted["clear"].add((*k, int(sweep.clear(e[:2] + (e[2:] - e[:2]) * at, edges).sum())))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("7", "10000"):
            spark.conf.set(name, size)
            for kind, got in (("facing", walls.facing_walls(scenes)), ("unshared", walls.unshared_walls(scenes))):
                assert {(r.image_id, r.building_id, r.edge_no) for r in got.collect()} == wanted[kind]
            assert {(r.image_id, r.building_id, r.edge_no, r.clear) for r in walls.clear_counts(scenes).collect()} == wanted["clear"]
    finally:
        spark.conf.set(name, before)
    assert "FlatMapGroups" not in walls.visible_facades(scenes)._jdf.queryExecution().toString()


def test_a_rig_whose_spread_is_the_limit_is_accepted(spark):
    rows = [(str(n), x, 0.0, 0.0, 0.0, 0.0, 0.0) for n in range(1, 40) for x in (n / 100, n / 100, n / 100 + 0.2)]
    df = spark.createDataFrame(rows, "rig string, x double, y double, z double, x0 double, y0 double, z0 double")
    poses = walls.rig_poses(df, max_spread=0.2).collect()
    assert any(r.spread > 0.2 for r in poses) and all(r.accepted for r in poses)


def test_readiness_stream_says_after_each_batch_what_the_log_says(spark, tmp_path):
    """Also where the last capture that was done fails later, and where nothing has changed."""
    landing(spark, "r")
    out = f"{spark.conf.get('spark.checkpoint.dir')}/readiness-{uuid.uuid4().hex}"
    schema, source = "image_id string, status string, seq long", tmp_path / "in"
    expected = spark.createDataFrame([("b", "1"), ("b", "2"), ("c", "2"), ("d", "9")], "building_id string, image_id string")
    parts = [[("1", "done", 1), ("1", "failed", 0)], [("2", "failed", 2), ("1", "done", 3)], [("1", "done", 4)], [("1", "failed", 5), ("2", "done", 6)], [("2", "skipped", 8), ("2", "done", 7)]]
    seen: list[tuple] = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        seen += part
        streams.run_ready_buildings(spark.readStream.schema(schema).parquet(str(source)), expected, out)
        last = {r.building_id: (r.done, r.done_set) for r in streams.last_word(spark.read.parquet(out), ["building_id"]).where("done > 0").collect()}
        latest = logs.latest_by_key(spark.createDataFrame(seen, schema).withColumnRenamed("image_id", "image"), ["image"], "seq")
        assert last == {r.building_id: (r.done, r.done_set) for r in logs.ready_buildings(expected, latest).collect()}
    told = sorted((r.batch, r.building_id, r.done) for r in spark.read.parquet(out).collect())
    assert told == [(1, "b", 1), (3, "b", 1), (3, "c", 1), (4, "b", 0), (4, "c", 0)]


def test_accepted_outlines_are_not_broadcast(spark):
    import streetweave.plans.catalogue  # noqa: F401
    from streetweave.plans.files import accepted_outlines

    plan = accepted_outlines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


@pytest.mark.parametrize(("name", "folder"), [("S4", "mapxml"), ("S5", "gml")])
def test_xml_is_written_in_files_of_bounded_size(spark, monkeypatch, tmp_path, name, folder):
    from streetweave.plans.catalogue import QUERIES
    from streetweave.plans import files

    monkeypatch.setattr(files, "FILE_ROWS", 70)
    monkeypatch.setattr(files, "_path", lambda s, n: str(tmp_path / n))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
    counts = [sum(line.count("</way>") + line.count("</node>") + line.count("</Building>") + line.count("</BuildingPart>") for line in p.open()) for p in (tmp_path / folder).glob("*/part-*")]
    assert len(counts) > 4 and max(counts) <= 70
