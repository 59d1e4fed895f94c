"""Independent sets, boxes, polygons and masks against brute force."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from streetweave.operators import boxes, captures, polygons, spatial, views
from streetweave.operators.independent import first_largest
from streetweave.sources.landing import landing

SHAPE = "array<array<array<array<double>>>>"


def square(x, y, s, t=None):
    t = s if t is None else t
    return [[x, y], [x + s, y], [x + s, y + t], [x, y + t], [x, y]]


# independent sets


def field(n, width, height, seed, limit=3.0):
    rng = random.Random(seed)
    points = [(rng.uniform(0, width), rng.uniform(0, height)) for _ in range(n)]
    near = [{j for j, q in enumerate(points) if j != i and math.dist(p, q) < limit} for i, p in enumerate(points)]
    return points, near


@pytest.mark.parametrize("side", [4.0, 8.0, 13.0])
def test_first_largest_set_equals_brute_force(side):
    for seed in range(60):
        n = 1 + seed % 14
        points, near = field(n, side, side, seed)
        want = next(list(c) for k in range(n, 0, -1) for c in combinations(range(n), k) if all(b not in near[a] for a, b in combinations(c, 2)))
        assert first_largest(near, points) == want


def test_twenty_points_of_a_crowd():
    points, near = field(20, 9.0, 9.0, 4)
    best = 0
    for mask in range(1 << 20):
        if mask.bit_count() > best and all(not mask >> j & 1 for i in range(20) if mask >> i & 1 for j in near[i]):
            best = mask.bit_count()
    got = first_largest(near, points)
    assert len(got) == best and all(b not in near[a] for a, b in combinations(got, 2))


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_a_chain_of_any_length(reach):
    n = 100_000
    near = [{j for j in range(max(0, i - reach), min(n, i + reach + 1)) if j != i} for i in range(n)]
    assert first_largest(near) == list(range(0, n, reach + 1))


@pytest.mark.parametrize(("width", "height"), [(100.0, 10.0), (90.0, 90.0)])
def test_dense_fields_of_a_thousand(width, height):
    points, near = field(1000, width, height, 1)
    got = set(first_largest(near, points))
    assert all(not near[i] & got for i in got)
    # none can be added, and none swapped for two
    assert all(near[i] & got for i in range(1000) if i not in got)
    single = {}
    for i in range(1000):
        if i not in got and len(near[i] & got) == 1:
            single.setdefault(next(iter(near[i] & got)), []).append(i)
    assert all(b in near[a] for around in single.values() for a, b in combinations(around, 2))


def test_two_sweeps_agree(monkeypatch):
    from streetweave.operators import independent

    points, near = field(200, 40.0, 20.0, 9)
    want = first_largest(near, points)
    assert first_largest(near, [(y, x) for x, y in points]) == want
    monkeypatch.setattr(independent, "MANY", 50)
    points, near = field(120, 30.0, 12.0, 9)
    few = first_largest(near, points)
    monkeypatch.setattr(independent, "MANY", 10**6)
    assert first_largest(near, points) == few


# seven checks


def assessed(spark, rows, inputs=None):
    schema = "building_id string, image_id string, lat double, lon double, geometry string, source string, revision int, facade_iou double, depth_samples long, depth_conflicts long"
    return {r.building_id: r for r in views.assess_footprints(spark.createDataFrame(rows, schema), landing(spark, "t"), inputs).collect()}


def test_views_a_metre_apart_are_one_independent_view(spark):
    m = 1 / 111_195.0
    rows = [("near", "a", 39.0, 0.0, "g", "osm", None, 0.5, 3, 0), ("near", "b", 39.0 + m, 0.0, "g", "osm", None, 0.7, 3, 0), ("far", "a", 39.0, 0.0, "g", "osm", None, None, 0, 0), ("far", "b", 39.0 + 4 * m, 0.0, "g", "local", 2, None, 0, 0)]
    rows += [("mixed", "a", 39.0, 0.0, "g", "osm", 1, None, 2, 1), ("mixed", "b", 39.1, 0.0, "h", "osm", None, None, 2, 0), ("nowhere", "a", None, None, "g", "osm", None, None, None, None), ("nowhere", "b", None, None, "g", "osm", None, None, None, None)]
    inputs = spark.createDataFrame([(5, 0, 1, 0)], "compatible long, stale long, incomplete long, invalid long")
    got = assessed(spark, rows, inputs)
    assert {b: (r.independent_views, r.conclusion) for b, r in got.items()} == {
        "near": (1, "single_view_association"), "far": (2, "consistent_multi_view_association"), "mixed": (2, "mixed_geometry_association"), "nowhere": (0, "single_view_association")
    }
    far, near = got["far"], got["near"]
    assert (far.multi_view_support, far.geometry_consistency, far.geometry_provenance, far.footprint_correction, far.pose_alignment, far.depth_evidence, far.input_completeness) == ("supporting", "supporting", "informational", "caution", "not_available", "not_available", "caution")
    assert far.sources == ["local", "osm"] and far.revisions == [2] and (near.least_iou, near.largest_iou, near.depth_evidence) == (0.5, 0.7, "supporting")
    assert got["mixed"].depth_evidence == "caution" and assessed(spark, rows)["far"].input_completeness == "supporting"


def test_fusion_has_revisions_and_inferred_pixels(spark):
    m = 1 / 111_195.0
    seen = spark.createDataFrame([("w", "a", "osm", 10, 0.5, 4, 2), ("w", "b", "local", 20, 0.7, None, 1), ("w", "c", "osm", 5, 0.9, 1, None)], "building_id string, image_id string, source string, pixels long, coverage double, inferred_pixels long, revision int")
    places = spark.createDataFrame([("a", 39.0, 0.0), ("b", 39.0 + m, 0.0), ("c", 39.0 + 9 * m, 0.0)], "image_id string, lat double, lon double")
    r = captures.fuse_nearby(seen, places, landing(spark, "t")).first()
    assert (r.sources, r.revisions, r.captures, r.observed_pixels, r.inferred_pixels, r.views, r.independent_ids, r.confidence) == ("local,osm", [1, 2], 3, 35, 5, 2, ["a", "c"], 0.7)


# boxes


def random_boxes(n, seed, spread=50.0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w, h = (10 ** rng.uniform(-4, 2) for _ in range(2))
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        out.append((k, x, y, x + w, y + h))
    return [*out, (n, 1.0, 1.0, 1.0, 1.0), (n + 1, 2.0, 2.0, 1.0, 3.0), (n + 2, None, 0.0, 1.0, 1.0), (n + 3, -1e4, -1e4, 1e4, 1e4), (n + 4, 0.0, 0.0, 2.0, 2.0)]


BOX = "id long, west double, south double, east double, north double"


def test_boxes_of_any_size_meet_as_by_brute_force(spark):
    a, b = random_boxes(150, 1), random_boxes(150, 2)
    got = boxes.meeting_boxes(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["id"], ["id"]).select("a_id", "b_id").collect()
    sound = lambda r: r[1] is not None and r[1] <= r[3] and r[2] <= r[4]
    want = {(p[0], q[0]) for p in filter(sound, a) for q in filter(sound, b) if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_meeting_boxes_are_not_broadcast(spark):
    a, b = (spark.createDataFrame(random_boxes(20, k), BOX) for k in (3, 4))
    assert "Broadcast" not in boxes.meeting_boxes(a, b, ["id"], ["id"])._jdf.queryExecution().toString()


def test_points_in_boxes_without_a_broadcast(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(400)] + [(400, 1.0, 1.0), (401, None, 1.0), (402, 2.0, 2.0)]
    regions = random_boxes(300, 5)
    p, q = spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(regions, BOX.replace("id", "region", 1))
    got = {r.point_id: r.region for r in spatial.smallest_region(p, q).collect()}
    want = {}
    for k, x, y in points:
        around = [((e - w) * (n - s), i) for i, w, s, e, n in regions if x is not None and w is not None and w <= x <= e and s <= y <= n]
        if around:
            want[k] = min(around)[1]
    assert got == want and len(want) > 390
    inside = spatial.region_at(p, q.where("region < 100"), q.where("region >= 100 AND region < 150"), "point_id")
    hit = lambda lo, hi, x, y: any(w is not None and w <= x <= e and s <= y <= n for i, w, s, e, n in regions if lo <= i < hi)
    assert {r.point_id for r in inside.collect()} == {k for k, x, y in points if x is not None and hit(0, 100, x, y) and not hit(100, 150, x, y)}


# polygons


def by_raster(shapes, n=900, low=-5.0, high=8.0):
    step = (high - low) / n
    at = low + (np.arange(n) + 0.5) * step
    grid = np.stack(np.meshgrid(at, at), -1).reshape(-1, 2)
    inside = [polygons._inside(grid, polygons.edges_of(s)) for s in shapes]
    return [float(i.sum()) * step * step for i in (*inside, np.logical_and(*inside))]


def star(rng, n, cx, cy):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    points = [[cx + r * math.cos(t), cy + r * math.sin(t)] for t in turns for r in (rng.uniform(0.5, 3),)]
    return [*points, points[0]]


@pytest.mark.parametrize("seed", range(8))
def test_shared_area_equals_a_fine_raster(seed):
    rng = random.Random(seed)
    a, b = [[star(rng, rng.randint(3, 14), 0, 0), square(-0.1, -0.1, 0.2)]], [[star(rng, 9, 1, 1)], [square(4.5, 4.5, 2.0), square(5.0, 5.0, 1.0)]]
    assert polygons.shared_area(a, b) == pytest.approx(by_raster([a, b]), abs=0.12)
    assert polygons.shared_area(b, a)[2] == pytest.approx(polygons.shared_area(a, b)[2], abs=1e-9)


def test_shared_areas_by_hand():
    corner = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [1.0, 1.0], [1.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]]
    assert polygons.shared_area(corner, [[square(0, 0, 2)]]) == pytest.approx((7, 4, 3))
    assert polygons.shared_area([[square(0, 0, 4), square(1, 1, 2)]], [[square(0, 0, 2)]]) == pytest.approx((12, 4, 3))
    assert polygons.shared_area([[square(0, 0, 1)]], [[square(1, 0, 1)]]) == pytest.approx((1, 1, 0))
    assert polygons.shared_area([[square(2.0, 48.0, 1e-4)]], [[square(2.00005, 48.0, 1e-4)]])[2] == pytest.approx(0.5e-8, rel=1e-6)
    assert polygons.shared_area(None, [[square(0, 0, 1)]]) == pytest.approx((0, 1, 0)) and polygons.shared_area(None, []) == (0, 0, 0)
    ring = [[math.cos(k / 5000 * 2 * math.pi), math.sin(k / 5000 * 2 * math.pi)] for k in range(5000)]
    assert polygons.shared_area([[[*ring, ring[0]]]], [[square(0, 0, 2)]])[2] == pytest.approx(math.pi / 4, rel=1e-5)


@pytest.mark.parametrize(("shape", "issue"), [
    ([[square(0, 0, 4)]], None), ([[square(0, 0, 4), square(1, 1, 2)]], None), ([[square(0, 0, 1)], [square(2, 0, 1)]], None), ([[square(0, 0, 4), [[0, 0], [1, 1], [2, 1], [0, 0]]]], None),
    ([[[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]], "self_intersection"), ([[square(0, 0, 4), square(5, 5, 1)]], "hole_outside"), ([[square(0, 0, 4), square(3, 3, 2)]], "self_intersection"),
    ([[square(0, 0, 9), square(1, 1, 4), square(2, 2, 1)]], "hole_outside"), ([[square(0, 0, 4)], [square(2, 2, 4)]], "self_intersection"), ([[square(0, 0, 4)], [square(1, 1, 1)]], "overlapping_polygons"),
    ([[square(0, 0, 9), square(1, 1, 7)], [square(2, 2, 1)]], None), ([[square(0, 0, 1)], [square(1, 0, 1)]], "self_intersection"), ([[[[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]]]], "self_intersection"),
    ([[[[0, 0], [1, 1], [2, 2], [0, 0]]]], "self_intersection"), ([[[[0, 0], [1, 0], [1, 1]]]], "open_ring"), ([[[[0, 0], [1, math.nan], [1, 1], [0, 0]]]], "not_finite"), ([], "no_area"), (None, "no_area"), ([[[[1, 1]] * 5]], "no_area"),
])
def test_what_is_wrong_with_a_shape(shape, issue):
    assert polygons.shape_issue(shape) == issue


def test_corrections(spark):
    h = 1e-4
    base = [[square(0.0, 40.0, h)]]
    strips = [[[square(0.0 + k * h / 20, 40.0, h / 20, h)]] for k in range(21)]
    cases = {
        "fine": ("geometry", [[[square(h / 10, 40.0, h)]]], ""), "twenty": ("split", strips[:20], ""), "many": ("split", strips, "bad_part_count"), "one": ("split", [base], "bad_part_count"), "two": ("geometry", strips[:2], "bad_part_count"),
        "bow": ("geometry", [[[[[0, 40], [h, 40 + h], [h, 40], [0, 40 + h], [0, 40]]]]], "self_intersection"), "hole": ("geometry", [[[square(0.0, 40.0, h), square(2 * h, 40.0, h / 2)]]], "hole_outside"),
        "moved": ("geometry", [[[square(0.0, 40.001, h)]]], "moved_too_far"), "over": ("split", [[[square(0.0, 40.0, h)]], [[square(h / 2, 40.0, h)]]], "parts_overlap"), "touch": ("split", [[[square(0.0, 40.0, h / 2, h)]], [[square(h / 2, 40.0, h / 2, h)]]], ""),
        "far": ("geometry", [[[square(200.0, 40.0, h)]]], "out_of_range,moved_too_far"), "none": ("geometry", [], "bad_part_count"), "unknown": ("geometry", [base], "unknown_footprint"),
    }
    floats = lambda x: [floats(y) for y in x] if isinstance(x, list) else float(x)
    proposals = spark.createDataFrame([(k, 1, kind, floats(parts)) for k, (kind, parts, _) in cases.items()], f"osm_id string, revision int, kind string, parts array<{SHAPE}>")
    feet = spark.createDataFrame([(k, base) for k in cases if k != "unknown"], f"building_id string, geometry {SHAPE}")
    got = {r.osm_id: r.issues for r in polygons.validate_corrections(proposals, feet).collect()}
    assert got == {k: want for k, (_, _, want) in cases.items() if want}


def test_corrections_are_checked_once_and_in_all_tasks(spark):
    """A filter on the issues must not be carried below the exchange, where the check would run a second time."""
    proposals = spark.createDataFrame([("a", 1, "geometry", [[[square(0.0, 40.0, 1e-4)]]]), ("b", 1, "geometry", None), (None, 2, None, [None])], f"osm_id string, revision int, kind string, parts array<{SHAPE}>")
    feet = spark.createDataFrame([("a", [[square(0.0, 40.0, 1e-4)]]), ("b", None)], f"building_id string, geometry {SHAPE}")
    found = polygons.validate_corrections(proposals, feet)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "Broadcast" not in plan
    assert {(r.osm_id, r.revision): r.issues for r in found.collect()} == {("b", 1): "unknown_footprint,bad_part_count", (None, 2): "unknown_footprint,no_area"}


def test_lists_equal_pylists():
    shape = pa.list_(pa.list_(pa.list_(pa.float64())))
    column = pa.array([[[[1.0, 2.0], [None, 3.0]], None, []], None, [], [[None, [4.0, 5.0, 6.0]]], [[[], [7.0]]]], shape)
    for part in (column, column[1:4], column[2:], column[5:]):
        assert polygons._lists(part) == part.to_pylist()


def test_few_points_have_the_centre_of_many(monkeypatch):
    rng = random.Random(21)
    shapes = [[[star(rng, rng.randint(3, 9), rng.uniform(-50, 50), rng.uniform(-50, 50)), square(0.0, 0.0, 0.2)], [star(rng, 4, 60, 60)]] for _ in range(40)] + [[], None, [[[]]], [[[[1.0, 1.0]] * 4]]]
    few = [polygons.centre(s) for s in shapes]
    monkeypatch.setattr(polygons, "FEW", 0)
    for got, want in zip(few, [polygons.centre(s) for s in shapes], strict=True):
        assert got == (None if want is None else pytest.approx(want, abs=1e-9))


def test_few_edges_equal_many(monkeypatch):
    """Loops over a few edges say what arrays say, and long work on few bytes is dealt to all tasks."""
    rng = random.Random(8)
    shapes = [[[star(rng, rng.randrange(3, 9), rng.uniform(-1, 1), rng.uniform(-1, 1))]] for _ in range(60)]
    for _ in range(300):
        ring = [[float(rng.randrange(4)), float(rng.randrange(4))] for _ in range(rng.randrange(3, 7))]
        shapes.append([[[*ring, ring[0]]]] if rng.random() < 0.7 else [[[*ring, ring[0]], square(1.0, 1.0, rng.choice([0.5, 4.0]))]])
    few = [polygons.shape_issue(s) for s in shapes], [polygons.shared_area(s, t) for s, t in zip(shapes, shapes[1:], strict=False)]
    monkeypatch.setattr(polygons, "FEW", 0)
    many = [polygons.shape_issue(s) for s in shapes], [polygons.shared_area(s, t) for s, t in zip(shapes, shapes[1:], strict=False)]
    assert few[0] == many[0] and len(set(few[0])) >= 4
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in zip(few[1], many[1], strict=True))


def test_few_boxes_go_to_the_points_and_regions_are_chosen_after_the_exchange(spark):
    rng = random.Random(8)
    p = spark.createDataFrame([(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(300)], "point_id long, lon double, lat double")
    q = spark.createDataFrame(random_boxes(60, 9), BOX)
    few, many = (boxes.points_in_boxes(p, q, ["id"], few=n) for n in (1000, 1))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 0
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(few) and "strategy=merge" in plan(many)
    chosen = spatial.smallest_region(p, q.withColumnRenamed("id", "region"))._jdf.queryExecution().executedPlan().toString()
    assert chosen.count("Exchange hashpartitioning(point_id") == 1 and "partial_" not in chosen[chosen.index("Exchange hashpartitioning(point_id") :]
