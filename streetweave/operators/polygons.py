"""Polygons with holes: areas, centres, the area two of them share, and whether they are valid.

A shape is polygons -> rings -> closed lists of [x, y], the first ring of a polygon its shell. Areas come from
slabs: between two heights at which there is a corner or two edges cross, no edges cross, so what is inside is
a row of trapezoids, and their middle lines tell the area. Insides are even-odd over all rings of a shape."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from streetweave.functions.geo import EARTH_RADIUS_M
from streetweave.operators.boxes import meeting_boxes
from streetweave.operators.dealing import dealt

# How far the centre of a correction may lie from its footprint, the most parts of a split, and
# the share of the smaller of two parts that they may have in common.
SHIFT_M, MAX_PARTS, PART_OVERLAP = 50.0, 20, 0.01
#: Numbers that one step of the slabs holds at a time.
_AT_ONCE = 1 << 20
#: Up to so many edges a loop over them takes less time than calls on arrays.
FEW = 24


def edges_of(shape: list | None) -> np.ndarray:
    """x1, y1, x2, y2 of all edges of a shape's rings."""
    parts = []
    for polygon in shape or []:
        for ring in polygon or []:
            p = np.array([q for q in ring or [] if q is not None], float).reshape(-1, 2)
            if len(p) > 1:
                parts.append(np.concatenate([p[:-1], p[1:]], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of edges of ``a`` and ``b`` whose boxes touch: a sweep along x, in blocks."""
    if not len(a) or not len(b):
        return
    order = np.argsort(np.minimum(b[:, 0], b[:, 2]), kind="stable")
    b = b[order]
    left, right = np.minimum(b[:, 0], b[:, 2]), np.maximum(b[:, 0], b[:, 2])
    reach = np.maximum.accumulate(right)  # none before ends beyond it
    lo, hi = np.searchsorted(reach, np.minimum(a[:, 0], a[:, 2]), "left"), np.searchsorted(left, np.maximum(a[:, 0], a[:, 2]), "right")
    n = np.maximum(hi - lo, 0)
    start, total = 0, np.cumsum(n)
    while start < len(a):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + _AT_ONCE, "right")))
        sizes = n[start:end]
        i = np.repeat(np.arange(start, end), sizes)
        j = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[start:end], sizes)
        near = (right[j] >= np.minimum(a[i, 0], a[i, 2])) & (np.maximum(b[j, 1], b[j, 3]) >= np.minimum(a[i, 1], a[i, 3])) & (np.minimum(b[j, 1], b[j, 3]) <= np.maximum(a[i, 1], a[i, 3]))
        yield i[near], order[j[near]]
        start = end


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    out = []
    for i, j in _pairs(a, b):
        p, q = a[i], b[j]
        d, e = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2]
        cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        live = cross != 0
        t = ((q[:, 0] - p[:, 0]) * e[:, 1] - (q[:, 1] - p[:, 1]) * e[:, 0])[live] / cross[live]
        fine = (t >= 0) & (t <= 1)
        out.append(p[live][fine, 1] + t[fine] * d[live][fine, 1])
    return out


def shared_area(a: list | None, b: list | None) -> tuple[float, float, float]:
    """(area of a, area of b, area of both) of two shapes."""
    x, y = edges_of(a), edges_of(b)
    if not len(x) and not len(y):
        return 0.0, 0.0, 0.0
    both = np.concatenate([x, y])
    both = both - np.tile(both[0, :2], 2)  # small numbers are exact further down
    if len(both) <= FEW:
        return _shared_area_of_few(both.tolist(), len(x))
    x, y = both[: len(x)], both[len(x) :]
    heights = np.unique(np.concatenate([both[:, 1], both[:, 3], *_crossing_heights(x, y), *_crossing_heights(x, x), *_crossing_heights(y, y)]))
    is_b = np.arange(len(both)) >= len(x)
    low, high = np.minimum(both[:, 1], both[:, 3]), np.maximum(both[:, 1], both[:, 3])
    slope = np.where(high > low, (both[:, 2] - both[:, 0]) / np.where(high > low, both[:, 3] - both[:, 1], 1.0), 0.0)
    areas = np.zeros(3)
    step = max(1, _AT_ONCE // len(both))
    for at in range(0, len(heights) - 1, step):
        bottom, top = heights[at : at + step + 1][:-1], heights[at : at + step + 1][1:]
        middle = ((bottom + top) / 2)[:, None]
        met = (low[None] < middle) & (middle < high[None])
        where = np.where(met, both[None, :, 0] + (middle - both[None, :, 1]) * slope[None], np.inf)
        order = np.argsort(where, axis=1, kind="stable")
        where = np.take_along_axis(where, order, 1)
        there = np.isfinite(where)
        in_a = np.cumsum(there & ~is_b[order], axis=1) % 2 == 1
        in_b = np.cumsum(there & is_b[order], axis=1) % 2 == 1
        width = np.where(there[:, 1:], where[:, 1:] - np.where(there[:, :-1], where[:, :-1], 0.0), 0.0)
        for k, inside in enumerate((in_a, in_b, in_a & in_b)):
            areas[k] += float(((width * inside[:, :-1]).sum(axis=1) * (top - bottom)).sum())
    return float(areas[0]), float(areas[1]), float(areas[2])


def _shared_area_of_few(edges: list[list[float]], n: int) -> tuple[float, float, float]:
    """The same for a few edges, the first ``n`` of them of a."""
    heights = {e[1] for e in edges} | {e[3] for e in edges}
    for k, (ax, ay, bx, by) in enumerate(edges):
        dx, dy = bx - ax, by - ay
        for cx, cy, ex, ey in edges[k + 1 :]:
            cross = dx * (ey - cy) - dy * (ex - cx)
            if cross and max(ax, bx) >= min(cx, ex) and max(cx, ex) >= min(ax, bx):
                t = ((cx - ax) * (ey - cy) - (cy - ay) * (ex - cx)) / cross
                if 0 <= t <= 1:
                    heights.add(ay + t * dy)
    levels = sorted(heights)
    one = other = both = 0.0
    for bottom, top in zip(levels, levels[1:], strict=False):
        middle = (bottom + top) / 2
        met = sorted((ax + (middle - ay) * ((bx - ax) / (by - ay)), k) for k, (ax, ay, bx, by) in enumerate(edges) if ay < middle < by or by < middle < ay)
        in_a = in_b = False
        for (x, k), (after, _) in zip(met, met[1:], strict=False):
            in_a, in_b = in_a != (k < n), in_b != (k >= n)
            part = (after - x) * (top - bottom)
            one, other, both = one + part * in_a, other + part * in_b, both + part * (in_a and in_b)
    return one, other, both


def centre(shape: list | None) -> tuple[float, float] | None:
    """The centre of mass; shells count, holes are taken off, whichever way their rings run."""
    total, cx, cy = 0.0, 0.0, 0.0
    origin = next((p[0][0] for p in shape or [] if p and p[0]), None)
    if origin is None:
        return None
    if sum(len(ring or ()) for polygon in shape for ring in polygon) <= FEW and all(q is not None and len(q) == 2 and None not in q for polygon in shape for ring in polygon for q in ring or ()):
        return _centre_of_few(shape, *origin)
    for polygon in shape:
        for k, ring in enumerate(polygon):
            e = edges_of([[ring]]) - np.tile(np.array(origin, float), 2)
            cross = e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]
            sign = (1.0 if cross.sum() >= 0 else -1.0) * (1.0 if k == 0 else -1.0)
            total += sign * float(cross.sum()) / 2
            cx += sign * float(((e[:, 0] + e[:, 2]) * cross).sum()) / 6
            cy += sign * float(((e[:, 1] + e[:, 3]) * cross).sum()) / 6
    return (origin[0] + cx / total, origin[1] + cy / total) if total else None


def _centre_of_few(shape: list, x0: float, y0: float) -> tuple[float, float] | None:
    """The same for a few points."""
    total, cx, cy = 0.0, 0.0, 0.0
    for polygon in shape:
        for k, ring in enumerate(polygon):
            area = mx = my = 0.0
            for (ax, ay), (bx, by) in zip(ring or (), (ring or ())[1:], strict=False):
                ax, ay, bx, by = ax - x0, ay - y0, bx - x0, by - y0
                cross = ax * by - bx * ay
                area, mx, my = area + cross, mx + (ax + bx) * cross, my + (ay + by) * cross
            sign = (1.0 if area >= 0 else -1.0) * (1.0 if k == 0 else -1.0)
            total, cx, cy = total + sign * area / 2, cx + sign * mx / 6, cy + sign * my / 6
    return (x0 + cx / total, y0 + cy / total) if total else None


def _inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd, in blocks."""
    if len(points) + len(edges) <= FEW:
        rows = edges.tolist()
        return np.array([sum((b > y) != (d > y) and x < a + (y - b) / (d - b) * (c - a) for a, b, c, d in rows) % 2 == 1 for x, y in points.tolist()], bool)
    out = np.zeros(len(points), bool)
    step = max(1, _AT_ONCE // max(1, len(edges)))
    for at in range(0, len(points), step):
        p = points[at : at + step]
        straddles = (edges[None, :, 1] > p[:, None, 1]) != (edges[None, :, 3] > p[:, None, 1])
        run = np.where(straddles, edges[None, :, 3] - edges[None, :, 1], 1.0)
        x = edges[None, :, 0] + (p[:, None, 1] - edges[None, :, 1]) / run * (edges[None, :, 2] - edges[None, :, 0])
        out[at : at + step] = (straddles & (p[:, None, 0] < x)).sum(axis=1) % 2 == 1
    return out


def _side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))


def _clash(edges: np.ndarray, ring: np.ndarray, place: np.ndarray, size: np.ndarray) -> bool:
    """Whether edges cross or run along one another, or a ring touches itself."""
    if len(edges) <= FEW:
        return _clash_of_few(edges.tolist(), ring.tolist(), place.tolist(), size.tolist())
    for i, j in _pairs(edges, edges):
        i, j = i[i < j], j[i < j]
        p1, p2, q1, q2 = edges[i, :2], edges[i, 2:], edges[j, :2], edges[j, 2:]
        s = [_side(p1, p2, q1), _side(p1, p2, q2), _side(q1, q2, p1), _side(q1, q2, p2)]
        proper = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
        if proper.any():
            return True
        line = (s[0] == 0) & (s[1] == 0)
        axis = np.abs(p2 - p1).argmax(axis=1)
        take = np.arange(len(i))
        a0, a1 = np.sort([p1[take, axis], p2[take, axis]], axis=0)
        b0, b1 = np.sort([q1[take, axis], q2[take, axis]], axis=0)
        if (line & (np.minimum(a1, b1) > np.maximum(a0, b0))).any():
            return True
        gap = np.abs(place[i] - place[j])
        neighbours = (gap == 1) | (gap == size[i] - 1)
        touch = (s[0] * s[1] <= 0) & (s[2] * s[3] <= 0) & (~line | (np.minimum(a1, b1) >= np.maximum(a0, b0)))
        if (touch & (ring[i] == ring[j]) & ~neighbours).any():
            return True
    return False


def _turn(px: float, py: float, qx: float, qy: float, rx: float, ry: float) -> int:
    d = (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (d > 0) - (d < 0)


def _clash_of_few(edges: list[list[float]], ring: list[int], place: list[int], size: list[int]) -> bool:
    """The same for a few edges."""
    for i, (ax, ay, bx, by) in enumerate(edges):
        for j in range(i + 1, len(edges)):
            cx, cy, dx, dy = edges[j]
            if max(cx, dx) < min(ax, bx) or max(ax, bx) < min(cx, dx) or max(cy, dy) < min(ay, by) or max(ay, by) < min(cy, dy):
                continue
            first, second = (_turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)), (_turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by))
            across, back = first[0] * first[1], second[0] * second[1]
            if across < 0 and back < 0:
                return True
            line = first == (0, 0)
            (a0, a1), (b0, b1) = (sorted((ax, bx)), sorted((cx, dx))) if abs(bx - ax) >= abs(by - ay) else (sorted((ay, by)), sorted((cy, dy)))
            if line and min(a1, b1) > max(a0, b0):
                return True
            neighbours = abs(place[i] - place[j]) in (1, size[i] - 1)
            if across <= 0 and back <= 0 and (not line or min(a1, b1) >= max(a0, b0)) and ring[i] == ring[j] and not neighbours:
                return True
    return False


def shape_issue(shape: list | None) -> str | None:
    """What is wrong with a shape: not_finite, open_ring (or of fewer than four points), self_intersection,
    hole_outside, overlapping_polygons or no_area; None if nothing is."""
    rings = [(n, k, ring) for n, polygon in enumerate(shape or []) for k, ring in enumerate(polygon or [])]
    if not rings:
        return "no_area"
    tables = []
    for n, k, ring in rings:
        if any(q is None or len(q) != 2 or any(c is None or not math.isfinite(c) for c in q) for q in ring or []):
            return "not_finite"
        if len(ring or []) < 4 or list(ring[0]) != list(ring[-1]):
            return "open_ring"
        tables.append((n, k, [(*a, *b) for a, b in zip(ring, ring[1:], strict=False) if a[0] != b[0] or a[1] != b[1]]))
    if any(len(e) < 3 for _, _, e in tables):
        return "no_area"
    edges = [e for _, _, t in tables for e in t]
    number, place, size = [i for i, (_, _, t) in enumerate(tables) for _ in t], [i for _, _, t in tables for i in range(len(t))], [len(t) for _, _, t in tables for _ in t]
    if _clash_of_few(edges, number, place, size) if len(edges) <= FEW else _clash(np.array(edges, float), np.array(number), np.array(place), np.array(size)):
        return "self_intersection"
    if len(tables) == 1 and _surely_has_area(rings[0][2]):
        return None
    tables = [(n, k, np.array(e, float)) for n, k, e in tables]
    middles = [(e[:, :2] + e[:, 2:]) / 2 for _, _, e in tables]
    for i, (n, k, _) in enumerate(tables):
        for j, (m, h, e) in enumerate(tables):
            if i == j:
                continue
            within = _inside(middles[i], e)
            if n == m and k > 0 and h == 0 and not within.all():
                return "hole_outside"
            if n == m and k > 0 and h > 0 and within.any():
                return "hole_outside"
            if n != m and k == 0 and h == 0 and _inside(middles[i], np.concatenate([t for o, _, t in tables if o == m])).any():
                return "overlapping_polygons"
    return None if shared_area(shape, None)[0] > 0 else "no_area"


def _surely_has_area(ring: list) -> bool:
    """Whether a ring that doesn't touch itself is plainly no line; the slabs tell where it may be one."""
    (x0, y0), area = ring[0], 0.0
    west = east = x0
    south = north = y0
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        area += (ax - x0) * (by - y0) - (bx - x0) * (ay - y0)
        west, east, south, north = min(west, bx), max(east, bx), min(south, by), max(north, by)
    return abs(area) > 1e-6 * (east - west) * (north - south) > 0


def _ring_points(shape: Column) -> Column:
    return F.flatten(F.flatten(shape))


def bounding_box(shape: Column) -> list[Column]:
    """west, south, east, north of a shape."""
    points = _ring_points(shape)
    ends = [(F.array_min, 0, "west"), (F.array_min, 1, "south"), (F.array_max, 0, "east"), (F.array_max, 1, "north")]
    return [f(F.transform(points, _coordinate(k))).alias(name) for f, k, name in ends]


def _coordinate(k: int):
    return lambda p: p[k]


def polygon_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, iou of shapes (id, geometry) that share some area: candidates are pairs whose boxes meet."""
    # the optimizer doesn't look through explode: without it each use of a side repeats how the shape is made
    held = [t.select("id", F.explode(F.array("geometry")).alias("geometry")) for t in (a, b)]
    boxes = [t.select("id", "geometry", F.explode(F.array(F.struct(*bounding_box(F.col("geometry"))))).alias("box")) for t in held]
    boxed = [t.select("id", "geometry", "box.*") for t in boxes]
    met = meeting_boxes(*boxed, ["id", "geometry"], ["id", "geometry"])

    @arrow_udf("double")
    def overlap(first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(first, second, strict=True):
            one, other, both = shared_area(x.as_py(), y.as_py())
            out.append(both / (one + other - both) if both > 0 else 0.0)
        return pa.array(out, pa.float64())

    return dealt(met, "a_id", "b_id").select("a_id", "b_id", overlap("a_geometry", "b_geometry").alias("iou")).where("iou > 0")


def _distance_m(a: tuple[float, float], b: tuple[float, float]) -> float:
    middle = math.radians((a[1] + b[1]) / 2)
    return math.hypot(math.radians(b[0] - a[0]) * math.cos(middle), math.radians(b[1] - a[1])) * EARTH_RADIUS_M


def correction_issues(base: list | None, kind: str | None, parts: list | None) -> list[str]:
    """Why a correction can't be accepted: codes in a fixed order, each once."""
    found = set()
    parts = parts or []
    issues = [shape_issue(p) for p in parts]
    found |= {i for i in issues if i}
    if kind == "split":
        found |= {"bad_part_count"} if not 2 <= len(parts) <= MAX_PARTS else set()
    elif len(parts) != 1:
        found.add("bad_part_count")
    good = [p for p, i in zip(parts, issues, strict=True) if not i]
    points = [q for p in good for polygon in p for ring in polygon for q in ring]
    if any(not (-180 <= x <= 180 and -90 <= y <= 90) for x, y in points):
        found.add("out_of_range")
    home = centre(base)
    if home is None:
        found.add("unknown_footprint")
    elif any(_distance_m(home, c) > SHIFT_M for p in good if (c := centre(p))):
        found.add("moved_too_far")
    if len(parts) <= MAX_PARTS:
        boxes = [_box(p) for p in good] if len(good) > 1 else []
        for i, p in enumerate(good):
            for j, q in enumerate(good[i + 1 :], i + 1):
                west, south, east, north = (f(a, b) for f, a, b in zip((max, max, min, min), boxes[i], boxes[j], strict=True))
                if west >= east or south >= north:
                    continue  # their boxes share no area
                one, other, both = shared_area(p, q)
                if both > PART_OVERLAP * min(one, other):
                    found.add("parts_overlap")
    order = ("unknown_footprint", "not_finite", "open_ring", "no_area", "self_intersection", "hole_outside", "overlapping_polygons", "out_of_range", "moved_too_far", "bad_part_count", "parts_overlap")
    return [c for c in order if c in found]


def _box(shape: list) -> tuple[float, float, float, float]:
    xs, ys = zip(*[q for polygon in shape for ring in polygon for q in ring], strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _lists(column: pa.Array) -> list:
    """What ``to_pylist`` returns; nested lists are cut out of those of their values, which takes a fraction of its time."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, cuts = _lists(column.values), column.offsets.to_pylist()
    if column.null_count:
        return [values[a:b] if there else None for a, b, there in zip(cuts, cuts[1:], column.is_valid().to_pylist(), strict=False)]
    return [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def validate_corrections(proposals: DataFrame, footprints: DataFrame) -> DataFrame:
    """osm_id, revision, issues (comma-joined codes) of proposed corrections that aren't acceptable.
    ``proposals``: osm_id, revision, kind, parts (shapes in degrees; one for a kind other than split);
    footprints: building_id, geometry. More than 20 parts are rejected for their number and not compared."""

    # a filter on a function's column would be pushed below the dealing, and the function run there once more
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            issues = [",".join(correction_issues(*row)) for row in zip(_lists(batch["base"]), batch["kind"].to_pylist(), _lists(batch["parts"]), strict=True)]
            table = pa.table({"osm_id": batch["osm_id"], "revision": batch["revision"], "issues": pa.array(issues, pa.string())})
            yield from table.filter(pa.array([i != "" for i in issues], pa.bool_())).to_batches()

    rows = proposals.join(footprints.select(F.col("building_id").alias("osm_id"), F.col("geometry").alias("base")).hint("merge"), "osm_id", "left")
    osm_id, revision = (proposals.schema[c].dataType.simpleString() for c in ("osm_id", "revision"))
    return dealt(rows, "osm_id", "revision").select("osm_id", "revision", "base", "kind", "parts").mapInArrow(check, f"osm_id {osm_id}, revision {revision}, issues string")
