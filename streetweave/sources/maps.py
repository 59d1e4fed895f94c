"""Map sources as footprints: elements (ways and relations), map XML, and cadastral GML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.functions.fields import is_building

_POINT = "struct<lon: double, lat: double>"
ELEMENTS = f"type string, id bigint, tags map<string, string>, version int, timestamp string, geometry array<{_POINT}>, members array<struct<type: string, ref: bigint, role: string, geometry: array<{_POINT}>>>"
_GEOMETRY = "array<array<array<array<double>>>>"


def _rings(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings made by joining lines end to end; lines left over make none."""
    rest, rings = [line for line in lines if len(line) > 1], []
    while rest:
        ring = rest.pop(0)
        while ring[0] != ring[-1]:
            k = next((k for k, line in enumerate(rest) if ring[-1] in (line[0], line[-1])), None)
            if k is None:
                break
            line = rest.pop(k)
            ring = ring + (line[1:] if line[0] == ring[-1] else line[-2::-1])
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def _inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = point
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            hit = not hit
    return hit


def _assembled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def points(line) -> list[tuple[float, float]]:
        return [(p["lon"], p["lat"]) for p in (line if line is not None else []) if p is not None]

    for frame in frames:
        rows = []
        for r in frame.itertuples():
            members = [m for m in (r.members if r.members is not None else []) if m["type"] == "way"]
            outer = _rings([points(m["geometry"]) for m in members if m["role"] != "inner"])
            inner = _rings([points(m["geometry"]) for m in members if m["role"] == "inner"])
            whole = bool(outer) and all(m["geometry"] is not None for m in members)
            polygons = [[o, *[i for i in inner if _inside(i[0], o)]] for o in outer]
            rows.append((r.id, whole, [[[list(p) for p in ring] for ring in polygon] for polygon in polygons], [int(m["ref"]) for m in members]))
        yield pd.DataFrame(rows, columns=["id", "whole", "geometry", "refs"])


def read_footprints(elements: DataFrame) -> DataFrame:
    """building_id, osm_version, osm_timestamp, tags, geometry of buildings. A relation's rings are joined from
    its members, row by row; a complete relation's own member ways are no buildings besides."""
    built = elements.where(is_building(F.col("tags")["building"]))
    shown = ["id", F.col("version").alias("osm_version"), F.col("timestamp").alias("osm_timestamp"), "tags"]
    rings = built.where("type = 'relation'").select("id", "members").mapInPandas(_assembled, f"id bigint, whole boolean, geometry {_GEOMETRY}, refs array<bigint>")
    relations = rings.where("whole").join(built.where("type = 'relation'").select(*shown), "id")
    taken = rings.where("whole").select(F.explode("refs").alias("id")).distinct()
    closed = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    ways = built.where((F.col("type") == "way") & closed).join(taken, "id", "left_anti")
    square = F.array(F.array(F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))))
    one = ways.select(F.concat(F.lit("way/"), "id").alias("building_id"), *shown[1:], square.alias("geometry"))
    two = relations.select(F.concat(F.lit("relation/"), "id").alias("building_id"), "osm_version", "osm_timestamp", "tags", "geometry")
    return one.unionByName(two)


def read_footprints_xml(spark: SparkSession, path: str) -> DataFrame:
    """Footprints of map XML: nodes, and ways and relations that refer to them."""

    def of(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    tag = "array<struct<_k: string, _v: string>>"
    nodes = of("node", "_id bigint, _lat double, _lon double").select(F.col("_id").alias("node"), F.struct(F.col("_lon").alias("lon"), F.col("_lat").alias("lat")).alias("p"))
    head = f"_id bigint, _version int, _timestamp string, tag {tag}"
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(tag)), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")
    ways = of("way", f"{head}, nd array<struct<_ref: bigint>>")
    refs = ways.select("_id", F.posexplode("nd").alias("pos", "nd")).select("_id", "pos", F.col("nd._ref").alias("node"))
    lines = refs.join(nodes, "node").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("geometry"))
    lines = ways.select("_id", "_version", "_timestamp", tags).join(lines, "_id")
    empty = F.lit(None).cast(f"array<struct<type: string, ref: bigint, role: string, geometry: array<{_POINT}>>>")
    as_ways = lines.select(F.lit("way").alias("type"), F.col("_id").alias("id"), "tags", F.col("_version").alias("version"), F.col("_timestamp").alias("timestamp"), "geometry", empty.alias("members"))
    relations = of("relation", f"{head}, member array<struct<_type: string, _ref: bigint, _role: string>>")
    member = relations.select("_id", F.explode("member").alias("m")).select("_id", F.col("m._type").alias("type"), F.col("m._ref").alias("ref"), F.col("m._role").alias("role"))
    with_lines = member.join(lines.select(F.col("_id").alias("ref"), "geometry"), "ref", "left").groupBy("_id").agg(F.collect_list(F.struct("type", "ref", "role", "geometry")).alias("members"))
    as_relations = relations.select("_id", "_version", "_timestamp", tags).join(with_lines, "_id").select(
        F.lit("relation").alias("type"), F.col("_id").alias("id"), "tags", F.col("_version").alias("version"), F.col("_timestamp").alias("timestamp"), F.lit(None).cast(f"array<{_POINT}>").alias("geometry"), "members"
    )
    return read_footprints(as_ways.unionByName(as_relations))


def read_reference_buildings(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """reference, use, construction_year, dwellings, floors, west, south, east, north of cadastral buildings,
    those that touch the box if one is given. Floors are the most of a building's parts."""

    def of(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)

    b = of("Building", "reference string, currentUse string, beginning string, numberOfDwellings int, posList string")
    numbers = F.transform(F.filter(F.split("posList", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = b.withColumn("n", numbers)
    lon = F.filter("n", lambda x, i: i % 2 == 0)
    lat = F.filter("n", lambda x, i: i % 2 == 1)
    year = F.regexp_extract("beginning", r"^([0-9]{4})", 1).try_cast("int")
    out = rows.select(
        "reference", F.col("currentUse").alias("use"), F.when(year >= 1000, year).alias("construction_year"), F.col("numberOfDwellings").alias("dwellings"),
        F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"),
    )
    if bbox:
        out = out.where((F.col("east") >= bbox[0]) & (F.col("west") <= bbox[2]) & (F.col("north") >= bbox[1]) & (F.col("south") <= bbox[3]))
    parts = of("BuildingPart", "localId string, numberOfFloorsAboveGround int")
    floors = parts.groupBy(F.split("localId", "_part")[0].alias("reference")).agg(F.max("numberOfFloorsAboveGround").alias("floors"))
    return out.join(floors, "reference", "left")
