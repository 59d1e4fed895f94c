"""Sinks: CSV, GeoJSON, GeoParquet columns, map XML, text lines. Each is an ordinary distributed write."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """The columns in order, with a header; lists become text joined with ``;``."""
    kinds = dict(df.dtypes)
    df.select(*[F.concat_ws(";", c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]).write.csv(path, header=True)


def features(df: DataFrame, key: str, geometry: str) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    rest = [c for c in df.columns if c not in (key, geometry)]
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), F.col(geometry).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def polygon_geometry(polygons: Column) -> Column:
    return F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def write_geojson(df: DataFrame, key: str, geometry: str, path: str) -> None:
    """Newline-delimited features."""
    features(df, key, geometry).write.text(path)


def _wkb(polygons: list | None) -> bytes | None:
    if polygons is None:
        return None
    out = [struct.pack("<BII", 1, 6, len(polygons))]
    for rings in polygons:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            out.append(struct.pack("<I", len(ring)))
            out.extend(struct.pack("<dd", *p[:2]) for p in ring)
    return b"".join(out)


def multipolygon_wkb(geometry: Column) -> Column:
    """Well-known binary of polygons -> rings -> points."""

    @arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([_wkb(x) for x in values.to_pylist()], pa.binary())

    return encode(geometry)


def geo_metadata(column: str) -> str:
    """The GeoParquet description of a geometry column."""
    return json.dumps({"version": "1.0.0", "primary_column": column, "columns": {column: {"encoding": "WKB", "geometry_types": ["MultiPolygon"]}}})


def _store(path: str, default: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, by its scheme or else that of the cluster's default file system."""
    if "://" not in path and not path.startswith("file:"):
        if default.startswith("file:"):
            return fs.LocalFileSystem(), os.path.abspath(path)
        path = default.rstrip("/") + path
    return (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def write_geoparquet(df: DataFrame, geometry: str, path: str) -> None:
    """GeoParquet: the geometry as WKB, and its description in the footer of every part. Spark's writer can't
    set footer keys, so the tasks write their parts themselves, each attempt under a name of its own, and tell
    the driver which. When all are done the driver removes what is there besides these: parts of an earlier
    table at ``path``, and those of attempts that were lost or came second. A job that fails leaves the earlier
    table's parts where they are. A path without a scheme is in the cluster's default file system; if that is a
    local one, all executors have to share the folder."""
    rows = df.withColumn(geometry, multipolygon_wkb(F.col(geometry)))
    described, run = geo_metadata(geometry), uuid.uuid4().hex[:12]
    default = str(df.sparkSession._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _store(path, default)
        store.create_dir(base, recursive=True)
        name, writer = f"part-{task.partitionId():05d}-{run}-{task.taskAttemptId()}.parquet", None
        for batch in batches:
            if writer is None:
                schema = batch.schema.with_metadata({"geo": described})
                # readers pass over names that begin with a line
                writer = pq.ParquetWriter(f"{base}/_{name}", schema, filesystem=store)
            writer.write_table(pa.Table.from_batches([batch]).cast(schema))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([name], pa.string())], names=["name"])

    written = {r.name for r in rows.mapInArrow(part, "name string").collect()}  # a name for each part
    store, base = _store(path, default)
    store.create_dir(base, recursive=True)
    for f in store.get_file_info(fs.FileSelector(base)):
        ours = f.base_name.removeprefix("_") in written
        if f.type == fs.FileType.File and not ours and re.match(r"_?part-", f.base_name):
            store.delete_file(f.path)
    for name in sorted(written):
        store.move(f"{base}/_{name}", f"{base}/{name}")
    if not written:  # a table without rows has a part all the same, which says what it would hold
        schema = to_arrow_schema(rows.schema).with_metadata({"geo": described})
        pq.write_table(schema.empty_table(), f"{base}/part-00000-{run}.parquet", filesystem=store)


#: Rings of a correction and corners of a ring that ids leave room for.
RINGS, CORNERS = 100_000, 1_000_000


def correction_nodes(corrections: DataFrame) -> DataFrame:
    """osm_id, way, pos, node, lon, lat of accepted outlines: new elements have negative ids, made of the
    correction's number and the corner's. ``corrections``: osm_id, number, geometry."""
    rings = corrections.select("osm_id", "number", F.posexplode(F.flatten("geometry")).alias("ring", "points"))
    points = rings.select("osm_id", "number", "ring", F.posexplode(F.slice("points", 1, F.size("points") - 1)).alias("pos", "p"))
    way = -(F.col("number") * RINGS + F.col("ring") + 1)
    return points.select("osm_id", way.alias("way"), "pos", (way * CORNERS - F.col("pos")).alias("node"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def write_corrections_xml(corrections: DataFrame, path: str) -> None:
    """Map XML of corrections under ``path``/nodes and ``path``/ways, marked as never to be uploaded."""
    nodes = correction_nodes(corrections)
    mark = F.lit("never").alias("_upload")
    out = nodes.select(F.col("node").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), mark)
    out.write.format("xml").option("rowTag", "node").option("rootTag", "osm").save(f"{path}/nodes")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: F.struct(x["node"].alias("_ref")))
    ways = nodes.groupBy("way", "osm_id").agg(F.concat(refs, F.slice(refs, 1, 1)).alias("nd"))
    tag = F.array(F.struct(F.lit("corrects").alias("_k"), F.col("osm_id").alias("_v"))).alias("tag")
    ways.select(F.col("way").alias("_id"), mark, "nd", tag).write.format("xml").option("rowTag", "way").option("rootTag", "osm").save(f"{path}/ways")
