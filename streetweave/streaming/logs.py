"""The logs as streams: state of work, progress, readiness, reviews, thinning. Each stream's last word per
key equals what the batch operator says of the whole log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streetweave.operators.logs import RATE_WINDOW
from streetweave.operators.spatial import far_captures
from streetweave.sources.landing import remove


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Degrees of the grid cells in which kept captures lie.
KEPT_CELL_DEG = 0.05


def stream_ledger_state(stream: DataFrame) -> DataFrame:
    """stage, image, status, seq of the latest entry; run in update mode."""
    last = stream.groupBy("stage", "image").agg(F.max_by(F.struct("status", "seq"), "seq").alias("e"))
    return last.select("stage", "image", "e.status", "e.seq")


class _Keyed(StatefulProcessor):
    """State of one key, entry by entry: a batch reads and writes only the entries that it touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass


def _by_entry(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None")


class _Progress(_Keyed):
    """The last completions as a list of bounded length, and how many there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent, self.n = handle.getListState("recent", "at_ms long, seq long"), handle.getValueState("n", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        recent = [(int(at), int(seq)) for at, seq in self.recent.get()] if self.recent.exists() else []
        n = self.n.get()[0] if self.n.exists() else 0
        for frame in rows:
            n += len(frame)
            recent = sorted([*recent, *zip(frame["at_ms"].tolist(), frame["seq"].tolist(), strict=True)])[-RATE_WINDOW:]
        self.recent.put(recent)
        self.n.update((n,))
        span = (recent[-1][0] - recent[0][0]) / 1000.0
        rate = (len(recent) - 1) / span * 60 if len(recent) > 1 and span > 0 else None
        yield pd.DataFrame({"stage": [key[0]], "completed": [n], "rate_per_minute": pd.Series([rate], dtype="float64")})


def stream_progress(completions: DataFrame) -> DataFrame:
    """stage, completed, rate_per_minute from the last completions, kept as a list of that many.
    ``completions``: stage, at_ms, seq of finished work."""
    return _by_entry(completions, ["stage"], _Progress(), "stage string, completed long, rate_per_minute double")


class _Reviews(_Keyed):
    """A map of attribute to what was said last, and the latest withdrawal, after which entries expire."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said, self.since = handle.getMapState("said", "attribute string", "seq long, value string"), handle.getValueState("since", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        since = before = self.since.get()[0] if self.since.exists() else -1
        new: dict[str, tuple[int, str]] = {}
        for frame in rows:
            for e in frame.itertuples():
                if e.action == "withdraw":
                    since = max(since, int(e.seq))
                elif int(e.seq) > new.get(e.attribute, (-1,))[0]:
                    new[e.attribute] = (int(e.seq), e.value)
        for attribute, entry in new.items():
            old = self.said.getValue((attribute,)) if self.said.containsKey((attribute,)) else None
            if entry[0] > since and (old is None or entry[0] > old[0]):
                self.said.updateValue((attribute,), entry)
        if since > before:
            self.since.update((since,))
            for attribute in [a for (a,), (seq, _) in self.said.iterator() if seq <= since]:
                self.said.removeKey((attribute,))
        review = json.dumps({a: v for (a,), (_, v) in sorted(self.said.iterator())})
        yield pd.DataFrame({"building_id": [key[0]], "review": [review]})


def stream_reviews(events: DataFrame) -> DataFrame:
    """building_id, review (JSON of attribute to value) after each batch: a withdrawal removes what was said
    before it, and a partial review keeps the other attributes."""
    return _by_entry(events, ["building_id"], _Reviews(), "building_id string, review string")


def run_available(stream: DataFrame, path: str, mode: str = "update") -> None:
    """Run a stream over what is there; each batch's rows are written under ``path`` with its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    # keyed state lives in RocksDB, on the executors' disks and in the checkpoint
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()


def last_word(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the latest batch of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _manifests(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[int, dict[int, int]]]:
    """The versions of a table of current states, oldest first: each its number, and which batch wrote each bucket."""
    rows = spark.read.schema("bucket int, written int, batch int").parquet(f"{path}/manifest")
    found: dict[int, dict[int, int]] = {}
    for r in rows.where(F.lit(before is None) | (F.col("batch") < (before or 0))).collect():  # a row for each bucket and version
        found.setdefault(r["batch"], {})[r["bucket"]] = r["written"]
    return sorted(found.items())


def _states(spark: SparkSession, path: str, schema: str, folders: dict[int, int]) -> DataFrame:
    """The rows of some buckets, each as a given batch has written it."""
    if not folders:
        return spark.createDataFrame([], f"{schema}, bucket int")
    by_batch: dict[int, list[int]] = {}
    for bucket, written in folders.items():
        by_batch.setdefault(written, []).append(bucket)
    own = reduce(or_, [(F.col("batch") == k) & F.col("bucket").isin(v) for k, v in by_batch.items()])
    return spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{path}/states").where(own).drop("batch")


def upsert(path: str, keys: list[str], order: str, n_buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch to keep a table of the last row of each key, by ``order``, in the
    shared folder under ``path``; of equal ones the greatest row is the last.

    Keys are hashed to buckets, each with one row per key, so buckets are even. A batch writes the buckets it
    touches anew, as folders with its number, and then a manifest of which folder is the bucket now; readers
    go by the manifest. A batch that is run again reads the manifest before it and replaces its own folders.
    Folders that the last manifest has replaced are removed in the batch after, so a reader that has begun
    has a batch's time to end. ``path`` belongs to one checkpoint."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _manifests(spark, path, number) if number else []
        live = known[-1][1] if known else {}
        if len(known) > 1:
            for bucket, written in known[-2][1].items():
                if live[bucket] != written:
                    remove(spark, f"{path}/states/batch={written:06d}/bucket={bucket}")
            for old, _ in known[:-1]:
                remove(spark, f"{path}/manifest/batch={old:06d}")
        columns = batch.columns
        new = batch.select("*", F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int").alias("bucket"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most n_buckets
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)
        both = new.unionByName(_states(spark, path, schema, {b: live[b] for b in touched if b in live}))
        last = both.groupBy("bucket", *keys).agg(F.max(F.struct(order, *[c for c in columns if c not in (order, *keys)])).alias("__last"))
        last = last.select("bucket", *[c if c in keys else F.col(f"__last.{c}").alias(c) for c in columns])
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/states/batch={number:06d}")
        listed = spark.createDataFrame(sorted((live | dict.fromkeys(touched, number)).items()), "bucket int, written int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number:06d}")

    return add


def run_upsert(stream: DataFrame, path: str, keys: list[str], order: str, n_buckets: int = 32) -> None:
    """Run a stream over what is there, into a table of current states (:func:`upsert`)."""
    writer = stream.writeStream.outputMode("update").foreachBatch(upsert(path, keys, order, n_buckets))
    writer.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def current_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of current states under ``path``, as its last manifest says."""
    known = _manifests(spark, path)
    return _states(spark, path, schema, known[-1][1] if known else {}).drop("bucket")


def run_ready_buildings(log: DataFrame, expected: DataFrame, path: str) -> None:
    """Run a stream of visits over what is there; each batch writes, under ``path`` with its number, building_id,
    done, done_set of the buildings all of whose expected captures are visited, with one done, if the done ones
    have changed; done is nought, and done_set null, where no capture is done any more. ``log``: image_id,
    status, seq; ``expected``: building_id, image_id, no pair twice.

    State is what was said last of each capture (:func:`upsert`, under ``path``-images), so an entry is not
    repeated for the buildings that expect its capture. A batch goes once through the expected views with the
    captures as they were before it and as they are now, however many entries it has."""
    spark, schema = log.sparkSession, "image_id string, status string, seq bigint"
    images = f"{path}-images"
    keep = upsert(images, ["image_id"], "seq")

    def states(before: int) -> DataFrame:
        known = _manifests(spark, images, before) if before else []
        return _states(spark, images, schema, known[-1][1] if known else {}).select("image_id", "status")

    def add(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("image_id").agg(F.max(F.struct("seq", "status")).alias("e"))
        keep(last.select("image_id", "e.status", "e.seq"), number)
        then, now = states(number).withColumnRenamed("status", "was"), states(number + 1).withColumnRenamed("status", "is")
        seen = now.join(then, "image_id", "left")
        was, done = F.coalesce(F.col("was") == "done", F.lit(False)), F.coalesce(F.col("is") == "done", F.lit(False))
        sums = expected.join(seen, "image_id", "left").groupBy("building_id").agg(
            F.count("*").alias("n"), F.count("is").alias("visited"), F.count("was").alias("visited_before"), F.count_if(done).alias("done"),
            F.count_if(was).alias("done_before"), F.count_if(was != done).alias("changed"), F.array_sort(F.collect_set(F.when(done, F.col("image_id")))).alias("ids"),
        )
        before = (F.col("visited_before") == F.col("n")) & (F.col("done_before") > 0)
        told = sums.where((F.col("visited") == F.col("n")) & F.when(before, F.col("changed") > 0).otherwise(F.col("done") > 0))
        mark = F.when(F.col("done") > 0, F.sha2(F.concat_ws(",", "ids"), 256))
        told.select("building_id", "done", mark.alias("done_set")).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    log.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_thin(stream: DataFrame, spacing_m: float, path: str, land: Callable[[DataFrame], DataFrame]) -> None:
    """Keep captures of each batch that are far enough from those kept before and from one another; what is
    kept is appended under ``path``. Captures kept before count as the earliest.

    A batch that is run again reads what the batches before it have kept and replaces what it has written
    itself, so it comes to the same result. What is kept lies in folders of grid cells, and a batch reads
    those of its own captures and the cells around; a capture that comes again has its old position."""
    spark = stream.sparkSession
    kept_columns = "image_id string, captured_at_ms long, lat double, lon double, batch int, cell string"

    def cell(lat: Column, lon: Column) -> Column:
        return F.concat_ws("_", F.floor(lat / KEPT_CELL_DEG), F.floor(lon / KEPT_CELL_DEG))

    def add(batch: DataFrame, number: int) -> None:
        place = F.struct(F.coalesce("captured_at_ms", F.lit(0)).alias("t"), "lat", "lon")
        first = batch.groupBy("image_id").agg(F.min("captured_at_ms").alias("captured_at_ms"), F.min(place).alias("p"))
        new, kept = first.select("image_id", "captured_at_ms", "p.lat", "p.lon"), None
        if number:
            new = land(new)
            around = F.explode(F.array(*[cell(F.col("lat") + a * KEPT_CELL_DEG, F.col("lon") + b * KEPT_CELL_DEG) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
            touched = new.where("lat IS NOT NULL AND lon IS NOT NULL").select(around.alias("cell")).distinct()
            before = spark.read.schema(kept_columns).parquet(path).where(F.col("batch") < number)
            kept = land(before.join(touched, "cell", "left_semi").select("image_id", "lat", "lon"))
            new = new.join(kept.select("image_id"), "image_id", "left_anti")
        out = far_captures(land(new), kept, spacing_m, land).withColumn("cell", cell(F.col("lat"), F.col("lon")))
        out.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/batch={number:06d}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
