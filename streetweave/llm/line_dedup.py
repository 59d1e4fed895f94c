"""Removal of lines found in many documents, with levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that hold each, bucketed and sorted by
hash, so that joining it needs no exchange of the run. Batches of documents are added one after another:
a batch's hashes merge-anti-join the runs of hashes known to be frequent (nothing more need be counted
of those) and the rest becomes a run of the lowest level. When a level has gathered ``fanout`` runs they
are merged into one of the next level, and what has reached the limit moves to a frequent run. So each
hash is rewritten once a level, and a new batch costs what the batch is, not what the corpus is. A
manifest in the runs' folder lists the runs after every batch: :meth:`LineRuns.open` goes on from it.

A line's key is the line without ASCII white space at both ends and A-Z lower-cased; hashes have 128
bits. A document is a distinct (doc_id, text): repeated rows count once, and lose their lines alike.
Null and empty texts are one empty line. Blank lines have no key and always stay. Lines of any length
and documents of any number of lines are taken whole. Other columns of the input stay as they are.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.llm.shared import discard, land, land_bucketed, new_path, note, open_bucketed

_WHITE = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]
_COUNTS, _FREQUENT = "h1 bigint, h2 bigint, n_docs bigint", "h1 bigint, h2 bigint"
_MANIFEST = "version int, place int, level int, run string, n_buckets int, min_docs int, fanout int"
#: Frequent hashes up to this number (16 bytes each) are broadcast; more are merge-joined.
BROADCAST_HASHES = 200_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].alias("d1"), F.xxhash64(docs["text"]).alias("d2")]


def line_hashes(docs: DataFrame) -> DataFrame:
    """d1, d2 (the document), pos, h1, h2 of every line that has a key."""
    lines = docs.select(*_document(docs), F.posexplode(text_lines(docs["text"])).alias("pos", "line"))
    keyed = lines.select("d1", "d2", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
    return keyed.select("d1", "d2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The runs of one corpus, in ``folder``."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, folder: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder, self._scratch = folder or new_path(spark, "line-runs"), folder is None
        self.n_buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.levels: list[list[DataFrame]] = []
        self._frequent: list[DataFrame] = []
        self._old: list[DataFrame] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs as the last batch that was added whole has left them."""
        manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
        rows = manifest.where(F.col("version") == manifest.agg(F.max("version")).first()[0]).collect()  # a row for each run
        runs = cls(spark, rows[0]["min_docs"], rows[0]["fanout"], folder)
        runs.n_buckets, runs.version = rows[0]["n_buckets"], rows[0]["version"]
        for r in sorted(rows, key=lambda r: r["place"]):
            columns = _FREQUENT if r["level"] < 0 else _COUNTS
            own = open_bucketed(spark, "lines", f"{folder}/{r['run']}", columns, runs.n_buckets, _HASH)
            if r["level"] < 0:
                runs._frequent.append(own)
                continue
            while len(runs.levels) <= r["level"]:
                runs.levels.append([])
            runs.levels[r["level"]].append(own)
        return runs

    def _run(self, counts: DataFrame) -> DataFrame:
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.n_buckets:
            counts = counts.repartition(self.n_buckets, *_HASH)
        run = land_bucketed(counts, "lines", self.n_buckets, _HASH, sort=_HASH, compression="zstd", path=f"{self.folder}/run-{uuid.uuid4().hex}")
        if self._scratch:
            note(run)
        return run

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs merged two by two, bucket by bucket."""
        merged = runs[0]
        for run in runs[1:]:
            other = run.select(*_HASH, F.col("n_docs").alias("more"))
            both = merged.join(other.hint("merge"), _HASH, "full")
            merged = both.select(*_HASH, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_docs"))
        return merged

    def add(self, lines: DataFrame) -> None:
        """Add a batch of whole documents, as :func:`line_hashes` gives them."""
        # by document first: a line that all documents share is summed up where they are read
        counts = lines.select("d1", "d2", *_HASH).distinct().groupBy(*_HASH).agg(F.count("*").alias("n_docs"))
        for run in self._frequent:
            counts = counts.join(run.hint("merge"), _HASH, "left_anti")
        self._push(0, self._run(counts))
        self._record()

    def _push(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._run(self._merged(self.levels[level]))
            self._old += [*self.levels[level], merged]
            self.levels[level] = []
            self._frequent.append(self._run(merged.where(F.col("n_docs") >= self.min_docs).select(*_HASH)))
            self._push(level + 1, self._run(merged.where(F.col("n_docs") < self.min_docs)))

    def _record(self) -> None:
        """Write the manifest of this version; what it doesn't list is removed then."""
        self.version += 1
        listed = [(-1, r) for r in self._frequent] + [(k, r) for k, level in enumerate(self.levels) for r in level]
        rows = [(self.version, k, level, r._landed_at.rsplit("/", 1)[-1], self.n_buckets, self.min_docs, self.fanout) for k, (level, r) in enumerate(listed)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        for run in self._old:
            discard(run)
        self._old = []

    def frequent(self) -> DataFrame:
        """The hashes of lines found in at least ``min_docs`` documents so far."""
        open_runs = [r for level in self.levels for r in level]
        if not open_runs:
            raise ValueError("no batch has been added")
        known = [r.withColumn("n_docs", F.lit(self.min_docs).cast("long")) for r in self._frequent]
        return self._merged([*open_runs, *known]).where(F.col("n_docs") >= self.min_docs).select(*_HASH)


def _dropped(docs: DataFrame, min_docs: int, batches: int) -> DataFrame:
    """d1, d2 and the positions ``dropped`` of the lines that go, for documents that lose any."""
    batch = F.pmod(F.xxhash64("d2", "d1"), F.lit(batches)).cast("int").alias("batch")
    lines = land(line_hashes(docs).select("*", batch), "lines-hashed", partition_by=["batch"])
    runs = LineRuns(docs.sparkSession, min_docs)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    frequent = land(runs.frequent(), "lines-found")
    if frequent.count() <= BROADCAST_HASHES:
        frequent = F.broadcast(frequent)
    return lines.join(frequent, _HASH, "left_semi").groupBy("d1", "d2").agg(F.collect_set("pos").alias("dropped"))


def _with_dropped(docs: DataFrame, min_docs: int, batches: int, columns: list[Column]) -> DataFrame:
    dropped = _dropped(docs, min_docs, batches).select(F.col("d1").alias("__f1"), F.col("d2").alias("__f2"), F.col("dropped").alias("__dropped"))
    own = docs.select(*columns, *[c.alias(f"__{n}") for c, n in zip(_document(docs), ("d1", "d2"), strict=True)])
    joined = own.join(dropped, own["__d1"].eqNullSafe(dropped["__f1"]) & (own["__d2"] == dropped["__f2"]), "left")
    return joined.drop("__d1", "__d2", "__f1", "__f2")


def _kept(text: Column, dropped: Column) -> Column:
    lines = text_lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4) -> DataFrame:
    """``docs`` with text free of the lines found in at least ``min_docs`` documents."""
    joined = _with_dropped(docs, min_docs, batches, [docs[c].alias(c) for c in docs.columns])
    return joined.withColumn("text", _kept(F.col("text"), F.col("__dropped"))).drop("__dropped")


def line_digest(docs: DataFrame, min_docs: int = 10, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the lines kept, for every document."""
    joined = _with_dropped(docs, min_docs, batches, [docs["doc_id"], docs["text"]])
    return joined.select(
        "doc_id",
        F.size(text_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_kept(F.col("text"), F.col("__dropped")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
