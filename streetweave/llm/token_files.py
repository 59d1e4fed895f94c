"""Token ids in binary files: one id array, and document boundaries in Elias-Fano code.

A file set is a Parquet table of segments plus an index. A segment holds some consecutive documents:

========== ======================================================================================
shard, seq  place of the segment in the order of all documents
n_docs      documents in it, of which the first ``n_null`` have no doc_id
ids         the ids of its documents end to end, little-endian, ``width`` bytes each
doc_ids     the doc_ids that aren't null, little-endian 64-bit differences, zstandard
ends        the documents' ends within ``ids``, an :class:`EliasFano` sequence
========== ======================================================================================

The index has the numbers of ids and documents before each segment. So a document's offset in the whole
corpus is its segment's base plus a select in ``ends``, about two bits and the logarithm of the mean
document length per document, and no table of 64-bit offsets exists anywhere. Both readers take the
offsets by select; :func:`documents_at` cuts single documents out of their segments with it.

Documents are in ascending order of doc_id, nulls first; rows with the same doc_id follow in the
order of their texts' hashes and texts. Null texts are empty and hold only the end id. Empty tables
make empty file sets. A text goes to the tokenizer whole, so a task needs some 30 bytes for each byte
of the longest one. Strings of special tokens in a text are what the tokenizer file makes of them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetweave.llm.shared import landing_conf, new_path

#: Ids in a segment before it is closed (a longer document has its own).
SEGMENT_IDS = 4 << 20
#: Characters of the texts that are given to the tokenizer at once, and words that it may keep in its cache.
BATCH_CHARS, CACHED_WORDS = 1 << 12, 300_000
#: Documents of a segment that share a key when single documents are looked up.
LOOKUP = 4096
_SEGMENTS = "shard int, seq int, n_docs long, n_null long, n_ids long, width int, ids binary, doc_ids binary, ends binary"
_DOCS = "shard int, seq int, nth long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, and a sample for select."""

    SAMPLE = 256
    _HEAD = struct.Struct("<QQB")

    def __init__(self, blob: bytes):
        self.n, self.universe, self.low_bits = self._HEAD.unpack_from(blob)
        n_low = (self.n * self.low_bits + 7) // 8
        n_high = (self.n + (self.universe >> self.low_bits) + 1 + 7) // 8
        at = self._HEAD.size
        self._low = np.frombuffer(blob, np.uint8, n_low, at)
        self._high = np.frombuffer(blob, np.uint8, n_high, at + n_low)
        self._sample = np.frombuffer(blob, "<u4", (self.n + self.SAMPLE - 1) // self.SAMPLE, at + n_low + n_high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        high[ones] = 1
        return b"".join(
            [
                cls._HEAD.pack(n, universe, low_bits),
                np.packbits(low.ravel(), bitorder="little").tobytes(),
                np.packbits(high, bitorder="little").tobytes(),
                ones[:: cls.SAMPLE].astype("<u4").tobytes(),
            ]
        )

    def select(self, k: int) -> int:
        """The k-th value, from the sample and at most a few hundred bits after it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        bit, left = int(self._sample[k // self.SAMPLE]), k % self.SAMPLE
        byte = bit // 8
        word = int(self._high[byte]) >> (bit % 8) << (bit % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self._high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - k
        first = k * self.low_bits
        low = int.from_bytes(self._low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (high << self.low_bits) | ((low >> (first % 8)) & ((1 << self.low_bits) - 1))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        low = np.unpackbits(self._low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) + low.astype(np.int64) @ (1 << np.arange(self.low_bits))


class _Encoder:
    """Ids of whole texts by the tokenizers library, whatever the tokenizer."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if hasattr(tokenizer.model, "_resize_cache"):
            tokenizer.model._resize_cache(CACHED_WORDS)  # the library's own cache of merged words
        self._batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # the fast one makes the same ids without offsets
        self.kind = np.dtype("<u2" if max(tokenizer.get_vocab_size(), end_id) < 1 << 16 else "<u4")
        self._end = np.array([end_id], self.kind).tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        first, size = 0, 0
        for last, text in enumerate(texts, 1):
            size += len(text)
            if size >= BATCH_CHARS or last == len(texts):
                for found in self._batch(texts[first:last], add_special_tokens=False):
                    yield np.array(found.ids, self.kind).tobytes() + self._end
                first, size = last, 0


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> _Encoder:
    """One for all tasks of a Python worker: the tokenizer file is parsed once."""
    return _Encoder(path, end_id)


def _segment(shard: int, seq: int, doc_ids: list[int | None], blobs: list[bytes], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(b) // width for b in blobs])
    known = np.array([i for i in doc_ids if i is not None], "<i8")
    zstd = zstandard.ZstdCompressor(level=3)
    values = (
        shard, seq, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), width,
        b"".join(blobs), zstd.compress(np.diff(known, prepend=0).astype("<i8").tobytes()), EliasFano.encode(ends),
    )
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _SEGMENTS.split(", ")])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text of ``docs`` (doc_id, text) with the tokenizer file ``tokenizer``, append
    ``end_id`` to each, and write a file set to ``path``. The tokenizer file is read by the executors."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        blobs: list[bytes] = []
        size = 0
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            for doc_id, blob in zip(batch["doc_id"].to_pylist(), encoder(texts), strict=True):
                ids.append(doc_id)
                blobs.append(blob)
                size += len(blob)
                if size >= SEGMENT_IDS * encoder.kind.itemsize:
                    yield _segment(shard, seq, ids, blobs, encoder.kind.itemsize)
                    seq, ids, blobs, size = seq + 1, [], [], 0
        if ids:
            yield _segment(shard, seq, ids, blobs, encoder.kind.itemsize)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash spreads rows that share a doc_id or have none
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("doc_id"), "h")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")
    with landing_conf(spark):
        ordered.mapInArrow(encode, _SEGMENTS).write.option("compression", "uncompressed").parquet(f"{path}/segments")
        sizes = spark.read.parquet(f"{path}/segments").select("shard", "seq", "n_ids", "n_docs")
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
        inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

        def earlier(column: str, window) -> Column:
            return F.coalesce(F.sum(column).over(window), F.lit(0))

        shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"), F.sum("n_docs").alias("docs"))
        shards = shards.select("shard", earlier("ids", before).alias("ids"), earlier("docs", before).alias("docs"))
        index = sizes.withColumns({"own_ids": earlier("n_ids", inside), "own_docs": earlier("n_docs", inside)}).join(shards, "shard")
        index.select("shard", "seq", "n_docs", (F.col("ids") + F.col("own_ids")).alias("base"), (F.col("docs") + F.col("own_docs")).alias("first_doc")).write.parquet(f"{path}/index")


class _Segment:
    """A segment as read back; the documents' bounds come by select."""

    def __init__(self, row: dict):
        self.ends, self.width, self.ids = EliasFano(row["ends"]), row["width"], memoryview(row["ids"])

    def bounds(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def of(self, first: int, end: int) -> np.ndarray:
        return np.frombuffer(self.ids[first * self.width : end * self.width], f"<u{self.width}").astype("<u4")


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DOCS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            segment, n = _Segment(row), row["n_docs"]
            at = [0, *(segment.ends.select(k) for k in range(n))]
            known = np.cumsum(np.frombuffer(zstandard.decompress(row["doc_ids"]), "<i8"))
            columns = [
                pa.array(np.full(n, row["shard"]), pa.int32()),
                pa.array(np.full(n, row["seq"]), pa.int32()),
                pa.array(np.arange(n), pa.int64()),
                pa.array([None] * row["n_null"] + known.tolist(), pa.int64()),
                pa.array(at[:-1], pa.int64()),
                pa.array(np.diff(at), pa.int64()),
                pa.array([zlib.crc32(segment.of(a, b)) for a, b in pairwise(at)], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(segment.of(0, at[-1]).astype(np.int64))))
            yield pa.record_batch(columns, names=names + ["ids"] * with_ids)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a file set: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), and with ``with_ids`` the ids."""
    segments = spark.read.parquet(f"{path}/segments")
    rows = segments.mapInArrow(lambda it: _read(it, with_ids), _DOCS + ", ids array<long>" * with_ids)
    index = spark.read.parquet(f"{path}/index")
    joined = rows.join(index, ["shard", "seq"])
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def documents_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """position, start and ids of the documents at the positions (``position``, from 0) of ``wanted``, each
    once; positions that no document has give no row. Only the wanted documents' ids are decoded."""
    index, segments = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/segments")
    last = F.col("first_doc") + F.col("n_docs") - 1
    keys = F.explode(F.sequence(F.floor(F.col("first_doc") / LOOKUP), F.floor(last / LOOKUP)))
    ranges = index.select("shard", "seq", "base", "first_doc", last.alias("last_doc"), keys.alias("key"))
    asked = wanted.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    met = asked.withColumn("key", F.floor(F.col("position") / LOOKUP)).join(ranges, "key").where("position BETWEEN first_doc AND last_doc")
    in_segment = met.groupBy("shard", "seq").agg(F.first("base").alias("base"), F.first("first_doc").alias("first_doc"), F.collect_list("position").alias("positions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = _Segment(row)
                bounds = [segment.bounds(p - row["first_doc"]) for p in row["positions"]]
                columns = [
                    pa.array(row["positions"], pa.int64()),
                    pa.array([row["base"] + a for a, _ in bounds], pa.int64()),
                    pa.array([segment.of(a, b).tolist() for a, b in bounds], pa.list_(pa.int64())),
                ]
                yield pa.record_batch(columns, names=["position", "start", "ids"])

    rows = segments.select("shard", "seq", "width", "ids", "ends").join(in_segment, ["shard", "seq"])
    return rows.mapInArrow(cut, "position long, start long, ids array<long>")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write a file set of ``docs`` to the shared folder and return its documents as read back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
