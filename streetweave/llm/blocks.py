"""Texts packed into blocks, and Spark rounds in which blocks ask buckets about their keys.

The repeat operators look at almost every position of a corpus. One Spark row per position would
be many times the size of the text, so whole documents are packed into blocks of a few MB, each
task works on arrays inside its block, and only keys travel: a block sends each bucket one row
with its distinct keys, a bucket sees a key of all blocks together, and answers each block in one row.

Blocks, and what blocks keep between rounds, are landed as tables bucketed by ``block_id``. So the
text is exchanged once, when it is packed; later rounds exchange keys and answers only, and a block
meets its answers in the task that reads it. A key that many documents share costs one entry per
block. The number of buckets, and of partitions, grows with the corpus and has no cap but Spark's own
for bucketed tables (``spark.sql.sources.bucketing.maxBuckets``), beyond which a partition holds more
blocks, which are still worked on one by one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.shared import discard, land, land_bucketed

#: Bytes of text in a block (a longer document is a block of its own), for each bucket of keys, and for each partition.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES = 1 << 20, 8 << 20, 16 << 20

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])
#: What a round makes: keys for a bucket, or with bucket -1 what the block keeps.
ROWS = "kind int, block_id long, bucket int, data binary"
ANSWERS = "block_id long, bucket int, data binary"
KEEP, ASK = 0, 1
Row = tuple[int, int, bytes]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
            out.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], schema=_SCHEMA))
        return pa.record_batch([pa.array([(task << 32) | seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block_id", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py() or b""
            if ids and size + len(raw) > BLOCK_BYTES:
                yield block()
                seq, ids, texts, size = seq + 1, [], [], 0
            ids.append(doc_id)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield block()


class Block:
    """The documents of one block: their ids, their bytes end to end, and where each begins."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.doc_ids: list[int | None] = table["doc_id"].to_pylist()
        text = table["text"].chunk(0)
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
        raw = text.buffers()[2]
        self.bytes = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = at[:-1] - at[0], at[1:] - at[0]
        self.n = len(self.bytes)

    def words(self) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The words of all documents, and at which of them the documents begin, with the end."""
        white = np.zeros(256, bool)
        white[[0x20, *range(0x09, 0x0E)]] = True
        gap = np.ones(self.n + 1, bool)  # the last entry closes a word at the very end
        gap[:-1] = white[self.bytes]
        begins, ends = ~gap[:-1], ~gap[:-1] & gap[1:]
        begins[1:] &= gap[:-2]
        some = self.ends > self.starts
        heads, tails = self.starts[some], self.ends[some] - 1
        begins[heads], ends[tails] = ~gap[heads], ~gap[tails]
        first = np.flatnonzero(begins)
        offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - first)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes[~gap[:-1]])])
        return words, np.searchsorted(first, np.append(self.starts, self.n)).astype(np.int64)

    def texts(self) -> list[bytes]:
        raw = self.bytes.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


@dataclass(frozen=True)
class Blocks:
    """The landed blocks, and how many partitions and buckets the corpus has."""

    table: DataFrame
    name: str
    n_parts: int
    n_buckets: int


def pack(docs: DataFrame, name: str) -> Blocks:
    """``docs`` (doc_id, text) as landed blocks. A null text counts as empty."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n_parts = min(most, max(least, total // PART_BYTES + 1))
    packed = rows.mapInArrow(_pack, "block_id long, data binary").repartition(n_parts, "block_id")
    return Blocks(land_bucketed(packed, name, n_parts, "block_id"), name, n_parts, max(least, total // BUCKET_BYTES + 1))


def packed_arrays(**arrays: np.ndarray) -> bytes:
    """Flat arrays by name: a line that says what they are, and then their bytes."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, b"\n", *(np.ascontiguousarray(a).tobytes() for a in arrays.values())]))


def unpacked_arrays(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(data)
    at = raw.index(b"\n") + 1
    out = {}
    for name, kind, n in json.loads(raw[:at]):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out


def _table(block_id: int, rows: Iterable[Row]) -> pa.Table:
    made = list(rows)
    return pa.table(
        {
            "kind": pa.array([k for k, _, _ in made], pa.int32()),
            "block_id": pa.array([block_id] * len(made), pa.int64()),
            "bucket": pa.array([b for _, b, _ in made], pa.int32()),
            "data": pa.array([d for _, _, d in made], pa.binary()),
        }
    )


class Rounds:
    """What the blocks of a corpus keep and ask, round after round; earlier rounds are removed."""

    def __init__(self, blocks: Blocks):
        self.blocks, self.spark = blocks, blocks.table.sparkSession
        self._kept: DataFrame | None = None
        self._asked: DataFrame | None = None
        self._answers: DataFrame | None = None

    def _land(self, rows: DataFrame) -> None:
        old = self._kept
        landed = land_bucketed(rows, f"{self.blocks.name}-round", self.blocks.n_parts, "block_id", "kind", compression="zstd")
        for done in (old, self._answers):
            if done is not None:
                discard(done)
        self._kept, self._answers, self._asked = landed, None, landed.where(F.col("kind") == ASK)

    def begin(self, work: Callable[[Block], Iterable[Row]]) -> None:
        """``work(block)`` gives what a block keeps and asks first."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block_id, data in zip(batch["block_id"].to_pylist(), batch["data"], strict=True):
                    yield from _table(block_id, work(Block(data.as_py()))).to_batches()

        self._land(self.blocks.table.mapInArrow(each, ROWS))

    def answer(self, judge: Callable[[int, list[bytes]], list[bytes | None]]) -> bool:
        """``judge(bucket, what each block asks of it)`` gives an answer for each, or none. False if nothing is asked."""
        if self._asked.isEmpty():
            return False

        def bucket(table: pa.Table) -> pa.Table:
            table = table.sort_by("block_id")
            found = judge(table["bucket"][0].as_py(), table["data"].to_pylist())
            some = [k for k, x in enumerate(found) if x]
            return pa.table(
                {
                    "block_id": table["block_id"].take(pa.array(some, pa.int64())),
                    "bucket": table["bucket"].take(pa.array(some, pa.int64())),
                    "data": pa.array([found[k] for k in some], pa.binary()),
                }
            )

        asked = self._asked.select("bucket", "block_id", "data")
        self._answers = land(asked.groupBy("bucket").applyInArrow(bucket, ANSWERS), f"{self.blocks.name}-answers")
        discard(self._kept, f"kind={ASK}")
        return True

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], ANSWERS)

    def go_on(self, work: Callable[[bytes, dict[int, bytes]], Iterable[Row]]) -> None:
        """``work(kept, answers by bucket)`` gives what a block keeps and asks next."""

        def pair(kept: pa.Table, answers: pa.Table) -> pa.Table:
            told = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
            made = [_table(i, work(d.as_py(), told)) for i, d in zip(kept["block_id"].to_pylist(), kept["data"], strict=True)]
            return pa.concat_tables(made) if made else _table(0, [])

        kept = self._kept.where(F.col("kind") == KEEP).select("block_id", "data")
        answers = self._empty() if self._answers is None else self._answers
        self._land(kept.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(pair, ROWS))

    def end(self, work: Callable[[Block, bytes | None], pa.Table], schema: str) -> DataFrame:
        """``work(block, kept)`` for every block, with the last that it has kept."""

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            kept = right["data"][0].as_py() if len(right) else None
            return pa.concat_tables([work(Block(data.as_py()), kept) for data in left["data"]])

        kept = self._kept.where(F.col("kind") == KEEP).select("block_id", "data")
        return self.blocks.table.groupBy("block_id").cogroup(kept.groupBy("block_id")).applyInArrow(pair, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any of their bits can serve as a bucket."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of some 64-bit columns."""
    h = mixed(columns[0].view(np.uint64))
    for c in columns[1:]:
        h = mixed((h << np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + mixed(c.view(np.uint64)))
    return h


def classes(columns: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the class of each row, the first row of each class): equal rows, told by all their columns; the
    hash only brings them together."""
    order = np.argsort(hashes, kind="stable")

    def new(order: np.ndarray, by: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[:1] = True
        for c in by:
            own = c[order]
            out[1:] |= own[1:] != own[:-1]
        return out

    begins = new(order, columns)
    if begins.sum() != new(order, [hashes]).sum():  # rows with one hash that differ
        order = np.lexsort([*columns, hashes])
        begins = new(order, columns)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(begins) - 1
    return of, order[begins]


def buckets_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def by_bucket(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, the rows that go there), for the buckets that get any."""
    bucket = buckets_of(hashes, n_buckets)
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[own[0]]), own
