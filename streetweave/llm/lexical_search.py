"""Ranked lexical search for a set of items, over all documents, by buckets of vector lengths.

A document is a vector of impacts, whole numbers that grow with a term's count and shrink with the document's
length; an item is a vector of term weights; the score is their product, in whole numbers. Only terms of items
matter, so documents keep just these:

1. One pass over the texts lands each document's number of terms and its counts of the items' terms.
2. Totals and document frequencies of what has landed give weights and impacts. The vectors are put in order
   of their lengths, the longest first, by range partitions, and cut into buckets of ``BUCKET``.
3. The head of that order is searched first; the scores of rank k are what all other documents have to reach.
   In a task, each item meets bucket after bucket. A bucket is passed over if item length times the bucket's
   greatest length stays below the threshold (Cauchy-Schwarz). Inside, the item's heaviest coordinates are
   multiplied out and the rest is bounded by the lengths of what remains; what could still reach the threshold
   is scored exactly, in 64-bit integers, over all terms. Each task keeps k documents per item, so what is
   ranked at last is k per task and item, less what the thresholds have kept out.

Nothing is approximate: bounds are widened by more than what doubles lose. Items are taken in blocks of at
most ``ENTRIES`` terms or so (an item is never split), which bounds what is sent to tasks; more blocks mean
more passes. A document is counted in slices, so a long text takes the memory of its distinct terms.

Null and empty texts have no terms: as documents they count nowhere, as items they find nothing. Each row is a
document or an item of its own, also when an id repeats. Among equal scores a null doc_id comes last. Empty
tables give no rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from streetweave.llm.shared import discard, land

#: Vectors in a bucket, in a range partition (the longest documents come first, so few), and terms of the
#: items of a block.
BUCKET, PART, ENTRIES = 2048, 8192, 200_000
#: Range partitions at most; beyond, they get larger and are sorted on disk.
MOST_PARTS = 20_000
#: Share of an item's length that its first coordinates leave over, at most.
REST = 0.5
_SLICE = 1 << 20
#: A-Z in lower case; what is no part of a term becomes a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WIDER = 1 + 1e-9


def term_counts(raw: bytes) -> Counter:
    """How often each term occurs in UTF-8 text."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        end = at + _SLICE
        while end < len(raw) and _TERMS[raw[end]] != 32:
            end += 1
        counts.update(raw[at:end].translate(_TERMS).split())
        at = end
    return counts


def _distinct_terms(text: Column) -> Column:
    @arrow_udf("array<string>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(x.decode() for x in term_counts(t.as_py() or b"")) for t in texts.cast(pa.binary())], pa.list_(pa.string()))

    return distinct(text.cast("string"))


def _ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _counting(vocabulary: dict[bytes, int]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, times = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                counts = term_counts(text.as_py() or b"")
                n.append(counts.total())
                known = sorted((vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys())
                terms.append(np.array([t for t, _ in known], np.int64))
                times.append(np.array([f for _, f in known], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _ragged(terms, pa.int32()), _ragged(times, pa.int64())], ["doc_id", "n", "terms", "times"])

    return count


def _weighing(docs: int, length: int) -> Callable:
    """Impacts, and the vector's length, of documents with at least one term of the items."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            if 50 * int(n.max(initial=0)) * docs >= 1 << 63:
                n = n.astype(object)
            m = (50 + (50 * n * docs) // length).astype(np.int64)
            times, offsets = _flat(batch.column(3))
            times = times.astype(np.int64)
            impacts = (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, np.diff(offsets)))
            squares = np.concatenate([[0.0], np.cumsum(impacts.astype(float) ** 2)])
            norm = np.sqrt(squares[offsets[1:]] - squares[offsets[:-1]])
            each = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(impacts, pa.int64()))
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), batch.column(2), each], ["doc_id", "norm", "terms", "impacts"])
            yield rows.filter(pa.array(np.diff(offsets) > 0))

    return weigh


class _Item:
    """An item's terms, heaviest first, and how many of them are multiplied out before the bound."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[order], weights[order]
        left = np.sqrt(np.concatenate([np.cumsum((self.weights.astype(float) ** 2)[::-1])[::-1], [0.0]]))
        self.length = float(left[0])
        self.first = int(np.argmax(left <= REST * self.length))
        self.rest = float(left[self.first])


class _Bucket:
    """Vectors of about one length, by document and by term."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, terms: np.ndarray, impacts: np.ndarray, offsets: np.ndarray):
        self.ids, self.nulls, self.terms, self.impacts, self.offsets = ids, nulls, terms, impacts, offsets
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.by_term, self.rows, self.values = terms[order], rows[order], impacts[order]
        self.squares = np.bincount(rows, impacts.astype(float) ** 2, len(ids))
        self.longest = math.sqrt(float(self.squares.max()))

    def reaching(self, item: _Item, least: int) -> np.ndarray:
        """Documents that could score ``least`` or more."""
        k = item.first
        lo, hi = np.searchsorted(self.by_term, item.terms[:k], "left"), np.searchsorted(self.by_term, item.terms[:k], "right")
        part, used = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for a, b, w in zip(lo.tolist(), hi.tolist(), item.weights[:k].tolist(), strict=True):
            rows, values = self.rows[a:b], self.values[a:b].astype(float)
            part[rows] += w * values
            used[rows] += values * values
        left = np.maximum(self.squares - used + 1e-12 * self.squares, 0.0)
        return np.flatnonzero((part + item.rest * np.sqrt(left)) * _WIDER >= least)

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``weights`` has a place for each term of the vocabulary."""
        sizes = np.diff(self.offsets)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.offsets[rows] - first, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], first)  # no document is without terms


def _best(k: int, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of the k best: falling score, then known before unknown and rising ids."""
    return np.lexsort((ids, null, -score))[:k]


def _searching(items: dict[int, tuple[np.ndarray, np.ndarray]], least: dict[int, int], n_terms: int, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = {q: _Item(*v) for q, v in items.items()}
        kept: dict[int, tuple] = {}
        weights = np.zeros(n_terms, np.int64)
        for bucket in _buckets(batches):
            for q, item in prepared.items():
                old = kept.get(q)
                lowest = max(1, least.get(q, 1), int(old[0][-1]) if old is not None and len(old[0]) == k else 1)
                if item.length * bucket.longest * _WIDER < lowest:
                    continue
                rows = bucket.reaching(item, lowest)
                if not len(rows):
                    continue
                weights[item.terms] = item.weights
                score = bucket.scores(rows, weights)
                weights[item.terms] = 0
                rows, score = rows[score >= lowest], score[score >= lowest]
                found = (score, bucket.nulls[rows], bucket.ids[rows])
                both = found if old is None else tuple(np.concatenate(x) for x in zip(old, found, strict=True))
                best = _best(k, *both)
                kept[q] = tuple(x[best] for x in both)
        for q, (score, null, ids) in kept.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids, pa.int64(), mask=null), pa.array(score)], ["q", "doc_id", "score"])

    return search


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bucket]:
    for batch in batches:
        for first in range(0, batch.num_rows, BUCKET):
            rows = batch.slice(first, BUCKET)
            terms, offsets = _flat(rows.column(1))
            impacts, _ = _flat(rows.column(2))
            ids = rows.column(0)
            yield _Bucket(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), terms, impacts.astype(np.int64), offsets)


def _landed_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[DataFrame, np.ndarray, int] | None:
    """(vectors with doc_id, norm, terms, impacts and part, from the longest on; the weight of each term; the number of parts)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = land(texts.mapInArrow(_counting(vocabulary), "doc_id long, n long, terms array<int>, times array<long>"), "search-counts")
    n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        discard(counted)
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row for each term of the items
        df[r.t] = r["count"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    n_parts = min(MOST_PARTS, math.ceil(n_docs / PART))
    rows = counted.mapInArrow(_weighing(n_docs, length), "doc_id long, norm double, terms array<int>, impacts array<long>")
    # copies have one length: the second key spreads them
    order = [F.desc("norm"), F.xxhash64("doc_id", "terms")]
    ranged = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    vectors = land(ranged, "search-vectors")
    discard(counted)
    return vectors, weights, n_parts


def _top(rows: DataFrame, k: int) -> DataFrame:
    """q, rank, doc_id, score: of shares of an item's rows first, so that no task ranks all of them."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q", share).orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    """q, rank, doc_id, score for items (q, terms)."""
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in block for t in r.terms}))}
    made = _landed_vectors(docs, vocabulary)
    if made is None:
        return None
    vectors, weights, n_parts = made
    ids = {r.q: np.array(sorted(vocabulary[t.encode()] for t in r.terms), np.int64) for r in block}
    items = {q: (t[weights[t] > 0], weights[t][weights[t] > 0]) for q, t in ids.items()}
    items = {q: v for q, v in items.items() if len(v[0])}
    columns = ["doc_id", "terms", "impacts"]

    def search(rows: DataFrame, least: dict[int, int], name: str) -> DataFrame:
        return land(rows.select(*columns).mapInArrow(_searching(items, least, len(vocabulary), k), "q long, doc_id long, score long"), name)

    head = max(1, n_parts // 8)
    first = search(vectors.where(F.col("part") < head), {}, "search-head")
    least = {r.q: int(r.score) for r in _top(first, k).where(F.col("rank") == k).collect()}  # a row for each item of the block
    others = search(vectors.where(F.col("part") >= head), least, "search-rest") if n_parts > 1 else None
    found = land(_top(first if others is None else first.union(others), k), "search-top")
    for used in (vectors, first, others):
        if used is not None:
            discard(used)
    return found


def search(items: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents for each item, or all with a score above nought.
    Eager; what it returns is read from a table in the shared folder."""
    spark = docs.sparkSession
    numbered = land(items.select("item_id", _distinct_terms(items["text"]).alias("terms")).withColumn("q", F.monotonically_increasing_id()), "search-items")
    total = numbered.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(2 * total / ENTRIES))
    found = []
    for b in range(blocks if total else 0):
        block = numbered.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "terms").collect()
        if block and (part := _search_block(docs, block, k)) is not None:
            found.append(part)
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found).join(numbered.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * n * docs) // length AS m FROM d, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
