"""Near duplicates by SimHash fingerprints, found through deletion variants of segments.

Fingerprints that differ in at most four of 64 bits differ in at most one bit of one of three
segments. A segment with one of its bits wiped out is a variant; two segments that differ in at most
one bit share a variant, so 64 variants of a fingerprint (21 + 21 + 22) find all its partners by
equality. Rows of a variant meet in a partition, and are verified there against the whole
fingerprint.

Equal fingerprints are merged first, so copies cost nothing. A variant that many fingerprints share
is cut into blocks, and pairs of blocks are dealt to separate groups. A small group reports its links
one by one, a larger one ties each member to the first of those it is connected with by links inside
the group: what is connected stays connected, and a group of n yields fewer than n rows.

Null and blank texts have fingerprint zero and are linked like any other. Repeated rows and ties fall
into one component. A null doc_id never names a component unless all its members are null. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from streetweave.llm.components import components
from streetweave.llm.shared import land
from streetweave.llm.shingle_sets import banded, jaccard_links

BITS, DISTANCE = 64, 4
#: (first bit, bits) of the segments: fewer than DISTANCE + 1, so that one differs by one bit at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a variant that meet in one group; more are cut into blocks of this size.
GROUP = 2048
#: In groups up to this size links are reported one by one.
SMALL = 32
_CHUNK = 1 << 16


def _fingerprint(raw: bytes, words_per_shingle: int, seed: int) -> int:
    words = raw.lower().split()
    n = max(1, len(words) - words_per_shingle + 1)
    if not words:
        return 0
    counts = np.zeros(BITS, np.int64)
    for first in range(0, n, _CHUNK):
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[i : i + words_per_shingle]), seed) for i in range(first, min(n, first + _CHUNK))], "<u8"
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: Column, words_per_shingle: int = 4, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text's word shingles, as a signed long."""

    @arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(x.as_py() or b"", words_per_shingle, seed) for x in texts.cast(pa.binary())], pa.int64())

    return simhash(text)


def _variants(prints: DataFrame) -> DataFrame:
    """A row for each fingerprint and wiped bit: the bit's number, and the rest of its segment."""
    made = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        made += [
            segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << k))).bitwiseOR(F.lit((first + k) << 22)) for k in range(bits)
        ]
    return prints.select("fp", F.explode(F.array(*made)).alias("variant"))


def _grouped(variants: DataFrame) -> DataFrame:
    """The variants with the group they meet in: one, or for frequent variants pairs of blocks."""
    frequent = land(variants.groupBy("variant").count().where(F.col("count") > GROUP), "simhash-frequent")
    if frequent.isEmpty():
        return variants.select("variant", F.lit(0).cast("long").alias("part"), "fp")
    blocks = F.ceil(F.col("count") / GROUP)
    cut = variants.join(frequent, "variant", "left").select(
        "variant", "fp", F.coalesce(blocks, F.lit(1)).alias("n"), F.pmod(F.xxhash64("fp"), F.coalesce(blocks, F.lit(1))).alias("own")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = cut.select("variant", "fp", "n", "own", other.alias("other"))
    return dealt.select("variant", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).alias("part"), "fp")


_MASKS = [np.uint64(((1 << bits) - 1) << first) for first, bits in SEGMENTS]


def _linked(a: np.ndarray, b: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
    """Whether fingerprints are within the distance, and ``bit`` is the first variant they share:
    a pair is reported for one variant of one segment."""
    x = a ^ b
    near = np.bitwise_count(x) <= DISTANCE
    first = np.full(x.shape, -1, np.int64)
    for (start, _), mask in reversed(list(zip(SEGMENTS, _MASKS, strict=True))):
        part = x & mask
        ones = np.bitwise_count(part)
        where = np.bitwise_count((part & (~part + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        first = np.where(ones == 0, start, np.where(ones == 1, where, first))
    return near & (first == bit)


def _forest(prints: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tree that the links within a group form, edges from its first member to the others."""
    rest = np.arange(len(prints))
    roots, nodes = [], []
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            for k in range(0, len(frontier), 64):
                hit |= _linked(prints[frontier[k : k + 64], None], prints[None, rest], bit).any(axis=0)
            frontier, rest = rest[hit], rest[~hit]
            nodes.append(frontier)
            roots.append(np.full(len(frontier), root))
    none = np.zeros(0, np.int64)
    return prints[np.concatenate([none, *roots])], prints[np.concatenate([none, *nodes])]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows come sorted by group; a group may go over several batches."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def edges(variant: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (variant[1:] != variant[:-1]) | (part[1:] != part[:-1])])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(fp)))
        group = np.cumsum(new) - 1
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        small = np.flatnonzero((size[group] <= SMALL) & (size[group] > 1))
        for step in range(1, min(SMALL, int(size.max()))):
            at = small[small + step < len(fp)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            at = at[_linked(fp[at], fp[at + step], variant[at] >> 22)]
            us.append(fp[at])
            vs.append(fp[at + step])
        for g in np.flatnonzero(size > SMALL):
            u, v = _forest(np.unique(fp[head[g] : head[g] + size[g]]), int(variant[head[g]]) >> 22)
            us.append(u)
            vs.append(v)
        return pa.record_batch([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"])

    for batch in batches:
        own = [batch["variant"].to_numpy(), batch["part"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)]
        rows = [np.concatenate(x) for x in zip(held, own, strict=True)]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0]
        held = [x[last:] for x in rows]
        if last:
            yield edges(*(x[:last] for x in rows))
    if len(held[0]):
        yield edges(*held)


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all those within the distance."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # fingerprints are small and their variants 64 times that: they are dealt to all tasks before
    grouped = _grouped(_variants(prints.select("fp").distinct().repartition(n, "fp")))
    dealt = grouped.repartition(n, "variant", "part").sortWithinPartitions("variant", "part")
    return dealt.mapInArrow(_links, "u long, v long")


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes, rid and th, that tell the rows of ``docs`` apart but for repeated (doc_id, text)."""
    return [F.xxhash64(docs["doc_id"], docs["text"]).alias("rid"), F.xxhash64(docs["text"]).alias("th")]


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, least_jaccard: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): each document's doc_id, rid, th and fingerprint ``fp``, and for each
    fingerprint the least doc_id that has it, ``first_id``, and the least of its component,
    ``component_id``. With ``least_jaccard``, documents whose shingle sets are that similar are linked
    too, however far apart their fingerprints are."""
    keyed = docs.select("doc_id", *_row_keys(docs), "text")
    if least_jaccard is None:
        prints = land(keyed.select("doc_id", "rid", "th", fingerprint(F.col("text"), words_per_shingle).alias("fp")), "simhash-prints")
    else:
        prints = banded(keyed, words_per_shingle, _fingerprint)
    firsts = land(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    edges = links(firsts)
    if least_jaccard is not None:
        edges = edges.union(jaccard_links(docs.select("text"), prints, words_per_shingle, least_jaccard, _grouped))
    roots = components(edges, "simhash-links")
    with_root = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = with_root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, with_root.join(least, "root").select("fp", "first_id", "component_id", "root")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints, classes = near_duplicates(docs)
    joined = prints.join(classes.select("fp", "component_id"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 4, least_jaccard: float | None = None) -> DataFrame:
    """One document of each component with all its columns: that of the least doc_id, of several the one
    of the least fingerprint and then of the least text hash."""
    prints, classes = near_duplicates(docs, words_per_shingle, least_jaccard)
    named = prints.select("doc_id", "rid", "th", "fp").join(classes.select("fp", "component_id", "root"), "fp")
    least = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", "th", "rid")).alias("k"))
    kept = land(least.select("k.rid", "k.th"), "simhash-kept")
    # the columns travel as one, so that none of their names can clash
    rows = docs.select(*_row_keys(docs), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = rows.join(kept, ["rid", "th"], "left_semi")
    # repeated rows are sorted side by side by the join
    order = F.row_number().over(Window.partitionBy("rid", "th").orderBy("rid"))
    return found.withColumn("n", order).where("n = 1").select("row.*")
