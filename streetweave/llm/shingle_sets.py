"""Links between texts whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Candidates are texts that share one of 24 bands of five minima: of pairs with similarity 0.8 a share of
1 - (1 - 0.8 ** 5) ** 24 = 0.9999 meets in some band, of more similar ones more. Every candidate that
could join two components is verified on the two whole sets, as 64-bit hashes of the shingles.

First each member of a bucket is held against the bucket's first; then, in buckets that still hold more
than one component, members of different components are, inside tasks that get a bounded block of the
bucket and give the links of a forest. So a large group of near copies costs little, and no pairs are
emitted but links. Inside a block a prefix filter leaves only sets that share one of their rarest hashes, so
many texts of a bucket that aren't similar cost next to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from streetweave.llm.components import components
from streetweave.llm.shared import land

BANDS, ROWS = 24, 5
_RANDOM = np.random.default_rng(5)
_FLIP = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_CHUNK = 1 << 8


def _hashes(raw: bytes, words_per_shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a shorter text is one shingle."""
    words = raw.lower().split()
    n = max(1, len(words) - words_per_shingle + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + words_per_shingle])) for i in range(n)), np.uint64, n))


def _bands(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for first in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[first : first + _CHUNK] ^ _FLIP) * _ODD).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def shingle_set(text: Column, words_per_shingle: int) -> Column:
    """The hashes of a text's shingles, each once."""

    @arrow_udf("array<long>")
    def made(texts: pa.Array) -> pa.Array:
        return _lists([_hashes(x.as_py() or b"", words_per_shingle).view(np.int64) for x in texts.cast(pa.binary())])

    return made(text)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def print_set_and_bands(text: Column, words_per_shingle: int, printed) -> Column:
    """An array of a text's fingerprint (``printed`` of its bytes), a hash of the set of its shingles and
    the set's bands, in one pass over the texts."""

    @arrow_udf("array<long>")
    def made(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.cast(pa.binary()):
            raw = x.as_py() or b""
            hashes = _hashes(raw, words_per_shingle)
            row = [printed(raw, words_per_shingle, 42), *np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64), *_bands(hashes)]
            out.append(np.array(row, np.int64))
        return _lists(out)

    return made(text)


def banded(keyed: DataFrame, words_per_shingle: int, printed) -> DataFrame:
    """doc_id, rid, th, fp, sh (hash of the set) and bands of ``keyed`` (doc_id, rid, th, text)."""
    made = keyed.select("doc_id", "rid", "th", print_set_and_bands(F.col("text"), words_per_shingle, printed).alias("s"))
    return land(made.select("doc_id", "rid", "th", F.col("s")[0].alias("fp"), F.col("s")[1].alias("sh"), F.slice("s", 3, BANDS).alias("bands")), "shingle-bands")


def similar_pairs(sets: list[np.ndarray], least: float, wanted: Callable[[int, int], bool] = lambda i, j: True) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets with a Jaccard similarity of ``least`` or more that are ``wanted`` when they come up.

    Prefix filter: in one order of all hashes, the rarest first, sets that are so similar share one of the
    first n - ceil(least * n) + 1 of their n hashes. So only sets that meet in a list of these are compared,
    smaller ones first; sets that have nothing rare in common never are."""
    sizes = np.array([len(x) for x in sets])
    hashes, at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    rare = np.argsort(n, kind="stable")
    rank = np.empty(len(hashes), np.int64)
    rank[rare] = np.arange(len(hashes))
    alone = int(np.searchsorted(n[rare], 2))  # a hash that no other set has can't be shared
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lists: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable").tolist():
        size = int(sizes[i])
        if not size:
            continue
        own = rank[at[ends[i] : ends[i + 1]]]
        met: dict[int, None] = {}
        last = size - math.ceil(least * size - 1e-9)
        prefix = np.partition(own, last)[: last + 1]
        for h in prefix[prefix >= alone].tolist():
            if others := lists.get(h):
                met.update(dict.fromkeys(others))
            lists.setdefault(h, []).append(i)
        for j in met:
            if sizes[j] >= least * size - 1e-9 and wanted(i, j):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= least * (size + int(sizes[j]) - common):
                    yield i, j


def _forest(least: float):
    """Links within a block of a bucket that join its components, by comparing sets of different ones."""

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("sh")
        shs, roots = table["sh"].to_pylist(), table["root"].to_pylist()
        up = {r: r for r in roots}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        us, vs = [], []
        for i, j in similar_pairs([x.values.to_numpy() for x in table["set"]], least, lambda i, j: top(roots[i]) != top(roots[j])):
            up[top(roots[i])] = top(roots[j])
            us.append(shs[j])
            vs.append(shs[i])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return links


def jaccard_links(docs: DataFrame, made: DataFrame, words_per_shingle: int, least: float, blocks) -> DataFrame:
    """Links (u, v) between the ``fp`` of ``docs`` (text), ``made`` of them by ``banded``, that connect those
    of similar sets. ``blocks`` deals (variant, fp) to groups: variant, part, fp."""
    # texts of equal sets need no bucket: one of them stands for all
    heads = land(made.groupBy("sh").agg(F.min("fp").alias("head"), F.min("th").alias("th"), F.first("bands").alias("bands")), "shingle-heads")
    equal = made.select("sh", "fp").distinct().join(heads.select("sh", "head"), "sh").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    rows = heads.select("sh", F.explode("bands").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.min("sh").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    shared = land(rows.join(firsts, "bucket"), "shingle-buckets")

    def sets_of(shs: DataFrame) -> DataFrame:
        wanted = shs.distinct().join(heads.select("sh", "th"), "sh")
        texts = docs.select(F.xxhash64("text").alias("th"), "text").join(wanted, "th").groupBy("sh").agg(F.min("text").alias("text"))
        return land(texts.select("sh", shingle_set(F.col("text"), words_per_shingle).alias("set")), "shingle-sets")

    tried = land(shared.where("sh <> a").select("a", F.col("sh").alias("b")).distinct(), "shingle-tried")
    sets = sets_of(tried.select(F.explode(F.array("a", "b")).alias("sh")))
    both = tried.join(sets.select(F.col("sh").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sh").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = land(both.where(common >= least * (F.size("x") + F.size("y") - common)).select(F.col("a").alias("u"), F.col("b").alias("v")), "shingle-found")
    roots = components(found, "shingle-roots")
    placed = shared.join(roots, shared["sh"] == roots["node"], "left").select("bucket", "sh", F.coalesce("root", "sh").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 AND n > 2").select("bucket")
    rest = land(placed.join(open_, "bucket").select(F.col("bucket").alias("variant"), F.col("sh").alias("fp"), "root").distinct(), "shingle-open")
    if not rest.isEmpty():
        dealt = blocks(rest.select("variant", "fp")).join(rest, ["variant", "fp"])
        whole = dealt.select("variant", "part", F.col("fp").alias("sh"), "root").join(sets, "sh")
        found = found.union(land(whole.groupBy("variant", "part").applyInArrow(_forest(least), "u long, v long"), "shingle-more"))
    head = heads.select("sh", "head")
    named = found.join(head.toDF("u", "hu"), "u").join(head.toDF("v", "hv"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    return equal.union(named)
