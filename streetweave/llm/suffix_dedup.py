"""Removal of long byte strings that occur twice: suffixes sampled by a difference cover.

A difference cover D of a period v holds, for any two positions i and j, a k < v with both i + k
and j + k (taken modulo v) in D. So if the ``length`` bytes at i and j agree, some aligned pair of
*sampled* suffixes agrees on the ``length - v + 1`` bytes after it. That is the sampling of the
difference-cover suffix array construction; since only common prefixes of ``length`` bytes matter,
the order of the suffixes is needed to that depth alone and one recursion suffices:

1. *Sort the sampled tuples.* Sampled positions are named by the bytes after them; buckets sort the
   names and mark those that occur again. A position whose name is unique is out, and with it every
   suffix that reaches none but such positions within v bytes.
2. *Recurse on names.* The sampled positions left get longer names, of the text from a period before
   them to ``length`` bytes after, as far as the document goes. Where such a name occurs again, all
   suffixes inside with ``length`` bytes repeat; within long matches this settles all of them.
3. *Merge the remaining suffixes.* Every suffix, sampled or not, that reaches a name of step 1 and
   isn't such a later copy gets the name of its prefix of ``length`` bytes; buckets sort these.
4. *Compare adjacent prefixes.* Equal neighbours in that order begin repeated strings.

Of equal names in step 2 the first, by block and position, stays in play: its suffixes are sorted in
step 3, so that others can meet them there. A suffix inside a later one has an equal at an earlier
place, and that one either is sorted or has itself an equal at an earlier place.

Names of step 1 are 64-bit fingerprints: equal ones of different strings cost work and change nothing.
What is decided by names (steps 2 to 4) takes two independent ones, 96 bits in all: a polynomial
modulo 2 ** 64, and one modulo the prime 2 ** 32 - 5, for which no strings of ``length`` bytes are
alike by structure. The bytes themselves are not compared again.

A block sends each distinct name once, in order, with a bit that tells whether it has it twice, and
gets bits back in that order; so one string repeated over a whole text costs one entry. Blocks stay
where they are (:mod:`streetweave.llm.blocks`), names and bits travel.

The period is the largest q * q + q + 1 (q prime) that leaves a name of a third of ``length``: 133 for
200 bytes, of which the cover holds 12, so step 1 looks at a tenth of all suffixes where the classic
period of three would sort two thirds of them.

Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are separate
documents, so each removes the other; an empty table gives an empty result; null ids are kept. A
document is worked on whole within a task, at some 100 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.blocks import Block, Blocks, buckets_of, classes, mixed, pack
from streetweave.llm.shared import land

_BASE, _BASE_2 = 0xD1342543DE82EF95, 0x9E3779B1
_PRIME = np.uint64((1 << 32) - 5)
_KEYS = "bucket int, block_id long, data binary"
_MARKS = "block_id long, bucket int, bits binary"
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@lru_cache
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): a perfect difference set modulo v = q * q + q + 1, closed under multiplication by q."""
    q = max((q for q in (2, 3, 5, 7, 11, 13) if q * q + q + 1 <= length * 2 // 3), default=0)
    if not q:
        return 1, (0,)
    v = q * q + q + 1
    orbits = sorted({tuple(sorted({x, x * q % v, x * q * q % v})) for x in range(v)})

    def grow(chosen: tuple[int, ...], first: int) -> tuple[int, ...] | None:
        differences = [(a - b) % v for a in chosen for b in chosen if a != b]
        if len(differences) != len(set(differences)) or len(chosen) > q + 1:
            return None
        if len(chosen) == q + 1:
            return chosen
        for k in range(first, len(orbits)):
            if found := grow(chosen + orbits[k], k + 1):
                return found
        return None

    found = grow((), 0)
    assert found, v
    return v, found


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=2)
def _prime_powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(_PRIME))) % _PRIME])
    return out


class Rolling:
    """Two hashes of any stretches of a byte string, from one pass over it."""

    def __init__(self, text: np.ndarray):
        self._symbols, n = text.astype(np.uint64) + np.uint64(1), len(text)
        self._inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._symbols * _powers(_BASE, n)[:n], out=self._sums[1:])

    def first(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits, modulo 2 ** 64."""
        return mixed((self._sums[end] - self._sums[begin]) * self._inverse[begin] + (end - begin).astype(np.uint64))

    @cached_property
    def _remainders(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the symbols times powers, modulo the prime, and the inverse powers."""
        n = len(self._symbols)
        size = 1 << max(10, (n + 1).bit_length())
        sums, powers = np.zeros(n + 1, np.uint64), _prime_powers(_BASE_2, size)
        for first in range(0, n, 1 << 22):  # a part's sum stays below 2 ** 64
            part = slice(first, min(n, first + (1 << 22)))
            sums[part.start + 1 : part.stop + 1] = (np.cumsum(self._symbols[part] * powers[part]) + sums[part.start]) % _PRIME
        return sums, _prime_powers(pow(_BASE_2, -1, int(_PRIME)), size)

    def second(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """32 bits, modulo the prime."""
        sums, inverse = self._remainders
        return ((sums[end] + _PRIME - sums[begin]) % _PRIME * inverse[begin] % _PRIME).astype(np.uint32)


class _Names:
    """The distinct names of a block in the order in which they are sent, and which one each row has."""

    def __init__(self, columns: list[np.ndarray], n_buckets: int):
        self.of, firsts = classes(columns, columns[0])  # in the order of the first column, and so of the buckets
        self.firsts, self.columns = firsts, [c[firsts] for c in columns]
        bucket = buckets_of(self.columns[0], n_buckets)
        self.buckets, at = np.unique(bucket, return_index=True)
        self.at = np.append(at, len(firsts))

    def rows(self, block_id: int) -> pa.RecordBatch:
        """A row for each bucket: the number of names, the bits of those that the block has twice, the columns."""
        twice = np.bincount(self.of, minlength=len(self.firsts)) > 1
        blobs = []
        for a, b in zip(self.at[:-1], self.at[1:], strict=True):
            blobs.append(b"".join([np.uint64(b - a).tobytes(), np.packbits(twice[a:b]).tobytes(), *(c[a:b].tobytes() for c in self.columns)]))
        columns = [pa.array(self.buckets.astype(np.int32)), pa.array(np.full(len(blobs), block_id), pa.int64()), pa.array(blobs, pa.binary())]
        return pa.record_batch(columns, names=["bucket", "block_id", "data"])

    def marked(self, marks: pa.Table) -> np.ndarray:
        """Two planes of marks for each name: found again, and found in an earlier block."""
        out = np.zeros((2, len(self.firsts)), bool)
        place = np.searchsorted(self.buckets, marks["bucket"].to_numpy().astype(self.buckets.dtype))
        for k, bits in zip(place, marks["bits"].to_pylist(), strict=True):
            a, b = self.at[k], self.at[k + 1]
            out[:, a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (b - a)).reshape(2, -1)
        return out


def _judged(keys: DataFrame, second: bool, name: str) -> DataFrame:
    """Sort the names of each bucket and mark, for each block, those that equal another: neighbours."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id")
        twice, firsts, seconds, sizes = [], [], [], []
        for x in table["data"].to_pylist():
            n = int(np.frombuffer(x, "<u8", 1)[0])
            at = 8 + (n + 7) // 8
            twice.append(np.unpackbits(np.frombuffer(x, np.uint8, at - 8, 8), count=n))
            firsts.append(np.frombuffer(x, "<u8", n, at))
            seconds.append(np.frombuffer(x, "<u4", n, at + 8 * n) if second else np.zeros(0, np.uint32))
            sizes.append(n)
        columns = [np.concatenate(firsts), *[np.concatenate(seconds)] * second]
        of, heads = classes(columns, columns[0])
        out = np.zeros((2, len(of)), bool)
        out[0] = np.bincount(of, weights=1.0 + np.concatenate(twice))[of] > 1
        out[1] = np.arange(len(of)) != heads[of]  # the sort is stable: the head is of the earliest block
        parts = np.split(out, np.cumsum(sizes)[:-1], axis=1)
        some = [k for k, v in enumerate(parts) if v.any()]
        return pa.table(
            {
                "block_id": table["block_id"].take(pa.array(some, pa.int64())),
                "bucket": table["bucket"].take(pa.array(some, pa.int64())),
                "bits": pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary()),
            }
        )

    return land(keys.groupBy("bucket").applyInArrow(bucket, _MARKS), name)


def _with_marks(blocks: Blocks, marks: DataFrame, work: Callable[[int, Block, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(block_id, block, marks of the block)`` for every block."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = zip(left["block_id"].to_pylist(), left["data"], strict=True)
        return pa.Table.from_batches([work(block_id, Block(data.as_py()), right) for block_id, data in rows])

    return blocks.table.groupBy("block_id").cogroup(marks.groupBy("block_id")).applyInArrow(pair, schema)


class _Suffixes:
    """The suffixes of a block that matter, and their names."""

    def __init__(self, block: Block, length: int):
        self.block, self.length = block, length
        self.period, cover = difference_cover(length)
        lens = block.ends - block.starts
        self.left = np.repeat(block.ends, lens) - np.arange(block.n)  # bytes from here to the document's end
        table = np.zeros(self.period, bool)
        table[list(cover)] = True
        offset = (np.arange(block.n) - np.repeat(block.starts, lens)) % self.period
        self.depth = length - self.period + 1
        self.sampled = np.flatnonzero(table[offset] & (self.left >= self.depth))
        self.rolling = Rolling(block.bytes)

    def sample_names(self, n_buckets: int) -> _Names:
        return _Names([self.rolling.first(self.sampled, self.sampled + self.depth)], n_buckets)

    def names(self, begin: np.ndarray, end: np.ndarray, n_buckets: int) -> _Names:
        return _Names([self.rolling.first(begin, end), self.rolling.second(begin, end)], n_buckets)

    def remaining(self, repeated: np.ndarray) -> np.ndarray:
        """Suffixes that reach a repeated sampled name, and hold ``length`` bytes."""
        at = self.sampled[repeated]
        reach = np.zeros(self.block.n + 1, np.int32)
        np.add.at(reach, np.maximum(at - self.period + 1, 0), 1)
        np.add.at(reach, at + 1, -1)
        return np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (self.left >= self.length))

    def stretch(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Around each repeated sampled suffix, the text from a period before it to a prefix after it,
        within its document; at least ``length`` bytes."""
        at = self.sampled[repeated]
        first, last = np.searchsorted(self.block.starts, at, "right") - 1, self.left[at] + at
        begin, end = np.maximum(at - self.period + 1, self.block.starts[first]), np.minimum(at + self.length, last)
        whole = end - begin >= self.length
        whole[1:] &= (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])  # clipped at both ends: one and the same
        return begin[whole], end[whole]


def remove_repeated_bytes(docs: DataFrame, length: int = 200, digest: bool = False) -> DataFrame:
    """Each document's bytes without those covered by a string of ``length`` bytes that starts
    anywhere else too. Returns doc_id, n_bytes, n_removed, n_spans and kept (binary), or with
    ``digest`` the lowercase hex SHA-256 of the kept bytes in its place."""
    blocks = pack(docs, "suffixes")
    n = blocks.n_buckets

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, data in zip(batch["block_id"].to_pylist(), batch["data"], strict=True):
                yield _Suffixes(Block(data.as_py()), length).sample_names(n).rows(block_id)

    def stretches(suffixes: _Suffixes, marks: pa.Table):
        """The sampled suffixes found again, and the stretches around them with their names."""
        names = suffixes.sample_names(n)
        repeated = names.marked(of_round(marks, 1))[0][names.of]
        begin, end = suffixes.stretch(repeated)
        return repeated, begin, end, suffixes.names(begin, end, n)

    def recurse(block_id: int, block: Block, marks: pa.Table) -> pa.RecordBatch:
        return stretches(_Suffixes(block, length), marks)[-1].rows(block_id)

    def merge(block_id: int, block: Block, marks: pa.Table) -> pa.RecordBatch:
        return remaining(_Suffixes(block, length), marks)[0].rows(block_id)

    def remaining(suffixes: _Suffixes, marks: pa.Table):
        """Names and starts of the suffixes to merge, and which suffixes are known to repeat."""
        repeated, begin, end, names = stretches(suffixes, marks)
        again, earlier = names.marked(of_round(marks, 2))
        later = earlier[names.of] | (np.arange(len(begin)) != names.firsts[names.of])
        again = again[names.of]
        known, copied = inside(suffixes, begin[again], end[again]), inside(suffixes, begin[later], end[later])
        starts = suffixes.remaining(repeated)
        starts = starts[~copied[starts]]
        return suffixes.names(starts, starts + length, n), starts, known

    def inside(suffixes: _Suffixes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The suffixes with ``length`` bytes inside the given stretches."""
        count = np.zeros(suffixes.block.n + 1, np.int32)
        np.add.at(count, begin, 1)
        np.add.at(count, end - length + 1, -1)
        return np.cumsum(count[:-1]) > 0

    def of_round(marks: pa.Table, k: int) -> pa.Table:
        return marks.filter(pa.array(marks["round"].to_numpy(zero_copy_only=False) == k, pa.bool_()))

    names = _judged(blocks.table.mapInArrow(sample, _KEYS), False, "suffix-names").withColumn("round", F.lit(1))
    longer = _judged(_with_marks(blocks, names, recurse, _KEYS), True, "suffix-stretches").withColumn("round", F.lit(2))
    both = names.union(longer)
    prefixes = _judged(_with_marks(blocks, both, merge, _KEYS), True, "suffix-prefixes").withColumn("round", F.lit(3))

    def cut(block_id: int, block: Block, marks: pa.Table) -> pa.RecordBatch:
        names, starts, repeats = remaining(_Suffixes(block, length), marks)
        repeats[starts[names.marked(of_round(marks, 3))[0][names.of]]] = True
        cover = np.zeros(block.n + 1, np.int32)
        at = np.flatnonzero(repeats)
        cover[at] += 1
        cover[at + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = block.starts[block.ends > block.starts]
        begins[heads] = gone[heads]
        removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
        kept = [block.bytes[b:e][~gone[b:e]].tobytes() for b, e in zip(block.starts, block.ends, strict=True)]
        return pa.record_batch(
            [
                pa.array(block.doc_ids, pa.int64()),
                pa.array(block.ends - block.starts, pa.int64()),
                pa.array(removed[block.ends] - removed[block.starts], pa.int64()),
                pa.array(spans[block.ends] - spans[block.starts], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
        )

    return _with_marks(blocks, both.union(prefixes), cut, _DIGEST if digest else _SCHEMA)
