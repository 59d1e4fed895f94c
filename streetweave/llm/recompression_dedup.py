"""Removal of word passages that an earlier document holds too, found by recompression.

Recompression shortens sequences in Spark rounds. A round names the maximal runs of equal symbols and
the adjacent pairs whose first symbol falls in one half of the alphabet and whose second in the other.
Names are global: blocks send their distinct runs and pairs to buckets, a bucket sees each of them from
all blocks and numbers those that occur twice or more. So equal substrings get equal symbols, except
near their ends, and unequal ones never do, because a name stands for one content and nothing is
judged by a fingerprint. A run or pair that occurs once in the corpus gets no name; it parts what
stands left of it from what stands right.

How near the ends is followed exactly: each symbol carries the stretch of words that it depends on (its
own, and those of the neighbours that decided how it was cut). A passage that occurs twice holds, with
every symbol whose stretch lies inside it, that symbol twice. Therefore:

1. *Name the words.* Every passage with a word that occurs once is out.
2. *Recompress.* After each round every passage that holds the stretch of an unnamed symbol is out, and
   words that no passage left covers become separators, so rounds get cheap where nothing repeats.
   Symbols that depend on more words than a passage has, or on what lies beyond the document, tell
   nothing and become separators too. The rounds end when no symbol is left, or after ``ROUNDS``: high
   symbols have revealed where long repeats may be, and further rounds would only save work below.
3. *Verify.* What is left is named by the same rounds up to the whole passage: strings of 4 words by
   their words, of 16 by four of 4, and so on. In the last round the buckets tell the least doc_id of
   each passage.
4. *Cut.* Blocks drop the words of passages that a smaller doc_id has.

Null texts have no words. A null doc_id counts as larger than all others; rows that share a doc_id
don't remove each other. Documents shorter than the window lose nothing; empty tables stay empty. A
document is worked on whole within a task, at some 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from streetweave.llm.blocks import ASK, KEEP, Block, Rounds, Row, by_bucket, classes, hash_of, mixed, pack, packed_arrays, unpacked_arrays

#: Rounds of recompression at most, and how many names the next longer string is made of.
ROUNDS, STRIDE = 4, 4
_LAST = np.iinfo(np.int64).max
_TEXTS = "doc_id long, n_words long, n_removed long, text string"
_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
State = dict[str, np.ndarray]


# what blocks ask and buckets answer


def _buffers(words: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Where the words begin and end in their bytes, and the bytes."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    return at, memoryview(words.buffers()[2] or b"")


def _asked_words(words: pa.DictionaryArray, n_buckets: int) -> Iterator[Row]:
    """The distinct words of a block, to the buckets of their hashes: places, whether twice here, bytes."""
    n = len(words.dictionary)
    twice = (np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=n) > 1).astype(np.uint8)
    at, data = _buffers(words.dictionary)
    sizes = np.diff(at)
    # any hash of a word will do that all blocks agree on: a polynomial in its bytes
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], sizes)
    terms = (np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mixed(np.add.reduceat(terms, at[:-1] - at[0]) if n else np.zeros(0, np.uint64))
    order = np.argsort(hashes, kind="stable")
    at, data = _buffers(words.dictionary.take(pa.array(order)))
    sizes, first = sizes[order].astype("<u4"), 0
    for bucket, own in by_bucket(hashes[order], n_buckets):  # consecutive, as a bucket is a range of hashes
        part = slice(first, first := first + len(own))
        yield ASK, bucket, b"".join([struct.pack("<I", len(own)), order[part].astype("<u4").tobytes(), twice[order[part]].tobytes(), sizes[part].tobytes(), data[at[part.start] : at[part.stop]]])


def _name(bucket: int, rank: np.ndarray) -> np.ndarray:
    """Names above zero that no other bucket gives."""
    return (np.uint64(bucket) << np.uint64(36)) + rank.astype(np.uint64) + np.uint64(1)


def _named(bucket: int, of: np.ndarray, twice: np.ndarray, places: list[np.ndarray]) -> list[bytes | None]:
    """For each block the places and names of its keys, classes ``of``, that occur twice or more."""
    often = np.bincount(of, weights=1.0 + twice) > 1
    names = np.where(often, _name(bucket, np.cumsum(often)), 0).astype("<u8")[of]
    out, at = [], 0
    for own in places:
        n = names[at : at + len(own)]
        at += len(own)
        out.append(own[n > 0].tobytes() + n[n > 0].tobytes())
    return out


def _name_words(bucket: int, blobs: list[bytes]) -> list[bytes | None]:
    places, twice, offsets, texts, base = [], [], [np.zeros(1, np.int64)], [], 0
    for b in blobs:
        n = struct.unpack_from("<I", b)[0]
        places.append(np.frombuffer(b, "<u4", n, 4))
        twice.append(np.frombuffer(b, np.uint8, n, 4 + 4 * n))
        ends = base + np.cumsum(np.frombuffer(b, "<u4", n, 4 + 5 * n), dtype=np.int64)
        texts.append(b[4 + 9 * n :])
        offsets.append(ends)
        base = int(ends[-1])
    words = pa.Array.from_buffers(pa.large_binary(), sum(map(len, places)), [None, pa.py_buffer(np.concatenate(offsets)), pa.py_buffer(b"".join(texts))])
    return _named(bucket, words.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.concatenate(twice), places)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then all second bytes and so on: names have many bytes in common."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _asked(columns: list[np.ndarray], firsts: np.ndarray, more: np.ndarray, hashes: np.ndarray, n_buckets: int) -> Iterator[Row]:
    """The distinct keys of a block (rows ``firsts`` of the columns): places, ``more`` of each, columns."""
    zstd = zstandard.ZstdCompressor(level=1)
    for bucket, own in by_bucket(hashes[firsts], n_buckets):
        values = [own.astype("<u4"), more[own], *(c[firsts[own]].astype("<u8") for c in columns)]
        yield ASK, bucket, zstd.compress(b"".join(map(_planes, values)))


def _told(blobs: list[bytes], n_columns: int, kind: str) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    kinds = ["<u4", kind, *["<u8"] * n_columns]
    size, zstd, parts = sum(np.dtype(k).itemsize for k in kinds), zstandard.ZstdDecompressor(), [[] for _ in kinds]
    for b in blobs:
        raw, at = zstd.decompress(b), 0
        n = len(raw) // size
        for k, out in zip(kinds, parts, strict=True):
            planes = np.frombuffer(raw, np.uint8, n * np.dtype(k).itemsize, at)
            at += len(planes)
            out.append(np.ascontiguousarray(planes.reshape(-1, n).T).view(k).ravel())
    return parts[0], np.concatenate(parts[1]), [np.concatenate(c) for c in parts[2:]]


def _name_keys(n_columns: int):
    def judge(bucket: int, blobs: list[bytes]) -> list[bytes | None]:
        places, twice, columns = _told(blobs, n_columns, "u1")
        return _named(bucket, classes(columns, hash_of(columns))[0], twice, places)

    return judge


def _least_doc(n_columns: int):
    def judge(bucket: int, blobs: list[bytes]) -> list[bytes | None]:
        """The least doc_id of each key, to the blocks whose own least is larger."""
        places, docs, columns = _told(blobs, n_columns, "<i8")
        of, firsts = classes(columns, hash_of(columns))
        least = np.full(len(firsts), _LAST)
        np.minimum.at(least, of, docs)
        out, at = [], 0
        for own in places:
            now, mine = least[of[at : at + len(own)]], docs[at : at + len(own)]
            at += len(own)
            out.append(own[now < mine].tobytes() + now[now < mine].astype("<i8").tobytes())
        return out

    return judge


def _answers(told: dict[int, bytes], size: int, kind: str, default: np.ndarray | int) -> np.ndarray:
    """A value for each place, from the answers of all buckets."""
    out = np.full(size, default, kind)
    for data in told.values():
        n = len(data) // 12
        out[np.frombuffer(data, "<u4", n)] = np.frombuffer(data, kind, n, 4 * n)
    return out


# a block between rounds


class _Passages:
    """Which windows of a block may still occur twice. ``starts``: the words at which documents begin, and the end."""

    def __init__(self, starts: np.ndarray, window: int, alive: np.ndarray | None = None):
        self.starts, self.window, self.n = starts, window, int(starts[-1])
        if alive is None:
            ends = np.repeat(starts[1:], np.diff(starts))
            alive = np.arange(self.n) + window <= ends
        self.alive = alive

    def drop(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Windows that hold a stretch [lo, hi) are out."""
        fits = hi - lo <= self.window
        count = np.zeros(self.n + 1, np.int32)
        np.add.at(count, np.maximum(hi[fits] - self.window, 0), 1)
        np.add.at(count, lo[fits] + 1, -1)
        self.alive &= np.cumsum(count[:-1]) == 0

    def covered(self, size: int | None = None) -> np.ndarray:
        """The words in windows left; or, given a size, where strings of that many words inside windows left begin."""
        count = np.zeros(self.n + 1, np.int32)
        at = np.flatnonzero(self.alive)
        count[at] += 1
        count[at + (self.window if size is None else self.window - size + 1)] -= 1
        return np.cumsum(count[:-1]) > 0


def _recompressed(sym: State, passages: _Passages, turn: int) -> tuple[State, list[np.ndarray]]:
    """The symbols after a round, and the columns of those that need a name (rows where ``new``)."""
    name, beg, end, lo, hi = (sym[k] for k in ("name", "beg", "end", "lo", "hi"))
    reach = np.concatenate([[0], np.cumsum(passages.covered())])
    name = np.where((reach[end] > reach[beg]) & (hi - lo <= passages.window), name, 0)
    # one separator beside a symbol is enough
    doc = np.searchsorted(passages.starts, beg, "right") - 1
    some = name > 0
    stay = some.copy()
    stay[1:] |= some[:-1]
    stay[:-1] |= some[1:]
    name, beg, end, lo, hi, doc = (x[stay] for x in (name, beg, end, lo, hi, doc))

    def beside(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the left and the right neighbour reach; beyond its document where there is none."""
        left, right = passages.starts[doc] - 1, passages.starts[doc + 1] + 1
        same = doc[1:] == doc[:-1]
        left[1:] = np.where(same, lo[:-1], left[1:])
        right[:-1] = np.where(same, hi[1:], right[:-1])
        return left, right

    # runs
    left, right = beside(lo, hi, doc)
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (name[1:] == 0) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(name)) - 1 if len(first) else first
    parted = name[first] == 0
    count = last - first + 1
    name, beg, end, doc = name[first], beg[first], end[last], doc[first]
    lo, hi = np.where(parted, lo[first], np.minimum(lo[first], left[first])), np.where(parted, hi[last], np.maximum(hi[last], right[last]))
    # pairs
    half = (hash_of([name, count + turn * 0x10001]) & np.uint64(1)).astype(bool)
    opens, closes = half & ~parted, ~half & ~parted
    pair = np.zeros(len(name), bool)
    pair[:-1] = opens[:-1] & closes[1:] & (doc[1:] == doc[:-1])
    second = np.zeros(len(name), bool)
    second[1:] = pair[:-1]
    left, right = beside(lo, hi, doc)
    other, others = np.zeros(len(name), np.uint64), np.zeros(len(name), np.int64)
    a = np.flatnonzero(pair)
    other[a], others[a], end[a] = name[a + 1], count[a + 1], end[a + 1]
    lo = np.where(pair, np.minimum(lo, np.roll(lo, -1)), np.where(closes, np.minimum(lo, left), lo))
    hi = np.where(pair, np.maximum(hi, np.roll(hi, -1)), np.where(opens, np.maximum(hi, right), hi))
    name, beg, end, lo, hi, count, other, others, pair = (x[~second] for x in (name, beg, end, lo, hi, count, other, others, pair))
    new = (pair | (count > 1)) & (hi - lo <= passages.window)
    name = np.where((pair | (count > 1)) & ~new, 0, name)
    made = {"name": name, "beg": beg, "end": end, "lo": lo, "hi": hi, "new": new}
    return made, [name[new], other[new], (count[new].astype(np.uint64) << np.uint64(32)) | others[new].astype(np.uint64)]


def _levels(window: int) -> list[tuple[int, list[int]]]:
    """(size, where in it the shorter strings begin) of the strings that are named to verify a window."""
    out, size = [], 1
    while size < window or not out:
        longer = min(window, size * STRIDE)
        out.append((longer, sorted({min(k * size, longer - size) for k in range(STRIDE)})))
        size = longer
    return out


class _Task:
    """The steps of one operator call, as blocks take them."""

    def __init__(self, window: int, n_buckets: int):
        self.window, self.n_buckets, self.levels = window, n_buckets, _levels(window)

    def _state(self, passages: _Passages, **arrays: np.ndarray) -> Row:
        return KEEP, -1, packed_arrays(starts=passages.starts, alive=np.packbits(passages.alive), **arrays)

    def _passages(self, kept: State) -> _Passages:
        return _Passages(kept["starts"], self.window, np.unpackbits(kept["alive"], count=int(kept["starts"][-1])).astype(bool))

    def words(self, block: Block) -> Iterator[Row]:
        words, starts = block.words()
        coded = words.dictionary_encode()
        docs = np.array([_LAST if i is None else i for i in block.doc_ids], np.int64)
        yield self._state(_Passages(starts, self.window), docs=docs, word=coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32), size=np.array([len(coded.dictionary)]))
        yield from _asked_words(coded, self.n_buckets)

    def named_words(self, data: bytes, told: dict[int, bytes]) -> Iterator[Row]:
        """The words get their names, and the first round of recompression is asked for."""
        kept = unpacked_arrays(data)
        passages = self._passages(kept)
        names = _answers(told, int(kept["size"][0]), "<u8", 0)
        word, at = names[kept["word"]], np.arange(passages.n)
        passages.drop(at[word == 0], at[word == 0] + 1)
        yield from self._ask_symbols(passages, {"name": word, "beg": at, "end": at + 1, "lo": at, "hi": at + 1}, kept["docs"], kept["word"], names, 0)

    def _ask_symbols(self, passages: _Passages, sym: State, docs: np.ndarray, word: np.ndarray, names: np.ndarray, turn: int) -> Iterator[Row]:
        made, columns = _recompressed(sym, passages, turn)
        hashes = hash_of(columns)
        of, firsts = classes(columns, hashes)
        word = np.where(passages.covered(), word, 0).astype(np.uint32)
        used = np.unique(word)  # only names of words that passages left still hold
        word, names = np.searchsorted(used, word).astype(np.uint32), names[used]
        yield self._state(passages, docs=docs, word=word, names=names, size=np.array([len(firsts)]), **self._stored(made, of))
        yield from _asked(columns, firsts, (np.bincount(of, minlength=len(firsts)) > 1).astype(np.uint8), hashes, self.n_buckets)

    def _stored(self, made: State, of: np.ndarray) -> State:
        """Symbols in few bytes: their names or else the places of their keys, and differences of where they lie."""
        alphabet, code = np.unique(np.where(made["new"], 0, made["name"]), return_inverse=True)
        code[made["new"]] = len(alphabet) + of
        far = self.window + 1  # a dependence beyond the window tells nothing, however far it reaches
        before, after = np.minimum(made["beg"] - made["lo"], far), np.minimum(made["hi"] - made["end"], far)
        return {
            "alphabet": alphabet, "code": code.astype(np.uint32), "step": np.diff(made["beg"], prepend=0).astype(np.uint32),
            "long": (made["end"] - made["beg"]).astype(np.uint32), "before": before.astype(np.uint16 if far < 1 << 16 else np.uint32),
            "after": after.astype(np.uint16 if far < 1 << 16 else np.uint32),
        }

    def _symbols(self, kept: State, told: dict[int, bytes]) -> tuple[_Passages, State]:
        """The symbols with the names they have got; windows with one that got none are out."""
        passages, code = self._passages(kept), kept["code"].astype(np.int64)
        name = np.concatenate([kept["alphabet"], _answers(told, int(kept["size"][0]), "<u8", 0)])[code]
        beg = np.cumsum(kept["step"], dtype=np.int64)
        end = beg + kept["long"]
        sym = {"name": name, "beg": beg, "end": end, "lo": beg - kept["before"], "hi": end + kept["after"]}
        alone = (code >= len(kept["alphabet"])) & (name == 0)
        passages.drop(sym["lo"][alone], sym["hi"][alone])
        return passages, sym

    def recompress(self, turn: int):
        def step(data: bytes, told: dict[int, bytes]) -> Iterator[Row]:
            kept = unpacked_arrays(data)
            passages, sym = self._symbols(kept, told)
            yield from self._ask_symbols(passages, sym, kept["docs"], kept["word"], kept["names"], turn)

        return step

    def revealed(self, data: bytes, told: dict[int, bytes]) -> Iterator[Row]:
        """After the last round: windows left are to be verified, beginning with short strings."""
        kept = unpacked_arrays(data)
        passages, _ = self._symbols(kept, told)
        names = kept["names"] if len(kept["names"]) else np.zeros(1, np.uint64)
        yield from self._ask_strings(passages, kept["docs"], names[kept["word"]], 1, 0)

    def longer(self, level: int):
        def step(data: bytes, told: dict[int, bytes]) -> Iterator[Row]:
            """The strings of the level before get their names; windows with one that got none are out."""
            kept, size = unpacked_arrays(data), self.levels[level - 1][0]
            passages, at = self._passages(kept), kept["at"].astype(np.int64)
            name = np.zeros(passages.n, np.uint64)
            name[at] = _answers(told, int(kept["size"][0]), "<u8", 0)[kept["place"]]
            alone = at[name[at] == 0]
            passages.drop(alone, alone + size)
            yield from self._ask_strings(passages, kept["docs"], name, size, level)

        return step

    def _ask_strings(self, passages: _Passages, docs: np.ndarray, name: np.ndarray, size: int, level: int) -> Iterator[Row]:
        longer, offsets = self.levels[level]
        at = np.flatnonzero(passages.covered(longer))
        columns = [name[at + k] for k in offsets]
        hashes = hash_of(columns)
        of, firsts = classes(columns, hashes)
        if longer < self.window:
            yield self._state(passages, docs=docs, at=at.astype(np.uint32), place=of.astype(np.uint32), size=np.array([len(firsts)]))
            yield from _asked(columns, firsts, (np.bincount(of, minlength=len(firsts)) > 1).astype(np.uint8), hashes, self.n_buckets)
            return
        own = docs[np.searchsorted(passages.starts, at, "right") - 1]
        least = np.full(len(firsts), _LAST)
        np.minimum.at(least, of, own)
        yield self._state(passages, at=at.astype(np.uint32), place=of.astype(np.uint32), own=own, least=least)
        yield from _asked(columns, firsts, least, hashes, self.n_buckets)

    def cut(self, data: bytes, told: dict[int, bytes]) -> Iterator[Row]:
        """Which words stay, for blocks that lose any."""
        kept = unpacked_arrays(data)
        n, least = int(kept["starts"][-1]), kept["least"].copy()
        now = _answers(told, len(least), "<i8", _LAST)
        least = np.minimum(least, now)
        gone = kept["at"][least[kept["place"]] < kept["own"]].astype(np.int64)
        if len(gone):
            cover = np.zeros(n + 1, np.int32)
            cover[gone] += 1
            np.add.at(cover, gone + self.window, -1)
            yield KEEP, -1, np.packbits(np.cumsum(cover[:-1]) == 0).tobytes()


def remove_repeated_passages(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """Each document without the words covered by a passage of ``window`` words that also starts in a
    document with a smaller doc_id. Returns doc_id, n_words, n_removed and the kept words joined by
    one space as text, or with ``digest`` their lowercase hex SHA-256 as kept_sha256."""
    blocks = pack(docs, "passages")
    rounds, task = Rounds(blocks), _Task(window, blocks.n_buckets)
    rounds.begin(task.words)
    rounds.answer(_name_words)
    rounds.go_on(task.named_words)
    for turn in range(1, ROUNDS):
        if not rounds.answer(_name_keys(3)):
            break
        rounds.go_on(task.recompress(turn))
    rounds.answer(_name_keys(3))
    rounds.go_on(task.revealed)
    for level, (_, offsets) in enumerate(task.levels[:-1], 1):
        rounds.answer(_name_keys(len(offsets)))
        rounds.go_on(task.longer(level))
    rounds.answer(_least_doc(len(task.levels[-1][1])))
    rounds.go_on(task.cut)

    def joined(block: Block, kept: bytes | None) -> pa.Table:
        split = [t.split() for t in block.texts()]
        n_words = np.array([len(w) for w in split], np.int64)
        ends = np.cumsum(n_words)
        stay = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        if kept is not None:
            stay = np.unpackbits(np.frombuffer(kept, np.uint8), count=len(stay)).astype(bool)
        parts = np.split(stay, ends[:-1])
        texts = [b" ".join(w if s.all() else compress(w, s.tolist())) for w, s in zip(split, parts, strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(block.doc_ids, pa.int64()),
                "n_words": pa.array(n_words),
                "n_removed": pa.array([int(len(s) - s.sum()) for s in parts], pa.int64()),
                "kept_sha256" if digest else "text": pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode("utf-8", "replace") for t in texts], pa.string()),
            }
        )

    return rounds.end(joined, _DIGEST if digest else _TEXTS)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN f ON f.h = win.h WHERE m < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (
  SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS kept
  FROM e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
