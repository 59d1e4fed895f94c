"""Quality rules: a base of word and line counts, and bands of zstandard ratios.

The ratio of a text is its UTF-8 length over its compressed length. Repeated words and sentences
compress far better than prose, random or encrypted strings hardly at all, so both ends are out.
The ratio of clean prose grows with its length, because later text finds earlier text to point at;
hence the limits depend on the length. Whole documents are judged, and fixed chunks of them, so that
a junk passage inside a long clean text is seen too: too many chunks out of band reject the document.

A null text has no words and fails the base. Texts of any length are read whole, chunk by chunk where
they are compressed. Rows are judged one by one: repeated rows, ties and further columns change
nothing, an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)
_WHITE = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """(from this many bytes on, least ratio, greatest ratio), for whole texts; the same for chunks.

    The greatest ratios lie some 0.08 above those of prose of four languages of that length, which grow by
    0.1 or so with each doubling; other kinds of text, such as code, want bands of their own."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0),
        (64, 0.6, 2.4),
        (128, 0.95, 1.9),
        (256, 1.1, 1.95),
        (512, 1.2, 2.06),
        (1024, 1.3, 2.2),
        (2048, 1.4, 2.3),
        (4096, 1.5, 2.41),
        (8192, 1.5, 2.5),
        (16384, 1.6, 2.62),
        (32768, 1.6, 2.8),
        (65536, 1.6, 3.1),
        (1 << 20, 1.6, 3.8),
    )
    chunk_bytes: int = 1024
    chunk: tuple[float, float] = (1.1, 2.2)
    #: More than this share of the chunks out of band rejects the document.
    bad_share: float = 0.25
    level: int = 3


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more; ranks of doubled length, so exact."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    for step in (1, 2, 4):
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(again):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + _WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def _judge(raw: bytes, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    words = raw.split()
    repeated = _repeat_words(words)
    base_failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    in_words = raw.translate(None, _WHITE)
    # continuation bytes belong to the code point before them
    chars = len(in_words) - int(np.count_nonzero((np.frombuffer(in_words, np.uint8) & 0xC0) == 0x80))
    packed, sink = 0, zstd.compressobj(size=len(raw))
    for at in range(0, len(raw), 1 << 20):
        packed += len(sink.compress(raw[at : at + (1 << 20)]))
    packed += len(sink.flush())
    ratio = len(raw) / packed
    least, most = [b[1:] for b in bands.whole if b[0] <= len(raw)][-1]
    size, low, high = bands.chunk_bytes, *bands.chunk
    n_chunks = len(raw) // size  # the bytes after the last full chunk are too few for a limit of their own
    bad = sum(not low <= size / len(zstd.compress(raw[k * size : (k + 1) * size])) <= high for k in range(n_chunks))
    kept = not base_failed and least <= ratio <= most and bad <= bands.bad_share * n_chunks
    return len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), _dup_lines(raw), repeated, base_failed, kept, ratio, n_chunks, bad


def verdict(text: Column, bands: Bands = Bands()) -> Column:
    """A struct with the counts, base_failed, kept, and the figures of the bands."""

    @arrow_udf(_VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        zstd = zstandard.ZstdCompressor(level=bands.level)
        rows = [_judge(x.as_py() or b"", bands, zstd) for x in texts.cast(pa.binary())]
        names = [f.split()[0] for f in _VERDICT.split(", ")]
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]] for f in _VERDICT.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return judge(text)


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and the verdict's fields, a row for each document."""
    return docs.select("doc_id", verdict(F.col("text"), bands).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(verdict(docs["text"], bands)["kept"])
