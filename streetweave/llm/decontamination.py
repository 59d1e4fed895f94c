"""Benchmark decontamination: windows of benchmark words looked up in every document.

Words are maximal runs of letters a-z, digits and characters beyond ASCII, A-Z lower-cased. A window is
``window`` consecutive words of an item; a shorter item that has words is one window. Every word is
hashed once; hashes of windows are combined from those of halves (two, four, eight words ...), for all
sizes that the benchmark has in one pass over a document. A window hash that is found is verified
against the words themselves.

The windows of the benchmark are the broadcast side while their number is within ``BROADCAST_WINDOWS``;
there the words of a document are at hand in the scan's task, by reference, for the verification.
Beyond that number a bitmap of the benchmark's hashes, of a fixed size, is broadcast; document windows that
it lets pass are exchanged by their hashes, without words, and documents with candidates are read again to
verify these. Both ways give the same hits.

Hits are collected per document, (doc_id, hash of the text), so repeated rows share one entry and get
the same result. Null texts and texts without words are clean; items without words have no window; an
empty benchmark leaves all documents clean. Other columns stay as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetweave.llm.shared import land

#: Windows that are broadcast at most; one is its hash, item and words, some 200 bytes. More are joined by an exchange.
BROADCAST_WINDOWS = 500_000
#: The bitmap has 64 bits for each value of so many leading bits of a hash, so a million rows at most. A document
#: window that isn't in the benchmark passes with a chance of the benchmark's windows over 67 million.
FILTER_BITS = 20
#: What separates words, once A-Z are lower-cased, and what does in the text as it is.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BETWEEN, -1), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN_ANY_CASE, -1), "")).cast("long")


def _with_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``df`` (w, the words) with h1, h2 ... of the sizes wanted: arrays of the hashes of all windows."""
    powers = [1 << k for k in range(max(sizes).bit_length())]

    def combined(left: str, right: str, apart: int, size: int) -> Column:
        n = F.greatest(F.size("w") - size + 1, F.lit(0))
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))

    df = df.withColumn("p1", F.transform("w", lambda x: F.xxhash64(x)))
    for k in powers[1:]:
        df = df.withColumn(f"p{k}", combined(f"p{k // 2}", f"p{k // 2}", k // 2, k))
    made = {k: f"p{k}" for k in powers}
    for size in sorted(sizes):
        total = 0
        for k in reversed(powers):  # 10 is 8 and then 2
            if size & k:
                before, total = total, total + k
                if before and total not in made:
                    made[total] = f"s{size}_{total}"
                    df = df.withColumn(made[total], combined(made[before], f"p{k}", before, total))
    return df.withColumns({f"h{size}": F.col(made[size]) for size in sizes})


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, size, hash and words of every window."""
    items = benchmark.select("item_id", words(benchmark["text"]).alias("w")).where(F.size("w") > 0)
    sizes = range(1, window + 1)
    size = F.least(F.size("w"), F.lit(window))
    own = F.element_at(F.array(*[f"h{n}" for n in sizes]), size)
    each = _with_hashes(items, list(sizes)).select("item_id", "w", size.alias("size"), F.posexplode(own).alias("at", "hash"))
    return each.select("item_id", "size", "hash", F.slice("w", F.col("at") + 1, F.col("size")).alias("window")).distinct()


def _in_bitmap(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``scanned`` whose bit of ``h`` is set by some ``hash`` of ``known``."""

    def row(h: str) -> Column:
        return F.shiftrightunsigned(h, 64 - FILTER_BITS)

    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    bits = known.select(row("hash").alias("b"), bit.alias("x")).groupBy("b").agg(F.bit_or("x").alias("bits"))
    met = scanned.join(F.broadcast(bits), row("h") == F.col("b"))
    return met.where(F.getbit("bits", F.col("h").bitwiseAND(F.lit(63)).cast("int")) == 1).drop("b", "bits")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """d1, d2 (the document), spans (at, size: the windows found) and items, for documents with hits."""
    looked_for = land(benchmark_windows(benchmark, window), "benchmark-windows")
    counts = {r["size"]: r["count"] for r in looked_for.groupBy("size").count().collect()}  # at most ``window`` rows
    sizes = sorted(counts) or [window]
    keys = [docs["doc_id"].alias("d1"), F.xxhash64(docs["text"]).alias("d2")]
    scanned = _with_hashes(docs.select(*keys, words(docs["text"]).alias("w")), sizes)
    scanned = scanned.select("d1", "d2", "w", F.size("w").alias("n"), F.posexplode(F.concat(*[f"h{s}" for s in sizes])).alias("place", "h"))
    # the windows of a size begin where those of the smaller sizes end
    begins, base = F.lit(0), F.lit(0)
    for s in sizes:
        begins, base = F.when(F.col("size") == s, base).otherwise(begins), base + F.greatest(F.col("n") - s + 1, F.lit(0))
    at = F.col("place") - begins
    verified = F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("size")) == F.col("window")
    if sum(counts.values()) <= BROADCAST_WINDOWS:
        met = scanned.join(F.broadcast(looked_for), F.col("h") == F.col("hash")).withColumn("at", at).where(verified)
    else:
        known = looked_for.select("hash", "size").distinct()
        found = _in_bitmap(scanned.drop("w"), known).join(known, F.col("h") == F.col("hash")).select("d1", "d2", at.alias("at"), "size", "hash")
        spots = found.groupBy("d1", "d2").agg(F.collect_set(F.struct("at", "size", "hash")).alias("spots"))
        own = docs.select(*[k.alias(f"o{i}") for i, k in enumerate(keys)], docs["text"])
        back = own.join(spots, own["o0"].eqNullSafe(spots["d1"]) & (own["o1"] == spots["d2"]))
        each = back.select("d1", "d2", words(F.col("text")).alias("w"), F.explode("spots").alias("s"))
        cut = each.select("d1", "d2", "s.*", F.slice("w", F.greatest(F.col("s.at"), F.lit(0)) + 1, F.col("s.size")).alias("cut"))
        met = cut.join(looked_for, ["hash", "size"]).where(F.col("cut") == F.col("window"))
    return met.groupBy("d1", "d2").agg(F.collect_set(F.struct(F.col("at").alias("at"), F.col("size").alias("size"))).alias("spans"), F.collect_set("item_id").alias("items"))


def _hit_words(spans: Column) -> Column:
    """The positions, from 0, of the words inside any span."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = hits(docs, benchmark, window)
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), n_words(F.col("text")).alias("n_words"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["d1"]) & (own["th"] == found["d2"]), "left")
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(_hit_words(F.col("spans"))), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(items, ","), F.lit("")), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with all their columns."""
    found = hits(docs, benchmark, window).select("d1", "d2")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["d1"]) & (F.xxhash64(docs["text"]) == found["d2"]), "left_anti")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """All documents, without the hit words and what separates them from the word after."""
    found = hits(docs, benchmark, window).select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), _hit_words(F.col("spans")).alias("__gone"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__d1"]) & (F.xxhash64(docs["text"]) == found["__d2"]), "left").drop("__d1", "__d2")
    # a marker before each word tells words and separators apart without a second pattern
    pieces = F.split(F.regexp_replace(F.col("text"), r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", "\x01$1"), "\x01", -1)
    plain = F.instr(F.col("text"), "\x01") == 0
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 2), F.col("__gone"))
    cut = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(stay, lambda i: F.get(pieces, i + 1)), ""))
    # a text with the marker in it loses the marker: it separates words like any control character
    source = F.when(plain, F.col("text")).otherwise(F.translate("text", "\x01", " "))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(source)).withColumn(
        "text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cut)
    ).drop("__gone")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, sizes)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id
"""
