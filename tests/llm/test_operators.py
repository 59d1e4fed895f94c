"""The dealt operators against brute force, SQL, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streetweave.llm import blocks, components, decontamination, license_scan, line_dedup, mixing, quality_rules, recompression_dedup, shared, simhash_dedup, suffix_dedup, token_files, url_filter
from tests.llm.fixtures import CLASHES, components as brute_components
from tests.llm.fixtures import documents, empty, raw, table
from tests.oracle import connect, rows_of, rows_of_sql

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def thue_morse(n):
    return [k.bit_count() % 2 for k in range(n)]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    ef = token_files.EliasFano(token_files.EliasFano.encode(values))
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(k) for k in range(0, len(values), 7)] == values[::7].tolist()


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 24, 50_000))
    assert len(token_files.EliasFano.encode(values)) * 8 < 50_000 * (2 + math.log2((1 << 24) / 50_000) + 1)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_hold_the_ids_of_whole_texts(spark, name):
    from tokenizers import Tokenizer

    tokenizer = public_tokenizers.path(name)
    odd = [(902, "Hello World, the Cat sat.\nTwo lines", "en", "s", 1), (900, "don't. CAN'T? <|endoftext|>, <|ENDOFTEXT|> y?! İ. Å. ½.", "en", "s", 1), (901, "a\u0301. é, ''ll", "en", "s", 1)]
    docs = table(spark, [*documents(), *odd])
    got = token_files.encoded(docs, tokenizer)
    t = Tokenizer.from_file(tokenizer)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: -1 if r[0] is None else r[0])
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows]
    want = [(i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for (i, _), x in zip(rows, ids, strict=True)]
    assert sorted_rows(got.select("doc_id", "n_tokens", "ids_crc32")) == sorted(want, key=str)
    spans = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got.collect())
    assert [s[0] for s in spans] == np.concatenate([[0], np.cumsum([s[1] for s in spans])[:-1]]).tolist()
    assert [s[2] for s in spans] == sorted(s[2] for s in spans)


def test_token_files_can_give_the_ids(spark, tmp_path):
    docs = table(spark, [(1, "hello world", "en", "s", 11), (2, None, "en", "s", 0)], clashes=False)
    token_files.write_token_files(docs, str(tmp_path / "t"), TOKENIZER, end_id=49407)
    rows = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert rows[2].ids == [49407] and rows[1].ids[-1] == 49407 and rows[2].start == rows[1].n_tokens


def test_token_files_give_single_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 300)
    monkeypatch.setattr(token_files, "LOOKUP", 4)
    docs, path = table(spark), str(tmp_path / "t")
    token_files.write_token_files(docs, path, TOKENIZER)
    rows = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    wanted = [0, 3, 3, 7, 11, 29, len(rows) - 1, len(rows), -1]
    found = token_files.documents_at(spark, path, spark.createDataFrame([(k,) for k in wanted], "position long"))
    got = sorted((r.position, r.start, r.ids) for r in found.collect())
    assert got == [(k, rows[k].start, rows[k].ids) for k in sorted(set(wanted)) if 0 <= k < len(rows)]
    assert spark.read.parquet(f"{path}/segments").count() > 5


def test_empty_token_files(spark):
    assert token_files.encoded(empty(spark), TOKENIZER).collect() == []


# suffix dedup


def test_difference_covers():
    for length in (10, 20, 50, 100, 200, 400):
        v, cover = suffix_dedup.difference_cover(length)
        assert v <= max(1, length * 2 // 3) and {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert suffix_dedup.difference_cover(200)[0] == 133 and len(suffix_dedup.difference_cover(200)[1]) == 12


@pytest.mark.parametrize("length", [30, 200])
def test_suffix_dedup_equals_brute_force(spark, length):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000))
    more = [base + base[500:41_000], "q" * 3000 + base[7_000:9_000] + "q" * 260, "".join("01"[x] for x in thue_morse(1024)), "".join("10"[x] for x in thue_morse(1024))]
    docs = table(spark, [*[r for r in documents() if len(raw(r[1])) < 20_000], *[(500 + k, t, "", "", 0) for k, t in enumerate(more)]])
    got = sorted_rows(suffix_dedup.remove_repeated_bytes(docs, length, digest=True))
    texts = [(r.doc_id, raw(r.text)) for r in docs.select("doc_id", "text").collect()]
    starts = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    assert got == sorted(want, key=str)


def test_stretches_have_two_hashes():
    rng = random.Random(1)
    text = np.frombuffer(bytes(rng.randrange(256) for _ in range(3000)), np.uint8)
    rolling = suffix_dedup.Rolling(text)
    at = np.arange(0, 2000, 7)
    prime, base = int(suffix_dedup._PRIME), suffix_dedup._BASE_2
    want = [sum((int(text[a + k]) + 1) * pow(base, k, prime) for k in range(200)) % prime for a in at.tolist()]
    got = rolling.second(at, at + 200)
    assert got.tolist() == want
    # complementary Thue-Morse strings: alike modulo 2 ** 64, not modulo the prime
    both = np.array(thue_morse(2048) + [1 - x for x in thue_morse(2048)], np.uint8)
    rolling = suffix_dedup.Rolling(both)
    begin = np.array([0, 2048])
    assert len(set(rolling.first(begin, begin + 2048).tolist())) == 1 and len(set(rolling.second(begin, begin + 2048).tolist())) == 2


def test_suffix_dedup_of_one_passage_in_a_copied_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text, "", "", 0), (2, text, "", "", 0), (3, "".join(rng.choice("ijk") for _ in range(500)) + text[1000:1260], "", "", 0)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeated_bytes(table(spark, rows)).collect()}
    assert got == {1: (3000, 1), 2: (3000, 1), 3: (260, 1)}
    assert suffix_dedup.remove_repeated_bytes(empty(spark)).collect() == []


# simhash


def simhash(text) -> int:
    words = raw(text).lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), seed=42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_all_pairs(spark):
    docs = table(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [simhash(t) for _, t in rows]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    want = [(i, f"{p:016x}", least.get(roots[k])) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True))]
    assert sorted_rows(simhash_dedup.labelled(docs)) == sorted(want, key=str)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))
    assert simhash_dedup.labelled(empty(spark)).collect() == [] and simhash_dedup.keep_one(empty(spark)).collect() == []


@pytest.mark.parametrize(("group", "small"), [(2048, 32), (40, 4)])
def test_links_connect_what_is_near(spark, monkeypatch, group, small):
    """Clusters around centres, also with groups cut into blocks."""
    monkeypatch.setattr(simhash_dedup, "GROUP", group)
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    rng = random.Random(4)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    points = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    got = {r.node: r.root for r in components.components(edges, "t").collect()}
    roots = brute_components(points, lambda a, b: (a ^ b).bit_count() <= 4)
    place = {s: roots[k] for k, s in enumerate(signed)}
    assert all(place[e.u] == place[e.v] for e in edges.collect())
    sides = {}
    for k, s in enumerate(signed):
        sides.setdefault(roots[k], set()).add(got.get(s, s))
    assert all(len(v) == 1 for v in sides.values()) and len({min(v) for v in sides.values()}) == len(sides)


@pytest.mark.parametrize("group", [2048, 5])
def test_similar_shingle_sets_are_linked(spark, monkeypatch, group):
    """Chains of edits, so that buckets hold members that are similar to some of the others only."""
    monkeypatch.setattr(simhash_dedup, "GROUP", group)
    rng = random.Random(9)
    texts = []
    for _ in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        for _ in range(9):
            texts.append(" ".join(words))
            for _ in range(rng.randint(1, 3 + len(words) // 60)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    texts += ["", None, "one", "one two", "ONE  two"]

    def shingles(t):
        w = raw(t).lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, prints = [shingles(t) for t in texts], [simhash_dedup._fingerprint(raw(t), 5, 42) & (1 << 64) - 1 for t in texts]
    similar = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    far = [(i, j) for i in range(len(texts)) for j in range(i) if similar(i, j) and (prints[i] ^ prints[j]).bit_count() > 5]
    roots = brute_components(range(len(texts)), lambda i, j: similar(i, j) or (prints[i] ^ prints[j]).bit_count() <= 4)
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    kept = simhash_dedup.keep_one(docs, words_per_shingle=5, least_jaccard=0.8)
    assert far and kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(roots.values())
    assert simhash_dedup.keep_one(empty(spark), 5, 0.8).collect() == []


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(5, 5), (100, 101), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges, "t").collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100}
    assert components.components(edges.limit(0), "t").count() == 0


def test_components_of_a_hub(spark):
    """One node with 30,000 neighbours, some of which have neighbours of their own."""
    n = 30_000
    spokes = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    beyond = spark.range(1, n + 1, 100).select(F.col("id").alias("u"), (F.col("id") + 10**6).alias("v"))
    got = components.components(spokes.union(beyond), "t")
    assert got.count() == n + n // 100 and got.where("root <> 0").count() == 0


# lines


def test_line_dedup_equals_brute_force(spark):
    docs = table(spark)
    got = line_dedup.line_digest(docs, min_docs=5, batches=3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def key(x):
        return "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for _, lines in {(i, t): {key(x) for x in (t or "").split("\n")} for i, t in rows}.items() for k in lines if k)
    want, kept = [], []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if seen[key(x)] < 5]
        want.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay).encode())))
        kept.append("\n".join(stay))
    assert sorted_rows(got) == sorted(want, key=str) and any(w[2] for w in want)
    cleaned = line_dedup.drop_frequent_lines(docs, min_docs=5, batches=3)
    assert cleaned.columns == docs.columns and sorted(r.text for r in cleaned.collect()) == sorted(kept)
    assert line_dedup.line_digest(empty(spark)).collect() == []


def test_line_runs_stay_right_over_many_batches(spark):
    lines = spark.createDataFrame([(b, d, 0, h, 0) for b in range(7) for d in range(3) for h in range(b + 1)], "b int, d1 long, pos int, h1 long, h2 long").withColumn("d2", F.col("b").cast("long"))
    folder = shared.new_path(spark, "test-runs")
    runs = line_dedup.LineRuns(spark, min_docs=10, folder=folder)
    for b in range(7):
        if b == 4:  # another day
            runs = line_dedup.LineRuns.open(spark, folder)
        runs.add(lines.where(F.col("b") == b))
    # hash h is in 3 documents of each batch from h on
    want = [h for h in range(7) if 3 * (7 - h) >= 10]
    assert sorted(r.h1 for r in runs.frequent().collect()) == want
    again = line_dedup.LineRuns.open(spark, folder)
    assert sorted(r.h1 for r in again.frequent().collect()) == want and len(again._frequent) == len(runs._frequent) > 0
    # a run is joined as it lies: only the batch is exchanged
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    counts = lines.groupBy("h1", "h2").count().join(runs._frequent[0].hint("merge"), ["h1", "h2"], "left_anti")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# quality


def test_quality_counts_equal_brute_force(spark):
    docs = table(spark)
    got = quality_rules.judged(docs)
    want = []
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        words = SPACE.findall(t)
        windows = {}
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), []).append(k)
        hit = {j for v in windows.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        want.append((r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    assert sorted_rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=str)
    assert got.where("kept AND base_failed").count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality_rules.judged(empty(spark)).collect() == []


def test_compression_bands_reject_both_ends_and_junk_inside(spark):
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "nd", "at", "ea", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to"]
    clean = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(n)) for n in (30, 100, 300, 1000, 3000, 12000)]
    shout = " ".join(rng.choice(("GO!!", "WIN!!", "NOW!!")) + str(rng.randrange(3)) for _ in range(400))
    noise = " ".join("".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(rng.randint(4, 12))) for _ in range(400))
    junk_inside = clean[3] + " " + shout * 3 + " " + clean[2]
    texts = [*clean, shout, noise, junk_inside]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    assert all(got[k].kept for k in range(6))
    assert got[6].ratio > 3 and not got[6].kept and got[7].ratio < 1.25 and got[8].n_bad_chunks > 0 and not got[8].kept


def test_clean_documents_are_kept_and_junk_is_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judged(docs).join(labels, "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    good, junk = ([r for r in judged if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    rejected = [r for r in judged if not r.kept]
    assert sum(not r.kept for r in junk) >= 0.3 * len(junk)  # recall: junk that neither repeats nor is random passes
    assert sum(r.quality == 0 for r in rejected) >= 0.9 * len(rejected)  # precision


def test_bands_equal_brute_force(spark):
    docs = table(spark, [(k, t, "", "", 0) for k, t in enumerate(r[1] for r in documents())])
    bands = quality_rules.Bands()
    squeeze = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    for r in docs.join(quality_rules.judged(docs).select("doc_id", "kept", "base_failed", "ratio"), "doc_id").select("text", "base_failed", docs["doc_id"], "ratio", quality_rules.verdict(F.col("text"))["kept"].alias("verdict")).collect():
        b = raw(r.text)
        low, high = next((lo, hi) for size, lo, hi in reversed(bands.whole) if len(b) >= size)
        chunks = [squeeze(b[k : k + 1024]) for k in range(0, len(b) - 1023, 1024)]
        bad = sum(not bands.chunk[0] <= x <= bands.chunk[1] for x in chunks)
        assert r.ratio == pytest.approx(squeeze(b), rel=0.05)
        if abs(r.ratio - low) > 0.1 and abs(r.ratio - high) > 0.1:
            assert r.verdict == (not r.base_failed and low <= squeeze(b) <= high and bad <= bands.bad_share * len(chunks))


# decontamination


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def contaminated(rows, items, size=10):
    def words(t):
        low = "".join(c.lower() if c.isascii() else c for c in (t or ""))
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), size)
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    docs = table(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    texts = [t for _, t in rows if t and len(t) > 300]
    items = [texts[0][20:200], texts[1][:90].upper().replace(" ", " - "), "ünï çödé", "", None, "!!!", "same same same", texts[0][20:200], texts[2], "never seen words here at all my friend of old times indeed"]
    b = bench(spark, items)
    want = contaminated(rows, list(enumerate(items)))
    assert sorted_rows(decontamination.contamination(docs, b)) == sorted(want, key=str) and any(w[5] for w in want)
    clean = decontamination.drop_contaminated(docs, b)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    cut = decontamination.cut_contaminated(docs, b)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    lost = {(i, n): h for i, n, h, *_ in want}
    after = Counter((r.doc_id, r.n_words) for r in decontamination.contamination(cut, b.limit(0)).collect())
    assert after == Counter((i, n - h) for (i, n, h, *_) in want) and lost
    assert decontamination.contamination(empty(spark), b).collect() == []
    assert not any(r.contaminated for r in decontamination.contamination(docs, b.limit(0)).collect())


def test_decontamination_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    docs = table(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [next(t for _, t in rows if t and len(t) > 400)[:300]]
    assert sorted_rows(decontamination.contamination(docs, bench(spark, items))) == sorted(contaminated(rows, list(enumerate(items))), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = decontamination.hits(docs, bench(spark, items))._jdf.queryExecution().executedPlan().toString()
    # words are exchanged for documents that are read again because of a candidate, never with each window
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = re.findall(r"Exchange hashpartitioning\(h#(.*?)Generate posexplode\(.*?\), \[(.*?)\]", plan, re.DOTALL)
    # and a window is exchanged only if the bitmap lets it pass
    assert sent and all("getbit" in between and " w#" not in columns for between, columns in sent)


def test_the_bitmap_lets_all_windows_of_the_benchmark_pass(spark):
    known = spark.range(2000).select(F.xxhash64("id").alias("hash"))
    scanned = spark.range(100_000).select("id", F.xxhash64("id").alias("h"))
    extremes = spark.createDataFrame([(-1, -1), (-2, 0), (-3, -(1 << 63)), (-4, (1 << 63) - 1)], "id long, h long")
    known, scanned = known.union(extremes.select("h")), scanned.union(extremes)
    passed = [r.id for r in decontamination._in_bitmap(scanned, known).select("id").collect()]
    assert len(passed) == len(set(passed)) < 2100 and set(passed) >= {*range(2000), -1, -2, -3, -4}


def test_nothing_that_was_landed_is_left_behind(spark):
    docs = table(spark)
    base = Path(shared.new_path(spark, "x").removeprefix("file:")).parent

    def left() -> tuple[set, set]:
        return {t.name for t in spark.catalog.listTables()}, {p.name for p in base.iterdir()}

    kept = line_dedup.LineRuns(spark, 2, folder=f"{shared.new_path(spark, 'own-runs')}")
    before = left()
    out = {}
    with shared.scratch():
        kept.add(line_dedup.line_hashes(docs))
        for name, make in (("bytes", suffix_dedup.remove_repeated_bytes), ("words", recompression_dedup.remove_repeated_passages), ("lines", line_dedup.line_digest)):
            out[name] = len(make(docs).collect())
    tables, folders = (now - then for now, then in zip(left(), before, strict=True))
    assert set(out.values()) == {docs.count()} and len(tables) == 1  # the runs of the caller
    # small manifests of runs that are gone, and the caller's folder
    assert all(f.startswith(("line-runs-", "own-runs-")) for f in folders)
    assert kept.frequent().count() > 0
    with pytest.raises(ZeroDivisionError), shared.scratch():
        shared.land(docs, "lost")
        1 / 0
    assert not [f for f in left()[1] if f.startswith("lost-")]


# urls


def test_urls_are_split_and_ruled(spark):
    urls = [
        "HTTP://Sub.Example.COM/en/7?x=1", "https://a.com/en/5#t", "http://x.net/de/1", "http://y.example.net/de/8/2", "http://org/es/", "http://shop.org/fr/", None, "no scheme", "http://", "ftp://h?q://z", "http://notcom/en/", "http://a.com/EN/",
    ]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, rule string, score double")
    got = {r.page_id: r for r in url_filter.filtered(pages, url_filter.rule_table(spark), url_filter.default_labelled(spark)).collect()}
    assert [(got[i].host, got[i].path) for i in range(12)] == [
        ("sub.example.com", "/en/7"), ("a.com", "/en/5"), ("x.net", "/de/1"), ("y.example.net", "/de/8/2"), ("org", "/es/"), ("shop.org", "/fr/"), ("", ""), ("", ""), ("", ""), ("h", ""), ("notcom", "/en/"), ("a.com", "/EN/"),
    ]
    assert [got[i].rule for i in range(6)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert all(got[i].rule is None and got[i].verdict in ("allow", "block") for i in range(5, 12))
    assert url_filter.filtered(pages.limit(0), url_filter.rule_table(spark), url_filter.default_labelled(spark)).collect() == []


def test_odd_pages_have_a_verdict(spark):
    """Long URLs, repeated rows, rules of one length, columns named like the result's, no labelled URL."""
    long = "http://" + "a." * 3000 + "org/es/" + "b/" * 20_000
    rows = [(1, long, "h", "p", "v"), (2, "http://x.y/a", "h", "p", "v"), (2, "http://x.y/a", "h", "p", "v"), (None, "http://x.y/a", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string")
    rules = url_filter.rule_table(spark, (("org/es/", "block"), ("x.y/a", "allow"), ("y/a", "block"), ("x.y/", "block")))
    none = url_filter.default_labelled(spark).limit(0)
    got = url_filter.filtered(pages, rules, none).collect()
    assert sorted((r.page_id or 0, r.host[:3], r.rule, r.verdict) for r in got) == [(0, "x.y", "x.y/a", "allow"), (1, "a.a", "org/es/", "block"), (2, "x.y", "x.y/a", "allow"), (2, "x.y", "x.y/a", "allow")]
    assert len(next(r.path for r in got if r.page_id == 1)) == 4 + 40_000
    free = spark.createDataFrame([(5, "http://casino-win.test/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filtered(free, rules, none).collect()] == ["allow"]


def n_grams(url):
    host, path = re.match(r"(?:[^:]*://([^/?#]*)([^?#]*))?", url or "").groups(default="")
    texts = [("host", f"^{host.lower()}$"), ("path", f"^{path}$")]
    return {""} | {f"{tag}{n}{t[k : k + n]}" for tag, t in texts for n in (3, 4) for k in range(len(t) - n + 1)}


def fitted(rows, iterations=300, rate=0.1, shrink=0.005):
    """Weights by n-gram, in plain numpy and without hashing."""
    grams = [n_grams(u) for u, _ in rows]
    place = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    x = np.zeros((len(rows), len(place)))
    for k, g in enumerate(grams):
        x[k, [place[i] for i in g]] = 1 / math.sqrt(len(g))
    w, y = np.zeros(len(place)), np.array([label for _, label in rows])
    for _ in range(iterations):
        w = w * (1 - rate * shrink) + rate * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    return {g: w[k] for g, k in place.items()}


def test_url_verdicts_equal_brute_force(spark):
    """Host, path and rule by SQL, and the verdict of the rest by a plain logistic regression."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in url_filter.filtered(pages, url_filter.rule_table(spark), url_filter.default_labelled(spark)).collect()}
    rules = ", ".join(f"('{r}', '{v}')" for r, v in url_filter.RULES)
    low = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    want = connect("/root/testdata/sf0.01").execute(f"""
        WITH r AS (SELECT rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p, v FROM (VALUES {rules}) t(rule, v)),
        u AS (SELECT page_id, {low} AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, host, path, arg_max(rule, length(rule)), arg_max(v, length(rule))
        FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL""").fetchall()
    weights, ruled = fitted(url_filter.labelled_urls()), 0
    for page, host, path, rule, verdict in want:
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            ruled += 1
            assert r.verdict == verdict
        else:
            grams = n_grams(f"x://{host}{path}")
            score = sum(weights.get(g, 0) for g in grams) / math.sqrt(len(grams))
            assert r.score == pytest.approx(score, abs=0.02) and (abs(score) < 0.02 or r.verdict == ("block" if score > 0 else "allow"))
    assert len(want) == len(got) and 0 < ruled < len(want)


def test_url_model_on_hosts_it_has_not_seen():
    """Four folds over the hosts of the labelled table, half of which have a hyphen in either label."""
    rows = url_filter.labelled_urls()
    hosts = sorted({u.split("/")[2] for u, _ in rows})
    fold = {h: k for h, k in zip(hosts, np.random.default_rng(0).integers(4, size=len(hosts)), strict=True)}
    counts = Counter()
    for k in range(4):
        weights = fitted([r for r in rows if fold[r[0].split("/")[2]] != k])
        for u, label in rows:
            if fold[u.split("/")[2]] == k:
                counts[label, sum(weights.get(g, 0) for g in n_grams(u)) > 0] += 1
    assert counts[1, True] / (counts[1, True] + counts[0, True]) >= 0.9  # precision
    assert counts[1, True] / (counts[1, True] + counts[1, False]) >= 0.6  # recall


# mixing


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(5, 30), rng.choice(("en", "de", None)), "src0" if rng.random() < 0.4 else f"src{rng.randrange(1, 5)}", 1) for i in range(3000)]
    docs = table(spark, rows, clashes=False)
    topics = spark.createDataFrame([(i, str(i % 3)) for i in range(0, 3000, 2)], "doc_id long, topic string")
    want = {"src0": 0.2, "src1": 0.2, "src2": 0.2, "src3": 0.2, "src4": 0.2, "gone": 0.5}
    lang = {None: 0.5, "en": 0.25, "de": 0.25}
    targets = {
        "source": spark.createDataFrame(list(want.items()), "value string, share double"),
        "lang": spark.createDataFrame(list(lang.items()), "value string, share double"),
        "topic": spark.createDataFrame([("0", 0.3), ("1", 0.3), ("2", 0.2), (None, 0.2)], "value string, share double"),
    }
    got = mixing.mixed(docs, topics, targets=targets).collect()
    tokens = Counter()
    for r in got:
        tokens["all"] += r.n_tokens * r.prob
        tokens["source", r.source] += r.n_tokens * r.prob
        tokens["lang", r.lang] += r.n_tokens * r.prob
    for s in ("src0", "src1", "src4"):
        assert tokens["source", s] / tokens["all"] == pytest.approx(0.2, abs=0.002)
    assert tokens["lang", None] / tokens["all"] == pytest.approx(0.5, abs=0.002)
    assert max(r.prob for r in got) == 1.0 and sum(r.n_tokens for r in got if r.kept) == pytest.approx(tokens["all"], rel=0.1)


def test_mixing_of_odd_tables(spark):
    docs = table(spark)
    out = mixing.mixed(docs)
    assert out.count() == docs.count() and out.where("prob IS NULL OR kept IS NULL").count() == 0
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert mixing.mixed(empty(spark)).collect() == [] and mixing.sampled(empty(spark)).collect() == []


def test_raking_comes_to_its_targets_by_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(5)}", f"l{rng.randrange(3)}", f"t{rng.randrange(4)}", rng.randint(1, 500)) for _ in range(300)]
    cells = mixing.token_cells(spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long"))
    targets = {d: mixing.tempered(cells, d, 0.5) for d in mixing.DIMENSIONS}
    few = mixing.raked(cells, targets)
    gaps = mixing.marginal_gaps(few, targets).collect()
    assert len(gaps) == 12 and max(abs(g.share - g.target) for g in gaps) < 1e-4
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    many = {(r.source, r.lang, r.topic): r.w for r in mixing.raked(cells, targets).collect()}
    assert many == {(r.source, r.lang, r.topic): pytest.approx(r.w, rel=1e-9) for r in few.collect()}


# passages


def test_classes_are_told_by_content_not_by_hash():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 6, 500).astype(np.uint64) for _ in range(2)]
    for hashes in (blocks.hash_of(columns), np.zeros(500, np.uint64), columns[0] % np.uint64(2)):
        of, firsts = blocks.classes(columns, hashes)
        rows = list(zip(*(c.tolist() for c in columns), strict=True))
        assert [rows[firsts[k]] for k in of] == rows and len(firsts) == len(set(rows))


def test_levels_reach_the_window():
    for window in (1, 2, 3, 4, 5, 16, 17, 50, 200):
        covered = {0}
        for size, offsets in recompression_dedup._levels(window):
            covered = {a + b for a in offsets for b in covered}
        assert size == window and covered == set(range(window))


def passages_by_brute_force(rows, window):
    first, big = {}, float("inf")
    for i, w in rows:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, big), big if i is None else i)
    want = []
    for i, w in rows:
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                gone[k : k + window] = b"\1" * window
        want.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(want, key=str)


@pytest.mark.parametrize(("window", "rounds"), [(1, 2), (3, 2), (7, 5), (20, 5)])
def test_passages_of_few_words_equal_brute_force(spark, monkeypatch, window, rounds):
    """Texts over few words, where chance repeats abound, long copies with edits, and Thue-Morse words."""
    monkeypatch.setattr(recompression_dedup, "ROUNDS", rounds)
    rng = random.Random(window)
    texts = [[rng.choice("abcdefgh"[: 2 + k % 7]) for _ in range(rng.randint(0, 60))] for k in range(30)]
    long = [f"w{rng.randrange(300)}" for _ in range(900)]
    texts += [long, long[100:700], [*long[:400], "x", *long[400:]], long[::-1]]
    texts += [["ab"[x] for x in thue_morse(64)], ["ba"[x] for x in thue_morse(64)]]
    docs = table(spark, [(k, " ".join(t), "", "", 0) for k, t in enumerate(texts)])
    got = recompression_dedup.remove_repeated_passages(docs, window, digest=True)
    assert sorted_rows(got) == passages_by_brute_force([(k, [x.encode() for x in t]) for k, t in enumerate(texts)], window)


@pytest.mark.parametrize("window", [12, 50])
def test_passage_dedup_equals_brute_force(spark, window):
    docs = table(spark)
    got = recompression_dedup.remove_repeated_passages(docs, window, digest=True)
    rows = [(r.doc_id, raw(r.text).split()) for r in docs.select("doc_id", "text").collect()]
    want = passages_by_brute_force(rows, window)
    assert sorted_rows(got) == want and any(x[2] for x in want)
    assert recompression_dedup.remove_repeated_passages(empty(spark)).collect() == []


def test_passages_of_runs_and_periods(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    middle = ["a " * 60, "a b " * 40, "a b c d e " * 14, "a " * 25 + "b " * 25, "x " + "a a b " * 20 + "y"]
    rows = [(10 * k + j, f"{noise(9 + j)} {m} {noise(7)}", "", "", 0) for k, m in enumerate(middle) for j in range(3)]
    test_rows = table(spark, rows)
    got = {r.doc_id: r.n_removed for r in recompression_dedup.remove_repeated_passages(test_rows).collect()}
    for k, m in enumerate(middle):
        n = len(m.split())
        assert got[10 * k + 1] >= n and got[10 * k + 2] >= n and got[0] == 0


# licences


def test_licences_are_found_and_inherited(spark):
    mit = "Released under the MIT License."
    rows = [
        ("a/LICENSE", dict(license_scan.file_templates())["MIT"]), ("a/x.py", "code here\nmore code"), ("a/b/y.py", "deeper code"), ("a/b/z.py", f"# {mit}\ncode of its own and more code after that, all about other matters"), ("c/q.py", "code"),
        ("d/1", f"text\n{mit}"), ("d/2", "x\nLicensed under the Apache License, Version 2.0."), ("d/3", "plain"), ("e/4", None), (None, mit), (None, None), ("a/x.py", "code here\nmore code"), ("f", "the of and in under a work"),
    ]
    files = spark.createDataFrame([(i, p, t, "x", "y") for i, (p, t) in enumerate(rows)], "k int, path string, text string, term string, th string")
    got = {r.k: r for r in license_scan.scanned(files).collect()}
    assert len(got) == len(rows)
    assert (got[0].licence, got[0].found) == ("MIT", "file")
    assert (got[1].licence, got[1].found, got[1].licence_dir) == ("MIT", "inherited", "a/")
    assert (got[2].licence, got[2].licence_dir) == ("MIT", "a/b/") and got[3].found == "header"
    assert got[4].licence is None and got[5].licence == "MIT" and got[6].licence == "Apache-2.0"
    assert got[7].licence is None  # the headers beside it disagree
    assert got[9].licence == "MIT" and got[10].licence is None and got[11].licence == "MIT" and got[12].licence is None
    assert license_scan.scanned(files.limit(0)).collect() == []


def test_full_licence_texts_are_found(spark):
    """As they are, on one line, with other holders and words left out; and what is only about licences is not."""
    rng = random.Random(12)
    rows, texts = [], dict(license_scan.file_templates())
    for name, text in texts.items():
        edited = " ".join(w for w in text.split() if rng.random() > 0.08)
        rows += [(f"{name}/a", text), (f"{name}/b", " ".join(text.split())), (f"{name}/c", "Copyright 2031 Some Body\n" + edited), (f"{name}/d", text.upper())]
    prose = "A talk about the license of the software and its terms. " + " ".join(rng.choice(("river", "stone", "garden", "window", "letter")) for _ in range(300))
    rows += [("x/1", prose), ("y/1", "very long " * 40_000), ("z/1", texts["ISC"]), ("z/1", texts["ISC"])]
    files = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "k int, path string, text string")
    got = {r.k: (r.licence, r.found) for r in license_scan.scanned(files).collect()}
    for k, (path, _) in enumerate(rows[:-4]):
        assert got[k] == (path.split("/")[0], "file"), (path, got[k])
    assert got[len(rows) - 4][1] != "file" and got[len(rows) - 3] == (None, None)
    assert got[len(rows) - 2] == got[len(rows) - 1] == ("ISC", "file")


def test_cosines_equal_plain_arithmetic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(license_scan.file_templates())
    more = [(900_000, texts["GPL-2.0"][:9000]), (900_001, texts["MPL-2.0"].replace("Covered", "Other")), (900_002, "all rights reserved software")]
    docs = docs.select("doc_id", "text", "source", "lang").union(spark.createDataFrame([(i, t, "s", "en") for i, t in more], "doc_id long, text string, source string, lang string"))
    files = license_scan.document_paths(docs)
    rows = files.collect()
    got = {r.doc_id: (r.licence, r.cosine, r.found == "file") for r in license_scan.scanned(files).where("found IN ('header', 'file')").collect()}

    def terms(t, whole):
        low = "".join(c.lower() if c.isascii() else c for c in t)
        low = re.sub(r"[.\-]+(?=[\x00-\x20]|$)", " ", low)
        found = re.split(r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [w for w in found if (len(w) > 3 and w not in license_scan.FILE_STOP_WORDS if whole else w and w not in license_scan.STOP_WORDS)]

    def best(t, templates, whole):
        vectors = [(name, Counter(terms(x, whole))) for name, x in templates]
        df = Counter(w for _, c in vectors for w in c)
        idf = {w: round(math.log((len(vectors) + 1.0) / (n + 1.0)) + 1.0, 9) for w, n in df.items()}
        c, rarest, out = Counter(terms(t, whole)), math.log(len(vectors) + 1.0) + 1.0, []
        length = math.sqrt(sum((n * idf.get(w, rarest)) ** 2 if w in idf else n * rarest**2 for w, n in c.items()))
        for name, v in vectors:
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in v.items()))
            cosine = round(sum(n * v[w] * idf[w] ** 2 for w, n in c.items() if w in v) / (length or 1) / norm, 6)
            if cosine >= license_scan.LEAST:
                out.append((-cosine, name))
        return min(out, default=None)

    want = {}
    for r in rows:
        lines = (r.text or "").split("\n")
        whole = best(" ".join(lines), license_scan.file_templates(), True)
        of_lines = min(filter(None, (best(x, license_scan.TEMPLATES, False) for x in lines)), default=None)
        if found := whole or of_lines:
            want[r.doc_id] = (found[1], pytest.approx(-found[0], abs=2e-6), whole is not None)
    assert got == want and any(w for _, _, w in got.values())


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_planted_licence_lines_are_found_at_any_size(spark, sf):
    names = {
        "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    files = license_scan.document_paths(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
    line = F.explode(F.split("text", "\n", -1))
    planted = {(r.doc_id, names[r.line]) for r in files.select("doc_id", line.alias("line")).where(F.col("line").isin(*names)).collect()}
    own = {(r.doc_id, r.licence) for r in license_scan.scanned(files).where("found IN ('header', 'file')").collect()}
    assert planted and planted <= own


# SQL


@pytest.mark.parametrize("name", ["op2_license_scan", "op5_line_dedup", "op7_decontamination", "op9_mixing", "op10_recompression_dedup"])
def test_queries_equal_sql(spark, name):
    from streetweave.llm.entries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    assert rows_of(QUERIES[name](spark, folder)) == rows_of_sql(connect(folder), ORACLES[name])


def test_no_clash_is_missing():
    assert len(set(CLASHES)) == len(CLASHES)
