"""Whitening, personal data and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streetweave.llm import lexical_search, personal_data, whitening
from tests.llm.fixtures import documents, empty, table

# whitening


def vectors(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3)
    for name in ("w", "n", "j", "v", "component", "at", "dims"):
        df = df.withColumn(name, F.lit("x"))
    return df


def odd_vectors():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.array([8, 4, 2, 1, 1, 0.5, 0.5, 0.3, 0.2, 0.1, 0.1, 0])  # the last dimension is constant
    good = (rng.normal(size=(300, 12)) @ mix.T).astype(np.float32)
    good[:, 11] = 2.5
    rows = [(i, x.tolist()) for i, x in enumerate(good)]
    rows += [(1000, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), *[(2000 + i, rows[7][1]) for i in range(150)], (None, rows[5][1])]
    bad = [(5000, None), (5001, [math.nan] * 12), (5002, [math.inf, *[0.0] * 11]), (5003, [None, *[0.0] * 11]), (5004, [1.0] * 11), (5005, []), (5006, [3e38] * 12)]
    return rows, bad


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    rows, bad = odd_vectors()
    got = whitening.whitened_rows(vectors(spark, rows + bad), k=32).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, u = np.linalg.eigh(y.T @ y / n)
    rank = int((values > 1e-9 * values.max()).sum())
    assert rank == 11 and {r.component for r in got} == set(range(1, 12)) and len(got) == n * rank
    values, u = values[::-1][:rank], u[:, ::-1][:, :rank]
    want = y @ u / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(1)
    found = {}
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-9
        found.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.whitened, r.deviation))
    sign = {c: np.sign(found[10][c][0][0] * want[10, c - 1]) for c in range(1, rank + 1)}
    for k, (i, _) in enumerate(rows):
        for c in range(1, rank + 1):
            assert any(abs(w - sign[c] * want[k, c - 1]) < 1e-7 and d == deviation[k] for w, d in found[i][c])
    assert not {i for i, _ in bad} & set(found)


def test_whitening_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        assert whitening.whitened_rows(vectors(spark, rows)).collect() == []


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(i, [1e9 * (i % 3), 2.0**40 * (i % 2), float(i)]) for i in range(40)]
    got = {r.vec_id: r for r in whitening.whitened_rows(vectors(spark, rows, "array<double>"), k=1).collect()}
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        d = sum((40 * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert got[i].deviation == (d if d < 1 << 63 else None)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_jacobi_keeps_small_eigenvalues(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    want = 10.0 ** -np.linspace(0, 8, n)
    scale = np.sqrt(want)
    values, u = whitening.eigen((q * want) @ q.T)
    assert np.allclose(values, want, rtol=1e-6) and np.allclose(u.T @ u, np.eye(n), atol=1e-12)
    # graded matrices: diagonal scaling does not hurt
    values, _ = whitening.eigen(np.diag(scale) @ (q * (1 + np.arange(n))) @ q.T @ np.diag(scale))
    assert np.allclose(sorted(values), np.linalg.eigvalsh(np.diag(scale) @ (q * (1 + np.arange(n))) @ q.T @ np.diag(scale)), rtol=1e-6, atol=1e-14)


def test_pivoted_cholesky_stops_at_the_rank():
    a = np.random.default_rng(0).normal(size=(20, 6))
    factor = whitening.pivoted_cholesky(a @ a.T)
    assert factor.shape[1] == 6 and np.allclose(factor @ factor.T, a @ a.T)


# personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_patterns(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "b9", "1", "22", "256", "7", " ", "-", "+", "(", ")", "%", "é", "com", "4111 1111 1111 1111", "@a.b", "1.2.3.4", "+1 212 555 0123", "\n"]), max_size=25))
def test_plain_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert sorted(personal_data.plain_spans(text), key=lambda s: (s[1], personal_data.KINDS.index(s[0]))) == by_patterns(text)
    assert [s[:3] for s in personal_data.all_spans(text) if s[3]] == by_patterns(text)


DISGUISED = {
    "email": ["alice at example dot com", "bob.smith (at) mail [dot] example [dot] org", "jane dot doe at example dot co dot uk", "x1 AT y DOT com", "al1ce @ example . com", "alice@example dot com", "аlicе@ехаmple.com", "alice＠example．com",
              "al​ice@exa­mple.com", "alice&#64;example&#46;com", "alice_at_example_dot_com", "juan arroba ejemplo punto es", "jean arobase exemple point fr", "oi.78 at mail3.example.com", "hans [at] beispiel.de", "u at mail [dot] foo"],
    "ip": ["one nine two dot one six eight dot one dot one", "192[.]168[.]1[.]1", "192 dot 168 dot 1 dot 1", "192(dot)168(dot)1(dot)1", "１９２.１６８.１.１", "l92.168.1O.1"],
    "card": ["four one one one one one one one one one one one one one one one", "4111–1111–1111–1111", "４１１１ １１１１ １１１１ １１１１", "4lll 1111 1111 1111", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "٤١١١١١١١١١١١١١١١"],
    "phone": ["plus one two one two five five five zero one two three", "+1 (212) 555-O1l3", "+1 two one two five five five zero one two three", "plus four four double seven nine one two three four five six seven", "＋1 212 555 0123", "plus un deux un deux cinq cinq cinq zéro un deux trois"],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in DISGUISED.items() for t in ts])
def test_disguises_are_found_where_they_stand(kind, text):
    assert personal_data.all_spans(text)[0][:3] == (kind, 0, len(text))
    around = f"Write « {text} », é or so."
    assert [(k, around[a:b]) for k, a, b, plain in personal_data.all_spans(around) if not plain and k == kind] == [(kind, text)]


@pytest.mark.parametrize("text", [
    "meet me at example.com today", "look at this point in time", "she sat at the dot on it", "5 @ 3.75 and at 12.5", "see x (a) the. b", "un deux trois, nous irons au bois", "one, two, three dots. At ten.", "a point at which the dot com boom ended",
    "foo@bar", "user at home", "The dot at the end of line. Com.", "Привет, мир. Как дела?", "um drei, vier oder fünf Uhr", "[a] first. [b] second.", "version 1.2.3 and 4.5",
])
def test_prose_is_left_alone(text):
    assert personal_data.all_spans(text) == []


def test_spans_take_time_in_proportion():
    for part in ("a", "1", "+1 ", "a@", " at ", "(", " dot ", "one ", "a at b ", "x at b.c ", "@ ", "1 dot ", "[ "):
        text = part * (200_000 // len(part))
        began = time.perf_counter()
        personal_data.all_spans(text)
        assert time.perf_counter() - began < 6, part


def test_found_rows(spark):
    rows = [*documents(), *[(500 + i, f"é {t} and me@x.org, +1 212 555 0123 x", "en", "s", 1) for i, t in enumerate(t for ts in DISGUISED.values() for t in ts)]]
    df = table(spark, rows)
    got = personal_data.found(df).collect()
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        plain = by_patterns(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        n = Counter(k for k, _, _ in plain)
        want[(r.doc_id, *[n[k] for k in personal_data.KINDS], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert all(r.n_added == 1 and len(r.spans.split(",")) == 3 for r in got if r.doc_id is not None and r.doc_id >= 500)
    assert all(r.n_added == 0 for r in got if r.doc_id is None or r.doc_id < 500)
    assert personal_data.found(empty(spark)).collect() == []
    masked = df.where("doc_id = 500").select(personal_data.redacted(F.col("text"))).first()[0]
    assert masked == "é [email] and [email], [phone] x"


# ranked search


def by_brute_force(items, docs, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else i, -s] += 1
    return out


@pytest.mark.parametrize(("bucket", "part", "entries"), [(2048, 32_768, 200_000), (5, 9, 60)])
def test_search_equals_brute_force(spark, monkeypatch, bucket, part, entries):
    for name, value in (("BUCKET", bucket), ("PART", part), ("ENTRIES", entries)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = table(spark)
    rng = random.Random(2)
    texts = [t for _, t, *_ in documents() if t]
    items = [(i, " ".join(rng.sample(texts[i].split(), min(12, len(texts[i].split()))))) for i in range(0, 40, 3)]
    items += [(100, None), (101, ""), (102, "?! ..."), (103, "The THE the"), (103, "same ünï"), (None, "in of"), (104, "nowhere tobefound"), (105, texts[4])]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(1)).withColumn("terms", F.lit("x"))
    want = by_brute_force(items, [tuple(r) for r in docs.select("doc_id", "text").collect()], 7)
    assert Counter(tuple(r) for r in lexical_search.search(frame, docs, k=7).collect()) == want
    few = lexical_search.search(frame.where("item_id = 105"), docs, k=1000)
    assert Counter(tuple(r) for r in few.collect()) == by_brute_force([items[-1]], [tuple(r) for r in docs.select("doc_id", "text").collect()], 1000)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(items, empty(spark)).collect() == []
    assert lexical_search.search(items.where("false"), table(spark)).collect() == []
    assert lexical_search.search(items, table(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])).collect() == []


def test_counts_of_a_text_in_slices(monkeypatch):
    text = "Él niño's CAT, the cat; 東京 ".encode() * 50
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "_SLICE", 7)
    assert lexical_search.term_counts(text) == whole and whole["él".encode()] == 0 and whole["Él".encode()] == 50 and whole[b"cat"] == 100


def test_buckets_and_coordinates_are_pruned():
    rng = np.random.default_rng(1)
    n, v = 3000, 500
    rows = [np.sort(rng.choice(v, rng.integers(1, 30), replace=False)) for _ in range(n)]
    impacts = [rng.integers(1, 400_000, len(r)) for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    bucket = lexical_search._Bucket(np.arange(n), np.zeros(n, bool), np.concatenate(rows), np.concatenate(impacts), offsets)
    item = lexical_search._Item(np.array([3, 40, 77, 200]), np.array([9000, 8000, 500, 20]))
    weights = np.zeros(v, np.int64)
    weights[item.terms] = item.weights
    exact = bucket.scores(np.arange(n), weights)
    least = int(np.sort(exact)[-20])
    found = bucket.reaching(item, least)
    assert set(np.flatnonzero(exact >= least)) <= set(found.tolist()) and len(found) < n / 10
    assert item.length * bucket.longest >= exact.max()


# near duplicates: verification by prefixes, and measured recall


def distinct_sets(folder):
    import duckdb

    from streetweave.llm.shingle_sets import _hashes

    rows = duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall()
    sets = {v.tobytes(): v for (x,) in rows if len(v := _hashes((x or "").encode(), 5))}
    return [v.view(np.int64) for v in sets.values()]


def test_prefixes_find_all_similar_pairs():
    from streetweave.llm.shingle_sets import similar_pairs

    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 400, int(rng.integers(1, 60)))) for _ in range(60)]
    sets = base + [np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 400, 2)])) for x in base] + [base[0], np.zeros(0, np.int64)]
    for least in (0.5, 0.8, 1.0):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[j]) and (c := len(np.intersect1d(sets[i], sets[j]))) and c >= least * (len(sets[i]) + len(sets[j]) - c)}
        assert {tuple(sorted(p, reverse=True)) for p in similar_pairs(sets, least)} == want


def test_unlike_sets_of_a_bucket_cost_little():
    from streetweave.llm.shingle_sets import similar_pairs

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, 500)) for _ in range(4096)]
    began = time.perf_counter()
    assert not list(similar_pairs(sets, 0.8)) and time.perf_counter() - began < 10


def test_recall_of_the_bands_on_whole_tables():
    """All pairs of distinct sets with similarity 0.8, found exactly, against those that share a band."""
    from streetweave.llm.shingle_sets import _bands, similar_pairs

    sets = distinct_sets("/root/testdata/sf0.1")
    pairs = list(similar_pairs(sets, 0.8))
    bands = {i: set(enumerate(_bands(sets[i].view(np.uint64)))) for i in {k for p in pairs for k in p}}
    assert len(pairs) >= 40 and sum(bool(bands[i] & bands[j]) for i, j in pairs) >= 0.9 * len(pairs)
