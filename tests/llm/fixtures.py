"""Small tables with the cases that break things, and plain versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHES = ("fp", "variant", "count", "words", "spans", "dropped", "d1", "d2", "h", "h1", "pos", "root", "u", "v", "bucket", "topic", "prob", "kept", "w", "at", "items", "hash", "rid", "th", "row", "n")


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(("the", "of", "and", "in")) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    return " ".join(w + (".\n" if rng.random() < 0.05 else "") for w in words)


def documents(seed: int = 5) -> list[tuple]:
    """Prose with exact and near copies, shared passages and lines, runs, junk, nulls, ties, a long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(12)]
    passage, line = prose(rng, 70), "The Same Line, everywhere."
    texts = [*base, base[0], base[0], base[1].replace("the", "a", 1), base[2] + " tail"]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 20) for _ in range(3)]
    texts += [prose(rng, 30) + "\n" + ("  " if i % 2 else "") + line.upper() + "\n" + prose(rng, 10) for i in range(11)]
    texts += ["same " * 300, "same " * 260 + "end", "ab cd " * 200, "x" * 900, "x" * 450 + "y" + "x" * 450]
    texts += ["", None, " \n\t ", "one", "Ünï ÇÖDÉ ünï", "a\n\nb\n", "\n".join(["x y"] * 5), prose(rng, 20_000)]
    texts += [base[3].upper(), "é" * 300, "\u2028 odd\u00a0space " * 30]
    rows = [(i, t, rng.choice(("en", "de", None)), rng.choice(("src0", "src0", "src1", None)), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    # the same row again, one doc_id twice, and rows without one
    return [*rows, rows[0], (rows[1][0], "another text under one id", "en", "src1", 25), (None, base[4], "en", "src0", 1), (None, None, None, None, None)]


def table(spark, rows: list[tuple] | None = None, clashes: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    for name in CLASHES if clashes else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text) -> bytes:
    return (text or "").encode()


def components(points: list, near) -> dict[int, int]:
    """Index to the least index it is connected with, comparing all pairs."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(points))}
