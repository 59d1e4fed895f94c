"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed up to cells of (source, language, topic). Rounds rake the cells' token weights to
the target share of every source, then language, then topic; the ratio of a cell's raked weight to its
tokens, over the largest such ratio, is the probability with which each of its documents is kept. So
the expected tokens of what is kept have the target shares, and no document is drawn twice.

The draw is a hash of the doc_id: it repeats, needs no seed per task, and rows with one doc_id share
it; null doc_ids share one too. Null attributes are a category of their own. Texts without words weigh
nothing and are kept like the rest of their cell. A target for a value that no document has is left
out and the others are scaled up; a value without a target gets none of the weight and is dropped. An
empty table stays empty. The number of cells is that of the combinations that occur: the rounds run in
one partition while they are few, and by sums and joins over all partitions beyond that. What is left
between the raked shares and the targets after the fixed number of rounds is told by
:func:`marginal_gaps`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetweave.llm.shared import discard, land

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking, and the most cells for one partition and for a broadcast.
ROUNDS, FEW_CELLS = 10, 100_000
_NONE = "\x00none"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the doc_id: 52 bits of its MD5."""
    digits = F.substr(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(1), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def token_cells(weighted: DataFrame) -> DataFrame:
    """The cells of (source, lang, topic, n_tokens) rows and their token weight ``n``."""
    return weighted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("n"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares for a dimension: the present token shares to a power below one, which lifts the
    small values at the cost of the large."""
    own = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("n"), F.lit(power)).alias("t"))
    return own.select("value", (F.col("t") / F.lit(own.agg(F.sum("t")).first()[0] or 1.0)).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``w``, their weight after raking to ``targets`` (value, share), in total as before."""
    now = cells
    for d in DIMENSIONS:
        t = targets[d].select(F.col("value").alias(d), F.col("share").alias(f"t_{d}"))
        now = now.join(t, d, "left").fillna(0.0, [f"t_{d}"])
    now = landed = land(now.withColumn("w", F.col("n")), "mixing-cells")
    few = now.count() <= FEW_CELLS
    whole = now.agg(F.sum("n")).first()[0] or 0.0
    for k in range(rounds):
        if few:
            now = now.coalesce(1)
        for d in DIMENSIONS:
            if few:
                now = now.withColumn("own", F.sum("w").over(Window.partitionBy(d)))
            else:  # summed where the cells are, however many share a value
                now = now.join(now.groupBy(d).agg(F.sum("w").alias("own")), d)
            now = now.withColumn("w", F.when(F.col("own") > 0, F.col("w") * F.col(f"t_{d}") * F.lit(whole) / F.col("own")).otherwise(F.lit(0.0))).drop("own")
        if not few or k % 2 or k == rounds - 1:
            now, old = land(now, "mixing-raked"), landed
            discard(old)
            landed = now
    return now.select(*DIMENSIONS, "n", "w")


def marginal_gaps(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, target and share of the raked weight ``w`` of ``cells``, a row for each value with
    a target: how far the rounds have come."""
    total = cells.agg(F.sum("w")).first()[0] or 1.0
    out = None
    for d in DIMENSIONS:
        own = cells.groupBy(F.col(d).alias("value")).agg((F.sum("w") / F.lit(total)).alias("share"))
        t = targets[d].select("value", F.col("share").alias("target"))
        rows = t.join(own, "value", "left").select(F.lit(d).alias("dimension"), "value", "target", F.coalesce("share", F.lit(0.0)).alias("share"))
        out = rows if out is None else out.union(rows)
    return out


def probabilities(cells: DataFrame) -> DataFrame:
    """source, lang, topic and ``prob``, by raked weight over tokens, at most one."""
    ratio = F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(F.lit(0.0))
    most = cells.agg(F.max(ratio)).first()[0] or 1.0
    return cells.select(*DIMENSIONS, F.round(F.least(ratio / F.lit(most), F.lit(1.0)), 6).alias("prob"))


def mixed(docs: DataFrame, topics: DataFrame | None = None, power: float = 0.9, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob and kept of every document. ``topics`` (doc_id,
    topic) has at most one row for a doc_id; without one a document's topic is null. ``targets`` default
    to the tempered present shares."""
    own = docs.select("doc_id", "source", "lang", n_words(docs["text"]).alias("n_tokens"))
    if topics is not None:
        own = own.join(topics.select("doc_id", F.col("topic").cast("string").alias("topic")), "doc_id", "left")
    else:
        own = own.withColumn("topic", F.lit(None).cast("string"))
    weighted = land(own.select("doc_id", "n_tokens", *[F.coalesce(d, F.lit(_NONE)).alias(d) for d in DIMENSIONS]), "mixing-weighted")
    cells = land(token_cells(weighted), "mixing-counted")
    if targets is None:
        targets = {d: tempered(cells, d, power) for d in DIMENSIONS}
    else:
        targets = {d: _scaled(cells, d, t) for d, t in targets.items()}
    probs = land(probabilities(raked(cells, targets)), "mixing-probabilities")
    joined = weighted.join(F.broadcast(probs) if probs.count() <= FEW_CELLS else probs, list(DIMENSIONS))
    shown = [F.when(F.col(d) != _NONE, F.col(d)).alias(d) for d in DIMENSIONS]
    return joined.select("doc_id", *shown, "n_tokens", "prob", (draw(F.col("doc_id")) < F.col("prob")).alias("kept"))


def _scaled(cells: DataFrame, dimension: str, target: DataFrame) -> DataFrame:
    present = cells.select(F.col(dimension).alias("value")).distinct()
    there = target.select(F.coalesce("value", F.lit(_NONE)).alias("value"), "share").join(present, "value")
    return there.select("value", (F.col("share") / F.lit(there.agg(F.sum("share")).first()[0] or 1.0)).alias("share"))


def sampled(docs: DataFrame, topics: DataFrame | None = None, power: float = 0.9, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents drawn, with all their columns."""
    verdicts = mixed(docs, topics, power, targets)
    # rows that share a doc_id may stand in different cells: the cell decides, not the doc_id alone
    cells = verdicts.where("kept").select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("lang").alias("__l")).distinct()
    on = docs["doc_id"].eqNullSafe(cells["__id"]) & docs["source"].eqNullSafe(cells["__s"]) & docs["lang"].eqNullSafe(cells["__l"])
    return docs.join(cells, on, "left_semi")


def oracle_sql(power: float = 0.9, rounds: int = ROUNDS) -> str:
    steps, last = [], "c0"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"c{k + 1}_{d}"
            steps.append(
                f"{name} AS (SELECT source, lang, topic, n, t_source, t_lang, t_topic, total, "
                f"CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} * total / sum(w) OVER (PARTITION BY {d}) ELSE 0.0 END AS w FROM {last})"
            )
            last = name
    targets = ", ".join(
        f"g_{d} AS (SELECT {d}, t / sum(t) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(n), {power}) AS t FROM c GROUP BY {d}))" for d in DIMENSIONS
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(CAST(e.label AS VARCHAR), '') AS topic,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents LEFT JOIN (SELECT vec_id, min(label) AS label FROM embeddings GROUP BY vec_id) e ON vec_id = doc_id),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL),
{targets},
c0 AS (
  SELECT c.source, c.lang, c.topic, n, t_source, t_lang, t_topic, sum(n) OVER () AS total, n AS w
  FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{", ".join(steps)},
r AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN w / n ELSE 0.0 END AS ratio FROM {last}),
p AS (SELECT source, lang, topic, round(least(ratio / max(ratio) OVER (), 1.0), 6) AS prob FROM r)
SELECT doc_id, nullif(d.source, '') AS source, nullif(d.lang, '') AS lang, nullif(d.topic, '') AS topic, n_tokens, prob,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < prob AS kept
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic
"""
