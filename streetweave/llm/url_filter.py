"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table, at most ``MAX_LABELLED`` rows. Gradient descent
from zero keeps the weights a combination of the labelled URLs' features, so the iterations run on
their Gram matrix (one row of arrays, bounded by the table) and the weights come out of one
aggregation at the end. Scoring explodes the n-grams of each distinct URL part pair, joins the weights
and sums; the weights are broadcast, bounded by the labelled URLs' n-grams.

A null URL and one without ``://`` have empty host and path; no rule fits them and the model judges
the empty strings. URLs of any length are read whole. Verdicts belong to (host, path), so repeated
rows agree. An empty table gives an empty result, an empty labelled table allows whatever no rule
blocks. Other columns of the input are left alone.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.llm.shared import land

#: The largest labelled table; its Gram matrix is one row.
MAX_LABELLED = 500
#: Sizes of the n-grams, and the number of hash values.
GRAMS, SLOTS = (3, 4), 1 << 30
#: Rules up to this number are broadcast.
BROADCAST_RULES = 100_000

#: (host and path, verdict) of the rules of the registered query.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: The labelled URL table of the registered query: hosts that are about one of these words, each in four
#: forms with a neutral word, with and without a hyphen. Forms, neutral words and paths are the same for
#: both labels, so that the words alone tell them apart.
UNWANTED = (
    "adult", "ads", "bets", "bingo", "casino", "cams", "cheap", "click", "crack", "dating", "farm", "jackpot", "loans", "pills", "poker", "replica", "seo",
    "slots", "spam", "torrent", "track", "warez", "win", "xxx",
)
WANTED = (
    "archive", "art", "bread", "bridge", "council", "dance", "earth", "ether", "family", "garden", "health", "heritage", "history", "house", "journal",
    "kitchen", "letters", "library", "market", "mother", "museum", "music", "nation", "nature", "news", "north", "notes", "people", "poetry", "reading",
    "research", "river", "school", "science", "sheet", "station", "street", "students", "theatre", "then", "thread", "travel", "university", "water",
    "weather", "where", "winter", "world",
)
NEUTRAL = ("best", "daily", "free", "great", "home", "my", "new", "online", "one", "royal", "server", "the", "top", "video", "x")
FORMS, SUBDOMAINS = ("{w}-{n}", "{n}-{w}", "{w}{n}", "{n}{w}"), ("", "www.", "m.", "blog.")
PATHS = ("/en/1", "/de/22", "/fr/31.html", "/es/42", "/en/5/", "/play/61", "/order/7", "/guide/83", "/item/9", "/a/17")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label) of the table above; 1 is unwanted."""
    rows = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(words):
            for k, form in enumerate(FORMS):
                name = form.format(w=word, n=NEUTRAL[(4 * i + k) % len(NEUTRAL)])
                rows.append((f"http://{SUBDOMAINS[(i + k) % 4]}{name}.test{PATHS[(3 * i + k) % len(PATHS)]}", label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(r, *r.partition("/")[::2], v) for r, v in rules]
    made = spark.createDataFrame(rows, "rule string, r_host string, rest string, verdict string")
    return made.select("rule", "r_host", F.concat(F.lit("/"), "rest").alias("r_path"), F.col("verdict").alias("r_verdict"))


def matched_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, r_verdict of the longest rule that fits, for distinct parts that one fits."""
    labels = F.split("host", r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    table = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    met = parts.select("host", "path", F.explode(suffix).alias("r_host")).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "r_verdict")).alias("b")
    return met.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.r_verdict")


def _features(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slot, value: the distinct hashed n-grams of host and path, of length one together."""

    def grams(text: Column, tag: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.length(framed) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(f"{tag}{n}"), F.substr(framed, i, F.lit(n))), F.lit(SLOTS)))

    made = [grams(F.col(part), part, n) for part in ("host", "path") for n in GRAMS]
    slots = F.array_distinct(F.concat(*made, F.array(F.lit(-1).cast("long"))))
    own = parts.select(*keys, slots.alias("slots"))
    return own.select(*keys, F.explode("slots").alias("slot"), (1 / F.sqrt(F.size("slots"))).alias("value"))


def train(labelled: DataFrame, iterations: int = 300, rate: float = 0.1, shrink: float = 0.005) -> DataFrame:
    """slot, weight of a logistic regression on ``labelled`` (url, label 0 or 1)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), "label").groupBy("host", "path").agg(F.max("label").alias("label"))
    rows = rows.select("*", F.concat_ws("\n", "host", "path").alias("i"))
    if rows.count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    features = land(_features(rows, ["i", "label"]), "url-features")
    other = features.select(F.col("i").alias("j"), "slot", F.col("value").alias("v2"))
    gram = features.join(other, "slot").groupBy("i", "label", "j").agg(F.sum(F.col("value") * F.col("v2")).alias("k"))
    lines = gram.groupBy("i", "label").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("ks"))
    one = lines.agg(F.array_sort(F.collect_list(F.struct("i", "label", "ks"))).alias("rows"))

    def dot(row: Column, a: Column) -> Column:
        return F.aggregate(F.zip_with(row["ks"], a, lambda k, x: k["k"] * x), F.lit(0.0), lambda s, x: s + x)

    def step(a: Column, _: Column) -> Column:
        pull = F.transform("rows", lambda r: r["label"] - 1 / (1 + F.exp(-dot(r, a))))
        return F.zip_with(a, pull, lambda x, g: x * (1 - rate * shrink) + rate * g)

    start = F.transform("rows", lambda r: F.lit(0.0))
    solved = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("a"))
    each = solved.select(F.explode(F.zip_with("rows", "a", lambda r, a: F.struct(r["i"].alias("i"), a.alias("a")))).alias("x"))
    parts = features.join(each.select("x.i", "x.a"), "i")
    return parts.groupBy("slot").agg(F.sum(F.col("a") * F.col("value")).alias("weight"))


def scores(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """host, path, score of distinct parts; above zero is unwanted."""
    met = _features(parts, ["host", "path"]).join(F.broadcast(weights), "slot")
    return met.groupBy("host", "path").agg(F.round(F.sum(F.col("value") * F.col("weight")), 9).alias("score"))


def filtered(pages: DataFrame, rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block), and the model's score where no rule fits."""
    host, path = host_and_path(pages["url"])
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = land(own.select("host", "path").distinct(), "url-parts")
    ruled = land(matched_rules(parts, rules), "url-ruled")
    # these tables grow with the pages: no side is broadcast, and the few bytes of a URL are dealt to all tasks
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    free = parts.join(ruled.hint("merge"), ["host", "path"], "left_anti").repartition(n, "host", "path")
    weights = land(train(labelled), "url-weights")
    judged = scores(free, weights).select("host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") > 0, "block").otherwise("allow").alias("verdict"), "score")
    fixed = ruled.select("host", "path", "rule", F.col("r_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    verdicts = fixed.union(judged).hint("merge")
    joined = own.join(verdicts, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "score")


def default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")
