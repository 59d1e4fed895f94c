"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance.

Every line of a text is a header that may name a licence, and the text as a whole may be a licence
file. Lines are compared with one-line templates, whole texts with the full texts of licences in the
folder ``licences``. Both become sparse vectors over the terms of their templates: term counts times
the terms' inverse frequency among the templates, so that a verdict doesn't depend on what else the
corpus holds. Words that no template has are kept as a number, and lengthen the vector as if each were
in no template. The template with the largest cosine is the licence, from ``least`` on; ties go to the
smaller name. A match as a whole outranks those of lines.

A text that lacks a template's heaviest terms can't reach ``least``: what they leave of its length is
too short. Only texts with one of those terms are counted word by word, which loses none.

A directory has the licence of the licence files in it, else that of its files' headers, where these
agree. A file without a licence of its own takes that of the nearest directory above it that has one:
its ancestor paths are exploded and equality-joined with the directories' paths.

Common words of the language ("the", "of", "under") are no terms, nor are words of fewer than four
letters in whole texts; a line that holds none of the terms never leaves the scan. Null texts and paths
have no licence of their own; null paths have no directory. Rows are told apart by (path, hash of the
text), so repeated rows agree. Empty tables give empty results; texts of any length are read whole.
"""

from __future__ import annotations

import math
import string
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetweave.llm.shared import land

_NO_PATH = "\x00"
#: Least cosine of a match.
LEAST = 0.6
#: (licence, how it is named in headers or how its text begins), and words that are no terms.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "all rights reserved proprietary and confidential"),
)
#: Directories with a licence that are broadcast at most.
BROADCAST_DIRECTORIES = 200_000
STOP_WORDS = ("a", "and", "any", "are", "in", "is", "of", "or", "the", "this", "to", "under", "with", "without", "work")


FILE_STOP_WORDS = (
    "also", "been", "both", "each", "from", "have", "into", "more", "must", "only", "other", "shall", "such", "than", "that", "their", "them", "then", "these",
    "they", "this", "those", "under", "upon", "what", "when", "where", "which", "will", "with", "work", "your",
)


def file_templates() -> tuple[tuple[str, str], ...]:
    """(licence, full text) of the folder beside this module."""
    return tuple((p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licences").glob("*.txt")))


def terms(text: Column) -> Column:
    """The words of a text: runs of letters, digits and what lies beyond ASCII, with . and - inside."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.regexp_replace(lowered, r"[.\-]+(?=[\x00-\x20]|\z)", " "), r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def line_terms(text: Column) -> Column:
    return F.filter(terms(text), lambda w: ~w.isin(*STOP_WORDS))


def file_terms(text: Column) -> Column:
    return F.filter(terms(F.translate(text, "\n", " ")), lambda w: (F.length(w) > 3) & ~w.isin(*FILE_STOP_WORDS))


class _Templates:
    """Templates as vectors: ``idf`` (term, idf) and ``weights`` (template, licence, term, w, of length
    one), two tables bounded by the templates; ``rarest`` is the idf of a word that no template has."""

    def __init__(self, spark: SparkSession, templates, cut, name: str):
        made = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, licence string, text string")
        words = made.select("template", "licence", F.explode(cut(F.col("text"))).alias("term"))
        counts = land(words.groupBy("template", "licence", "term").agg(F.count("*").alias("n")), f"licence-{name}-terms")
        total = len(templates) + 1.0
        self.rarest = math.log(total) + 1.0
        own = counts.groupBy("term").agg(F.count("*").alias("df"))
        self.idf = land(own.select("term", F.round(F.log(F.lit(total) / (F.col("df") + 1.0)) + 1.0, 9).alias("idf")), f"licence-{name}-idf")
        heavy = counts.join(self.idf, "term").select("template", "licence", "term", (F.col("n") * F.col("idf")).alias("x"))
        norms = heavy.groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        self.weights = land(heavy.join(norms, "template").select("template", "licence", "term", (F.col("x") / F.col("norm")).alias("w")), f"licence-{name}-weights")

    def anchors(self, least: float) -> list[str]:
        """Terms one of which a text must hold to come to ``least`` with any template."""
        order = Window.partitionBy("template").orderBy(F.desc("w"), "term").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(order), F.lit(0.0))
        return sorted(r["term"] for r in self.weights.withColumn("before", before).where(F.col("before") <= 1.0001 - least * least).select("term").distinct().collect())

    def matched(self, vectors: DataFrame, keys: list[str], least: float) -> DataFrame:
        """keys, licence, cosine of the best template. ``vectors``: keys, size, term, n."""
        weighed = vectors.join(F.broadcast(self.idf), "term").withColumn("x", F.col("n") * F.col("idf"))
        sums = weighed.groupBy(*keys).agg(F.max("size").alias("size"), F.sum("n").alias("known"), F.sum(F.col("x") * F.col("x")).alias("square"))
        length = F.sqrt(F.col("square") + (F.col("size") - F.col("known")) * F.lit(self.rarest * self.rarest))
        dots = weighed.join(F.broadcast(self.weights), "term").groupBy(*keys, "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
        cosines = dots.join(sums, keys).select(*keys, "licence", F.round(F.col("dot") / length, 6).alias("cosine"))
        best = cosines.where(F.col("cosine") >= least).groupBy(*keys).agg(F.max_by(F.struct("licence", "cosine"), F.struct("cosine", _descending("licence"))).alias("b"))
        return best.select(*keys, "b.licence", "b.cosine")


def header_licences(files: DataFrame, templates=TEMPLATES, full_texts=None, least: float = LEAST) -> DataFrame:
    """path, th, licence, cosine and whole (the text as a whole matches) of ``files`` (path, text) that
    have a licence of their own. ``full_texts`` default to :func:`file_templates`."""
    spark = files.sparkSession
    files = files.select(F.coalesce("path", F.lit(_NO_PATH)).alias("path"), F.coalesce("text", F.lit("")).alias("text"))  # null keys would fall out of the joins
    headers = _Templates(spark, templates, line_terms, "header")
    keyed = files.select("path", F.xxhash64("text").alias("th"), "text")
    lines = keyed.select("path", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("path", "th", "pos", line_terms(F.col("line")).alias("words"))
    each = lines.select("path", "th", "pos", F.size("words").alias("size"), F.explode("words").alias("term")).join(F.broadcast(headers.idf.select("term")), "term")
    found = land(each.groupBy("path", "th", "pos", "size", "term").agg(F.count("*").alias("n")), "licence-found")
    # several rows may be the same file: a line counts once for each
    repeats = keyed.groupBy("path", "th").agg(F.count("*").alias("rows"))
    found = found.join(repeats, ["path", "th"]).withColumn("n", F.col("n") / F.col("rows"))
    per_line = headers.matched(found, ["path", "th", "pos"], least)
    line = per_line.groupBy("path", "th").agg(F.max_by(F.struct("licence", "cosine"), F.struct("cosine", _descending("licence"))).alias("b"))

    bodies = _Templates(spark, file_templates() if full_texts is None else full_texts, file_terms, "file")
    words = keyed.select("path", "th", file_terms(F.col("text")).alias("words"))
    likely = words.where(F.arrays_overlap("words", F.array(*[F.lit(t) for t in bodies.anchors(least)])))
    counted = likely.select("path", "th", F.size("words").alias("size"), F.explode("words").alias("term")).join(F.broadcast(bodies.idf.select("term")), "term")
    vectors = counted.groupBy("path", "th", "size", "term").agg(F.count("*").alias("n")).join(repeats, ["path", "th"]).withColumn("n", F.col("n") / F.col("rows"))
    whole = bodies.matched(land(vectors, "licence-bodies"), ["path", "th"], least).select("path", "th", F.struct("licence", "cosine").alias("w"))
    both = line.join(whole, ["path", "th"], "full")
    best = F.coalesce("w", "b")
    return both.select(F.nullif(F.col("path"), F.lit(_NO_PATH)).alias("path"), "th", best["licence"].alias("licence"), best["cosine"].alias("cosine"), F.col("w").isNotNull().alias("whole"))


def _descending(name: str) -> Column:
    """A key that orders short names the other way round, for ties in a maximum."""
    return F.translate(F.rpad(F.col(name), 40, " "), _ORDER, _ORDER[::-1])


_ORDER = " -." + string.digits + string.ascii_uppercase + string.ascii_lowercase


def ancestors(path: Column) -> Column:
    """The directories above a path, each ending in a slash, the root as an empty string."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    )


def directory_licences(paths: DataFrame) -> DataFrame:
    """dir, licence: of its licence files, else of its headers, where all of them agree. ``paths``: path,
    licence, whole."""
    own = paths.where("path IS NOT NULL AND licence IS NOT NULL").select(F.regexp_extract("path", r"^(?:.*/)?", 0).alias("dir"), "licence", "whole")
    some = own.groupBy("dir").agg(
        F.max("whole").alias("any_whole"), F.min("licence").alias("a"), F.max("licence").alias("b"),
        F.min(F.when(F.col("whole"), F.col("licence"))).alias("wa"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("wb"),
    )
    chosen = F.when(F.col("any_whole"), F.when(F.col("wa") == F.col("wb"), F.col("wa"))).otherwise(F.when(F.col("a") == F.col("b"), F.col("a")))
    return some.select("dir", chosen.alias("dir_licence")).where("dir_licence IS NOT NULL")


def scanned(files: DataFrame, templates=TEMPLATES, full_texts=None, least: float = LEAST) -> DataFrame:
    """``files`` (path, text and what else they have but for the names below) with licence, cosine,
    found (file, header, inherited or null) and licence_dir, the directory it is inherited from."""
    own = land(header_licences(files.select("path", "text"), templates, full_texts, least), "licence-own")
    directories = land(directory_licences(own), "licence-directories")
    known = F.broadcast(directories) if directories.count() <= BROADCAST_DIRECTORIES else directories
    # only files that may inherit look for a directory: those with a row that has no licence of its own
    keyed = files.select("path", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).where("path IS NOT NULL")
    bare = keyed.join(own.select("path", "th"), ["path", "th"], "left_anti").select("path").distinct()
    up = bare.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).join(known, "dir")
    nearest = up.groupBy("path").agg(F.max_by(F.struct("dir", "dir_licence"), F.length("dir")).alias("up"))
    rest = [F.col(f"`{c}`") for c in files.columns if c != "text"]
    rows = files.select(*rest, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"))
    mine = own.select(F.col("path").alias("__path"), F.col("th").alias("__h"), "licence", "cosine", "whole")
    joined = rows.join(mine, rows["path"].eqNullSafe(mine["__path"]) & (rows["__th"] == mine["__h"]), "left").drop("__th", "__path", "__h")
    joined = joined.withColumnRenamed("licence", "__own").join(nearest, "path", "left")
    inherited = F.col("__own").isNull() & F.col("up").isNotNull()
    return joined.select(
        *rest,
        F.when(inherited, F.col("up.dir_licence")).otherwise(F.col("__own")).alias("licence"),
        "cosine",
        F.when(F.col("__own").isNull(), F.when(inherited, "inherited")).otherwise(F.when(F.col("whole"), "file").otherwise("header")).alias("found"),
        F.when(inherited, F.col("up.dir")).alias("licence_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents laid out as source/lang/ and a directory for each leading digit of
    the doc_id, as fan-out stores do."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    fan = F.regexp_replace(number, r"(.)(?=.)", "$1/")
    folder = F.regexp_extract(fan, r"^(?:.*/)?", 0)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), folder, number)
    return docs.select("doc_id", path.alias("path"), "text")


def oracle_sql(templates=TEMPLATES, full_texts=None, least: float = LEAST) -> str:
    def terms_of(text: str) -> str:
        low = f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
        return f"regexp_split_to_array(regexp_replace({low}, '[.\\-]+([\\x00-\\x20]|$)', ' \\1', 'g'), '[\\x00-\\x2C\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    def some(words: tuple[str, ...]) -> str:
        return ", ".join(f"'{w}'" for w in words)

    def words(text: str) -> str:
        return f"list_filter({terms_of(text)}, lambda x: x <> '' AND x NOT IN ({some(STOP_WORDS)}))"

    def long_words(text: str) -> str:
        return f"list_filter({terms_of(f'replace({text}, chr(10), chr(32))')}, lambda x: length(x) > 3 AND x NOT IN ({some(FILE_STOP_WORDS)}))"

    def vectors(name: str, rows, cut) -> str:
        values = ", ".join("({}, '{}', '{}')".format(k, licence, text.replace("'", "''")) for k, (licence, text) in enumerate(rows))
        return f"""{name}_t(template, licence, text) AS (VALUES {values}),
{name}_n AS (SELECT template, licence, term, count(*) AS n FROM (SELECT template, licence, unnest({cut("text")}) AS term FROM {name}_t) GROUP BY ALL),
{name}_all AS (SELECT count(*) + 1.0 AS total, ln(count(*) + 1.0) + 1.0 AS rarest FROM {name}_t),
{name}_idf AS (SELECT term, round(ln(total / (count(*) + 1.0)) + 1.0, 9) AS idf FROM {name}_n, {name}_all GROUP BY term, total),
{name}_norm AS (SELECT template, sqrt(sum(n * idf * n * idf)) AS norm FROM {name}_n JOIN {name}_idf USING (term) GROUP BY template),
{name}_w AS (SELECT template, licence, term, n * idf / norm AS w FROM {name}_n JOIN {name}_idf USING (term) JOIN {name}_norm USING (template))"""

    def matched(found: str, keys: str, name: str, by: str) -> str:
        on = " AND ".join(f"d.{k} = s.{k}" for k in keys.split(", "))
        return f"""{name}_x AS (SELECT v.*, n * idf AS x FROM {found} v JOIN {by}_idf USING (term)),
{name}_s AS (SELECT {keys}, max(size) AS size, sum(n) AS known, sum(x * x) AS square FROM {name}_x GROUP BY {keys}),
{name}_d AS (SELECT {keys}, template, licence, sum(x * w) AS dot FROM {name}_x JOIN {by}_w USING (term) GROUP BY {keys}, template, licence),
{name} AS (SELECT * FROM (SELECT {", ".join("d." + k for k in keys.split(", "))}, licence,
    round(dot / sqrt(square + (size - known) * rarest * rarest), 6) AS cosine FROM {name}_d d JOIN {name}_s s ON {on}, {by}_all)
  WHERE cosine >= {least} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY cosine DESC, licence) = 1)"""

    return f"""
WITH {vectors("h", templates, words)},
{vectors("f", file_templates() if full_texts is None else full_texts, long_words)},
files AS (SELECT doc_id, text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' ||
  regexp_extract(regexp_replace(CAST(doc_id AS VARCHAR), '(.)', '\\1/', 'g'), '^(.*/)?./$', 1) || CAST(doc_id AS VARCHAR) AS path FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM files)),
lt AS (SELECT doc_id, pos, len(ws) AS size, unnest(ws) AS term FROM (SELECT doc_id, pos, {words("line")} AS ws FROM l)),
found AS (SELECT doc_id, pos, size, term, count(*) AS n FROM lt WHERE term IN (SELECT term FROM h_idf) GROUP BY ALL),
{matched("found", "doc_id, pos", "per_line", "h")},
line AS (SELECT doc_id, licence, cosine FROM per_line QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
ft AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM (SELECT doc_id, {long_words("text")} AS ws FROM files)),
bodies AS (SELECT doc_id, size, term, count(*) AS n FROM ft WHERE term IN (SELECT term FROM f_idf) GROUP BY ALL),
{matched("bodies", "doc_id", "whole", "f")},
own AS (SELECT files.doc_id, path, coalesce(whole.licence, line.licence) AS licence, coalesce(whole.cosine, line.cosine) AS cosine, whole.doc_id IS NOT NULL AS whole
  FROM files LEFT JOIN line ON line.doc_id = files.doc_id LEFT JOIN whole ON whole.doc_id = files.doc_id),
dirs AS (SELECT * FROM (SELECT regexp_extract(path, '^(.*/)?', 0) AS dir, CASE
    WHEN bool_or(whole) THEN CASE WHEN min(licence) FILTER (whole) = max(licence) FILTER (whole) THEN min(licence) FILTER (whole) END
    WHEN min(licence) = max(licence) THEN min(licence) END AS dir_licence FROM own WHERE licence IS NOT NULL GROUP BY 1) WHERE dir_licence IS NOT NULL),
up AS (SELECT doc_id, dir, dir_licence FROM (
    SELECT doc_id, CASE WHEN i = 0 THEN '' ELSE array_to_string(parts[1:i], '/') || '/' END AS anc
    FROM (SELECT doc_id, string_split(path, '/') AS parts, unnest(range(len(string_split(path, '/')))) AS i FROM own)) JOIN dirs ON dir = anc
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(dir) DESC) = 1)
SELECT own.doc_id, path, coalesce(licence, dir_licence) AS licence, cosine,
  CASE WHEN licence IS NOT NULL THEN CASE WHEN whole THEN 'file' ELSE 'header' END WHEN dir_licence IS NOT NULL THEN 'inherited' END AS found,
  CASE WHEN licence IS NULL THEN dir END AS licence_dir
FROM own LEFT JOIN up ON up.doc_id = own.doc_id
"""
