"""Licence scan: TF-IDF cosine of headers, licence files and statements to templates, then inheritance down the directories.

A header is the comment a text opens with, whatever its marks. Headers and whole licence files (by
their name) are blocks; a block is compared whole, from its first paragraph that speaks of rights to
its end, by paragraphs and by SPDX lines, without lines that only name the holder of a copyright. No
cue is asked of a block. Its templates are full texts, header notices, SPDX lines and short notices,
and rarity is counted over these templates, so a block's score does not depend on the other files.

A statement is a single line anywhere in a text with a licence cue, compared with the short notices;
document frequencies are counted over all statements. A file's own licence is the template nearest to
any of its blocks and statements, if near enough. A licence file speaks for its directory; a file
without a licence of its own takes that of the nearest directory above it that has one.

Scale. Statements repeat, so they are reduced to distinct lines with counts before anything is
scored; parts of blocks are named by the digest of their words, so copies are scored once. Templates
are the broadcast side, a parameter whose size is checked. Inheritance works on distinct directories:
each is joined with its ancestors by path, the longest match wins. Files move by directory, statement
and part of a block only, never with their texts.

Cases: null or empty texts state nothing; a null path is the root; equal scores go to the smaller
licence name, several licence files of one directory to the best score, then the smaller path;
repeated rows are scanned one by one; an empty table gives an empty result; columns other than
the key, path and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm import licence_notices
from staywise.session import written

CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|\bCC[ -]BY\b|\bCC0\b"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"
TOKEN = r"[a-z0-9]+"
#: Comments that end at a mark, and lines that are comment by their start.
BLOCK_MARKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("(*", "*)"), ("{-", "-}"), ("--[[", "]]"), ("=begin", "=end"), ("#|", "|#"))
LINE_MARKS = r"(?i)^(#|//|--|;|%|'|!|\"|\.\.(\s|$)|\.\\\"|(rem|dnl)\b)"
PROLOGUE = r"(?i)^(<\?|<!doctype|@echo)"
OPENS = r"(?i)^[\s\x{FEFF}]*(<\?|<!|@echo|/\*|#|//|--|;|%|'|!|\"|\.\.|\.\\\"|\(\*|\{-|=begin|(rem|dnl)\b)"
LINE_WORDS = r"(?i)^\W*((rem|dnl)\b|=begin\b|=end\b)"
#: A line that only names who holds a copyright.
HOLDER = r"(?i)^\W*(copyright\W*(\(c\)|\x{A9}|\d{4}|by\b|the\b.*\bauthors\b)|\(c\)\s|\x{A9}|all rights reserved\W*$|spdx-filecopyrighttext)"
RIGHTS = r"(?i)licen[cs]e|copyright|spdx|public domain|permission|redistribut|free software|\bCC[ -]BY\b|\bCC0\b"

#: Short notices by licence (fixed values; a caller may pass any other list).
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use are permitted under the simplified BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 license, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, share alike."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute is granted under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, the Unlicense."),
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def directory(path: Column) -> Column:
    """The path without its last part and slash; the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def statements(files: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The lines of every file that carry a licence cue: key columns and ``line``."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(CUE))
    cued = files.filter(F.col(text).rlike(CUE))
    return cued.select(*key, F.explode(F.transform(lines, F.trim)).alias("line"))


def score(lines: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75, digits: int = 6) -> DataFrame:
    """line, licence, score for each distinct ``line`` near enough to a template."""
    spark = lines.sparkSession
    if sum(len(t) for _, t in templates) > 16 << 20:
        raise ValueError("the templates are the broadcast side and must stay below 16 MB")
    distinct = written(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "licence-lines")
    terms = distinct.select("line", "n", F.explode(tokens(F.col("line"))).alias("token")).groupBy("line", "token").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("tf"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    rarity = terms.groupBy("token").agg(F.sum("n").alias("df"))
    idf = lambda df: F.log((1 + F.col("all")) / (1 + df)) + 1
    every = F.broadcast(total)  # one row

    weighed = terms.join(rarity, "token").join(every).select("line", "token", (F.col("tf") * idf(F.col("df"))).alias("w"))
    listed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("t")) for n, t in templates])).alias("x"))
    own = listed.select("x.licence", F.explode(tokens(F.col("x.t"))).alias("token")).groupBy("licence", "token").agg(F.count(F.lit(1)).alias("tf"))
    own = own.join(rarity, "token", "left").join(every).select("licence", "token", (F.col("tf") * idf(F.coalesce("df", F.lit(0)))).alias("v"))

    norms = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("a"))
    lengths = own.groupBy("licence").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("b"))
    dots = weighed.join(F.broadcast(own), "token").groupBy("line", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("a") * F.col("b")), digits)
    near = dots.join(norms, "line").join(F.broadcast(lengths), "licence").select("line", "licence", cosine.alias("score"))
    best = F.max_by(F.struct("licence", "score"), F.struct("score", F.col("rank")))
    names = sorted({n for n, _ in templates}, reverse=True)  # of equal scores the smaller name
    ranked = near.filter(F.col("score") >= threshold).withColumn("rank", F.array_position(F.lit(names), F.col("licence")))
    return ranked.groupBy("line").agg(best.alias("best")).select("line", "best.licence", "best.score")


def block_templates(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, str]]:
    """What blocks are compared with: the short notices, and longer texts and SPDX lines of the same licences."""
    names = sorted({n for n, _ in templates})
    longer = [(n, t) for n, t in (*licence_notices.NOTICES, *licence_notices.full_texts()) if n in names]
    return [*templates, *longer, *licence_notices.spdx(names)]


def header_lines(lines: Column) -> Column:
    """The leading lines of comment, with the blank lines among them; the lines of an array are trimmed."""
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("end"), F.lit(False).alias("over"))

    def step(s: Column, line: Column) -> Column:
        put = lambda n, end, over=False: F.struct(n.alias("n"), end.alias("end"), F.lit(over).alias("over"))
        more, none = s["n"] + 1, F.lit("")
        out = F.when(s["over"], s)
        out = out.when(s["end"] != "", F.when(F.contains(line, s["end"]), put(more, none)).otherwise(put(more, s["end"])))
        for opens, closes in BLOCK_MARKS:
            rest = F.substr(line, F.lit(len(opens) + 1))
            out = out.when(F.startswith(line, F.lit(opens)), F.when(F.contains(rest, F.lit(closes)), put(more, none)).otherwise(put(more, F.lit(closes))))
        out = out.when((line == "") | line.rlike(LINE_MARKS) | ((s["n"] == 0) & line.rlike(PROLOGUE)), put(more, none))
        return out.otherwise(put(s["n"], none, True))

    return F.slice(lines, F.lit(1), F.aggregate(lines, state, step)["n"])


def blocks(files: DataFrame, key: list[str], path: str, text: str = "text") -> DataFrame:
    """The parts of every header and licence file that are compared: key columns, ``block`` (a digest) and ``part``."""
    whole = F.regexp_extract(F.col(path), r"([^/]*)$", 1).rlike(LICENCE_NAME)
    seen = files.filter(whole | F.col(text).rlike(OPENS))
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\s\x{FEFF}]+|\s+$", ""))
    found = seen.select(*key, lines.alias("__lines"), whole.alias("__whole"))
    found = found.select(*key, F.when(F.col("__whole"), F.col("__lines")).otherwise(header_lines(F.col("__lines"))).alias("__lines"))
    kept = F.filter("__lines", lambda x: ~x.rlike(HOLDER))
    bare = F.transform(kept, lambda x: F.regexp_replace(F.when(x.rlike("[A-Za-z0-9]"), x).otherwise(""), LINE_WORDS, ""))
    found = found.select(*key, bare.alias("__lines"))
    paragraphs = F.filter(F.split(F.array_join("__lines", "\n"), r"\n{2,}"), lambda x: x.rlike("[A-Za-z0-9]"))
    found = found.select(*key, "__lines", paragraphs.alias("__paras"))
    first = F.array_position(F.transform("__paras", lambda x: x.rlike(RIGHTS)), F.lit(True)).cast("int")
    later = F.when(first > 1, F.array(F.array_join(F.slice("__paras", first, F.size("__paras")), "\n"))).otherwise(F.array().cast("array<string>"))
    named = F.filter("__lines", lambda x: x.rlike(r"(?i)spdx"))
    parts = F.array_distinct(F.concat(F.array(F.array_join("__paras", "\n")), later, F.col("__paras"), named))
    each = found.select(*key, F.explode(parts).alias("part"))
    return each.select(*key, F.md5(F.array_join(tokens(F.col("part")), " ")).alias("block"), "part").filter(F.col("part").rlike("[A-Za-z0-9]"))


def score_blocks(parts: DataFrame, templates: list[tuple[str, str]], threshold: float = 0.75, digits: int = 6) -> DataFrame:
    """block, licence, score for each distinct ``block`` near enough to a template."""
    spark = parts.sparkSession
    if sum(len(t) for _, t in templates) > 16 << 20:
        raise ValueError("the templates are the broadcast side and must stay below 16 MB")
    listed = spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("t")) for n, t in templates])).alias("at", "x"))
    own = listed.select("at", "x.licence", F.explode(tokens(F.col("x.t"))).alias("token")).groupBy("at", "licence", "token").agg(F.count(F.lit(1)).alias("tf"))
    idf = lambda df: F.log((1 + F.lit(len(templates))) / (1 + df)) + 1
    rarity = own.groupBy("token").agg(idf(F.count(F.lit(1))).alias("idf"))
    own = own.join(rarity, "token").select("at", "licence", "token", "idf", (F.col("tf") * F.col("idf")).alias("v"))
    lengths = own.groupBy("at").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("b"))
    unit = F.struct("at", "licence", (F.col("v") / F.col("b")).alias("v"))
    known = written(own.join(lengths, "at").groupBy("token").agg(F.first("idf").alias("idf"), F.collect_list(unit).alias("of")), "licence-templates")

    # Copies of a block add up to a multiple of its counts, which the cosine does not see.
    terms = parts.select("block", F.explode(tokens(F.col("part"))).alias("token")).groupBy("block", "token").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * F.coalesce("idf", idf(F.lit(0)))
    weighed = written(terms.join(F.broadcast(known.select("token", "idf")), "token", "left").select("block", "token", weight.alias("w"), F.col("idf").isNotNull().alias("shared")), "licence-terms")
    square = F.col("w") * F.col("w")
    norms = weighed.groupBy("block").agg(F.sum(square).alias("all"), F.sum(F.when(F.col("shared"), square).otherwise(0.0)).alias("part"))
    # By Cauchy and Schwarz no template is nearer than the share of the length that lies in known words.
    able = norms.filter(F.col("part") >= (threshold - 1e-5) ** 2 * F.col("all")).select("block", F.sqrt("all").alias("a"))
    met = weighed.filter("shared").join(able, "block").join(F.broadcast(known.select("token", "of")), "token")
    dots = met.select("block", "a", "w", F.explode("of").alias("o")).groupBy("block", "o.licence", "o.at").agg(F.sum(F.col("w") * F.col("o.v") / F.col("a")).alias("cosine"))
    near = dots.withColumn("score", F.round("cosine", digits)).filter(F.col("score") >= threshold)
    names = sorted({n for n, _ in templates}, reverse=True)
    ranked = near.withColumn("rank", F.array_position(F.lit(names), F.col("licence")))
    return ranked.groupBy("block").agg(F.max_by(F.struct("licence", "score"), F.struct("score", "rank")).alias("best")).select("block", "best.licence", "best.score")


def _better(part: Column, *tie: str) -> Column:
    return F.min_by(part, F.struct(-F.col("score"), *tie))


def scan(files: DataFrame, key: str, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """A row per file: key, path, licence, how (header, file, inherited or null), score, from_path."""
    named = files.withColumn("__path", F.coalesce(F.col(path).cast("string"), F.lit("")))
    # Rows of equal key and path share what any of them states.
    said = written(statements(named.select(F.col(key).alias("__key"), "__path", F.col(text).alias("__text")), ["__key", "__path"], "__text"), "licence-said")
    scored = score(said.select("line"), templates, threshold)
    parts = written(blocks(named.select(F.col(key).alias("__key"), "__path", F.col(text).alias("__text")), ["__key", "__path"], "__path", "__text"), "licence-blocks")
    matched = parts.join(score_blocks(parts, block_templates(templates), threshold), "block").select("__key", "__path", "licence", "score")
    both = said.join(scored, "line").select("__key", "__path", "licence", "score").unionByName(matched)
    stated = both.groupBy("__key", "__path").agg(_better(F.struct("licence", "score"), "licence").alias("own"))
    stated = written(stated.select("__key", "__path", "own.licence", "own.score"), "licence-own")

    speaks = F.regexp_extract(F.col("__path"), r"([^/]*)$", 1).rlike(LICENCE_NAME)
    grants = stated.filter(speaks).withColumn("dir", directory(F.col("__path")))
    granted = grants.groupBy("dir").agg(_better(F.struct("licence", "score", F.col("__path").alias("from_path")), "__path").alias("grant"))

    rows = named.select(F.col(key).alias("__key"), "__path", directory(F.col("__path")).alias("__dir"))
    dirs = rows.select("__dir").distinct()
    steps = F.split(F.col("__dir"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    ancestors = dirs.select("__dir", F.explode(F.array_distinct(above)).alias("dir"))
    nearest = ancestors.join(granted, "dir").groupBy("__dir").agg(F.max_by("grant", F.struct(F.length("dir"))).alias("grant"))

    a, s = rows.alias("a"), stated.alias("s")
    joined = a.join(s, F.col("a.__key").eqNullSafe(F.col("s.__key")) & (F.col("a.__path") == F.col("s.__path")), "left").select(
        "a.__key", "a.__path", "a.__dir", "s.licence", "s.score"
    )
    full = joined.join(nearest, "__dir", "left")
    has = F.col("licence").isNotNull()
    itself = F.regexp_extract(F.col("__path"), r"([^/]*)$", 1).rlike(LICENCE_NAME)
    return full.select(
        F.col("__key").alias(key),
        F.col("__path").alias("path"),
        F.coalesce(F.col("licence"), F.col("grant.licence")).alias("licence"),
        F.when(has & itself, "file").when(has, "header").when(F.col("grant").isNotNull(), "inherited").alias("how"),
        F.coalesce(F.col("score"), F.col("grant.score")).alias("score"),
        F.when(has, F.col("__path")).otherwise(F.col("grant.from_path")).alias("from_path"),
    )
