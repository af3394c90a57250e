"""License notices in whole texts, by an exact set-similarity join.

The blocks are all stretches of a text's words, wherever its lines break, as sets of words;
the templates are known notices. A template matches every stretch, up to `REACH` times as long
as itself, that holds at least `threshold` of its distinct words: words may be put in, but
scattered ones don't match.

Template words are put in one order, rarest in the whole corpus first. A stretch that reaches
the threshold holds one of the template's first few words (prefix filter), so only places of
such words are candidates. They meet the table of templates by equality of the word, each with
the words around it, as far as a stretch can reach. The words around must hold enough of the
template's (length filter), and enough of those that come after the candidate's own in the
order, as it stands for the stretches in which it is the rarest shared word (positional filter).
Survivors, few as they are, are dealt out evenly, and each looks at the stretches that hold it.

Everything is a built-in function. The work grows with a text's words, however long the text:
texts are cut into overlapping parts before any place is looked at. Matches depend on the text
alone, so they are summed up by its hash.

Beside the templates stand base phrases, found wherever their words follow one another.

Edge cases: null and empty texts have no words, null first_word and last_word, empty
labels and score 0; each row is judged by itself, so null and repeated doc_ids are kept
as they are; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.scratch import Scratch

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: words of a notice. Lower case, no punctuation.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
#: The longest stretch of words that is compared with a template, in times the template's words.
REACH = 1.25
#: Words of a part of a text, in which places are looked for together.
PART = 4096
#: Prefix words that travel as a literal set; of larger banks every word meets the table of templates.
SET_WORDS = 5_000
#: Rows of the table of templates (about 500 bytes each) that may be broadcast.
BROADCAST_ROWS = 20_000
#: Texts with matches (about 100 bytes each) that may be broadcast.
BROADCAST_MATCHES = 100_000
#: Of lower-cased text: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    by_hand = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(by_hand)


def spaced(lower: Column) -> Column:
    """' word word ... ': the words with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, BETWEEN, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def need(size: int, threshold: float) -> int:
    """The fewest shared words that reach the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def rarest_first(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """All template words, by how often they stand in the whole corpus; ties by the word."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    words = docs.select(F.explode(F.split(spaced(lower_ascii(F.col("text"))), " ")).alias("word"))
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    counts = {r["word"]: r["n"] for r in words.join(F.broadcast(known), "word").groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def reach(text: str) -> int:
    """The words of the longest stretch that a template is looked for in."""
    return math.ceil(REACH * len(text.split()))


def template_rows(spark: SparkSession, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """word, label, words (rarest first), place (of word in them), least, reach, for each word of each prefix."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for label, text in templates:
        words = sorted(set(text.split()), key=rank.__getitem__)
        least = need(len(words), threshold)
        rows += [(w, label, words, k + 1, least, reach(text)) for k, w in enumerate(words[: len(words) - least + 1])]
    found = spark.createDataFrame(rows, "word string, label string, words array<string>, place int, least int, reach int")
    return F.broadcast(found) if len(rows) <= BROADCAST_ROWS else found


def candidates(docs: DataFrame, prefixes: list[str], length: int) -> DataFrame:
    """mark (the text's hash), word, around, at: places of prefix words, with up to `length` - 1 words on
    either side, and where in these the word stands."""
    mark = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    rows = docs.select(mark.alias("mark"), F.split(F.trim(spaced(lower_ascii(F.col("text")))), " ").alias("words"))
    # Parts of a text, with `length` - 1 further words on either side.
    side = length - 1
    begin = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PART))
    part = lambda k: F.struct(F.least(k, F.lit(side)).alias("before"), F.slice("words", F.greatest(k - side, F.lit(0)) + 1, F.least(k, F.lit(side)) + PART + side).alias("own"))
    rows = rows.select("mark", F.explode(F.transform(begin, part)).alias("p")).select("mark", "p.before", "p.own")
    known = (lambda w: w.isin(prefixes)) if len(prefixes) <= SET_WORDS else (lambda w: F.lit(True))
    inside = lambda i: (i >= F.col("before")) & (i < F.col("before") + PART)
    found = F.transform("own", lambda w, i: F.when(inside(i) & known(w), i))
    found = F.filter(found, lambda i: i.isNotNull())
    around = lambda i: F.struct(F.get("own", i).alias("word"), F.slice("own", F.greatest(i - side, F.lit(0)) + 1, F.least(i, F.lit(side)) + length).alias("around"), (F.least(i, F.lit(side)) + 1).alias("at"))
    return rows.select("mark", F.explode(F.transform(found, around)).alias("c")).select("mark", "c.*")


def matches(docs: DataFrame, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """mark, labels, share (the best) of texts that some template matches."""
    spark = docs.sparkSession
    table = template_rows(spark, order, templates, threshold)
    rank = {w: k for k, w in enumerate(order)}
    prefixes = set()
    for _, text in templates:
        own = sorted(set(text.split()), key=rank.__getitem__)
        prefixes |= set(own[: len(own) - need(len(own), threshold) + 1])
    rows = candidates(docs, sorted(prefixes), max(reach(text) for _, text in templates)).join(table, "word")
    # The words around, as far as this template's stretches reach.
    from_ = F.greatest(F.col("at") - F.col("reach") + 1, F.lit(1))
    rows = rows.select("mark", "word", "label", "words", "place", "least", "reach", F.slice("around", from_, F.col("at") - from_ + F.col("reach")).alias("around"), (F.col("at") - from_ + 1).alias("at"))
    mine = F.array_intersect("words", "around")
    after = F.size(mine) - F.array_position(mine, F.col("word")).cast("int") + 1
    rows = rows.where((F.size("around") >= F.col("least")) & (F.least(after, F.size("words") - F.col("place") + 1) >= F.col("least")))
    rows = rows.hint("rebalance")  # a text of very many candidates is no one task's
    at_start = lambda i: F.when(F.array_contains("words", F.element_at("around", i)), F.size(F.array_intersect("words", F.slice("around", i, F.col("reach")))))
    shared = F.array_max(F.transform(F.sequence(F.lit(1), "at"), at_start))
    rows = rows.select("mark", "label", "least", F.size("words").alias("size"), shared.alias("shared")).where("shared >= least")
    return rows.groupBy("mark").agg(F.collect_set("label").alias("labels"), F.max(F.col("shared") / F.col("size")).alias("share"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = [t for t in (TEMPLATES if templates is None else templates) if t[1].split()]
    docs = docs.select("doc_id", "text")
    any_phrase = "|".join(PHRASES)
    words = F.col("said")
    rows = docs.select("doc_id", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b")).alias("mark"), spaced(lower_ascii(F.col("text"))).alias("said"))
    counts = [F.when(words.contains(f" {p} "), F.regexp_count(words, F.lit(f" {p}(?= )"))).otherwise(0).cast("long") for p in PHRASES]
    rows = rows.select("doc_id", "mark", "said", *[c.alias(f"n{k}") for k, c in enumerate(counts)])
    n_base = sum((F.col(f"n{k}") for k in range(1, len(PHRASES))), F.col("n0"))
    base = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    before = lambda most: F.when(F.col("n_base") > 0, spaces(F.regexp_extract(words, rf"(?s)^(.*{most}) (?:{any_phrase})(?= )", 1)))
    n_words = F.when(words == "  ", F.lit(0)).otherwise(spaces(words) - 1).cast("long")
    rows = rows.select("doc_id", "mark", "said", n_base.alias("n_base"), base.alias("base"))
    rows = rows.select("doc_id", "mark", "n_base", "base", n_words.alias("n_words"), before("?").alias("first_word"), before("").alias("last_word"))
    if templates:
        # Written first, so that the join sees how many there are, and can split a text that very many rows have.
        found = Scratch(docs.sparkSession, "licenses").save(matches(docs, rarest_first(docs, templates), templates, threshold), "matches")
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST_MATCHES else found, "mark", "left")
    else:
        rows = rows.withColumns({"labels": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")})
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("labels", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same by brute force: every stretch of a template's reach that begins with a template word."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    known = ", ".join(f"('{label}', list_distinct({text.split()}), {reach(text)})" for label, text in (TEMPLATES if templates is None else templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
w AS (SELECT rid, {words.format("t")} AS ws FROM d),
phrase(p, label) AS (VALUES {phrases}),
hit AS (SELECT rid, i, label FROM (SELECT rid, ws, unnest(range(len(ws))) AS i FROM w) x, phrase
        WHERE ws[i + 1] = p[1] AND list_slice(ws, i + 1, i + len(p)) = p),
base AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM hit GROUP BY rid),
known(label, k, reach) AS (VALUES {known}),
place AS (SELECT rid, i, ws[i + 1] AS word FROM (SELECT rid, ws, unnest(range(len(ws))) AS i FROM w)),
own AS (SELECT rid, label, i, p.word, len(k) AS size, reach FROM place p JOIN (SELECT label, k, reach, unnest(k) AS word FROM known) USING (word)),
found AS (SELECT a.rid, a.label, count(DISTINCT b.word) / a.size AS share FROM own a JOIN own b ON b.rid = a.rid AND b.label = a.label AND b.i >= a.i AND b.i < a.i + a.reach
          GROUP BY a.rid, a.label, a.i, a.size HAVING count(DISTINCT b.word) >= ceil({threshold} * a.size - 1e-9)),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY rid)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.share, 0.0)::DOUBLE END AS score
FROM d JOIN w USING (rid) LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""
