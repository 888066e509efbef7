"""License scans: exact phrases and an exact set-similarity join, in
DataFrame functions only.

Text blocks are windows of consecutive words over the whole text, line breaks
being gaps like any other, ``SPREAD`` times as long as the template.  A block
matches a template if it holds at least ``threshold`` of the template's
distinct words.  One scan notes which template words a text holds, and keeps
the words of texts that hold enough for some template (length filter).
Template words are ordered by the number of texts that hold them, rarest
first; a text with a matching block must hold one of the template's first
|T| - need + 1 words (prefix filter), and enough words beyond a common word's
place in both orders (positional filter).  The windows of the candidates left
are verified one by one, so the join is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, keyed, row_key
from tessera.session import ensure_checkpoint_dir

#: What separates words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices whose wording is given by the licences themselves.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the "
                  "gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
)
THRESHOLD = 0.8
#: Words of a block for each word of the template.
SPREAD = 1.5


def words_of(text: str) -> list[str]:
    """Words of a template (ASCII)."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _spaced(text: Column) -> Column:
    """Every word between a space of its own on either side."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, "  "))
    return F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _count_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _phrases(s: Column, n_words: Column) -> list[Column]:
    """n_base, first_word, last_word and base (labels) of spaced texts."""
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        p = " " + "  ".join(phrase.split()) + " "
        there = F.contains(s, F.lit(p))
        places.append(F.when(there, ((F.length(s) - F.length(F.replace(s, F.lit(p), F.lit("")))) / len(p)).cast("long"))
                      .otherwise(F.lit(0)))
        firsts.append(F.when(there, _count_words(F.substring_index(s, p, 1))))
        lasts.append(F.when(there, n_words - _count_words(F.substring_index(s, p, -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return [sum(places[1:], places[0]).alias("n_base"), F.least(*firsts).alias("first_word"),
            F.greatest(*lasts).alias("last_word"), F.filter(F.array(*labels), lambda x: x.isNotNull()).alias("base")]


def _need(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def _sets(templates, threshold: float):
    """(label, distinct words, words that match, words of a block) of each template."""
    for label, text in templates:
        words = words_of(text)
        yield label, sorted(set(words)), _need(len(set(words)), threshold), math.ceil(SPREAD * len(words))


def noted(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``rows(id, occ, text)`` scanned once: n_words, the phrases' columns, the
    template words held, as places in their sorted list, and the spaced text
    of those that hold enough words of some template."""
    sets = list(_sets(templates, threshold))
    vocabulary = sorted({w for _, ws, _, _ in sets for w in ws})
    code = {w: i for i, w in enumerate(vocabulary)}
    s = F.col("spaced")
    held = F.filter(F.array(*[F.when(F.contains(s, F.lit(f" {w} ")), F.lit(i)) for w, i in code.items()]), lambda x: x.isNotNull())
    enough = F.lit(False)
    for _, ws, need, _ in sets:
        enough = enough | (F.size(F.array_intersect("held", F.array(*[F.lit(code[w]) for w in ws]))) >= need)
    return rows.select("id", "occ", _spaced(F.col("text")).alias("spaced")) \
        .withColumn("n_words", _count_words(s)).withColumn("held", held) \
        .select("id", "occ", "n_words", *_phrases(s, F.col("n_words")), "held", F.when(enough, s).alias("spaced"))


def template_join(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, occ, label, containment) of every ``noted`` text and template with
    a matching block; containment is the best block's."""
    spark = texts.sparkSession
    sets = list(_sets(templates, threshold))
    vocabulary = sorted({w for _, ws, _, _ in sets for w in ws})
    counted = texts.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = {vocabulary[r["word"]]: r["n"] for r in counted.collect()}  # a row for each template word
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rank = F.array(*[F.lit(order[w]) for w in vocabulary])
    ranked = texts.where("spaced is not null") \
        .select("id", "occ", "spaced", F.array_sort(F.transform("held", lambda i: F.get(rank, i))).alias("held"))
    prefixes, members = [], []
    for label, ws, need, width in sets:
        ranks = sorted(order[w] for w in ws)
        members += [(label, w, len(ws), need, width) for w in ws]
        prefixes += [(r, label, i, len(ranks), need) for i, r in enumerate(ranks[:len(ranks) - need + 1])]
    index = spark.createDataFrame(prefixes, "word int, label string, i int, size int, need int")
    probes = ranked.select("id", "occ", "held", F.posexplode("held").alias("j", "word"))
    room = 1 + F.least("i", "j") + F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) - 1
    pairs = probes.join(F.broadcast(index), "word") \
        .where((F.size("held") >= F.col("need")) & (room >= F.col("need"))) \
        .groupBy("id", "occ").agg(F.collect_set("label").alias("labels"))
    # the places of a candidate's template words; a block starts at each of them
    words = ranked.alias("r").join(pairs.alias("p"), F.expr("r.id <=> p.id and r.occ = p.occ")).select("r.id", "r.occ", "spaced", "labels")
    whole = spark.createDataFrame(members, "label string, word string, size int, need int, width int")
    places = words.select("id", "occ", "labels", F.posexplode(F.split(F.trim("spaced"), "  ")).alias("at", "word")) \
        .join(F.broadcast(whole), "word").where(F.array_contains("labels", F.col("label")))
    block = Window.partitionBy("id", "occ", "label").orderBy("at")
    widths = sorted({width for _, _, _, width in sets})
    common = F.coalesce(*[F.when(F.col("width") == w, F.size(F.collect_set("word").over(block.rangeBetween(0, w - 1)))) for w in widths])
    return places.withColumn("common", common).where(F.col("common") >= F.col("need")) \
        .groupBy("id", "occ", "label").agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)
    of every document.

    Score is 1 where a base phrase stands, else the best block's containment,
    else 0.  Null and wordless texts: no words, no labels, null places.  Rows
    that repeat an id are documents of their own; an empty table gives no row.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    texts = noted(row_key(keyed(docs, id=id_col, text=text_col)), templates, threshold).checkpoint()
    by_template = template_join(texts, templates, threshold).groupBy("id", "occ") \
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return texts.alias("b").join(by_template.alias("t"), F.expr("b.id <=> t.id and b.occ = t.occ"), "left").select(
        F.col("b.id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``scan`` on ``documents`` (ids unique)."""
    lists = ",\n       ".join(f"('{label}', {ws}, {need}, {width})" for label, ws, need, width in _sets(templates, threshold))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    found = ",\n  ".join(
        f"list_filter(range(len(w) - {len(p.split())} + 1), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + f") AS p{n}"
        for n, (p, _) in enumerate(PHRASES))
    n = range(len(PHRASES))
    return f"""
WITH templates(label, ws, need, width) AS (VALUES
       {lists}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {found} FROM d),
r AS (SELECT doc_id, label, len(ws) AS size, need, width, place, word
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d), templates WHERE list_contains(ws, word)),
blocks AS (SELECT a.doc_id, a.label, a.place, a.size, count(DISTINCT b.word) AS held FROM r a JOIN r b
           ON a.doc_id = b.doc_id AND a.label = b.label AND b.place BETWEEN a.place AND a.place + a.width - 1
           GROUP BY ALL HAVING count(DISTINCT b.word) >= any_value(a.need)),
m AS (SELECT doc_id, label, max(held / size) AS containment FROM blocks GROUP BY ALL),
l AS (SELECT doc_id, list(label) AS more, max(containment) AS containment FROM m GROUP BY doc_id),
b AS (SELECT p.doc_id, n_words, {' || '.join(f'p{k}' for k in n)} AS places,
       list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{PHRASES[k][1]}' END" for k in n)}], lambda x: x IS NOT NULL) AS base,
       coalesce(more, []) AS more, coalesce(containment, 0.0) AS containment FROM p LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
       CAST(CASE WHEN len(base) > 0 THEN 1.0 ELSE containment END AS DOUBLE) AS score
FROM b
"""
