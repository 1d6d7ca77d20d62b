"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored

# Phrases and the labels they give.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as words, and the labels they give.
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version"),
    (
        "gpl-notice",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    (
        "apache-2.0-notice",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit-notice", "released under the mit license"),
    (
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted"),
)

#: A template is found in a block that holds this share of its different words.
CONTAINMENT = 0.8
#: Words of a block; blocks start every half block, so a notice of up to BLOCK / 2 + 1 words lies whole in one.
BLOCK = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each with one space before and behind."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(round(containment * size, 9)))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: tuple = PHRASES,
    templates: tuple = TEMPLATES,
    containment: float = CONTAINMENT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, matches.

    matches lists the blocks found as (label, start, words, overlap, containment). The join
    is exact: words of a template are ordered from rare to frequent by the number of
    documents that hold them; a block that reaches the overlap c holds one of the first
    size - c + 1 of them (prefix filter), has c template words or more (length filter), and
    enough of both behind the first common word (positional filter). Null and empty texts
    have no words, no labels and score 0. Repeated rows give a row each; other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    sets = [(i, label, list(dict.fromkeys(words.split()))) for i, (label, words) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    known = F.array(*map(F.lit, vocabulary))
    either = " (" + "|".join(p for p, _ in phrases) + ")(?= )"
    norm, n_base = F.col("_norm"), F.col("n_base")
    hits = F.col("_hits")
    could = F.lit(False)
    for _, _, ws in sets:  # a document with too few of the words has no block with enough
        could = could | (F.size(F.array_intersect(hits, F.array(*map(F.lit, ws)))) >= needed(len(ws), containment))
    found = F.array_compact(
        F.array(*[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in phrases])
    )
    first = F.regexp_extract(norm, "(?s)^(.*?)" + either, 1)
    last = F.regexp_extract(norm, "(?s)^(.*)" + either, 1)
    rows = stored(
        docs.select(F.col(key).alias("doc_id"), normal(F.col(text)).alias("_norm"))
        .withColumn("n_words", F.when(norm == "  ", 0).otherwise(spaces(norm) - 1).cast("long"))
        .withColumn("n_base", F.regexp_count(norm, F.lit(either)).cast("long"))
        .withColumn("_hits", F.array_intersect(F.split(norm, " "), known))
        .select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "n_words",
            "n_base",
            F.when(n_base > 0, spaces(first)).cast("long").alias("first_word"),
            F.when(n_base > 0, spaces(last)).cast("long").alias("last_word"),
            F.when(n_base > 0, found).otherwise(F.array().cast("array<string>")).alias("_base"),
            "_hits",
            F.when(could, norm).alias("_norm"),
        ),
        "license-rows",
    )
    # at most as many rows as the templates have words
    counts = dict(rows.select(F.explode("_hits").alias("w")).groupBy("w").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = F.array(*[F.lit(w) for w in sorted(vocabulary, key=rank.__getitem__)])
    index = []
    for i, label, ws in sets:
        line = sorted(ws, key=rank.__getitem__)
        c = needed(len(line), containment)
        index += [(w, i, label, line, at, c) for at, w in enumerate(line[: len(line) - c + 1])]
    prefix = F.broadcast(
        spark.createDataFrame(index, "word string, template int, label string, line array<string>, at int, c int")
    )
    half = block // 2
    blocks = (
        rows.filter("_norm is not null")
        .withColumn("_words", F.split(F.trim("_norm"), " "))
        .withColumn("_start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - half - 1, F.lit(0)), F.lit(half))))
        .withColumn("_block", F.slice("_words", F.col("_start") + 1, block))
        .select("_row", "_start", F.size("_block").alias("_n"), F.array_intersect(ordered, "_block").alias("_set"))
    )
    behind = F.least(F.size("line") - F.col("at"), F.size("_set") - F.col("_at"))
    overlap = F.size(F.array_intersect("_set", "line"))
    matches = (
        blocks.select("_row", "_start", "_n", "_set", F.posexplode("_set").alias("_at", "_word"))
        .join(prefix, F.col("_word") == F.col("word"))
        .filter((F.size("_set") >= F.col("c")) & (behind >= F.col("c")))
        # of the common words only the first is used, so a pair is verified once
        .filter(F.array_position("line", F.element_at(F.array_intersect("line", "_set"), 1)) == F.col("at") + 1)
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("c"))
        .withColumn("containment", F.col("overlap") / F.size("line"))
    )
    found_blocks = matches.groupBy("_row").agg(
        F.sort_array(
            F.collect_list(
                F.struct("label", F.col("_start").alias("start"), F.col("_n").alias("words"), "overlap", "containment")
            )
        ).alias("matches"),
        F.max("containment").alias("_score"),
    )
    empty = F.array().cast("array<struct<label:string,start:int,words:int,overlap:int,containment:double>>")
    return (
        rows.drop("_norm", "_hits")
        .join(found_blocks, "_row", "left")
        .withColumn("matches", F.coalesce("matches", empty))
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            listed(F.col("_base")).alias("base_labels"),
            listed(F.concat("_base", F.transform("matches", lambda m: m["label"]))).alias("labels"),
            F.when(n_base > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
            "matches",
        )
    )


def oracle() -> str:
    """The scan without any filter, by comparing each block with each template."""
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', list_distinct(string_split('{ws}', ' ')))" for label, ws in TEMPLATES)
    return rf"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
p as (select string_split(phrase, ' ') as ps, label from (values {phrases}) v(phrase, label)),
w as (select r, ws, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as word from d),
hit as (select r, pos, label from w join p on word = ps[1] and ws[pos + 1 : pos + len(ps)] = ps),
base as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels
  from hit group by r),
t as (select label, ts, greatest(1, ceil(round({CONTAINMENT} * len(ts), 9)))::int as c
  from (values {templates}) v(label, ts)),
b as (select r, ws[start + 1 : start + {BLOCK}] as block
  from (select r, ws, unnest(range(0, greatest(len(ws) - {BLOCK // 2}, 1), {BLOCK // 2})) as start from d where len(ws) > 0)),
o as (select r, label, len(list_intersect(ts, block)) as overlap, c, len(ts) as size from b, t),
m as (select r, list(distinct label) as labels, max(overlap / size) as score from o where overlap >= c group by r)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(m.score, 0.0)::double end as score
from d left join base using (r) left join m using (r)
"""
