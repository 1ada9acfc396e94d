"""Licence scan by diagonal voting.

Every pair of neighbouring document words is hashed and joined to the places where the pair stands in a licence template.
A match votes for the diagonal (document place - template place). Votes are added up per document, template and diagonal;
diagonals that lie within ``GAP`` words are merged, so inserted or missing words only shift between neighbours; a merged
span counts when it holds enough of the template's pairs and isn't much longer than the template. A base phrase counts
where one diagonal holds all its pairs, that is where its words stand consecutively.

Defined cases: null or empty text has no words and no labels; each input row gives one row, repeated ids and repeated rows
included; an empty table gives an empty result; overlapping places all count. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window, functions as F

from panelwise.llm.common import broadcast_checked, words

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public licence notices in their usual wording, and the label of each.
TEMPLATES = {
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
            "General Public License as published by the Free Software Foundation",
    "agpl": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
           "this work",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction",
    "mit-notice": "Released under the terms of the MIT License",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                "compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted",
}
GAP = 3
COVER = 0.8
STRETCH = 1.5
# A diagonal of a template needs so many votes before it is merged with others.
VOTES = 2


def anchors(spark, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(gram, kind, template, label, offset, grams, len): each word pair of each template; kind 0 marks a text's end."""
    rows = [Row(kind=1, template=f"base:{p}", label=v, text=p) for p, v in base.items()]
    rows += [Row(kind=2, template=f"text:{k}", label=k, text=t) for k, t in templates.items()]
    df = spark.createDataFrame(rows, "kind int, template string, label string, text string").withColumn(
        "w", words(F.col("text")))
    pairs = df.select("kind", "template", "label", (F.size("w") - 1).alias("grams"), F.size("w").alias("len"), "w",
                      F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("offset"))
    pairs = pairs.select(F.xxhash64(F.get("w", F.col("offset")), F.get("w", F.col("offset") + 1)).alias("gram"),
                         "kind", "template", "label", "offset", "grams", "len")
    end = spark.range(1).select(
        F.xxhash64(F.lit(""), F.lit(None).cast("string")).alias("gram"), F.lit(0).alias("kind"), F.lit("").alias("template"),
        F.lit("").alias("label"), F.lit(0).alias("offset"), F.lit(1).alias("grams"), F.lit(1).alias("len"))
    return pairs.union(end)


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, gap: int = GAP,
         cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """One row per template found in a document: row, doc_id, kind, label, start, end, cover, found, n_words.

    kind 0 rows carry n_words and stand once for each document; kind 1 rows are base places; kind 2 rows are merged spans
    with the covered share of their template, ``found`` if they pass. ``row`` numbers the input rows.
    """
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                         F.array_append(words(F.col("text")), F.lit("")).alias("w"))
    at = tokens.select("row", "doc_id", "w", F.posexplode_outer("w").alias("pos", "word"))
    grams = at.select("row", "doc_id", "pos", F.xxhash64("word", F.get("w", F.col("pos") + 1)).alias("gram"))
    votes = grams.join(broadcast_checked(anchors(docs.sparkSession, base, templates)), "gram")
    by = ("row", "doc_id", "kind", "template", "label", "grams", "len")
    diagonals = votes.groupBy(*by, (F.col("pos") - F.col("offset")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("offset").alias("offsets"), F.min("pos").alias("first"),
        F.max("pos").alias("last"))
    kept = diagonals.where((F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("votes") == F.col("grams")))
                           | ((F.col("kind") == 2) & (F.col("votes") >= VOTES)))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("kind") < 2) | (F.col("diagonal") - F.lag("diagonal").over(along) > gap), F.lit(True))
    spans = kept.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(along)).groupBy(*by, "span").agg(
        F.min("first").alias("start"), F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets"))
    share = F.size("offsets") / F.col("grams")
    fits = (F.col("last") - F.col("start") + 2) <= F.col("len") * stretch
    return spans.select(
        "row", "doc_id", "kind", "label", F.col("start").cast("long").alias("start"),
        (F.col("last") + 2).cast("long").alias("end"), share.alias("cover"),
        ((F.col("kind") == 1) | ((F.col("kind") == 2) & (share >= cover) & fits)).alias("found"),
        F.when(F.col("kind") == 0, F.col("start").cast("long")).alias("n_words"))


def label(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    base, found = F.col("kind") == 1, F.col("found")
    return scan(docs, **options).groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, F.lit(1))).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(found, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kind") > 0, F.col("cover"))), F.lit(0.0)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return label(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score")


def _values() -> str:
    rows = [(1, f"base:{p}", v, p) for p, v in BASE.items()] + [(2, f"text:{k}", k, t) for k, t in TEMPLATES.items()]
    return ", ".join(f"({k}, '{t}', '{n}', '{x}')" for k, t, n, x in rows)


SQL = rf"""
WITH src AS (SELECT doc_id, text, 3 AS kind, '' AS template, '' AS label FROM documents UNION ALL
             SELECT NULL, text, kind, template, label FROM (VALUES {_values()}) v(kind, template, label, text)),
w AS (SELECT doc_id, kind, template, label, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
g AS (SELECT doc_id, kind, template, label, len(w) AS n, unnest(list_zip(w, w[2:], range(0, len(w)), true)) AS g
      FROM w WHERE len(w) > 1),
votes AS (SELECT d.doc_id, t.kind, t.template, t.label, t.n - 1 AS grams, t.n AS n, d.g[3] AS pos, t.g[3] AS off
          FROM g d JOIN g t ON d.kind = 3 AND t.kind < 3 AND d.g[1] = t.g[1] AND d.g[2] = t.g[2]),
diag AS (SELECT doc_id, kind, template, label, grams, n, pos - off AS diagonal, count(*) AS votes, list(off) AS offs,
         min(pos) AS a, max(pos) AS b FROM votes GROUP BY ALL),
kept AS (SELECT *, CASE WHEN kind = 2 AND diagonal - lag(diagonal) OVER s <= {GAP} THEN 0 ELSE 1 END AS fresh FROM diag
         WHERE (kind = 1 AND votes = grams) OR (kind = 2 AND votes >= {VOTES})
         WINDOW s AS (PARTITION BY doc_id, template ORDER BY diagonal)),
span AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM kept),
spans AS (SELECT doc_id, kind, label, min(a) AS a, CAST(len(list_distinct(flatten(list(offs)))) AS DOUBLE) / grams AS cover,
          max(b) - min(a) + 2 <= n * {STRETCH} AS fits
          FROM span GROUP BY doc_id, kind, template, label, grams, n, span),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE kind = 1) AS n_base, min(a) FILTER (WHERE kind = 1) AS first_word,
           max(a) FILTER (WHERE kind = 1) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 1) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 1 OR (cover >= {COVER} AND fits)) AS labels,
           max(cover) AS score FROM spans GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN by_doc USING (doc_id) WHERE w.kind = 3
"""
