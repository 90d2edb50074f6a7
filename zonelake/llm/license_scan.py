"""License scans by diagonal voting, in DataFrame functions only.

All rolling three-word hashes of every text are joined to the positions of the same hashes in the license templates (a
fixed table of some hundred rows, broadcast). A hit votes for its diagonal, the offset of document to template; diagonals next
to each other (words were added or left out) merge into one span, and a span is verified by the template words that its hits
cover: all of a short notice, a share of a long one, in a stretch that isn't much longer than the template. Votes are counted, and
covered words kept as bits, before anything is shuffled, so what moves is a row for each diagonal that was hit.

Base labels are exact places of three phrases. Shingles are known by 64-bit hashes; a false hit has a chance of about
10^-16 a word and would have to cover a notice to count.

Defined results: null and empty texts have no words and labels, and score 0; rows that share doc_id and text have equal results; a null doc_id is an id like any other; an empty table gives an empty table; extra
columns are ignored. score is 1 with a base label, else the best covered share of a verified span, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonelake.llm.common import ascii_lower, let, text_of

#: Separators of words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
K = 3
#: Diagonals of a template of LONG words or more that differ by so many words at most are one span, and it may lack some of its words.
SLACK, LONG, SHARE = 4, 16, 0.6

# Usual notices of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]
#: Template positions in one word of bits.
BITS = 62


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def gram_hashes(words: Column) -> Column:
    """The hash of the K words from each place."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.xxhash64(F.slice(w, i, K)))
    return let(words, lambda w: F.when(F.size(w) >= K, each(w)).otherwise(F.array().cast("array<bigint>")))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, from 0."""
    parts = phrase.split()
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(starts, lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase)


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(hash, template, length, at, b0, b1, ...): where each hash stands in each template, and the bits of the words there."""
    listed = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(templates)], "template int, text string").select("template", words_of(F.col("text")).alias("words"))
    rows = listed.select("template", F.size("words").alias("length"), F.posexplode(gram_hashes(F.col("words"))).alias("at", "hash"))
    bit = lambda b, j: F.expr(f"CASE WHEN (at + {j}) div {BITS} = {b} THEN shiftleft(1L, (at + {j}) % {BITS}) ELSE 0L END")
    return rows.select("*", *[sum((bit(b, j) for j in range(1, K)), bit(b, 0)).alias(f"b{b}") for b in range(bit_words(templates))])


def bit_words(templates: list[tuple[str, str]]) -> int:
    """Longs that hold a bit for every word of the longest template, whose words are at least two characters apart."""
    return -(-max(len(t) for _, t in templates) // 2 // BITS)


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, template, length, start, stop, covered) of verified spans in documents (doc_id, text_hash, text)."""
    grams = docs.select("doc_id", "text_hash", F.posexplode(gram_hashes(words_of(F.col("text")))).alias("place", "hash"))
    hits = grams.join(F.broadcast(template_table(docs.sparkSession, templates)), "hash")
    key, bits = ["doc_id", "text_hash", "template", "length"], [f"b{b}" for b in range(bit_words(templates))]
    united = [F.bit_or(b).alias(b) for b in bits]
    voted = hits.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.min("place").alias("start"), (F.max("place") + K).alias("stop"), *united)
    line = Window.partitionBy(*key).orderBy("diagonal")
    # A short notice stands on one diagonal, as a word more can make it another licence's.
    slack = F.when(F.col("length") < LONG, 0).otherwise(SLACK)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > slack, F.lit(True))
    merged = voted.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*key, "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *united)
    merged = merged.withColumn("covered", sum((F.bit_count(b) for b in bits), F.lit(0)))
    enough = F.when(F.col("length") < LONG, F.col("covered") == F.col("length")).otherwise(F.col("covered") >= SHARE * F.col("length"))
    return merged.where(enough & (F.col("stop") - F.col("start") <= 2 * F.col("length"))).select(*key, "start", "stop", "covered")


def detect(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels and score."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    label = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), F.col("template") + 1)
    found = spans(base, templates).groupBy(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash")).agg(F.collect_set(label).alias("more"), F.max(F.col("covered") / F.col("length")).alias("best"))
    nowhere = F.array().cast("array<int>")

    def places(words: Column) -> Column:
        """One array for each phrase; its last word is looked for before its words are."""
        return F.array(*[F.when(F.array_contains(words, p.split()[-1]), phrase_places(words, p)).otherwise(nowhere) for p in PHRASES])

    rows = base.select("doc_id", "text_hash", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), places(w).alias("at"))).alias("s"))
    names = [F.when(F.size(F.col("s.at")[k]) > 0, F.lit(name)) for k, name in enumerate(PHRASES.values())]
    rows = rows.select("doc_id", "text_hash", F.col("s.n").cast("long").alias("n_words"), F.flatten("s.at").alias("at"), F.array_sort(F.array_compact(F.array(*names))).alias("names"))
    met = rows.join(found, rows["doc_id"].eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    every = F.array_sort(F.array_union("names", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return met.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("names", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
