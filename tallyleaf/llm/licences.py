"""Licence scan with a positional index of rare words, on DataFrame functions only.

Templates are word sequences: short phrases that must stand word for word, and longer notices of which a share must
stand at their relative positions. If ``need`` of a template's ``n`` words stand at one start, one of any
``n - need + 1`` of its words does; the index holds that many postings per template, of the words with the highest inverse document
frequency in the scanned corpus. A file is looked up by the indexed words that it holds, postings and occurrences are intersected
by relative position, and each candidate start is verified: enough words in place, and every word of the mandatory key
phrase. So the index loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf.operators.scale import literal_table

#: Phrase and label.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notice, label and mandatory key phrase.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "mit", "hereby granted free of charge"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
     "apache-2", "apache org licenses license 2 0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "bsd", "redistribution and use in source and binary forms"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     "gpl", "gnu general public license"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
     "lgpl", "gnu lesser general public license"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "isc", "with or without fee is hereby granted"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution 4 0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "creative commons attribution noncommercial"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
]
NOTICE_PERCENT = 80
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, list[str], int, list[int], bool]]:
    """``(number, label, words, need, key places, base)`` of every template."""
    out = []
    for phrase, label in PHRASES:
        words = phrase.split()
        out.append((len(out), label, words, len(words), list(range(len(words))), True))
    for notice, label, key in NOTICES:
        words, keys = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i: i + len(keys)] == keys)
        out.append((len(out), label, words, -(-NOTICE_PERCENT * len(words) // 100), list(range(at, at + len(keys))), False))
    return out


def text_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case. The Kelvin sign is the only other character whose lower case is an ASCII letter."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ"))), SEPARATORS), "")


def rare_postings(docs: DataFrame) -> DataFrame:
    """One row, ``index``: array of (word, template, place), the rarest words of each template by their counts in ``docs``."""
    known = templates()
    listed = literal_table(docs.sparkSession, [(t, i, w, len(words) - need + 1) for t, _, words, need, _, _ in known for i, w in enumerate(words)],
                           "template int; place int; word string; keep int")
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in known for w in t[2]})])
    counts = docs.select(F.explode(F.array_intersect(text_words(F.col("text")), vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    order = Window.partitionBy("template").orderBy(F.coalesce("files", F.lit(0)), "place")
    ranked = listed.join(counts, "word", "left").withColumn("rank", F.row_number().over(order)).where("rank <= keep")
    return ranked.agg(F.sort_array(F.collect_list(F.struct("word", "template", "place"))).alias("index"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row of ``docs``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (null without any). Labels are distinct, sorted and comma-joined; ``score`` is the largest share of a found template's
    words that stands in place, 0 without any. A null text is empty: 0 words and no labels. Long texts are scanned
    whole, repeated rows give equal rows, other columns are ignored, an empty table gives no rows.
    """
    known = templates()
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(need).alias("need"),
                               F.array(*map(F.lit, keys)).alias("keys"), F.lit(base).alias("base")) for _, label, words, need, keys, base in known])
    index = rare_postings(docs)
    rows = docs.select("doc_id", text_words(F.col("text")).alias("words"), index.scalar().alias("index"))
    hit = F.arrays_overlap("words", F.transform("index", lambda p: p["word"]))
    rows = rows.select("doc_id", "words", F.size("words").cast("bigint").alias("n_words"), F.when(hit, F.col("index")).alias("index"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.exists("index", lambda p: p["word"] == F.get("words", i)))
    rows = rows.withColumn("places", F.when(F.col("index").isNotNull(), places))

    def starts(i: Column) -> Column:
        same = F.filter("index", lambda p: p["word"] == F.get("words", i))
        return F.transform(same, lambda p: F.struct(p["template"].alias("template"), (i - p["place"]).alias("start")))

    rows = rows.withColumn("starts", F.array_distinct(F.flatten(F.transform("places", starts))))

    def stands(c: Column, j: Column) -> Column:
        return F.coalesce(F.get("words", c["start"] + j) == F.get(F.get(table, c["template"])["words"], j), F.lit(False))

    def checked(c: Column) -> Column:
        t = F.get(table, c["template"])
        size = F.size(t["words"])
        placed = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda j: stands(c, j)))
        good = (placed >= t["need"]) & F.forall(t["keys"], lambda j: stands(c, j))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["start"].alias("start"), F.when(good, placed / size).alias("share"))

    rows = rows.withColumn("found", F.coalesce(F.filter(F.transform("starts", checked), lambda f: f["share"].isNotNull()), F.expr("array()")))
    base = F.filter("found", lambda f: f["base"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda f: f["label"]))), ",")
    start = F.transform(base, lambda f: f["start"].cast("bigint"))
    return rows.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(start).alias("first_word"),
                       F.array_max(start).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
                       F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"))


def scan_sql() -> str:
    """The same rows in SQL without an index: every template word against every word of every text."""
    listed = ", ".join(f"({t}, '{label}', {i}, '{w}', {need}, {len(words)}, {i in keys}, {len(keys)}, {base})"
                       for t, label, words, need, keys, base in templates() for i, w in enumerate(words))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH t(template, label, place, word, need, size, is_key, keys, base) AS (VALUES {listed}),
        d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
        f AS (SELECT doc_id, template, label, base, pos - place AS start, count(*)::DOUBLE / any_value(size) AS share FROM w JOIN t USING (word)
            GROUP BY doc_id, template, label, base, pos - place HAVING count(*) >= any_value(need) AND count(*) FILTER (is_key) = any_value(keys))
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(g.n_base, 0) AS n_base, g.first_word, g.last_word, coalesce(g.base_labels, '') AS base_labels,
            coalesce(g.labels, '') AS labels, coalesce(g.score, 0) AS score
        FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (base) AS n_base, CAST(min(start) FILTER (base) AS BIGINT) AS first_word,
            CAST(max(start) FILTER (base) AS BIGINT) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id) g USING (doc_id)"""
