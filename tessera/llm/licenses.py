"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Tokens stand in one global order, rarest first by the number of documents that hold them. A template of
n tokens is contained in a block if at least ceil(THRESHOLD * n) of its tokens are there, so one of its
first n - ceil(THRESHOLD * n) + 1 must be (prefix filter); a block needs as many template tokens as that
minimum (length filter), and what may follow the first shared token must suffice (positional filter).
The pairs left are counted exactly.

A block is each window of BLOCK_WORDS words of a text at every BLOCK_WORDS / 2 words, whatever the line ends, so
that each passage of half a window lies in one block, however it is wrapped. As words of unrelated lines meet in
a window by chance, a template's tokens must stand within SPAN times its words there. Only template tokens of a
block matter, and templates are a fixed list: what is collected or broadcast has its size. Words of blocks are
lower-cased as Unicode has it, those of the plain phrases in A-Z alone.

Rows: a null text is empty, has no words and no label, and scores 0. Repeated rows get the same result
each, and ties (several blocks or templates of a label) one label. Results meet their rows by (id, hash of the
text), nulls equal to nulls. Empty tables give empty results. Columns of the input named as results are replaced.
Texts of any length are scanned whole; their words are held one text at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower

#: What separates words, and the phrases of the plain scan.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before letters are lower-cased, as a positive class with its most frequent part first: long negated classes are slow.
WORD_ANY_CASE = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]++"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences of well-known licenses, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it under the terms of the gnu affero general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
#: Share of a template's tokens that a block must hold, and the words of a block.
THRESHOLD, BLOCK_WORDS = 0.8, 64
#: Words that a template may take up, as a multiple of its own (what marks comments may stand between).
SPAN = 1.25


def needed(n: int) -> int:
    return math.ceil(THRESHOLD * n - 1e-9)


def span(sentence: str) -> int:
    return int(SPAN * len(sentence.split()))


def _words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def ordered_tokens(df: DataFrame, text: str = "text") -> list[str]:
    """All template tokens, those in the fewest documents first; one row for each template token reaches the driver."""
    every = sorted({w for _, t in TEMPLATES for w in t.split()})
    held = F.array_intersect(_words(F.lower(F.col(text))), F.array(*map(F.lit, every)))
    counts = df.select(F.explode(held).alias("token")).groupBy("token").count()
    found = {r["token"]: r["count"] for r in counts.collect()}
    return sorted(every, key=lambda w: (found.get(w, 0), w))


def license_blocks(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each block and template that it contains: keys, word where the block begins, template, label, containment."""
    spark = df.sparkSession
    order = ordered_tokens(df, text)
    rank = {w: i for i, w in enumerate(order)}
    templates, prefixes = [], []
    for i, (label, sentence) in enumerate(TEMPLATES):
        tokens = sorted(set(sentence.split()), key=rank.__getitem__)
        n, o = len(tokens), needed(len(tokens))
        templates.append((i, label, tokens, span(sentence)))
        prefixes += [(tokens[j], i, j, n, o) for j in range(n - o + 1)]
    any_rare = F.array(*map(F.lit, sorted({p[0] for p in prefixes})))
    least = min(p[4] for p in prefixes)
    likely = df.select(*keys, _words(F.lower(F.col(text))).alias("_words")).where(F.arrays_overlap("_words", any_rare))
    half = BLOCK_WORDS // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - half - 1, F.lit(0)), F.lit(half))
    cut = F.transform(starts, lambda at: F.struct(at.alias("word"), F.slice("_words", at + 1, F.lit(BLOCK_WORDS)).alias("block")))
    cut = F.filter(cut, lambda b: F.arrays_overlap(b["block"], any_rare))
    blocks = likely.select(*keys, F.explode(cut).alias("_b")).select(*keys, "_b.word", F.col("_b.block").alias("_block"))
    blocks = blocks.withColumn("_tokens", F.array_intersect(F.array(*map(F.lit, order)), "_block")).where(F.size("_tokens") >= least)
    index = spark.createDataFrame(prefixes, "token string, template int, _at int, _n int, _needed int")
    tokens = spark.createDataFrame(templates, "template int, label string, _of array<string>, _span int")
    seen = blocks.select(*keys, "word", "_block", "_tokens", F.posexplode("_tokens").alias("_pos", "token"))
    pairs = seen.join(F.broadcast(index), "token")
    size = F.size("_tokens")
    pairs = pairs.where((size >= F.col("_needed")) & (1 + F.least(size - F.col("_pos") - 1, F.col("_n") - F.col("_at") - 1) >= F.col("_needed")))
    # each pair once: at the first token that both hold
    pairs = pairs.join(F.broadcast(tokens), "template").withColumn("_both", F.array_intersect("_tokens", "_of"))
    pairs = pairs.where((F.get("_both", F.lit(0)) == F.col("token")) & (F.size("_both") >= F.col("_needed")))
    near = F.transform(F.sequence(F.lit(1), F.size("_block")), lambda i: F.size(F.array_intersect("_of", F.slice("_block", i, F.col("_span")))))
    pairs = pairs.withColumn("_held", F.array_max(near)).where(F.col("_held") >= F.col("_needed"))
    return pairs.select(*keys, "word", "template", "label", (F.col("_held") / F.col("_n")).alias("containment"))


def _starts(phrase: list[str], label: str):
    """A function of a word and its place: (label, place) if the phrase begins there, else null."""

    def here(w: Column, i: Column) -> Column:
        hit = w == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            hit = hit & (F.get(F.col("_words"), i + k) == word)
        return F.when(hit, F.struct(F.lit(label).alias("label"), i.cast("long").alias("word")))

    return here


def phrase_places(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words and places: an array of (label, word) for every place where a phrase's words stand consecutively."""
    low = F.lower(F.col(text))
    likely = F.contains(low, F.lit("license")) | low.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]++by")
    out = df.withColumn("n_words", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long"))
    out = out.withColumn("_words", F.when(likely, _words(ascii_lower(F.col(text)))).otherwise(F.array().cast("array<string>")))
    found = [F.filter(F.transform("_words", _starts(phrase.split(), label)), lambda x: x.isNotNull()) for phrase, label in PHRASES.items()]
    return out.withColumn("places", F.concat(*found)).drop("_words")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    score is 1 with a phrase, else the largest containment of a template in a block, else 0.
    """
    keyed = df.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    hits = license_blocks(keyed, ["_id", "_h"], "_text").groupBy("_id", "_h").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"), F.count_distinct("word").alias("_blocks"))
    hits = hits.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "_more", "_best", "_blocks")
    base = phrase_places(keyed, "_text").drop("_text")
    out = base.join(hits, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    labels = F.array_distinct(F.col("places")["label"])
    starts = F.col("places")["word"]
    return out.select(
        F.col("_id").alias(doc_id),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(labels, F.coalesce("_more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        F.coalesce("_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
