"""License scan: an exact set-similarity join between the blocks of texts and license templates.

A block is any run of as many consecutive words as a template has, wherever lines break (the whole text if that is shorter).
Tokens are ordered by the number of texts that hold them in the whole corpus, rarest first. A block that holds at least
``ceil(0.8 n)`` of a template's n distinct tokens must hold one of the template's first ``n - ceil(0.8 n) + 1`` tokens in
that order (prefix filter), so only the neighbourhoods of prefix tokens are looked at. A neighbourhood must have enough
template tokens at all (length filter) and enough of them left from the first shared token on (positional filter). In
what passes, the distinct template tokens of every block are counted. Tokens outside all templates cannot add to an
overlap, so frequencies and ranks are kept for template tokens alone: a table bounded by the templates.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

THRESHOLD = 0.8
_FRAME = 1 << 30

# The phrases of the base scan with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Sentences of public license texts with the labels they stand for.
TEMPLATES = (
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _NOT_WORD else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text after lower-casing A-Z: runs of 0-9, a-z and everything beyond ASCII."""
    return text.translate(_FOLD).split()


def _phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands, in words joined by single spaces with one at each end."""
    out, at, word, last = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", last, at)
        last = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


def _neighbourhoods(ranks: list[tuple[int, int]], reach: dict[int, int]) -> list[dict]:
    """The template tokens (place, rank) around prefix tokens, those of overlapping neighbourhoods together."""
    out: list[list[int]] = []
    for low, high in sorted((at - reach[r], at + reach[r]) for at, r in ranks if r in reach):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    places = [at for at, _ in ranks]
    return [{"at": [at for at, _ in cut], "ranks": [r for _, r in cut]} for low, high in out for cut in [ranks[bisect_left(places, low) : bisect_right(places, high)]]]


def _scan(docs: DataFrame, vocabulary: dict[bytes, int], required: int, reach: dict[int, int]) -> DataFrame:
    """The base columns of every document and its neighbourhoods of prefix tokens with enough template tokens.

    ``reach``: for each prefix token, the words before or behind it that a block of its templates can hold.
    """
    phrases = [(f" {p} ".encode(), label) for p, label in PHRASES]
    block = pa.struct([("at", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32()))])
    prefix = {w for w, r in vocabulary.items() if r in reach}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for b in small_batches(batches):
            rows = []
            for text in b.column("text").to_pylist():
                split = words(text or b"")
                joined = b" " + b" ".join(split) + b" "
                places, labels = [], []
                for p, label in phrases:
                    if here := _phrase_places(joined, p):
                        places += here
                        labels.append(label)
                blocks, here = [], known & set(split)
                if len(here) >= required and not prefix.isdisjoint(here):
                    ranks = [(i, vocabulary[w]) for i, w in enumerate(split) if w in here]
                    blocks = [x for x in _neighbourhoods(ranks, reach) if len(set(x["ranks"])) >= required]
                rows.append((len(split), len(places), min(places, default=None), max(places, default=None), sorted(set(labels)), blocks))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(block)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, blocks array<struct<at:array<int>,ranks:array<int>>>"
    )


def token_frequencies(docs: DataFrame, tokens: list[bytes]) -> dict[bytes, int]:
    """In how many texts of the whole corpus each of the given tokens stands."""
    wanted = frozenset(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in small_batches(batches):
            for text in b.column("text").to_pylist():
                counts.update(wanted & set(words(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.binary()), pa.array(list(counts.values()), type=pa.int64())], names=["token", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {t: 0 for t in tokens} | {bytes(r["token"]): r["n"] for r in found.collect()}  # at most one row a template token


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base (labels), matches (label, start, containment).

    ``matches`` holds for each template found its best block (the first of equal ones) by the number of its first template
    token's word. Null and empty texts have no words and no places; texts of any length are read whole, whatever their line
    breaks. Repeated rows are scanned again, null doc_ids kept, other columns ignored; an empty table stays empty. Templates
    without words are ignored.
    """
    spark = docs.sparkSession
    sets = [(label, split, set(split)) for label, text in templates if (split := words(text.encode()))]
    tokens = sorted(set().union(*(s for *_, s in sets)) if sets else set())
    seen = token_frequencies(docs, tokens)
    rank = {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (seen[t], t)))}
    rows, required, reach = [], [], {}
    for k, (label, split, s) in enumerate(sets):
        ranks, need = sorted(rank[t] for t in s), math.ceil(threshold * len(s) - 1e-9)
        required.append(need)
        for i in range(len(s) - need + 1):
            rows.append((ranks[i], i, k, label, ranks, need, len(split)))
            reach[ranks[i]] = max(reach.get(ranks[i], 0), len(split) - 1)
    prefix = spark.createDataFrame(rows, "rank int, i int, template int, label string, ranks array<int>, need int, width int")
    scanned = cut(_scan(docs, rank, min(required, default=1), reach).withColumn("_id", F.monotonically_increasing_id()), "op5-scan")
    near = scanned.select("_id", F.posexplode("blocks").alias("block", "b")).select("_id", "block", "b.at", F.col("b.ranks").alias("held"), F.array_sort(F.array_distinct("b.ranks")).alias("own"))
    met = (
        near.select("*", F.posexplode("own").alias("j", "rank"))
        .join(F.broadcast(prefix), "rank")  # bounded: the prefix tokens of the templates
        .where((F.size("own") - F.col("j") >= F.col("need")) & (F.size("ranks") - F.col("i") >= F.col("need")) & (F.size(F.array_intersect("own", "ranks")) >= F.col("need")))
        .dropDuplicates(["_id", "block", "template"])
    )
    hits = met.select("_id", "block", "template", "label", "ranks", "need", "width", F.explode(F.arrays_zip("at", "held")).alias("h")).where("array_contains(ranks, h.held)")
    # Places are stretched so that one frame length fits the blocks of every template.
    stretched = hits.withColumn("x", F.col("h.at") * F.floor(F.lit(_FRAME) / F.col("width")).cast("bigint"))
    ahead = Window.partitionBy("_id", "block", "template").orderBy("x").rangeBetween(0, _FRAME - max((len(x) for _, x, _ in sets), default=1) - 1)
    counted = stretched.withColumn("overlap", F.size(F.collect_set("h.held").over(ahead))).where("overlap >= need")
    best = counted.groupBy("_id", "template").agg(F.first("label").alias("label"), F.max(F.struct("overlap", (-F.col("h.at")).alias("back"))).alias("m"), F.max(F.size("ranks")).alias("n"))
    found = best.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("label", (-F.col("m.back")).alias("start"), (F.col("m.overlap") / F.col("n")).alias("containment")))).alias("matches"))
    return scanned.join(found, "_id", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)).alias("matches"))


def op5_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_join(F.array_sort(F.array_union("base", F.transform("matches", lambda m: m["label"]))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def _template_sql() -> str:
    rows = ", ".join(f"({k}, '{label}', {len(words(text.encode()))}, [{', '.join(repr(w.decode()) for w in sorted(set(words(text.encode()))))}])" for k, (label, text) in enumerate(TEMPLATES))
    return f"SELECT * FROM (VALUES {rows}) AS v(template, label, width, tokens)"


def oracle_sql() -> str:
    """The same result stated plainly: words as rows, phrases by the words that follow, every block of a template's width that begins with one of its tokens."""
    fold = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    longest = max(len(phrase.split()) for phrase, _ in PHRASES)
    following = ", ".join(f"lead(x, {k}) OVER w AS x{k}" for k in range(1, longest))
    places = " UNION ALL ".join(f"SELECT doc_id, i AS place, '{label}' AS label FROM ahead WHERE " + " AND ".join(f"x{k or ''} = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({fold.format("text")}, {word}) AS w FROM documents),
at_word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
ahead AS (SELECT *, {following} FROM at_word WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM places GROUP BY doc_id),
templates AS (SELECT template, label, width, len(tokens) AS n, unnest(tokens) AS x FROM ({_template_sql()})),
held AS (SELECT doc_id, template, label, width, n, x, i FROM at_word JOIN templates USING (x)),
full_ AS (SELECT doc_id, template FROM held GROUP BY doc_id, template HAVING count(DISTINCT x) >= ceil({THRESHOLD} * any_value(n) - 1e-9)),
blocks AS (SELECT doc_id, label, n, count(DISTINCT x) OVER (PARTITION BY doc_id, template ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n_held FROM held JOIN full_ USING (doc_id, template)),
hits AS (SELECT doc_id, label, n_held / n AS c FROM blocks WHERE n_held >= ceil({THRESHOLD} * n - 1e-9)),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)"""
