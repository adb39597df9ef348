"""License scans by diagonal voting.

Words of every whole text form rolling k-grams (k = 2, the shortest phrase has two words).
Each word is hashed once, to 64 bits, and a k-gram's hash is rolled from those of its words.
All hashes are joined with the template positions that hold the same k-gram; where a hash is one
of the templates', the words go along and are compared, so a collision cannot vote.  A hit votes for the diagonal
offset = place in the text - place in the template; votes are pre-aggregated as bit sets of
template places per (text, template, diagonal).  Diagonals at most ``GAP`` apart are one
occurrence, so a few inserted or missing words do not split it, and a span is verified by
the share of the template's k-grams it holds.  A diagonal with all k-grams of a base phrase
is a place where its words stand consecutively.

The join's other side is the template list, a parameter whose size is checked before it is
broadcast.  Votes are keyed by 128 bits of the text, so copies add nothing to the shuffle.

Defined results: null text is empty (no words, no labels, score 0); repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op3_license_diagonals"

# Fixed values of the contract: base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices of public licenses, as lower-case words.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
     " as published by the free software foundation", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
     " files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following"
     " conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = 3                # diagonals apart at most within one occurrence
COVER = 0.85           # share of a template's k-grams in a verified span
MOST_GRAMS = 100_000   # of all templates together, to be broadcast
BITS = 62              # template places per bit set


_BYTES = bytes(b if b > 127 or chr(b) in "0123456789" + LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))
ROLL = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Lower-case words of a text in UTF-8: all bytes above 127 belong to characters that are in words."""
    return text.translate(_BYTES).split()


def gram_hashes(w: list[bytes]) -> np.ndarray:
    """The rolled 64-bit hash of each 2-gram."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    return (h[:-1] * ROLL + h[1:]).view(np.int64)


def _rolled(wanted: np.ndarray):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grams", pa.list_(pa.int64())), ("said", pa.map_(pa.int32(), pa.string()))])

    def run(batches):
        for batch in batches:
            grams, said = [], []
            for text in batch.column("text").cast(pa.binary()):
                w = words(text.as_py())
                g = gram_hashes(w)
                hits = np.flatnonzero(np.isin(g, wanted)).tolist()
                grams.append(g)
                said.append([(i, f"{w[i].decode()} {w[i + 1].decode()}") for i in hits])
            sizes = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in grams]))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([np.empty(0, np.int64), *grams]))),
                                              pa.array(said, schema.field("said").type)], schema=schema)
    return run


def template_rows(base=BASE, templates=TEMPLATES) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, is_base, grams, place, gram)"""
    out = []
    for t, (phrase, label) in enumerate((*base, *templates)):
        w = phrase.split()
        out += [(t, label, t < len(base), len(w) - 1, i, f"{w[i]} {w[i + 1]}") for i in range(len(w) - 1)]
    return out


def votes(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """a, b (key of the text), template, label, is_base, grams, diagonal, part, bits, low, high: one row per voted diagonal and bit set."""
    rows = [(*r, int(gram_hashes(r[-1].encode().split())[0])) for r in template_rows(base, templates)]
    side = docs.sparkSession.createDataFrame(rows, "template int, label string, is_base boolean, grams int, place int, gram string, h long")
    if len(rows) <= MOST_GRAMS:
        side = F.broadcast(side)
    d = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(store.text_key(F.col("text")).alias("k"), "text").select("k.a", "k.b", "text")
    d = d.mapInArrow(_rolled(np.unique(np.array([r[-1] for r in rows], np.int64))), "a long, b long, grams array<long>, said map<int,string>")
    hits = d.select("a", "b", "said", F.posexplode("grams").alias("pos", "h")).join(side, "h").where(F.col("said")[F.col("pos")] == F.col("gram"))
    return hits.groupBy("a", "b", "template", "label", "is_base", "grams", (F.col("pos") - F.col("place")).alias("diagonal"),
                        F.floor(F.col("place") / BITS).alias("part")).agg(
        F.expr(f"bit_or(shiftleft(1L, place % {BITS}))").alias("bits"), F.min("place").alias("low"), F.max("place").alias("high"))


def spans(voted: DataFrame) -> DataFrame:
    """a, b, label, first, last (words), cover: merged diagonals that verify."""
    run = Window.partitionBy("a", "b", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(run) > GAP
    v = voted.where(~F.col("is_base")).withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    v = v.withColumn("n", F.sum("new").over(run.rangeBetween(Window.unboundedPreceding, 0)))
    one = v.groupBy("a", "b", "template", "label", "grams", "n", "part").agg(
        F.bit_or("bits").alias("bits"), F.min(F.col("diagonal") + F.col("low")).alias("first"), F.max(F.col("diagonal") + F.col("high") + 1).alias("last"))
    one = one.groupBy("a", "b", "template", "label", "grams", "n").agg(
        F.sum(F.bit_count("bits")).alias("held"), F.min("first").alias("first"), F.max("last").alias("last"))
    return one.withColumn("cover", F.col("held") / F.col("grams")).where(F.col("cover") >= COVER)


def places(voted: DataFrame) -> DataFrame:
    """a, b, label, word: where all words of a base phrase stand consecutively."""
    b = voted.where("is_base").groupBy("a", "b", "template", "label", "grams", "diagonal").agg(F.sum(F.bit_count("bits")).alias("held"))
    return b.where("held = grams").select("a", "b", "label", F.col("diagonal").alias("word"))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    voted = store.save(votes(docs, base, templates), "license-votes")
    none = F.array().cast("array<string>")
    at = places(voted).groupBy("a", "b").agg(F.count("*").alias("n_base"), F.min("word").alias("first_word"), F.max("word").alias("last_word"),
                                             F.collect_set("label").alias("base"))
    seen = spans(voted).groupBy("a", "b").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    found = store.save(at.join(seen, ["a", "b"], "full"), "license-found")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", store.text_key(F.col("text")).alias("k"), F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words")).select("doc_id", "n_words", "k.a", "k.b")
    out = d.join(found, ["a", "b"], "left").withColumn("base", F.coalesce("base", none)).withColumn("more", F.coalesce("more", none))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0)))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
                      F.col("last_word").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"), score.alias("score"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(store.table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({t}, '{label}', {str(b).lower()}, {g}, {i}, '{gram}')" for t, label, b, g, i, gram in template_rows())
ORACLE_SQL = rf"""
WITH t(template, label, is_base, grams, place, gram) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT r, unnest(range(0, len(w) - 1)) AS pos, unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS z FROM d WHERE len(w) > 1),
hit AS (SELECT DISTINCT r, template, label, is_base, grams, pos - place AS diagonal, place FROM (SELECT r, pos, z[1] || ' ' || z[2] AS gram FROM g) JOIN t USING (gram)),
base AS (SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base FROM (
  SELECT r, template, label, diagonal FROM hit WHERE is_base GROUP BY r, template, label, diagonal, grams HAVING count(*) = grams) GROUP BY r),
step AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new
  FROM (SELECT DISTINCT r, template, diagonal FROM hit WHERE NOT is_base)),
grp AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS n FROM step),
span AS (SELECT h.r, label, count(DISTINCT place) / grams AS cover FROM hit h JOIN grp USING (r, template, diagonal) GROUP BY h.r, template, label, grams, n
  HAVING count(DISTINCT place) / grams >= {COVER}),
more AS (SELECT r, list(DISTINCT label) AS more, max(cover) AS cover FROM span GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(cover, CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""
