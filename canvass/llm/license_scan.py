"""License notices in documents: MinHash bands over overlapping windows retrieve templates, exact
containment of shingles verifies them. DataFrame functions only.

Words are runs of letters and digits in lower case, shingles five words. A window has four
shingles and windows start at every second one, so each shingle lies in two windows. A window's
band is the least of its four hashes under the band's seed. Templates have windows at every
shingle. Where a document holds a whole template of at least three shingles, one of its windows
equals a template's or has all but one of its shingles in one of the template's: it is missed with
probability 0.25 ** BANDS at most, 6 in 100 million. Shorter templates make up half a window at
most, so they are retrieved by their exact shingles and never missed.

A retrieved template counts where at least ``containment`` of its distinct shingles lie within a
stretch of three times its length around the window.

The documents are read once and their texts are never shuffled; what goes on is the windows that
share a band value or a shingle with some template. Templates are a parameter of bounded size.

Defined cases: null or empty text has no windows; a text of fewer than five words is one shingle;
rows that repeat an id are scanned apart and may each be returned; an empty table or an empty
list of templates gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

WORDS = 5
WINDOW = 4
BANDS = 12
#: Templates of so many shingles at most are retrieved by exact shingles.
SHORT = 2
CONTAINMENT = 0.8

#: Public notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


def _shingles(text: str) -> tuple[Column, Column]:
    """(words of a text column, shingle hashes of a column ``w`` of words)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    n = F.size("w")
    full = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WORDS)]))
    return words, F.when(n >= WORDS, full).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", "w")))).otherwise(F.array().cast("array<bigint>"))


def _windows(texts: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, pos, h0..h3): windows of shingles; a window cut short by the end repeats its first."""
    words, hashes = _shingles("text")
    # explode() of one element keeps the optimizer from computing words and hashes anew for each window.
    rows = texts.select(*keys, F.explode(F.array(words)).alias("w")).select(*keys, F.explode(F.array(hashes)).alias("h")).where(F.size("h") > 0)
    struct = lambda p: F.struct(p.alias("pos"), *[(F.get("h", p + k) if k == 0 else F.coalesce(F.get("h", p + k), F.get("h", p))).alias(f"h{k}") for k in range(WINDOW)])
    last = F.size("h") - 1
    return rows.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), last, F.lit(step)), struct)))


def _bands() -> list[Column]:
    return [F.least(*[F.xxhash64(f"h{k}", F.lit(j)) for k in range(WINDOW)]).alias(f"b{j}") for j in range(BANDS)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_shingle): a row for each notice in each document, with
    its best containment and the place (in shingles) from which it was found."""
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    source = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    own = _windows(source, ["license"], 1).select("license", "pos", "h0", *_bands()).collect()  # bounded by the templates
    sizes: dict[str, set[int]] = {}
    for r in own:
        sizes.setdefault(r.license, set()).add(r.h0)
    shingle_rows = [(name, h, len(hs)) for name, hs in sizes.items() for h in sorted(hs)]
    band_rows = sorted({(r.license, j, r[f"b{j}"]) for r in own for j in range(BANDS)})
    empty = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("bigint").alias("first_shingle"))
    if not own:
        return empty
    shingles = F.broadcast(spark.createDataFrame(shingle_rows, "license string, h bigint, size int"))
    bands = F.broadcast(spark.createDataFrame(band_rows, "license string, band int, value bigint"))

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    windows = _windows(texts, ["row", "doc_id"], WINDOW // 2).select("row", "doc_id", "pos", "h0", "h1", *_bands())
    values = {j: sorted({v for _, k, v in band_rows if k == j}) for j in range(BANDS)}
    alike = F.lit(False)
    for j in range(BANDS):
        alike = alike | F.col(f"b{j}").isin(values[j])
    all_shingles = sorted({h for _, h, _ in shingle_rows})
    exact = F.col("h0").isin(all_shingles) | F.col("h1").isin(all_shingles)
    hits = written(windows.where(alike | exact).select("row", "doc_id", "pos", "h0", "h1", F.array(*[f"b{j}" for j in range(BANDS)]).alias("bands")), "license-windows")

    length = F.col("size").cast("bigint") + WINDOW
    retrieved = hits.select("row", "doc_id", "pos", F.posexplode("bands").alias("band", "value")).join(bands, ["band", "value"])
    retrieved = retrieved.join(F.broadcast(shingles.select("license", "size").distinct()), "license")
    # A window's first two shingles, so that each shingle counts at its own place once.
    placed = hits.select("row", "doc_id", F.explode(F.array(F.struct("pos", F.col("h0").alias("h")), F.struct((F.col("pos") + 1).alias("pos"), F.col("h1").alias("h")))).alias("s")).select("row", "doc_id", "s.pos", "s.h")
    placed = placed.join(shingles, "h")
    at_hit = ["row", "doc_id", "license", F.floor(F.col("pos") / length).alias("stretch")]
    retrieved = retrieved.select(*at_hit).union(placed.where(F.col("size") <= SHORT).select(*at_hit)).distinct()
    placed = placed.select("row", "license", "size", "h", "pos", F.explode(F.array(*[F.floor(F.col("pos") / length) + d for d in (-1, 0, 1)])).alias("stretch"))
    checked = retrieved.join(placed, ["row", "license", "stretch"]).groupBy("row", "doc_id", "license", "size", "stretch").agg(F.countDistinct("h").alias("n"), F.min("pos").cast("bigint").alias("at"))
    best = checked.select("row", "doc_id", "license", (F.col("n") / F.col("size")).alias("containment"), "at").where(F.col("containment") >= containment)
    return best.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("first_shingle")).drop("row")
