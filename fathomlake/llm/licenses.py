"""License scans: MinHash bands over overlapping word windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import where_computed

SPACE = " \t\n\x0b\f\r"

#: License statements as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Windows of 2 * STRIDE words begin at every STRIDE-th word, so that each run of up to STRIDE + 1 words lies in one.
STRIDE = 7
#: Bands of one row. A template piece of five words is one of a window's ten shingles: 1 - (1 - 1/10) ** 96 > 0.9999.
BANDS = 96
SHINGLE = 5


def seed(j: int) -> int:
    """The j-th of the permutations x -> (x ^ seed) * odd, as a signed 64-bit number."""
    x = (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return x - (1 << 64) if x >= 1 << 63 else x


def words_of(text: Column) -> Column:
    """Lower-cased words; none for a null or blank text."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+"))


def shingles(words: Column) -> Column:
    """xxhash64 of each SHINGLE words, in order."""
    place = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(place, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _permuted(j: int):
    return lambda x: x.bitwiseXOR(F.lit(seed(j)).cast("long"))


def band_keys(window: Column) -> Column:
    """Least value of the window's shingles under each permutation, with the permutation's number."""
    return F.array(*[F.xxhash64(F.lit(j), F.array_min(F.transform(window, _permuted(j)))) for j in range(BANDS)])


def pieces(templates: DataFrame) -> DataFrame:
    """Template pieces of up to STRIDE + 1 words, each with its shingles: what a window retrieves."""
    t = templates.withColumn("w", words_of(F.col("template_text")))
    t = t.withColumn("all", F.array_distinct(shingles(F.col("w")))).withColumn("sh", shingles(F.col("w")))
    step = STRIDE + 1 - SHINGLE + 1
    return t.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("sh") - 1, F.lit(0)), F.lit(step)))).withColumn("piece", F.slice("sh", F.col("at") + 1, F.lit(step))).where(F.size("piece") > 0)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, max_templates: int = 2_000) -> DataFrame:
    """One row (id, license, n_shingles, n_found, containment) for each document and template of which the document holds
    at least `containment` of the distinct shingles.

    Windows whose bands collide with a template piece's retrieve the template; shingles of the whole document then verify
    it. A window can only collide where it holds a piece's least shingle, so only such windows' bands are computed: the
    collisions are the same. Templates under five words have no shingle and are refused, as are more than max_templates
    (their bands are held in the plan). Null and empty texts match nothing; rows that share an id are scanned each.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > max_templates or any(len(t.split()) < SHINGLE for t in templates.values()):
        raise ValueError("too many templates, or one under five words")
    spark = docs.sparkSession
    table = pieces(spark.createDataFrame(list(templates.items()), "license string, template_text string"))
    known = table.select("license", "all", "piece", band_keys(F.col("piece")).alias("keys")).collect()
    least: set[int] = set()
    for row in known:
        least |= {min(row["piece"], key=lambda x, s=seed(j): x ^ s) for j in range(BANDS)}
    bands = spark.createDataFrame([(k, r["license"]) for r in known for k in r["keys"]], "__key long, license string").distinct()
    whole = spark.createDataFrame(list({r["license"]: (r["license"], r["all"]) for r in known}.values()), "license string, template_shingles array<long>")
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    d = d.withColumn("__words", words_of(F.col("__text"))).withColumn("__sh", shingles(F.col("__words")))
    hit = F.filter(F.transform(F.col("__sh"), lambda x, i: F.when(x.isin(*sorted(least)), i)), lambda i: i.isNotNull())
    d = where_computed(d.withColumn("__hits", hit), F.size("__hits") > 0)
    # a place lies in the windows that begin at its own stride and at the one before
    begins = F.array_distinct(F.flatten(F.transform(F.col("__hits"), lambda i: F.array(F.floor(i / STRIDE), F.greatest(F.floor(i / STRIDE) - 1, F.lit(0))))))
    width = 2 * STRIDE - SHINGLE + 1
    small = F.array_intersect("__sh", F.array(*[F.lit(x) for x in sorted({x for r in known for x in r["all"]})]))
    d = d.select(F.monotonically_increasing_id().alias("__row"), "__id", "__sh", small.alias("__small"), begins.alias("__begins"))
    windows = d.select("__row", "__id", "__sh", "__small", F.explode("__begins").alias("__b"))
    windows = windows.select("__row", "__id", F.col("__small").alias("__sh"), F.slice("__sh", (F.col("__b") * STRIDE + 1).cast("int"), F.lit(width)).alias("__window"))
    found = windows.select("__row", "__id", "__sh", band_keys(F.col("__window")).alias("__keys"))
    retrieved = found.withColumn("__key", F.explode("__keys")).join(F.broadcast(bands), "__key").groupBy("__row", "license").agg(F.first("__id").alias("__id"), F.first("__sh").alias("__sh"))
    found = retrieved.join(F.broadcast(whole), "license")
    n, got = F.size("template_shingles"), F.size(F.array_intersect("template_shingles", "__sh"))
    out = found.select(F.col("__id").alias(id_col), "license", n.cast("long").alias("n_shingles"), got.cast("long").alias("n_found"), (got / n).alias("containment"))
    return out.where(F.col("containment") >= containment)


def licenses_sql(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """The same in DuckDB's SQL, by comparing all shingles."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(v)})" for k, v in (templates or TEMPLATES).items())
    grams = lambda t, key: f"SELECT DISTINCT {key}, w AS a, lead(w, 1) OVER s AS b, lead(w, 2) OVER s AS c, lead(w, 3) OVER s AS d, lead(w, 4) OVER s AS e FROM (SELECT {key}, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM {t}) WINDOW s AS (PARTITION BY {key} ORDER BY i)"
    return rf"""
WITH t(license, t) AS (VALUES {values}),
tw AS (SELECT license, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS x FROM t),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS x FROM documents),
ts AS (SELECT * FROM ({grams("tw", "license")}) WHERE e IS NOT NULL),
dg AS (SELECT * FROM ({grams("dw", "r")}) WHERE e IS NOT NULL),
n AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
m AS (SELECT r, license, count(*) AS f FROM dg JOIN ts USING (a, b, c, d, e) GROUP BY r, license)
SELECT doc_id, license, n AS n_shingles, f AS n_found, f / n AS containment FROM m JOIN n USING (license) JOIN dw USING (r) WHERE f / n >= {containment}"""
