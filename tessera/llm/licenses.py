"""License scans: MinHash bands over overlapping text windows, exact verification.

Texts and templates are word sequences (lower case, runs of letters and digits)
with five-word shingles. A document is cut into windows of three shingles every
two, so every run of two shingles lies in a window; a template is indexed by all
its runs of three. Each window and run has ``BANDS`` MinHash bands of one row. A
template of one shingle has a Jaccard similarity of 1/3 to the window around
it and is retrieved with probability 1 - (2/3)^17 = 0.999; longer ones share
whole runs and are retrieved more surely. Retrieved templates are verified by
exact containment of their shingles (as strings) in the whole document.

All of it is DataFrame expressions on the document's own row: no shuffle, no
Python. The templates' bands are literals of the plan (a fixed, small table).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
WIDTH, STRIDE = 3, 2
BANDS = 17

#: The statements looked for, by license.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []


def _longs(values: list[int]) -> Column:
    """An array literal (as SQL text: one call, however many values)."""
    return F.expr(f"from_json('{list(values)}', 'array<bigint>')")


def _constants() -> list[int]:
    """Constants of the permutations ``x -> x xor c`` of the shingles' hashes."""
    return [int(c) for c in np.random.default_rng(5).integers(-2**63, 2**63 - 1, BANDS)]


def _words() -> Column:
    return F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _positions(words: str) -> Column:
    """0 .. number of shingles - 1."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _with_bands(rows: DataFrame, stride: int) -> DataFrame:
    """``rows`` with ``words`` and ``bands``: the MinHash values of all windows."""
    rows = rows.withColumn("words", _words())
    hashes = F.transform(_positions("words"), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE)]))
    rows = rows.withColumn("hashes", hashes)
    starts = F.when(F.size("hashes") > 0, F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda j: F.struct(*[F.get("hashes", j + k).alias(f"h{k}") for k in range(WIDTH)]))
    constants = _longs(_constants())

    def minima(w):
        return F.transform(constants, lambda c: F.least(*[w[f"h{k}"].bitwiseXOR(c) for k in range(WIDTH)]))

    return rows.withColumn("bands", F.flatten(F.transform(windows, minima))).drop("hashes")


def template_bands(spark, templates=TEMPLATES) -> list[tuple[str, list[str], list[int]]]:
    """``(license, shingles, bands)`` of each template, by the same expressions."""
    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(templates)], "i int, text string")
    got = {r.i: r.bands for r in _with_bands(rows, 1).select("i", F.array_distinct("bands").alias("bands")).collect()}
    return [(name, sorted(set(shingles_of(text))), got[i]) for i, (name, text) in enumerate(templates)]


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license, n_shared, n_template, containment)``, a row for each row of
    ``docs`` and template of which it holds at least ``containment``.

    Null and empty texts match nothing; a text of one to four words is one
    shingle. Repeated rows repeat; a null doc_id stays null. Only doc_id and
    text are read.
    """
    index = template_bands(docs.sparkSession, templates)
    rows = _with_bands(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), STRIDE)
    every = sorted({b for _, _, bands in index for b in bands})
    rows = rows.withColumn("hits", F.array_intersect("bands", _longs(every))).drop("bands", "text")
    retrieved = F.array_compact(F.array(*[
        F.when(F.arrays_overlap("hits", _longs(bands)), F.lit(i)) for i, (_, _, bands) in enumerate(index)]))
    # explode_outer: explode would add a filter that evaluates all of the above twice.
    rows = rows.select("doc_id", "words", F.explode_outer(retrieved).alias("i")).filter("i IS NOT NULL")
    own = F.transform(_positions("words"), lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " "))
    wanted = F.array(*[F.array(*[F.lit(s) for s in shingles]) for _, shingles, _ in index])
    names = F.array(*[F.lit(name) for name, _, _ in index])
    rows = rows.select("doc_id", F.get(names, F.col("i")).alias("license"), F.get(wanted, F.col("i")).alias("wanted"), own.alias("own"))
    rows = rows.select("doc_id", "license", F.size(F.array_intersect("wanted", "own")).cast("long").alias("n_shared"), F.size("wanted").cast("long").alias("n_template"))
    return rows.withColumn("containment", F.col("n_shared") / F.col("n_template")).filter(F.col("n_shared") >= F.lit(containment) * F.col("n_template") - 1e-9)
