"""License scans (op2), with DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are five words, hashed. A template of fewer words
is one run of its own length and is found where these words stand in a row. A template of n shingles
is looked for in windows of 2n shingles that start every n, so one of them holds every occurrence
whole. MinHash bands of one row retrieve the templates that a window may hold: an occurrence of the template makes
half of its window's shingles or more, so BANDS bands miss it with a probability of 2^-BANDS (an
occurrence that has lost a fifth of its shingles: 0.64^BANDS, below 1e-6). Then the share of the
template's shingles in the window and its neighbourhood (n before and after) is counted exactly, and AT_LEAST of them make a match.

A window can only agree with a template in a band if they share a shingle, so texts and windows that
hold no shingle of any template are passed over first; that loses nothing. Templates are
constants of the program, so their tables are small literals; texts are read once, and again for the
short ones, and never shuffled.

Defined results: a null or empty text matches nothing; rows that repeat a doc_id are reported together; a
license is reported once a document with its best containment and first place; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 32
AT_LEAST = 0.8

#: Notices by name (fixed values; public license texts).
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means.",
}

#: Notices of fewer than WORDS words.
SHORT = {"all-rights-reserved-line": "All rights reserved."}
NOTICES = TEMPLATES | SHORT


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hashes of all runs of five words (none for fewer)."""

    def of(w: Column) -> Column:
        n = F.size(w) - WORDS
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.slice(w, i + 1, WORDS)))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), of), F.lit(0))  # bound to a name, lest it be computed for each run


def _minhashes(s: Column) -> Column:
    return F.get(F.transform(F.array(s), lambda s: F.array(*(_least(s, b) for b in range(BANDS)))), F.lit(0))


def _least(s: Column, band: int) -> Column:
    return F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(band))))


def _numbered(n: int):
    return lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"))


def template_rows(spark: SparkSession, templates: dict[str, str] = NOTICES) -> DataFrame:
    """license, own (distinct shingles), n, bands of each template of five words or more."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    rows = rows.select("license", F.array_distinct(shingles(words(F.col("text")))).alias("own"))
    return rows.withColumns({"n": F.size("own"), "bands": _minhashes(F.col("own"))}).where(F.col("n") > 0)


def _runs(docs: DataFrame, short: dict[str, list[str]]) -> DataFrame:
    """doc_id, license, containment (1), first place where all words of a short template stand in a row."""

    def at(w: Column, run: list[str]) -> Column:
        start = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: _all([F.get(w, i + j).eqNullSafe(F.lit(x)) for j, x in enumerate(run)]))
        return F.get(start, F.lit(0))

    def found(w: Column) -> Column:
        return F.array(*(F.struct(F.lit(name).alias("license"), at(w, run).alias("first")) for name, run in short.items()))

    # Bound to a name, lest the text be split again for each word; texts without a run's words are passed over before.
    held = _any([_all([F.contains(F.lower("text"), F.lit(x)) for x in run]) for run in short.values()])
    rows = docs.where(held).select("doc_id", F.inline(F.get(F.transform(F.array(words(F.col("text"))), found), F.lit(0))))
    return rows.where(F.col("first").isNotNull()).select("doc_id", "license", F.lit(1.0).alias("containment"), "first")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _short(templates: dict[str, str]) -> dict[str, list[str]]:
    """Words of the templates that have some, but fewer than five."""
    split = {name: [w for w in re.split(r"[\W_]+", text.lower()) if w] for name, text in templates.items()}
    return {name: w for name, w in split.items() if 0 < len(w) < WORDS}


def _long(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """doc_id, license, containment, first of the matches of templates of five words or more."""
    spark = docs.sparkSession
    table = template_rows(spark, templates).collect()  # constants: a row a template
    if not table:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(1.0).alias("containment"), F.lit(0).alias("first")).where(F.lit(False))
    sizes = sorted({r.n for r in table})
    known = sorted({x for r in table for x in r.own})
    hit = lambda x: x.isin(known)
    rows = docs.select("doc_id", shingles(words(F.col("text"))).alias("s"))
    at = F.filter(F.transform("s", lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())
    rows = rows.where(F.exists("s", hit)).withColumn("at", at)
    # For each size: the windows (by number, starting at number * n) that hold a known shingle.
    near = lambda n: F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(F.floor(i / n).cast("int"), (F.floor(i / n) - 1).cast("int")))))
    windows = F.flatten(F.array(*(F.transform(F.filter(near(n), lambda k: k >= 0), _numbered(n)) for n in sizes)))
    rows = rows.select("doc_id", "s", F.inline(windows))
    rows = rows.withColumn("bands", _minhashes(F.slice(F.col("s"), F.col("k") * F.col("n") + 1, 2 * F.col("n"))))
    low = F.greatest(F.lit(0), (F.col("k") - 1) * F.col("n"))
    rows = rows.select("doc_id", "n", "k", "bands", low.alias("low"), F.slice(F.col("s"), low + 1, (F.col("k") + 3) * F.col("n") - low).alias("part"))
    rows = rows.select("doc_id", "n", "low", "part", F.posexplode("bands").alias("band", "value"))
    banded = spark.createDataFrame([(r.license, r.n, b, v, r.own) for r in table for b, v in enumerate(r.bands)], "license string, n int, band int, value long, own array<bigint>")
    found = rows.join(F.broadcast(banded), ["n", "band", "value"])  # templates * BANDS constants
    share = F.size(F.array_intersect("part", "own")) / F.col("n")
    first = F.col("low") + F.array_min(F.filter(F.transform("part", lambda x, i: F.when(F.array_contains("own", x), i)), lambda i: i.isNotNull()))
    return found.select("doc_id", "license", share.alias("containment"), first.alias("first")).where(F.col("containment") >= AT_LEAST)


def scan(docs: DataFrame, templates: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, license, containment (0.8 to 1), first_shingle of every license found."""
    long, short = _long(docs, templates), _short(templates)
    found = long.unionByName(_runs(docs, short)) if short else long
    best = found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first").alias("first_shingle"))
    return best.select("doc_id", "license", "containment", F.col("first_shingle").cast("int").alias("first_shingle"))
