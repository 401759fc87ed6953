"""License scan: MinHash bands over overlapping windows, then exact shingle containment (DataFrame operations only).

Texts and templates become lower-cased runs of letters and digits and five-word shingles (64-bit hashes).
For each length n (in shingles) that a template has, a text has windows of n shingles, one from each place
where any template's shingle stands.  A window's set is hashed to ``BANDS`` bands of ``ROWS`` MinHashes, and
windows that share a band with a template of their length retrieve it.  Shingles that no template has
cannot raise a containment, so they do not enter the sets: they are told inside the row by a hash table of the
templates' shingles, a constant of the plan.  Texts without any have no windows.  Neither have places with fewer template
shingles within n than the containment asks for.

An occurrence that keeps the share c of a template's shingles within its length has, in the window from
its first kept shingle, a Jaccard similarity of at least c / (2 - c) with it (the rest can only be other
templates' shingles), and is retrieved with probability 1 - (1 - (c / (2 - c))^ROWS)^BANDS: over 0.9998 at
c = 0.8 with the settings below, and surely at c = 1.  Retrieved pairs are verified by the exact share of the template's shingles in the window.

A window looks at its own shingles only, so the work is in proportion to a text's template shingles times the
templates' lengths.  The list is taken in parts of at most ``max_shingles`` shingles, one pass over the texts for each; what a
pass shuffles is one row for each text and template retrieved.

Defined cases: null and empty texts match nothing; repeated rows are scanned one by one; templates of
fewer than five words are ignored, those with equal names are one template (the greatest text); an
empty table or list gives no rows; extra columns are kept, those named like the operator's are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, checkpointed, columns_but

SHINGLE = 5
BANDS, ROWS = 16, 2
MIN_CONTAINMENT = 0.8
MAX_SHINGLES = 1 << 16
#: Rows of template bands that may be broadcast.
BROADCAST_BANDS = 1 << 20
PROBES = 4
#: Common notice lines and headers, by SPDX-style name.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-full", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause-full", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]
OWN = {"template", "containment", "n_windows"}


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words, in order."""

    def runs(h: Column) -> Column:
        n = F.size(h) - (SHINGLE - 1)
        starts = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))  # item access is constant-time, slice() copies

    return bound(F.transform(words, lambda w: F.xxhash64(w)), runs)


def band_hashes(hashes: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One hash for each band of MinHashes of the set."""
    out = []
    for b in range(bands):
        mins = [F.array_min(F.transform(hashes, lambda h, s=b * rows + r: F.xxhash64(h, F.lit(s)))) for r in range(rows)]
        out.append(F.xxhash64(F.lit(b), *mins))
    return F.array(*out)


def templates_of(templates: DataFrame) -> DataFrame:
    """template, n, hashes (distinct), class (length in shingles)."""
    named = templates.where(F.col("template").isNotNull()).groupBy("template").agg(F.max("text").alias("text"))
    hashed = named.select("template", shingles_of(words_of(F.col("text"))).alias("h")).where(F.size("h") > 0)
    return hashed.select("template", F.array_distinct("h").alias("hashes"), F.size(F.array_distinct("h")).alias("n"), F.size("h").alias("class"))


def template_table(spark, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if rows is None else rows, "template string, text string")


def hash_table(values: list[int]) -> list[int]:
    """Open addressing: every value within PROBES places of its own; 0 where nothing stands."""
    size = 4
    while size < 2 * len(values):
        size *= 2
    while True:
        table = [0] * (size + PROBES)
        for v in values:
            at = v % size
            free = next((k for k in range(at, at + PROBES) if not table[k]), None)
            if free is None:
                break
            table[free] = v
        else:
            return table
        size *= 2


def in_parts(templates: DataFrame, max_shingles: int) -> Iterator[list[tuple[str, list[int], int, int]]]:
    """The list of templates (a parameter of the operator), at most about max_shingles shingles at a time."""
    part, size = [], 0
    for r in templates_of(templates).toLocalIterator():
        part.append((r["template"], list(r["hashes"]), r["n"], r["class"]))
        size += r["n"]
        if size >= max_shingles:
            yield part
            part, size = [], 0
    if part:
        yield part


def scan(docs: DataFrame, templates: DataFrame, min_containment: float = MIN_CONTAINMENT, keep: list[str] | None = None, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """One row for each document and template found: kept columns, template, containment, n_windows."""
    kept = columns_but(docs, OWN) if keep is None else keep
    found = [_scan(docs, part, min_containment, kept) for part in in_parts(templates, max_shingles)]
    if not found:
        return docs.select(*kept, F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("containment"), F.lit(None).cast("long").alias("n_windows")).where(F.lit(False))
    return functools.reduce(DataFrame.unionByName, found)


def _scan(docs: DataFrame, listed: list[tuple[str, list[int], int, int]], min_containment: float, kept: list[str]) -> DataFrame:
    spark = docs.sparkSession
    table = hash_table(sorted({h for _, hashes, _, _ in listed for h in hashes}))
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    size = len(table) - PROBES

    def is_known(h: Column) -> Column:
        at = F.pmod(h, F.lit(size)).cast("int")
        return functools.reduce(lambda a, b: a | b, (F.get(known, at + k) == h for k in range(PROBES)))

    hits = F.filter(F.transform(shingles_of(words_of(F.col("text"))), lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: is_known(x["h"]))
    # A generator of one row: the filter stays above it, where it would else be a second copy of the expression.
    rows = docs.select(*kept, F.explode(F.array(hits)).alias("__hits")).where(F.size("__hits") > 0)
    rows = checkpointed(rows.withColumn("__row", F.monotonically_increasing_id()))
    least: dict[int, int] = {}
    for _, _, n, c in listed:
        least[c] = min(least.get(c, n), math.ceil(min_containment * n))
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("length"), F.lit(m).alias("least")) for c, m in sorted(least.items())]))
    classed = rows.select("__row", "__hits", classes.alias("__c"))
    # Hit k opens a window if the least-th hit from it on stands within its length.
    far = F.col("__c.least") - 1
    dense = F.filter(F.sequence(F.lit(0), F.size("__hits") - 1), lambda k: F.coalesce(F.get("__hits", k + far)["i"] - F.get("__hits", k)["i"] < F.col("__c.length"), F.lit(False)))
    windows = classed.select("__row", F.col("__c.length").alias("__class"), F.explode(F.transform(dense, lambda k: F.struct(k.alias("k"), band_hashes(window_set(k, F.col("__c.length"))).alias("bands")))).alias("w"))
    banded = windows.select("__row", "__class", "w.k", F.explode("w.bands").alias("__band"))
    of_templates = spark.createDataFrame([(t, h, c) for t, h, _, c in listed], "template string, hashes array<long>, __class int").select("template", "__class", F.explode(band_hashes(F.col("hashes"))).alias("__band"))
    met = banded.join(F.broadcast(of_templates) if BANDS * len(listed) <= BROADCAST_BANDS else of_templates, ["__class", "__band"])
    retrieved = met.groupBy("__row", "__class", "template").agg(F.collect_set("k").alias("__ks"))  # no more than the text has windows
    texts = spark.createDataFrame([(t, h, n) for t, h, n, _ in listed], "template string, __hashes array<long>, __n int")
    pairs = retrieved.join(texts, "template").join(rows, "__row")
    shares = F.filter(F.transform("__ks", lambda k: F.size(F.array_intersect(window_set(k, F.col("__class")), F.col("__hashes"))) / F.col("__n")), lambda c: c >= min_containment)
    exact = pairs.select(*kept, "template", F.explode(F.array(shares)).alias("__shares")).where(F.size("__shares") > 0)
    return exact.select(*kept, "template", F.array_max("__shares").alias("containment"), F.size("__shares").cast("long").alias("n_windows"))


def window_set(k: Column, length: Column) -> Column:
    """The different shingles of the window of that length that begins at hit k of __hits."""
    near = F.slice("__hits", k + 1, length)  # positions differ, so no more hits than that
    return F.array_distinct(F.transform(F.filter(near, lambda x: x["i"] < F.get("__hits", k)["i"] + length), lambda x: x["h"]))
