"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are the lower-cased runs of letters and digits; elements are runs of five words, as 64-bit hashes.  A template of
w words is looked for in windows of ``1.25 w`` words and a quarter of it as step, so that a passage that holds the
template with up to a quarter more words lies whole in some window.  Template and window share a band if their smallest
hash under one of the template's hash functions agrees.  The number of functions follows from the smallest Jaccard
similarity that a window with containment ``threshold`` can have, so that the chance of missing such a window is below
``miss``.  Windows retrieved are matches if they hold at least ``threshold`` of the template's elements.

A band can only agree if the window holds the element with the template's smallest hash ("anchor"), so documents
without any anchor, and windows without one, are passed over before anything is hashed again: this loses nothing that
the bands would find.

All steps are DataFrame functions without a shuffle before the last aggregate.  The templates are a bounded list (a
parameter), so they become literals of the plan.  Defined results: a null or empty text and a template or text of fewer than five words match
nothing; texts are read whole; rows with one key are one document; an empty table gives an empty table; only the named
columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by which public licenses are applied to a work, and licence texts: short ones whole, long ones by
# a passage that every copy holds.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("apache-2.0-short", "Licensed under the Apache License v2"),
    ("apache-2.0-brief", "Licensed under Apache 2.0"),
    ("apache-2.0-text", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall "
     "mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this "
     "document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting "
     "the License."),
    ("mit-licensed", "Licensed under the MIT License"),
    ("mit-distributed", "Distributed under the MIT License"),
    ("mit-available", "Available under the MIT License"),
    ("mit-terms", "Under the terms of the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
     "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
     "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("gpl-licensed", "Licensed under the GNU General Public License"),
    ("gpl-text", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The "
     "licenses for most software and other practical works are designed to take away your freedom to share and change "
     "the works."),
    ("lgpl", "Under the GNU Lesser General Public License"),
    ("lgpl-terms", "Under the terms of the GNU Lesser General Public License"),
    ("lgpl-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl-3.0-text", "This version of the GNU Lesser General Public License incorporates the terms and conditions of "
     "version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("agpl", "Under the GNU Affero General Public License"),
    ("agpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation"),
    ("agpl-text", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of "
     "works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("bsd-licensed", "Licensed under the BSD License"),
    ("bsd-3-clause", "Licensed under the 3-Clause BSD License"),
    ("bsd-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
     "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
     "PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc-licensed", "Licensed under the ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
     "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
     "be held liable for any damages arising from the use of this software."),
    ("mpl-2.0-licensed", "Licensed under the Mozilla Public License"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0"),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("cc0-1.0-waiver", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work"),
    ("cc-by-4.0-short", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0-short", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-available", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc-by-nc-4.0-long", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0-short", "Licensed under CC BY-ND 4.0"),
)
# End of fixed values.

SHINGLE = 5


@dataclass(frozen=True)
class ScanParams:
    threshold: float = 0.8
    miss: float = 1e-4


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def elements(w: str) -> Column:
    """The hashes of all five-word runs of an array column of words."""
    return F.expr(f"""CASE WHEN size({w}) >= {SHINGLE} THEN transform(sequence(0, size({w}) - {SHINGLE}), i ->
        xxhash64({", ".join(f"get({w}, i + {k})" for k in range(SHINGLE))})) ELSE array() END""")


def band_count(p: ScanParams, n_words: int) -> tuple[int, int, int]:
    """(bands, elements of a window, step) for a template of n words."""
    n = n_words - SHINGLE + 1
    step = max(1, n_words // 4)
    window = math.ceil(1.25 * n_words) + step - SHINGLE
    held = math.ceil(p.threshold * n)
    least = held / (window + n - held)
    return max(1, math.ceil(math.log(p.miss) / math.log(1 - min(least, 0.999)))), window, step


def smallest(parts: str, bands: str) -> Column:
    """The smallest hash of an element array under each of the functions 0 .. bands - 1."""
    return F.expr(f"transform(sequence(0, {bands} - 1), k -> array_min(transform({parts}, x -> xxhash64(x, k))))")


def template_rows(spark: SparkSession, templates, p: ScanParams) -> list[dict]:
    """``license_id, parts, bands, window, step, marks, anchors`` of the templates of five words or more.

    Three small collects, so that no step is computed again inside the next one's functions.
    """
    texts = spark.createDataFrame([(i, t) for i, t in templates], "license_id string, body string")
    split = texts.select("license_id", words(F.col("body")).alias("w")).collect()
    sized = [(r["license_id"], list(r["w"]), *band_count(p, len(r["w"]))) for r in split if len(r["w"]) >= SHINGLE]
    if not sized:
        return []
    table = spark.createDataFrame(sized, "license_id string, w array<string>, bands int, window int, step int")
    table = spark.createDataFrame(
        table.select("license_id", F.array_distinct(elements("w")).alias("parts"), "bands", "window", "step").collect(),
        "license_id string, parts array<long>, bands int, window int, step int")
    marked = spark.createDataFrame(
        table.withColumn("marks", smallest("parts", "bands")).collect(),
        "license_id string, parts array<long>, bands int, window int, step int, marks array<long>")
    return [r.asDict() for r in marked.withColumn("anchors", F.expr(
        "array_distinct(transform(marks, (m, k) -> filter(parts, x -> xxhash64(x, k) = m)[0]))"))
        .orderBy("license_id").collect()]


def scan(df: DataFrame, templates=TEMPLATES, p: ScanParams = ScanParams(), key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """``key, license_id, containment, first_word, n_windows``: every template that a document holds, its best
    containment, the first word of the first matching window and the number of matching windows."""
    rows = template_rows(df.sparkSession, templates, p)

    def longs(values) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.expr("cast(array() as array<long>)")

    plans = F.array(*[F.struct(F.lit(r["license_id"]).alias("license_id"), longs(r["parts"]).alias("body"),
                               F.lit(len(r["parts"])).alias("n"), F.lit(r["bands"]).alias("bands"),
                               F.lit(r["window"]).alias("window"), F.lit(r["step"]).alias("step"),
                               longs(r["marks"]).alias("marks"), longs(r["anchors"]).alias("anchors"))
                      for r in rows])
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, license_id string, containment double, " \
          "first_word long, n_windows long"
    if not rows:
        return df.sparkSession.createDataFrame([], out)
    all_anchors = longs(sorted({a for r in rows for a in r["anchors"]}))
    # The row number, kept by a filter that always holds, is a barrier: later filters are not pushed to where words are
    # split, which would split a text again for every element.
    docs = (df.select(F.col(key).alias("doc_key"), words(F.col(text)).alias("w"))
            .select("doc_key", elements("w").alias("parts"), F.monotonically_increasing_id().alias("row"))
            .filter("row >= 0"))
    near = (docs.select("doc_key", "parts", F.array_intersect("parts", all_anchors).alias("hit"),
                        F.monotonically_increasing_id().alias("row")).filter("row >= 0 AND size(hit) > 0"))
    pairs = near.select("doc_key", "parts", F.explode(F.filter(
        plans, lambda t: F.arrays_overlap(t["anchors"], F.col("hit")))).alias("t"), F.monotonically_increasing_id().alias("row")).filter("row >= 0")
    windows = (pairs.select("doc_key", "t", "parts", F.explode(F.expr("sequence(0, size(parts) - 1, t.step)"))
                            .alias("start"))
               .withColumn("part", F.slice("parts", F.col("start") + 1, F.col("t.window")))
               .filter(F.arrays_overlap("part", "t.anchors")))
    retrieved = windows.filter(F.exists(F.arrays_zip(smallest("part", "t.bands").alias("own"),
                                                     F.col("t.marks").alias("marks")),
                                        lambda z: z["own"] == z["marks"]))
    share = F.size(F.array_intersect("t.body", "part")) / F.col("t.n")
    return (retrieved.select("doc_key", "t.license_id", share.alias("containment"), "start")
            .filter(F.col("containment") >= p.threshold)
            .groupBy(F.col("doc_key").alias(key), "license_id")
            .agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"),
                 F.count("*").alias("n_windows")))
