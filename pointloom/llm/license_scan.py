"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

The windows for a template are as long as it and begin every quarter of its length, so an occurrence overlaps one of
them by seven eighths at least. With ``BANDS`` bands of one value, a window whose Jaccard similarity with the template is
J shares a band with probability ``1 - (1 - J) ** BANDS``: above 0.9999999 at J = 0.65, and always at J = 1. Bands are
computed only for windows that hold a shingle that comes first in a template's band; no other window can collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_sql as S
from ..plans.scratch import Scratch

BANDS = 16

# Notices by which texts state their license.
TEMPLATES: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0-warranty", "distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The table ``license_id, text`` that ``scan`` takes by default."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("text")) for a, b in texts])).alias("r"))
    return rows.select("r.*")


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = 0.75, bands: int = BANDS) -> DataFrame:
    """``doc_id, license_id, containment`` of every document that holds a template: the best of its windows.

    Containment is the share of a template's distinct shingles in a window and a quarter of its length to both sides,
    ``threshold`` at least. Templates without words match nothing, null texts hold nothing, and rows that repeat a doc_id
    add to the same result.
    """
    scratch = Scratch(docs.sparkSession, "license-scan")
    known = templates(docs.sparkSession) if known is None else known
    rows = S.with_words(known.select("license_id", "text"), "text", "w")
    known = rows.select("license_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(S.WIDTH)).alias("width"), S.of_text("w", "hash").alias("hashes"), S.of_text("w", "text").alias("shingles"), "w")
    known = scratch.table(known.where("size(shingles) > 0").withColumn("step", F.greatest(F.lit(1), F.floor(F.col("m") / 4).cast("int"))), "templates")
    sketch = scratch.table(S.sketches(known, ["license_id"], bands), "sketch")
    text = S.with_words(docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("t")), "text", "w").drop("text")
    near = scratch.table(S.hits(text, "w", sketch), "near").dropDuplicates(["doc_id", "t"])
    # only the words around a hit go on: those of the longest window with a quarter to both sides
    reach = 2 * (known.agg(F.max("m")).first()[0] or 1)
    hit = near.select("doc_id", "t", F.explode(F.expr(f"transform(hits, x -> named_struct('at', x.at, 'width', x.width, 'h', x.h, 'from', greatest(0, x.at - {reach}), 'w', slice(w, greatest(0, x.at - {reach}) + 1, {2 * reach + 1})))")).alias("s"))
    hit = hit.select("doc_id", "t", "s.*").join(sketch, ["width", "h"]).join(known.select("license_id", "m", "step", "shingles"), "license_id")
    first, last = "greatest(0, cast(ceil((at + width - m) / step) as int))", "cast(floor(at / step) as int)"
    window = hit.withColumn("q", F.explode(F.expr(f"case when {first} <= {last} then sequence({first}, {last}) else cast(array() as array<int>) end")))
    window = window.withColumn("v", F.expr("slice(w, q * step - from + 1, m)"))
    least = "case " + " ".join(f"when width = {n} then array_min(transform({S.starts('v', n)}, i -> xxhash64({S.hash_at('v', 'i', n)}, band)))" for n in range(1, S.WIDTH + 1)) + " end"
    candidate = window.where(F.expr(least) == F.col("value")).select("doc_id", "license_id", "width", "shingles", F.expr("slice(w, greatest(0, q * step - from - step) + 1, m + step + least(step, q * step - from))").alias("v"))
    own = "case " + " ".join(f"when width = {n} then transform({S.starts('v', n)}, i -> array_join(slice(v, i + 1, {n}), ' '))" for n in range(1, S.WIDTH + 1)) + " end"
    share = candidate.select("doc_id", "license_id", F.expr(f"size(array_intersect({own}, shingles)) / size(shingles)").alias("containment"))
    return share.where(F.col("containment") >= threshold).groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"))
