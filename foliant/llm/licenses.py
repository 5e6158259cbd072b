"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words that no template has cannot add to a template's containment, so only five-word shingles that occur
in some template go on (one join on their hashes).  For each size class of templates the positions fall
into windows twice the class's length that overlap by half, so every occurrence lies within one window.
Least hashes of a window and of a template agree with the probability of their Jaccard similarity; a
window that holds ``similarity`` of a template has at least ``floor_similarity`` even if the rest of it is
full of other templates, and ``bands`` of one row each miss it with probability (1 - floor)^bands.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .positions import at_positions, sized, with_words, word_hash

SHINGLE = 5

# Short notices of public licences, each as it is commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("template_id"), F.lit(name).alias("license"), F.lit(text).alias("text")) for n, (name, text) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def bands_for(floor_similarity: float, miss: float) -> int:
    """Bands of one row that keep the probability of missing a pair at or below ``miss``."""
    return ceil(log(miss) / log(1 - floor_similarity))


def scan(
    docs: DataFrame, known: DataFrame | None = None, *, similarity: float = 0.8, floor_similarity: float = 0.25, miss: float = 1e-4, shingle: int = SHINGLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, template_id, license, containment, n_windows: one row for each document and template found in it.

    ``known`` has template_id, license and text (default: TEMPLATES).  Words are lower-cased runs between
    white space.  Null and empty texts, and texts or templates with fewer words than a shingle, match
    nothing; rows that repeat an id and a text count once; a null id is kept as null; an empty table gives
    an empty result; other columns are not read.
    """
    known = known if known is not None else templates(docs.sparkSession)
    hashed = word_hash(tuple(range(shingle)))
    parts = at_positions(with_words(known.select("template_id", "text"), "template_id", "text"), shingle).select(F.col("_id").alias("template_id"), hashed.alias("h"))
    sets = parts.groupBy("template_id").agg(F.collect_set("h").alias("t_set")).withColumn("cls", F.greatest(F.ceil(F.log2(F.size("t_set"))), F.lit(0)).cast("int"))
    seeds = bands_for(floor_similarity, miss)
    classes = [r[0] for r in sets.select("cls").distinct().orderBy("cls").collect()]  # at most the logarithm of the longest template
    if not classes:
        classes = [0]
    vocabulary = sized(parts.select("h").distinct())
    hits = at_positions(with_words(docs, id_col, text_col), shingle).select("_id", "_key", "_pos", hashed.alias("h")).join(vocabulary, "h", "left_semi")
    placed = hits.select(
        "_id", "_key", "h",
        F.explode(F.flatten(F.array(*[_windows(c) for c in classes]))).alias("w"),
    ).select("_id", "_key", "h", "w.cls", "w.at")
    # a window has at most twice the class's length in shingles, so its set is bounded
    windows = placed.groupBy("_id", "_key", "cls", "at").agg(F.collect_set("h").alias("w_set"))
    bands = sized(sets.select("cls", "template_id", F.explode(_bands("t_set", seeds)).alias("band")))
    found = windows.select("*", F.explode(_bands("w_set", seeds)).alias("band")).join(bands, ["cls", "band"]).select("_id", "_key", "cls", "at", "w_set", "template_id").dropDuplicates(["_id", "_key", "cls", "at", "template_id"])
    verified = found.join(sized(sets.select("template_id", "t_set")), "template_id").withColumn("containment", F.size(F.array_intersect("w_set", "t_set")) / F.size("t_set")).filter(F.col("containment") >= similarity - 1e-9)
    return (
        verified.groupBy("_id", "template_id")
        .agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"))
        .join(sized(known.select("template_id", "license")), "template_id")
        .select(F.col("_id").alias(id_col), "template_id", "license", "containment", "n_windows")
    )


def _windows(cls: int) -> Column:
    """The two overlapping windows of a class that hold a position (one at the start of a text)."""
    step = 1 << cls
    at = F.floor(F.col("_pos") / step).cast("int")
    window = lambda place: F.struct(F.lit(cls).alias("cls"), place.alias("at"))
    return F.when(at > 0, F.array(window(at), window(at - 1))).otherwise(F.array(window(at)))


def _bands(column: str, seeds: int) -> Column:
    """One hash for each band: the seed with the least of the re-hashed shingles."""
    return F.transform(F.sequence(F.lit(1), F.lit(seeds)), lambda s: F.xxhash64(s, F.array_min(F.transform(F.col(column), lambda h: F.xxhash64(s, h)))))
