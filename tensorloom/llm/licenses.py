"""License scan with DataFrame operations only: sparse TF-IDF cosine to templates, then inheritance along directories.

Templates are full license texts (the files of license_texts) and statements:
standard headers, names and SPDX ids.  Their terms go to every task as small
broadcast tables.  Only passages with a word of the law (CUE) are compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import looked_up, stage

#: Names by which statements call a license.
NAMES = {
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0 license"),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0 license"),
    "Artistic-1.0-Perl": ("Artistic License",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause license"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0 license"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0 license"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0 license"),
    "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0 license"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal public domain dedication", "CC0 1.0 license"),
    "EPL-1.0": ("Eclipse Public License v1.0",),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License 2.0"),
    "GFDL-1.2": ("GNU Free Documentation License, version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, version 1.3",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3 license"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1 license"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3 license"),
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License", "MIT-0 license"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "PSF-2.0": ("Python Software Foundation License Version 2",),
    "Unlicense": ("Unlicense license",),
    "Zlib": ("zlib License",),
}
_FSF = {"AGPL-3.0": "GNU Affero General Public License", "GPL-2.0": "GNU General Public License", "GPL-3.0": "GNU General Public License", "LGPL-2.1": "GNU Lesser General Public License", "LGPL-3.0": "GNU Lesser General Public License"}


def _version(name: str) -> str:
    return name.split("-")[1].removesuffix(".0")


#: Statements that several licenses share, and names without a version; they count where a text says nothing more definite.
FRAGMENTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    *((x, f"{how} {name}") for x, name in (("AGPL", "GNU Affero General Public License"), ("Apache", "Apache License"), ("BSD", "BSD License"), ("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License")) for how in ("Licensed under the", "The")),
)
#: Statements and standard headers by which texts name their license; a license may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    *((x, f"{how} {name}") for x, names in NAMES.items() for name in names for how in ("Licensed under the", "The")),
    *((x, f"SPDX-License-Identifier: {x}") for x in NAMES),
    *((x, f"SPDX-License-Identifier: {x}-only") for x in _FSF),
    *((f"{x}-or-later", f"SPDX-License-Identifier: {x}{end}") for x in _FSF for end in ("-or-later", "+")),
    *((f"{x}-or-later", f"Licensed under the {n}, version {_version(x)} or (at your option) any later version") for x, n in _FSF.items()),
    *((x, f"is free software: you can redistribute it and/or modify it under the terms of the {n} as published by the Free Software Foundation, version {_version(x)} of the License.") for x, n in _FSF.items()),
    *((f"{x}-or-later", f"is free software: you can redistribute it and/or modify it under the terms of the {n} as published by the Free Software Foundation, either version {_version(x)} of the License, or (at your option) any later version.") for x, n in _FSF.items()),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *FRAGMENTS,
)
#: Words that say nothing about which license is meant.
STOP = frozenset(
    "a all an and any are as at be by can details do file files find for found from had has have if in information into is it its may more must not of on or other our project program see shall software such that the their these this those to "
    "under use was we where which will with work you your code library package copyright c distributed released terms http https".split()
)
#: What a term counts that no template has, and the least that these words count in a statement: a name alone is none ("mit" is a German word).
UNKNOWN = 2.0
LAW, LAW_WORDS = 3.5, frozenset(("licence", "license", "licensed"))
#: Only passages with a word of the law are compared, so every template must have one.
CUE = r"(?i)licen[cs]|permission|permitted|public domain|redistribut|\b[al]?gpl"
TEXTS = Path(__file__).with_name("license_texts")


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole licenses, by the names of their files."""
    return tuple((p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt")))


THRESHOLD = 0.8
MAX_TEMPLATES = 5_000
FILE_NAMES = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[^a-z0-9.\-]+"


def terms(text: str) -> list[str]:
    return [t for t in (x.strip(".-") for x in re.split(TERM, text.lower())) if t]


def term_array(text: Column) -> Column:
    """Terms of a text: runs of a-z, 0-9, dots and hyphens of the lower-cased text, without dots and hyphens at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), TERM), lambda t: F.trim(t, F.lit(".-"))), lambda t: t != "")


class Vectors:
    """TF-IDF of the templates.  idf(t) = ln((1 + T) / (1 + templates with t)) + 1, ``law`` at least for LAW_WORDS, 0 for STOP and UNKNOWN for others; tf is the count."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, law: float = LAW) -> None:
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        if bare := [t for _, t in templates if not re.search(CUE, t)]:
            raise ValueError(f"no word of the law in a template: {bare[0][:80]}")
        counts = [Counter(terms(t)) for _, t in templates]
        of = Counter(t for c in counts for t in c)
        self.unknown, self.foreign, self.threshold = UNKNOWN, math.log(1 + len(templates)) + 1, threshold
        self.idf = dict.fromkeys(STOP, 0.0) | {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in of.items() if t not in STOP}
        self.idf |= {t: max(self.idf[t], law) for t in LAW_WORDS if t in self.idf}
        self.rows = []
        for i, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
            vector = {t: n * self.idf[t] for t, n in c.items() if self.idf[t]}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.rows += [(i, name, t, x / norm) for t, x in vector.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "template int, license string, term string, weight double")


def passages(text: Column) -> Column:
    """The whole text, its paragraphs (also those of comments), its lines, its block comments, and the sentences of text and lines, each once."""
    end = r"(?<=[.!?])[\x22')\]]*\s+(?=[^\p{L}\p{N}]*\p{Lu})"
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)(/\*.*?\*/|<!--.*?-->)"), F.lit(1))
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[\x20\t]*\n"), F.split(text, r"\n[^\p{L}\p{N}\n]*\n"), F.split(text, "\n"), blocks, F.split(text, end), F.split(text, rf"\n|{end}")))


def compared(counted: DataFrame, keys: list[str], vectors: Vectors, ranks: list[int]) -> DataFrame:
    """The passages' terms (with tf) to the templates that they reach the threshold with: the key, license, score, the template's rank, and whether they do so with foreign terms counted in full."""
    spark = counted.sparkSession
    idf = spark.createDataFrame(sorted(vectors.idf.items()), "term string, idf double")
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(vectors.unknown)))
    strict = F.col("tf") * F.coalesce("idf", F.lit(vectors.foreign))
    norms = weighed.groupBy(keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sqrt(F.sum(strict * strict)).alias("strict"))
    table = spark.createDataFrame([(*r, ranks[r[0]]) for r in vectors.rows], "template int, license string, term string, weight double, rank int")
    dots = weighed.join(F.broadcast(table), "term").groupBy(*keys, "template", "license", "rank").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    hits = dots.join(norms, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= vectors.threshold)
    return hits.select(*keys, "license", "score", "rank", (F.col("dot") >= vectors.threshold * F.col("strict") * (1 - 1e-9)).alias("all"))


def own_licenses(files: DataFrame, key: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, full: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """key, license, score, whole: each file's passage most like a template, of those with a cosine of at least the threshold.

    Passages like a full text (``full``; by default those of ``full_texts``) go
    before statements, and those before FRAGMENTS; then the score decides, and ties
    go to the smaller license.  ``whole``: the whole text reaches the threshold
    also with terms that no template has counted as if one had.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = files.where(text.rlike(CUE)).select(key, F.posexplode(passages(text)).alias("passage", "part"))
    some = some.where(F.col("part").rlike(CUE)).select(key, "passage", term_array(F.col("part")).alias("terms"))
    # A passage is one row, so its terms are counted before anything moves.
    counted = some.select(key, "passage", F.explode("terms").alias("term")).groupBy(key, "passage", "term").agg(F.count(F.lit(1)).alias("tf"))
    whole = full_texts() if full is None else full
    hits = compared(counted, [key, "passage"], Vectors(templates, threshold), [2 if t in FRAGMENTS else 1 for t in templates])
    if whole:
        hits = hits.unionByName(compared(counted, [key, "passage"], Vectors(whole, threshold, 0.0), [0] * len(whole)))
    best = F.min(F.struct("rank", (-F.col("score")).alias("s"), F.col("license").alias("license")))
    return hits.groupBy(key).agg(best.alias("best"), F.bool_or((F.col("passage") == 0) & F.col("all")).alias("whole")).select(key, F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"), "whole")


def parent(path: Column) -> Column:
    """What stands before the last slash; null for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(directory: Column) -> Column:
    """The directory and those above it, the longest first, the root as ''."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, key: str = "path", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, path, own_license, own_score, license, source ('own', 'inherited' or null), licensed_by (the directory it is inherited from).

    files needs ``key``, path and text; others are ignored.  A file has the
    license of its best passage, else the one of the nearest directory above it that
    has a license file: one named LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE, or
    one that is a license as a whole.  Of several in a directory the best score
    counts, then the smaller license.  Null texts have no license, null paths inherit
    none, and rows with a null key are left out.  Rows that repeat a key are files of
    their own.  An empty table gives an empty one.
    """
    own = files.select(F.col(key).alias("file"), F.col("path").alias("place"), "text").where(F.col("file").isNotNull())
    # Equal rows have equal terms, so their cosines are those of one; others differ in this hash.
    own = own.withColumn("row", F.xxhash64("file", "text"))
    # In files, as it is read for directories and for the files themselves: the texts are compared once.
    found = stage(own_licenses(own.select("row", "text"), "row", templates, threshold))
    # Only the few licensed files and the paths move, never the texts.
    places = own.select("file", "place", "row", parent(F.col("place")).alias("directory"))
    with_own = places.join(found, "row", "left").drop("row")
    by_directory = (
        with_own.where(F.col("license").isNotNull() & F.col("directory").isNotNull() & (F.col("whole") | F.col("place").rlike(FILE_NAMES)))
        .groupBy("directory")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("license"))).alias("best"))
        .select(F.col("directory").alias("above"), F.col("best.license").alias("theirs"))
    )
    directories = places.where(F.col("directory").isNotNull()).groupBy("directory").agg(F.count(F.lit(1)).alias("files"))
    nearest = (
        directories.select("directory", "files", F.posexplode(ancestors(F.col("directory"))).alias("steps", "above"))
        .join(by_directory, "above")
        .groupBy("directory")
        .agg(F.first("files").alias("files"), F.min_by(F.struct("above", "theirs"), "steps").alias("heir"))
    )
    joined = looked_up(with_own, nearest, ["directory"], "files", size=F.octet_length("directory") + F.octet_length("heir.above") + F.octet_length("heir.theirs"))
    return joined.select(
        F.col("file").alias(key if key != "path" else "path"),
        *([F.col("place").alias("path")] if key != "path" else []),
        F.col("license").alias("own_license"),
        F.col("score").alias("own_score"),
        F.coalesce("license", "heir.theirs").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("heir").isNotNull(), "inherited").alias("source"),
        F.when(F.col("license").isNull(), F.col("heir.above")).alias("licensed_by"),
    )
