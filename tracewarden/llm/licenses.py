"""Licence scans: sparse TF-IDF cosine to notices, headers and whole texts, and inheritance along directories.

Built from DataFrame functions alone. Only sentences that speak of licences are taken apart, so
the terms that are shuffled are few; directories, not files, are joined with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import stored

# ---- fixed values: usual notices of public licences, by SPDX identifier
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: A sentence is looked at if it speaks of licences; the templates above all do.
SPEAKS = r"(?i)licen[sc]|copyright|spdx|public domain|hereby granted|redistribution|creative commons"
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.6
#: The same for headers and whole texts, which are long and share many words with prose.
LEAST_HEADER, LEAST_TEXT = 0.7, 0.8
#: Titles and headers as the licences ask for them, compared with lines, paragraphs and their sentences.
_GNU = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General "
    "Public License as published by the Free Software Foundation, "
)
_LATER = _GNU + "either version {n} of the License, or (at your option) any later version."
_ONLY = _GNU + "version {n}."
_CC = "This work is licensed under the Creative Commons {kind} 4.0 International License."
_PUBLIC = (
    ("AGPL-3.0", "program", "Affero ", "3", "GNU Affero General Public License", "Version 3, 19 November 2007"),
    ("GPL-2.0", "program", "", "2", "GNU General Public License", "Version 2, June 1991"),
    ("GPL-3.0", "program", "", "3", "GNU General Public License", "Version 3, 29 June 2007"),
    ("LGPL-2.1", "library", "Lesser ", "2.1", "GNU Lesser General Public License", "Version 2.1, February 1999"),
    ("LGPL-3.0", "library", "Lesser ", "3", "GNU Lesser General Public License", "Version 3, 29 June 2007"),
)
HEADERS = (
    *((name, text.format(thing=thing, kind=kind, n=n)) for name, thing, kind, n, _, _ in _PUBLIC for text in (_LATER, _ONLY)),
    *((name, f"{title} {dated}") for name, _, _, _, title, dated in _PUBLIC),
    *((name, f"{title} version {n}") for name, _, _, n, title, _ in _PUBLIC),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-4.0", _CC.format(kind="Attribution")),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", _CC.format(kind="Attribution-NonCommercial")),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-SA-4.0", _CC.format(kind="Attribution-ShareAlike")),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
     "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved. This software is proprietary and confidential."),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("Proprietary", "This software contains confidential and proprietary information and may not be copied, used, disclosed or "
     "distributed without prior written permission."),
)
#: Whole public licences, a file each, named by SPDX identifier.
TEXTS = Path(__file__).with_name("licence_texts")
TAG = r"(?i)SPDX-License-Identifier:[ \t]*(\(?[a-z0-9][a-z0-9.+:-]*(?:[ \t()]+(?:and|or|with)[ \t(]+[a-z0-9][a-z0-9.+:-]*)*\)?)"
SPEAKS_LONG = SPEAKS + r"|proprietary|all rights reserved|unauthorized copying|free software|unencumbered software"
#: What comments put before their lines.
COMMENT = r"(?m)^[ \t]*(?://+!?|#+|/?\*+/?|--+|;+|%+|<!--|\(\*|dnl\b|rem\b)[ \t]*"
#: Names of files that hold the licence of their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|copyright)([.\-_].*)?$"


def _terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def template_vectors(notices: tuple[tuple[str, str], ...]) -> tuple[list[tuple], float]:
    """(template, licence, term, weight) with unit vectors, and per term its idf; the idf of a foreign term."""
    counts = [_terms(text) for _, text in notices]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(notices)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, ((name, _), count) in enumerate(zip(notices, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in count.items()))
        rows += [(i, name, t, n * idf[t] / norm, idf[t]) for t, n in sorted(count.items())]
    return rows, math.log(1 + len(notices)) + 1


def sentences(text: Column) -> Column:
    """Lines, cut at the ends of sentences."""
    return F.split(F.regexp_replace(text, r"([.!?])[\t\n\r ]+", "$1\n"), "\n")


def notice_scores(files: DataFrame, notices: tuple = NOTICES, least: float = LEAST) -> DataFrame:
    """path, licence, score, sentence: the best template of each file that has one.

    The sentence with the highest cosine counts; ties go to the first licence by name, then to
    the earlier sentence.
    """
    spark: SparkSession = files.sparkSession
    rows, foreign = template_vectors(notices)
    table = spark.createDataFrame(rows, "template int, licence string, _term string, weight double, idf double")
    idf = table.select("_term", "idf").distinct()
    said = (
        files.filter(F.col("text").rlike(SPEAKS))
        .select("path", F.posexplode(sentences(F.col("text"))).alias("sentence", "said"))
        .filter(F.col("said").rlike(SPEAKS))
        .select("path", "sentence", F.translate("said", UPPER, LOWER).alias("said"))
    )
    counted = (
        said.select("path", "sentence", F.explode(F.regexp_extract_all("said", F.lit(TERM), F.lit(0))).alias("term"))
        .groupBy("path", "sentence", "term")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(idf), F.col("term") == F.col("_term"), "left")
        .select("path", "sentence", "term", (F.col("n") * F.coalesce("idf", F.lit(foreign))).alias("w"))
    )
    norms = counted.groupBy("path", "sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        counted.join(F.broadcast(table.drop("idf")), F.col("term") == F.col("_term"))
        .groupBy("path", "sentence", "template", "licence")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    return (
        dots.join(norms, ["path", "sentence"])
        .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
        .filter(F.col("score") >= least)
        .groupBy("path")
        .agg(F.min(F.struct((-F.col("score")).alias("below"), "licence", "sentence")).alias("best"))
        .select("path", "best.licence", (-F.col("best.below")).alias("score"), "best.sentence")
    )


def term_counts(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _long_templates() -> list[tuple]:
    """(template, whole, licence, term, n) of headers and whole texts."""
    rows = [(False, *h) for h in HEADERS] + [(True, f.stem, f.read_text()) for f in sorted(TEXTS.glob("*.txt"))]
    return [(i, whole, name, t, n) for i, (whole, name, text) in enumerate(rows) for t, n in sorted(_terms(text).items())]


def long_units(text: Column) -> Column:
    """The whole text, its paragraphs without comment signs, their sentences, and its lines; (whole, said)."""
    plain = F.regexp_replace(text, COMMENT, "")
    joined = F.transform(F.split(plain, r"\n[ \t\r]*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    parts = F.concat(joined, F.flatten(F.transform(joined, sentences)), F.split(plain, "\n"))
    parts = F.filter(F.array_distinct(parts), lambda p: p.rlike(SPEAKS_LONG))
    parts = F.transform(parts, lambda p: F.struct(F.lit(False).alias("whole"), p.alias("said")))
    return F.concat(parts, F.array(F.struct(F.lit(True).alias("whole"), plain.alias("said"))))


def long_scores(files: DataFrame) -> DataFrame:
    """path, licence, score: the best header or whole licence text of each file that has one.

    Document frequencies are those of the terms of the templates over all files.
    """
    spark: SparkSession = files.sparkSession
    counts = spark.createDataFrame(_long_templates(), "template int, whole boolean, licence string, _term string, n int")
    # The empty term stands for the file itself.
    vocabulary = counts.select("_term").union(spark.range(1).select(F.lit("").alias("_term"))).distinct()
    met = (
        files.select(F.explode(F.array_append(F.array_distinct(term_counts(F.coalesce("text", F.lit("")))), F.lit(""))).alias("term"))
        .join(F.broadcast(vocabulary), F.col("term") == F.col("_term"))
        .groupBy("_term")
        .agg(F.count("*").alias("df"))
    )
    met = stored(met, "terms")
    first = met.filter(F.col("_term") == "").first()
    total = first["df"] if first else 0
    foreign = math.log(1 + total) + 1
    weighed = (
        counts.join(met, "_term", "left")
        .withColumn("idf", F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1)
        .withColumn("weight", F.col("n") * F.col("idf"))
    )
    length = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    table = weighed.join(length, "template").select(
        "template", F.col("whole").alias("_whole"), "licence", "_term", (F.col("weight") / F.col("length")).alias("weight")
    )
    idf = weighed.select("_term", "idf").distinct()
    counted = (
        files.filter(F.col("text").rlike(SPEAKS_LONG))
        .select("path", F.posexplode(long_units(F.col("text"))).alias("unit", "u"))
        .select("path", "unit", "u.whole", F.explode(term_counts(F.col("u.said"))).alias("term"))
        # Said here, these conditions are the same for norms and products, which then share one exchange.
        .filter(F.col("path").isNotNull() & F.col("whole").isNotNull() & F.col("term").isNotNull())
        .groupBy("path", "unit", "whole", "term")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(idf), F.col("term") == F.col("_term"), "left")
        .select("path", "unit", "whole", "term", (F.col("n") * F.coalesce("idf", F.lit(foreign))).alias("w"))
    )
    norms = counted.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        counted.join(F.broadcast(table), (F.col("term") == F.col("_term")) & (F.col("whole") == F.col("_whole")))
        .groupBy("path", "unit", "whole", "template", "licence")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    return (
        dots.join(norms, ["path", "unit"])
        .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
        .filter(F.col("score") >= F.when(F.col("whole"), LEAST_TEXT).otherwise(LEAST_HEADER))
        .groupBy("path")
        .agg(F.min(F.struct((-F.col("score")).alias("below"), "licence")).alias("best"))
        .select("path", "best.licence", (-F.col("best.below")).alias("score"))
    )


def tagged(files: DataFrame) -> DataFrame:
    """path, licence, score: the first SPDX tag of each file that has one."""
    named = F.trim(F.regexp_extract("text", TAG, 1))
    named = F.regexp_replace(named, r"(?i)\b((?:A|L)?GPL-[0-9.]+)(?:-only|-or-later|\+)", "$1")
    return (
        files.select("path", named.alias("licence"))
        .filter(F.col("licence") != "")
        .groupBy("path")
        .agg(F.min("licence").alias("licence"))
        .select("path", "licence", F.lit(1.0).alias("score"))
    )


def licence_scores(files: DataFrame, notices: tuple = NOTICES, least: float = LEAST) -> DataFrame:
    """path, licence, score: by tag, or else what scores highest; at a tie notices go before longer texts."""
    found = (
        tagged(files).withColumn("rank", F.lit(0))
        .unionByName(notice_scores(files, notices, least).drop("sentence").withColumn("rank", F.lit(1)))
        .unionByName(long_scores(files).withColumn("rank", F.lit(2)))
    )
    return (
        found.groupBy("path")
        .agg(F.min(F.struct((F.col("rank") > 0).alias("late"), (-F.col("score")).alias("below"), "rank", "licence")).alias("best"))
        .select("path", "best.licence", (-F.col("best.below")).alias("score"))
    )


def folder(path: Column) -> Column:
    """The directory of a file: ``/`` or ``/a/b``, or ``a/b`` and an empty string for a relative path."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?<=/)(?:\./+)+", ""), r"^(?:\./+)+", "")
    above = F.when(F.contains(plain, F.lit("/")), F.regexp_replace(plain, r"/[^/]*$", "")).otherwise("")
    root = F.when(F.startswith(plain, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.isNotNull(), F.coalesce(F.nullif(above, F.lit("")), root))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, up to its root: ``/``, or an empty string for a relative one."""
    parts = F.split(directory, "/")
    named = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rooted = F.startswith(directory, F.lit("/"))
    root = F.when(rooted, F.lit("/")).otherwise(F.lit(""))
    return F.array_distinct(F.concat(F.array(root), F.filter(named, lambda d: (d != "") & (d != "/"))))


def scan_licences(files: DataFrame, notices: tuple = NOTICES, least: float = LEAST) -> DataFrame:
    """One row per file (path, text): path, licence, score, origin, from_path.

    ``origin`` is ``header`` for a notice of the file's own, ``licence file`` for files that are
    one, ``inherited`` from the licence file of the nearest directory, its own first, or ``none``.
    A file's own licence is that of its SPDX tag, or of the notice, header or whole licence text
    that it comes closest to. Of several licence files in a directory the highest score counts, then the first path. Null
    and empty texts have no notice; a null path inherits nothing and keeps a row each; equal
    paths share the best notice of their texts. Other columns are not read.
    """
    plain = files.select("path", "text")
    best = stored(licence_scores(plain.filter(F.col("path").isNotNull()), notices, least), "licences")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    is_file = name.rlike(LICENCE_FILE)
    held = (
        best.filter(is_file)
        .groupBy(folder(F.col("path")).alias("held_by"))
        .agg(F.min(F.struct((-F.col("score")).alias("below"), "path", "licence")).alias("h"))
        .select("held_by", F.col("h.path").alias("from_path"), F.col("h.licence").alias("given"))
    )
    nearest = (
        plain.select(folder(F.col("path")).alias("folder"))
        .filter(F.col("folder").isNotNull())
        .distinct()
        .select("folder", F.explode(ancestors(F.col("folder"))).alias("held_by"))
        .join(held, "held_by")
        .groupBy("folder")
        .agg(F.max_by(F.struct("from_path", "given"), F.length("held_by")).alias("near"))
        .select("folder", "near.*")
    )
    own = F.col("licence").isNotNull()
    return (
        plain.select("path", folder(F.col("path")).alias("folder"))
        .join(best, "path", "left")
        .join(nearest, "folder", "left")
        .select(
            "path",
            F.coalesce("licence", "given").alias("licence"),
            "score",
            F.when(own & is_file, "licence file")
            .when(own, "header")
            .when(F.col("given").isNotNull(), "inherited")
            .otherwise("none")
            .alias("origin"),
            F.when(own, F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
        )
    )
