"""Licence scans: TF-IDF cosine to templates, and inheritance from ancestor directories [native].

Statements are the sentences of a text that use licence vocabulary or a licence's short name (GPLv3), line by line and with wrapped or comment lines joined,
its paragraphs that do, and the whole text if it does; a licence file is a file of a usual
name, or one at least half of whose lines hold statements that are at least half of its characters, white space apart.  Statements and templates are sparse TF-IDF vectors over
lower-cased words, with document frequencies over the templates; terms are joined, and the best cosine
of at least ``least`` names a statement's licence.  A file has its best statement's licence.  A file
without one inherits that of the nearest ancestor directory holding a licence file, found by joining the
file's ancestor paths to directories.

Defined results: null or blank text -> no statement; null path -> no ancestors; ties between licences go to
the one that sorts first; of several licence files in a directory the best match counts; repeated rows
are judged alike; an empty table gives an empty result; input columns of the output's names are replaced.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let

#: Licence id, its identifiers, its names.
NAMES = [
    ("Apache-2.0", ["Apache-2.0"], ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"]),
    ("MIT", ["MIT"], ["MIT License"]),
    ("GPL-3.0", ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], ["GNU General Public License Version 3, 29 June 2007", "GNU General Public License version 3", "GNU GPL v3", "GPLv3"]),
    ("GPL-2.0", ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], ["GNU General Public License Version 2, June 1991", "GNU General Public License version 2", "GNU GPL v2", "GPLv2"]),
    ("GPL-unversioned", ["GPL"], ["GNU General Public License"]),
    ("LGPL-3.0", ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], ["GNU Lesser General Public License version 3", "GNU Lesser General Public License Version 3, 29 June 2007", "LGPLv3"]),
    ("LGPL-2.1", ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License Version 2.1, February 1999", "LGPLv2.1"]),
    ("LGPL-unversioned", ["LGPL"], ["GNU Lesser General Public License"]),
    ("AGPL-3.0", ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], ["GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU Affero General Public License Version 3, 19 November 2007", "AGPLv3"]),
    ("MPL-2.0", ["MPL-2.0"], ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"]),
    ("BSD-2-Clause", ["BSD-2-Clause"], ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD-3-Clause"], ["BSD 3-Clause License", "New BSD License", "BSD License"]),
    ("CC-BY-4.0", ["CC-BY-4.0"], ["Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4.0"], ["Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4.0"], ["Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC0-1.0", ["CC0-1.0"], ["CC0 1.0 Universal license"]),
    ("ISC", ["ISC"], ["ISC License"]),
    ("Unlicense", ["Unlicense"], ["Unlicense"]),
    ("BSL-1.0", ["BSL-1.0"], ["Boost Software License, Version 1.0"]),
    ("Zlib", ["Zlib"], ["zlib License"]),
    ("EPL-2.0", ["EPL-2.0"], ["Eclipse Public License 2.0"]),
]
PHRASES = ["{}", "Released under the {}.", "Licensed under the {}.", "This project is licensed under the terms of the {}.", "Use of this source code is governed by the {}."]
#: Notices of common licences (fixed values): licence id, notice.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal: dedicated to the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No license is granted."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-unversioned", "it under the terms of the GNU General Public License as published by"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
#: Whole licences, a file each.
FULL = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))]
TEMPLATES = list(dict.fromkeys([*NOTICES, *FULL, *[(k, f"SPDX-License-Identifier: {x}") for k, ids, _ in NAMES for x in ids], *[(k, f.format(x)) for k, _, names in NAMES for x in names for f in PHRASES]]))
WORDS = r"(?i:licen[cs]e|copyright|spdx|public domain|permission|redistribut|all rights reserved|released under)"
#: What the identifiers and names begin with that don't hold such words themselves, as spelled; not MIT, which is a German word too, also in capitals.
SHORT = sorted({re.match("[A-Za-z]+", x)[0] for _, ids, names in NAMES for x in [*ids, *names] if not re.search(WORDS, x)} - {"MIT"})
VOCABULARY = rf"{WORDS}|\b(?:{'|'.join(SHORT)})"
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
LEAST = 0.6
#: Words from which a whole text that matches a template is a licence file.
WHOLE = 60
#: What comment lines begin or end with.
COMMENT = r"(?m)^[\x20\x09]*(?:/{2,}!?|/?\*+[!/]?|#+!?|--+|;+|%+|<!--+)?[\x20\x09]*|[\x20\x09]*(?:\*+/|--+>)?[\x20\x09]*$"


def _sentences(text: Column) -> Column:
    return F.split(text, r"\n|(?<=[.!?;])[\x20\x09]+")


def _joined(text: Column) -> Column:
    """The whole text, its paragraphs and their sentences, with the lines of comments and wrapped lines joined."""
    bare = F.regexp_replace(text, COMMENT, "")
    line = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return let(F.transform(F.split(bare, r"\n\s*\n"), line), lambda p: F.concat(F.array(line(bare)), p, F.flatten(F.transform(p, _sentences))))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+"), lambda w: F.regexp_replace(w, r"\.+$", "") != "")


def templates(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or TEMPLATES, "license string, notice string")


def weights(notices: DataFrame) -> DataFrame:
    """(license, t, term, idf, w): unit-length TF-IDF rows of the templates; t numbers them."""
    n = notices.withColumn("t", F.xxhash64("license", "notice"))
    tf = n.select("license", "t", F.explode(F.transform(_terms(F.col("notice")), lambda w: F.regexp_replace(w, r"\.+$", ""))).alias("term")).groupBy("license", "t", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.countDistinct("license").alias("df"))
    total = notices.agg(F.countDistinct("license").alias("total"))  # frequencies are over licences, however many notices one has
    x = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("idf", F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)
    norm = x.groupBy("t").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("norm"))
    return x.join(norm, "t").select("license", "t", "term", "idf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w"))


def matched(said: DataFrame, notices: DataFrame, least: float = LEAST) -> DataFrame:
    """(statement, license, score) for the distinct statements that match a template.  Terms no template has count
    with the highest inverse frequency."""
    w = weights(notices)
    s = said.select(F.explode("said").alias("statement")).distinct().select("statement", F.xxhash64("statement").alias("s"))
    tf = s.select("s", F.explode(F.transform(_terms(F.col("statement")), lambda x: F.regexp_replace(x, r"\.+$", ""))).alias("term")).groupBy("s", "term").agg(F.count("*").alias("tf"))
    top = notices.agg((F.log(1 + F.countDistinct("license")) + 1).alias("top"))
    v = tf.join(w.select("term", "idf").distinct(), "term", "left").crossJoin(F.broadcast(top)).select("s", "term", "idf", (F.col("tf") * F.coalesce("idf", "top")).alias("v"))
    square = F.col("v") * F.col("v")
    norm = v.groupBy("s").agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("idf").isNotNull(), square))).alias("known"))
    #: no cosine is larger than the share of the known terms in the length
    norm = norm.filter(F.col("known") >= (least - 1e-6) * F.col("norm")).select("s", "norm")
    dot = v.join(norm, "s").join(w.select("license", "t", "term", "w"), "term").groupBy("s", "license", "t").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.first("norm").alias("norm"))
    score = dot.select("s", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least).join(s, "s")
    best = score.groupBy("statement").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("statement", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, notices: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(``path``, other columns but text, own_license, own_score, license, inherited_from) for every row of ``files`` (path, text, ...)."""
    added = ["own_license", "own_score", "license", "inherited_from"]
    keep = [c for c in files.columns if c.lower() not in ("text", *added)]
    notices = templates(files.sparkSession) if notices is None else notices
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.when(text.rlike(VOCABULARY), F.filter(_sentences(text), lambda s: s.rlike(VOCABULARY))).otherwise(F.array().cast("array<string>"))
    solid = lambda x: F.length(F.regexp_replace(x, r"\s+", "")).cast("long")
    mostly = F.when(F.size("_said") > 0, 2 * F.aggregate(F.col("_said"), F.lit(0).cast("long"), lambda n, x: n + solid(x)) >= solid(F.col("_text"))).otherwise(False)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != "")
    mostly = mostly & (2 * F.size(F.filter(lines, lambda x: x.rlike(VOCABULARY))) >= F.size(lines))
    rows = files.select(*[F.col(f"`{c}`") for c in keep], some.alias("_said"), F.when(text.rlike(VOCABULARY), _joined(text)).otherwise(F.array().cast("array<string>")).alias("_joined"), text.alias("_text"), F.xxhash64("path", text).alias("_row"))
    rows = cut(rows.select(*[F.col(f"`{c}`") for c in keep], F.array_distinct(F.concat(F.slice("_joined", 1, 1), F.filter(F.concat("_said", "_joined"), lambda x: x.rlike(VOCABULARY)))).alias("_said"), mostly.alias("_mostly"), "_row"), "statements")
    hit = cut(matched(rows.select(F.col("_said").alias("said")), notices, least), "matched")
    own = rows.filter(F.size("_said") > 0).select("_row", F.posexplode("_said").alias("_at", "statement")).distinct().join(hit, "statement")
    whole = (F.col("_at") == 0) & (F.size(_terms(F.col("statement"))) >= WHOLE)  # the first is the whole text
    own = own.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.max(whole).alias("_whole"))
    own = own.select("_row", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"), "_whole")
    rows = rows.join(own, "_row", "left")
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    is_file = name.rlike(FILE_NAMES) | F.col("_mostly") | F.coalesce("_whole", F.lit(False))
    parent = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    folders = rows.filter(F.col("own_license").isNotNull() & is_file & F.col("path").isNotNull()).select(parent(F.col("path")).alias("_folder"), "own_license", "own_score")
    folders = folders.groupBy("_folder").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"))).alias("b")).select("_folder", F.col("b.license").alias("_folder_license"))
    #: ancestors of the distinct directories, not of every file
    homes = rows.filter(F.col("path").isNotNull()).select(parent(F.col("path")).alias("_home")).distinct()
    parts = F.split("_home", "/")
    up = homes.select("_home", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("_folder"))
    near = up.join(folders, "_folder").groupBy("_home").agg(F.max(F.struct(F.length("_folder").alias("depth"), "_folder", "_folder_license")).alias("b"))
    near = near.select("_home", "b._folder", "b._folder_license")
    j = rows.join(near, parent(rows.path) == near._home, "left")
    given = F.col("own_license").isNull() & F.col("_folder_license").isNotNull()
    return j.select(*[F.col(f"`{c}`") for c in keep], "own_license", "own_score", F.coalesce("own_license", "_folder_license").alias("license"), F.when(given, F.col("_folder")).alias("inherited_from"))
