"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Segments of a file are its lines that speak of licences and, for licence files, the whole text; where no line is a
template word for word, also stretches of words that run over lines or are part of one. A segment's
terms are weighed by how few templates hold them; the closest template above a threshold names
the file's own licence. A file without one takes that of the nearest directory above it whose licence file
has one. Directories, not files, are resolved against each other, so the joins are as small as the tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import checkpoint, extended, mapped, texts, with_fields, without

#: How licences are named in headers and begin in licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited"),
)
_GNU = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
)
_VERBATIM = "Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"
#: Notices that are wrapped over lines or stand inside longer ones are compared by stretches of words, with these besides TEMPLATES.
NOTICES = (
    ("GPL-3.0", _GNU.format("", 3)), ("GPL-2.0", _GNU.format("", 2)), ("LGPL-2.1", _GNU.format("Lesser ", "2.1")), ("LGPL-3.0", _GNU.format("Lesser ", 3)), ("AGPL-3.0", _GNU.format("Affero ", 3)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("BSD-2-Clause", _BSD.format("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _VERBATIM.format("2007")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + _VERBATIM.format("1989, 1991")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _VERBATIM.format("2007")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 " + _VERBATIM.format("1991, 1999")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _VERBATIM.format("2007")),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
#: Stretches are laid so that one of these words falls on the same word of the notice; the least cosine that counts there.
ANCHORS = ("licensed", "license", "licence", "copyright", "spdx", "permission", "redistribution", "unencumbered", "dedicated", "legal")
LEAST_STRETCH = 0.75
#: A line speaks of licences if, in lower case, it holds one of these.
TRIGGERS = ("licen", "copyright", "spdx", "public domain", "all rights reserved")
#: Terms, in lower case; the least cosine that counts; names of licence files.
TERM = "[a-z0-9]+"
LEAST = 0.6
FILES = ("license", "licence", "copying", "notice")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_terms = re.compile(TERM).findall


def _vectors(templates) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """(weight of each term of the templates, weight of any other, each template with its unit vector)."""
    bags = [(name, Counter(_terms(text.translate(ASCII)))) for name, text in templates]
    held = Counter(t for _, bag in bags for t in bag)
    idf = {t: log((1 + len(bags)) / (1 + n)) + 1 for t, n in held.items()}
    out = []
    for name, bag in bags:
        norm = sum((n * idf[t]) ** 2 for t, n in bag.items()) ** 0.5
        out.append((name, {t: n * idf[t] / norm for t, n in bag.items()}))
    return idf, log(1 + len(bags)) + 1, out


def _inverted(templates: list[tuple[str, dict[str, float]]]) -> dict[str, list[tuple[int, float]]]:
    """The templates that hold a term, with its weight in each."""
    out: dict[str, list[tuple[int, float]]] = {}
    for i, (_, v) in enumerate(templates):
        for t, w in v.items():
            out.setdefault(t, []).append((i, w))
    return out


class Matcher:
    def __init__(self, templates, least: float):
        self.idf, self.other, self.templates = _vectors(templates)
        self.least = least
        self.of_term = _inverted(self.templates)
        self.stretch_idf, self.stretch_other, notices = _vectors([*templates, *NOTICES])
        self.notices = [(name, v, len(_terms(text.translate(ASCII)))) for (name, v), (_, text) in zip(notices, [*templates, *NOTICES], strict=True)]
        self.anchored: dict[str, list[tuple[int, int]]] = {a: [] for a in ANCHORS}  # notices and places in them, by anchor
        for i, (_, text) in enumerate([*templates, *NOTICES]):
            for q, w in enumerate(_terms(text.translate(ASCII))):
                if w in self.anchored:
                    self.anchored[w].append((i, q))

    def best(self, segment: str) -> tuple[float, int]:
        """(cosine to the closest template, minus its number), ties to the first."""
        bag = Counter(_terms(segment))
        if not bag:
            return 0.0, 0
        norm = sum((n * self.idf.get(t, self.other)) ** 2 for t, n in bag.items()) ** 0.5
        known = {t: n * self.idf[t] / norm for t, n in bag.items() if t in self.idf}
        sums: dict[int, float] = {}
        for t, x in known.items():
            for i, w in self.of_term[t]:
                sums[i] = sums.get(i, 0.0) + x * w
        return max(((round(s, 6), -i) for i, s in sums.items()), default=(0.0, 0))

    def of(self, text: str, whole: bool) -> tuple[str | None, float]:
        """The licence that a text names, and its cosine (0 if none)."""
        low = text.translate(ASCII) if not text.isascii() else text.lower()
        segments = [x for x in low.split("\n") if any(t in x for t in TRIGGERS)] if any(t in low for t in TRIGGERS) else []
        score, number = max(map(self.best, [*dict.fromkeys(segments), *[low] * whole]), default=(0.0, 0))
        name, score = (self.templates[-number][0], score) if score >= self.least else (None, 0.0)
        if score < 1 and any(a in low for a in ANCHORS):
            wider, other = self.stretch(_terms(low))
            if wider >= LEAST_STRETCH and wider > score:
                return other, wider
        return name, score

    def stretch(self, words: list[str]) -> tuple[float, str | None]:
        """(cosine, licence) of the closest stretch of words as long as a notice, whatever lines it runs over."""
        idf, other = self.stretch_idf, self.stretch_other
        places = sorted({(k, max(i - q, 0)) for i, w in enumerate(words) if w in self.anchored for k, q in self.anchored[w]})
        best, found = 0.0, None
        for k, start in places:
            name, v, length = self.notices[k]
            bag = Counter(words[start : start + length])
            dot = sum(n * idf[t] * v[t] for t, n in bag.items() if t in v)
            if dot and (cosine := round(dot / sum((n * idf.get(t, other)) ** 2 for t, n in bag.items()) ** 0.5, 6)) > best:
                best, found = cosine, name
        return best, found


def directory(path: Column) -> Column:
    """All of a path before its last slash; the empty string at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def is_license_file(path: Column) -> Column:
    """By its name: LICENSE, LICENCE, COPYING or NOTICE, in any case, with any extension."""
    return F.coalesce(F.lower(F.regexp_extract(path, "([^/.]*)[^/]*$", 1)).isin(*FILES), F.lit(False))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """files with own_license and similarity (null and 0 where none is near enough), license (its own, else the
    inherited one, else null) and inherited_from (the directory, else null).

    Null and empty texts name none, nor does a copyright line alone; files with a null path inherit nothing; of several licence files in a directory the
    closest to a template counts, then the first by name of the licence. Columns of the new names are replaced, repeated rows stay. Texts are
    read once and don't travel: what is joined is one row a directory.
    """
    files = without(files, ["own_license", "similarity", "license", "inherited_from"])
    row = F.struct(*[files[f"`{c}`"] for c in files.columns if c != text_col]).alias("_row")  # so that no name of theirs meets one of ours
    files = files.select(row, F.col(path_col).alias("_path"), F.col(text_col).alias("_text"), is_license_file(F.col(path_col)).alias("_whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for b in batches:
            found = [matcher.of(t, w.as_py()) for t, w in zip(texts(b.column(2)), b.column(3), strict=True)]
            yield extended(b, {"own_license": pa.array([x for x, _ in found], pa.string()), "similarity": pa.array([s for _, s in found], pa.float64())})

    own = files.transform(mapped, run, with_fields(files, [T.StructField("own_license", T.StringType()), T.StructField("similarity", T.DoubleType())]))
    return inherited(checkpoint(own.drop("_text")))


def inherited(own: DataFrame) -> DataFrame:
    """own (_row, _path, _whole, own_license, similarity) as scan returns it."""
    placed = own.withColumn("_dir", directory(F.col("_path")))
    said = placed.where("_whole AND own_license IS NOT NULL").groupBy("_dir").agg(F.min(F.struct(-F.col("similarity"), "own_license"))["own_license"].alias("license"))
    said = checkpoint(said.select(F.col("_dir").alias("above"), "license"))
    dirs = placed.select("_dir").where("_dir IS NOT NULL").distinct()
    parts = F.split("_dir", "/")
    depth = F.when(F.col("_dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    up = dirs.select("_dir", F.explode(depth).alias("depth")).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = up.join(said, "above").groupBy("_dir").agg(F.max_by(F.struct("license", "above"), "depth").alias("x"))
    nearest = checkpoint(nearest.select(F.col("_dir").alias("_d"), "x.license", F.col("x.above").alias("_above")))
    out = placed.join(nearest, F.col("_dir") == F.col("_d"), "left")
    has = F.col("own_license").isNotNull()
    return out.select("_row.*", "own_license", "similarity", F.coalesce("own_license", "license").alias("license"), F.when(~has, F.col("_above")).alias("inherited_from"))


#: documents carry no paths: the query lays them out as a tree by source and id. The first of each hundred is its directory's licence file, the
#: first of each thousand that of the directory above.
LAYOUT = """concat_ws('/', source, cast(doc_id div 1000 as string), if(doc_id % 1000 = 0, null, cast(doc_id div 100 as string)),
                       if(doc_id % 100 = 0, 'LICENSE', concat(cast(doc_id as string), '.txt')))"""


def _values() -> str:
    return ", ".join(f"({i}, '{n}', '{t.translate(ASCII)}')" for i, (n, t) in enumerate(TEMPLATES))


ORACLE = rf"""
WITH tpl(i, license, t) AS (VALUES {_values()}),
tt AS (SELECT i, license, term, count(*) AS n FROM (SELECT i, license, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tv AS (SELECT i, license, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY i)) AS x FROM tt JOIN idf USING (term)),
d AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CASE WHEN doc_id % 1000 <> 0 THEN CAST(doc_id // 100 AS VARCHAR) END, CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END) AS path,
             doc_id % 100 = 0 AS whole, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
seg AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d WHERE regexp_matches(t, '{"|".join(TRIGGERS)}')) WHERE regexp_matches(s, '{"|".join(TRIGGERS)}')
        UNION SELECT doc_id, t FROM d WHERE whole),
st AS (SELECT doc_id, s, term, count(*) AS n FROM (SELECT doc_id, s, unnest(regexp_extract_all(s, '{TERM}')) AS term FROM seg) GROUP BY ALL),
sv AS (SELECT doc_id, s, term, n * coalesce(idf, ln(1 + (SELECT count(*) FROM tpl)) + 1) AS x FROM st LEFT JOIN idf USING (term)),
su AS (SELECT doc_id, s, term, x / sqrt(sum(x ** 2) OVER (PARTITION BY doc_id, s)) AS x FROM sv),
cs AS (SELECT doc_id, s, i, license, round(sum(su.x * tv.x), 6) AS c FROM su JOIN tv USING (term) GROUP BY ALL),
own AS (SELECT doc_id, arg_max(license, (c, -i)) AS own_license, max(c) AS similarity FROM cs WHERE c >= {LEAST} GROUP BY doc_id),
p AS (SELECT d.doc_id, d.path, d.whole, regexp_replace(d.path, '(^|/)[^/]*$', '') AS dir, own.own_license, coalesce(own.similarity, 0.0) AS similarity FROM d LEFT JOIN own USING (doc_id)),
said AS (SELECT dir AS above, arg_min(own_license, (-similarity, own_license)) AS license FROM p WHERE whole AND own_license IS NOT NULL GROUP BY dir),
near AS (SELECT q.dir, arg_max(said.license, length(said.above)) AS license, arg_max(said.above, length(said.above)) AS above
         FROM (SELECT DISTINCT dir FROM p) q JOIN said ON q.dir = said.above OR starts_with(q.dir, said.above || '/') OR said.above = '' GROUP BY q.dir)
SELECT p.doc_id, p.path, p.own_license, p.similarity, coalesce(p.own_license, near.license) AS license, CASE WHEN p.own_license IS NULL THEN near.above END AS inherited_from
FROM p LEFT JOIN near ON p.dir = near.dir
"""
