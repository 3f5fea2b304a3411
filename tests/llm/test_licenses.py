import random

from pyspark.sql import functions as F

from larder.llm import licenses as L

FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("a/one.py", "code"),
    ("a/b/two.py", "# Licensed under the Apache License, Version 2.0\ncode"),
    ("a/b/three.py", None),
    ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/d/four.py", ""),
    ("a/b/c/LICENSE", "nothing of the kind"),
    ("z/five.py", "no licence here that one could name, though the word occurs"),
    ("six.py", "x"),
    (None, "Released under the MIT License."),
    (None, "x"),
    ("ab/seven.py", "x"),
    ("a/one.py", "code"),
    ("m/License.md", "Licensed under CC BY-NC 4.0."),
    ("m/NOTICE", "Licensed under CC BY 4.0."),
    ("m/n/o/eight", "é" * 4_000),
]


def nearest(path, own):
    if path is None:
        return None, None
    parts = path.split("/")[:-1]
    for k in range(len(parts), -1, -1):
        d = "/".join(parts[:k])
        said = sorted((-s, n) for p, n, s in own if p is not None and p.rpartition("/")[0] == d and p.rpartition("/")[2].split(".")[0].lower() in L.FILES and n)
        if said:
            return said[0][1], d
    return None, None


def test_scan_equals_a_plain_version(spark):
    matcher = L.Matcher(L.TEMPLATES, L.LEAST)
    files = FILES + [("LICENSE", "Licensed under the ISC License")]
    for rows in (FILES, files):
        df = spark.createDataFrame(rows, "path string, text string").withColumns({"license": F.lit(1), "similarity": F.lit("x"), "_dir": F.lit("clash")})
        own = []
        for p, t in rows:
            base = (p or "").rpartition("/")[2].split(".")[0].lower()
            own.append((p, *matcher.of(t or "", base in L.FILES)))
        want = []
        for p, n, s in own:
            name, d = nearest(p, own)
            want.append((str(p), str(n), s, str(n or name), str(None if n else d)))
        got = L.scan(df).collect()
        assert sorted((str(r["path"]), str(r["own_license"]), r["similarity"], str(r["license"]), str(r["inherited_from"])) for r in got) == sorted(want)


def test_headers(spark):
    m = L.Matcher(L.TEMPLATES, L.LEAST)
    for name, text in L.TEMPLATES:
        assert m.of(f"x\n# {text}.\ny", True)[0] == name
    assert m.of("the public domain of words", False) == (None, 0.0)
    assert m.of("LICENSED UNDER CC BY-NC 4.0", False)[0] == "CC-BY-NC-4.0"


def test_wrapped_and_embedded_notices():
    m = L.Matcher(L.TEMPLATES, L.LEAST)
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\ncode"
    for kind, version, name in (("", "3", "GPL-3.0"), ("", "2", "GPL-2.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")):
        assert m.of(gnu.format(kind, version), False)[0] == name
    mit = "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction, including\ncode"
    assert m.of(mit, False)[0] == "MIT"
    for name, text in L.NOTICES:
        words = text.split()
        wrapped = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        assert m.of(f"/*\n{wrapped}\n */\ncode", False)[0] == name
    assert m.of("stone river " * 80 + "Released under the MIT License. " + "lamp hall " * 80, False)[0] == "MIT"
    for text in ("a licence to copy the river is dedicated to stones " * 5, "all rights reserved by permission of the licensed fisher", "copyright"):
        assert m.of(text, False) == (None, 0.0)


HEADS = {
    "Apache-2.0": "Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n 51 Franklin Street, Fifth Floor",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.",
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "MIT": "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE\n    LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN\n    ATTORNEY-CLIENT RELATIONSHIP.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software",
}


def test_licence_files_and_headers():
    m = L.Matcher(L.TEMPLATES, L.LEAST)
    for name, text in HEADS.items():
        for whole in (True, False):
            assert m.of(text + "\n\n" + "stone river lamp " * 300, whole)[0] == name
            assert m.of("".join(f"// {x}\n" for x in text.split("\n")), whole)[0] == name
    apache = "# Copyright 2020 Someone. All rights reserved.\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    assert m.of(apache, False)[0] == "Apache-2.0" and m.of(mpl, False)[0] == "MPL-2.0"
    assert m.of("# Copyright (c) 2020 Someone Inc. All rights reserved.\ncode", False)[0] is None


def test_cosine_by_dense_vectors():
    rng = random.Random(1)
    idf, other, templates = L._vectors(L.TEMPLATES)
    vocabulary = sorted(idf) + ["unknown", "words"]
    for _ in range(50):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 15))]
        w = {t: words.count(t) * idf.get(t, other) for t in words}
        norm = sum(x * x for x in w.values()) ** 0.5
        best = max(round(sum(w.get(t, 0) * x for t, x in v.items()) / norm, 6) for _, v in templates)
        assert abs(L.Matcher(L.TEMPLATES, 0).best(" ".join(words))[0] - best) < 2e-6


def test_long_texts_and_clashing_columns(spark):
    words = "stone river lamp license quiet " * 60_000
    text = words + "\n# Licensed under the Apache License, Version 2.0\n" + words
    files = spark.createDataFrame([("a/x", text), ("a/LICENSE", "MIT License. " + words[:2_000]), ("a/y", "z"), ("a/y", "z")], "path string, text string")
    clashing = files.withColumns({"own_license": F.lit(1), "inherited_from": F.lit("x"), "_whole": F.lit(3), "above": F.lit("u"), "depth": F.lit("v"), "_d": F.lit("w"), "_above": F.lit("t"), "x": F.lit(5)})
    got = L.scan(clashing)
    assert {"above", "depth", "x"} <= set(got.columns)
    rows = {(r["path"], r["own_license"], r["license"], r["inherited_from"]) for r in got.collect()}
    assert ("a/x", "Apache-2.0", "Apache-2.0", None) in rows and got.count() == 4


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "path string, text string")).count() == 0
