"""License scan against plain Python."""

import math
import re
from collections import Counter

import pytest

from tensorloom.llm import licenses

APACHE = "Licensed under the Apache License, Version 2.0."


def brute(text, threshold=licenses.THRESHOLD):
    v = licenses.Vectors(licenses.TEMPLATES, threshold)
    best = None
    t = text or ""
    for part in {t, *re.split(r"\n[\x20\t]*\n", t), *t.split("\n")}:
        c = Counter(licenses.terms(part))
        x = {k: n * v.idf.get(k, v.unknown) for k, n in c.items()}
        norm = math.sqrt(sum(a * a for a in x.values()))
        for i, (name, _) in enumerate(licenses.TEMPLATES):
            dot = sum(x.get(k, 0) * w for j, _, k, w in v.rows if j == i)
            score = round(dot / norm, 9) if norm else 0
            if score >= threshold and (best is None or (-score, name) < best):
                best = (-score, name)
    return best and (best[1], -best[0])


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_own(which, request):
    df = request.getfixturevalue(which)
    got = {r.doc_id: (r.license, pytest.approx(r.score, abs=1e-6)) for r in licenses.own_licenses(df, "doc_id").collect()}
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    assert got == {d: w for d, w in want.items() if w}
    assert which == "nasty" or got


def test_inheritance(spark):
    rows = [
        ("/a/LICENSE", APACHE),
        ("/a/x.py", "code"),
        ("/a/b/y.py", "code"),
        ("/a/b/c/COPYING", "intro words here\n\nReleased under the MIT License.\n\nmore words"),
        ("/a/b/c/d/z.py", None),
        ("/a/b/c/own.py", "# Licensed under CC BY-NC 4.0.\ncode goes here"),
        ("/other/w.py", ""),
        ("/lone/short.txt", "Released under the MIT License."),
        ("/lone/friend.txt", "nothing"),
        ("plain.txt", "nothing"),
        (None, APACHE),
    ]
    df = spark.createDataFrame([(i, *r, "x", 1.0) for i, r in enumerate(rows)], "id long, path string, text string, license string, score double")
    got = {r.id: (r.license, r.source, r.licensed_by) for r in licenses.scan(df, "id").collect()}
    assert got == {
        0: ("Apache-2.0", "own", None),
        1: ("Apache-2.0", "inherited", "/a"),
        2: ("Apache-2.0", "inherited", "/a"),
        3: ("MIT", "own", None),
        4: ("MIT", "inherited", "/a/b/c"),
        5: ("CC-BY-NC-4.0", "own", None),
        6: (None, None, None),
        7: ("MIT", "own", None),
        8: ("MIT", "inherited", "/lone"),
        9: (None, None, None),
        10: ("Apache-2.0", "own", None),
    }
    assert licenses.scan(df.where("false"), "id").count() == 0


GPL = """# Copyright (C) 2019 Jane Roe
#
# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU {1}General Public License as published by
# the Free Software Foundation{2} version {3} of the License{4}.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {1}General Public License for more details.
"""
LATER = ", or\n# (at your option) any later version"
HEADERS = [
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("Apache-2.0", "// Copyright 2020 Foo. Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", GPL.format(";", "", ";", 2, "")),
    ("GPL-2.0-or-later", GPL.format(";", "", "; either", 2, LATER)),
    ("GPL-3.0", GPL.format(":", "", ",", 3, "")),
    ("GPL-3.0-or-later", GPL.format(":", "", ", either", 3, LATER)),
    ("AGPL-3.0-or-later", GPL.format(":", "Affero ", ", either", 3, LATER)),
    ("LGPL-2.1-or-later", GPL.format(";", "Lesser ", "; either", 2.1, LATER)),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;\n"),
    ("Apache-2.0", "# Copyright 2017 The Authors. All Rights Reserved.\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS.\nimport os\n"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("BSD-2-Clause", "// SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0"),
    (None, "mit"),
    (None, "The licensed driver waited under the bridge, and nobody had a copy of the map."),
    (None, "You need a license to fish in this lake."),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HEADERS)], "id long, text string")
    got = {r.id: r.license for r in licenses.own_licenses(df, "id").collect()}
    assert {i: (got.get(i), w) for i, (w, _) in enumerate(HEADERS) if got.get(i) != w} == {}


def test_license_files(spark):
    """Whole files, with a holder's line before them, and as a comment before code."""
    full = dict(licenses.full_texts())
    assert {"Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "0BSD", "Unlicense", "Zlib"} <= set(full)
    rows = [(f"{n} file", f"Copyright (c) 2011-2020, Jane Roe and the Example contributors\nAll rights reserved.\n\n{t}") for n, t in full.items()]
    rows += [(f"{n} comment", "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\n" + "int some_name(void) { return other(1); }\n" * 300) for n, t in full.items()]
    rows += [(f"{n} bare", "/*\n" + t + "\n*/\n" + "int some_name(void) { return other(1); }\n" * 300) for n, t in full.items() if "*/" not in t]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r.license for r in licenses.own_licenses(df, "id").collect()}
    assert {k: got.get(k) for k, _ in rows if got.get(k) != k.split(" ")[0]} == {}
