import math
from collections import Counter

from marginalia.llm import licences as L

SCHEMA = "doc_id long, path string, text string, licence string, dir string"


def cosine(line):
    """The best template of a line by dictionaries of words."""
    templates = [(n, t) for n in sorted(L.TEMPLATES) for t in L.TEMPLATES[n]]
    df = Counter(w for _, t in templates for w in set(t.split()))
    weigh = lambda t: {w: c * (math.log((1 + len(templates)) / (1 + df[w])) + 1) for w, c in Counter(t.split()).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a, best = weigh(line), (None, 0.0)
    for name, text in templates:
        b = weigh(text)
        c = sum(a[w] * b.get(w, 0) for w in a) / (norm(a) * norm(b))
        if c > best[1] + 1e-12:
            best = (name, c)
    return best


def test_cosines_equal_a_dictionary_version(spark):
    lines = [
        "Licensed under the Apache License, Version 2.0.",
        "Notice: Licensed under the Apache License, Version 2.0, see below.",
        "This work is licensed under the GNU General Public License, version 3. extra",
        "the this is under a of",
        "All rights reserved.",
        "Released under the MIT License. " * 3,
        "nothing of the kind",
    ]
    rows = [(i, f"r/{i}.txt", f"some text\n{line}\nmore", None, None) for i, line in enumerate(lines)]
    got = {r.doc_id: (r.licence, r.cosine) for r in L.own_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, line in enumerate(lines):
        name, value = max((cosine(x) for x in ("some text", line, "more")), key=lambda c: c[1])
        if value >= L.LEAST:
            assert got[i][0] == name and abs(got[i][1] - value) < 1e-9
        else:
            assert got[i] == (None, None)
    assert got[0][0] == "Apache-2.0" and got[5][0] == "MIT"


def test_nearest_directory_gives_its_licence(spark):
    mit, gpl, apache = ("Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.")
    rows = [
        (1, "LICENSE", mit), (2, "a/b/COPYING.txt", gpl), (3, "a/b/c/x.py", "code"), (4, "a/y.py", "code"), (5, "a/b/z.py", f"code\n{apache}"),
        (6, "bb/LICENSE", "no words of that kind"), (7, "bb/q.py", None), (8, "top.py", ""), (9, None, "code"), (10, "a/b/c/x.py", "code"),
        (11, "e/LICENSE-2", gpl), (12, "e/LICENSE-1", mit), (13, "e/f.py", "x" * 500_000),
    ]
    out = L.licences(spark.createDataFrame([(*r, "zz", "zz") for r in rows], SCHEMA)).collect()
    got = {r.doc_id: (r.effective, r.from_dir) for r in out}
    assert len(out) == 13
    assert got[3] == got[10] == ("GPL-3.0", "a/b") and got[4] == ("MIT", "") and got[5] == ("Apache-2.0", None)
    assert got[6] == got[7] == got[8] == got[9] == ("MIT", "") and got[13] == ("MIT", "e")
    assert L.licences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_licence_at_all(spark):
    rows = [(1, "a/x", "code", None, None)]
    assert [(r.effective, r.from_dir) for r in L.licences(spark.createDataFrame(rows, SCHEMA)).collect()] == [(None, None)]


GNU = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 */
int main() { return 0; }
"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/.
import os
"""


def test_headers_and_whole_texts_are_compared_as_a_whole(spark):
    texts = L.licence_texts.texts()
    whole = [(n, t[-1]) for n, t in texts.items() if len(t[-1]) > 700 and n not in ("CC-BY-4.0", "CC-BY-NC-4.0", "AGPL-3.0")]
    assert len(whole) >= 10
    grant = texts["MIT"][0]
    cases = [
        *((n, t.replace("Copyright (c)", "Copyright (c) 2031 Some Body")) for n, t in whole),
        *((n, "\n".join(f"// {x}" for x in t.split("\n")) + "\nint x;\n") for n, t in whole if len(t) < 3000),
        ("LGPL-2.1", GNU), ("MPL-2.0", MPL), ("MIT", grant), ("MIT", "RELEASED UNDER THE MIT LICENSE"),
        ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n" + texts["GPL-3.0"][-1].split("\n", 3)[3]),
        ("AGPL-3.0", "This work is licensed under the GNU Affero\nGeneral Public License, version 3."),
        ("LGPL-3.0", "This library is licensed under the GNU Lesser General\nPublic License, version 3."),
        ("Proprietary", "All rights reserved. No part of this work\nmay be copied without permission."),
        (None, "All of the work is under the license of the author, and it was in the hope that the terms of use are to be of any use to you."),
    ]
    got = {r.doc_id: (r.licence, r.cosine) for r in L.own_licences(spark.createDataFrame([(i, "x", t, "", "") for i, (_, t) in enumerate(cases)], SCHEMA)).collect()}
    assert [(i, n, got[i]) for i, (n, _) in enumerate(cases) if got[i][0] != n] == []
