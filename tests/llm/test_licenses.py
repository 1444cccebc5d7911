from collections import Counter

from tracewarden.llm import licenses

SCHEMA = "path string, text string, licence string, score double, folder string, term string"


def scanned(spark, rows):
    df = spark.createDataFrame([(p, t, "x", 1.0, "y", "z") for p, t in rows], SCHEMA)
    return {r.path: r for r in licenses.scan_licences(df).collect()}


def test_every_notice_finds_its_licence(spark):
    rows = [(f"/n/{i}.txt", f"Some prose here.\nX. {text} And more.") for i, (_, text) in enumerate(licenses.NOTICES)]
    got = scanned(spark, rows)
    for i, (name, _) in enumerate(licenses.NOTICES):
        assert (got[f"/n/{i}.txt"].licence, got[f"/n/{i}.txt"].origin) == (name, "header")


def test_nearest_ancestor_gives_the_licence(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    got = scanned(spark, [
        ("/LICENSE", mit), ("/a/b/COPYING.txt", gpl), ("/a/x.py", "code"), ("/a/b/y.py", "code"), ("/a/b/c/d/z.py", None),
        ("/a/b/c/own.py", "# " + mit), ("/ab/q.py", "licence unknown"), ("top.py", ""), ("/a/b/license-notes/k", gpl),
        ("/e/license", mit), ("/e/LICENSE.md", mit), ("/e/f", "f"),
    ])
    assert {p: (r.licence, r.origin, r.from_path) for p, r in got.items()} == {
        "/LICENSE": ("MIT", "licence file", "/LICENSE"),
        "/a/b/COPYING.txt": ("GPL-3.0", "licence file", "/a/b/COPYING.txt"),
        "/a/x.py": ("MIT", "inherited", "/LICENSE"),
        "/a/b/y.py": ("GPL-3.0", "inherited", "/a/b/COPYING.txt"),
        "/a/b/c/d/z.py": ("GPL-3.0", "inherited", "/a/b/COPYING.txt"),
        "/a/b/c/own.py": ("MIT", "header", "/a/b/c/own.py"),
        "/ab/q.py": ("MIT", "inherited", "/LICENSE"),
        "top.py": (None, "none", None),
        "/a/b/license-notes/k": ("GPL-3.0", "header", "/a/b/license-notes/k"),
        "/e/license": ("MIT", "licence file", "/e/license"),
        "/e/LICENSE.md": ("MIT", "licence file", "/e/LICENSE.md"),
        "/e/f": ("MIT", "inherited", "/e/LICENSE.md"),
    }


def test_relative_paths_inherit_from_their_root(spark):
    mit = "Released under the MIT License."
    rows = [("LICENSE", mit), ("top.py", "code"), ("./src/a.py", "code"), ("src/deep/./b.py", "code"), ("/abs/c.py", "code"),
            ("src/deep/LICENSE", "Licensed under CC BY-NC 4.0."), ("./d.py", "code"), ("/e.py", "code")]
    got = {p: (r.licence, r.origin, r.from_path) for p, r in scanned(spark, rows).items()}
    assert got == {
        "LICENSE": ("MIT", "licence file", "LICENSE"),
        "top.py": ("MIT", "inherited", "LICENSE"),
        "./src/a.py": ("MIT", "inherited", "LICENSE"),
        "src/deep/./b.py": ("CC-BY-NC-4.0", "inherited", "src/deep/LICENSE"),
        "src/deep/LICENSE": ("CC-BY-NC-4.0", "licence file", "src/deep/LICENSE"),
        "/abs/c.py": (None, "none", None),
        "./d.py": ("MIT", "inherited", "LICENSE"),
        "/e.py": (None, "none", None),
    }


def test_edges(spark):
    rows = [(None, "Released under the MIT License."), (None, None), ("/r", "Released under the MIT License."), ("/r", ""), ("/r", "")]
    df = spark.createDataFrame([(p, t, "x", 1.0, "y", "z") for p, t in rows], SCHEMA)
    got = Counter((r.path, r.licence, r.origin) for r in licenses.scan_licences(df).collect())
    assert got == {(None, None, "none"): 2, ("/r", "MIT", "header"): 3}
    # A sentence is compared as a whole, wherever it stands.
    long = "word " * 200_000 + "end. Licensed under CC BY-NC 4.0."
    assert scanned(spark, [("/l", long)])["/l"].licence == "CC-BY-NC-4.0"
    assert licenses.scan_licences(spark.createDataFrame([], SCHEMA)).collect() == []


def test_headers_tags_and_whole_files(spark):
    prose = "\n\nint main() { return 0; }\n"
    gpl = (
        "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public "
        "License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later "
        "version.\n */"
    )
    whole = {f"/t/{f.stem}/LICENSE": f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    assert len(whole) >= 12
    rows = {
        "/s/a.c": ("// SPDX-License-Identifier: MIT" + prose, "MIT"),
        "/s/b.py": ("# SPDX-License-Identifier: Apache-2.0" + prose, "Apache-2.0"),
        "/s/c.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */" + prose, "GPL-2.0"),
        "/s/d.rs": ("// SPDX-License-Identifier: MIT OR Apache-2.0" + prose, "MIT OR Apache-2.0"),
        "/s/e": ("ISC License" + prose, "ISC"),
        "/s/f": ("Mozilla Public License Version 2.0" + prose, "MPL-2.0"),
        "/s/g.c": (gpl + prose, "GPL-3.0"),
        "/s/h": ("   GNU GENERAL PUBLIC LICENSE\n      Version 2, June 1991" + prose, "GPL-2.0"),
        "/s/i": ("Copyright (c) 2020 A. All rights reserved.\nThis software is proprietary and confidential." + prose, "Proprietary"),
        "/s/j": ("Some prose about nothing.", None),
    }
    got = scanned(spark, [*((p, t) for p, (t, _) in rows.items()), *whole.items(), ("/t/GPL-2.0/src/x.c", "code")])
    assert {p: got[p].licence for p in rows} == {p: name for p, (_, name) in rows.items()}
    assert {p: got[p].licence for p in whole} == {p: p.split("/")[2] for p in whole}
    assert (got["/t/GPL-2.0/src/x.c"].licence, got["/t/GPL-2.0/src/x.c"].origin) == ("GPL-2.0", "inherited")
