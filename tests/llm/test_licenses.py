import math
import re
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millwatch.llm import license_texts, licenses
from millwatch.llm.queries import op3_licenses


def split(t):
    return [x for x in re.split(r"[\W_]+", t.lower()) if x]


def plain(rows, least=0.7, share=0.5):
    """(key, path, text) -> (own, license, dir, is file), by all lines and templates."""
    n = len(rows)
    words = [set(split(t or "")) for _, _, t in rows]
    vocabulary = {w for t in licenses.TEMPLATES.values() for w in split(t)}
    idf = {w: 1 + math.log((1 + n) / (1 + sum(w in s for s in words))) for w in vocabulary}
    vec = lambda t: {w: c * idf.get(w, 1 + math.log(1 + n)) for w, c in Counter(split(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = {k: vec(t) for k, t in licenses.TEMPLATES.items()}
    out = []
    for key, path, text in rows:
        best, said = None, 0
        for line in (text or "").split("\n"):
            v = vec(line)
            got = [(-round(sum(v.get(w, 0) * x for w, x in t.items()) / norm(v) / norm(t), 9), k) for k, t in templates.items()] if v else []
            got = [g for g in got if -g[0] >= least]
            if got:
                best, said = min([best or (9, ""), min(got)]), said + len(split(line))
        is_file = best is not None and (said >= share * max(1, len(split(text or ""))) or bool(path and re.search(licenses.NAMES, path)))
        out.append([key, path, best, is_file])
    dirs: dict = {}
    for _, path, best, is_file in out:
        if is_file and path is not None:
            d = path.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, (9, "")), best)
    result = []
    for key, path, best, is_file in out:
        lic, at = (best[1], None) if best else (None, None)
        if not best and path is not None:
            parts = path.rpartition("/")[0].split("/")
            for k in range(len(parts), -1, -1):
                d = "/".join(parts[:k])
                if d in dirs:
                    lic, at = dirs[d][1], d
                    break
        result.append((key, best[1] if best else None, lic, at, is_file))
    return sorted(result, key=str)


def result(df, key):
    return sorted(((r[key], r["own_license"], r["license"], r["license_dir"], r["is_license_file"]) for r in df.collect()), key=str)


def test_query(spark):
    rows = [(r[0], "/".join([r[2] or "-", r[3] or "-", str(r[0])]), r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    got = result(op3_licenses(spark, "/root/testdata/sf0.01"), "doc_id")
    assert got == plain(rows)
    assert sum(r[1] is not None for r in got) >= 10


@pytest.fixture
def tree():
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    return [
        (1, "a/LICENSE", "x y z\n" + mit + "\n" + "word " * 60),
        (2, "a/b/c.py", "print"),
        (3, "a/b/d/e.py", "# " + gpl + "\ncode code code code code code code code code code code code code code code code"),
        (4, "z/q.py", "none"),
        (5, "COPYING", gpl),
        (6, None, mit),
        (7, None, None),
        (8, "a/b/f.txt", ""),
        (9, "a/b/d/", "t"),
        (2, "a/b/c.py", "print"),
        (None, "a/n", mit + " " + mit),
    ]


def test_tree(spark, tree):
    df = spark.createDataFrame(tree, "id long, path string, text string").withColumns({"t": F.lit(1), "name": F.lit("q"), "c": F.lit(2)})
    got = licenses.scan_licenses(df)
    assert result(got, "id") == plain(tree)
    assert {"t", "name", "c"} <= set(got.columns)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    clash = licenses.scan_licenses(df.withColumns({"License": F.lit(1), "_id": F.lit(5)}))
    assert "License" not in clash.columns and clash.where("_id = 5").count() == df.count()
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_common_licences(spark):
    """Headers, wrapped notices, SPDX lines and full texts; names outside the list have none."""
    texts = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    bsd = license_texts._BSD + "\n" + license_texts._BSD_3 + "\n\n" + license_texts._BSD_END
    comment = lambda t: "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 60)) + "\n */\n" + "int main(void) { return counter + offset; }\n" * 30
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows = [(f"full/{k}/LICENSE", t, k) for k, t in texts.items()]
    rows += [
        ("mit/LICENSE", "MIT License\n\nCopyright (c) 2020 Ann Other\n\n" + license_texts._MIT.replace("conditions:\n", "conditions:\n\n") + "\n\n" + license_texts._AS_IS, "MIT"),
        ("bsd3/LICENSE", "Copyright (c) 2020, Ann Other\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"),
        ("bsd2/LICENSE", "Copyright (c) 2020, Ann Other\n\n" + license_texts._BSD + "\n\n" + license_texts._BSD_END, "BSD-2-Clause"),
        ("isc/LICENSE", "Copyright 2020 Ann\n\n" + license_texts._ISC + ", provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + license_texts._ISC_END, "ISC"),
        ("a/1.c", comment(gpl2), "GPL-2.0"),
        ("a/2.c", comment(gpl2.replace("version 2", "version 3")), "GPL-3.0"),
        ("a/3.c", comment(gpl2.replace("version 2", "version 2.1").replace("program", "library").replace("General", "Lesser General")), "LGPL-2.1"),
        ("a/4.c", comment(license_texts._MPL), "MPL-2.0"),
        ("a/5.c", comment(license_texts._APACHE), "Apache-2.0"),
        ("a/6.c", "// SPDX-License-Identifier: MIT\nint x;\n" + "int y;\n" * 30, "MIT"),
        ("a/7.c", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\n" + "int y;\n" * 30, "GPL-2.0"),
        ("a/8.py", "# Released under the BSD License.\n" + "y = 1\n" * 30, "BSD"),
        ("a/9.py", "# Licensed under the GNU General Public License v3.\n" + "y = 1\n" * 30, "GPL-3.0"),
        ("a/10.txt", "The council gave permission to hold a license hearing.\nNobody redistributed the 2 papers.", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "id long, path string, text string")
    got = {r["path"]: (r["own_license"], r["is_license_file"]) for r in licenses.scan_licenses(df).collect()}
    assert {p: x for p, (x, _) in got.items()} == {p: x for p, _, x in rows}
    assert all(is_file for p, (_, is_file) in got.items() if p.endswith("LICENSE")) and not any(is_file for p, (_, is_file) in got.items() if p.startswith("a/"))


def test_repeated_rows_count_once(spark):
    """A row given twice is no likelier a licence file than given once, so its directory doesn't inherit."""
    text = "Released under the MIT License.\n" + " ".join(f"word{i}" for i in range(8))
    rows = [(1, "a/x.py", text), (2, "a/y.py", "nothing here"), (3, "b/x.py", text), (3, "b/x.py", text), (4, "b/y.py", "nothing here")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string"))
    assert {(r["id"], r["own_license"], r["license"], r["is_license_file"]) for r in got.collect()} == {(1, "MIT", "MIT", False), (2, None, None, False), (3, "MIT", "MIT", False), (4, None, None, False)}
