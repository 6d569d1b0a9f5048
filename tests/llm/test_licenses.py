import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from quiverlake.llm.licenses import TEMPLATES, file_licenses, scan
from quiverlake.llm.queries import ORACLE_SQL, QUERIES

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def _files(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, p string, text string, license string, score int")


def test_each_template_is_found(spark):
    rows = [(k, f"/{k}", "Some words before. More of them.\n" + text) for k, (_, text) in enumerate(TEMPLATES)]
    got = {r["id"]: r["license"] for r in file_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {k: name for k, (name, _) in enumerate(TEMPLATES)}


def test_inheritance(spark):
    rows = [
        (1, "/a/LICENSE", MIT), (2, "/a/x.txt", "plain"), (3, "/a/b/c/y.txt", "plain text " * 9000), (4, "/a/b/z.txt", f"head\n{APACHE}"), (5, "/q/x.txt", None),
        (6, "/a/b/c/COPYING.md", APACHE), (7, "/a/b/c/d/e.txt", ""), (8, None, MIT), (None, "/a/n.txt", MIT), (2, "/a/x.txt", "plain"), (9, "/r/LICENSE", "nothing of the kind"), (10, "/r/s.txt", "x"), (11, "/a/t.txt", f"{APACHE}\n{MIT}"),
    ]
    got = scan(_files(spark, rows), "doc_id", F.col("p")).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], r["path"]): (r["own_license"], r["license"], r["license_from"]) for r in got}
    assert found[2, "/a/x.txt"] == (None, "MIT", "/a")
    assert found[3, "/a/b/c/y.txt"] == (None, "Apache-2.0", "/a/b/c")
    assert found[4, "/a/b/z.txt"] == ("Apache-2.0", "Apache-2.0", None)
    assert found[7, "/a/b/c/d/e.txt"] == (None, "Apache-2.0", "/a/b/c")
    assert found[5, "/q/x.txt"] == found[10, "/r/s.txt"] == found[9, "/r/LICENSE"] == found[8, None] == (None, None, None)
    assert found[None, "/a/n.txt"] == (None, "MIT", "/a")
    assert found[11, "/a/t.txt"][0] == "Apache-2.0"
    assert scan(_files(spark, []), "doc_id", F.col("p")).collect() == []


def test_prose_has_no_license(spark):
    rows = [(1, "/x", "She asked for permission to leave the house. A driving license costs money. The copyright debate goes on and on in the newspapers.")]
    assert file_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect() == []


def _wrapped(text, width=70):
    return "\n".join(textwrap.wrap(text, width))


def test_whole_licenses_and_wrapped_headers(spark):
    """License files with their copyright lines, and headers over several lines; the shared clauses of BSD do not tell them apart, the third does."""
    text = {}
    for name, notice in TEMPLATES:
        text[name] = max(text.get(name, ""), notice, key=len)
    own = "Copyright (c) 2020 Some Body. All rights reserved.\n\n"
    rows = [(k, f"/{k}/LICENSE", own + _wrapped(text[n])) for k, n in enumerate(("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "0BSD", "Zlib"))]
    headers = [("GPL-3.0", 10), ("AGPL-3.0", 11), ("LGPL-3.0", 12), ("Apache-2.0", 13), ("MPL-2.0", 14), ("GPL-2.0", 15)]
    rows += [(k, f"/{k}/x.c", "A program that does things.\n\n" + _wrapped(text[n], 40) + "\n\nAnd then its code, in many more words that have nothing to do with it. " * 20) for n, k in headers]
    rows += [(20, "/20", "Copyright (c) 2021 Some Body. All rights reserved.\nCode of it.")]
    got = {r["id"]: r["license"] for r in file_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    want = {0: "BSD-2-Clause", 1: "BSD-3-Clause", 2: "MIT", 3: "ISC", 4: "0BSD", 5: "Zlib", 20: "Proprietary"} | {k: n for n, k in headers}
    assert got == want


def test_against_sql(spark, sf_dir):
    got = QUERIES["op5_licenses"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op5_licenses']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    if not want:
        pytest.fail("no rows")
