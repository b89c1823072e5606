import re

from tests.oracle import connect, same
from tidemark.llm import licenses


def test_equals_oracle(spark):
    sf = "/root/testdata/sf0.01"
    same(licenses.license_matches(spark.read.parquet(f"{sf}/documents.parquet")), connect(sf), licenses.oracle_sql())


def test_variants_have_one_digest(spark):
    mit = "MIT License\n" + licenses.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (3, mit + "\nmore"), (4, mit.replace("License", "Licence")), (5, "  " + mit.replace(" ", "   "))]
    got = {r.doc_id for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id int, text string")).collect() if r.scope == "text" and r.license == "MIT"}
    assert got == {1, 2, 4, 5}


def test_rows_of_every_kind(spark):
    notice = "Released under the MIT License."
    rows = [(1, f"a\n{notice}\n{notice}\nb", 1), (1, notice, 1), (None, notice, 1), (2, None, 1), (3, "", 1), (4, "©\n" * 10, 1), (5, "x " * 50_000 + "\n# " + notice, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    got = {(r.doc_id, r.license, r.scope, r.n) for r in licenses.license_matches(df).collect()}
    assert got == {(1, "MIT", "line", 3), (1, "MIT", "text", 1), (None, "MIT", "line", 1), (None, "MIT", "text", 1), (5, "MIT", "line", 1)}
    assert licenses.license_matches(df.where("doc_id = 9")).count() == 0


def test_every_known_text_passes_the_prefilter_under_any_spelling(spark):
    """The filters drop nothing that the plain form would find."""
    texts = licenses.known_texts()
    assert all(any(m in t.lower() for m in licenses.MARKS) for _, t in texts)
    rows = [(str(i), t) for i, (_, t) in enumerate(texts)]
    for i, (_, t) in enumerate(texts):
        low = t.lower()
        for old, new in licenses.SPELLINGS:
            if new in low:
                rows.append((f"{i} {old}", low.replace(new, old)))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    plain = licenses.canonical_units(df).join(licenses.known_digests(spark), "digest").groupBy("doc_id", "license", "scope").count()
    fast = licenses.license_matches(df)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, fast.collect()))
    assert {r.doc_id for r in fast.where("scope = 'text'").collect()} == {r[0] for r in rows}


def test_whole_texts_are_found(spark):
    import os

    import pytest

    folder = "/usr/share/common-licenses"
    if not os.path.exists(f"{folder}/GPL-3"):
        pytest.skip("no licence texts on this machine")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl", "GFDL-1.3": "GFDL-1.3"}
    rows = []
    for f in names:
        text = open(f"{folder}/{f}", encoding="utf-8").read()
        kept = "\n".join(line for line in text.split("\n") if not re.match(licenses.COPYRIGHT_LINE, line.lower()))
        rows += [(f, text), (f + " unwrapped", "\n\n".join(" ".join(p.split()) for p in kept.split("\n\n"))), (f + " more", text + "\nand more")]
    got = {r.doc_id: r.license for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id string, text string")).where("scope = 'text'").collect()}
    assert {k: v for k, v in got.items() if "more" not in k and "unwrapped" not in k} == names
    assert not any("more" in k for k in got)
    assert {k.removesuffix(" unwrapped"): v for k, v in got.items() if "unwrapped" in k} == names


def test_titles_and_rights_lines_are_optional(spark):
    body = dict(licenses.KNOWN)["ISC"]
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause" and len(t) > 200)
    rows = [(1, body), (2, "The ISC License\n\nCopyright (c) 2004 A\n\n" + body), (3, "Copyright 2020, B.\nAll rights reserved.\n\n" + bsd), (4, "BSD 3-Clause License\n\n" + bsd), (5, "copyright notice and " + body)]
    got = {(r.doc_id, r.license) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id int, text string")).where("scope = 'text'").collect()}
    assert got == {(1, "ISC"), (2, "ISC"), (3, "BSD-3-Clause"), (4, "BSD-3-Clause")}


def test_a_table_of_the_callers_own(spark):
    own = licenses.canonical_units(spark.createDataFrame([("mine", "My own terms.\nDo as you like.")], "doc_id string, text string")).where("scope = 'text'").selectExpr("digest", "doc_id AS license")
    rows = spark.createDataFrame([(1, "MY OWN TERMS;\n\ndo as you like"), (2, "my own")], "doc_id int, text string")
    assert [(r.doc_id, r.license, r.scope, r.n) for r in licenses.license_matches(rows, own).collect()] == [(1, "mine", "text", 1)]
