import re

import pytest

from trackloom.llm.licenses import NOTICES, op4_license_scans, scanned, trained

KNOWN = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "creative-commons",
    "All rights reserved.": "proprietary",
}


@pytest.fixture(scope="module")
def classifier(spark):
    return trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_notices_alone_and_inside_paragraphs(spark, classifier):
    docs = [(i, n, f) for i, (f, n) in enumerate((f, n) for f in NOTICES for n in NOTICES[f])]
    docs += [(100 + i, f"{n} {' '.join(f'w{j}' for j in range(30))}".upper(), f) for i, n, f in docs]
    got = {r.doc_id: r.family for r in scanned(spark.createDataFrame(docs, "doc_id long, text string, family string"), classifier).collect()}
    assert sum(got.get(i) == f for i, _, f in docs) >= 0.95 * len(docs)


def test_edge_cases(spark, classifier):
    rows = [(1, None), (2, ""), (3, " \n\n"), (4, "the license of all rights"), (5, "x " * 50_000 + "\nAll rights reserved."), (None, "Released under the MIT License."), (None, "Released under the MIT License.")]
    got = scanned(spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double"), classifier).collect()
    assert sorted(((r.doc_id, r.paragraph, r.family) for r in got), key=repr) == sorted([(5, 1, "proprietary"), (None, 0, "mit"), (None, 0, "mit")], key=repr)
    assert all(0 < r.score <= 1 and r.confirmed >= 0.8 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scanned(empty, trained(empty)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for i, line in enumerate((r.text or "").split("\n")):
            for notice, family in KNOWN.items():
                if re.search(re.escape(notice), line, re.I):
                    want.add((r.doc_id, i, family))
    assert {(r.doc_id, r.paragraph, r.family) for r in op4_license_scans(spark, sf).collect()} == want and want


def test_wrapped_notices_and_several_in_a_line(spark, classifier):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that some conditions are met."
    two = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    lesser = "Licensed under the GNU Lesser General Public License"
    rows = [(1, f"some words\n{bsd}\nmore"), (2, two), (3, lesser), (4, "Released under the\n\nMIT License"), (5, "released under the MIT License\nreleased under the MIT License")]
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"), classifier).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == {(1, 1, "bsd"), (2, 0, "mit"), (2, 0, "apache"), (3, 0, "lgpl"), (5, 0, "mit"), (5, 1, "mit")}
    assert [r.text for r in got if r.doc_id == 1] == [bsd]
