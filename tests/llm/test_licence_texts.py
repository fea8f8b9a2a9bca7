"""Copyright statements of every form, and licences known by their whole text."""

from ledgerloom.llm import licences
from ledgerloom.llm.workers import importable


def scanned(spark, texts):
    importable(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.license, r.notices) for r in licences.scan(df, licences.known_licences(spark)).collect()}


def test_copyright_statements(spark):
    mit, single = licences._MIT, " ".join(licences._MIT.split())
    headers = ["Copyright (c) Microsoft Corporation.", "Copyright (c) <year> <copyright holders>", "Copyright Jane Doe 2020", "\u00a9 Jane Doe",
               "(c) Jane Doe", "Copyright 2020 Foo, Inc. All rights reserved.", "# Copyright \u00a9 2019-2021 The Foo Authors", "Foo Corp. All rights reserved."]
    texts = [f"MIT License\n\n{h}\n\n{mit}" for h in headers] + [f"{h} {single}" for h in headers[:3] + headers[5:7]]
    texts += [f"MIT License Copyright (c) 2020 Jane Doe {single}", f"The MIT License (c) 2020 J. Doe and others. {single}", f"MIT License Copyright Jane Doe {single}"]
    texts += [mit.replace("the above copyright", "the above\ncopyright").replace("The above copyright", "The above\ncopyright")]
    assert {k: name for k, (name, _) in scanned(spark, texts).items()} == {k: "MIT" for k in range(len(texts))}


def test_statements_leave_notices_and_prose(spark):
    texts = ["Copyright (c) 2020 X. Licensed under CC BY-NC 4.0.", "Copyright 2020 Foo Inc. Released under the MIT License.", "a copyright notice, (c) of the list"]
    assert scanned(spark, texts) == {0: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), 1: ("MIT", "MIT"), 2: (None, None)}
    listed = spark.createDataFrame([("(b) one\n(c) you must retain",)], "text string")
    assert listed.select(licences.canonical("text")).first()[0] == "b one c you must retain"


def test_whole_texts(spark):
    texts = licences.known_texts()
    found = scanned(spark, [t for _, t in texts] + [" ".join(t.split()) for n, t in texts if n.startswith(("BSD", "Unl"))])
    names = [n for n, _ in texts] + [n for n, _ in texts if n.startswith(("BSD", "Unl"))]
    assert [found[k][0] for k in range(len(names))] == names
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(names)
    bsd = next(t for n, t in texts if n == "BSD-3-Clause")
    dressed = "BSD 3-Clause License\n\nCopyright (c) 2021, Jane Doe\nAll rights reserved.\n\n" + bsd.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")
    assert scanned(spark, [dressed])[0][0] == "BSD-3-Clause"


def test_anchors_lose_no_line(spark):
    """All known texts as one line, in other spellings, cases and dresses: looked at, and found as without anchors."""
    texts = [" ".join(t.split()) for _, t in licences.KNOWN + licences.known_texts()]
    swapped = []
    for t in texts:
        for said, meant in licences.SPELLINGS.items():
            t = t.replace(meant, said)
        swapped.append(t)
    lines = [*texts, *[t.upper() for t in texts], *swapped, *[f"Copyright (c) 2020 Jane Doe. {t}" for t in texts], *[t.replace(" ", " -- ") for t in texts]]
    docs = importable(spark).createDataFrame([(i, f"before\n{t}\nafter") for i, t in enumerate(lines)], "doc_id long, text string")
    known = licences.known_licences(spark)
    anchors = {r.anchor for r in known.select("anchor").collect()}
    assert anchors == {"licen", "permission", "redistribution"}
    with_anchors = {r.doc_id: r.notices for r in licences.scan(docs, known).collect()}
    without = {r.doc_id: r.notices for r in licences.scan(docs, known.drop("anchor")).collect()}
    assert with_anchors == without and sum(n is not None for n in without.values()) > 3 * len(texts)


def test_known_texts_without_an_anchor_are_found(spark):
    docs = importable(spark).createDataFrame([(1, "x\nDo as you like.\ny")], "doc_id long, text string")
    known = licences.known_licences(spark, [("Own", "Do as you like"), ("MIT", "MIT license")])
    assert [r.notices for r in licences.scan(docs, known).collect()] == ["Own"]
