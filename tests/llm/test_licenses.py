import re

from corpusloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "MIT License\nand again the MIT-License; CC BY-NC 4.0.",
    "GNU Lesser General Public License version 2.1",
    "SPDX-License-Identifier: Apache-2.0",
    "cc by cc by Apache_License", "mit licenses are not the phrase", "", None, "CC" + "é" + " BY",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "released under the terms of the Apache License, Version 2.0. " * 30,
]


def _base(text):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    w, at, labels = WORD.findall(low), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_against_brute_force(spark, docs, texts):
    rows = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    every = dict(enumerate(texts)) | {100 + i: t for i, t in enumerate(TEXTS)} | {None: texts[3]}
    found = licenses.scan(docs.select("doc_id", "text").unionByName(rows)).collect()
    assert len(found) == len(every) + 1
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(every[r.doc_id])
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}


def test_labels_and_suppression(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.scan(rows).collect()}
    assert labels[0] == "gpl" and labels[1] == "cc-by,cc-by-nc,mit"
    assert labels[2] == "lgpl"  # the general license inside it is suppressed
    assert labels[3] == "apache" and labels[9] == "mit" and labels[6] == labels[7] == ""


def test_rules_are_many_and_valid():
    found = licenses.rules()
    assert len(found) > 300 and all(re.compile(r[3]) for r in found)


def test_native_and_empty(nothing, docs):
    assert licenses.scan(nothing).count() == 0
    plan = licenses.scan(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "ArrowEval" not in plan
