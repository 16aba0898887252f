"""The licence index against a brute-force search of words."""

import re

from conftest import SF

from keyloom.llm import license_scan, queries
from keyloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").encode().lower().decode())
    at = [(i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def check(got, texts):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in texts)
    want = sorted((str(i), *map(str, brute(t))) for i, t in texts)
    assert sorted(tuple(map(str, (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))) for r in got) == want


def test_whole_table(spark):
    got = queries.op2_license_scan(spark, SF).collect()
    check(got, [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()])


def test_small(spark):
    texts = [
        (1, "GNU--General Public\nLicense, and the MIT LICENSE. mit license"), (2, "cc; by"), (3, "ccby cc\u00a0by"), (4, None), (5, ""), (6, "...!"), (7, "mit lıcense \u212aGNU general public license"), (None, "Apache License"), (None, "Apache License"),
        (9, "x " * 60_000 + "Licensed under the Apache License, Version 2.0. " + "y " * 10), (10, "gnu general gnu general public license"), (11, "Released under CC BY-NC 4.0"), (12, "by the cc and by by"), (13, "İmit license"),
        (14, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (15, "the of and a this " * 30),
    ]
    df = spark.createDataFrame([(i, t, "a", 1, "w") for i, t in texts], "doc_id long, text string, label string, row int, word string")
    got = license_scan.scan_licenses(df).collect()
    check(got, texts)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[14]["labels"] == "mit-grant" and by[14]["n_base"] == 0 and by[14]["score"] > 0.9
    assert "apache-2.0" in by[9]["labels"] and by[9]["first_word"] == 60_003
    assert by[15]["labels"] == "" and all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def method_labels(texts, weights):
    """Labels by trying every place of every notice."""
    out = []
    for text in texts:
        w, found = WORD.findall(text.lower()), {label for phrase, label in license_scan.BASE_PHRASES if f" {phrase} " in f" {' '.join(WORD.findall(text.lower()))} "}
        for label, notice, key in license_scan.TEMPLATES:
            t, k = notice.split(), key.split()
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for s in range(-at, len(w)):
                if w[max(s + at, 0) : s + at + len(k)] == k and s + at >= 0:
                    share = sum(weights[x] for i, x in enumerate(t) if 0 <= s + i < len(w) and w[s + i] == x) / sum(weights[x] for x in t)
                    if round(share, 6) >= license_scan.COVERAGE:
                        found.add(label)
        out.append(",".join(sorted(found)))
    return out


def test_labels_of_the_method(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is granted"  # neither "hereby" nor "license"
    texts = [isc, "the " * 50 + isc, isc.replace("copy", "clone"), "apache license version 2 0", "distributed on an as is basis", "redistribution and use in source and binary forms", "Mozilla Public License, v. 2.0", "licensed under the GNU Affero General Public License version 3"]
    texts += [n for _, n, _ in license_scan.TEMPLATES] + [" ".join(n.split()[2:]) for _, n, _ in license_scan.TEMPLATES] + [f"x y {n} {n}" for _, n, _ in license_scan.TEMPLATES]
    texts += ["of the and to in this use as is with"] * 30 + ["nothing here"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(df).collect()}
    want = method_labels(texts, license_scan.word_weights(df))
    assert [got[i] for i in range(len(texts))] == want
    assert got[0] == got[1] == "isc" and got[2] == ""
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(df, rare=1).collect()} == got  # how many words are looked up changes nothing


def test_rarest_words_are_looked_up():
    weights = {r[3]: 1.0 for r in license_scan.posting_rows()} | {"by": 0.1, "the": 0.0}
    index, looked = license_scan.index_of(weights | {"cc": 9.0}, 1)
    assert "cc" in looked and "by" not in looked and "the" not in looked
