from __future__ import annotations

import re

from geoloom.llm import license_scan

DOCS = "doc_id long, text string"


def shortest(tree):
    """A short text that a parsed regex matches, and what its look-aheads ask for behind it."""
    text, tail = "", ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            text += chr(arg)
        elif op == "ANY":
            text += "z"
        elif op == "IN":
            kind, value = arg[0]
            text += {"CATEGORY_DIGIT": "0", "CATEGORY_NOT_SPACE": "q"}[str(value)] if str(kind) == "CATEGORY" else chr(value[0] if str(kind) == "RANGE" else value)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = arg
            text += "".join(shortest(inner)[0] for _ in range(low))
        elif op == "SUBPATTERN":
            inner = shortest(arg[-1])
            text, tail = text + inner[0], tail + inner[1]
        elif op == "BRANCH":
            text += shortest(arg[1][0])[0]
        elif op == "ASSERT":
            tail = shortest(arg[1])[0]
        else:
            raise ValueError(op)
    return text, tail


def own_match(regex):
    """A short text that the rule's regex matches."""
    text = "".join(shortest(re._parser.parse(regex))).strip()
    assert re.search(regex, f" {text} "), (regex, text)
    return text


def labels(text):
    """Labels by all rules, without gates."""
    spaced = f" {text} "
    found = [(m.start(), m.end(), priority, rule, label) for rule, _, regex, priority, label in license_scan.rule_rows() for m in re.finditer(regex, spaced)]
    return {d[4] for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])) for e in found)}


def test_each_rule_finds_a_text_with_its_own_match_only(spark):
    texts = sorted({own_match(r[2]) for r in license_scan.rule_rows()} | {p for p, _ in license_scan.BASE_PHRASES})
    docs = spark.createDataFrame(list(enumerate(f"Ünd, ({t.upper()})!" for t in texts)), DOCS)
    for r in license_scan.scan(docs).collect():
        base = {label for phrase, label in license_scan.BASE_PHRASES if f" {phrase} " in f" {texts[r.doc_id]} "}
        assert set(r.labels.split(",")) == labels(texts[r.doc_id]) | base and r.labels and r.score > 0, texts[r.doc_id]


def test_gates_are_words_that_their_rules_require():
    for _, gate, regex, _, _ in license_scan.rule_rows():
        assert gate in own_match(regex).split(), (gate, regex)


def test_short_forms_without_the_word_license(spark):
    texts = {"Released under Apache 2.0": "apache", "MPL 2.0": "mpl", "BSD 3-Clause": "bsd", "GFDL 1.3": "gfdl", "EPL 1.0": "epl", "OFL 1.1": "ofl", "SPDX-License-Identifier: PSF-2.0": "python", "SPDX-License-Identifier: MS-PL": "ms-pl", "no such thing": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert {list(texts)[r.doc_id]: r.labels for r in license_scan.scan(docs).collect()} == texts


def test_notices_in_files(spark):
    texts = {
        "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */": "apache",
        "// See https://opensource.org/licenses/MIT": "mit",
        "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": "mpl",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
        "GPL v2 with Classpath exception": "gpl,gpl-classpath-exception",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert {list(texts)[r.doc_id]: r.labels for r in license_scan.scan(docs).collect()} == texts


def test_many_copies_and_null_texts(spark):
    rows = [(i, "MIT License" if i % 3 else None) for i in range(3000)] + [(None, "MIT License")] * 2
    docs = spark.createDataFrame(rows, DOCS)
    out = license_scan.scan(docs).collect()
    assert len(out) == len(rows) and all((r.labels, r.n_base) == (("mit", 1) if r.doc_id is None or r.doc_id % 3 else ("", 0)) for r in out)
