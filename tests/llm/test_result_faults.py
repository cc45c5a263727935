"""Cases of operators 3, 4, 6 and 7 that once gave wrong results."""

from __future__ import annotations

import math
import random
import re

import pytest

from sigmaloom.llm import html, licenses
from tests.llm.test_operators import check_suffix

TEXT = [f"This is paragraph number {i} of the long article, and it goes on with several words more." for i in range(3)]
ARTICLE = "".join(f"<p>{x}</p>" for x in TEXT)


@pytest.mark.parametrize(
    "wrap,first",
    [
        ("<article class='overflow-hidden rounded'>{}</article>", ""),
        ('<div class="overflow-hidden bg-white"><article>{}</article></div>', ""),
        ("<article data-note='a hidden gem' data-class='footer'>{}</article>", ""),
        ("<article><header><h1>Real Title</h1></header>{}</article>", "Real Title\n"),
        ("<article>{}</article><div hidden><p>Subscribe to our letter now, it is free for all.</p></div>", ""),
        ("<article>{}</article><div aria-hidden='true'><p>Some of it is not for you, dear reader.</p></div>", ""),
        ("<div hidden=''><article>{}</article></div>", ""),
        ("<article>{}<p style='color: red; display: none'>Not shown to anyone at all here.</p></article>", ""),
    ],
)
def test_hidden_is_an_attribute(wrap, first):
    page = f"<body><nav><a href=x>Menu</a></nav>{wrap.format(ARTICLE)}<footer>All of it is ours.</footer></body>"
    assert html.main_text(page)[0] == first + "\n".join(TEXT)


def test_repeated_rows_open_their_text_once(spark):
    """One row 300 times, and two texts that share a passage with it."""
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(1, f"first {passage} end")] * 300 + [(2, f"another beginning {passage} and end"), (3, passage[40:400]), (4, "short")]
    check_suffix(spark.createDataFrame(rows, "doc_id long, text string"))


def test_license_blocks_against_all_windows(spark):
    """Every run of words of a block's length, of random texts over the templates' words and others."""
    random.seed(4)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = []
    for i in range(250):
        made = []
        for _ in range(random.randint(0, 4)):
            own = random.choice(licenses.TEMPLATES)[1].split()
            for _ in range(random.randint(0, 5)):
                own[random.randrange(len(own))] = random.choice([*words, "other", "", "nc, sa"])
            made += [random.choice(["Word", "x\ny", *words[:5]]) for _ in range(random.randint(0, 6))] + own
        texts.append((i, " ".join(made).title() if i % 2 else "\n".join(made)))
    texts += [(900, None), (901, ""), (902, "license " * 5000), (902, "license " * 5000)]
    want = {}
    for i, text in texts:
        have = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        found = []
        for label, t in licenses.TEMPLATES:
            own, size = set(t.split()), math.ceil(len(t.split()) / 0.8 - 1e-9)
            for a in range(len(have)):
                if have[a] in own and len(own & set(have[a : a + size])) >= 0.8 * len(own) - 1e-9:
                    last = max(k for k in range(a, min(a + size, len(have))) if have[k] in own) + 1
                    found.append((label, a, last, len(own & set(have[a : a + size])) / len(own)))
        stays = [(x, s) for x, a, b, s in found if not any(y in licenses.GIVES_WAY.get(x, ()) and c < b and a < d for y, c, d, _ in found)]
        want[i] = ({x for x, _ in stays}, max((s for _, s in stays), default=None))
    d = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as labels")
    for r in licenses.scan_licenses(d).collect():
        labels, score = want[r.doc_id]
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(","))), r
        assert math.isclose(r.score, score if score is not None else float(bool(r.base_labels)))
    assert sum(bool(x) for x, _ in want.values()) > 100


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache-2.0 License, Version 2.0", "apache"),
        ("redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated project documentation files", "mit"),
        ("under the terms of the GNU Lesser General Public License", "lgpl"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc,cc-by-sa"),
        ("released under the terms of a license", ""),
    ],
)
def test_license_wordings(spark, text, labels):
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels
