"""The ten corpus operators and the pipeline against brute force, on small tables with odd rows."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigmaloom.llm import chat, decontam, html, langid, licenses, minhash, mixing, quality, suffix, urls

DOCS = "doc_id long, text string, lang string, source string, extra int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the small table, with nulls, empty and odd texts, repeated rows and a clashing column."""
    rows = [tuple(r) + (1,) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()]
    base = max(rows, key=lambda r: len(r[1] or ""))[1]
    odd = [(9001, None, None, None, 1), (9002, "", "en", "", 1), (9003, "   \n\t ", None, "src0", 1), (9004, "a" * 700, "en", "src1", 1), (9005, "ab" * 400, "de", None, 1), (9006, base, "en", "src2", 1), (9006, base, "en", "src2", 1), (None, base[:400], None, "src3", 1), (9008, "12 34 !!", "en", "src0", 1), (9009, base.replace(" the ", " THE ", 3), "en", "src4", 1)]
    return spark.createDataFrame(rows + odd, DOCS).cache()


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "bye"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "bye"), (4, 0, None, None), (5, 0, "user", "hi"), (5, 1, "bot", "other"), (None, 0, "user", "lone")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got.keys() == {2, 4, 5, None}
    assert got[2][:2] == (3, 2)
    assert got[4][2] == "<|user|>\n\n<|end|>\n"
    clash = spark.createDataFrame([(i, t, r, x, 5, "z") for i, t, r, x in rows], "conv_id long, turn long, role string, text string, n_turns int, c string")
    assert {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.render_chats(clash).collect()} == got
    assert got[None][2] == "<|user|>\nlone\n<|end|>\n"
    assert chat.render_chats(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def test_quality(spark, docs):
    got = quality.quality_cascade(docs).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert len(got) == sum(texts.values())
    want = Counter()
    for (i, text), n in texts.items():
        w, t = words(text), text or ""
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)] += n
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.quality_cascade(empty(spark)).count() == 0


def test_cascade_order(spark):
    """The order follows rejection per cost; costs are taken by running each rule, shares exactly."""
    assert quality.cascade_order({"dear": (0.6, 1.0), "cheap": (0.3, 0.1), "never": (0.0, 0.1), "same": (0.3, 0.11)}) == ["cheap", "same", "dear", "never"]
    sample = spark.createDataFrame([(i, "word " * 20000) for i in range(10)], "x int, text string")
    found = {"dear": (F.length(F.regexp_replace("text", "[^!]+", "")) > 0) | (F.col("x") < 6), "cheap": F.col("x") < 3}
    got = quality.rejected_and_cost(sample, found)
    assert got["dear"][0] == 0.6 and got["cheap"][0] == 0.3 and got["dear"][1] > got["cheap"][1]
    assert quality.cascade_order(quality.rejected_and_cost(sample.limit(0), found)) == ["cheap", "dear"]


def test_quality_rules_reject_and_keep(spark):
    good = " ".join(f"word{i} other" for i in range(60)) + "."
    bad = {"symbols": good + " ###" * 20, "duplicate_lines": good + "\nsame line here\nsame line here\nsame line here", "shouting": good.upper(), "exclamations": good + "!" * 30, "few_letters": " ".join(str(10000 + i) for i in range(100)), "word_length": " ".join("x" * 14 + f"{i}y" for i in range(100))}
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate([good, *bad.values()])], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.kept, r.failed_rule) for r in quality.quality_cascade(d).collect()}
    assert got.pop(0) == (True, None)
    assert not any(kept for kept, _ in got.values()) and {f for _, f in got.values()} == set(bad)


def test_html():
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy now, it is good.</div><article><h1>A &amp; B</h1><p><b>One.<br><p>Two  words\n here, and some more of them.</p><form>name</form></article><div id="comments"><p>I like this very much, thank you.</p></div><footer>&copy; x</footer>'
    assert html.main_text(page)[0] == "A & B\nOne.\nTwo words here, and some more of them."
    assert html.main_text("") == ("", 0)
    assert html.main_text("<p>" * 3000)[0] == ""


@pytest.mark.parametrize("wrap", ['div class="layout has-sidebar"', 'div class="post-header-wrap"', 'div id="page-banner-top"', 'div class="sidebar"', "form"])
def test_html_wrappers(wrap):
    """An article is kept whatever wraps it; what is no article beside it is not."""
    inner = '<article><h1>Title</h1><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is <object>a figure</object> here.</p></article>'
    page = f'<body><nav><a href="/">Home</a></nav><{wrap}>{inner}</{wrap.split()[0]}><div id="comments"><article><p>Nice one, thank you.</p></article></div><div class="site-footer"><p>All rights kept.</p></div></body>'
    assert html.main_text(page)[0] == "Title\nThe sum x+1 is a figure here."


def test_html_parts_of_an_article():
    """Headers, quotes and notes inside an article stay; adverts, forms and comments there go; a line that is one link stays among paragraphs."""
    text = "These are some words of the article, and here it goes on."
    page = f'<article><div class="story-header"><h1>Title</h1></div><p>{text}</p><div class="ad"><p>{text} Buy it.</p></div><p><a href="/x">See also the other page</a></p><p>{text}</p><blockquote class="search">find</blockquote><div class="legal">No warranty</div><p>{text}</p><form>{text}</form><section class="comments"><p>{text}</p></section></article>'
    assert html.main_text(page)[0].split("\n") == ["Title", text, "See also the other page", text, "find", "No warranty", text]


def test_html_cut_changes_labels():
    """The classifier alone errs on short blocks; the cut sets them right by what they stand in and beside."""
    page = "<div><p>Short</p>" + "<p>A much longer text with many words in it, which says what the page is about, and more.</p><p>Name</p>" * 3 + "</div>"
    found = html.blocks_of(page)
    assert sum(x[1] < 0 for x in found) == 4 and all(x[2] == x[3] == 0 for x in found)
    assert html.main_text(page)[0].count("\n") == 6


def test_html_long_pages_take_linear_time(spark):
    import time

    def seconds(n):
        page = "<div>" * n + "</p>" * n + "<p>word</p><p>A longer sentence with some more words in it, and so on.</p>" * n
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.5
    d = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 4), (3, "u", "<p>" + "long text, " * 200_000 + ".</p>", 5), (3, "u", "<article>x", 5), (3, "u", "<article>x", 5)], "page_id long, url string, html string, text int")
    got = html.extract_pages(d).collect()
    assert sorted((r.page_id, len(r.text), r.n_chars) for r in got) == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (3, 2_200_001, 2_200_001)]
    assert html.extract_pages(d.limit(0)).count() == 0


def test_minimum_cut():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(x for x, s in zip(scores, side, strict=True) if x > 0 and not s) - sum(x for x, s in zip(scores, side, strict=True) if x < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        assert math.isclose(cost(html.minimum_cut([max(0, x) for x in scores], [max(0, -x) for x in scores], edges)), min(map(cost, itertools.product([False, True], repeat=n))), abs_tol=1e-6)


def check_suffix(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[j : j + 200] for _, b in rows for j in range(len(b) - 199))
    want = Counter()
    for i, b in rows:
        mark = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                mark[j : j + 200] = b"\1" * 200
        left = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        want[i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(left).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.cut_repeats(docs).collect()) == want
    return want


def test_suffix(spark, docs):
    check_suffix(docs)
    assert suffix.cut_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize(("group", "batch"), [(2000, 1000), (2000, 3), (2, 1000), (0, 1)])
def test_suffix_arrays(spark, monkeypatch, group, batch):
    """Passages of 190 to 320 bytes in many places of different texts, with changed bytes, beside 300 equal rows; both ways of sorting."""
    import random

    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "SORTED", batch)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passage = word(320)
    rows = []
    for i in range(40):
        a, b = rng.choice([(0, 320), (0, 260), (40, 320), (30, 229), (30, 230), (30, 231)])
        part = list(passage[a:b])
        if i % 3 == 0:
            part[rng.randrange(len(part))] = "Z"
        rows.append((i, word(rng.randrange(200)) + "".join(part) + word(rng.randrange(200)), "x"))
    rows += [(77, word(500) + passage[:150], "x")] * 300 + [(78, "ab" * 3000, "x"), (79, "c" * 199, "x"), (80, "c" * 200, "x"), (81, None, None), (None, "", None)]
    want = check_suffix(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert sum(x[2] > 0 for x in want) > 20


def test_language(spark, docs):
    got = langid.language_of(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[9001].lang_pred == by[9002].lang_pred == by[9008].lang_pred == "und"
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 9000}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in langid.language_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture():
    import numpy as np

    p = np.array([[0.9, 0.1], [0.1, 0.9]])
    share, _ = langid.mixture(p, np.array([75.0, 25.0]), 200)
    assert abs(share[0] - 0.8125) < 0.05  # (0.75 - 0.1) / 0.8


def test_urls(spark):
    rows = [(i, f"https://{h}.com/de/x{i}?spam=1") for i, h in enumerate(["a", "b"] * 20)] + [(100, "http://WWW.Example.com/en/71"), (101, "http://x.com/en/5#a"), (102, None), (103, "no scheme"), (104, "ftp://example.net/de/8?x"), (105, "http://net/de/1"), (106, "http://sub.org/es/")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[100].host, got[100].path, got[100].rule, got[100].verdict) == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[101].rule, got[101].verdict) == ("com/en/", "block")
    assert got[102].host == got[103].path == "" and got[102].verdict == "allow"
    assert (got[104].rule, got[104].path) == ("example.net/de/8", "/de/8")
    assert got[105].rule == "net/de/" and got[106].rule == "org/es/"


def test_mined_rules(spark):
    rows = [(["h:bad", "p:x"], True)] * 9 + [(["h:bad", "p:y"], False)] * 9 + [(["h:ok", "p:x"], False)] * 9
    rules = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.8)
    assert [r.antecedent for r in rules.collect()] == [["h:bad", "p:x"]]
    hit = urls.match_rules(spark.createDataFrame([("u1", ["h:bad", "p:x", "q:z"]), ("u2", ["h:bad"])], "url string, tokens array<string>"), rules)
    assert [r.url for r in hit.collect()] == ["u1"]


def test_mined_rules_are_minimal_and_as_counted(spark):
    """Against a count of all combinations: block rules by confidence and support, without those that hold a smaller one."""
    import itertools
    import random

    rng = random.Random(4)
    rows = [(t, (rng.random() < 0.1) != ({"a", "b"} <= set(t) or "c" in t)) for t in (sorted(rng.sample("abcdef", rng.randint(1, 5))) for _ in range(200))]
    part, blocked = Counter(), Counter()
    for t, bad in rows:
        for n in range(1, 6):
            for c in itertools.combinations(t, n):
                part[c] += 1
                blocked[c] += bad
    good = {c for c in part if blocked[c] >= 10 and blocked[c] >= 0.7 * part[c]}
    want = sorted(list(c) for c in good if not any(set(d) < set(c) for d in good))
    got = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.05, 0.7, 0.0, ())
    assert want and sorted(r.antecedent for r in got.collect()) == want


def test_urls_judged_by_rules_of_covered_ones(spark):
    rows = [(i, f"http://x{i}.org/es/{i}") for i in range(20)] + [(50 + i, f"http://x{i}.net/de/{i}") for i in range(20)] + [(100, "http://new.org/fr/1"), (101, "http://new.net/fr/1"), (102, "http://new.info/fr/1"), (103, "http://new.org/old/es/1"), (104, "http://new.info/es/1")]
    d = spark.createDataFrame([(i, u, "h", "r", "t") for i, u in rows], "page_id long, url string, host string, rule string, tokens string")
    got = {r.page_id: r for r in urls.filter_urls(d).collect()}
    assert len(got) == len(rows)
    assert got[0].verdict == "block" and got[50].verdict == "allow"
    # neither the host's suffix nor the folder alone decides, both together do
    assert [got[i].verdict for i in (100, 101, 102, 104)] == ["allow"] * 4 and got[103].verdict == "block" and got[103].mined == "h:org p:es"
    assert urls.filter_urls(d.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "x\nReleased under the MIT License.\nCC-BY cc by"), (2, None), (3, "Permission is hereby granted, free of charge, to any person obtaining copies of this software and associated documentation files"), (4, "the mit licenses"), (5, "GNU\tGeneral  Public-License")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (10, 3, 4, 8, "cc-by,mit")
    assert got[2].n_words == 0 and got[2].labels == "" and got[2].first_word is None
    assert got[3].base_labels == "" and got[3].labels == "mit" and got[3].score >= 0.8
    assert got[4].n_base == 0 and got[5].labels == "gpl"


def test_license_names_and_wraps(spark):
    """Notices that share most words keep apart; a notice is found however its lines are broken."""
    texts = {
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "lgpl": "It is licensed under the GNU Lesser General Public License, version 3.",
        "cc-by": "The text is licensed under CC BY 4.0.",
        "cc-by,cc-by-nc": "The text is licensed under CC BY-NC 4.0.",
        "cc-by,cc-by-sa": "The text is licensed under CC BY-SA 4.0.",
        "cc-by,cc-by-nc,cc-by-sa": "The text is licensed under CC BY-NC-SA 4.0.",
        "": "The song was released under the other name, so no license was needed for it.",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "cc0": "This work is dedicated to the public domain under CC0.",
    }
    rows = []
    for label, text in texts.items():
        w = text.split()
        rows += [(label, text), (label, "Lead in words here.\n" + text + "\nand more.")]
        rows += [(label, "\n".join([" ".join(w[:k]), " ".join(w[k:])])) for k in range(1, len(w))] + [(label, "\n * ".join(w))]
    both = texts["gpl"] + "\n" + texts["lgpl"].replace("It", "Other parts")
    rows += [("gpl,lgpl", both), ("", "source and binary forms\n" + "of other things\n" * 9 + "redistribution and use with or without modification are permitted")]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {i: label for i, (label, _) in enumerate(rows)}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_minhash(spark, docs, k, num):
    sets = {}
    for r in docs.filter("doc_id is not null").collect():
        w = [x.lower() for x in words(r.text)]
        sets[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if part[b] < part[a] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    part[a] = part[b]
        if all(part[part[i]] == part[i] for i in part):
            break
    got = minhash.near_duplicates(docs, k, (num, 100)).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(s), part[i], part[i] == i) for i, s in sets.items()}


def test_equal_ids_with_different_texts(spark):
    """Each text of a doc_id is compared, whichever the table gives first, and they share a component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (5, c), (6, "lone words"), (None, a)]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), 5, (80, 100)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


def test_stages_keep_one_row_of_a_group(spark):
    """Repeated rows, null ids and equal ids with different texts: one row of a group stays, with its text whole."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(1, a), (1, a), (1, a), (2, a + " end"), (None, b), (None, b), (7, c), (7, d), (8, d + " end"), (None, d), (9, "x y"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    want = sorted([(1, a), (None, b), (7, c), (7, d), (9, "x y")], key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == want
    left = corpus_pipeline.repeated_string_stage(spark, kept, "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == want


def test_large_groups(spark):
    """A group too large for all pairs: edits of one text, in chains that link only by way of others."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(100), rng.choice([1, 2, 3, 4])):
            w[j] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    for i in range(8):
        w = list(base)
        w[: 4 * i] = [f"y{j}" for j in range(4 * i)]
        rows.append((100 + i, " ".join(w)))
    sets = {i: frozenset(tuple(t.split()[k : k + 3]) for k in range(98)) for i, t in rows}
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if part[b] < part[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    part[a], changed = part[b], True
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == part


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(size.values())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, free = {}, float(total), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        free -= over
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()), key=repr)
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_sainte_lague(spark):
    rows = [("a", 53, 7), ("b", 24, 7), ("c", 23, 7)]
    got = mixing.sainte_lague(spark.createDataFrame([("g", *r) for r in rows], "g string, name string, v long, n long"), ["g"], "v", "n", [F.col("name")])
    seats = Counter()
    for _ in range(7):
        seats[max(rows, key=lambda r: (r[1] / (2 * seats[r[0]] + 1), r[0]))[0]] += 1
    assert {r.name: r.quota for r in got.collect()} == dict(seats)


def test_tiling():
    import numpy as np

    item = np.arange(40, dtype=np.uint64)
    text = np.concatenate([np.full(7, 99, np.uint64), item[20:], np.full(3, 98, np.uint64), item[:20]])
    assert decontam.tiles(text, item, 5) == 40  # reordered halves
    assert decontam.tiles(item[:4], item, 5) == 0
    assert decontam.tiles(np.zeros(50, np.uint64), np.zeros(20, np.uint64), 5) == 20


def tiled(text, item, least):
    """Greedy string tiling by its definition: the longest common free stretch first, then the earliest in item and text."""
    least = max(1, min(least, len(item)))
    used_t, used_p = [False] * len(text), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least or not n:
            return sum(used_p)
        used_p[i : i + n] = [True] * n
        used_t[j : j + n] = [True] * n


def test_tiling_against_its_definition():
    import random

    import numpy as np

    rng = random.Random(6)
    for _ in range(150):
        words = rng.choice([2, 3, 8])
        text, item = ([rng.randrange(words) for _ in range(rng.randint(0, 40))] for _ in range(2))
        if item and rng.random() < 0.5:
            at = rng.randrange(len(item))
            text += item[at:] + item[:at]
        assert decontam.tiles(np.array(text, np.uint64), np.array(item, np.uint64), 3) == tiled(text, item, 3)
    same = np.zeros(4000, np.uint64)
    assert decontam.tiles(same, same[:3000], 5) == 3000


def test_short_items_and_odd_rows(spark):
    """Items shorter than a seed match as a whole; empty and null rows match nothing; clashing names are ignored."""
    bench = spark.createDataFrame([(1, "Quartz Zebra", 0), (2, "", 0), (3, None, 0), (4, "one", 0), (5, "a b c d e f g h", 0)], "item_id long, text string, words int")
    rows = [(1, "the quartz, zebra ran"), (2, "zebra quartz"), (3, None), (4, ""), (5, "One"), (6, "f g h a b c d e"), (6, "f g h a b c d e"), (None, "x " * 9000 + "quartz zebra")]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n_words int")
    got = sorted((r.doc_id or 0, r.item_id, r.covered, r.contaminated) for r in decontam.contaminated(d, bench).collect())
    assert got == sorted([(1, 1, 2, True), (2, None, 0, False), (3, None, 0, False), (4, None, 0, False), (5, 4, 1, True), (6, 5, 5, False), (6, 5, 5, False), (0, 1, 2, True)], key=lambda x: x[0])
    assert decontam.contaminated(d.limit(0), bench).count() == 0


def test_decontamination(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    first = bench.filter("length(text) > 120").orderBy("item_id").first()
    w = first.text.split()
    half = len(w) // 2
    more = spark.createDataFrame([(7001, "lead in " + " ".join(w[half:] + ["and", "then"] + w[:half])), (7002, " ".join(w[: len(w) // 3])), (7003, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(more, bench).collect()}
    assert got[7001].contaminated and got[7001].item_id == first.item_id
    assert not got[7002].contaminated and not got[7003].contaminated
    assert not any(r.contaminated for r in decontam.contaminated(more, bench.limit(0)).collect())


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(rows) <= spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.taken <= 3 * r["size"] for r in rows)
