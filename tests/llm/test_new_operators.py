"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sigmaloom.llm import langid, queries, resample, runs, simhash
from sigmaloom.operators.components import connected_components

EDGES = [
    (1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "One"), (None, "a b c d e f"), (7, "x " * 3000), (7, "another text of the same id"),
    (8, "naïve café \U0001f600 你好"), (8, "naïve café \U0001f600 你好"), (9, "w" * 50_000), (10, "p q r " * 40 + "tail"), (11, " ".join(f"w{i}" for i in range(30_000))),
]


def frame(spark, rows, extra=True):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.selectExpr("*", "'x' as fp", "1 as top", "2 as runs", "3 as weight", "4 as rank") if extra else d


def components(values: np.ndarray, distance: int) -> dict[int, int]:
    label = {int(v): int(v) for v in values}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= distance]:
            a, b = top(int(v)), top(int(w))
            label[max(a, b)] = min(a, b)
    return {int(v): top(int(v)) for v in values}


@pytest.mark.parametrize("distance,sizes", [(4, simhash.Sizes(4, 16, 2, 3)), (4, simhash.Sizes()), (2, simhash.Sizes(2, 8, 3, 2))])
def test_gray_index_loses_no_link(spark, distance, sizes):
    """Random fingerprints, a dense cluster, a chain of near ones, and a top node that holds a third of all."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 1, np.uint64)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), 1)
    chain = [centre[0] ^ np.uint64(0xFFFF00000000)]
    for _ in range(60):
        chain.append(chain[-1] ^ flips(1, 3)[0])
    hot = (rng.integers(0, 2**40, 300, np.uint64) << np.uint64(24)) | np.uint64(0xABCDEF)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 300, np.uint64), centre ^ flips(300, 3), centre ^ flips(100, 7), np.array(chain, np.uint64), hot, hot[:50] ^ flips(50, 2)]))
    leaves = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {r.id: r.component for r in connected_components(simhash.fingerprint_links(leaves, distance, sizes)).collect()}
    want = components(values, distance)
    groups = lambda of: {frozenset(g) for g in _groups(of).values() if len(g) > 1}
    assert groups({int(np.int64(k).view(np.uint64)): v for k, v in found.items()}) == groups(want)


def _groups(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, set()).add(k)
    return out


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_edges(spark):
    got = simhash.near_fingerprints(frame(spark, EDGES)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((d is None, d or 0, f"{plain_fingerprint(t):016x}") for d, t in EDGES)
    parts = {r.doc_id: r.component_id for r in got}
    assert parts[1] == parts[2] == parts[3] == 1 and parts[4] == parts[5] == 4 and parts[None] is None
    assert {r.component_id for r in got if r.doc_id == 7} == {7} and parts[8] == 8
    assert simhash.near_fingerprints(frame(spark, [])).count() == 0


def test_simhash_fingerprint_is_sparks_xxhash64(spark):
    row = spark.sql("select xxhash64('alpha beta gamma delta') as h").first()
    assert simhash.fingerprint("Alpha  beta\ngamma delta".encode(), 4, 42) == row.h & (2**64 - 1)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_against_plain_loops(spark, longest):
    random.seed(3)
    vocabulary = ["alpha", "Beta", "gamma9", "déltà", "你好", "x"]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 40))) + random.choice(["", "!", "-a_b"])) for i in range(120)] + EDGES
    target = [(1, "alpha alpha beta. ALPHA"), (2, None), (3, "")]
    grams = lambda t: [" ".join(w[i : i + n]) for w in [[x for x in plain_words(t) if x]] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)), Counter(bucket(g) for _, x in target for g in grams(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10_000) / ((s[b] + 1.0) * (t.total() + 10_000))))
    rows = []
    for d, x in docs:
        g, weight = grams(x), sum(gain(bucket(y)) for y in grams(x))
        h = None if d is None else int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len([y for y in plain_words(x) if y])])
    able = sorted((r for r in rows if r[4] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: len(able) * 10 // 100])}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = resample.resample(frame(spark, docs), frame(spark, target), longest)
    assert [x for x, _ in got.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"] and {x for _, x in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=key)


def test_resampling_of_empty_tables_and_ties(spark):
    none = frame(spark, [])
    assert resample.resample(none, none).count() == 0
    same = [(5, "word " * 30)] * 40 + [(6, "word " * 30)] * 40
    ranks = sorted((r["rank"], r.doc_id) for r in resample.resample(frame(spark, same), none, percent=50).collect() if r["rank"])
    assert [r for r, _ in ranks] == list(range(1, 41)) and len({d for _, d in ranks}) == 1


def plain_runs(words, least=6, exponent=4):
    """Maximal stretches of every period, without those that a smaller period gives too."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - start
            if i > start and n >= max(least, exponent * q) and not any(all(words[x] == words[x + p] for x in range(start, start + n - p)) for p in range(1, q)):
                out.append((start, n, q))
            i += i == start
    return sorted(out)


def periodic(seed):
    r, out = random.Random(seed), []
    for _ in range(r.randint(0, 6)):
        unit = [r.randint(0, r.choice([0, 1, 2, 5])) for _ in range(r.randint(1, 5))]
        out += (unit * r.randint(1, 8))[: len(unit) * 8 - r.randint(0, 3)]
    return out


def test_runs_against_brute_force():
    for seed in range(1500):
        seq = periodic(seed)
        assert runs.runs_of(seq) == plain_runs(seq), seq
        hashes = np.array([(x + 3) * 0x9E3779B97F4A7C15 % 2**64 for x in seq], np.uint64)
        starts, ends = runs.stretches(hashes, np.zeros(len(seq), np.int64), 6, 4)
        assert [(a + x, y, z) for a, b in zip(starts, ends) for x, y, z in runs.runs_of(seq[a:b])] == plain_runs(seq), seq


@pytest.mark.parametrize("least,exponent", [(6, 4), (9, 3), (3, 3), (5, 5)])
def test_runs_with_other_bounds(least, exponent):
    for seed in range(400):
        assert runs.runs_of(periodic(seed), least, exponent) == plain_runs(periodic(seed), least, exponent)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, tmp_path):
    """The registered query on small texts with many runs, on edge cases, and on ids whose texts get planted repeats."""
    texts = [(100 + s, " ".join(f"W{x}" for x in periodic(s))) for s in range(150)] + [(d, t) for d, t in EDGES if d != 11]
    texts += [(2000 + i, " ".join(f"v{x}" for x in range(40 + i))) for i in range(60)]
    frame(spark, texts, False).selectExpr("*", "'en' as lang", "1 as w", "2 as runs").write.parquet(f"{tmp_path}/documents.parquet")
    rows = []
    for d, t in texts:
        words = planted(d, (t or "").encode().split())
        found = plain_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        rows.append((d, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[6:]
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key)
    assert sum(r[1] for r in rows) > 100


def test_runs_operator_output(spark):
    got = runs.periodic_runs(frame(spark, [(1, "a b  a b a b\na b tail"), (2, "no run here"), (3, None)]), keep=("doc_id", "weight")).sort("doc_id").collect()
    assert [(r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in got] == [(9, "a b tail", [(0, 8, 2)]), (3, "no run here", []), (0, "", [])]
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def test_language_mixtures(spark):
    """Texts of two languages halved: both are chosen, with shares near a half; others have one."""
    r = random.Random(8)
    word = {"aa": lambda: "".join(r.choices("abcde", k=6)), "bb": lambda: "".join(r.choices("vwxyz", k=6)), "cc": lambda: "".join(r.choices("jklmn", k=6))}
    make = lambda lang, n: " ".join(word[lang]() for _ in range(n))
    rows = [(i, make(lang, 200), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 15)] + [(100, make("aa", 300) + " " + make("bb", 300), None), (101, None, "aa"), (102, "123", "aa")]
    got = {x.doc_id: x for x in langid.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as mixture", "2 as score")).collect()}
    both = {m.lang: m.share for m in got[100].mixture}
    assert set(both) == {"aa", "bb"} and all(0.4 < s < 0.6 for s in both.values()) and got[100].lang_pred in both
    assert [(m.lang, m.share) for m in got[0].mixture] == [("aa", 1.0)] and got[101].mixture == [] and got[102].lang_pred == "und"
