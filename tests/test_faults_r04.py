"""Findings of round 4: entries with their candidates, and what moves."""

import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


def assert_equals_sql(spark, con, name):
    from sigmaloom.plans import registry

    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = con.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns and want
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_entries_list_their_candidates(spark, con):
    """Every entry holds the whole list that it counts."""
    from sigmaloom.plans import registry

    assert_equals_sql(spark, con, "e4_ambiguous_assembly")
    rows = registry.QUERIES["e4_ambiguous_assembly"](spark, FOLDER).collect()
    assert all(len(r.candidates.split(",")) == r.n_candidates for r in rows)
    assert {r.scope for r in rows} == {"chapter", "earlier"} and max(r.n_candidates for r in rows) > 3


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("mode", ["conservative", "ocr"])
def test_packed_uses_give_the_same(spark, monkeypatch, mode, block):
    """Lookups of formulas as arrays, cut anywhere, against those of rows of uses; and no use is a row before it is looked up."""
    from pyspark.sql import functions as F

    from sigmaloom.operators import resolve
    from sigmaloom.plans import adapter

    monkeypatch.setattr(resolve, "BLOCK", block)
    monkeypatch.setattr(resolve, "TEXT", 2000)
    formulas = adapter.corpus(spark, FOLDER).withColumn("context_text", F.concat("context_text", F.lit(" and where "), F.coalesce(F.get("words", F.lit(3)), F.lit("z")), F.lit(" is told.")))
    stop = [] if mode == "ocr" else adapter.STOP
    uses, senses = adapter.looked_up(formulas, stop, mode)
    far = formulas if mode == "conservative" else None
    resolved = resolve.resolved_uses(uses, senses, far)
    rows = lambda d, columns: sorted(map(repr, d.select(*columns).collect()))
    same = adapter.packed(formulas, stop, mode)
    got = resolve.packed_lookups(*same, mode, far)
    assert "Generate posexplode(words" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got, got.columns) == rows(resolve.needed_uses(resolved, mode), got.columns)
    edges = resolve.packed_lookups(*same, f"{mode} edges" if mode == "ocr" else "edges")
    bare = resolved.drop("scope", "entry", "n_candidates")
    want = resolve.needed_uses(bare, mode)
    want = want.filter("target_id is not null or told") if mode == "ocr" else want
    assert rows(edges, edges.columns) == rows(want, edges.columns)
    if mode == "ocr":
        links = resolve.packed_lookups(*same, "links")
        first = bare.filter("target_id is not null").groupBy("formula_id", "target_id").agg(F.min_by(F.struct("symbol", "ordinal", "match_type"), "ordinal").alias("x")).select("formula_id", "target_id", "x.*")
        assert rows(links, links.columns) == rows(first, links.columns)


def test_guidance_meets_classes_of_users(spark):
    """Users who have learned the same meet a formula once, in lists of a bounded length; what moves does not grow with users times formulas."""
    from sigmaloom.operators import graph
    from tests.test_corpus_faults import shuffled

    ids = [f"f{i:02}" for i in range(60)]
    formulas = spark.createDataFrame([(f, "c", i) for i, f in enumerate(ids)], "formula_id string, chapter_id string, position long")
    edges = [(ids[i], ids[j]) for i in range(1, 60) for j in {0, i // 2, i - 1}]
    learned = [(u, "c", ids[i]) for u in range(300) for i in range(3) if u % 8 >> i & 1] + [(u, "c", "other") for u in range(300)]
    got = graph.locked_guidance(spark.createDataFrame(edges, "dependent_id string, target_id string"), formulas, spark.createDataFrame(learned, "user_id long, chapter_id string, formula_id string"))
    have = {u: {f for x, _, f in learned if x == u} for u in range(300)}
    want = {(u, f, min(left)) for u in have for f in ids if (left := [t for d, t in edges if d == f and t not in have[u]])}
    rows = got.collect()
    assert len(rows) == len(want) > 15_000 and {(r.user_id, r.formula_id, r.blocker_id) for r in rows} == want
    assert shuffled(spark, got) < 2500


def test_a_long_chapter_is_several_parts(spark, con, monkeypatch, tmp_path):
    """No row of a payload holds a whole chapter, whatever its length; read again, all formulas and edges are there."""
    from sigmaloom.sources import files

    monkeypatch.setattr(files, "PART", 3)
    formulas = spark.createDataFrame([(f"{c}{i}", c, i, "x") for c in ("a", "b") for i in range(10)], "formula_id string, chapter_id string, position long, latex string")
    edges = [(f"a{i}", f"a{j}", "exact_match", 90) for i in range(10) for j in range(i)]
    found = files.chapter_payloads(formulas, spark.createDataFrame(edges, "dependent_id string, target_id string, evidence string, conf long"))
    rows = found.collect()
    assert max(len(r.formulas) for r in rows) == 3 and len(rows) == 8 and all(r.dependencies == [] for r in rows if r.chapter_id == "b")
    for c in ("a", "b"):
        assert [f.formula_id for r in sorted(rows, key=lambda r: r.part) if r.chapter_id == c for f in r.formulas] == [f"{c}{i}" for i in range(10)]
    files.write_payloads(found, f"{tmp_path}/payloads")
    f, e = files.read_dependency_payloads(spark.read.parquet(f"{tmp_path}/payloads"))
    assert f.count() == 20 and sorted(tuple(r) for r in e.select("dependent_id", "target_id", "evidence", "conf").collect()) == sorted(edges)
    assert_equals_sql(spark, con, "s8_chapter_payloads")


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_pieces_are_found_in_arrays_or_listed(spark, monkeypatch, most):
    """Variants of any length meet the fields that hold them, whether the tasks carry their pieces or not; frequent pieces are counted, not listed."""
    from sigmaloom.operators import search
    from tests.test_corpus_faults import shuffled

    monkeypatch.setattr(search, "PIECES", most)
    monkeypatch.setattr(search, "TEXTS", 3)
    texts = ["the theme of them", "a b, 1,2 x-y", "Äther 等位基因 ﬁxed `q`", r"\sigma\bar{x} the", "", "𝔘nit the 𝔘nit", "theta  \t theorem", "ab"] + ["the end"] * 50
    variants = ["the", "them", "eorem", "等位", "等位基因", "fixed", "'q'", "sigma", "x bar", "b", "ab", "1.2", "nit the", "zzz", "𝔘nit", "th", "y"]
    plan = spark.createDataFrame(list(enumerate(variants)), "query_id long, variant string")
    fields = spark.createDataFrame([(i, "text", 0, 2, t) for i, t in enumerate(texts)], "id long, field string, part int, least int, text string").filter("text != ''")
    got = {(r.query_id, r.id) for r in search.field_matches(plan, fields).filter("holds").collect()}
    forms = spark.createDataFrame([(t,) for t in texts + variants], "t string").select("t", search.compact("t").alias("c"), search.loose("t").alias("l"), search.normal(search.latex_words("t")).alias("n")).collect()
    form, apart = {r.t: r for r in forms}, __import__("re").compile(search.APART)
    want = set()
    for q, v in enumerate(variants):
        for i, t in enumerate(texts):
            for w, x in ((form[v].c, form[t].c), (form[v].l, form[t].l)):
                short = len(w) <= 2 and w.isascii() and w.isalnum()
                words = apart.split(form[t].n) + apart.split(t.lower())
                if w and len(w) >= 2 and t and (w in (form[t].c, form[t].l, *words) if short else w in x):
                    want.add((q, i))
    assert got == want and len(want) > 60
    if most > 5:
        assert shuffled(spark, search.field_matches(plan, fields)) < 400


def test_audited_entries_do_not_move(spark):
    """Entries that know their chapter are counted where they are."""
    from sigmaloom.operators import audit
    from tests.test_corpus_faults import shuffled

    formulas = spark.createDataFrame([("f", "c")], "formula_id string, chapter_id string")
    edges = spark.createDataFrame([], "dependent_id string, edge_status string, evidence string")
    entries = spark.createDataFrame([("f", "c")] * 500, "dependent_id string, chapter_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        found = audit.dependency_audit(formulas, edges, entries)
        assert found.first().ambiguous == 500 and shuffled(spark, found) < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
