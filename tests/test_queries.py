"""Registered queries against their oracle SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sigmaloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["i1_sense_registry", "j1_asof_definition", "j4_equation_groups", "e6_dependencies_conservative", "a1_dependency_audit", "n1_segment_events", "n7_score_formula", "r1_featured_two_stage", "g3_starter_formulas", "x4_symbol_keys", "m3_lexical_similarity",
         "e4_opened_candidates", "e6_dependencies_ocr", "q3_score_formulas", "q4_score_concepts", "c1_symbol_concepts", "m4_embedding_similarity", "r7_storyline_blueprint", "s5_dependency_payloads", "v6_concept_entries"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


def test_components(spark):
    from sigmaloom.operators.components import connected_components

    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 2)], "left long, right long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}


def test_depth_has_no_bound(spark):
    """A chain of 1,500 formulas over many blocks, a short chapter, and edges that skip blocks."""
    from sigmaloom.operators.graph import formula_depth

    n = 1500
    rows = [(f"a{i}", "a", i) for i in range(n)] + [(f"b{i}", "b", i) for i in range(5)]
    edges = [(f"a{i}", f"a{i - 1}") for i in range(1, n)] + [(f"a{i}", f"a{i - 700}") for i in range(700, n)] + [("b4", "b0"), ("b4", "b2"), ("b2", "b1"), ("b3", None)]
    formulas = spark.createDataFrame(rows, "formula_id string, chapter_id string, position long")
    want = {f"a{i}": i for i in range(n)} | {"b0": 0, "b1": 0, "b2": 1, "b3": 0, "b4": 2}
    found = spark.createDataFrame(edges, "dependent_id string, target_id string")
    assert {r.formula_id: r.depth for r in formula_depth(formulas, found, block=400).collect()} == want
    assert {r.formula_id: r.depth for r in formula_depth(formulas, found).collect()} == want
    with pytest.raises(ValueError, match="earlier"):
        formula_depth(formulas, spark.createDataFrame([("b0", "b1")], "dependent_id string, target_id string"))


def test_every_oracle_has_a_query():
    assert registry.ORACLES.keys() <= registry.QUERIES.keys()


def test_unclosed_formula_and_heading(spark):
    from sigmaloom.operators.segment import segment_events

    text = "# Chapter 2: Drift\ntext a\n$$\np_{t}=q\n$$\nwhere p is freq (2.1)\n$$ x=y $$ tail\n# Chapter 3: a $$ b\n$$\nnever closed"
    rows = segment_events(spark.createDataFrame([("b", 0, text)], "book_id string, page_index int, text string")).orderBy("line_index", "seq").collect()
    assert [(r.kind, r.text) for r in rows] == [("heading", "Drift"), ("text", "text a"), ("formula", "p_{t}=q"), ("text", "where p is freq (2.1)"), ("formula", "x=y"), ("text", "tail"), ("heading", "a $$ b")]


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_components_of_chains_and_hubs(spark, monkeypatch, most):
    """Whatever fits a task: a long chain, a hub and pairs, in shuffled order, against union-find."""
    import random

    from sigmaloom.operators import components

    monkeypatch.setattr(components, "TASK_LINKS", most)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 30)] + [(900 - i, 800 - i) for i in range(9)] + [(3, 3)]
    random.Random(1).shuffle(links)
    top = {x: x for pair in links for x in pair}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    want = {x: find(x) for x in top if x != 3}
    rows = spark.createDataFrame(links, "left long, right long").repartition(5)
    assert {r.id: r.component for r in components.connected_components(rows).collect()} == want
    text = rows.selectExpr("cast(left as string) as left", "cast(right as string) as right")
    if most > 7:
        assert {r.id: r.component for r in components.connected_components(text).collect()} == {str(k): min(str(x) for x, w in want.items() if w == v) for k, v in want.items()}
    assert components.connected_components(rows.limit(0)).count() == 0


def test_symbols_of_odd_formulas(spark):
    """Styles, operators, nested equality signs, calls on the left and pieces that stand alone."""
    from sigmaloom.operators import symbols

    texts = [r"\overline{W} = \dfrac{1}{n}", r"E(x) = \mu", r"\sigma(x,y) = r", r"a^{b} + b = c", r"\sum_{i=1}^{n} x_i = y", r"\operatorname{Var}(z) = 2", r"E(x | y) = m", r"\frac{\sqrt{u}}{v_{\text{a=b}}} = w", "", None]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "formula_id long, latex string")
    occ = symbols.symbol_occurrences(f)
    got, defined = {}, {}
    for r in symbols.defined_symbols(f, occ).collect():
        got.setdefault(r.formula_id, set()).add(r.symbol)
        if r.kind == "defined":
            defined.setdefault(r.formula_id, set()).add(r.symbol)
    assert got == {0: {r"\overline{W}", "n"}, 1: {"x", r"\mu"}, 2: {r"\sigma", "x", "y", "r"}, 3: {"a^{b}", "b", "c"}, 4: {"x_i", "y"}, 5: {"z"}, 6: {"x", "y", "m"}, 7: {"u", "w"} | (got[7] - {"u", "w"})}
    assert defined[0] == {r"\overline{W}"} and defined[1] == {"x"} and 2 not in defined and defined[3] == {"a^{b}", "b"} and defined[4] == {"x_i"} and 6 not in defined and "w" not in defined[7]
    left = {(r.formula_id, r.symbol) for r in symbols.fragment_suppression(occ, f).collect()}
    assert (2, r"\sigma") not in left and (3, "b") in left
    keys = symbols.symbol_role(symbols.symbol_keys(spark.createDataFrame([(r"\xi",), (r"\varepsilon",), ("x_{i}",)], "symbol string"))).collect()
    assert {r.symbol: r.role for r in keys} == {r"\xi": "variable", r"\varepsilon": "variable", "x_{i}": "parameter"}


def test_group_edges_come_first_in_ocr_mode(spark):
    """A formula that cites its own group's sibling gets the group edge in one mode, the cited one in the other."""
    from sigmaloom.operators import resolve

    f = spark.createDataFrame([("f1a", "1.1a", "c1", 1, 0, "", 90), ("f1b", "1.1b", "c1", 1, 1, "see Equation 1.1a", 90)], "formula_id string, raw_id string, chapter_id string, chapter int, position long, context_text string, conf long")
    uses = spark.createDataFrame([], "formula_id string, chapter_id string, chapter int, position long, symbol string, canonical string, family string, ordinal long")
    senses = spark.createDataFrame([], "sense_id string, symbol string, canonical string, family string, formula_id string, chapter_id string, chapter int, position long")
    for mode, want in (("ocr", "compound_group"), ("conservative", "explicit_reference")):
        edges = [r for r in resolve.build_dependencies(f, uses, senses, mode)[0].collect() if r.dependent_id == "f1b"]
        assert [r.evidence for r in edges] == [want]


def test_query_plan_and_scores(spark):
    """Rules with their skips, numbers by prefix, ids, and words that are no prefix of another number."""
    from sigmaloom.operators import search

    plan = search.query_plan(spark.createDataFrame([(1, "有效群体大小"), (2, "公式 2.1"), (4, "formula_2.1a"), (5, "2"), (6, None)], "query_id long, text string"))
    rows = plan.collect()
    of = lambda i: {r.variant for r in rows if r.query_id == i}
    assert of(1) == {"有效群体大小", "effective population size", "genetic effective size", "effective size"}
    assert of(2) == {"公式 2.1", "2.1", "formula 2.1", "formula2.1", "公式2.1"} and of(4) == {"formula_2.1a"} and of(6) == set()
    assert {"chapter 2", "c2", "第2章", "formula 2"} <= of(5) and {r.number for r in rows if r.query_id == 5} == {"2"}
    f = [("formula_2.1a", "2.1a", "Formula 2.1a", "x y", "the effective population size"), ("formula_2.1", "2.1", "Formula 2.1", "z", "alpha"), ("formula_21.1a", "21.1a", "Formula 21.1a", "w", "drift")]
    docs = search.search_documents(spark.createDataFrame(f, "formula_id string, raw_id string, label string, latex string, context_text string"))
    got = {(r.query_id, r.id): r.score for r in search.score_formulas(plan, docs).collect()}
    assert got == {(1, "formula_2.1a"): 500, (2, "formula_2.1"): 1000, (2, "formula_2.1a"): 830, (4, "formula_2.1a"): 900, (5, "formula_2.1"): 920, (5, "formula_2.1a"): 920} | {(2, "formula_21.1a"): 780, (5, "formula_21.1a"): 780}
    assert {r.mapped for r in rows if r.query_id == 1} == {True} and not any(r.mapped for r in rows if r.query_id != 1)


def test_sanitized_at_any_depth(spark):
    from sigmaloom.sources.files import sanitized

    d = spark.sql("select 1 as id, 'x' as review_notes, named_struct('reviewed_at', 1, 'keep', array(named_struct('teaching_move', 1, 'n', 2))) as a, array(array(named_struct('source_sentence', 's', 'z', 3))) as b, cast(null as struct<reviewed_by:string,q:int>) as c")
    assert sanitized(d).toJSON().collect() == ['{"id":1,"a":{"keep":[{"n":2}]},"b":[[{"z":3}]]}']
