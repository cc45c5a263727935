"""Findings of round 3: results that depended on the order of rows, and what moves."""

import datetime

import pytest


def test_learned_state_takes_the_earliest(spark, tmp_path):
    """Events that come before earlier ones, in one batch and in later ones."""
    from sigmaloom.streaming import intake

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    schema = "user_id long, chapter_id string, formula_id string, ts timestamp"
    for days in ([9, 8, 5], [30, 2, 7], [40]):
        spark.createDataFrame([(1, "chapter1", "f", day(n)) for n in days], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = intake.stream_learned_state(spark, stream, f"{tmp_path}/seen", f"{tmp_path}/checkpoint").collect()
    assert [(r.user_id, r.chapter_id, r.formula_id, r.first_ts) for r in got] == [(1, "chapter1", "f", day(2))]


def test_a_cluster_is_one_large_group_not_one_a_table(spark, monkeypatch):
    """Near copies share many keys of the 64 tables; their rows for the large groups grow with the copies, not with copies times tables."""
    from sigmaloom.llm import minhash

    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words[:i], f"own{i}", *words[i + 1 :]])) for i in range(60)], "doc_id long, text string")
    seen, links = [], minhash.large_group_links
    monkeypatch.setattr(minhash, "large_group_links", lambda large, *rest: seen.append((large.count(), large.select("id").distinct().count())) or links(large, *rest))
    got = minhash.near_duplicates(docs, 3, (85, 100)).collect()
    assert {r.component_id for r in got} == {0}
    ((rows, ids),) = seen
    assert ids >= 50 and rows <= 20 * ids


def test_entries_are_read_not_moved(spark):
    """The builder's entries are marked where the uses are looked up; to read them shuffles nothing."""
    from sigmaloom.plans import registry, resolve_queries
    from tests.test_corpus_faults import FOLDER, shuffled

    assert "e4_ambiguous_assembly" in registry.QUERIES
    entries = resolve_queries.built(spark, FOLDER)[2]
    assert entries.count() > 0 and shuffled(spark, entries) == 0


def test_guidance_is_written_out_not_moved(spark):
    """Users without a first prerequisite, with some or all of them, and without an id, against a plain loop; fewer rows move than are returned."""
    from sigmaloom.operators import graph
    from tests.test_corpus_faults import shuffled

    ids = [f"f{i:02}" for i in range(40)]
    edges = [(ids[i], ids[j]) for i in range(2, 40) for j in {0, i // 2, i - 1}]
    learned = [(u, "c", f"f{i:02}") for u in range(200) for i in range(u % 4 + 1) if u % 25 == 1 or u % 50 == 2] + [(u, "c", "other") for u in [*range(200), None]]
    known = {}
    for u, _, f in learned:
        known.setdefault(u, set()).add(f)
    want = {}
    for u, have in known.items():
        for f in ids:
            if left := [t for d, t in edges if d == f and t not in have]:
                want[u, f] = min(left)
    frames = (
        spark.createDataFrame(edges, "dependent_id string, target_id string"),
        spark.createDataFrame([(f, "c", i) for i, f in enumerate(ids)], "formula_id string, chapter_id string, position long"),
        spark.createDataFrame(learned, "user_id long, chapter_id string, formula_id string"),
    )
    df = graph.locked_guidance(*frames)
    assert {(r.user_id, r.formula_id): r.blocker_id for r in df.collect()} == want
    assert shuffled(spark, graph.locked_guidance(*frames)) < len(want)


def test_concepts_are_scored_by_short_plans(spark):
    """Every form of a concept's texts is made once; plans that hold the folding tables many times fill the driver."""
    from sigmaloom.operators import search
    from tests.test_search import CONCEPTS, plan_of

    def plans():
        it, found = spark._jsparkSession.sharedState().statusStore().executionsList().iterator(), {}
        while it.hasNext():
            x = it.next()
            found[x.executionId()] = x.physicalPlanDescription()
        return found

    plan, before = plan_of(spark)[0], plans()
    search.score_concepts(plan, spark.createDataFrame(CONCEPTS, "id string, title string, symbol string, label string, section string, context string, aliases array<string>")).write.format("noop").mode("overwrite").save()
    made = [text for k, text in plans().items() if k not in before]
    assert made and max(map(len, made)) < 150_000


@pytest.mark.parametrize("values", [1 << 20, 200])
def test_all_similar_vectors_are_found(spark, monkeypatch, values):
    """The registered query against its SQL at a low threshold, with a chapter in one block and in many; it gives more than the pairs at 0.88."""
    import os

    import duckdb

    from sigmaloom.operators import merge
    from sigmaloom.plans import registry
    from tests.test_corpus_faults import FOLDER, assert_same

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    monkeypatch.setattr(merge, "BLOCK_VALUES", values * 8)
    monkeypatch.setattr(merge, "STRIP", values)
    assert_same(spark, con, FOLDER, "m4_embedding_similarity")
    low = "select count(*) from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3"
    own = registry.QUERIES["m4_embedding_similarity"](spark, FOLDER).filter("left % 2 = 0 and right % 2 = 0").count()
    assert own == con.execute(low).fetchone()[0] > 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_family_review_does_not_move_uses(spark, monkeypatch, block):
    """The review of families against its SQL over any number of blocks; the formulas move, the uses do not."""
    import os

    import duckdb

    from sigmaloom.operators import resolve
    from sigmaloom.plans import registry
    from tests.test_corpus_faults import FOLDER, assert_same, shuffled

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    monkeypatch.setattr(resolve, "BLOCK", block)
    assert_same(spark, con, FOLDER, "j3_family_review")
    if block == 4096:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
        try:
            moved = shuffled(spark, registry.QUERIES["j3_family_review"](spark, FOLDER))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert moved < registry.QUERIES["j7_use_filter"](spark, FOLDER).count() / 2


@pytest.mark.parametrize("name", ["e4_ambiguous_assembly", "j3_family_review"])
def test_blocks_become_values_in_slices(spark, monkeypatch, name):
    """The entries of a formula and the review's rows do not depend on how the uses of a block are cut."""
    from sigmaloom.operators import resolve
    from sigmaloom.plans import registry
    from tests.test_corpus_faults import FOLDER

    rows = lambda: sorted(map(repr, registry.QUERIES[name](spark, FOLDER).collect()))
    want = rows()
    monkeypatch.setattr(resolve, "SLICE", 50)
    assert want and rows() == want


def test_prerequisites_are_found_once(spark):
    """What is read twice is written: no lookup is left in the plans of the queries that read it, and no use moves to be held against it."""
    from sigmaloom.plans import registry, view_queries
    from tests.test_corpus_faults import FOLDER, shuffled

    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for name in ("c11_nested_references", "c12_rule_concept_graph"):
        assert "CoGroups" not in plan(registry.QUERIES[name](spark, FOLDER))
    introduced = view_queries.refs(spark, FOLDER)[3]
    uses = registry.QUERIES["j7_use_filter"](spark, FOLDER).count()
    assert introduced.count() > 0 and shuffled(spark, introduced) < uses / 10


def test_candidates_of_earlier_chapters_are_all_listed(spark):
    """The pairs of classes and the classes of uses give every pair of a use and a sense of an earlier chapter, in a plain loop."""
    import random

    from pyspark.sql import functions as F

    from sigmaloom.operators import resolve

    r = random.Random(5)
    names = ["alpha", "alphas", "alphabet", "alpine", "beta", "betas", "bet"]
    canonical = lambda s: s.removesuffix("s")
    keys = lambda s: (s, canonical(s), s[:4])
    senses = [(f"f{i}::{s}", *keys(s), f"f{i}", f"chapter{c}", c, i) for i in range(40) for c in [i % 5 + 1] for s in r.sample(names, r.randint(1, 3))]
    uses = [(f"u{i}", f"chapter{c}", c, i, *keys(s), o) for i in range(40) for c in [i % 6 + 1] for o, s in enumerate(r.sample(names, 3))]
    want = set()
    for f, _, chapter, _, symbol, can, fam, _ in uses:
        for _, s, s_can, s_fam, target, _, at, _ in senses:
            if at < chapter and s_can == can:
                want.add((f, symbol, target, "exact", max(40, 78 - 3 * (chapter - at))))
            if at < chapter and s_fam == fam and s != symbol:
                want.add((f, symbol, target, "family", max(30, 62 - 4 * (chapter - at))))
    s = spark.createDataFrame(senses, "sense_id string, symbol string, canonical string, family string, formula_id string, chapter_id string, chapter int, position long")
    u = spark.createDataFrame(uses, "formula_id string, chapter_id string, chapter int, position long, symbol string, canonical string, family string, ordinal long")
    pairs, classes = resolve.candidate_pairs(u, s), resolve.earlier_chapter_candidates(u, s)
    same = "chapter = c and (match_type = 'exact' and key = canonical or match_type = 'family' and key = family and via_symbol != symbol)"
    got = classes.join(pairs.withColumnRenamed("chapter", "c"), F.expr(same)).select("formula_id", "symbol", "target_id", "match_type", "conf").collect()
    assert {tuple(x) for x in got} == want
    listed = {(x.formula_id, x.symbol): (x.n_exact, x.n_kin) for x in classes.collect()}
    assert listed == {k: tuple(sum(w[:2] == k and w[3] == m for w in want) for m in ("exact", "family")) for k in {w[:2] for w in want}}


def test_answers_move_with_their_formula(spark):
    """Answers one by one or in lists give the same; the query moves lists, not uses."""
    from pyspark.sql import functions as F

    from sigmaloom.operators import review
    from sigmaloom.plans import registry
    from tests.test_corpus_faults import FOLDER, shuffled

    formulas = spark.createDataFrame([("a", "c1", 0), ("b", "c1", 1), ("c", "c2", 2), ("d", None, 3)], "formula_id string, chapter_id string, position long")
    rows = [("b", "x", "a", 40), ("b", "y", "a", 39), ("b", "z", "b", 90), ("a", "x", "b", 90), ("c", "x", "a", 90), ("c", "y", None, 90), ("d", "x", "a", 90), ("b", "v", "gone", 90), ("gone", "x", "a", 90), ("b", "w", "a", None)]
    plain = spark.createDataFrame(rows, "formula_id string, symbol string, target_id string, conf long")
    lists = plain.groupBy("formula_id", "target_id").agg(F.collect_list(F.struct("symbol", "conf")).alias("answers"))
    for results in (plain, lists):
        edges, ambiguous = review.sense_to_edges(results, formulas)
        assert [tuple(r) for r in edges.select("dependent_id", "target_id", "via_symbol").collect()] == [("b", "a", "x")]
        assert sorted((r.formula_id, r.symbol) for r in ambiguous.collect()) == sorted((f, s) for f, s, *_ in rows if f != "gone" and (f, s) != ("b", "x"))
    uses = registry.QUERIES["j7_use_filter"](spark, FOLDER).count()
    for name in ("v7_sense_edges", "v7_sense_ambiguous"):
        assert shuffled(spark, registry.QUERIES[name](spark, FOLDER)) < uses / 10


def test_notes_and_stories_are_read_where_formulas_are(spark):
    """Notes in lists give what single ones give, and move nothing; a story's points are added up without moving what it meets."""
    from pyspark.sql import functions as F

    from sigmaloom.operators import graph
    from sigmaloom.plans import registry
    from tests.test_corpus_faults import FOLDER, shuffled

    rows = [("f", "accent", 3, "b"), ("f", "acronym", 1, "b"), ("f", "plain", 0, "z"), ("f", "accent", 1, "a"), ("f", "accent", 5, "c"), ("f", "acronym", 6, "d"), ("f", "accent", 7, "e"), ("g", "plain", 0, "z")]
    single = spark.createDataFrame(rows, "formula_id string, kind string, rank long, note string")
    lists = single.groupBy("formula_id").agg(F.collect_list(F.struct("kind", "rank", "note")).alias("notes"))
    for annotations in (single, lists):
        assert sorted(map(tuple, graph.key_concepts(annotations).collect())) == [("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c"), ("f", 3, "d")]
    assert shuffled(spark, registry.QUERIES["g10_key_concepts"](spark, FOLDER)) == 0
    plan = registry.QUERIES["r7_storyline_blueprint"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(array(symbol" not in plan  # three keys of every occurrence


def test_pages_move_whole(spark):
    """Headings carry over the pages of a book, also of pages without a book; pages move, not their lines."""
    from sigmaloom.operators import segment
    from tests.test_corpus_faults import shuffled

    rows = []
    for book in ("a", None):
        rows += [(book, 0, "one\n# Chapter 3: Three\ntwo"), (book, 1, "three\n## 4 Four\nfour"), (book, 2, "five $$x$$ six"), (book, 3, None), (book, 4, "seven\n$$a\nb$$\neight")]
    pages = spark.createDataFrame(rows, "book_id string, page_index long, text string")
    got = segment.segment_events(pages).orderBy("book_id", "page_index", "line_index", "seq").collect()
    mine = [(r.page_index, r.kind, r.text, r.section, r.subsection, r.chapter_id) for r in got if r.book_id == "a"]
    at = [("Chapter 1", "", "chapter1"), ("Three", "", "chapter3"), ("Three", "Four", "chapter3")]
    assert mine == [
        (0, "text", "one", *at[0]), (0, "heading", "Three", *at[1]), (0, "text", "two", *at[1]), (1, "text", "three", *at[1]), (1, "heading", "Four", *at[2]), (1, "text", "four", *at[2]),
        (2, "text", "five", *at[2]), (2, "formula", "x", *at[2]), (2, "text", "six", *at[2]), (4, "text", "seven", *at[2]), (4, "formula", "a\nb", *at[2]), (4, "text", "eight", *at[2]),
    ]
    assert [(r.page_index, r.kind, r.text, r.section, r.subsection, r.chapter_id) for r in got if r.book_id is None] == mine
    contexts = {(r.book_id, r.text): (r.before_text, r.after_text) for r in segment.attach_context(segment.segment_events(pages)).collect()}
    assert contexts == {("a", "x"): ("three four five", "six seven"), ("a", "a\nb"): ("six seven", "eight"), (None, "x"): ("", ""), (None, "a\nb"): ("", "")}
    many = spark.createDataFrame([("a", i, "\n".join(["word"] * 50)) for i in range(40)], "book_id string, page_index long, text string")
    assert shuffled(spark, segment.segment_events(many)) < 2000


def test_whole_symbols_are_read_in_their_formula(spark):
    """Whole symbols and roles read from a formula's list: as the joins give them, without moving an occurrence."""
    from sigmaloom.operators import symbols
    from tests.test_corpus_faults import shuffled

    rows = [("a", r"x_{1} = x + y"), ("b", r"\sigma(x, y) = r"), ("c", r"E(x_1, y) = z"), ("d", r"E(x) = \mu"), ("e", "u + v"), ("f", ""), ("g", None), ("h", r"\sigma = x_{2} + x"), ("i", r"\sigma_{1} = \sigma(a, b)")]
    f = spark.createDataFrame(rows * 20, "formula_id string, latex string").distinct().localCheckpoint()
    occ = symbols.symbol_occurrences(f)
    joined = symbols.fragment_suppression(occ, f)
    whole = symbols.whole_symbols(f)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, joined.select("formula_id", "symbol", "ordinal").collect()))
    kind = {(r.formula_id, r.symbol): r.kind for r in symbols.defined_symbols(f, occ).collect()}
    first, want = set(), []
    for i, s, _ in sorted(map(tuple, whole.collect()), key=lambda r: (r[0], r[2])):
        defined = kind[i, s] == "defined" and i not in first
        first |= {i} if defined else set()
        want.append((i, s, "defined" if defined else "used"))
    roles = symbols.concept_symbols(f)
    assert sorted(map(tuple, roles.collect())) == sorted(want)
    assert shuffled(spark, whole) == 0 and shuffled(spark, roles) == 0


def test_a_phrase_is_sought_once(spark):
    """Each pattern of a name is in the plan once, not once for each test of what it finds; sentences move only where they tell symbols apart."""
    from pyspark.sql import functions as F

    from sigmaloom.operators import concepts

    d = spark.createDataFrame([("The mean wait is computed here.", "w"), ("nothing", "w"), (None, "w")], "context string, base string").select(concepts.named_phrase(F.col("context"), F.col("base")).alias("name"))
    assert [r.name for r in d.collect()] == ["Mean Wait", None, None]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 3
