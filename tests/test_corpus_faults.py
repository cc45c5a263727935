"""Queries against their oracle SQL on tables with odd texts: few words, none, null."""

import os

import duckdb
import pytest

from sigmaloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["", None, "1 2 3", "\n$$ $$ -- \n", "ab cd", "Alpha", "Alpha beta", "Alpha betas gamma", "gamma deltas alpha Alpha", "İstanbul Kelvin"]
NAMES = ["n10_formula_list", "n3_formula_number", "n9_mention_positions", "s3_structured_blocks", "v8_cache_plan", "n11_keywords_chapter", "n11_keywords_search", "r9_search_index", "q1_search_documents",
         "g1_neighbours_dependents", "g1_neighbours_prerequisites", "g2_expand_step", "s8_chapter_payloads", "e1_edge_attributes"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def assert_same(spark, con, folder, name):
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """(folder, connection) of the smallest tables, whose documents are 80 with odd texts among others."""
    folder, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for f in os.listdir(FOLDER):
        if f != "documents.parquet":
            os.symlink(f"{FOLDER}/{f}", f"{folder}/{f}")
    con.execute("create table odd (i bigint, t varchar)")
    con.executemany("insert into odd values (?, ?)", list(enumerate(TEXTS)))
    con.execute(f"""copy (select d.doc_id, case when d.doc_id % 3 = 0 then odd.t else left(d.text, 300) end as text, lang, 'src' || (d.doc_id % 3 * d.doc_id % 2) as source, n_chars
      from '{FOLDER}/documents.parquet' d join odd on odd.i = d.doc_id // 3 % {len(TEXTS)} where d.doc_id < (select min(doc_id) from '{FOLDER}/documents.parquet') + 80 order by d.doc_id) to '{folder}/documents.parquet'""")
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_texts_without_words(spark, odd, name):
    assert_same(spark, odd[1], odd[0], name)


def shuffled(spark, df):
    """Records that the stages of a run of ``df`` write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())

    def read():
        it, found = stages().iterator(), {}
        while it.hasNext():
            s = it.next()
            found[s.stageId()] = s.shuffleWriteRecords()
        return found

    before = read()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in read().items() if k not in before)


def test_uses_do_not_move_by_key(spark):
    """A use's lookups of the chapter move the formulas as arrays and the senses, not the uses."""
    from sigmaloom.operators import resolve
    from sigmaloom.plans.resolve_queries import inputs

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        _, uses, senses = inputs(spark, FOLDER)
        moved = shuffled(spark, resolve.resolved_uses(uses, senses))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < uses.count() / 2


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_lookups_over_blocks(spark, monkeypatch, block):
    """Counts and last definitions over any number of blocks, uses after the last sense and chapters without one, against a plain loop."""
    from sigmaloom.operators import resolve

    monkeypatch.setattr(resolve, "BLOCK", block)
    sense = "sense_id string, symbol string, canonical string, family string, formula_id string, chapter_id string, chapter int, position long"
    use = "formula_id string, chapter_id string, chapter int, position long, symbol string, canonical string, family string, ordinal long"
    key = lambda s: (s.rstrip("s"), s[:1])
    senses = [(f"{c}{p}::{s}", s, *key(s), f"{c}{p}", c, 1, p) for c in "ab" for p, s in enumerate(["x", "ys", "y", "yt", "x", "xs", "x"])]
    uses = [(f"{c}{p}", c, 1, p, s, *key(s), o) for c in "abc" for p in range(12) for o, s in enumerate(["x", "xs", "y", "ys", "yt", "z", "yz"])]
    got = resolve.resolved_uses(spark.createDataFrame(uses, use), spark.createDataFrame(senses, sense)).collect()
    want = {}
    for f, c, _, p, s, can, fam, _o in uses:
        early = [x for x in senses if x[5] == c and x[7] < p]
        exact, canon, kin = [x for x in early if x[1] == s], [x for x in early if x[2] == can], [x for x in early if x[3] == fam]
        hit = (exact or canon or [None])[-1]
        want[f, s] = (hit and hit[4], hit and hit[0], "exact" if exact else "canonical" if canon else None, len(kin), kin[-1][4] if kin else None)
    assert len(got) == len(want) and {(r.formula_id, r.symbol): (r.target_id, r.sense_id, r.match_type, r.n_family, r.last_family) for r in got} == want
