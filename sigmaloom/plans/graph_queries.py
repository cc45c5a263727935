"""Queries on the graph and its rankings, over the ``ocr`` builder's edges: earlier formulas of the same chapter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.work import written
from ..operators import graph, rank, resolve
from .adapter import CORPUS, corpus, occurrences, packed, table, vocabulary
from .registry import query
from .resolve_queries import J1, J4, J5

GRAPH = ",".join([CORPUS, J1, J4, J5]) + """,
found as (
  select dependent_id, target_id, '' as via_symbol, 'explicit_reference' as evidence, 94 as conf, 0 as stage, ordinal from j5o
  union all select dependent_id, target_id, '', 'compound_group', 86, 1, ordinal from j4b where prior
  union all select j1.formula_id, j1.target_id, j1.symbol, case match_type when 'exact' then 'exact_match' else 'canonical_match' end, case match_type when 'exact' then 90 else 82 end, 2, u.ordinal from j1 join uses u on u.formula_id = j1.formula_id and u.symbol = j1.symbol),
ge as materialized (select dependent_id, target_id, via_symbol, evidence, conf from (select *, row_number() over (partition by dependent_id, target_id order by stage, ordinal, via_symbol) as r from found) where r = 1)
"""
DEPTH = """
walk as (select formula_id, 0 as depth from corpus union select ge.dependent_id, walk.depth + 1 from walk join ge on ge.target_id = walk.formula_id),
dep as (select formula_id, max(depth) as depth from walk group by all)
"""
DEGREES = """
deg as (select c.*, coalesce(i.n, 0) as n_in, coalesce(o.n, 0) as n_out from corpus c left join (select target_id, count(*) as n from ge group by all) i on i.target_id = c.formula_id left join (select dependent_id, count(*) as n from ge group by all) o on o.dependent_id = c.formula_id)
"""
SCORES = "sc as (select d.formula_id, greatest(0, 8 - depth) + n_out + 3 * n_in as score from deg d join dep on dep.formula_id = d.formula_id)"
SPINE = """
bb as (select chapter_id, row_number() over (partition by chapter_id order by first nulls last, score desc, depth, position, formula_id) - 1 as ordinal, formula_id from (
  select *, case when depth = 0 and roots <= 7 then roots when anyroot = 0 and place <= 4 then place end as first from (
    select c.formula_id, c.chapter_id, c.position, depth, score, sum((depth = 0)::int) over (partition by c.chapter_id order by c.position) as roots, max((depth = 0)::int) over (partition by c.chapter_id) as anyroot, row_number() over (partition by c.chapter_id order by c.position) as place
    from corpus c join dep on dep.formula_id = c.formula_id join sc on sc.formula_id = c.formula_id)) qualify row_number() over (partition by chapter_id order by first nulls last, score desc, depth, position, formula_id) <= 14)
"""


def edges_of(spark, folder):
    """(formulas, occ, uses, edges); the edges are written once, as most queries read them more than once."""
    formulas, occ, _, uses = vocabulary(spark, folder)
    found = resolve.explicit_reference_join(formulas, "ocr").union(resolve.equation_group_join(formulas, "prior")).union(resolve.symbol_edges(resolve.packed_lookups(*packed(formulas), "links"), "ocr"))
    return formulas, occ, uses, written(resolve.edge_dedupe(found), "edges")


def learned_of(spark, folder):
    """(user_id, chapter_id, formula_id, ts): what users did, as formulas of the corpus."""
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    number = F.expr("concat(k % 20 + 1, '.', k div 2 + 1, case when k % 2 = 0 then 'a' else 'b' end)")
    return e.select("event_id", "user_id", "ts", F.expr("concat('chapter', k % 20 + 1)").alias("chapter_id"), F.concat(F.lit("formula_"), number).alias("formula_id"), number.alias("raw_id"))


LEARNED = """
learned as (select event_id, user_id, ts, 'chapter' || (k % 20 + 1) as chapter_id, (k % 20 + 1) || '.' || (k // 2 + 1) || (case when k % 2 = 0 then 'a' else 'b' end) as raw_id,
  'formula_' || (k % 20 + 1) || '.' || (k // 2 + 1) || (case when k % 2 = 0 then 'a' else 'b' end) as formula_id from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))
"""


@query("e7_formula_depth", f"with recursive {GRAPH}, {DEPTH} select formula_id, cast(depth as bigint) as depth from dep")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return graph.formula_depth(formulas, edges)


for _d, _s in (("prerequisites", "dependent_id as formula_id, target_id as neighbour_id"), ("dependents", "target_id as formula_id, dependent_id as neighbour_id")):
    query(f"g1_neighbours_{_d}", f"with {GRAPH} select {_s} from ge")(lambda spark, folder, d=_d: graph.neighbours(edges_of(spark, folder)[3], d))


@query("g2_expand_step", f"""with {GRAPH} select dependent_id as formula_id, target_id as next_id, 'prerequisite' as side from ge join corpus c on c.formula_id = dependent_id
  union all select formula_id, next_id, 'dependent' from (select t.formula_id, d.formula_id as next_id, row_number() over (partition by t.formula_id order by d.position, d.formula_id) as r
    from ge join corpus t on t.formula_id = target_id join corpus d on d.formula_id = dependent_id and d.chapter_id = t.chapter_id) where r <= 5""")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return graph.expand_step(formulas, edges, formulas)


@query("g3_starter_formulas", f"with {GRAPH} select formula_id, chapter_id from corpus where formula_id not in (select dependent_id from ge)")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return graph.starter_formulas(formulas, edges)


@query("g4_locked_guidance", f"""with {GRAPH}, {LEARNED} select u.user_id, e.dependent_id as formula_id, min_by(e.target_id, {{'p': t.position, 'i': t.formula_id}}) as blocker_id
  from (select distinct user_id, chapter_id from learned) u join corpus c on c.chapter_id = u.chapter_id join ge e on e.dependent_id = c.formula_id join corpus t on t.formula_id = e.target_id
  where not exists (select 1 from learned l where l.user_id = u.user_id and l.formula_id = e.target_id) group by all""")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return graph.locked_guidance(edges, formulas, learned_of(spark, folder))


@query("g5_lane_assignment", f"""with recursive {GRAPH}, {DEPTH}, ln as (select c.formula_id, chapter_id, position, cast(least(9, depth + case when depth = 0 and c.formula_id in (select target_id from ge) then 1 else 0 end) as bigint) as lane from corpus c join dep on dep.formula_id = c.formula_id)
  select formula_id, lane, row_number() over (partition by chapter_id, lane order by position) - 1 as row from ln""")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return graph.lane_assignment(formulas, edges, graph.formula_depth(formulas, edges))


@query("g8_recommended_entry", f"""with recursive {GRAPH}, {DEPTH}, {DEGREES}, {SCORES}, {SPINE}, ok as (select * from corpus where position % 3 <> 0)
  select chapter_id, min(b)['i'] as formula_id from (select bb.chapter_id, {{'t': case when ordinal < 5 then 0 else 1 end, 'o': ordinal, 'i': bb.formula_id}} as b from bb join ok on ok.formula_id = bb.formula_id union all select chapter_id, {{'t': 3, 'o': position, 'i': formula_id}} from ok) group by all""")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    depth = graph.formula_depth(formulas, edges)
    spine = rank.backbone(formulas, rank.centrality(formulas, edges, depth), depth).groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "formula_id"))), lambda x: x["formula_id"]).alias("backbone"))
    spine = spine.select("chapter_id", F.slice("backbone", 1, 5).alias("representative"), "backbone", F.array().cast("array<string>").alias("full"))
    return graph.recommended_entry(spine, formulas.filter("position % 3 != 0"))


@query("g9_chapter_edges", f"with {GRAPH} select distinct t.chapter_id, target_id, dependent_id from ge join corpus t on t.formula_id = target_id join corpus d on d.formula_id = dependent_id and d.chapter_id = t.chapter_id")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return graph.chapter_edges(formulas, edges)


@query("g10_key_concepts", f"""with {CORPUS}, n as (select formula_id, substr(symbol, 1, 3) as note, min(ordinal) as rank from occ where length(symbol) % 3 <> 2 group by all)
  select formula_id, r - 1 as ordinal, note from (select *, row_number() over (partition by formula_id order by rank, note) as r from n) where r <= 4""")
def _(spark, folder):
    kind = lambda x: F.when(F.length(x) % 3 == 0, "accent").when(F.length(x) % 3 == 1, "acronym").otherwise("plain")
    notes = F.transform("words", lambda x, i: F.struct(kind(x).alias("kind"), i.cast("long").alias("rank"), F.substring(x, 1, 3).alias("note")))
    return graph.key_concepts(corpus(spark, folder).select("formula_id", notes.alias("notes")))


@query("r1_featured_two_stage", f"""with {GRAPH}, {DEGREES}, s as (select formula_id, chapter, position, 30000 * n_in + 13500 * n_out + cast(floor(greatest(0, 1600 - length(latex)) * 10000 / 1600) as bigint) + 3500 as score from deg),
  r as (select *, row_number() over (partition by chapter order by score desc, position, formula_id) as rank, 240 // greatest(1, (select count(distinct chapter) from deg)) as quota from s),
  t as (select *, case when rank <= quota then 0 else 1 end as extra from r qualify row_number() over (order by case when rank <= quota then 0 else 1 end, score desc, chapter, position, formula_id) <= 240)
  select formula_id, chapter, cast(score + case when extra = 0 then floor(3500 * greatest(0, 20 - rank) / 20) else 0 end as bigint) as importance from t""")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return rank.featured_two_stage(formulas, edges)


@query("r2_featured_simple", f"with {GRAPH}, {DEGREES} select formula_id, cast(30 * n_in + 13 * n_out + case when conf >= 75 then 10 else -20 end as bigint) as score from deg order by score desc, position, formula_id limit 240")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return rank.featured_simple(formulas, edges)


@query("r3_centrality", f"with recursive {GRAPH}, {DEPTH}, {DEGREES}, {SCORES} select formula_id, cast(score as bigint) as score from sc")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    return rank.centrality(formulas, edges, graph.formula_depth(formulas, edges))


@query("r4_backbone", f"with recursive {GRAPH}, {DEPTH}, {DEGREES}, {SCORES}, {SPINE} select * from bb")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    depth = graph.formula_depth(formulas, edges)
    return rank.backbone(formulas, rank.centrality(formulas, edges, depth), depth)


@query("r5_chapter_navigator", f"""with recursive {GRAPH}, {DEPTH}, {DEGREES}, {SCORES}, {SPINE}, grp5(group_id, low, high) as (values ('basics', 1, 6), ('core', 7, 14), ('advanced', 15, 30))
  select group_id, c.chapter_id, n_formulas, backbone, representative, full_ids, case when n_formulas < 20 then 'easy' when n_formulas < 60 then 'medium' else 'hard' end as difficulty
  from (select chapter_id, chapter, count(*) as n_formulas, string_agg(formula_id, ',' order by position) as full_ids from corpus group by all) c
  left join (select chapter_id, string_agg(formula_id, ',' order by ordinal) as backbone, string_agg(formula_id, ',' order by ordinal) filter (ordinal < 5) as representative from bb group by all) b on b.chapter_id = c.chapter_id
  left join grp5 on chapter between low and high""")
def _(spark, folder):
    formulas, _, _, edges = edges_of(spark, folder)
    depth = graph.formula_depth(formulas, edges)
    groups = spark.createDataFrame([("basics", 1, 6), ("core", 7, 14), ("advanced", 15, 30)], "group_id string, low int, high int")
    return rank.chapter_navigator(formulas, rank.backbone(formulas, rank.centrality(formulas, edges, depth), depth), groups)


@query("r6_learning_paths", f"""with {CORPUS}, {LEARNED} select path_id, row_number() over (partition by path_id order by event_id, c.formula_id) - 1 as ordinal, c.formula_id from (select user_id as path_id, event_id, raw_id from learned) s join corpus c on c.raw_id = s.raw_id""")
def _(spark, folder):
    seeds = learned_of(spark, folder).select(F.col("user_id").alias("path_id"), F.col("event_id").alias("ordinal"), "raw_id")
    return rank.learning_paths(seeds, corpus(spark, folder))


STORY = """bp as (select item_id as story_id, 1 + item_id % 3 as low, 12 + item_id % 5 as high, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as keys,
  ['formula_' || (item_id % 9 + 6) || '.1a', 'formula_' || (item_id % 5 + 1) || '.2b', 'formula_4.3a', 'formula_2.1b'][:item_id % 5] as seeds, regexp_extract_all(lower(text), '[a-z]{3,}')[:2] as tokens from benchmark)"""


@query("r7_storyline_blueprint", f"""with recursive {CORPUS}, {STORY},
  h as (select distinct story_id, formula_id, symbol, defines from (select *, unnest(list_distinct([symbol, canonical, family])) as key from occ) o join (select *, unnest(keys) as key from bp) b using (key) where chapter between low and high),
  p as (select story_id, formula_id, sum(case when defines then 18 else 10 end) as points from h group by all),
  s as (select story_id, formula_id, chapter, position, nullif(coalesce(list_position(seeds, formula_id), 0), 0) as seed, seeds, points + coalesce(1001 - nullif(coalesce(list_position(seeds, formula_id), 0), 0), 0) + 12 * len(list_filter(tokens, lambda t: contains(latex, t))) as score
    from p join corpus using (formula_id) join bp using (story_id)),
  n as (select *, row_number() over (partition by story_id order by coalesce(seed, 1000000), -score, chapter, position, formula_id) as i from s),
  g(story_id, i, ids, chapters) as (select distinct story_id, 0::bigint, []::varchar[], []::int[] from n
    union all select g.story_id, n.i, case when n.seed is not null or not (len(ids) >= 6 or (len(ids) >= 3 and list_contains(chapters, n.chapter))) then list_append(ids, formula_id) else ids end,
      case when n.seed is not null or not (len(ids) >= 6 or (len(ids) >= 3 and list_contains(chapters, n.chapter))) then list_append(chapters, n.chapter) else chapters end from g join n on n.story_id = g.story_id and n.i = g.i + 1),
  f as (select story_id, ids[:6] as ids from g qualify row_number() over (partition by story_id order by i desc) = 1),
  back as (select a.story_id, string_agg(a.formula_id, ',' order by a.seed) as reversed from s a join f using (story_id) where a.seed is not null and not list_contains(ids, a.formula_id) and exists (select 1 from s b where b.story_id = a.story_id and b.seed < a.seed and b.chapter > a.chapter) group by all)
  select story_id, row_number() over (partition by story_id order by chapter, position, formula_id) - 1 as ordinal, formula_id, cast(score as bigint) as score, coalesce(reversed, '') as reversed
  from s join f using (story_id) left join back using (story_id) where len(ids) >= 2 and list_contains(ids, formula_id)""")
def _(spark, folder):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    formulas = corpus(spark, folder).repartition(tasks, "formula_id")  # what a formula scores is then added up where it is
    words, i = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), F.col("item_id")
    seeds = F.slice(F.array(F.concat(F.lit("formula_"), i % 9 + 6, F.lit(".1a")), F.concat(F.lit("formula_"), i % 5 + 1, F.lit(".2b")), F.lit("formula_4.3a"), F.lit("formula_2.1b")), F.lit(1), (i % 5).cast("int"))
    blueprints = table(spark, folder, "benchmark").select(i.alias("story_id"), (1 + i % 3).alias("low"), (12 + i % 5).alias("high"), words.alias("keys"), seeds.alias("seeds"), F.lit(None).cast("array<string>").alias("roles"), F.slice(words, 1, 2).alias("tokens"))
    return rank.storyline_blueprint(formulas, occurrences(formulas), blueprints)


@query("r8_storyline_by_symbol", f"""with {CORPUS}, d as (select u.symbol, u.formula_id, u.chapter, u.position from (select *, row_number() over (partition by formula_id order by ordinal) as r from uses) u join corpus c on c.formula_id = u.formula_id and c.conf >= 75 where r <= 6),
  top as (select symbol, count(*) as n from d group by all having count(*) >= 2 order by n desc, symbol limit 8)
  select symbol, row_number() over w as step, formula_id, lag(formula_id) over w as support_id from d where symbol in (select symbol from top) window w as (partition by symbol order by chapter, position, formula_id) qualify row_number() over w <= 8""")
def _(spark, folder):
    formulas, _, _, uses = vocabulary(spark, folder)
    return rank.storyline_by_symbol(formulas, uses)


@query("r9_search_index", f"with {CORPUS} select formula_id as id, raw_id as number, chapter_id, label, substr(latex, 1, 500) as latex_preview, substr(context_text, 1, 800) as context from corpus")
def _(spark, folder):
    return rank.search_index_build(corpus(spark, folder))


@query("r10_display_name", f"with {CORPUS} select formula_id, (case when contains(c, 'response') then 'Response' when contains(c, 'tion') then 'Tion' when contains(c, 'ment') then 'Ment' else 'Formula' end) || ' ' || raw_id as display_name from (select *, lower(context_text) as c from corpus)")
def _(spark, folder):
    return rank.display_name(corpus(spark, folder), ["response", "tion", "ment"])
