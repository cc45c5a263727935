"""Queries on symbol resolution, edges and their audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.work import written
from ..operators import audit, resolve
from .adapter import CORPUS, STOP, corpus, looked_up, packed, vocabulary
from .registry import query

J1 = """
j1 as (
  select formula_id, symbol, coalesce(a, b) as target_id, coalesce(sa, sb) as sense_id, case when a is not null then 'exact' else 'canonical' end as match_type from (
    select u.formula_id, u.symbol, x.formula_id as a, x.sense_id as sa, y.formula_id as b, y.sense_id as sb from uses u
    asof left join senses x on u.chapter_id = x.chapter_id and u.symbol = x.symbol and u.position > x.position
    asof left join senses y on u.chapter_id = y.chapter_id and u.canonical = y.canonical and u.position > y.position)
  where a is not null or b is not null)
"""
#: Every use with its hit, and the earlier formulas of its chapter that define its family.
RES = """
kin as (select u.formula_id, u.symbol, count(distinct s.formula_id) as n_family, max_by(s.formula_id, s.position) as last_family
  from uses u join senses s on s.chapter_id = u.chapter_id and s.family = u.family and s.position < u.position group by all),
res as (select u.*, j1.target_id, j1.match_type, coalesce(n_family, 0) as n_family, last_family from uses u left join j1 using (formula_id, symbol) left join kin using (formula_id, symbol))
"""
#: All pairs of uses and senses of earlier chapters, as candidates of each kind.
J2 = """
j2p as (select u.formula_id, u.symbol, u.family, s.formula_id as target_id, s.chapter_id, 'exact' as match_type, greatest(40, 78 - 3 * (u.chapter - s.chapter)) as conf, min_by(s.symbol, {'d': s.symbol <> u.symbol, 's': s.symbol}) as via_symbol
    from uses u join senses s on (s.symbol = u.symbol or s.canonical = u.canonical) and s.chapter < u.chapter group by all
  union all select u.formula_id, u.symbol, u.family, s.formula_id, s.chapter_id, 'family', greatest(30, 62 - 4 * (u.chapter - s.chapter)), min(s.symbol)
    from uses u join senses s on s.family = u.family and s.symbol <> u.symbol and s.chapter < u.chapter group by all),
j2 as (select formula_id, symbol, count(*) filter (match_type = 'exact') as n_exact, count(*) filter (match_type = 'family') as n_kin from j2p group by all)
"""
#: The same pairs, once for each class of uses: those of one canonical form or family in one chapter.
J2C = """
cls as (select distinct 'exact' as match_type, canonical as key, chapter from uses union all select distinct 'family', family, chapter from uses),
j2c as (select distinct c.match_type, c.key, c.chapter, s.formula_id as target_id, s.chapter_id, s.symbol as via_symbol, cast(case c.match_type when 'exact' then greatest(40, 78 - 3 * (c.chapter - s.chapter)) else greatest(30, 62 - 4 * (c.chapter - s.chapter)) end as bigint) as conf
  from cls c join (select *, 'exact' as match_type, canonical as key from senses union all select *, 'family', family from senses) s on s.match_type = c.match_type and s.key = c.key and s.chapter < c.chapter)
"""
#: The first entry of each formula and family: in order of the uses, those of the own chapter before those of earlier ones.
ENTRIES = """
offers as (select *, 0 as stage, 'chapter' as scope, 'family_candidate' as evidence, n_family as n from res where n_family >= case when target_id is null then 1 else 3 end
  union all select res.*, 1, 'earlier', case when n_exact > 0 then 'exact_match' else 'family_candidate' end, n_exact + n_kin from res join j2 using (formula_id, symbol) where target_id is null and regexp_full_match(chapter_id, 'chapter[0-9]+')),
ambiguous as (select formula_id as dependent_id, chapter_id, chapter, position, family, symbol, canonical, scope, evidence, n::bigint as n_candidates
  from offers qualify row_number() over (partition by formula_id, family order by ordinal, stage) = 1)
"""
#: What the entries list, for the formulas of ``asked``.
OPENED = """
cands as (select e.dependent_id, e.family, e.symbol, e.scope, s.formula_id as target_id, s.chapter_id, min_by(s.symbol, {'d': s.symbol <> e.symbol, 's': s.symbol}) as via_symbol, 'family_candidate' as match_type, 45 as conf
    from ambiguous e join asked on asked.formula_id = e.dependent_id join senses s on e.scope = 'chapter' and s.chapter_id = e.chapter_id and s.family = e.family and s.position < e.position group by all
  union all select e.dependent_id, e.family, e.symbol, e.scope, p.target_id, p.chapter_id, p.via_symbol, p.match_type, p.conf
    from ambiguous e join asked on asked.formula_id = e.dependent_id join j2p p on e.scope = 'earlier' and p.formula_id = e.dependent_id and p.symbol = e.symbol),
opened as (select dependent_id, family, symbol, row_number() over (partition by dependent_id, family, symbol order by case scope when 'earlier' then -conf end, case scope when 'earlier' then chapter_id end, target_id, match_type) as place,
    target_id, chapter_id, via_symbol, match_type, cast(conf as bigint) as conf from cands)
"""
J4 = """
grp as (select *, regexp_extract(raw_id, '^(A?[0-9]+\\.[0-9]+)[a-z]?$', 1) as g from corpus),
j4b as (select a.formula_id as dependent_id, b.formula_id as target_id, b.position as ordinal, b.position < a.position as prior from grp a join grp b on a.g = b.g and a.chapter_id = b.chapter_id and a.formula_id <> b.formula_id where a.g <> '')
"""
J5 = """
refs as (select formula_id, chapter_id, position, unnest(x) as raw, generate_subscripts(x, 1) - 1 as o from (select *, regexp_extract_all(context_text, '\\b(?:Equations?|Eq\\.?|Formula)\\s+(A?[0-9]+(?:\\.[0-9]+)+[a-z]?)', 1) as x from corpus)),
j5c as (select r.formula_id as dependent_id, t.formula_id as target_id, min(o) as ordinal from refs r join corpus t on r.raw = t.raw_id where (r.chapter_id <> t.chapter_id or t.position < r.position) and r.formula_id <> t.formula_id group by all),
j5o as (select r.formula_id as dependent_id, t.formula_id as target_id, min(o) as ordinal from refs r join corpus t on r.raw = t.raw_id where r.chapter_id = t.chapter_id and t.position < r.position group by all)
"""
X6 = """
x6 as (select distinct chapter_id, lower(s) as key from (select chapter_id, unnest(regexp_extract_all(context_text, '(?i)\\b(?:where|let)\\s+([A-Za-z\\\\]+)\\s+(?:is|are|be|denotes?|represents?)\\b', 1)) as s from corpus)),
x7 as (select u.formula_id, u.symbol, substr(trim(regexp_extract(c.context_text, '(?i)\\bwhere\\s+' || u.symbol || '\\s+(?:is|are|denotes?|represents?)\\s+([^.;]+)', 1)), 1, 220) as definition
  from (select distinct formula_id, symbol from uses) u join corpus c on c.formula_id = u.formula_id)
"""


X7O = """
x7o as (select u.formula_id, u.symbol, substr(trim(regexp_extract(c.context_text, '(?i)\\b' || u.symbol || '\\s+(?:is|denotes|represents|means)\\s+([^.;]+)', 1)), 1, 220) as definition
  from res u join corpus c on c.formula_id = u.formula_id where u.target_id is null)
"""
CONSERVATIVE = ",".join([CORPUS, J1, RES, J2, ENTRIES, J4, J5, X6]) + """,
found as (
  select dependent_id, target_id, '' as via_symbol, 'explicit_reference' as evidence, 98 as conf, 0 as stage, ordinal, cast(null as varchar) as definition from j5c
  union all select dependent_id, target_id, '', 'compound_group', 86, 1, ordinal, null from j4b
  union all select formula_id, target_id, symbol, match_type || '_match', 84, 2, ordinal, null from res where target_id is not null and n_family < 3),
txt as (select u.formula_id as dependent_id, cast(null as varchar) as target_id, u.symbol as via_symbol, 'text_definition' as evidence, 55 as conf, 3 as stage, u.ordinal, x7.definition
  from res u join x7 using (formula_id, symbol) where x7.definition <> '' and u.target_id is null and (length(u.symbol) > 1 or exists (select 1 from x6 where x6.chapter_id = u.chapter_id and x6.key = u.symbol))),
dedup as (select * from (select * from found union all select * from txt) qualify row_number() over (partition by dependent_id, target_id, case when target_id is null then via_symbol end order by stage, ordinal, via_symbol) = 1),
attr as (select e.dependent_id, e.target_id, e.via_symbol, e.evidence, e.conf, e.definition, e.ordinal, case when e.target_id is null then 'variable_definition' else 'formula' end as type, 'accepted' as edge_status,
  case e.evidence when 'canonical_match' then 82 when 'text_definition' then 65 else 100 end as edge_weight, coalesce(d.chapter_id <> t.chapter_id, false) as cross_chapter
  from dedup e join corpus d on d.formula_id = e.dependent_id left join corpus t on t.formula_id = e.target_id),
edges as (select * from attr qualify type = 'formula' or row_number() over (partition by dependent_id, type order by conf desc, length(coalesce(definition, '')) desc, ordinal) <= 3)
"""
#: In this mode no symbol is stop-listed.
OCR = ",".join([CORPUS.replace(" and symbol not in ('the', 'and', 'that', 'with', 'for')", ""), J1, RES, J4, J5, X7O]) + """,
hits as (
  select dependent_id, target_id, '' as via_symbol, 'compound_group' as evidence, 86 as conf, 0 as stage, ordinal, cast(null as varchar) as definition from j4b where prior
  union all select dependent_id, target_id, '', 'explicit_reference', 94, 1, ordinal, null from j5o
  union all select formula_id, target_id, symbol, match_type || '_match', case match_type when 'exact' then 90 else 82 end, 2, ordinal, null from res where target_id is not null),
judged as (select h.*, least(d.conf, t.conf) as least_conf from hits h join corpus d on d.formula_id = h.dependent_id join corpus t on t.formula_id = h.target_id),
txt as (select x.formula_id as dependent_id, cast(null as varchar) as target_id, x.symbol as via_symbol, 'text_definition' as evidence, 78 as conf, 3 as stage, u.ordinal, x.definition
  from x7o x join res u using (formula_id, symbol) join corpus c on c.formula_id = x.formula_id where x.definition <> '' and c.conf >= 75),
dedup as (select * from (select * exclude (least_conf) from judged where least_conf >= 75 union all select * from txt) qualify row_number() over (partition by dependent_id, target_id, via_symbol order by stage, ordinal) = 1),
edges as (select dependent_id, target_id, via_symbol, evidence, conf, case when target_id is null then 'variable_definition' else 'formula' end as type, 'accepted' as edge_status,
  case evidence when 'canonical_match' then 82 when 'text_definition' then 82 else 100 end as edge_weight, false as cross_chapter, definition from dedup),
ambiguous as (select dependent_id, target_id, via_symbol as symbol, 'low_confidence_ocr' as evidence, cast(least(least_conf, 55) as bigint) as conf from judged where least_conf < 75
  union all select formula_id, last_family, symbol, 'family_candidate', 45 from res where target_id is null and n_family > 0 and (formula_id, symbol) not in (select (dependent_id, via_symbol) from txt))
"""
COLUMNS = ["dependent_id", "target_id", "via_symbol", "evidence", "conf", "type", "edge_status", "edge_weight", "cross_chapter"]
_LIST = ", ".join(COLUMNS)


def inputs(spark, folder, mode="conservative"):
    """(formulas, uses, senses) of the corpus; in ``ocr`` mode no symbol is stop-listed."""
    formulas = corpus(spark, folder)
    return formulas, *looked_up(formulas, [] if mode == "ocr" else STOP, mode)


def built(spark, folder, mode="conservative", entries=True):
    """(formulas, edges, ambiguous) of the corpus; neither is computed before it is read, and without ``entries`` the edges alone are looked up."""
    formulas = corpus(spark, folder)
    return formulas, *resolve.build_dependencies(formulas, *packed(formulas, [] if mode == "ocr" else STOP, mode), mode, entries)


@query("n10_formula_list", f"with {CORPUS} select formula_id, raw_id, chapter_id, chapter, position, label, latex, context_text, conf from corpus")
def _(spark, folder):
    return corpus(spark, folder).select("formula_id", "raw_id", "chapter_id", "chapter", "position", "label", "latex", "context_text", "conf")


@query("i1_sense_registry", f"with {CORPUS} select sense_id, symbol, canonical, family, formula_id, chapter_id, chapter, position from senses")
def _(spark, folder):
    return vocabulary(spark, folder)[2].select("sense_id", "symbol", "canonical", "family", "formula_id", "chapter_id", "chapter", "position")


for _scope in ("chapter", "global"):
    _g = ("chapter_id, " if _scope == "chapter" else "") + "key_kind, key"
    query(f"i2_symbol_index_{_scope}", f"""with {CORPUS} select {_g}, string_agg(sense_id, ',' order by chapter, position, sense_id) as sense_ids
      from (select distinct chapter_id, chapter, position, sense_id, unnest(['symbol', 'canonical', 'family']) as key_kind, unnest([symbol, canonical, family]) as key from senses) group by all""")(
        lambda spark, folder, scope=_scope: resolve.symbol_index(vocabulary(spark, folder)[2], scope)
    )


@query("j1_asof_definition", f"with {CORPUS}, {J1} select * from j1")
def _(spark, folder):
    _, uses, senses = inputs(spark, folder)
    return resolve.asof_definition(uses, senses)


@query("j2_earlier_chapter_candidates", f"with {CORPUS}, {J2C} select * from j2c")
def _(spark, folder):
    """All pairs, of classes of uses and senses; ``j2_use_classes`` says whose they are."""
    _, _, senses, uses = vocabulary(spark, folder)
    return resolve.candidate_pairs(uses, senses)


@query("j2_use_classes", f"with {CORPUS}, {J2} select formula_id, symbol, canonical, family, chapter, n_exact, n_kin from j2 join uses using (formula_id, symbol)")
def _(spark, folder):
    """Each use with candidates: its classes (canonical form or family, and chapter) and how many it has."""
    _, _, senses, uses = vocabulary(spark, folder)
    return resolve.earlier_chapter_candidates(uses, senses)


@query("j2_candidate_lists", f"""with {CORPUS} select distinct kind, key, chapter_id, chapter, position, formula_id as target_id, symbol as via_symbol
  from (select *, 'canonical' as kind, canonical as key from senses union all select *, 'family', family from senses)""")
def _(spark, folder):
    return resolve.candidate_lists(vocabulary(spark, folder)[2])


@query("j3_family_demotion", f"with {CORPUS}, {J1}, {RES} select formula_id, symbol, n_family as n_targets, last_family as last_target from res where n_family >= 3")
def _(spark, folder):
    _, uses, senses = inputs(spark, folder)
    return resolve.family_candidates(uses, senses)


@query("j3_family_review", f"""with {CORPUS} select u.formula_id, u.symbol, count(distinct s.formula_id) as n_targets, max_by(s.formula_id, s.position) as last_target from uses u join senses s
  on u.chapter_id = s.chapter_id and u.family = s.family and s.position < u.position and u.canonical <> s.canonical group by all""")
def _(spark, folder):
    uses, senses = looked_up(corpus(spark, folder))
    return resolve.family_candidates(uses, senses, "review", 1)


@query("j4_equation_groups", f"with {CORPUS}, {J4} select dependent_id, target_id, ordinal from j4b")
def _(spark, folder):
    return resolve.equation_group_join(corpus(spark, folder)).select("dependent_id", "target_id", "ordinal")


@query("j4_equation_groups_prior", f"with {CORPUS}, {J4} select dependent_id, target_id, ordinal from j4b where prior")
def _(spark, folder):
    return resolve.equation_group_join(corpus(spark, folder), "prior").select("dependent_id", "target_id", "ordinal")


@query("j5_explicit_references", f"with {CORPUS}, {J5} select dependent_id, target_id, cast(98 as bigint) as conf from j5c")
def _(spark, folder):
    return resolve.explicit_reference_join(corpus(spark, folder)).select("dependent_id", "target_id", "conf")


@query("j5_explicit_references_ocr", f"with {CORPUS}, {J5} select dependent_id, target_id, cast(94 as bigint) as conf from j5o")
def _(spark, folder):
    return resolve.explicit_reference_join(corpus(spark, folder), "ocr").select("dependent_id", "target_id", "conf")


@query("x6_text_defined_symbols", f"with {CORPUS}, {X6} select * from x6")
def _(spark, folder):
    return resolve.text_defined_symbols(corpus(spark, folder))


@query("x7_text_definition", f"with {CORPUS}, {X6} select * from x7 where definition <> ''")
def _(spark, folder):
    formulas, _, _, uses = vocabulary(spark, folder)
    return resolve.text_definition(uses, formulas)


@query("j6_text_fallback", f"with {CONSERVATIVE} select dependent_id, via_symbol, cast(conf as bigint) as conf, definition from txt")
def _(spark, folder):
    formulas, uses, senses = inputs(spark, folder)
    left = resolve.resolved_uses(uses, senses).filter("target_id is null")
    return resolve.text_definition_fallback(left, resolve.text_defined_symbols(formulas), formulas).select("dependent_id", "via_symbol", "conf", "definition")


@query("j7_use_filter", f"with {CORPUS} select formula_id, symbol, ordinal from uses")
def _(spark, folder):
    return vocabulary(spark, folder)[3].select("formula_id", "symbol", "ordinal")


def _found(spark, folder, mode="conservative"):
    """(formulas, edges that are distinct) of the corpus, without definitions."""
    formulas, uses, senses = inputs(spark, folder, mode)
    return formulas, resolve.edge_dedupe(resolve.found_edges(formulas, resolve.resolved_uses(uses, senses), mode), resolve.EDGE_KEYS[mode])


@query("e1_edge_attributes", f"with {CONSERVATIVE} select {_LIST} from attr")
def _(spark, folder):
    """Edges and definitions, before they are pruned."""
    formulas, uses, senses = inputs(spark, folder)
    resolved = written(resolve.needed_uses(resolve.resolved_uses(uses, senses)), "resolved")
    text = resolve.text_definition_fallback(resolved.filter("target_id is null"), resolve.text_defined_symbols(formulas), formulas)
    found = resolve.found_edges(formulas, resolved, "conservative").unionByName(text)
    return resolve.edge_attributes(resolve.edge_dedupe(found, resolve.EDGE_KEYS["conservative"]), formulas).select(*COLUMNS)


@query("e2_edge_dedupe", f"with {CONSERVATIVE} select dependent_id, target_id, via_symbol, evidence, cast(conf as bigint) as conf from dedup where stage < 3")
def _(spark, folder):
    return _found(spark, folder)[1].select("dependent_id", "target_id", "via_symbol", "evidence", "conf")


@query("e3_edge_prune", f"with {CONSERVATIVE} select dependent_id, target_id, via_symbol, evidence, definition from edges")
def _(spark, folder):
    return built(spark, folder, entries=False)[1].select("dependent_id", "target_id", "via_symbol", "evidence", "definition")


@query("e4_ambiguous_assembly", f"""with {CONSERVATIVE}, asked as (select formula_id from corpus), {OPENED},
  nested as (select dependent_id, family, symbol, string_agg(target_id || ':' || conf, ',' order by place) as candidates from opened group by all)
  select * from ambiguous left join nested using (dependent_id, family, symbol)""")
def _(spark, folder):
    """Each entry with all its candidates."""
    formulas = corpus(spark, folder)
    uses, senses = packed(formulas, STOP, "conservative")
    return resolve.nested_candidates(resolve.build_dependencies(formulas, uses, senses)[1], senses)


@query("e4_opened_candidates", f"""with {CONSERVATIVE}, asked as (select formula_id from corpus qualify row_number() over (partition by chapter_id order by position desc) = 1), {OPENED} select * from opened""")
def _(spark, folder):
    """What a reader at the end of each chapter finds open: the candidates of the chapter's last formula."""
    formulas = corpus(spark, folder)
    uses, senses = packed(formulas, STOP, "conservative")
    entries = resolve.build_dependencies(formulas, uses, senses)[1]
    last = formulas.groupBy("chapter_id").agg(F.max_by("formula_id", "position").alias("dependent_id")).select("dependent_id")
    return resolve.opened_candidates(entries.join(last, "dependent_id", "left_semi"), senses)


@query("e5_quarantine", f"with {OCR} select * from ambiguous")
def _(spark, folder):
    return built(spark, folder, "ocr")[2]


for _mode, _sql in (("conservative", CONSERVATIVE), ("ocr", OCR)):
    query(f"e6_dependencies_{_mode}", f"with {_sql} select {_LIST.replace('dependent_id', 'c.formula_id as dependent_id')} from (select formula_id from corpus) c left join edges e on e.dependent_id = c.formula_id")(
        lambda spark, folder, mode=_mode: resolve.with_all_formulas(*built(spark, folder, mode, False)[:2]).select(*COLUMNS)
    )


A1 = """
a1 as (select c.chapter_id, c.formulas, coalesce(e.edges, 0) as edges, coalesce(e.accepted, 0) as accepted, coalesce(e.exact_edges, 0) as exact_edges, coalesce(e.explicit_edges, 0) as explicit_edges, coalesce(e.group_edges, 0) as group_edges,
    coalesce(e.fallback_definitions, 0) as fallback_definitions, coalesce(e.family_edges, 0) as family_edges, coalesce(a.ambiguous, 0) as ambiguous
  from (select chapter_id, count(*) as formulas from corpus group by all) c
  left join (select f.chapter_id, count(*) as edges, count(*) filter (edge_status = 'accepted') as accepted, count(*) filter (evidence = 'exact_match') as exact_edges, count(*) filter (evidence = 'explicit_reference') as explicit_edges,
      count(*) filter (evidence = 'compound_group') as group_edges, count(*) filter (evidence = 'text_definition') as fallback_definitions, count(*) filter (evidence = 'family_candidate') as family_edges
    from edges e join corpus f on f.formula_id = e.dependent_id group by all) e on e.chapter_id = c.chapter_id
  left join (select chapter_id, count(*) as ambiguous from ambiguous group by all) a on a.chapter_id = c.chapter_id)
"""


@query("a1_dependency_audit", f"with {CONSERVATIVE}, {A1} select * from a1")
def _(spark, folder):
    return audit.dependency_audit(*built(spark, folder))


@query("a2_audit_totals", f"with {CONSERVATIVE}, {A1} select coalesce(chapter_id, 'all') as chapter_id, sum(formulas)::bigint as formulas, sum(edges)::bigint as edges, sum(ambiguous)::bigint as ambiguous, sum(family_edges)::bigint = 0 and sum(edges) = sum(accepted) as invariants_hold from a1 group by rollup (chapter_id)")
def _(spark, folder):
    return audit.audit_totals(audit.dependency_audit(*built(spark, folder)))


@query("a3_review_bundle", f"""with {CONSERVATIVE},
  ind as (select target_id, count(*) as n from edges where target_id is not null group by all), outd as (select dependent_id, count(*) as n from edges group by all),
  picks as (select c.formula_id, row_number() over (order by coalesce(i.n, 0) desc, c.formula_id) as top_rank, coalesce(o.n, 0) as n_out, row_number() over (partition by coalesce(o.n, 0) = 0 order by c.formula_id) as zero_rank, row_number() over (order by chapter, position) - 1 as place
    from corpus c left join ind i on i.target_id = c.formula_id left join outd o on o.dependent_id = c.formula_id)
  select formula_id, case when top_rank <= 8 then 'top' when n_out = 0 and zero_rank <= 8 then 'zero' else 'every' end as reason from picks where top_rank <= 8 or (n_out = 0 and zero_rank <= 8) or place % 100 = 0""")
def _(spark, folder):
    formulas, edges, _ = built(spark, folder, entries=False)
    return audit.review_bundle(formulas, written(edges, "edges"))


@query("a4_quality_report", f"""with {OCR} select 'duplicate_id' as issue, count(*) as n from (select formula_id from corpus group by all having count(*) > 1)
  union all select 'missing_target', count(*) from edges where target_id is not null and target_id not in (select formula_id from corpus)
  union all select 'low_confidence_accepted', count(*) from edges e where exists (select 1 from corpus c where c.formula_id in (e.dependent_id, e.target_id) and c.conf < 75)
  union all select 'low_confidence_formula', count(*) from corpus where conf < 75""")
def _(spark, folder):
    formulas, edges, _ = built(spark, folder, "ocr", False)
    return audit.quality_report(formulas, written(edges, "edges"))
