"""Queries on review operations and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review, search
from .adapter import CORPUS, corpus, table
from .registry import query

REVIEW = """
rv as (select p_partkey as concept_id, 'chapter' || (p_size % 5) as chapter_id, p_name as name, ['unreviewed', 'approved', 'needs_revision', 'ambiguous', 'rejected'][p_partkey % 5 + 1] as status, cast(50 + p_partkey % 50 as bigint) as conf, p_size % 4 as n_flags, p_partkey % 2 = 0 as defined, p_type || ' ' || p_name as evidence from part),
mg as (select ps as concept_id from (select l_partkey as ps, l_linenumber from lineitem where l_linenumber = 7))
"""


def concepts(spark, folder):
    d = table(spark, folder, "part")
    status = F.get(F.array(*map(F.lit, review.STATUSES)), (F.col("p_partkey") % 5).cast("int"))
    return d.select(F.col("p_partkey").alias("concept_id"), F.concat(F.lit("chapter"), F.col("p_size") % 5).alias("chapter_id"), F.col("p_name").alias("name"), status.alias("status"), (50 + F.col("p_partkey") % 50).cast("long").alias("conf"), (F.col("p_size") % 4).alias("n_flags"), (F.col("p_partkey") % 2 == 0).alias("defined"), F.concat_ws(" ", "p_type", "p_name").alias("evidence"))


@query("v1_review_queue", f"""with {REVIEW} select concept_id, cast(score as bigint) as score from (select rv.concept_id, case when status = 'unreviewed' then 60 when status in ('ambiguous', 'needs_revision') then 80 else 0 end + case when conf < 72 then 97 - conf else 0 end
  + case when n_flags > 0 then 25 + least(5 * n_flags, 20) else 0 end + case when coalesce(n, 0) > 0 then 30 + least(5 * n, 25) else 0 end + case when defined then 8 else 0 end as score from rv left join (select concept_id, count(*) as n from mg group by all) g on g.concept_id = rv.concept_id) where score > 0 order by score desc, concept_id limit 500""")
def _(spark, folder):
    groups = table(spark, folder, "lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("concept_id"))
    return review.review_queue(concepts(spark, folder), groups)


@query("v2_review_rollup", f"""with {REVIEW} select coalesce(chapter_id, 'all') as chapter_id, count(*) as total, count(*) filter (status = 'unreviewed') as unreviewed, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'needs_revision') as needs_revision, count(*) filter (status = 'ambiguous') as ambiguous, count(*) filter (status = 'rejected') as rejected,
  cast(round(count(*) filter (status <> 'unreviewed') * 10000.0 / count(*)) as bigint) as reviewed, count(*) filter (status in ('unreviewed', 'ambiguous', 'needs_revision')) = 0 as passes from rv group by rollup (chapter_id)""")
def _(spark, folder):
    return review.review_rollup(concepts(spark, folder))


@query("v3_patch_upsert", f"""with {REVIEW}, pt as (select l_partkey as concept_id, l_orderkey * 10 + l_linenumber as seq, max(case when l_linenumber % 2 = 0 then 'approved' end) as status, max(case when l_linenumber % 3 = 0 then cast(99 as bigint) end) as conf from lineitem group by all),
  la as (select concept_id, max_by(status, seq) filter (status is not null) as status, max_by(conf, seq) filter (conf is not null) as conf from pt group by all)
  select rv.concept_id, coalesce(la.status, rv.status) as status, coalesce(la.conf, rv.conf) as conf from rv left join la on la.concept_id = rv.concept_id""")
def _(spark, folder):
    d = table(spark, folder, "lineitem")
    patches = d.select(F.col("l_partkey").alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, "approved").alias("status"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(99).cast("long")).alias("conf"))
    return review.patch_upsert(concepts(spark, folder).select("concept_id", "status", "conf"), patches, "concept_id", ["status", "conf"])


@query("v4_auto_review", f"""with {REVIEW} select concept_id, case when status in ('approved', 'rejected') then 'kept' when conf >= 80 then 'approved' when conf < 60 then 'needs_revision' else 'manual' end as decision, case when conf < 60 then 'low_confidence' else '' end as reasons from rv""")
def _(spark, folder):
    return review.auto_review(concepts(spark, folder))


@query("v5_prompt_tasks", f"""with {CORPUS} select 'task_' || formula_id as task_id, row_number() over (partition by chapter_id order by position) - 1 as n_prior,
  coalesce(array_to_string(list(raw_id) over (partition by chapter_id order by position rows between 3 preceding and 1 preceding), ','), '') as prior from corpus""")
def _(spark, folder):
    return review.prompt_tasks(corpus(spark, folder))


RAW = "raw as (select case when position % 7 = 0 then formula_id || '_x' else formula_id end as formula_id, case when position % 5 = 0 then 'odd' else 'approved' end as status, conf + position % 20 as conf from corpus where position % 11 <> 0)"


def _raw(spark, folder):
    p = F.col("position")
    return corpus(spark, folder).filter(p % 11 != 0).select(F.when(p % 7 == 0, F.concat("formula_id", F.lit("_x"))).otherwise(F.col("formula_id")).alias("formula_id"), F.when(p % 5 == 0, "odd").otherwise("approved").alias("status"), (F.col("conf") + p % 20).alias("conf"))


@query("v6_validation_accepted", f"with {CORPUS}, {RAW} select formula_id, status, least(100, conf) as conf from raw where formula_id in (select formula_id from corpus) and status <> 'odd'")
def _(spark, folder):
    return review.result_validation(_raw(spark, folder), corpus(spark, folder))[0]


@query("v6_validation_issues", f"""with {CORPUS}, {RAW} select formula_id, 'unknown_id' as issue from raw where formula_id not in (select formula_id from corpus) union all select formula_id, 'bad_status' from raw where formula_id in (select formula_id from corpus) and status = 'odd'
  union all select formula_id, 'clamped' from raw where formula_id in (select formula_id from corpus) and status <> 'odd' and conf > 100 union all select formula_id, 'missing' from corpus where formula_id not in (select formula_id from raw)""")
def _(spark, folder):
    return review.result_validation(_raw(spark, folder), corpus(spark, folder))[1]


#: A result of every part, each of a kind by its number: whole, broken, no object, unknown, with values missing, not allowed or of another type.
RESULTS = """
kinds as (select *, p_partkey % 11 as k, 'c' || p_partkey as key from part),
want as (select p_partkey as row_id, key as stable_key, case when k in (3, 7) then p_name else 'Name ' || p_partkey end as concept_name, case when k in (4, 7) then 'unknown' else 'math_concept' end as concept_type,
  case when k = 7 then 'Of ' || p_name else 'What it is' end as definition, cast(case k when 5 then 100 when 6 then 0 when 7 then 0 when 8 then 71 else 90 end as bigint) as conf, case when k in (7, 8) then 'unreviewed' else 'approved' end as review_status,
  case when k in (6, 7, 8) then ['seen', 'llm_candidate', 'needs_review'] else ['seen', 'llm_candidate'] end as review_flags, k from kinds where k not in (0, 1, 2))
"""


def _results(spark, folder):
    p = table(spark, folder, "part").withColumn("k", F.col("p_partkey") % 11)
    k, name = F.col("k"), F.concat(F.lit("Name "), "p_partkey")
    text = lambda field, value: F.concat(F.lit(f'"{field}":'), value)
    said = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    key = F.when(k == 2, "nobody").otherwise(F.concat(F.lit("c"), "p_partkey"))
    fields = [
        F.when(k == 9, text("task_id", said(key))).when(k == 10, F.concat(F.lit('"chapter_id":"x","formula_id":"y","role":"z","symbol":"'), "p_partkey", F.lit('"'))).otherwise(text("stable_key", said(key))),
        text("concept_name", F.when(k == 3, F.lit('" "')).when(k == 7, F.lit("[1]")).otherwise(said(name))), text("concept_type", F.when(k == 4, F.lit('"odd"')).when(k == 7, F.lit("null")).otherwise(F.lit('"math_concept"'))),
        F.when(k != 7, text("definition", F.lit('"What it is"'))), text("confidence", F.when(k == 5, "7").when(k == 6, '"0.9"').when(k == 7, "-1").when(k == 8, "0.71").otherwise("0.9")),
        text("review_status", F.when(k == 7, F.lit("{}")).when(k == 8, F.lit('"odd"')).otherwise(F.lit('"approved"'))), F.lit('"review_flags":["seen",3,"seen"]'),
    ]
    whole = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))
    raw = p.select(F.col("p_partkey").alias("row_id"), F.when(k == 0, F.substring(whole, 1, 20)).when(k == 1, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole).alias("text"))
    known = F.when(k == 10, F.concat(F.lit("x::y::z::"), "p_partkey")).otherwise(F.concat(F.lit("c"), "p_partkey"))
    concepts = p.filter("k != 2").select(known.alias("stable_key"), F.col("p_name").alias("concept_name"), F.lit("unknown").alias("concept_type"), F.concat(F.lit("Of "), "p_name").alias("definition"))
    return review.concept_results(raw, concepts)


@query("v6_concept_entries", f"with {RESULTS} select row_id, case k when 10 then 'x::y::z::' || row_id else stable_key end as stable_key, concept_name, concept_type, definition, conf, review_status, review_flags, '' as review_notes, '{review.RESULT_MODEL}' as extraction_model from want")
def _(spark, folder):
    return _results(spark, folder)[0]


@query("v6_concept_issues", """select p_partkey as row_id, case when k in (0, 1) then null when k = 2 then 'nobody' else 'c' || p_partkey end as stable_key, issue from (select p_partkey, p_partkey % 11 as k from part) join (values (0, 'broken_json'), (1, 'not_an_object'), (2, 'unknown_key'),
  (3, 'missing_concept_name'), (4, 'invalid_concept_type'), (7, 'missing_concept_name'), (7, 'missing_definition'), (7, 'invalid_concept_type'), (8, 'invalid_review_status')) i(k, issue) using (k)""")
def _(spark, folder):
    return _results(spark, folder)[1]


@query("v8_cache_plan", f"with {CORPUS}, w as (select formula_id, position, sha256(formula_id || chr(10) || latex || chr(10) || context_text) as digest from corpus) select formula_id, digest from w where position % 3 <> 0")
def _(spark, folder):
    f = corpus(spark, folder)
    cache = f.filter("position % 3 = 0").select("formula_id", F.sha2(F.concat("formula_id", F.lit("\n"), "latex", F.lit("\n"), "context_text"), 256).alias("digest"))
    return review.incremental_cache_plan(f, cache)


@query("v9_copy_filter", r"""select doc_id as id, r = '' as ok, r as reason from (select doc_id, case when trim(coalesce(text, '')) = '' then 'missing' when len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 14 and len(regexp_extract_all(text, '[A-Za-z]{2,}')) > greatest(6.0, 0.45 * len(regexp_extract_all(text, '[一-鿿]'))) then 'raw_english' else '' end as r from documents)""")
def _(spark, folder):
    return review.generated_copy_filter(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


#: Queries without Latin words, chosen by the item's number.
ASKED = ["有效群体大小", "自然选择", "选择强度", "连锁不平衡", "LD", "Ne", "第3章", "chapter 2", "公式 4.1", "群体大小"]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _norm(text: str) -> str:
    text = f"translate(coalesce({text}, ''), {_quoted(''.join(search.FOLDED))}, {_quoted(''.join(search.FOLDED.values()))})"
    for c, plain in search.LIGATURES.items():
        text = f"replace({text}, '{c}', '{plain}')"
    comma = lambda x: f"regexp_replace({x}, '([0-9]),([0-9])', '\\1.\\2', 'g')"
    plain = f"translate({comma(comma(f'lower({text})'))}, '{search.QUOTES[0]}', {_quoted(search.QUOTES[1])})"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


def _latex_words(text: str) -> str:
    for pattern, said in search.LATEX_WORDS:
        text = f"regexp_replace({text}, '{pattern}', '{said.replace('$', chr(92))}', 'g')"
    return text


def folded(texts: str) -> str:
    """CTE ``fx``: (text, n, c, l, words) of the texts of a query: its normal, compact and loose forms, and its words with LaTeX read."""
    return rf"""
tx as (select distinct text, {_latex_words("text")} as lw from ({texts})),
nx as (select text, {_norm("text")} as n, {_norm("text || ' ' || lw")} as m from tx),
fx as (select text, n, regexp_replace(n, '\s+', '', 'g') as c, regexp_replace({_latex_words("n")}, '{search.APART}', '', 'g') as l, string_split_regex(m, '{search.APART}') as words from nx)
"""


def matched(fields: str, plan: str) -> str:
    """CTEs ``va`` and ``fm``: every variant of ``plan`` held against every row of ``fields``(id, field, least, text), by way of ``fx``."""
    return rf"""
va as (select distinct query_id, form, v, regexp_matches(v, '^[a-z0-9]{{1,2}}$') as short from (select query_id, 'c' as form, c as v from {plan} p join fx on fx.text = p.variant union all select query_id, 'l', l from {plan} p join fx on fx.text = p.variant) where v <> ''),
fm as (select query_id, id, field, bool_or(form = 'c' and c = v) as equal, bool_or(form = 'c' and starts_with(c, v)) as begins,
    bool_or(length(v) >= least and case when short then c = v or l = v or (least <= 2 and list_contains(words, v)) else contains(case form when 'c' then c else l end, v) end) as holds
  from va join (select f.*, c, l, words from {fields} f join fx using (text) where f.text <> '') f on starts_with(c, v) or contains(l, v) or contains(c, v) or list_contains(words, v) group by all having equal or begins or holds)
"""


def _text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


_RULES = ", ".join(f"({_text(p)}, {_text(t.lower())}, {_text(skip)})" for p, terms, skip in search.RULES for t in terms)
_FORMS = lambda value, forms: f"unnest([{', '.join(chr(39) + f.replace('%s', chr(39) + ' || ' + value + ' || ' + chr(39)) + chr(39) for f in forms)}])"
_CHAPTER = "coalesce(" + ", ".join(f"nullif(regexp_extract(n, '{p}', 1), '')" for p in search.CHAPTER) + ")"

_asked = f"case item_id % 4 when 0 then text when 1 then string_split_regex(text, '[ ]+')[1] || ' ' || (item_id % 20 + 1) || '.1a' when 2 then [{', '.join(map(_text, ASKED))}][item_id // 4 % {len(ASKED)} + 1] else string_split_regex(text, '[ ]+')[1] end"
PLAN = rf"""
qs as (select *, regexp_extract(n, '{search.NUMBER}', 1) as number from (select item_id as query_id, {_norm(_asked)} as n from benchmark)),
rules(pattern, term, skip) as (values {_RULES}),
ruled as (select query_id, pattern, term from qs join rules on regexp_matches(n, pattern) and (skip is null or not regexp_matches(n, skip))),
qp as (select distinct query_id, variant, number, query_id in (select query_id from ruled where not starts_with(pattern, '^')) as mapped from (select query_id, n as variant, number from qs union all select query_id, {_FORMS("number", search.NUMBER_FORMS)}, number from qs where number <> ''
  union all select query_id, {_FORMS("c", search.CHAPTER_FORMS)}, number from (select *, {_CHAPTER} as c from qs) where c is not null
  union all select query_id, term, number from ruled join qs using (query_id)) where variant <> '')
"""
_names = "[number, label, 'formula ' || number, 'formula' || number, '公式 ' || number, '公式' || number]"
DOCS = rf"""
sd as (select formula_id as id, raw_id as number, label, coalesce(lang, '') || ' part ' || coalesce(words[1], '') as section, latex, context_text as context, array_to_string(words[3:8], ' ') as keywords from corpus),
fd as (select id, x.field as field, x.least as least, x.text as text from (select id, unnest([{{'field': 'label', 'least': 2, 'text': label}}, {{'field': 'latex', 'least': 2, 'text': latex || ' ' || {_latex_words("latex")}}}, {{'field': 'keywords', 'least': 2, 'text': keywords}},
  {{'field': 'section', 'least': 2, 'text': section}}, {{'field': 'context', 'least': 3, 'text': context}}]) as x from sd)),
names as (select id, unnest(list_concat([id], {_names})) as text from sd)
"""
SEARCH = f"""{PLAN}, {DOCS}, {folded("select text from fd union all select text from names union all select number from sd union all select number from qp union all select variant from qp")}, {matched("fd", "qp")},
hits as (select query_id, id, cast(max(s) as bigint) as score from (
  select query_id, id, case field when 'label' then 780 when 'latex' then 730 when 'keywords' then 640 when 'section' then 590 else 500 end as s from fm where holds
  union all select query_id, id, 900 from qp join fx v on v.text = variant join fx a on a.c = v.c and a.c <> '' join names on names.text = a.text where qp.number = ''
  union all select query_id, id, case when n = q then 1000 when regexp_matches(q, '^[a-z]?[0-9]+\\.?$') then 920 else 830 end
    from (select distinct query_id, fx.c as q from qp join fx on fx.text = qp.number where number <> '') join (select id, fx.c as n from sd join fx on fx.text = sd.number) on n = q or starts_with(n, case when regexp_matches(q, '^[a-z]?[0-9]+$') then q || '.' else q end)) group by all)
"""
NATURAL = lambda key: f"array_to_string(list_transform(regexp_extract_all(lower({key}), '([0-9]+|[^0-9]+)', 1), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(ltrim(x, '0'), 12, '0') else x end), '')"


def _queries(spark, folder):
    i, first = F.col("item_id"), F.get(F.split("text", "[ ]+"), F.lit(0))
    asked = F.get(F.array(*map(F.lit, ASKED)), (F.floor(i / 4) % len(ASKED)).cast("int"))
    text = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, F.concat(first, F.lit(" "), i % 20 + 1, F.lit(".1a"))).when(i % 4 == 2, asked).otherwise(first)
    return table(spark, folder, "benchmark").select(i.alias("query_id"), text.alias("text"))


def _plan(spark, folder):
    return search.query_plan(_queries(spark, folder))


def _documents(spark, folder):
    f = corpus(spark, folder).withColumns({"keywords": F.slice("words", 3, 6), "section": F.concat(F.coalesce("lang", F.lit("")), F.lit(" part "), F.coalesce(F.get("words", F.lit(0)), F.lit("")))})
    return search.search_documents(f)


@query("q1_search_documents", f"""with {CORPUS}, {DOCS}, st as (select *, array_to_string(list_filter([id, {_names[1:-1]}, section, latex, {_latex_words("latex")}, context, keywords], lambda x: x <> ''), ' ') as search_text from sd), {folded("select search_text as text from st")}
  select id, number, label, section, latex, context, keywords, search_text, c as compact, l as loose from st join fx on fx.text = search_text""")
def _(spark, folder):
    return _documents(spark, folder)


@query("q2_query_plan", f"with {PLAN} select * from qp")
def _(spark, folder):
    return _plan(spark, folder)


@query("q3_score_formulas", f"with {CORPUS}, {SEARCH} select * from hits")
def _(spark, folder):
    return search.score_formulas(_plan(spark, folder), _documents(spark, folder))


@query("q6_fuzzy_match", f"""with {CORPUS}, {PLAN}, wd as (select distinct symbol as word from occ),
  sc as (select variant, word, cast(round(420 - 420 * levenshtein(variant, word) / greatest(length(variant), length(word))) as bigint) as score
    from (select distinct variant from qp where regexp_matches(variant, '^[a-z.,]+$')), wd where levenshtein(variant, word) / greatest(length(variant), length(word)) <= 0.32 qualify row_number() over (partition by variant order by score desc, word) <= 16)
  select distinct query_id, variant, word, score from sc join qp using (variant)""")
def _(spark, folder):
    words = corpus(spark, folder).select(F.explode("words").alias("word")).distinct()
    return search.fuzzy_match(_plan(spark, folder).filter(F.col("variant").rlike("^[a-z.,]+$")), words)


CHAPTERS = f"""
ch as (select *, regexp_extract(chapter_id, '([0-9]+)$', 1) as d from (select chapter_id, chapter, concat_ws(' ', min(words[1]), max(words[1])) as title from corpus group by all
  union all select 'appendix' || chapter, chapter, 'of ' || chapter_id from (select distinct chapter_id, chapter from corpus))),
cn as (select *, starts_with(chapter_id, 'appendix') as added, case when starts_with(chapter_id, 'appendix') then [{", ".join(_quoted(x).replace("%s", "' || d || '") for x in search.APPENDIX_NAMES)}] else [{", ".join(_quoted(x).replace("%s", "' || d || '") for x in search.CHAPTER_NAMES)}] end as names from ch),
cf as (select chapter_id as id, 'own' as field, 2 as least, unnest(list_append(names[1:2], chapter_id)) as text from cn union all select chapter_id, 'every', 2, concat_ws(' ', chapter_id, title, array_to_string(names, ' ')) from cn),
pc as (select * from qp where number = ''),
iq as (select query_id, {", ".join(f"coalesce({', '.join(f'nullif(regexp_extract(n, {_quoted(p)}, 1), {_quoted(str())})' for p in some)}) as {name}" for name, some in (("chapter", search.WHICH_CHAPTER), ("appendix", search.WHICH_APPENDIX)))},
  {", ".join("(" + " or ".join(f"regexp_matches(n, {_quoted(p)})" for p in some) + f") as {name}" for name, some in (("by_chapter", search.ASKS_CHAPTER), ("by_appendix", search.ASKS_APPENDIX)))} from qs)
"""
Q5 = f"""{PLAN}, {CHAPTERS}, {folded("select text from cf union all select variant from qp")}, {matched("cf", "pc")},
q5 as (select query_id, chapter_id, cast(max(s) as bigint) as score from (select query_id, fm.id as chapter_id, case when field = 'own' and equal and case when added then by_appendix else by_chapter end then 960 when field = 'every' and holds then 820 end as s
    from fm join iq using (query_id) join cn on cn.chapter_id = fm.id where case when added then coalesce(iq.appendix = d, true) and iq.chapter is null else coalesce(iq.chapter = d, true) and iq.appendix is null end) where s is not null group by all)
"""


def _chapters(spark, folder):
    f = corpus(spark, folder)
    first = F.get("words", F.lit(0))
    own = f.groupBy("chapter_id", "chapter").agg(F.concat_ws(" ", F.min(first), F.max(first)).alias("title"))
    added = f.select("chapter_id", "chapter").distinct().select(F.concat(F.lit("appendix"), "chapter").alias("chapter_id"), "chapter", F.concat(F.lit("of "), "chapter_id").alias("title"))
    return own.union(added)


def chapter_hits(spark, folder):
    queries = _queries(spark, folder)
    return search.score_chapters(search.query_plan(queries), search.query_intents(queries), _chapters(spark, folder))


@query("q5_score_chapters", f"with {CORPUS}, {Q5} select * from q5")
def _(spark, folder):
    return chapter_hits(spark, folder)


@query("q7_merge_and_rank", f"""with {CORPUS}, {SEARCH}, h as (select query_id, id, number as name, score from hits join (select id, number from sd) using (id)),
  o as (select query_id, 'formula' as type, id, score, row_number() over (partition by query_id order by score desc, {NATURAL("name")}, id) as rank from h) select * from o where rank <= 10""")
def _(spark, folder):
    docs = _documents(spark, folder)
    hits = search.score_formulas(_plan(spark, folder), docs).join(docs.select("id", F.col("number").alias("name")), "id")
    return search.merge_and_rank(hits.withColumn("type", F.lit("formula")))


#: Parts as concepts: one alias that names the brand, one in capitals that names the context, one that is the section's title.
PART_CONCEPTS = """
cc4 as (select p_partkey as id, p_name as title, p_brand as symbol, 'Formula ' || p_size as label, p_type as section, 'A ' || p_name || ' of ' || p_type || ' size' as context, [lower(p_brand) || ' thing', upper(p_name), p_type] as aliases from part),
qs4 as (select p_partkey as query_id, case p_partkey % 7 when 0 then p_name when 1 then string_split(p_name, ' ')[1] when 2 then substr(p_name, 2, 4) when 3 then p_type when 4 then p_brand when 5 then substr(p_name, 1, 2) else p_type || ' siz' end as n from part),
"""


def _part_concepts(spark, folder):
    p = table(spark, folder, "part")
    aliases = F.array(F.concat(F.lower("p_brand"), F.lit(" thing")), F.upper("p_name"), F.col("p_type"))
    context = F.concat(F.lit("A "), "p_name", F.lit(" of "), "p_type", F.lit(" size"))
    d = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("symbol"), F.concat(F.lit("Formula "), "p_size").alias("label"), F.col("p_type").alias("section"), context.alias("context"), aliases.alias("aliases"))
    text = F.expr("case p_partkey % 7 when 0 then p_name when 1 then split(p_name, ' ')[0] when 2 then substring(p_name, 2, 4) when 3 then p_type when 4 then p_brand when 5 then substring(p_name, 1, 2) else concat(p_type, ' siz') end")
    return d, p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


_alias = f"select id, case when regexp_matches(fa.n, '^[a-z_]+_concept$') or fa.c = fs.c or len(list_filter(string_split_regex(fa.n, '{search.APART}'), lambda x: x <> '')) >= 5 or (alias = upper(alias) and len(list_filter(string_split_regex(fa.n, '{search.APART}'), lambda x: x <> '')) >= 2) then 'broad' else 'alias' end as field, 2 as least, alias as text from (select id, section, unnest(aliases) as alias from cc4) join fx fa on fa.text = alias join fx fs on fs.text = section"


@query("q4_score_concepts", f"""with {PART_CONCEPTS} qt as (select query_id, {_norm("n")} as n from qs4), q4 as (select query_id, n as variant from qt),
  {folded("select title as text from cc4 union all select symbol || ' ' || label from cc4 union all select context from cc4 union all select section from cc4 union all select unnest(aliases) from cc4 union all select variant from q4")},
  f4 as (select id, 'title' as field, 2 as least, title as text from cc4 union all select id, 'symbol', 2, symbol || ' ' || label from cc4 union all select id, 'context', 3, context from cc4 union all select id, 'section', 2, section from cc4 union all {_alias}),
  dq as (select distinct min(query_id) over (partition by variant) as query_id, variant from q4), {matched("f4", "dq")},
  s4 as (select query_id, id, max(case field when 'title' then case when equal then 880 when begins then 820 else 760 end when 'alias' then case when equal then 850 when begins then 800 else 740 end when 'symbol' then case when holds then 690 end when 'context' then case when holds then 610 end when 'section' then case when holds then 540 end else case when holds then 520 end end) as score from fm group by all)
  select query_id, id, cast(score as bigint) as score from s4 where score is not null""")
def _(spark, folder):
    """Each distinct text once, for the first part that asks it."""
    concepts, queries = _part_concepts(spark, folder)
    queries = queries.groupBy(search.normal(F.col("text")).alias("text")).agg(F.min("query_id").alias("query_id"))
    plan = queries.select("query_id", F.col("text").alias("variant"), F.lit("").alias("number"), F.lit(False).alias("mapped")).filter("variant != ''")
    return search.score_concepts(plan, concepts)


@query("q8_concept_grouping", f"with {REVIEW} select cast(substr(chapter_id, 8) as bigint) as query_id, lower(name) as title, max_by(concept_id, {{'s': conf, 'i': -concept_id}}) as best_id, max(conf) as score, count(*) as n, string_agg(distinct status, ',' order by status) as labels from rv group by all")
def _(spark, folder):
    c = concepts(spark, folder)
    return search.concept_grouping(c.select(F.substring("chapter_id", 8, 9).cast("long").alias("query_id"), F.col("concept_id").alias("id"), F.col("name").alias("title"), F.col("status").alias("label"), F.col("conf").alias("score")))
