"""Queries on segmentation: documents read as pages of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment
from .adapter import CORPUS, corpus, ranked, table
from .registry import query


def pages(spark, folder):
    d = table(spark, folder, "documents")
    head = F.expr("concat('# Chapter ', cast(substring(source, 4) as int) + 1, ': ', source, chr(10))")
    d = d.select("doc_id", F.concat("source", F.lit("_"), "lang").alias("book_id"), F.concat(head, "text").alias("text"))
    return ranked(d, "book_id", "doc_id").select("book_id", F.col("position").alias("page_index"), "text")


EVENTS = r"""
pg as (select source || '_' || lang as book_id, row_number() over (partition by source, lang order by doc_id) - 1 as page_index, '# Chapter ' || (cast(substr(source, 4) as int) + 1) || ': ' || source || chr(10) || text as text from documents),
ln as (select book_id, page_index, i - 1 as line_index, trim(l) as line from (select book_id, page_index, unnest(x) as l, generate_subscripts(x, 1) as i from (select *, string_split(text, chr(10)) as x from pg)) where trim(l) <> ''),
l1 as (select *, (length(line) - length(replace(line, '$$', ''))) // 2 as n, regexp_matches(line, '(?i)^(?:#{1,6}\s*)?(?:chapter|ch\.?)\s+(\d+)\b[:.\-\s]*(.*)$') as is_ch, regexp_matches(line, '(?i)^(?:#{1,6}\s*)?appendix\s+([A-Z]|\d+)\b[:.\-\s]*(.*)$') as is_app,
  regexp_matches(line, '^#{1,3}\s*(\d+)\s+(.+)$') as is_num, string_split(line, '$$') as p from ln),
l2 as (select *, is_ch or is_app or is_num as heading, coalesce(sum(case when (is_ch or is_app or is_num) and n = 1 then 1 else 0 end) over (partition by book_id, page_index order by line_index rows between unbounded preceding and 1 preceding), 0) as part from l1),
l3 as (select *, coalesce(sum(case when not heading and n = 1 then 1 else 0 end) over (partition by book_id, page_index, part order by line_index rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as open from l2),
l4 as (select *, heading and not open as live, n = 1 and not open and not heading as opens, n = 1 and open as closes from l3),
l5 as (select *, sum(opens::int) over (partition by book_id, page_index order by line_index) as span,
  case when live and is_ch then 'chapter' || cast(regexp_extract(line, '(?i)^(?:#{1,6}\s*)?(?:chapter|ch\.?)\s+(\d+)', 1) as int) end as c0,
  case when live and is_ch then coalesce(nullif(trim(regexp_extract(line, '(?i)^(?:#{1,6}\s*)?(?:chapter|ch\.?)\s+(\d+)\b[:.\-\s]*(.*)$', 2)), ''), 'Chapter ?') end as s0,
  case when live and is_ch then '' when live then trim(regexp_extract(line, '^#{1,3}\s*(\d+)\s+(.+)$', 2)) end as u0 from l4),
l6 as (select *, coalesce(last_value(c0 ignore nulls) over w, 'chapter1') as chapter_id, coalesce(last_value(s0 ignore nulls) over w, 'Chapter 1') as section, coalesce(last_value(u0 ignore nulls) over w, '') as subsection from l5
  window w as (partition by book_id order by page_index, line_index rows between unbounded preceding and current row)),
ev0 as (
  select book_id, page_index, line_index, section, subsection, chapter_id, 0 as seq, 'heading' as kind, case when is_ch then section else subsection end as text from l6 where live
  union all select book_id, page_index, line_index, section, subsection, chapter_id, 0, 'text', trim(p[1]) from l6 where not live and (n >= 2 or opens)
  union all select book_id, page_index, line_index, section, subsection, chapter_id, 1, 'formula', trim(p[2]) from l6 where not live and n >= 2
  union all select book_id, page_index, line_index, section, subsection, chapter_id, 2, 'text', trim(array_to_string(p[3:], '$$')) from l6 where not live and n >= 2
  union all select book_id, page_index, line_index, section, subsection, chapter_id, 2, 'text', trim(array_to_string(p[2:], '$$')) from l6 where closes
  union all select book_id, page_index, line_index, section, subsection, chapter_id, 0, 'text', line from l6 where not live and n = 0 and not open),
pc as (select *, case when opens then trim(array_to_string(p[2:], '$$')) when closes then trim(p[1]) when open and n = 0 then line end as body from l6),
blk as (select book_id, page_index, min(line_index) as line_index, min_by(section, line_index) as section, min_by(subsection, line_index) as subsection, min_by(chapter_id, line_index) as chapter_id, 1 as seq, 'formula' as kind,
  coalesce(string_agg(body, chr(10) order by line_index) filter (body <> ''), '') as text from pc where body is not null group by book_id, page_index, span having bool_or(closes)),
events as (select * from ev0 where text <> '' or kind = 'formula' union all by name select * from blk where text <> ''),
gaps as (select *, sum((kind = 'formula')::int) over (partition by book_id order by page_index, line_index, seq) as gap from events),
tx as (select book_id, gap, list(text order by page_index, line_index, seq) as t from gaps where kind = 'text' group by all),
ctx as (select g.*, coalesce(array_to_string(b.t[-3:], ' '), '') as before_text, coalesce(array_to_string(a.t[:3], ' '), '') as after_text from gaps g left join tx b on b.book_id = g.book_id and b.gap = g.gap - 1 left join tx a on a.book_id = g.book_id and a.gap = g.gap where kind = 'formula'),
num as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '^\$+|\$+$', '', 'g'), '\\tag\{[^{}]+\}', '', 'g'), '(?i)\((A?\d+(?:\.\d+)+[a-z]?)\)', '', 'g'), '\s+', ' ', 'g')) as latex,
  coalesce(nullif(regexp_extract(text, '(?i)\((A?\d+(?:\.\d+)+[a-z]?)\)', 1), ''), nullif(regexp_extract(after_text, '(?i)\((A?\d+(?:\.\d+)+[a-z]?)\)', 1), '')) as number from ctx),
ids as (select *, row_number() over (partition by book_id order by page_index, line_index, seq) - 1 as position, coalesce(number, substr(chapter_id, 8) || '.u' || lpad(cast(row_number() over (partition by book_id, chapter_id, number is null order by page_index, line_index, seq) as varchar), 3, '0')) as raw_id from num where latex <> ''),
recs as (select *, row_number() over (partition by book_id, raw_id order by position) as twin, number is not null as numbered, trim(concat_ws(' ', nullif(before_text, ''), nullif(after_text, ''))) as context_text from ids),
scored as (select *, 'formula_' || raw_id || case when twin > 1 then '_dup' || twin else '' end as formula_id, twin > 1 as duplicate,
  greatest(5, 98 - 20 * (not numbered)::int - 18 * (twin > 1)::int - 28 * (length(latex) < 6 or not regexp_matches(latex, '[A-Za-z\\]'))::int - 12 * (length(context_text) < 32)::int - 25 * (length(replace(latex, '{', '')) <> length(replace(latex, '}', '')))::int) as conf from recs)
"""


def records(spark, folder):
    return segment.score_formula(segment.assign_formula_ids(segment.attach_context(segment.segment_events(pages(spark, folder)))))


@query("n1_segment_events", f"with {EVENTS} select book_id, page_index, line_index, seq, kind, text, section, subsection, chapter_id from events")
def _(spark, folder):
    return segment.segment_events(pages(spark, folder)).drop("chapter")


@query("n2_clean_formula", f"with {EVENTS} select book_id, page_index, line_index, latex from num where latex <> ''")
def _(spark, folder):
    return records(spark, folder).select("book_id", "page_index", "line_index", "latex")


@query("n5_formula_ids", f"with {EVENTS} select book_id, formula_id, raw_id, position, duplicate, numbered from scored")
def _(spark, folder):
    return records(spark, folder).select("book_id", "formula_id", "raw_id", "position", "duplicate", "numbered")


@query("n6_context", f"with {EVENTS} select book_id, page_index, line_index, seq, before_text, after_text from ctx")
def _(spark, folder):
    return segment.attach_context(segment.segment_events(pages(spark, folder))).select("book_id", "page_index", "line_index", "seq", "before_text", "after_text")


@query("n7_score_formula", f"with {EVENTS} select book_id, formula_id, cast(conf as bigint) as conf, conf < 75 as is_low_confidence from scored")
def _(spark, folder):
    return records(spark, folder).select("book_id", "formula_id", "conf", "is_low_confidence")


@query("n3_formula_number", rf"""with {CORPUS} select formula_id, nullif(regexp_extract('(' || raw_id || ')', '(?i)\((A?\d+(?:\.\d+)+[a-z]?)\)', 1), '') as number, regexp_extract(context_text, '(?i)\b(A?\d+(?:\.\d+)+[a-z]?)\b', 1) as loose from corpus""")
def _(spark, folder):
    f = corpus(spark, folder)
    return f.select("formula_id", segment.formula_number(F.lit("x"), F.concat(F.lit("see ("), "raw_id", F.lit(")"))).alias("number"), segment.formula_number(F.lit("x"), F.regexp_extract("context_text", r"^(\S+ \S+)\. ", 1)).alias("loose"))


@query("n4_chapter_from_number", f"with {CORPUS} select formula_id, chapter_id, chapter from corpus")
def _(spark, folder):
    chapter_id, chapter = segment.chapter_from_number(F.col("raw_id"))
    return corpus(spark, folder).select("formula_id", chapter_id.alias("chapter_id"), chapter.alias("chapter"))


@query("n8_structured_formulas", r"""select 'formula_A' || regexp_extract(chapter_id, '(\d+)$', 1) || '.' || row_number() over (partition by chapter_id order by doc_id, i) as formula_id, chapter_id, latex, context_text from (
  select *, unnest(x) as latex, generate_subscripts(x, 1) as i from (select doc_id, 'appendix' || (cast(substr(source, 4) as int) + 1) as chapter_id, regexp_extract_all(text, '(?s)\$\$\s*(.*?)\s*\$\$', 1) as x, trim(regexp_replace(text, '(?s)\$\$.*?\$\$', ' ', 'g')) as context_text from documents)) where length(latex) >= 4""")
def _(spark, folder):
    d = table(spark, folder, "documents").select(F.expr("concat('appendix', cast(substring(source, 4) as int) + 1)").alias("chapter_id"), F.col("doc_id").alias("block_order"), F.col("text").alias("content"))
    return segment.extract_structured_formulas(d)


@query("n9_mention_positions", rf"""with {CORPUS}, m as (select chapter_id, position as b, unnest(x) as raw_id, generate_subscripts(x, 1) as o from (select chapter_id, position, list_concat(regexp_extract_all(c, '\[\[(?:SEE_)?FORMULA:(\d+(?:\.\d+)?[a-z]?)\]\]', 1), regexp_extract_all(c, '(?i)\bEquations?\s+(\d+(?:\.\d+)?[a-z]?)', 1), regexp_extract_all(c, '\((\d+\.\d+[a-z]?)\)', 1)) as x
    from (select chapter_id, position, context_text || ' [[FORMULA:' || raw_id || ']] (' || raw_id || ')' as c from corpus)))
  select chapter_id, raw_id, row_number() over (partition by chapter_id order by f) - 1 as position from (select chapter_id, raw_id, min({{'b': b, 'o': o}}) as f from m group by all)""")
def _(spark, folder):
    f = corpus(spark, folder)
    return segment.formula_mention_positions(f.select("chapter_id", F.col("position").alias("block_order"), F.concat("context_text", F.lit(" [[FORMULA:"), "raw_id", F.lit("]] ("), "raw_id", F.lit(")")).alias("content")))


STOP_WORDS = ["and", "are", "for", "from", "into", "that", "the", "this", "where", "which", "with"]


def _keyword_sql(pattern, k, stop):
    cond = f"and lower(w) not in ({', '.join(repr(x) for x in stop)})" if stop else ""
    return f"""with {CORPUS}, k as (select formula_id, unnest(x) as w, generate_subscripts(x, 1) as p from (select formula_id, regexp_extract_all(context_text, '{pattern}') as x from corpus)),
      f as (select formula_id, lower(w) as l, min(p) as p, min_by(w, p) as w from k where true {cond} group by all) select * from (select formula_id, row_number() over (partition by formula_id order by p) - 1 as ordinal, w as keyword from f) where ordinal < {k}"""


@query("n11_keywords_chapter", _keyword_sql("[A-Za-z0-9]{3,}", 24, None))
def _(spark, folder):
    return segment.keywords(corpus(spark, folder).withColumn("text", F.col("context_text")))


@query("n11_keywords_search", _keyword_sql("[A-Za-z][A-Za-z0-9_-]{2,}", 16, STOP_WORDS))
def _(spark, folder):
    return segment.keywords(corpus(spark, folder).withColumn("text", F.col("context_text")), 16, "[A-Za-z][A-Za-z0-9_-]{2,}", STOP_WORDS)
