"""The registered queries of this subpackage: each operator over its whole table, and SQL where it says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.work import bound_batches
from . import chat, decontam, html, langid, licenses, minhash, mixing, quality, resample, runs, simhash, suffix, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark, folder):
    return chat.render_chats(_table(spark, folder, "conversations"))


def op2_quality_rules(spark, folder):
    return quality.quality_cascade(_table(spark, folder, "documents")).drop("failed_rule")


def op3_html_extraction(spark, folder):
    return html.extract_pages(_table(spark, folder, "pages"))


def op4_suffix_dedup(spark, folder):
    return suffix.cut_repeats(_table(spark, folder, "documents"), texts=False).drop("kept")


def op5_language_id(spark, folder):
    return langid.language_of(_table(spark, folder, "documents"))


def op6_url_filters(spark, folder):
    return urls.filter_urls(_table(spark, folder, "pages"))


def op7_license_scans(spark, folder):
    return licenses.scan_licenses(_table(spark, folder, "documents"))


def op8_minhash_dedup(spark, folder):
    return minhash.near_duplicates(_table(spark, folder, "documents"), k=3, threshold=(85, 100))


def op9_source_mixing(spark, folder):
    return mixing.mix_sources(_table(spark, folder, "documents"))


def op10_decontamination(spark, folder):
    found = decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "item_id", "n_item", "covered", F.round("coverage", 6).alias("coverage"), "contaminated")


def op11_simhash_dedup(spark, folder):
    return simhash.near_fingerprints(_table(spark, folder, "documents"))


def op12_importance_resampling(spark, folder):
    return resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


#: The contract's planted repeats: the words of every tenth document, by a hash of its id, repeat from word a on with period p.
PLANTED = {
    "w": r"array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')",
    "h": "crc32(cast(cast(doc_id as string) as binary))",
    "n": "size(w)",
    "a": "cast(pmod(h div 10, greatest(n, 1)) as int)",
    "p": "cast(1 + (n - a) div (3 + pmod(h div 10, 8)) as int)",
    "text": "case when h % 10 = 0 and n > 0 then array_join(transform(sequence(0, n - 1), i -> get(w, if(i < a, i, a + (i - a) % p))), ' ') else text end",
}


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text")
    planted = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 10) = 0")
    some = d.filter(planted)
    for name, value in PLANTED.items():
        some = some.withColumn(name, F.expr(value))
    return some.select("doc_id", "text").union(d.filter(~F.coalesce(planted, F.lit(False))))


def op13_periodic_runs(spark, folder):
    found = runs.periodic_runs(with_planted_repeats(_table(spark, folder, "documents")))
    # greatest exponent first: lengths and periods are compared crosswise, so equal ratios tie exactly
    best = F.expr("""aggregate(slice(runs, 2, size(runs)), get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period
        or (r.length * b.period = b.length * r.period and (r.start, r.period) < (b.start, b.period)), r, b))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return found | {"pipeline": pipeline}


SQL = {
    "op1_chat_formatting": r"""
with t as (select conv_id, coalesce(role, 'user') as role, coalesce(text, '') as text, turn,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) as place from conversations),
p as (select *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by place) as prefix,
    count(*) over (partition by conv_id) as n from t),
w as (select prefix, n, min(conv_id) as conv_id, count(*) as n_copies from p where place = n group by all),
k as (select w.* from w where not exists (select 1 from p where p.place < p.n and p.place = w.n and p.prefix = w.prefix))
select k.conv_id, k.n as n_turns, k.n_copies, string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' order by t.place) as text
from k join t on t.conv_id = k.conv_id group by all
""",
    "op2_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, unnest(generate_series(1, len(w) - 2)) as i, w from w where len(w) >= 3),
h as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as c from g),
c as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from h where c > 1) group by r),
m as (select doc_id, text, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as up, length(regexp_replace(text, '[^\p{Ll}]+', '', 'g')) as low,
    length(regexp_replace(text, '[^!]+', '', 'g')) as bang from w left join c using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines or word_chars < 3 * n_words or word_chars > 12 * n_words
    or 100 * n_repeat_words > 30 * n_words or up > low or 10 * bang > n_words or 2 * (up + low) < word_chars) as kept from b
""",
}


SQL["op12_importance_resampling"] = r"""
with tab as (select list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t from (select unnest(generate_series(0, 255))::bigint as i)),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
w as (select r, unnest(w) as w from d),
m as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
v as (select w, hex(encode(w)) as x from (select w from w union select w from m)),
b as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(generate_series(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket from v, tab),
s as (select bucket, count(*) as s from w join b using (w) group by all), t as (select bucket, count(*) as t from m join b using (w) group by all),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from w) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from m) + 10000))))::bigint as gain
    from (select distinct bucket from b) left join s using (bucket) left join t using (bucket)),
f as (select r, sum(gain)::bigint as weight from w join b using (w) join g using (bucket) group by r),
x as (select r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join f using (r)),
k as (select r, row_number() over (order by score desc, doc_id) as rank from x where n_features >= 20 and score is not null),
n as (select 10 * count(*) // 100 as n from k)
select doc_id, n_features, weight, score, case when rank <= n then rank end as rank from x left join k using (r), n
"""


def oracle_sql() -> dict:
    return dict(SQL)
