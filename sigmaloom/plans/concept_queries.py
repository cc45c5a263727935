"""Queries on symbols in LaTeX (from lineitem) and on concepts (from part) and vectors (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, symbols
from ..operators.components import connected_components
from .adapter import table
from .registry import query

#: Eight shapes of formulas; {s} and {t} are numbers of the row. Beside each: its symbols in order, and how many of them it defines.
SHAPES = [
    (r"x_{{s}} = \sigma_{{t}}^{2} + y_{s} + x", [r"x_{{s}}", r"\sigma_{{t}}^{2}", "y_{s}", "x"], 1),
    (r"\overline{W}_{{s}} = \dfrac{1}{n} \sum_{i=1}^{n} p_{s}", [r"\overline{W}_{{s}}", "n", "p_{s}"], 1),
    (r"\sum_{i=1}^{n} x_{s} = y_{t}", ["x_{s}", "y_{t}"], 1),
    (r"E(x_{s}) = \mu_{t}", ["x_{s}", r"\mu_{t}"], 1),
    (r"\sigma(x_{s}, y_{t}) = r", [r"\sigma", "x_{s}", "y_{t}", "r"], 0),
    (r"a^{b} + b = c_{s}", ["a^{b}", "b", "c_{s}"], 2),
    (r"u_{s} + \xi", ["u_{s}", r"\xi"], 1),
    (r"\hat{\beta}_{{s}} = \Var(z_{t})", [r"\hat{\beta}_{{s}}", "z_{t}"], 1),
]


def _sql(shape: str) -> str:
    return "'" + shape.replace("{s}", "' || s || '").replace("{t}", "' || t || '") + "'"


LATEX = f"""
lx as (select distinct l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as formula_id, (l_orderkey + l_linenumber) % 8 as k, cast(l_suppkey % 50 as varchar) as s, cast(l_partkey % 40 as varchar) as t from lineitem),
toks as (select formula_id, k, case k {' '.join(f"when {i} then [{', '.join(map(_sql, found))}]" for i, (_, found, _n) in enumerate(SHAPES))} end as z from lx),
occ3 as (select formula_id, k, unnest(z) as symbol, generate_subscripts(z, 1) - 1 as ordinal from toks),
occ2 as (select formula_id, symbol, ordinal from occ3),
kinds as (select *, ordinal < [{', '.join(str(n) for *_, n in SHAPES)}][k + 1] as defined from occ3)
"""
WHOLE = r"not (k = 0 and symbol = 'x') and not (k = 4 and symbol = '\sigma')"


def latex(spark, folder):
    d = table(spark, folder, "lineitem")
    shape = F.element_at(F.array(*[F.lit(x) for x, *_ in SHAPES]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8 + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{s}"), (F.col("l_suppkey") % 50).cast("string")), F.lit("{t}"), (F.col("l_partkey") % 40).cast("string"))
    return d.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("formula_id"), text.alias("latex")).distinct()


@query("x1_symbol_occurrences", f"with {LATEX} select * from occ2")
def _(spark, folder):
    return symbols.symbol_occurrences(latex(spark, folder))


@query("x2_defined_symbols", f"with {LATEX} select formula_id, symbol, case when defined then 'defined' else 'used' end as kind from kinds")
def _(spark, folder):
    f = latex(spark, folder)
    return symbols.defined_symbols(f, symbols.symbol_occurrences(f))


@query("x3_fragment_suppression", f"with {LATEX} select formula_id, symbol, ordinal from occ3 where {WHOLE}")
def _(spark, folder):
    return symbols.whole_symbols(latex(spark, folder))


KEYS = r"""
k4 as (select symbol, canonical, regexp_replace(regexp_replace(regexp_replace(canonical, '\\(?:overline|hat)', ''), '[_^](?:\\?[A-Za-z0-9]+)', '', 'g'), '[{}]', '', 'g') as family, regexp_extract(canonical, '^([^_^]*)', 1) as base, regexp_extract(canonical, '_([^^]*)', 1) as subscript, regexp_extract(canonical, '\^(.*)$', 1) as superscript, regexp_extract(canonical, '^\\(overline|hat)\{', 1) as accent
  from (select distinct symbol, regexp_replace(symbol, '([_^])\{([^{}]*)\}', '\1\2', 'g') as canonical from occ2))
"""


@query("x4_symbol_keys", f"with {LATEX}, {KEYS} select * from k4")
def _(spark, folder):
    return symbols.symbol_keys(symbols.symbol_occurrences(latex(spark, folder)))


@query("x5_symbol_role", rf"with {LATEX}, {KEYS} select symbol, case when starts_with(canonical, '\sigma_') then 'statistic_variance' when canonical in ('\sigma', '\xi') or length(canonical) = 1 then 'variable' when regexp_matches(canonical, '^[A-Za-z]+_[A-Za-z0-9]+$') then 'parameter' else 'symbol' end as role, false as is_operator from k4")
def _(spark, folder):
    return symbols.symbol_role(symbols.symbol_keys(symbols.symbol_occurrences(latex(spark, folder)))).select("symbol", "role", "is_operator")


def concepts(spark, folder):
    d = table(spark, folder, "part")
    return d.select(F.col("p_partkey").alias("concept_id"), F.concat(F.lit("chapter"), F.col("p_size") % 5).alias("chapter_id"), F.col("p_name").alias("name"), F.concat_ws(" ", F.col("p_type"), F.col("p_brand")).alias("alias"), (50 + F.col("p_partkey") % 50).cast("long").alias("conf"))


CONCEPTS = r"""
cc as (select p_partkey as concept_id, 'chapter' || (p_size % 5) as chapter_id, p_name as name, p_type || ' ' || p_brand as alias, cast(50 + p_partkey % 50 as bigint) as conf from part),
tok as (select concept_id, list_transform(list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'), '\s+'), lambda t: t <> ''), lambda t: case when length(t) > 4 and suffix(t, 'ies') then t[:-4] || 'y' when length(t) > 3 and suffix(t, 's') and not suffix(t, 'ss') then t[:-2] else t end) as nt,
  list_transform(list_filter(string_split_regex(regexp_replace(lower(alias), '[^a-z0-9 ]+', ' ', 'g'), '\s+'), lambda t: t <> ''), lambda t: case when length(t) > 4 and suffix(t, 'ies') then t[:-4] || 'y' when length(t) > 3 and suffix(t, 's') and not suffix(t, 'ss') then t[:-2] else t end) as alt from cc),
mk as (select cc.*, array_to_string(nt, ' ') as normalized_name, array_to_string(nt, ' ') as synonym_name, array_to_string(alt, ' ') as alias_key from cc join tok on tok.concept_id = cc.concept_id),
m2 as (
  select f as left, concept_id as right, reason, cast(score as bigint) as score from (
    select concept_id, reason, score, min(concept_id) over (partition by chapter_id, reason, key) as f from (
      select concept_id, chapter_id, 'exact_normalized_name' as reason, 1000 as score, normalized_name as key from mk union all select concept_id, chapter_id, 'synonym_normalized_name', 960, synonym_name from mk union all select concept_id, chapter_id, 'alias_overlap', 940, alias_key from mk)
    where length(key) >= 4 and len(list_filter(string_split(key, ' '), lambda t: length(t) > 3)) > 0) where f <> concept_id),
fn as (select chapter_id, normalized_name as nm, min(concept_id) as id from mk where length(normalized_name) >= 4 and len(list_filter(string_split(normalized_name, ' '), lambda t: length(t) > 3)) > 0 group by all),
gr as (select *, list_transform(generate_series(1, length(nm) - 1), lambda i: substr(nm, i, 2)) as g, string_split(nm, ' ') as t from fn),
gc as (select chapter_id, id, gram, count(*) as c from (select chapter_id, id, unnest(g) as gram from gr) group by all),
ov as (select a.id as x, b.id as y, sum(least(a.c, b.c)) as o from gc a join gc b on a.chapter_id = b.chapter_id and a.gram = b.gram and a.id < b.id group by all),
m3 as (select a.id as left, b.id as right, 'lexical_similarity' as reason, cast(greatest(
    case when least(len(a.t), len(b.t)) >= 2 and len(list_intersect(a.t, b.t)) >= least(len(a.t), len(b.t)) then greatest(820, 930 - 30 * abs(len(a.t) - len(b.t))) else 0 end,
    round(len(list_intersect(a.t, b.t)) * 1000.0 / len(list_distinct(list_concat(a.t, b.t)))), round(2000.0 * coalesce(o, 0) / (len(a.g) + len(b.g)))) as bigint) as score
  from gr a join gr b on a.chapter_id = b.chapter_id and a.id < b.id left join ov on ov.x = a.id and ov.y = b.id)
"""


def keyed(spark, folder):
    return merge.name_keys(concepts(spark, folder))


@query("m1_name_keys", f"with {CONCEPTS} select concept_id, normalized_name, synonym_name, alias_key from mk")
def _(spark, folder):
    return keyed(spark, folder).select("concept_id", "normalized_name", "synonym_name", "alias_key")


@query("m2_key_linkage", f"with {CONCEPTS} select * from m2")
def _(spark, folder):
    return merge.key_linkage(keyed(spark, folder))


@query("m3_lexical_similarity", f"with {CONCEPTS} select * from m3 where score >= 700")
def _(spark, folder):
    return merge.lexical_similarity_join(keyed(spark, folder), 700)


#: Every vector, and one that drifted from it towards the next vector of the table by 0.2 to 0.65 of it.
VECTORS = """
vec as (select vec_id as id, label, embedding::double[] as e, lead(embedding::double[]) over (order by vec_id) as f from embeddings),
vecs as (select 2 * id as id, label, e from vec union all select 2 * id + 1, label, list_transform(list_zip(e, f), lambda x: x[1] + (0.2 + 0.05 * (id % 10)) * x[2]) from vec where f is not null)
"""


def _vectors(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("chapter_id"), F.col("embedding").cast("array<double>").alias("e"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    near = F.zip_with("e", "f", lambda x, y: x + (F.lit(0.2) + F.lit(0.05) * (F.col("vec_id") % 10)) * y)
    drifted = v.join(after, "vec_id").select((2 * F.col("vec_id") + 1).alias("id"), "chapter_id", near.alias("embedding"))
    return v.select((2 * F.col("vec_id")).alias("id"), "chapter_id", F.col("e").alias("embedding")).union(drifted)


@query("m4_embedding_similarity", f"with {VECTORS} select a.id as left, b.id as right, round(list_cosine_similarity(a.e, b.e), 4) as score from vecs a join vecs b on a.label = b.label and a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.3")
def _(spark, folder):
    return merge.embedding_similarity_join(_vectors(spark, folder), 0.3)


PARTS = f"""{CONCEPTS}, lk as (select "left", "right", reason, score from m2 union all select * from m3 where score >= 700),
und as (select distinct "left" as a, "right" as b from lk union select "right", "left" from lk),
cp as (select a, min(b) as r from (select a, a as b from und union all select a, b from und) group by all),
reach(a, b) as (select a, b from und union select reach.a, und.b from reach join und on und.a = reach.b),
comp as (select a as id, least(a, min(b)) as component from reach group by a)"""


@query("m5_connected_components", f"with recursive {PARTS} select id, component from comp")
def _(spark, folder):
    k = keyed(spark, folder)
    return connected_components(merge.key_linkage(k).union(merge.lexical_similarity_join(k, 700)))


@query("m6_merge_groups", f"""with recursive {PARTS}, l2 as (select component, max(score) as score, string_agg(distinct reason, ',' order by reason) as reasons from lk join comp on comp.id = lk."left" group by all)
  select component, chapter_id, count(*) as n_members, max_by(concept_id, {{'c': conf, 'i': -concept_id}}) as canonical_id, score, reasons, case when score >= 960 then 'high' when score >= 900 then 'medium' else 'low' end as priority
  from mk join comp on comp.id = mk.concept_id join l2 using (component) group by component, chapter_id, score, reasons""")
def _(spark, folder):
    k = keyed(spark, folder)
    links = merge.key_linkage(k).union(merge.lexical_similarity_join(k, 700))
    return merge.merge_groups(k, links, connected_components(links))
