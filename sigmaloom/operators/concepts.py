"""The concept graph lifted from formulas: views, references, overlays, search entries. Confidences are whole hundredths."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.work import written
from .symbols import GREEK


#: Wordings of generated copy that must not be published.
UNSAFE_COPY = [
    "由当前支撑公式引入", "局部数学量", "当前公式涉及", "背景概念", "概念定义", "教材引入", "待审阅", "上下文线索", "由邻近段落支撑",
    "(?i)local mathematical quantity", "(?i)supporting formula", "(?i)local formula context", "帮你把符号", "标记的是", "(?i)places the symbol back", "(?i)marks the object",
]


#: What a sentence does for a formula, by the words that tell it, first match first; and what is said where none does.
MOVES = [
    ("recalls prior equations to propose an estimator", r"(?i)\brecalling\b.*\b(suggests?|estimator|approach)\b"),
    ("introduces an estimator", r"(?i)\bestimat(?:or|e|ed|ing)\b"),
    ("defines a quantity explicitly", r"(?i)\bdefined\s+as\b"),
    ("names a quantity used in the literature", r"(?i)\b(?:called|denoted\s+by)\b"),
    ("sets notation before the formula", r"(?i)\b(?:let|letting)\b"),
    ("explains symbols with a where clause", r"(?i)\bwhere\b"),
]
NO_MOVE = "uses nearby prose as formula evidence"


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def sentences_of(text: Column) -> Column:
    """The sentences of a text of single spaces: what ends in a full stop, question or exclamation mark before a space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n"), lambda x: F.trim(x) != "")


def teaching_move(texts: DataFrame, moves: list[tuple[str, str]] = MOVES) -> DataFrame:
    """(id, move, sentence): of texts(id, text) the first move whose pattern a sentence matches, at its first sentence; else NO_MOVE and the first sentence, up to 210 characters.

    Displayed formulas are taken out first; a text without words gives no row. One pass over each text, no join.
    """
    whole = F.col("whole")
    d = texts.select("id", spaced(F.col("text")).alias("whole")).filter("whole != ''")
    d = d.withColumn("s", sentences_of(F.regexp_replace(whole, r"(?s)\$\$.*?\$\$", " [formula] ")))
    hits = [F.when(_first_match(p).isNotNull(), F.struct(F.lit(move).alias("move"), _first_match(p).alias("sentence"))) for move, p in moves]
    first = F.struct(F.lit(NO_MOVE).alias("move"), F.coalesce(F.get("s", F.lit(0)), whole).alias("sentence"))
    return d.withColumn("h", F.coalesce(*hits, first)).select("id", "h.move", F.substring(spaced(F.col("h.sentence")), 1, 210).alias("sentence"))


def _first_match(pattern: str) -> Column:
    return F.get(F.filter("s", lambda x: x.rlike(pattern)), F.lit(0))


def unique_concept_ids(concepts: DataFrame, base: str, order: str) -> DataFrame:
    """C4: (+ concept_id): in order of the whole number ``order``, the first free one of the base id, the base id with _2, _3 and so on.

    An id is free if no row before has taken it, be it its own base id ("a", "a", "a_2": a, a_2, a_2_2). Number k of a base
    is contested only where "base_k" is a base id too: the latter's first row gets it unless so many rows of the base came
    before that they reached k. A base's free numbers then go to its rows by rank. Bases are decided from the shortest to
    those that extend them, one round a level; without such bases there is no round.
    """
    rows = concepts.withColumn("_r", F.row_number().over(Window.partitionBy(base).orderBy(order)))
    known = concepts.groupBy(F.col(base).alias("b")).agg(F.min(order).alias("first")).filter("b is not null")
    form = r"^(.+)_([2-9]|[1-9]\d+)$"
    kids = known.select(F.col("b").alias("kid"), F.regexp_extract("b", form, 1).alias("b"), F.regexp_extract("b", form, 2).try_cast("long").alias("k"), "first")
    kids = written(kids.filter("k is not null").join(known.select("b"), "b", "left_semi"), "id-kids")
    number = F.col("_r")
    if not kids.isEmpty():
        # rows of the base before the first row of each base that extends it
        marks = rows.select(F.col(base).alias("b"), F.col(order).alias("o"), F.lit(None).cast("string").alias("kid"), F.lit(None).cast("long").alias("k")).join(kids.select("b").distinct(), "b", "left_semi")
        marks = marks.union(kids.select("b", "first", "kid", "k")).withColumn("r", F.count(F.when(F.col("kid").isNull(), 1)).over(Window.partitionBy("b").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)))
        asked = marks.filter("kid is not null").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("k", "r", "kid"))).alias("asked"))
        asked = written(asked, "id-asked")
        # ``gone``: the numbers of a base that others hold, its own id (1) among them where its parent took that
        level = asked.select("b").join(kids.select(F.col("kid").alias("b")), "b", "left_anti").withColumn("lost", F.lit(False))
        done, gone = None, []
        while True:
            pick = F.aggregate("asked", F.when(F.col("lost"), F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>")), lambda g, x: F.when(x["r"] >= x["k"] - F.size(g), g).otherwise(F.array_append(g, x["k"])))
            done = written(level.join(asked, "b", "left").withColumn("gone", F.when(F.col("asked").isNull(), F.when(F.col("lost"), F.array(F.lit(1).cast("long")))).otherwise(pick)), "id-level")
            gone.append(done.select("b", "gone"))
            level = done.filter("asked is not null").select("gone", F.explode("asked").alias("x")).select(F.col("x.kid").alias("b"), (~F.array_contains("gone", F.col("x.k"))).alias("lost"))
            if level.isEmpty():
                break
        every = functools.reduce(DataFrame.union, gone).filter("size(gone) > 0").withColumnRenamed("b", base)
        rows = rows.join(every, base, "left")
        passed = F.size(F.filter("gone", lambda k, i: k - i <= F.col("_r")))
        number = F.col("_r") + F.when(F.col("gone").isNull(), 0).otherwise(passed)
    return rows.withColumn("concept_id", F.when(number == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), number))).select(*concepts.columns, "concept_id")


def prerequisite_concepts(senses: DataFrame, edges: DataFrame) -> DataFrame:
    """(formula_id, ordinal, ref_id, symbol): what the targets of a formula's edges define, except group edges, in order of the target's place."""
    s = senses.select(F.col("formula_id").alias("target_id"), F.col("sense_id").alias("ref_id"), "position", "symbol")
    d = edges.filter("evidence != 'compound_group'").join(s, "target_id").groupBy(F.col("dependent_id").alias("formula_id"), "position", "ref_id").agg(F.first("symbol").alias("symbol"))
    return d.select("formula_id", (F.row_number().over(Window.partitionBy("formula_id").orderBy("position", "ref_id")) - 1).cast("long").alias("ordinal"), "ref_id", "symbol")


def introduced_concepts(used: DataFrame, prerequisites: DataFrame, senses: DataFrame, limit: int = 10) -> DataFrame:
    """(formula_id, ordinal, symbol): used symbols that neither the formula nor its prerequisites define, the first ``limit``.

    used(formula_id, symbols): a formula's distinct symbols in order, which meet what is known as one list, so that no use moves.
    """
    known = prerequisites.select("formula_id", "symbol").union(senses.select("formula_id", "symbol")).groupBy("formula_id").agg(F.collect_set("symbol").alias("_known"))
    left = F.array_except("symbols", F.coalesce("_known", F.array().cast("array<string>")))
    d = used.join(known, "formula_id", "left").select("formula_id", F.posexplode(F.slice(left, 1, limit)).alias("ordinal", "symbol"))
    return d.select("formula_id", F.col("ordinal").cast("long").alias("ordinal"), "symbol")


def reference_dedupe(refs: DataFrame) -> DataFrame:
    """(owner, key, name, conf, n): refs(owner, ordinal, name, symbol, conf) merged by lower name and base symbol: first name, most confidence."""
    key = F.concat_ws(":", F.lower("name"), F.lower(F.regexp_extract("symbol", r"^([^_^]*)", 1)))
    return refs.groupBy("owner", key.alias("key")).agg(F.min_by("name", F.struct("ordinal", "name")).alias("name"), F.max("conf").alias("conf"), F.count("*").alias("n"))


def concept_summary(views: DataFrame, prerequisites: DataFrame, introduced: DataFrame) -> DataFrame:
    """Per chapter and over all (``all``): views, prerequisite and introduced edges; views(formula_id, chapter_id)."""
    n = lambda d, name: d.groupBy("formula_id").agg(F.count("*").alias(name))
    d = views.join(n(prerequisites, "pre"), "formula_id", "left").join(n(introduced, "intro"), "formula_id", "left")
    t = d.rollup("chapter_id").agg(F.count("*").alias("concept_views"), F.coalesce(F.sum("pre"), F.lit(0)).alias("prerequisite_edges"), F.coalesce(F.sum("intro"), F.lit(0)).alias("introduced_edges"))
    return t.select(F.coalesce("chapter_id", F.lit("all")).alias("chapter_id"), "concept_views", "prerequisite_edges", "introduced_edges")


def calibration_overlay(concepts: DataFrame, curated: DataFrame, available: DataFrame) -> DataFrame:
    """concepts(key, formula_id, name) with curated(key, formula_id, name) names; curated rows that are new enter if their formula is available."""
    c = curated.select(F.col("key").alias("_k"), F.col("name").alias("_n"))
    old = concepts.join(c, F.col("key") == F.col("_k"), "left").select("key", "formula_id", F.coalesce("_n", "name").alias("name"))
    new = curated.join(concepts.select("key"), "key", "left_anti").join(available.select("formula_id"), "formula_id", "left_semi")
    return old.union(new.select("key", "formula_id", "name"))


def review_merge(concepts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """concepts(key, concept_id, name, status) keeping name and status of reviewed rows with real work, by key, else by concept id."""
    r = reviewed.filter("status != 'unreviewed'")
    by_key = r.groupBy(F.col("key").alias("_k")).agg(F.min(F.struct("name", "status")).alias("a"))
    by_id = r.groupBy(F.col("concept_id").alias("_i")).agg(F.min(F.struct("key", "name", "status")).alias("b"))
    d = concepts.join(by_key, F.col("key") == F.col("_k"), "left").join(by_id, F.col("concept_id") == F.col("_i"), "left")
    return d.select("key", "concept_id", F.coalesce("a.name", "b.name", "name").alias("name"), F.coalesce("a.status", "b.status", "status").alias("status"))


def nested_references(prerequisites: DataFrame, owner_of: DataFrame, limit: int = 6) -> DataFrame:
    """C11: (formula_id, ref_id, nested): for each reference the first ``limit`` references of the formula that defines it, as a comma list."""
    first = prerequisites.filter(F.col("ordinal") < limit).groupBy("formula_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "ref_id"))), lambda x: x["ref_id"]), ",").alias("nested"))
    own = owner_of.select(F.col("sense_id").alias("ref_id"), F.col("formula_id").alias("o")).join(first.withColumnRenamed("formula_id", "o"), "o", "left").drop("o")
    return prerequisites.select("formula_id", "ref_id").join(own, "ref_id").select("formula_id", "ref_id", F.coalesce("nested", F.lit("")).alias("nested"))


def default_view(views: DataFrame, core: list[str], generic: list[str]) -> DataFrame:
    """(formula_id, concept_id): of views(formula_id, concept_id, name, conf) the best by confidence, 8 for a core word, less 10 for a generic one."""
    low = F.lower("name")
    score = F.col("conf") + F.when(F.exists(F.split(low, " "), lambda t: t.isin(core)), 8).otherwise(0) - F.when(low.isin(generic), 10).otherwise(0)
    return views.groupBy("formula_id").agg(F.max_by("concept_id", F.struct(score, "concept_id")).alias("concept_id"))


def concept_search_index(concepts: DataFrame) -> DataFrame:
    """C14: (name, n, aliases): per name the distinct aliases without regard to case, sorted, as a comma list."""
    return concepts.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.lower("alias"))), ",").alias("aliases"))


def release_consistency(index: DataFrame, views: DataFrame, search: DataFrame) -> DataFrame:
    """A5: (check, n): chapters whose indexed view count differs, and search items without a view."""
    counts = views.groupBy("chapter_id").agg(F.count("*").alias("found"))
    differ = index.join(counts, "chapter_id", "full").filter("not (coalesce(concept_views, 0) = coalesce(found, 0))")
    dangling = search.join(views.select("formula_id"), F.col("id") == F.col("formula_id"), "left_anti")
    one = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return one("count_differs", differ).union(one("dangling_search_item", dangling))


def view_lint(views: DataFrame, generic: list[str]) -> DataFrame:
    """(id, violation), one row each, of views(id, name, definition)."""
    checks = [("missing_name", F.trim(F.coalesce("name", F.lit(""))) == ""), ("generic_name", F.lower("name").isin(generic)), ("missing_definition", F.trim(F.coalesce("definition", F.lit(""))) == ""), ("unsafe_copy", F.coalesce(F.col("definition").rlike("|".join(f"(?:{x})" for x in UNSAFE_COPY)), F.lit(False)))]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return views.select("id", F.explode(found).alias("violation"))


def internal_key_scan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, key): internal keys at any depth of rows(id, json)."""
    found = F.array_distinct(F.regexp_extract_all("json", F.lit(r'"([A-Za-z_]+)"\s*:'), F.lit(1)))
    return rows.select("id", F.explode(F.array_intersect(found, F.array(*map(F.lit, keys)))).alias("key"))


#: Titles and symbols that say too little, general aliases, and words of a title that outweigh those.
GENERIC_TITLES = [
    r"^formula\s+\S+\s+result$", r"\bformula\b.*\bconcept\b", r"^(?:int|sum|frac|left|right|power|sub|sup|is clearly|where|if |then |[a-z] (?:sub|power))",
    r"(?:sub|power|simeq|frac|left|right).*(?:sub|power|simeq|frac|left|right)", r"\b(?:being considered|clearly too restrictive|relationship)\b",
]
GENERIC_SYMBOLS = r"\\int|\\sum|\\frac"
GENERAL_ALIASES = r"(?i)\b(?:quantity_concept|theorem_or_principle)\b"
TELLING_TITLES = "(?i)hka|mcdonald|kreitman|likelihood|probability density|fitness|adaptive|substitution|neutrality|order term"


def generic_concept() -> Column:
    """Whether a row (concept_id, title, symbol, aliases) says too little to stand for its chapter; nulls count as empty."""
    concept_id, title, symbol, aliases = (F.coalesce(x, F.lit("")) for x in ("concept_id", "title", "symbol", "aliases"))
    title = F.trim(title)
    wordy = F.regexp_count(title, F.lit(r"\S+")) > 4
    odd_symbol = (F.length(F.trim(symbol)) > 26) | symbol.rlike(GENERIC_SYMBOLS)
    general = aliases.rlike(GENERAL_ALIASES) & ~title.rlike(TELLING_TITLES)
    return F.lower(concept_id).endswith("_statement") | F.lower(title).rlike("|".join(f"(?:{x})" for x in GENERIC_TITLES)) | wordy | odd_symbol | general


def concept_entry_ranking(views: DataFrame, spine: DataFrame) -> DataFrame:
    """(chapter_id, rank, title, score): the entries of each chapter, scores in hundredths.

    views(chapter_id, concept_id, title, symbol, aliases, context, backbone, representative, in_section): 80 on the
    backbone, 55 as a representative, 18 with a symbol, an 18th of the context's length up to 24, 8 with aliases, 6 in
    the hinted section, less 85 if generic. Equal titles and symbols are one entry with its best view's score and 3 a
    view up to 24. Generic entries stand only where a chapter has no other. 3 for each 4 formulas of
    spine(chapter_id, n_backbone), at least 5 and at most 10.
    """
    on = lambda c, points: F.when(c, points).otherwise(0)
    text = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    context = F.least(F.lit(2400), F.floor(100 * F.length(F.coalesce("context", F.lit(""))) / 18))
    score = on(F.col("backbone"), 8000) + on(F.col("representative"), 5500) + on(F.coalesce("symbol", F.lit("")) != "", 1800) + context
    score = score + on(F.coalesce("aliases", F.lit("")) != "", 800) + on(F.col("in_section"), 600) - on(F.col("generic"), 8500)
    d = views.withColumn("generic", generic_concept()).withColumns({"score": score, "title": text("title"), "symbol": text("symbol")})
    best = F.max(F.struct("score", F.expr("not generic").alias("plain"))).alias("best")
    g = d.groupBy("chapter_id", "title", "symbol").agg(best, F.count("*").alias("n")).join(spine, "chapter_id", "left")
    g = g.select("chapter_id", "title", "symbol", (F.col("best.score") + F.least(F.lit(2400), 300 * F.col("n"))).cast("long").alias("score"), "best.plain", F.greatest(F.lit(5), F.least(F.lit(10), F.ceil(F.coalesce("n_backbone", F.lit(0)) * 3 / 4))).alias("k"))
    # plain entries come first; where there is one, generic ones fall out
    w = Window.partitionBy("chapter_id").orderBy(F.desc("plain"), F.desc("score"), "title", "symbol")
    g = g.withColumns({"rank": F.row_number().over(w).cast("long"), "first": F.first("plain").over(w)})
    return g.filter("plain = first and rank <= k").select("chapter_id", "rank", "title", "score")


def evidence_ranking(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, doc_id, block_index, score): per concept(key, formula_id, term) the best block of its formula: priority in hundredths, 200 if it holds the term, 150 if it is the document's first reference, 100 for a definition; first on ties."""
    d = concepts.join(blocks, F.col("formula_id") == F.col("doc_id"))
    score = 100 * F.col("priority") + F.when(F.contains(F.lower("content"), F.lower("term")), 200).otherwise(0) + F.when(F.col("formula_references") != "", 150).otherwise(0) + F.when(F.col("block_type") == "definition", 100).otherwise(0)
    best = F.max_by(F.struct("doc_id", "block_index", score.cast("long").alias("score")), F.struct(score, -F.col("block_index")))
    return d.groupBy("key").agg(best.alias("b")).select("key", "b.*")


#: Wordings that no name and no definition holds.
BAD_PHRASE = r"(?i)\b(first term|second term|third term|large parentheses|where|which|given that|note that|following set|standard approach|value for and|if gaussian|for gaussian|letting|assuming|subtracting|yielding|generated|is given|computed|calculated)\b"
BAD_NAME = r"(?i)^(first|second|third|last|following|if|for|when|while|satisfies|most robust approach|additional technical restriction|within-generation change is not influenced)\b"
NOT_USEFUL = [BAD_PHRASE, r"(?i)\bholds for all possible values of\b", r"(?i)\bappears in the literature\b", r"(?i)\bWright's \(\d{4}", r"[A-Z][A-Z\s,'-]{18,}$", r"\b[A-Z]{3,}(?:'S)?\b.*\b[A-Z]{3,}(?:'S)?\b", r"(?i)\b(first|second|third)\s+term\b"]
NO_PHRASE_START = r"(?i)^(a|an|the|if|for|when|while|thus|similarly|likewise|hence)\b"
#: How a style is read before a common name, and in a symbol's own name.
PREFIXES = [(r"\\(?:overline|bar)", "Mean "), (r"\\Delta", "Change in "), ("prime", "Updated ")]
READABLE = [
    (r"\\widehat\{\\boldsymbol\{([^{}]+)\}\}", "$1 estimator vector"), (r"\\boldsymbol\{([^{}]+)\}", "$1 vector"), (r"\\mathbf\{([^{}]+)\}", "$1 matrix"), (r"\\(?:overline|bar)\{([^{}]+)\}", "$1-bar"),
    (r"\\(?:widehat|hat)\{([^{}]+)\}", "$1-hat"), (r"\\Delta", "Change"), (r"\\delta", "delta"), (r"\\epsilon|\\varepsilon", "epsilon"), (r"\\(alpha|beta|gamma|sigma|mu)", "$1"),
    (r"_\{([^{}]+)\}", " sub $1"), (r"\^\{\\prime\}", " prime"), (r"\^\{([^{}]+)\}", " power $1"), (r"[{}]|\\", ""),
]
LOW_WORDS = ["a", "an", "and", "as", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
OPERATOR_NAMES = ["\\sum", "\\prod", "\\int", "\\partial"]


def title_case(text: Column) -> Column:
    word = lambda x, i: F.when((i > 0) & F.lower(x).isin(LOW_WORDS), F.lower(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 10_000))))
    return F.array_join(F.transform(F.split(spaced(text), " "), word), " ")


def base_symbol(symbol: Column) -> Column:
    for pattern, kept in ((r"\\(?:overline|bar|widehat|hat)\{([^{}]+)\}", "$1"), (r"[_^]\{[^{}]+\}", ""), (r"[{}]", ""), (r"^\\", "")):
        symbol = F.regexp_replace(symbol, pattern, kept)
    return symbol


def readable_symbol(symbol: Column) -> Column:
    for pattern, said in READABLE:
        symbol = F.regexp_replace(symbol, pattern, said)
    return title_case(symbol)


def is_useful(sentence: Column) -> Column:
    """Whether a sentence can stand as a definition: 28 to 190 characters, a capital first, none of NOT_USEFUL, at most 12 single letters."""
    fine = F.length(sentence).between(28, 190) & sentence.rlike(r"^[A-Z][A-Za-z0-9(\"' ]")
    for pattern in NOT_USEFUL:
        fine = fine & ~sentence.rlike(pattern)
    return fine & (F.size(F.regexp_extract_all(sentence, F.lit(r"\b[A-Za-z]\b"), F.lit(0))) <= 12)


def named_phrase(context: Column, base: Column) -> Column:
    """What a context calls a formula's symbol, else null: the first of three patterns whose phrase is fit for a name."""
    words = r"([A-Za-z][A-Za-z\s,'-]{3,64})"
    own = F.concat(F.lit(rf"(?i)(?:the|called|denote|denotes|defined as|is the|is called)\s+{words}\s+(?:\Q"), base, F.lit(r"\E|is|as|by|equals)"))
    found = [F.call_function("regexp_extract", context, p, F.lit(1)) for p in (own, F.lit(rf"(?i){words}\s+(?:is|are)\s+(?:defined|given|computed|calculated)"), F.lit(rf"(?i){words}\s+is\s"))]
    clean = lambda x: spaced(F.regexp_replace(x, r"(?i)\b(the|this|that|where|and|or)$", ""))
    good = lambda x: (x != "") & (F.size(F.split(x, " ")) <= 5) & ~x.rlike(BAD_PHRASE) & ~x.rlike(BAD_NAME) & ~x.rlike(NO_PHRASE_START) & (F.lower(x) != "let")
    # as lists of one, so that each pattern is sought once, not once for each test of what it finds
    fit = [F.get(F.transform(F.transform(F.array(x), clean), lambda y: F.when(good(y), title_case(y))), F.lit(0)) for x in found]
    return F.coalesce(*fit)


def symbol_concepts(occ: DataFrame, formulas: DataFrame, rules: list[tuple[str, str, str, str]], names: DataFrame, evidenced: DataFrame | None = None) -> DataFrame:
    """(key, name, concept_type, conf, needs_review) for every symbol of every formula.

    The name, in this order: of the first of rules(symbol pattern, context pattern, name, type) that fits symbol and
    context; of names(symbol, name) for the symbol; for its base, after a word for its style; of a Greek letter; an
    operator's; of a phrase of the context, where the formula defines the symbol; the symbol read aloud. Hundredths: 82 if
    defined, 68 if used; 8 for a rule, 8 if the sentence that holds the symbol (else any) is useful, 4 if the key is among
    ``evidenced``, 5 for a listed name, 5 if defined; 95 at most; below 72 it needs review.

    Each context meets each rule once and each distinct symbol once; a use then takes the least rule that both have.
    """
    met = lambda column, which: F.array_compact(F.array(*[F.when(column.rlike(r[which]), i) for i, r in enumerate(rules)]).cast("array<int>"))
    f = formulas.select("formula_id", spaced(F.col("context_text")).alias("context"))
    f = f.withColumns({"fits": met(F.col("context"), 1), "said": F.transform(sentences_of(F.col("context")), lambda x: F.struct(x.alias("text"), F.lower(x).alias("low"), is_useful(x).alias("useful")))})
    # sentences are searched only where some are useful and some are not; else all answer alike, whichever holds the symbol
    any_useful, all_useful = F.exists("said", lambda x: x["useful"]), F.forall("said", lambda x: x["useful"])
    f = f.select("formula_id", "context", "fits", any_useful.alias("any_useful"), F.when(any_useful & ~all_useful, F.col("said")).alias("said"))
    s = occ.select("symbol").distinct()
    s = s.withColumns({"base": base_symbol(F.col("symbol")), "readable": readable_symbol(F.col("symbol")), "meant": met(F.col("symbol"), 0)})
    listed = names.select(F.col("symbol").alias("_s"), F.col("name").alias("_n"))
    s = s.join(listed.withColumnsRenamed({"_s": "symbol", "_n": "own"}), "symbol", "left").join(listed.withColumnsRenamed({"_s": "base", "_n": "of_base"}), "base", "left")
    style = functools.reduce(lambda rest, p: F.when(F.col("symbol").rlike(p[0]), p[1]).otherwise(rest), reversed(PREFIXES), F.lit(""))
    operator = F.col("symbol").isin(OPERATOR_NAMES) | F.concat(F.lit("\\"), "base").isin(OPERATOR_NAMES)
    greek = F.when(F.col("base").isin([g for g in GREEK if g.islower()]), F.initcap("base"))
    s = written(s.withColumns({"known": F.coalesce("own", F.concat(style, "of_base"), greek, F.when(operator, F.col("readable"))), "operator": operator, "listed": F.col("own").isNotNull() | F.col("of_base").isNotNull()}).drop("own", "of_base"), "symbols")
    d = occ.select("formula_id", "symbol", "defines").join(s, "symbol").join(f, "formula_id").withColumn("key", F.concat_ws("::", "formula_id", "symbol"))
    d = d.withColumn("rule", F.array_min(F.array_intersect("fits", "meant")))
    of = lambda which, rest: F.coalesce(F.get(F.array(*[F.lit(r[which]) for r in rules]), F.col("rule")), rest) if rules else rest
    hit = F.get(F.filter("said", lambda x: F.contains(x["text"], F.col("base")) | F.contains(x["low"], F.lower("readable"))), F.lit(0))
    useful = F.when(F.col("said").isNull(), F.col("any_useful")).otherwise(F.coalesce(hit["useful"], F.col("any_useful")))
    phrase = F.when(F.col("defines") & F.col("known").isNull() & F.col("rule").isNull(), named_phrase(F.col("context"), F.col("base")))
    kind = F.when(F.col("operator"), "operator_or_function").when(F.col("base").isin("Cov", "Var", "E", "Pr"), "math_concept").when(F.col("defines") | F.col("base").isin("w", "W", "z", "p", "q"), "quantity_concept").otherwise("domain_concept")
    point = lambda test, n: F.when(test, n).otherwise(0)
    d = d.withColumn("_e", F.lit(False)) if evidenced is None else d.join(evidenced.select("key", F.lit(True).alias("_e")).distinct(), "key", "left")
    conf = F.least(F.lit(95), F.when(F.col("defines"), 87).otherwise(68) + point(F.col("rule").isNotNull(), 8) + point(useful, 8) + point(F.col("_e"), 4) + point(F.col("listed"), 5)).cast("long")
    return d.select("key", of(2, F.coalesce("known", phrase, "readable")).alias("name"), of(3, kind).alias("concept_type"), conf.alias("conf"), (conf < 72).alias("needs_review"))


def rule_concept_graph(formulas: DataFrame, senses: DataFrame, introduced: DataFrame, prerequisites: DataFrame, limit: int = 6) -> DataFrame:
    """(formula_id, focus, conf, n_prerequisites, introduced, copy): the first defined symbol is the focus (90 at most, 84 without prerequisites), with up to ``limit`` introduced symbols and a sentence from a template."""
    pre = prerequisites.groupBy("formula_id").agg(F.count("*").alias("n_prerequisites"))
    new = introduced.filter(F.col("ordinal") < limit).groupBy("formula_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "symbol"))), lambda x: x["symbol"]), ",").alias("introduced"))
    d = formulas.join(senses.select("formula_id", F.col("symbol").alias("focus")), "formula_id").join(pre, "formula_id", "left").join(new, "formula_id", "left").na.fill(0, ["n_prerequisites"]).na.fill("", ["introduced"])
    conf = F.least("conf", F.when(F.col("n_prerequisites") > 0, 90).otherwise(84)).cast("long")
    return d.select("formula_id", "focus", conf.alias("conf"), "n_prerequisites", "introduced", F.format_string("%s defines %s from %d earlier concepts.", "label", "focus", "n_prerequisites").alias("copy"))
