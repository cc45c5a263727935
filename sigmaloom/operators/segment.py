"""Pages to events (heading, text, formula) and formula records, as windows over lines.

The state *inside a display formula* before a line is the parity of the single ``$$`` lines since the page's last reset;
headings carry forward over the book by their last non-null value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.work import written

#: Line and number patterns.
CHAPTER = r"(?i)^(?:#{1,6}\s*)?(?:chapter|ch\.?)\s+(\d+)\b[:.\-\s]*(.*)$"
APPENDIX = r"(?i)^(?:#{1,6}\s*)?appendix\s+([A-Z]|\d+)\b[:.\-\s]*(.*)$"
NUMERIC = r"^#{1,3}\s*(\d+)\s+(.+)$"
NUMBER = r"(?i)\((A?\d+(?:\.\d+)+[a-z]?)\)"
LOOSE = r"(?i)\b(A?\d+(?:\.\d+)+[a-z]?)\b"


def segment_events(pages: DataFrame) -> DataFrame:
    """pages(book_id, page_index, text) to events(book_id, page_index, line_index, seq, kind, text, section, subsection, chapter_id, chapter)."""
    keys = ["_page", "book_id", "page_index"]  # one column, so that pages without a book or number are told apart as well
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pages.select(F.struct("book_id", "page_index").alias("_page"), "text").repartition(tasks, "_page")  # whole pages move once; all that follows is done where they are
    d = p.select("_page", "_page.*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_index", "line"))
    d = d.withColumns({"line": F.trim("line"), "line_index": F.col("line_index").cast("long")}).filter("line != ''")
    line = F.col("line")
    n = (F.length(line) - F.length(F.replace(line, F.lit("$$"), F.lit("")))) / 2
    heading = line.rlike(CHAPTER) | line.rlike(APPENDIX) | line.rlike(NUMERIC)
    d = d.withColumns({"n": n.cast("int"), "heading": heading})
    d = d.withColumns({"toggle": (~F.col("heading") & (F.col("n") == 1)).cast("int"), "reset": (F.col("heading") & (F.col("n") == 1)).cast("int")})
    page = Window.partitionBy("_page").orderBy("line_index")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("part", F.coalesce(F.sum("reset").over(past(page)), F.lit(0)))
    inside = Window.partitionBy("_page", "part").orderBy("line_index")
    d = d.withColumn("open", F.coalesce(F.sum("toggle").over(past(inside)), F.lit(0)) % 2 == 1)
    single = F.col("n") == 1
    d = d.withColumns({"is_heading": F.col("heading") & ~F.col("open"), "opens": single & ~F.col("open") & ~F.col("heading"), "closes": single & F.col("open")})
    d = d.withColumn("span", F.sum(F.col("opens").cast("int")).over(page))

    number = F.regexp_extract(line, CHAPTER, 1)
    letter = F.upper(F.regexp_extract(line, APPENDIX, 1))
    appendix = F.when(letter.rlike("^[A-Z]$"), F.ascii(letter) - 64).otherwise(F.expr(f"try_cast(upper(regexp_extract(line, r'{APPENDIX}', 1)) as int)"))
    is_chapter, is_appendix = line.rlike(CHAPTER), line.rlike(APPENDIX)
    title = lambda pattern, rest: F.when(F.trim(F.regexp_extract(line, pattern, 2)) != "", F.trim(F.regexp_extract(line, pattern, 2))).otherwise(rest)
    chapter = F.when(is_chapter, F.expr(f"try_cast(regexp_extract(line, r'{CHAPTER}', 1) as int)")).when(is_appendix, 30 + appendix)
    section = F.when(is_chapter, title(CHAPTER, F.concat(F.lit("Chapter "), F.expr(f"try_cast(regexp_extract(line, r'{CHAPTER}', 1) as int)")))).when(is_appendix, title(APPENDIX, F.concat(F.lit("Appendix "), letter)))
    chapter_id = F.when(is_chapter, F.concat(F.lit("chapter"), F.col("chapter").cast("string"))).when(is_appendix, F.concat(F.lit("appendix"), (F.col("chapter") - 30).cast("string")))
    live = F.col("is_heading")
    d = d.withColumn("chapter", F.when(live, chapter))
    d = d.withColumns({"section": F.when(live, section), "chapter_id": F.when(live, chapter_id), "subsection": F.when(live & (is_chapter | is_appendix), F.lit("")).when(live, F.trim(F.regexp_extract(line, NUMERIC, 2)))})
    start = {"chapter": F.lit(1), "chapter_id": F.lit("chapter1"), "section": F.lit("Chapter 1"), "subsection": F.lit("")}
    # the last heading of each page is carried over the pages of its book, within a page that of the lines before
    last = d.filter("is_heading").groupBy("_page").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("line_index", c))).alias(c) for c in start])
    book = Window.partitionBy("_page.book_id").orderBy("_page.page_index").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.select("_page").distinct().join(last, "_page", "left").select("_page", *[F.last(F.col(c)[c], True).over(book).alias(f"_{c}") for c in start])
    d = d.withColumns({c: F.last(c, True).over(page.rowsBetween(Window.unboundedPreceding, 0)) for c in start}).join(carry, "_page")
    d = d.withColumns({c: F.coalesce(c, f"_{c}", v) for c, v in start.items()}).withColumn("p", F.split(line, r"\$\$"))

    piece = lambda i: F.trim(F.get("p", F.lit(i)))
    rest = lambda i: F.trim(F.array_join(F.slice("p", i + 1, F.size("p")), "$$"))
    bracket = (F.locate("\\[", line) > 0) & (F.locate("\\]", line) > F.locate("\\[", line))
    lo, hi = F.locate("\\[", line), F.locate("\\]", line)
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    at = lambda a, b: F.trim(F.substring(line, a, b))
    plain = (
        F.when(live, F.array(event(0, "heading", F.when(is_chapter | is_appendix, F.col("section")).otherwise(F.col("subsection")))))
        .when(F.col("n") >= 2, F.array(event(0, "text", piece(0)), event(1, "formula", piece(1)), event(2, "text", rest(2))))
        .when(F.col("opens"), F.array(event(0, "text", piece(0))))
        .when(F.col("closes"), F.array(event(2, "text", rest(1))))
        .when(bracket, F.array(event(0, "text", at(F.lit(1), lo - 1)), event(1, "formula", at(lo + 2, hi - lo - 2)), event(2, "text", at(hi + 2, F.length(line)))))
        .when(~F.col("open"), F.array(event(0, "text", line)))
    )
    keys += ["line_index", "section", "subsection", "chapter_id", "chapter"]
    out = d.select(*keys, F.explode(plain).alias("e")).select(*keys, "e.*").filter((F.col("text") != "") | (F.col("kind") == "formula"))
    body = F.when(F.col("opens"), rest(1)).when(F.col("closes"), piece(0)).when(F.col("open") & (F.col("n") == 0) & ~bracket, line)
    part = d.withColumn("body", body).filter("body is not null")
    block = part.groupBy("_page", "span").agg(
        F.max("closes").alias("done"), F.min(F.struct(*keys[3:])).alias("k"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(F.col("line_index").alias("i"), "body"))), lambda x: x["body"] != ""), lambda x: x["body"]), "\n").alias("text"),
    ).filter("done and text != ''")
    block = block.select("_page", "_page.*", "k.*", F.lit(1).alias("seq"), F.lit("formula").alias("kind"), "text")
    return out.unionByName(block).select("book_id", "page_index", "line_index", "seq", "kind", "text", "section", "subsection", "chapter_id", "chapter")


def clean_formula(text):
    """The LaTeX of a raw formula column."""
    d = F.regexp_replace(F.trim(text), r"^\$+|\$+$", "")
    d = F.regexp_replace(F.regexp_replace(d, r"\\tag\{[^{}]+\}", ""), NUMBER, "")
    return F.trim(F.regexp_replace(d, r"\s+", " "))


def formula_number(raw, after):
    """The number in the formula, else in the text after it, else a loose one in its short first sentence; null if none."""
    first = F.trim(F.get(F.filter(F.split(after, r"\. "), lambda x: F.trim(x) != ""), F.lit(0)))
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(found(raw, NUMBER), found(after, NUMBER), F.when(F.length(first) <= 20, found(first, LOOSE)))


def chapter_from_number(number):
    """(chapter_id, chapter) of a number column."""
    appendix, plain = F.regexp_extract(number, r"(?i)^A(\d+)\.", 1), F.regexp_extract(number, r"^(\d+)\.", 1)
    chapter_id = F.when(appendix != "", F.concat(F.lit("appendix"), appendix.cast("int"))).when(plain != "", F.concat(F.lit("chapter"), plain.cast("int"))).otherwise("chapter1")
    return chapter_id, F.when(appendix != "", appendix.cast("int") + 30).when(plain != "", plain.cast("int")).otherwise(1)


def attach_context(events: DataFrame, limit: int = 3) -> DataFrame:
    """Formula events with before_text and after_text: up to ``limit`` nearest text events each way, stopping at a formula.

    Text events between two formulas form a gap, of which only the ``limit`` at either end are gathered; a formula takes the end of the gap before it and the start of the one after.
    """
    place = ["page_index", "line_index", "seq"]
    events = written(events, "events")
    book = Window.partitionBy("book_id").orderBy(*place)
    # places alone are put in order; the texts that are taken are few, and fetched by their places
    d = events.select("book_id", *place, "kind").withColumn("gap", F.sum((F.col("kind") == "formula").cast("int")).over(book))
    gap = Window.partitionBy("book_id", "gap")
    ends = {"_first": F.row_number().over(gap.orderBy(*place)), "_last": F.row_number().over(gap.orderBy(*[F.desc(c) for c in place]))}
    near = d.filter("kind = 'text'").withColumns(ends).filter((F.col("gap") > 0) & (F.col("_first") <= limit) | (F.col("_last") <= limit)).drop("kind")
    near = events.filter("kind = 'text'").select("book_id", *place, "text").join(near, ["book_id", *place])
    some = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) <= limit, F.struct(*place, "text"))))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), " ")
    texts = near.groupBy("book_id", "gap").agg(joined(some("_first")).alias("head"), joined(some("_last")).alias("tail"))
    texts = written(texts, "contexts")
    f = events.filter("kind = 'formula'").join(d.filter("kind = 'formula'").drop("kind"), ["book_id", *place], "left")
    before = texts.select("book_id", (F.col("gap") + 1).alias("gap"), F.col("tail").alias("before_text"))
    after = texts.select("book_id", "gap", F.col("head").alias("after_text"))
    return f.join(before, ["book_id", "gap"], "left").join(after, ["book_id", "gap"], "left").drop("gap").na.fill("", ["before_text", "after_text"])


def assign_formula_ids(formulas: DataFrame) -> DataFrame:
    """(+ number, raw_id, formula_id, position, duplicate, numbered, chapter from the number) for formula events with context."""
    place = ["page_index", "line_index", "seq"]
    d = formulas.withColumn("latex", clean_formula(F.col("text"))).filter("latex != ''")
    d = d.withColumn("number", formula_number(F.col("text"), F.col("after_text")))
    book = Window.partitionBy("book_id").orderBy(*place)
    of_chapter = Window.partitionBy("book_id", "chapter_id", F.col("number").isNull()).orderBy(*place)
    label = F.when(F.col("chapter_id").startswith("appendix"), F.concat(F.lit("A"), F.expr("substring(chapter_id, 9)"))).otherwise(F.expr("substring(chapter_id, 8)"))
    d = d.withColumns({"position": (F.row_number().over(book) - 1).cast("long"), "raw_id": F.coalesce("number", F.concat(label, F.lit(".u"), F.lpad(F.row_number().over(of_chapter).cast("string"), 3, "0")))})
    twin = F.row_number().over(Window.partitionBy("book_id", "raw_id").orderBy("position"))
    chapter_id, chapter = chapter_from_number(F.col("number"))
    d = d.withColumns({"twin": twin, "numbered": F.col("number").isNotNull()})
    d = d.withColumns({"chapter_id": F.when(F.col("numbered"), chapter_id).otherwise(F.col("chapter_id")), "chapter": F.when(F.col("numbered"), chapter).otherwise(F.col("chapter"))})
    name = F.concat(F.lit("formula_"), "raw_id", F.when(F.col("twin") > 1, F.concat(F.lit("_dup"), "twin")).otherwise(""))
    return d.withColumns({"formula_id": name, "duplicate": F.col("twin") > 1, "context_text": F.trim(F.concat_ws(" ", F.nullif("before_text", F.lit("")), F.nullif("after_text", F.lit(""))))}).drop("twin")


def score_formula(formulas: DataFrame) -> DataFrame:
    """(+ conf in hundredths, review_flags joined by comma, is_low_confidence)."""
    latex = F.col("latex")
    short = (F.length(latex) < 6) | ~latex.rlike(r"[A-Za-z\\]")
    braces = F.length(F.translate(latex, "{", "")) != F.length(F.translate(latex, "}", ""))
    faults = [("missing_formula_number", ~F.col("numbered"), 20), ("duplicate_formula_number", F.col("duplicate"), 18), ("suspicious_short_formula", short, 28), ("short_context", F.length("context_text") < 32, 12), ("unbalanced_latex_braces", braces, 25)]
    conf = F.lit(98)
    for _, bad, cost in faults:
        conf = conf - F.when(bad, cost).otherwise(0)
    conf = F.greatest(F.lit(5), conf)
    flags = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad, _ in faults], F.when(conf < 75, F.lit("low_confidence_ocr"))))
    return formulas.withColumns({"conf": conf.cast("long"), "review_flags": F.array_join(flags, ","), "is_low_confidence": conf < 75})


def keywords(rows: DataFrame, k: int = 24, pattern: str = r"[A-Za-z0-9]{3,}", stop: list[str] | None = None) -> DataFrame:
    """(formula_id, ordinal, keyword): the first ``k`` words of ``text``, distinct without regard to case, as first written."""
    w = rows.select("formula_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("p", "w")).withColumn("l", F.lower("w"))
    if stop:
        w = w.filter(~F.col("l").isin(stop))
    w = w.groupBy("formula_id", "l").agg(F.min(F.struct("p", "w")).alias("f")).select("formula_id", "f.*")
    r = F.row_number().over(Window.partitionBy("formula_id").orderBy("p"))
    return w.withColumn("r", r).filter(F.col("r") <= k).select("formula_id", (F.col("r") - 1).cast("long").alias("ordinal"), F.col("w").alias("keyword"))


def formula_mention_positions(blocks: DataFrame) -> DataFrame:
    """(chapter_id, raw_id, position): formulas in order of first mention in the chapter's blocks(chapter_id, block_order, content): tags, cited equations, numbers in parentheses."""
    kinds = [r"\[\[(?:SEE_)?FORMULA:(\d+(?:\.\d+)?[a-z]?)\]\]", r"(?i)\bEquations?\s+(\d+(?:\.\d+)?[a-z]?)", r"\((\d+\.\d+[a-z]?)\)"]
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in kinds])
    d = blocks.select("chapter_id", "block_order", F.posexplode(found).alias("o", "raw_id"))
    first = d.groupBy("chapter_id", "raw_id").agg(F.min(F.struct("block_order", "o")).alias("f"))
    return first.select("chapter_id", "raw_id", (F.row_number().over(Window.partitionBy("chapter_id").orderBy("f")) - 1).cast("long").alias("position"))


def extract_structured_formulas(blocks: DataFrame) -> DataFrame:
    """Display formulas of four characters or more inside blocks(chapter_id, block_order, content): (formula_id, chapter_id, latex, context_text)."""
    d = blocks.select("chapter_id", "block_order", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)\$\$\s*(.*?)\s*\$\$"), F.lit(1))).alias("o", "latex"), F.trim(F.regexp_replace("content", r"(?s)\$\$.*?\$\$", " ")).alias("context_text"))
    d = d.filter(F.length("latex") >= 4)
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("block_order", "o"))
    return d.select(F.concat(F.lit("formula_A"), F.regexp_extract("chapter_id", r"(\d+)$", 1), F.lit("."), n).alias("formula_id"), "chapter_id", "latex", "context_text")
