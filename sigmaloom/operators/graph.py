"""Queries on the dependency graph: depth, neighbours, guidance, lanes, recommendations."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.work import shared_dir, written


#: Formulas of a chapter in one block of the depth: what a task holds at once.
BLOCK = 4096


def formula_depth(formulas: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(formula_id, depth): the longest path to a formula without prerequisites, over edges whose target sorts earlier in the chapter.

    A chapter is cut by position into blocks, and the first blocks of all chapters are settled in one round, then the
    second ones: targets in earlier blocks are joined from the shared folder, those in the block are followed in order.
    Edges and depths lie there by block, so a round reads its own edges and of the depths only the blocks that they name.
    So rounds grow with the longest chapter's blocks, not with the depth, which has no bound.
    """
    spark = formulas.sparkSession
    at = formulas.select("formula_id", "chapter_id", "position")
    e = edges.filter("target_id is not null").select("dependent_id", "target_id").distinct()
    e = e.join(at.withColumnRenamed("formula_id", "dependent_id"), "dependent_id")
    e = e.join(at.select(F.col("formula_id").alias("target_id"), F.col("chapter_id").alias("_c"), F.col("position").alias("target")), "target_id")
    e = e.select("chapter_id", "position", "target", F.expr(f"target div {block}").alias("_b"), F.expr("chapter_id = _c and target < position").alias("earlier"), F.expr(f"position div {block}").alias("block"))
    folder = f"{shared_dir(spark)}/depth-{uuid.uuid4().hex}"
    e.repartition("block", "chapter_id").write.partitionBy("block").parquet(f"{folder}/edges")
    e = spark.read.schema(e.schema).parquet(f"{folder}/edges")
    named: dict[int, list[int]] = {}
    for r in e.groupBy("block", "_b").agg(F.bool_and("earlier").alias("earlier")).collect():  # at most the square of the longest chapter's blocks
        if not r.earlier:
            raise ValueError("an edge's target does not sort earlier in the chapter")
        named.setdefault(r.block, []).append(r._b)

    def levels(rows: pa.Table) -> pa.Table:
        depth: dict[int, int] = {}
        for p, t, base in sorted(zip(*(rows.column(c).to_pylist() for c in ("position", "target", "base")), strict=True)):
            depth[p] = max(depth.get(p, 0), base if base else depth.get(t, 0) + 1)
        chapter = pa.repeat(rows.column("chapter_id")[0], len(depth))
        return pa.table({"chapter_id": chapter, "position": pa.array(depth.keys(), pa.int64()), "depth": pa.array(depth.values(), pa.int64())})

    schema = at.select("chapter_id").schema.add("position", "long").add("depth", "long")
    path, whole = f"{folder}/depths", spark.createDataFrame([], at.select("chapter_id").schema.add("position", "long").add("depth", "long").add("block", "long")).schema
    spark.createDataFrame([], whole).write.partitionBy("block").parquet(path)
    for k in sorted(named):
        done = spark.read.schema(whole).parquet(path).filter(F.col("block").isin([b for b in named[k] if b < k]))
        own = e.filter(F.col("block") == k).join(done.select("chapter_id", F.col("position").alias("target"), "depth"), ["chapter_id", "target"], "left")
        base = F.when(F.col("_b") < k, F.coalesce("depth", F.lit(0)) + 1).otherwise(0)
        found = own.select("chapter_id", "position", "target", base.alias("base")).groupBy("chapter_id").applyInArrow(levels, schema)
        found.withColumn("block", F.lit(k).cast("long")).write.mode("append").partitionBy("block").parquet(path)
    found = at.join(spark.read.schema(whole).parquet(path).drop("block"), ["chapter_id", "position"], "left")
    return found.groupBy("formula_id").agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("depth"))


def neighbours(edges: DataFrame, direction: str = "prerequisites", hidden: tuple[str, ...] = ("\\pi", "\\infty")) -> DataFrame:
    """G1: (formula_id, neighbour_id) along accepted formula edges, without those via symbols that are not drawn."""
    e = edges.filter(F.col("target_id").isNotNull() & ~F.col("via_symbol").isin(*hidden))
    a, b = ("dependent_id", "target_id") if direction == "prerequisites" else ("target_id", "dependent_id")
    return e.select(F.col(a).alias("formula_id"), F.col(b).alias("neighbour_id")).distinct()


def expand_step(frontier: DataFrame, edges: DataFrame, formulas: DataFrame, max_successors: int = 5) -> DataFrame:
    """(formula_id, next_id, side): all prerequisites of each frontier formula and its first dependents of the same chapter."""
    f = frontier.select("formula_id")
    pre = neighbours(edges).join(f, "formula_id", "left_semi").select("formula_id", F.col("neighbour_id").alias("next_id"), F.lit("prerequisite").alias("side"))
    place = formulas.select(F.col("formula_id").alias("neighbour_id"), "chapter_id", "position")
    own = formulas.select("formula_id", F.col("chapter_id").alias("_c"))
    nxt = neighbours(edges, "dependents").join(f, "formula_id", "left_semi").join(place, "neighbour_id").join(own, "formula_id").filter("chapter_id = _c")
    rank = F.row_number().over(Window.partitionBy("formula_id").orderBy("position", "neighbour_id"))
    nxt = nxt.withColumn("r", rank).filter(F.col("r") <= max_successors).select("formula_id", F.col("neighbour_id").alias("next_id"), F.lit("dependent").alias("side"))
    return pre.union(nxt)


def starter_formulas(formulas: DataFrame, edges: DataFrame) -> DataFrame:
    """Formulas without an accepted prerequisite in their chapter."""
    chapter = formulas.select(F.col("formula_id").alias("target_id"), F.col("chapter_id").alias("_t"))
    held = edges.join(chapter, "target_id").select(F.col("dependent_id").alias("formula_id"), F.col("_t").alias("chapter_id"))
    return formulas.select("formula_id", "chapter_id").join(held, ["formula_id", "chapter_id"], "left_anti")


#: Users of a class that are listed in one row, and parts of a chapter's formulas that meet the classes apart.
CLASS_USERS = 4096
FORMULA_PARTS = 16


def locked_guidance(edges: DataFrame, formulas: DataFrame, learned: DataFrame) -> DataFrame:
    """(user_id, formula_id, blocker_id): for each user and formula of a chapter that the user studies, the first prerequisite not learned yet.

    Of a formula's prerequisites in order, only those up to the first that nobody has learned can block anyone. Users of a
    chapter who have learned the same ones of these are a class; each class meets each formula once, and its users are
    written out with what it finds. So no pair of a user and a formula moves, and there are no more classes than users.
    """
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as the result is far larger than what moves
    at = formulas.select("formula_id", "chapter_id", "position")
    e = edges.select(F.col("dependent_id").alias("formula_id"), F.col("target_id").alias("blocker_id")).distinct()
    e = e.join(at.select("formula_id", "chapter_id"), "formula_id").join(at.select(F.col("formula_id").alias("blocker_id"), F.col("position").alias("p")), "blocker_id")
    known = written(learned.filter("user_id is not null").select("user_id", F.col("formula_id").alias("blocker_id")).distinct(), "guidance-known")
    met = known.select(F.col("blocker_id").alias("_b")).distinct()
    e = e.filter("chapter_id is not null").join(met, F.col("blocker_id") == F.col("_b"), "left")
    at_last, place = F.min(F.when(F.col("_b").isNull(), F.struct("p", "blocker_id"))), F.struct("p", "blocker_id")
    e = e.groupBy("formula_id", "chapter_id").agg(at_last.alias("_last"), F.sort_array(F.collect_list(F.when(F.col("_b").isNotNull(), place))).alias("_some"))
    some = F.when(F.col("_last").isNull(), F.col("_some")).otherwise(F.filter("_some", lambda x: x < F.col("_last")))
    e = written(e.select("formula_id", "chapter_id", F.col("_last.blocker_id").alias("last"), F.transform(some, lambda x: x["blocker_id"]).alias("some")), "guidance")
    asked = e.select("chapter_id", F.explode("some").alias("blocker_id")).distinct()
    have = known.join(asked, "blocker_id").groupBy("user_id", "chapter_id").agg(F.sort_array(F.collect_set("blocker_id")).alias("have"))
    users = learned.filter("chapter_id is not null").select("user_id", "chapter_id").distinct().join(have, ["user_id", "chapter_id"], "left")
    users = users.withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    size = F.count("*").over(Window.partitionBy("chapter_id", "have"))
    users = users.withColumn("part", F.pmod(F.xxhash64("user_id"), F.ceil(size / CLASS_USERS)))
    classes = users.groupBy("chapter_id", "have", "part").agg(F.collect_list(F.struct("user_id")).alias("users"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(FORMULA_PARTS - 1)).cast("array<long>")).alias("_f")
    classes = classes.select("chapter_id", "have", "users", parts).repartition(tasks, "chapter_id", "_f")
    e = e.withColumn("_f", F.pmod(F.xxhash64("formula_id"), F.lit(FORMULA_PARTS))).repartition(tasks, "chapter_id", "_f")
    blocker = F.coalesce(F.get(F.array_except("some", "have"), F.lit(0)), "last")
    found = e.join(classes, ["chapter_id", "_f"]).select("users", "formula_id", blocker.alias("blocker_id")).filter("blocker_id is not null")
    return found.select(F.explode("users").alias("u"), "formula_id", "blocker_id").select("u.user_id", "formula_id", "blocker_id")


def lane_assignment(formulas: DataFrame, edges: DataFrame, depth: DataFrame, most: int = 9) -> DataFrame:
    """(formula_id, lane, row): the lane is the depth (one more for a root that others need), at most ``most``; rows by position."""
    needed = edges.select(F.col("target_id").alias("formula_id")).distinct().withColumn("needed", F.lit(True))
    d = formulas.select("formula_id", "chapter_id", "position").join(depth, "formula_id").join(needed, "formula_id", "left")
    lane = F.least(F.lit(most), F.col("depth") + F.when((F.col("depth") == 0) & F.col("needed"), 1).otherwise(0)).cast("long")
    row = F.row_number().over(Window.partitionBy("chapter_id", "lane").orderBy("position")) - 1
    return d.withColumn("lane", lane).select("formula_id", "lane", row.cast("long").alias("row"))


def next_concept(views: DataFrame, refs: DataFrame) -> DataFrame:
    """(concept_id, next_concept_id, source): first clickable prerequisite, else introduced, else the next in chapter order, else the first other one.

    views(concept_id, chapter_id, place), refs(concept_id, side, ordinal, ref_id, clickable).
    """
    r = refs.filter("clickable and ref_id != concept_id").select("concept_id", F.when(F.col("side") == "prerequisite", 0).otherwise(1).alias("tier"), F.col("ordinal").cast("long").alias("o"), F.col("ref_id").alias("next_concept_id"))
    order = Window.partitionBy("chapter_id").orderBy("place")
    v = views.withColumns({"n": F.lead("concept_id").over(order), "f": F.first("concept_id").over(order)})
    after = v.filter("n is not null").select("concept_id", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("o"), F.col("n").alias("next_concept_id"))
    first = v.filter("f != concept_id").select("concept_id", F.lit(3).alias("tier"), F.lit(0).cast("long").alias("o"), F.col("f").alias("next_concept_id"))
    best = F.min(F.struct("tier", "o", "next_concept_id"))
    names = F.array(*[F.lit(x) for x in ("prerequisite", "introduced", "order", "other")])
    return r.union(after).union(first).groupBy("concept_id").agg(best.alias("b")).select("concept_id", "b.next_concept_id", F.get(names, F.col("b.tier")).alias("source"))


def recommended_entry(chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """(chapter_id, formula_id): the first available formula of representative, backbone, full, else any of the chapter.

    chapters(chapter_id, representative, backbone, full: arrays), docs(formula_id, chapter_id, position).
    """
    listed = [chapters.select("chapter_id", F.lit(t).alias("tier"), F.posexplode(c).alias("o", "formula_id")) for t, c in enumerate(("representative", "backbone", "full"))]
    rows = listed[0].union(listed[1]).union(listed[2]).join(docs.select("formula_id"), "formula_id", "left_semi").select("chapter_id", "tier", F.col("o").cast("long").alias("o"), "formula_id")
    rows = rows.union(docs.select("chapter_id", F.lit(3).alias("tier"), F.col("position").cast("long").alias("o"), "formula_id"))
    return rows.groupBy("chapter_id").agg(F.min(F.struct("tier", "o", "formula_id")).alias("b")).select("chapter_id", "b.formula_id")


def chapter_edges(formulas: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (chapter_id, target_id, dependent_id) with both ends in the chapter."""
    at = lambda side: formulas.select(F.col("formula_id").alias(side), F.col("chapter_id").alias(f"{side}_c"))
    d = edges.join(at("target_id"), "target_id").join(at("dependent_id"), "dependent_id").filter("target_id_c = dependent_id_c")
    return d.select(F.col("target_id_c").alias("chapter_id"), "target_id", "dependent_id").distinct()


def key_concepts(annotations: DataFrame, k: int = 4) -> DataFrame:
    """(formula_id, ordinal, note): of accent and acronym annotations(formula_id, kind, rank, note) the first ``k`` distinct notes.

    The annotations of a formula may come in one row, as ``notes`` (kind, rank, note); then nothing is gathered or moved.
    """
    if "notes" in annotations.columns:
        fit = F.transform(F.filter("notes", lambda x: x["kind"].isin("accent", "acronym")), lambda x: F.struct(x["rank"], x["note"]))
        first = F.slice(F.array_distinct(F.transform(F.array_sort(fit), lambda x: x["note"])), 1, k)
        return annotations.select("formula_id", F.posexplode(first).alias("ordinal", "note")).select("formula_id", F.col("ordinal").cast("long").alias("ordinal"), "note")
    d = annotations.filter("kind in ('accent', 'acronym')").groupBy("formula_id", "note").agg(F.min("rank").alias("rank"))
    r = F.row_number().over(Window.partitionBy("formula_id").orderBy("rank", "note"))
    return d.withColumn("r", r).filter(F.col("r") <= k).select("formula_id", (F.col("r") - 1).cast("long").alias("ordinal"), "note")
