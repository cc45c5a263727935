"""A corpus pipeline of five stages: language ID, near-duplicates, repeated strings, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage to the shared folder and reads it back, so a lost
executor costs one stage at most. Texts pass Python in Arrow batches of a few MB: stages lower the session's
``spark.sql.execution.arrow.maxBytesPerBatch`` where it is higher.

Every stage: an empty table gives an empty one; columns of ``docs`` beyond the five of ``documents`` are left out,
whatever their names; repeated rows are rows of their own; null ids and sources stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaloom.functions.work import bound_batches, written
from sigmaloom.llm import decontam, langid, minhash, mixing, suffix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; ``lang`` is filled in where it was null. Learned on the documents with a language that are not held out.

    Texts that are null or without a letter go; equal likelihoods take the first language in code point order.
    """
    bound_batches(spark)
    model = langid.train(docs.filter(~langid.held_out()))
    kept = [c for c in COLUMNS if c != "text"]

    found = langid.identify(docs.select(*COLUMNS), model, COLUMNS)
    found = found.filter("lang_pred != 'und'")
    return found.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), *kept[2:])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at similarity 0.8: of the smallest doc_id (null last), then of the least hash.

    Rows are told apart by a number of their own, so repeated rows, null ids and equal ids with different texts are
    each linked by their text, and one row of a group stays. Rows without words, or with a null text, link with
    nothing and stay.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "near-duplicate-rows")
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "row")
    least = rows.select("row", order.alias("o")).join(found, "row").groupBy("component_id").agg(F.min("o").alias("o"))
    gone = found.select("row").join(least.select("o.row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that stand elsewhere too; characters cut in two go as well.

    Null texts become empty ones; a text that is repeated as a whole stays as an empty one.
    """
    bound_batches(spark)
    cut = suffix.cut_repeats(docs, keep=["doc_id", "lang", "source", "n_chars", "text"])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 per cent or more; null and empty texts stay, and an empty benchmark takes none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.contaminated(docs, benchmark).filter("contaminated").select("key").distinct()
    return docs.withColumn("key", F.xxhash64("doc_id", "text")).join(gone, "key", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): what the mix takes of each document; null texts have size 0."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Language mixtures, minhash links and repeated byte strings cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
