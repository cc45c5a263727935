"""Operator 12, importance resampling towards a target distribution, with Arrow kernels.

Texts of a batch are lower-cased (``ascii_lower``), split (``split_pattern_regex``), flattened and dictionary-encoded;
n-grams are pairs of an n-gram one shorter and the dictionary index shifted by its place, made distinct per batch, so
that CRC runs once for each distinct n-gram. Two passes read the texts: the first counts features by hash bucket, each
task sending at most one row a bucket; the second takes the gains of the buckets and sums them over each row's segment.
The gains, ``buckets`` whole numbers whatever the corpus holds, are all that reaches the driver.

A Gumbel draw adds to each weight a noise that depends on the seed and doc_id alone, so reruns agree, and the highest
scores are a sample without replacement. Ranks come from a range partitioning by score: a rank is the rank in the part
plus the rows of the parts before, so no task ranks the whole table and equal scores do not share one.

Defined results: A-Z alone are lower-cased; a null or wordless text has no feature and weight 0; rows with a null
doc_id have no score, are not drawn and do not count for the share; repeated rows are rows of their own, in any order
among themselves; equal scores go by the smaller doc_id; an empty table gives no row, an empty target counts 0 in every
bucket; columns beyond doc_id and the text are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What separates words once A-Z are lower-cased: ASCII beyond digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and for n = 1, 2.. ``longest`` the rows and the buckets of all its n-grams."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")), SEPARATORS)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(parts).dictionary_encode()
    word, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
    full = np.array([len(w) > 0 for w in known], bool)[word] if known else np.zeros(0, bool)
    row, word = row[full], word[full]
    counts = np.bincount(row, minlength=len(texts))
    found, grams, code, at = [], known, word, np.arange(len(word))
    for n in range(1, longest + 1):
        if n > 1:  # the gram one shorter that starts at the same word, and the word after it
            whole = at + n - 1 < len(word)
            whole[whole] = row[at[whole]] == row[at[whole] + n - 1]
            code, at = code[whole], at[whole]
            distinct, code = np.unique(code * len(known) + word[at + n - 1], return_inverse=True)
            grams = [grams[d // len(known)] + b" " + known[d % len(known)] for d in distinct.tolist()]
        bucket = np.array([zlib.crc32(g) % buckets for g in grams], np.int64)
        found.append((row[at], bucket[code] if len(code) else code))
    return counts, found


def bucket_counts(texts: DataFrame, column: str, longest: int, buckets: int) -> dict[int, int]:
    """Features in every bucket over all texts; at most ``buckets`` rows leave a task and reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0), longest, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
            pa.default_memory_pool().release_unused()
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(some), "n": pa.array(total[some])})

    counts = texts.select(F.col(column).alias("text")).mapInArrow(run, "bucket long, n long")
    return {r.bucket: r.n for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Gain of each bucket: thousandths of the log ratio of its smoothed shares in the target and the source, rounded down."""
    s, t = sum(source.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((source.get(b, 0) + 1.0) * t))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row; rows of a batch are in order, so each is one segment."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            words, found = features(texts, longest, len(gain))
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for row, bucket in found:
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                n += np.diff(ends)
                weight += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(words.astype(np.int64)), "n_features": pa.array(n), "weight": pa.array(weight)})
            pa.default_memory_pool().release_unused()

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, d.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of SHA-256 over ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked_by_parts(rows: DataFrame, order: list[Column], within: Column, most: int) -> DataFrame:
    """``rows`` with rank (long): the place from 1 by ``order`` among those that hold ``within``, null beyond ``most``.

    ``rows`` is a written table. Its range partitions are written with their number, so that a task that runs again
    finds the same parts; only parts that begin before ``most`` are ranked.
    """
    first = F.when(within, 0).otherwise(1)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [first, *order, F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_in", within)
    dealt = written(dealt.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranked-parts")
    sizes = dealt.filter("_in").groupBy("_part").count().orderBy("_part").collect()  # one row a partition
    before, seen = [], 0
    for part, n in sizes:
        before.append((part, seen))
        seen += n
    before = rows.sparkSession.createDataFrame(before, "_part int, _before long").filter(F.col("_before") < most)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_row"))
    open_ = dealt.join(F.broadcast(before), "_part")  # as many rows as partitions
    rank = F.when(F.col("_before") + place <= most, F.col("_before") + place)
    ranked = open_.filter("_in").withColumn("rank", rank.cast("long")).select(*rows.columns, "rank")
    rest = dealt.join(F.broadcast(before), "_part", "left").filter("not _in or _before is null")
    return ranked.union(rest.select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; rank is null where a row is not drawn.

    ``percent`` of the rows with ``least_words`` words are drawn, the number rounded down.
    """
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, "text", longest, buckets), buckets)
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows, "resample")
    within = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = rows.filter(within).count() * percent // 100
    out = ranked_by_parts(rows, [F.col("score").desc(), F.col("doc_id").asc()], within, drawn)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
