"""Operator 9, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a target
stops at ``cap`` times its source's words and the excess goes to the others by weight until none is above.
Blocks: all words make blocks of ``block`` words; the highest quotients target/1, target/3, ... hand them to
the sources, and again each source's blocks to its shards by their words. In a shard the documents stand in
seeded order; its blocks cover them from the start, as often as they go round.

Defined results: a null text has size 0 and takes 0; a null source is a source; repeated rows count each;
no document takes more than ``cap`` times its size; an empty table gives no row. Same rows and seed, same
result, whatever the partitions.

Shuffled are (doc_id, source, size) only. A source of any share splits into shards of at most
max(65,536, all words / 4,096) words or so; the apportionment itself runs on one row per source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD_WORDS = 1 << 16
MOST_SHARDS = 4096
#: A source table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, total, target): the capped targets, found in one pass over the sources in the order in which caps bind."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("most", F.col("source_size") * cap).withColumn("binds", F.col("most") / F.col("weight"))
    order = Window.orderBy("binds", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - capped) / left)
    level = F.max(F.when(F.col("level") <= F.col("binds"), F.col("level"))).over(everything)
    return per.withColumn("level", level).select("source", "source_size", "total", F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def sainte_lague(rows: DataFrame, group: list[str], votes: str, seats: str, tie: list[Column]) -> DataFrame:
    """``rows`` with quota: the seats of the group (a column that holds their number) by highest votes/(2k-1).

    Only quotients near the common divisor are listed: with m rows in a group, about two for each. At the divisor
    V/(n-m/2) no row has too many seats, at V/(n+m/2) none too few; the quotients in between are ranked.
    """
    whole = Window.partitionBy(*group)
    v = F.col(votes).cast("double")
    rows = rows.withColumn("_v", F.sum(v).over(whole)).withColumn("_m", F.count("*").over(whole))
    at = lambda n: F.when((F.col("_v") > 0) & (n > 0), F.floor(v * n / F.col("_v") + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("_low", at(F.col(seats) - F.col("_m") / 2)).withColumn("_high", F.when(v > 0, at(F.col(seats) + F.col("_m") / 2) + 1).otherwise(0).cast("long"))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(whole)).withColumn("_row", F.row_number().over(whole.orderBy(*tie)))
    listed = rows.filter("_high > _low").select(*group, "_row", "_left", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"), v.alias("_votes"))
    rank = F.row_number().over(whole.orderBy((F.col("_votes") / (2 * F.col("_k") - 1)).desc(), "_row", "_k"))
    won = listed.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*group, "_row").agg(F.count("*").alias("_won"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = rows.alias("a").join(won.alias("b"), same & (F.col("a._row") == F.col("b._row")), "left")
    kept = [F.col(f"a.{c}") for c in rows.columns if c[0] != "_"]
    return out.select(*kept, (F.col("a._low") + F.coalesce("b._won", F.lit(0))).alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, cap)
    targets = targets.withColumn("blocks", F.floor(F.col("total") / block)).withColumn("_all", F.lit(1))
    targets = sainte_lague(targets, ["_all"], "target", "blocks", [F.col("source").asc_nulls_last()]).withColumnRenamed("quota", "source_quota")
    part = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.col("total") / MOST_SHARDS))
    targets = written(targets.select("source", "source_size", "target", "source_quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / part)).cast("int").alias("n_shards")), "mix-targets")
    small = F.broadcast if targets.count() <= BROADCAST_ROWS else (lambda x: x)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "source_quota", "n_shards")
    placed = sizes.join(small(t), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_shards")))

    shards = placed.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(shards, ["source"], "shard_size", "source_quota", [F.col("shard")])
    take = F.least(F.col("quota") * block, F.col("shard_size") * cap)
    quotas = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), F.floor(take / F.greatest("shard_size", F.lit(1))).alias("rounds"), F.when(F.col("shard_size") > 0, take % F.greatest("shard_size", F.lit(1))).otherwise(0).alias("rest"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("before", before).join(small(quotas), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    taken = F.col("rounds") * F.col("size") + F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
