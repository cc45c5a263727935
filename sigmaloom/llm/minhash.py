"""Operator 8, MinHash near-duplicates with tensored banding.

A document is its set of distinct word shingles. Two small collections of ``side`` bands hold ``depth`` minhashes
each; every pair of a band of the first and a band of the second is the key of a table. So side * side tables
need 2 * side * depth minhashes, not side * side * 2 * depth. Documents that share a key are candidates; their
full sets confirm each link.

* Equal sets become one class first (by two 64-bit sums over the set, hashed to the class's id); only classes go on.
* A key with up to ``SMALL`` classes yields all its pairs. In a larger group every class is held against the
  group's cleanest one P (fewest shingles that no other class of large groups has), and against the next cleanest.
  With d the size of the symmetric difference to P and q the lone shingles, which all count in d and in no other's,
  two classes share at most min(d - q, d' - q') of their differences, so at similarity t a link needs
  d - c n <= d' - 2 q' + c n' and the same the other way round, c = (1 - t) / (1 + t). Classes of different
  components that pass both are compared. A link needs (d + d' - c (n + n')) / 2 common differences, of which at most
  the smaller lack of P's shingles is common lack. Where that leaves none to what they add to P, one of the two is
  next to P; otherwise both meet in a prefix, by rarity, of what they add (the lone ones first, P's own last).
  So no link between components is lost.
* Candidates whose minhashes agree in fewer than ``least_equal`` places or whose sizes differ too much are dropped:
  a link at the threshold falls below with probability under 1e-6.

Defined results: words are split at ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is
one shingle; without words the set is empty and links with nothing; a null doc_id is never linked; rows with
words and equal doc_id share a component, and each of their texts is compared; an empty table gives no row.

A link of similarity s is missed by all tables with probability about 2 (1 - s^depth)^side: 7e-5 at 0.85.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import LOWER, NOT_SPACE, Bits, Rolling, mixed, slices, word_spans, written

SIDE, DEPTH = 8, 2
SMALL = 16
PIVOTS = 2
#: Parts among which the classes next to a pivot are dealt.
PARTS = 8
#: Partners of a pivot in a part.
PART = 64
#: Sets in one Arrow batch; a set of a long text takes 100 KB and more.
ROWS = 500


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row of a slice, one row after the other, and where each row's begin."""
    rows = len(offsets) - 1
    starts, stops, row = word_spans(data, offsets, NOT_SPACE)
    words = Rolling(LOWER[data]).of(starts, stops) if len(starts) else np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    grams = np.maximum(np.where(n > 0, 1, 0), n - k + 1)
    where = np.repeat(np.arange(rows), grams)
    at = np.arange(len(where)) - np.repeat(np.concatenate([[0], np.cumsum(grams)])[:-1], grams) + first[where]
    end = np.minimum(at + k, first[where + 1])
    hashes = Rolling(words).of(at, end) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, where))
    hashes, where = hashes[order], where[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (where[1:] != where[:-1])
    hashes, where = hashes[fresh], where[fresh]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=rows))])


def _seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(count, 2)


def signatures(docs: DataFrame, k: int, hashes: int) -> DataFrame:
    """(doc_id, t, n, s1, s2, mins): hash of the text, size of the set, two sums that identify it, and its minhashes (32 bits each)."""
    seeds = _seeds(hashes)

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            h, ends = shingles(data, offsets, k)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            mins = np.zeros((len(n), hashes), np.uint32)
            sums = np.zeros((2, len(n)), np.uint64)
            if len(full):
                at = ends[:-1][full]
                for j, (a, b) in enumerate(seeds):
                    mins[full, j] = np.minimum.reduceat((((h ^ a) * (b | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), at)
                sums[0, full] = np.add.reduceat(mixed(h), at)
                sums[1, full] = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
            packed = pa.Array.from_buffers(pa.binary(4 * hashes), len(n), [None, pa.py_buffer(np.ascontiguousarray(mins))])
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "t": rows.column("t"), "n": pa.array(n.astype("int64")), "s1": pa.array(sums[0].view(np.int64)), "s2": pa.array(sums[1].view(np.int64)), "mins": packed.cast(pa.binary())})

    d = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return d.mapInArrow(run, d.select("doc_id", "t").schema.add("n", "long").add("s1", "long").add("s2", "long").add("mins", "binary"))


def table_keys(classes: DataFrame, side: int, depth: int) -> DataFrame:
    """(key, id) for every class and each of the side * side tables."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32).reshape(len(ids), 2, side, depth).astype(np.uint64)
            band = np.zeros(mins.shape[:3], np.uint64)
            for j in range(depth):
                band = mixed(band ^ mins[..., j]) + np.uint64(j + 1)
            table = np.arange(side * side, dtype=np.uint64).reshape(side, side)
            key = mixed(band[:, 0, :, None] * np.uint64(0x9E3779B97F4A7C15) + mixed(band[:, 1, None, :]) + table)
            yield pa.record_batch({"key": pa.array(key.reshape(-1).view(np.int64)), "id": ids.take(pa.array(np.repeat(np.arange(len(ids)), side * side)))})

    return classes.select("id", "mins").mapInArrow(run, "key long, id long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, items): sorted shingle hashes of the texts named in ``ids``(id, doc_id, t); a Bloom filter keeps other texts out of the shuffle."""
    bits = Bits(ids.select(F.xxhash64("doc_id", "t").alias("h")), "h")

    def near(batches):
        for batch in batches:
            h = np.asarray(batch.column("h").to_numpy(zero_copy_only=False)).view(np.uint64)
            yield batch.filter(pa.array(bits.has(h)))

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            h, ends = shingles(data, offsets, k)
            raw = h.tobytes()
            yield pa.record_batch({"id": rows.column("id"), "items": pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    d = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), "text").withColumn("h", F.xxhash64("doc_id", "t"))
    d = d.mapInArrow(near, d.schema).drop("h").join(ids, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    return d.select("id", "text").mapInArrow(run, "id long, items binary")


def with_sets(pairs: DataFrame, sets: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``pairs`` (left, right) with a, b: the sets of both, and the further columns of ``own`` for the left one.

    A right one with many partners is dealt by parts of PART partners, so that none is one task.
    """
    deal = pairs.groupBy("right").agg(F.count("*").alias("_c")).withColumn("_parts", F.ceil(F.col("_c") / PART).cast("int")).drop("_c")
    deal = written(deal, "minhash-deal")
    a = (sets if own is None else own).withColumnsRenamed({"id": "left", "items": "a"})
    b = sets.select(F.col("id").alias("right"), F.col("items").alias("b")).join(deal, "right").select("right", "b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = pairs.join(deal, "right").withColumn("_part", F.pmod(F.xxhash64("left"), F.col("_parts")).cast("int")).drop("_parts")
    return dealt.join(a, "left").join(b, ["right", "_part"]).drop("_part")


def shared_counts(pairs: DataFrame) -> DataFrame:
    """(left, right, both, n_left, n_right) of (left, right, a, b): sizes of the sets of each pair and of their intersection."""

    def run(batches):
        for batch in batches:
            got = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                got.append((len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            made = np.array(got, np.int64).reshape(-1, 3)
            yield pa.record_batch({"left": batch.column("left"), "right": batch.column("right"), "both": pa.array(made[:, 0]), "n_left": pa.array(made[:, 1]), "n_right": pa.array(made[:, 2])})

    return pairs.select("left", "right", "a", "b").mapInArrow(run, "left long, right long, both long, n_left long, n_right long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (left, right) whose sets have num * union <= den * intersection."""
    a = sets.select(F.col("id").alias("left"), F.col("items").alias("a"))
    b = sets.select(F.col("id").alias("right"), F.col("items").alias("b"))
    return shared_counts(pairs.join(a, "left").join(b, "right")).filter(_linked(threshold)).select("left", "right")


def _linked(threshold: tuple[int, int]):
    return threshold[1] * F.col("both") >= threshold[0] * (F.col("n_left") + F.col("n_right") - F.col("both"))


def plausible(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int], least_equal: int) -> DataFrame:
    """Distinct pairs whose sizes and minhashes allow the threshold."""
    num, den = threshold
    info = lambda side: classes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("mins").alias(f"m_{side}"))
    d = pairs.distinct().join(info("left"), "left").join(info("right"), "right")
    d = d.filter((den * F.least("n_left", "n_right") >= num * F.greatest("n_left", "n_right")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("m_left", "m_right")]
            yield batch.select(["left", "right"]).filter(pa.array((m[0] == m[1]).sum(1) >= least_equal))

    return d.select("left", "right", "m_left", "m_right").mapInArrow(run, "left long, right long")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """(id, n, q, lone): size of each set, and the items that no other set has, with their number."""

    def items(batches):
        for batch in batches:
            raw = batch.column("items").to_pylist()
            yield pa.record_batch({"id": batch.column("id").take(pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))), "h": pa.array(np.frombuffer(b"".join(raw), np.int64))})

    once = sets.mapInArrow(items, "id long, h long").groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    q = once.groupBy("id").agg(F.count("*").alias("q"), F.collect_list("h").alias("lone"))  # a set's own items at most
    return sets.select("id", (F.octet_length("items") / 8).cast("long").alias("n")).join(q, "id", "left").na.fill(0, ["q"])


#: The id of a class, from the sums and the size of its set.
CLASS = "xxhash64(s1, s2, n)"


def same_document(sig: DataFrame) -> DataFrame:
    """(left, right): links between the classes of texts with equal doc_id."""
    d = sig.filter("n > 0 and doc_id is not null").select("doc_id", F.expr(CLASS).alias("right"))
    several = d.groupBy("doc_id").agg(F.min("right").alias("left"), F.max("right").alias("_m")).filter("left != _m").select("doc_id", "left")
    return d.join(several, "doc_id").filter("left != right").select("left", "right").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    hashes = 2 * side * depth
    s = threshold[0] / threshold[1]
    least_equal = max(0, math.floor(hashes * s - 5.2 * math.sqrt(hashes * s * (1 - s))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(signatures(docs, k, hashes), "minhash")
    first = sig.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "t", "mins")).alias("f"))
    classes = written(first.select("s1", "s2", "n", F.expr(CLASS).alias("id"), F.col("f.doc_id").alias("doc_id"), F.col("f.t").alias("t"), F.col("f.mins").alias("mins")), "minhash-classes")
    keys = table_keys(classes, side, depth)
    buckets = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high")).filter("c > 1")
    twos = buckets.filter("c = 2").select(F.col("low").alias("left"), F.col("high").alias("right"))
    more = written(keys.join(buckets.filter("c > 2").select("key", "c", "low"), "key"), "minhash-keys")
    lists = more.filter(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # SMALL at most
    few = lists.select(F.posexplode("ids").alias("p", "left"), "ids").select("left", F.explode(F.slice("ids", F.col("p") + 2, F.lit(SMALL))).alias("right"))
    pairs = written(plausible(twos.union(few), classes, threshold, least_equal), "minhash-pairs")
    # the groups of all tables with one smallest class are one group: a cluster is not met once a table, and no pair is lost
    large = more.filter(F.col("c") > SMALL).select(F.col("low").alias("key"), "id").distinct()
    large = written(large, "minhash-large")
    ids = pairs.select(F.col("left").alias("id")).union(pairs.select("right")).union(large.select("id")).distinct()
    ids = written(classes.select("id", "doc_id", "t").join(ids, "id", "left_semi"), "minhash-ids")
    sets = written(full_sets(docs, ids, k), "minhash-sets", ROWS)
    links = written(confirmed(pairs, sets, threshold), "minhash-links", ROWS)
    if not large.isEmpty():
        links = links.union(large_group_links(large, classes, sets, links, threshold, least_equal))
    found = connected_components(links.union(same_document(sig)))
    parts = classes.select("id", "doc_id").join(found, "id")
    least = parts.groupBy("component").agg(F.min("doc_id").alias("least"))
    parts = written(parts.join(least, "component").select("id", "least"), "minhash-parts")
    of_class = classes.select("s1", "s2", "n", "id", "doc_id").join(parts, "id", "left").select("s1", "s2", "n", F.coalesce("least", "doc_id").alias("component"))
    out = sig.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def added_shingles(pairs: DataFrame) -> DataFrame:
    """(pivot, id, h) of (left, right, a, b, lone): the items of each class that its pivot lacks and some other class has."""

    def run(batches):
        for batch in batches:
            extra = []
            for a, b, own in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("lone"), strict=True):
                x = np.setdiff1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)
                extra.append(np.setdiff1d(x, own.values.to_numpy().view(np.uint64), assume_unique=True) if own.is_valid else x)
            row = pa.array(np.repeat(np.arange(len(extra)), [len(x) for x in extra]))
            h = np.concatenate(extra) if extra else np.zeros(0, np.uint64)
            yield pa.record_batch({"pivot": batch.column("right").take(row), "id": batch.column("left").take(row), "h": pa.array(h.view(np.int64))})

    return pairs.select("right", "left", "a", "b", "lone").mapInArrow(run, "pivot long, id long, h long")


def large_group_links(large: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, threshold: tuple[int, int], least_equal: int) -> DataFrame:
    """Links that join the components of groups too large for all their pairs."""
    num, den = threshold
    c = (den - num) / (den + num)
    clean = written(lone_shingles(sets.join(large.select("id").distinct(), "id", "left_semi")), "minhash-lone", ROWS)
    members = written(large.join(clean.select("id", "n", "q"), "id").withColumn("reach", ((F.col("n") - F.col("q")) * den / num - F.col("n"))), "minhash-members")
    # the cleanest of each of 64 parts first, so that no group is ranked in one task
    share = members.withColumn("share", F.col("q") / F.col("n"))
    part = F.row_number().over(Window.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("share", "id"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("share", "id"))
    pivots = share.withColumn("_r", part).filter(F.col("_r") <= PIVOTS).withColumn("_r", rank).filter(F.col("_r") <= PIVOTS)
    pivots = written(pivots.select("key", F.col("id").alias("pivot"), F.col("q").alias("pq"), F.col("reach").alias("preach"), "_r"), "minhash-pivots")
    lead = pivots.filter("_r = 1").select("key", "pivot")
    first = members.join(lead, "key").filter("id != pivot").select(F.col("id").alias("left"), F.col("pivot").alias("right")).distinct()
    first = written(shared_counts(with_sets(first, sets)), "minhash-first", ROWS)
    near = members.join(pivots.filter("_r > 1"), "key").filter("id != pivot and q <= preach and pq <= reach")
    near = near.select(F.least("id", "pivot").alias("left"), F.greatest("id", "pivot").alias("right"))
    star = confirmed(written(plausible(near, classes, threshold, least_equal), "minhash-star"), sets, threshold)
    star = written(star.union(first.filter(_linked(threshold)).select("left", "right")), "minhash-links", ROWS)
    parts = written(connected_components(links.union(star)), "minhash-parts")

    # what tells a class from its group's first pivot bounds its links to all others of the group
    of_pivot = members.select("key", "id", "n", "q").join(lead, "key").select("pivot", "id", "n", "q").distinct()
    apart = first.select(F.col("left").alias("id"), F.col("right").alias("pivot"), (F.col("n_left") - F.col("both")).alias("added"), (F.col("n_right") - F.col("both")).alias("removed"))
    m = of_pivot.join(apart, ["id", "pivot"], "left").na.fill(0, ["added", "removed"]).join(parts, "id", "left")
    m = m.withColumns({"comp": F.coalesce("component", "id"), "d": F.col("added") + F.col("removed")})
    m = m.withColumns({"least": F.col("d") - c * F.col("n") - 1e-6, "most": F.col("d") - 2 * F.col("q") + c * F.col("n"), "v": c * F.col("n") - F.col("added") + 1e-6}).drop("component")
    # per pivot the two components that reach furthest: a class is open if one outside its own reaches it
    ends = m.groupBy("pivot", "comp").agg(F.max("most").alias("most"), F.max("v").alias("v"))
    two = ends.groupBy("pivot").agg(*[F.max(F.struct(x, "comp")).alias(f"one_{x}") for x in ("most", "v")])
    second = lambda x: F.max(F.when(F.col("comp") != F.col(f"one_{x}.comp"), F.col(x))).alias(f"two_{x}")
    two = ends.join(two, "pivot").groupBy("pivot", "one_most", "one_v").agg(second("most"), second("v")).filter("two_most is not null")
    outside = lambda x: F.when(F.col("comp") == F.col(f"one_{x}.comp"), F.col(f"two_{x}")).otherwise(F.col(f"one_{x}.{x}"))
    # next to the pivot, or such that a component outside holds one that is
    opened = m.join(two, "pivot").filter(outside("most") >= F.col("least")).withColumn("next", F.col("v") + outside("v") >= 0).drop("one_most", "one_v", "two_most", "two_v")
    opened = written(opened, "minhash-open")
    told = ("id", "comp", "n", "d", "added", "removed", "least", "most")
    both = F.expr("comp != _comp and least <= _most and _least <= most")
    # shingles that both add to the pivot's: what both lack of it covers the smaller of the two lacks at most
    need = (F.col("d") + F.col("_d") - c * (F.col("n") + F.col("_n"))) / 2 - F.least("removed", "_removed") - 1e-6
    few = _next_to_pivot(opened, told, both & (need <= 0))
    own = sets.join(clean.select("id", "lone"), "id", "left")
    h = added_shingles(with_sets(opened.select(F.col("id").alias("left"), F.col("pivot").alias("right")), sets, own))
    h = written(_rarest(written(h, "minhash-added", ROWS), opened, threshold).select("pivot", "h", *told), "minhash-prefix")
    many = h.join(h.select("pivot", "h", *[F.col(x).alias(f"_{x}") for x in told]), ["pivot", "h"]).filter((F.col("id") < F.col("_id")) & both & (need > 0)).select("id", "_id")
    rest = few.union(many).select(F.col("id").alias("left"), F.col("_id").alias("right"))
    rest = written(confirmed(written(plausible(rest, classes, threshold, least_equal), "minhash-rest"), sets, threshold), "minhash-links", ROWS)
    return star.union(rest)


def _next_to_pivot(opened: DataFrame, told: tuple[str, ...], both: Column) -> DataFrame:
    """(id, _id): the pairs that pass ``both`` of ``opened`` of one pivot that may need no common addition to it: c n - added of the two sums to 0 or more, so one of them is next to the pivot."""
    m = opened.filter("next")
    # the side next to the pivot meets the whole of the other; both are dealt by parts, so that no pivot is one task
    part, parts = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"), F.explode(F.array(*[F.lit(i) for i in range(PARTS)]))
    near = m.filter("v >= 0").select("pivot", part.alias("part"), *told)
    whole = m.select("pivot", parts.alias("part"), *[F.col(x).alias(f"_{x}") for x in told])
    return near.join(whole, ["pivot", "part"]).filter(both).select(F.least("id", "_id").alias("id"), F.greatest("id", "_id").alias("_id")).distinct()


def _rarest(added: DataFrame, opened: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of each class's additions to its pivot the prefix by rarity that a linked class must meet.

    In the order lone shingles, additions by how many classes of the pivot have them, the pivot's own, the first
    n - ceil(t n) + 1 of two linked sets meet; lone ones meet none, and additions only additions.
    """
    num, den = threshold
    often = added.groupBy("pivot", "h").agg(F.count("*").alias("f"))
    n, q = F.col("n"), F.col("q")
    prefix = n - F.ceil(n * num / den - 1e-9) + 1 - q
    d = added.join(often, ["pivot", "h"]).join(opened.filter(prefix > 0), ["pivot", "id"])
    rank = F.row_number().over(Window.partitionBy("pivot", "id").orderBy("f", "h"))
    return d.withColumn("_rank", rank).filter((F.col("_rank") <= prefix) & (F.col("f") > 1))
