"""Operator 10, benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Seeds are the benchmark's ``least``-word
strings, and the whole of an item with fewer words; documents and test items that share one are joined. For each pair
the longest common stretches of words are marked again and again, never overlapping, down to the seed's length; running
Karp-Rabin hashes over what is still free find them, in memory linear in the two texts however often words repeat. A document
is contaminated by an item if the tiles cover at least ``coverage`` of the item's words; tiles may stand in any order
in the document, so reordered passages are caught.

Defined results: a null or empty text or item, and a text with fewer words than a seed, match nothing (coverage 0);
an item of fewer than ``least`` words is matched by all its words in order;
of several items the one with most coverage counts, then the smallest item_id; repeated rows are judged alike; an
empty benchmark leaves every document clean.

A Bloom filter of fixed size over the seeds marks the documents that may share one; only their word hashes move.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import ALNUM, LOWER, Bits, Rolling, slices, word_spans, written

LEAST = 5
COVERAGE = 0.8


def word_rows(rows: DataFrame, id_column: str, lengths: list[int], bits: Bits | None = None) -> DataFrame:
    """(id_column, key, n_words, words, seeds): word hashes (8 bytes each) and distinct seed hashes.

    With ``bits`` seeds have any of ``lengths`` words and go, with the words, only if it lets them through; without, they
    have the greatest of ``lengths``, or all words of a shorter text.
    """

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            starts, stops, row = word_spans(data, offsets, ALNUM)
            h = Rolling(LOWER[data]).of(starts, stops)
            count = np.bincount(row, minlength=len(rows))
            ends = np.concatenate([[0], np.cumsum(count)])
            rolling, place, seed = Rolling(h), [], []
            for least in lengths if bits is not None else range(1, max(lengths) + 1):
                at = np.arange(max(0, len(h) - least + 1))
                at = at[row[at] == row[at + least - 1]] if len(at) else at
                if bits is None and least < max(lengths):
                    at = at[count[row[at]] == least]
                got = rolling.of(at, at + least)
                if bits is not None:
                    near = bits.has(got)
                    at, got = at[near], got[near]
                place.append(at)
                seed.append(got)
            place, seed = np.concatenate(place), np.concatenate(seed)
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], ends)
            words, seeds = [], []
            for i in range(len(rows)):
                if cut[i + 1] > cut[i]:
                    words.append(h[ends[i] : ends[i + 1]].tobytes())
                    seeds.append(np.unique(seed[order[cut[i] : cut[i + 1]]]).view(np.int64).tolist())
                else:
                    words.append(None)
                    seeds.append(None)
            yield pa.record_batch({id_column: rows.column(id_column), "key": rows.column("key"), "n_words": pa.array(np.diff(ends)), "words": pa.array(words, pa.binary()), "seeds": pa.array(seeds, pa.list_(pa.int64()))})

    d = rows.select(id_column, F.xxhash64(id_column, "text").alias("key"), "text")
    return d.mapInArrow(run, d.select(id_column, "key").schema.add("n_words", "long").add("words", "binary").add("seeds", ArrayType(LongType())))


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words of ``item`` that greedy string tiling with ``text`` covers, by tiles of ``least`` words or all of a shorter item.

    The longest stretch common to what is free in both is sought by bisection over lengths, for each of which running
    hashes are compared; all stretches of that length are marked, the earliest in the item first and each with the
    earliest free place in the text, and the search goes on below. Memory is linear in both.
    """
    least = max(1, min(least, len(item)))
    if len(text) < least or not len(item):
        return 0
    one, two = Rolling(text), Rolling(item)
    t = np.arange(len(text) - least + 1)
    p = np.arange(len(item) - least + 1)
    # a stretch begins with a seed of both
    a, b = one.of(t, t + least), two.of(p, p + least)
    t, p = t[np.isin(a, b)], p[np.isin(b, a)]
    used_t, used_p = np.zeros(len(text), np.int32), np.zeros(len(item), np.int32)

    def free(at: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
        at = at[at + n <= len(used)]
        so_far = np.concatenate([[0], np.cumsum(used)])
        return at[so_far[at + n] == so_far[at]]

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, y = free(t, used_t, n), free(p, used_p, n)
        a, b = one.of(x, x + n), two.of(y, y + n)
        y = y[(both := np.isin(b, a))]
        return x, a, y, b[both]

    most = min(len(text), len(item))
    while most >= least and len(t) and len(p) and len(common(least)[2]):
        low = least
        while low < most:
            mid = (low + most + 1) // 2
            if len(common(mid)[2]):
                low = mid
            else:
                most = mid - 1
        x, a, y, b = common(low)
        order = np.argsort(a, kind="stable")
        ends, next_of = np.searchsorted(a[order], b, "right"), {}
        begins = np.searchsorted(a[order], b, "left")
        for i, begin, end in zip(y.tolist(), begins.tolist(), ends.tolist(), strict=True):
            if used_p[i] or used_p[i + low - 1]:
                continue
            at = next_of.get(begin, begin)
            while at < end and (used_t[x[order[at]]] or used_t[x[order[at]] + low - 1]):
                at += 1
            next_of[begin] = at
            if at < end:
                used_p[i : i + low] = 1
                used_t[x[order[at]] : x[order[at]] + low] = 1
        most = low - 1
    return int(used_p.sum())


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(one row per row of ``docs``: doc_id, key, n_words), (doc key, item_id, n_item, covered) for all pairs that share a seed."""
    items = written(word_rows(benchmark.select("item_id", "text"), "item_id", [least]), "gst-items").filter("seeds is not null")
    lengths = sorted(r[0] for r in items.select(F.least(F.lit(least), F.col("n_words"))).distinct().collect()) or [least]  # at most ``least`` numbers
    seeds = items.select("item_id", F.col("key").alias("item"), F.explode("seeds").alias("seed"))
    marked = written(word_rows(docs.select("doc_id", "text"), "doc_id", lengths, Bits(seeds, "seed")), "gst-docs")
    hit = marked.filter("seeds is not null").select("key", "words", "seeds").dropDuplicates(["key"])
    pairs = hit.select("key", F.explode("seeds").alias("seed")).join(seeds.select("item", "seed"), "seed").select("key", "item").distinct()

    def run(batches):
        for batch in batches:
            got = [tiles(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), least) for a, b in zip(batch.column("words").to_pylist(), batch.column("item_words").to_pylist(), strict=True)]
            yield pa.record_batch({"key": batch.column("key"), "item_id": batch.column("item_id"), "n_item": batch.column("n_item"), "covered": pa.array(got, pa.int64())})

    known = items.dropDuplicates(["key"]).select(F.col("key").alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("n_words").alias("n_item"), F.col("words").alias("item_words"))
    both = pairs.join(known, "item").join(hit.select("key", "words"), "key")
    return marked.select("doc_id", "key", "n_words"), both.select("key", "item_id", "n_item", "words", "item_words").mapInArrow(run, "key long, item_id long, n_item long, covered long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, key, n_words, item_id, n_item, covered, coverage, contaminated): the most covered item of each document."""
    every, pairs = benchmark_overlap(docs, benchmark, least)
    share = F.col("covered") / F.col("n_item")
    best = pairs.filter("covered > 0").groupBy(F.col("key").alias("k")).agg(F.max_by(F.struct("item_id", "n_item", "covered"), F.struct(share, -F.col("item_id"))).alias("b"))
    out = every.join(best, F.col("key") == F.col("k"), "left").select("doc_id", "key", "n_words", "b.*")
    covered = F.coalesce(F.col("covered") / F.col("n_item"), F.lit(0.0))
    return out.select("doc_id", "key", "n_words", "item_id", F.coalesce("n_item", F.lit(0)).alias("n_item"), F.coalesce("covered", F.lit(0)).alias("covered"), covered.alias("coverage"), (covered >= coverage).alias("contaminated"))
