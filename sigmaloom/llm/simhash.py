"""Operator 11, SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit for each of 64 places: 1 where over half of the text's shingle hashes have it. Equal fingerprints
are one leaf; leaves at ``distance`` or fewer differing bits are linked.

* The 64 bits fall into ``distance + 2`` segments. Linked fingerprints agree in two of them at least, so each pair of
  segments gives a table whose top nodes share the bits of both. The other bits, in a row, are read as a Gray code.
* Each table is sorted by (top node, Gray rank) and dealt by range, so a top node of any size falls into parts. Gray
  neighbours differ in few bits, so a run of consecutive leaves shares many: such a group is a node, the bits that all its
  leaves share and their values. Groups make blocks, blocks make upper nodes (Sizes).
* Differences add up on the way down: the bits that two nodes share, and differ in, bound all pairs below them. A pair of
  nodes beyond the distance is dropped with everything below; a pair of groups whose other bits cannot reach beyond the
  distance is linked as a whole, without looking at its leaves.
* Every block and every pair of blocks sends on a spanning forest of its links, so a dense group costs a link a leaf.
  Top nodes up to ``small`` leaves, nearly all of them, are compared in one pass over the sorted rows.

So no link is missed at any size, and nothing is capped: a top node of n leaves costs (n / block) ^ 2 pairs of blocks at
most, dealt as rows of a join.

Defined results: A-Z are lower-cased, words split at ASCII white space; a text with fewer words than a shingle is one
shingle; a null or wordless text has fingerprint zero, which is linked like any other; rows of one doc_id are linked; a
null doc_id is never the smallest, and a component of such rows alone has a null id; repeated rows are rows of their own;
an empty table gives no row; columns beyond doc_id and text are left out.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import slices, written


class Sizes(NamedTuple):
    """Leaves of a group, leaves of a block, blocks of an upper node, and leaves of a top node that are compared without an index."""

    leaves: int = 16
    block: int = 1024
    blocks: int = 32
    small: int = 16


#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, k: int, seed: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts, stops = [0, *ends[: max(0, len(words) - k)]], ends[min(k, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            raw = data.tobytes()
            made = np.array([fingerprint(raw[a:b], k, seed) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "fp": pa.array(made.view(np.int64))})

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, d.select("doc_id").schema.add("fp", "long"))


def segments(count: int) -> list[tuple[int, int]]:
    """(place, width) of ``count`` near-even segments of the 64 bits."""
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    return list(zip(accumulate([0, *widths[:-1]]), widths, strict=True))


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each word in the sequence of Gray codes."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits ^ (bits >> np.uint64(s))
    return bits


def arranged(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table the top node (the table's number and the bits of its two segments) and the Gray rank of the other bits."""
    parts = segments(distance + 2)

    def row_of(some):
        out = np.zeros(len(fp), np.uint64)
        for place, width in some:
            out = (out << np.uint64(width)) | ((fp >> np.uint64(place)) & np.uint64((1 << width) - 1))
        return out

    tables = []
    for i, pair in enumerate(combinations(parts, 2)):
        shared = sum(width for _, width in pair)
        top = row_of(pair) | np.uint64(i << shared)
        tables.append((top, gray_rank(row_of([p for p in parts if p not in pair]))))
    return tables


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the links (a, b) with the smallest one it reaches."""
    if not len(a):
        return a, b
    known, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(known))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            far = label != np.arange(len(known))
            return known[far], known[label[far]]
        label = new


def nodes(fp: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits that all leaves share, their values) of each group of ``leaves`` consecutive fingerprints."""
    at = np.arange(0, len(fp), leaves)
    low = np.bitwise_and.reduceat(fp, at)
    shared = ~(np.bitwise_or.reduceat(fp, at) ^ low)
    return shared, low & shared


def block_links(one: np.ndarray, two: np.ndarray | None, distance: int, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of Gray-sorted fingerprints, or within ``one``."""
    other = one if two is None else two
    (m1, p1), (m2, p2) = nodes(one, leaves), nodes(other, leaves)
    both = m1[:, None] & m2[None, :]
    differ = np.bitwise_count((p1[:, None] ^ p2[None, :]) & both)
    near = differ <= distance
    if two is None:
        near &= np.arange(len(m1))[:, None] <= np.arange(len(m2))[None, :]
    whole = near & (differ.astype(np.int64) + np.bitwise_count(~both) <= distance)
    left, right = [], []
    for x, y in zip(*np.nonzero(whole), strict=True):
        members = np.concatenate([one[x * leaves : (x + 1) * leaves], other[y * leaves : (y + 1) * leaves]])
        left.append(members[1:])
        right.append(np.full(len(members) - 1, members[0]))
    x, y = np.nonzero(near & ~whole)
    for at in range(0, len(x), 2048):  # a bound on memory: the leaves of so many pairs of nodes at a time
        i = (x[at : at + 2048, None] * leaves + np.arange(leaves))[:, :, None]
        j = (y[at : at + 2048, None] * leaves + np.arange(leaves))[:, None, :]
        inside = (i < len(one)) & (j < len(other))
        u, v = one[np.minimum(i, len(one) - 1)], other[np.minimum(j, len(other) - 1)]
        hit = inside & (np.bitwise_count(u ^ v) <= distance) & (u != v)
        a, b = forest(np.broadcast_to(u, hit.shape)[hit], np.broadcast_to(v, hit.shape)[hit])
        left.append(a)
        right.append(b)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(left), np.concatenate(right))


LINKED = "left long, right long, top long, upper long, block long, shared long, value long, leaves binary"


def index(leaves: DataFrame, distance: int, sizes: Sizes) -> DataFrame:
    """Links found inside blocks (left, right), and the blocks of top nodes that hold several, in one written table."""

    def deal(batches):
        for batch in batches:
            raw = batch.column("fp").to_numpy()
            for top, rank in arranged(raw.view(np.uint64), distance):
                yield pa.record_batch({"top": pa.array(top.view(np.int64)), "rank": pa.array(rank.view(np.int64)), "fp": pa.array(raw)})

    def links_row(a, b):
        n, none = len(a), pa.nulls(len(a), pa.int64())
        ends = {"left": pa.array(a.view(np.int64)), "right": pa.array(b.view(np.int64))}
        return pa.record_batch({**ends, **{c: none for c in ("top", "upper", "block", "shared", "value")}, "leaves": pa.nulls(n, pa.binary())})

    def block_row(top, upper, rank, fp):
        shared = ~(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))
        none = pa.nulls(1, pa.int64())
        nums = [np.array([x]).astype(np.uint64).view(np.int64) for x in (top, upper, rank, shared, fp[0] & shared)]
        return pa.record_batch({"left": none, "right": none, **dict(zip(("top", "upper", "block", "shared", "value"), map(pa.array, nums), strict=True)), "leaves": pa.array([fp.tobytes()])})

    def grow(batches):
        """A pass over sorted rows: open ones wait for the rest of their block; ``made`` counts the blocks of the open top node."""
        first = True
        made, upper, open_top = 0, 0, None
        rest = [np.zeros(0, np.uint64)] * 3

        def close(top, rank, fp, whole):
            """A block is complete; the top node ends with it (``whole``) if no further rows of it can come."""
            nonlocal made, upper
            if made % sizes.blocks == 0:
                upper = rank[0]
            alone = whole and made == 0
            made += 1
            if len(fp) > 1:
                yield links_row(*block_links(fp, None, distance, sizes.leaves))
            if not alone:
                yield block_row(top, upper, rank[0], fp)

        def groups(top, rank, fp, final):
            nonlocal made, open_top, first
            cuts = np.flatnonzero(top[1:] != top[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(top)]])
            size = ends - starts
            # small top nodes inside the partition: all pairs at a distance of up to ``small`` rows
            plain = size <= sizes.small
            plain[0] &= not (first or made)
            plain[-1] = False
            row = np.repeat(plain, size)
            at = np.flatnonzero(row)
            for s in range(1, sizes.small):
                x = at[at + s < len(top)]
                x = x[(top[x] == top[x + s])]
                if not len(x):
                    break
                x = x[np.bitwise_count(fp[x] ^ fp[x + s]) <= distance]
                if len(x):
                    yield links_row(fp[x], fp[x + s])
            for g in np.flatnonzero(~plain).tolist():
                last = g == len(starts) - 1
                edge = first and g == 0 or last and final  # its other rows may be in the partition before or after
                if open_top != top[starts[g]]:
                    made, open_top = 0, top[starts[g]]
                for a in range(starts[g], ends[g], sizes.block):
                    b = min(a + sizes.block, ends[g])
                    if last and not final and b - a < sizes.block:
                        rest[:] = [v[a:b] for v in (top, rank, fp)]
                        break
                    yield from close(top[a], rank[a:b], fp[a:b], b == ends[g] and not edge and not (last and not final))
                else:
                    if last:
                        rest[:] = [v[:0] for v in (top, rank, fp)]
            if len(starts) > 1:
                first = False

        for batch in batches:
            if batch.num_rows:
                new = [batch.column(c).to_numpy().view(np.uint64) for c in ("top", "rank", "fp")]
                top, rank, fp = (np.concatenate(v) for v in zip(rest, new, strict=True))
                yield from groups(top, rank, fp, False)
        if len(rest[0]):
            yield from groups(*rest, True)

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.select("fp").mapInArrow(deal, "top long, rank long, fp long")
    dealt = dealt.repartitionByRange(parts, "top", "rank").sortWithinPartitions("top", "rank")
    return written(dealt.mapInArrow(grow, LINKED), "simhash-index")


def links_between(blocks: DataFrame, distance: int, sizes: Sizes) -> DataFrame:
    """(left, right): links between different blocks of one top node, down from pairs of upper nodes."""
    near = lambda a, b: f"bit_count(({a}value ^ {b}value) & {a}shared & {b}shared) <= {distance}"
    nodes_ = blocks.select("top", "upper", "block", "shared", "value")
    differing = F.bit_or("value").bitwiseXOR(F.bit_and("value"))
    upper = nodes_.groupBy("top", "upper").agg(F.bit_and("shared").bitwiseAND(F.bitwise_not(differing)).alias("shared"), F.bit_and("value").alias("value"))
    side = lambda d, s: d.withColumnsRenamed({c: f"{s}_{c}" for c in d.columns if c != "top"})
    pairs = side(upper, "l").join(side(upper, "r"), "top").filter("l_upper <= r_upper").filter(near("l_", "r_")).select("top", "l_upper", "r_upper")
    pairs = pairs.join(side(nodes_, "l"), ["top", "l_upper"]).join(side(nodes_, "r"), ["top", "r_upper"])
    pairs = written(pairs.filter("l_block < r_block").filter(near("l_", "r_")).select("top", "l_block", "r_block"), "simhash-pairs")
    held = blocks.select("top", "block", "leaves")
    pairs = pairs.join(side(held, "l"), ["top", "l_block"]).join(side(held, "r"), ["top", "r_block"])

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("l_leaves").to_pylist(), batch.column("r_leaves").to_pylist(), strict=True):
                a, b = block_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), distance, sizes.leaves)
                yield pa.record_batch({"left": pa.array(a.view(np.int64)), "right": pa.array(b.view(np.int64))})

    return pairs.select("l_leaves", "r_leaves").mapInArrow(run, "left long, right long")


def fingerprint_links(leaves: DataFrame, distance: int, sizes: Sizes = Sizes()) -> DataFrame:
    """(left, right): links that connect all fingerprints of (fp) within ``distance``, directly or through each other."""
    found = index(leaves, distance, sizes)
    inside = found.filter("left is not null").select("left", "right")
    return inside.union(links_between(found.filter("block is not null"), distance, sizes))


def near_fingerprints(docs: DataFrame, k: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    rows = written(fingerprints(docs, k, seed), "simhash")
    leaves = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-leaves")
    links = fingerprint_links(leaves, distance)
    ids = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("left"), F.max("fp").alias("_m")).filter("left != _m")
    links = links.union(rows.join(ids, "doc_id").filter("fp != left").select("left", F.col("fp").alias("right")))
    parts = connected_components(links).withColumnRenamed("id", "fp")
    parts = written(leaves.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-parts")
    least = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(parts.join(least, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
