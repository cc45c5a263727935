"""Connected components of a link table: spanning forests within partitions, then alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.work import written

#: Links that one task turns into a spanning forest at most.
TASK_LINKS = 250_000


def spanning_forest(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, b): every vertex of the links of each of ``tasks`` partitions with the smallest one it reaches there; whole numbers only."""

    def run(batches):
        ends = [[x.column(c).to_numpy() for c in ("a", "b")] for x in batches if x.num_rows]
        if not ends:
            return
        known, at = np.unique(np.concatenate([x for pair in ends for x in pair]), return_inverse=True)
        sizes = np.cumsum([len(x) for pair in ends for x in pair])
        pieces = np.split(at, sizes[:-1])
        a, b = np.concatenate(pieces[::2]), np.concatenate(pieces[1::2])
        label = np.arange(len(known))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (label[a], label[b], a, b):
                np.minimum.at(new, side, low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(known)))
        yield pa.record_batch({"a": pa.array(known[far]), "b": pa.array(known[label[far]])})

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def connected_components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(id, component): each linked vertex with the smallest vertex it can reach; vertices are whole numbers or strings.

    Links of whole numbers first shrink to spanning forests, TASK_LINKS to a task; if that was one task, they are
    the result. Else large star, then small star, until no edge changes; each round is two shuffles on the vertex,
    written to the shared folder. Every vertex keeps one edge to its least neighbour, so a hub never meets its
    neighbours in one list: minima are pre-aggregated and joined back. No bound on the rounds: they end when
    nothing changes, after about the logarithm of the longest chain.
    """
    u, v = F.col(left), F.col(right)
    edges = links.filter(u != v).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
    whole = dict(edges.dtypes)["a"] in ("bigint", "int")
    edges = written(edges if whole else edges.distinct(), "links")
    before, done = None, False
    if whole:
        tasks = -(-max(edges.count(), 1) // TASK_LINKS)
        edges, done = written(spanning_forest(edges, tasks), "links"), tasks == 1
    while not done:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("m < a").select("a", F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        nxt = written(nxt, "links")
        now = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        edges, done, before = nxt, now == before, now
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", F.col("b")).distinct())
