"""Operator 13, periodic runs of words, by a suffix automaton with link-cut access.

The states of a suffix automaton, linked to their longest proper suffix states, form a tree; the prefixes of a text are
visited in order. An access (as in link-cut trees, on splay trees) turns the path from a prefix's state to the root into
one preferred path; each piece it is cut from holds the states last visited at one earlier end j. The deepest of them on
the path, of length L, is then the longest suffix of the prefix whose last occurrence ended at j: with d = i - j <= L the
stretch of the L + d words before i has period d. d is its least period, since a lesser one would give the suffix a later
occurrence, and the stretch cannot be longer to the left. A run is a stretch at the last i that has its start and period:
where it holds three periods or more, each i from the third period on gives it, up to its last word.

Before that, vectorised and exact: every word of a run stands in a short gram of words that occurs again a period away
(``gram_size``). Words outside grams repeated within a text belong to no run and no run crosses them, so the automaton
takes each stretch between such words by itself. Grams are told apart by 64-bit hashes: a collision only makes a stretch
longer. Memory is linear in the longest stretch of one text.

Defined results: words are split at ASCII white space and keep their case; a null text is empty; texts without a run
have an empty list; repeated rows are rows of their own; an empty table gives none; columns other than the kept ones are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import NOT_SPACE, Rolling, mixed, slices, word_spans


def suffix_automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, state of each prefix from the empty one); state 0 is the root, whose link is -1."""
    link, length, step, ends, last = [-1], [0], [{}], [0], 0
    for c in seq:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        ends.append(new)
    return link, length, ends


class LastEnds:
    """The link tree cut into preferred paths, each with the end at which it was last visited (0: never).

    A path is a splay tree by depth; only its root's ``end`` counts.
    """

    def __init__(self, link: list[int]):
        self.up, self.left, self.right, self.end = list(link), [-1] * len(link), [-1] * len(link), [0] * len(link)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, left, right, end = self.up, self.left, self.right, self.end
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g < 0 or (left[g] != p and right[g] != p):
                end[x] = end[p]
                self._rotate(x)
                return
            top = up[g] < 0 or (left[up[g]] != g and right[up[g]] != g)
            if top:
                end[x] = end[g]
            self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, x: int, i: int) -> list[tuple[int, int]]:
        """(deepest state, earlier end) of each piece of the path from x to the root, which then ends at i as a whole."""
        up, right, end = self.up, self.right, self.end
        pieces, below = [], -1
        while x >= 0:
            self._splay(x)
            if end[x]:
                pieces.append((x, end[x]))
            if right[x] >= 0:
                end[right[x]] = end[x]  # what lies deeper stays a path of its own
            right[x] = below
            below, x = x, up[x]
        end[below] = i
        return pieces


def runs_of(seq: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words and ``exponent`` periods, in order; the exponent is 3 or more."""
    link, length, ends = suffix_automaton(seq)
    paths, last = LastEnds(link), {}
    for i in range(1, len(ends)):
        for state, j in paths.access(ends[i], i):
            d, n = i - j, length[state]
            if n >= (exponent - 1) * d and n + d >= least:
                last[i - d - n, d] = i
    return sorted((start, end - start, d) for (start, d), end in last.items())


def gram_size(least: int, exponent: int) -> int:
    """Words of a gram such that each one inside a run occurs again a period away: a run of n words and period q allows n - 2 q + 1."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(words: np.ndarray, rows: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs, of word hashes with the row of each."""
    size, n = gram_size(least, exponent), len(words)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none
    at = np.arange(n - size + 1)
    at = at[rows[at] == rows[at + size - 1]]
    with np.errstate(over="ignore"):
        grams = mixed(Rolling(words).of(at, at + size) ^ mixed(rows[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    step = at[order[1:]] - at[order[:-1]]
    near = np.full(len(at), n)
    np.minimum.at(near, order[1:][same], step[same])
    np.minimum.at(near, order[:-1][same], step[same])
    keep = near < n
    at, near = at[keep], near[keep]
    while len(at):
        edge = np.ones(len(at), bool)
        edge[1:] = (at[1:] > at[:-1] + size) | (rows[at[1:]] != rows[at[:-1]])
        first = np.flatnonzero(edge)
        starts, ends = at[first], at[np.append(first[1:], len(at)) - 1] + size
        own = np.cumsum(edge) - 1
        fits = (near * exponent <= (ends - starts)[own]) & ((ends - starts)[own] >= least)
        if fits.all():
            return starts, ends
        at, near = at[fits], near[fits]
    return none, none


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """The kept columns, n_words, runs and collapsed: the words outside what follows the first period of any run, with single spaces."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for rows, data, offsets in slices(batches, column):
            starts, stops, row = word_spans(data, offsets, NOT_SPACE)
            first = np.searchsorted(row, np.arange(len(offsets)))
            hashes = Rolling(data).of(starts, stops) if len(starts) else np.zeros(0, np.uint64)
            raw = data.tobytes()
            found: list[list] = [[] for _ in range(rows.num_rows)]
            gone = np.zeros(len(starts), bool)
            for a, b in zip(*stretches(hashes, row, least, exponent), strict=True):
                known: dict[bytes, int] = {}
                seq = [known.setdefault(raw[x:y], len(known)) for x, y in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)]
                r = row[a]
                for start, length, period in runs_of(seq, least, exponent):
                    found[r].append((int(a - first[r]) + start, length, period))
                    gone[a + start + period : a + start + length] = True
            texts = []
            for r in range(rows.num_rows):
                words = raw[offsets[r] : offsets[r + 1]].split()
                if found[r]:
                    words = [w for w, g in zip(words, gone[first[r] : first[r + 1]].tolist(), strict=True) if not g]
                texts.append(b" ".join(words))
            made = [{"start": x, "length": y, "period": z} for some in found for x, y, z in some]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.array(made, kind.value_type))
            n = pa.array(np.diff(first).astype(np.int64))
            yield pa.record_batch({**{c: rows.column(c) for c in keep}, "n_words": n, "runs": runs, "collapsed": pa.array(texts, pa.binary()).view(pa.string())})

    kept = docs.select(*keep).schema
    return docs.select(*keep, column).mapInArrow(run, kept.add("n_words", "long").add("runs", RUNS).add("collapsed", "string"))
