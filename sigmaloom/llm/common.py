"""What the corpus operators share: words, work tables, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.work import shared_dir, written  # noqa: F401

#: ASCII white space as the contracts define it: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class Bits:
    """A Bloom filter of fixed size over 64-bit hashes: two bits a hash, 2 MB in all whatever the table holds.

    It only spares shuffles: what passes is joined exactly; where the table outgrows it, more passes.
    """

    BITS = 24

    def __init__(self, hashes: DataFrame, column: str):
        n = self.BITS
        places = hashes.select(F.explode(F.array(F.shiftrightunsigned(column, 64 - n), F.shiftrightunsigned(F.shiftleft(column, n), 64 - n))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
        self.words = np.zeros(1 << (n - 6), np.uint64)
        for at, value in words.collect():
            self.words[at] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)

    def __contains__(self, h):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        n = np.uint64(64 - self.BITS)
        out = np.ones(len(h), bool)
        for p in (h >> n, (h << np.uint64(self.BITS)) >> n):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with about ``limit`` bytes of text each (one long text makes a piece of its own).

    Yields (rows, bytes of all texts of the piece in one array, offsets of the rows in it); a null text is empty.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = batch.column(at)
        if text.null_count:
            text = text.fill_null("")
        text = text.cast(pa.large_binary())
        buffers = text.buffers()
        ends = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(text):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            stop = min(stop, len(text))
            yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
            start = stop
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        p = np.full(size + 1, base, np.uint64)
        p[0] = 1
        q = np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
        q[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.cumprod(p), np.cumprod(q)
    return have[0][: n + 1], have[1][: n + 1]


class Rolling:
    """Karp-Rabin hashes of any range of a sequence, modulo 2**64, mixed; equal ranges have equal hashes."""

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15 | 1):
        p, self.inverse = powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in ``in_word`` (a table over 256 bytes), never across rows, and the row of each."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = in_word[data]
    change = inside[1:] != inside[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[1:-1]] = True
    cut = first & inside[1:] & inside[:-1]
    starts = np.flatnonzero((change | cut) & inside[1:])
    stops = np.flatnonzero((change | cut) & inside[:-1])
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NOT_SPACE = ~SPACES
#: ASCII letters and digits, and every byte of a longer code point.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
