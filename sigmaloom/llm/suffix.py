"""Operator 4, suffix-array dedup by prefix-free parsing: every byte covered by a repeated long string goes.

Parsing. The rolling hash of every ``ANCHOR``-byte string is a trigger where it is the least of a window of
``length - ANCHOR + 1`` neighbours, so every ``length``-byte string holds a trigger that depends on its bytes alone:
its first least one. Equal strings stand at equal distance from equal triggers, and each string belongs to one
trigger. The strings of a trigger fall into ``CELLS`` cells by their distance to it; those of a cell, with all their
bytes, are a phrase. The dictionary is the distinct phrases, told apart by a 128-bit BLAKE2 digest of their bytes;
the parse is the list of a text's phrases. The suffixes of a phrase that are its strings are in no other phrase of
the text, so the dictionary's suffixes and the parse's counts give the corpus's strings.

Suffix order. All strings of a phrase that the parse has twice repeat. A phrase found once shares strings only with
phrases of the same core, the bytes that all strings of its cell have. So the dictionary is dealt by core, the phrases
found once with one copy of each other phrase of the core; in each part a suffix array sorts their suffixes by
content, and equal neighbours (a common prefix of ``length`` bytes or more) repeat. The parts together are the
corpus order of all suffixes that can repeat, compared byte by byte.

A core with more than ``GROUP`` phrases is too large for a part: its phrases are cut to single strings first, which
are dealt by their own digest.

Defined results: a null text is empty (0 bytes, the hash of nothing); texts under ``length`` bytes keep all;
rows are texts of their own even with equal doc_id, also null; repeated rows repeat each other; an empty table
gives no row.

Shuffled are digests of phrases whose trigger occurs twice (triggers are one in about (length - ANCHOR) / 2 bytes),
the bytes of the phrases to sort, and only those texts that a fixed-size Bloom filter lets through. Equal rows share
their spans, which are distinct and merged before a text's list is formed, so a list is no longer than its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Rolling, mixed, slices, written

LENGTH = 200
ANCHOR = 48
#: Distances to a trigger fall into so many cells.
CELLS = 4
BASE2 = 0xD6E8FEB86659FD93
#: Phrases of one core that one task sorts at most, and about so many phrases in a suffix array.
GROUP = 2000
SORTED = 1000
#: Texts or phrases in one Arrow batch.
ROWS = 2000
#: Bytes of text that are hashed at a time.
SLICE = 1 << 18


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def row_key(rows: DataFrame) -> DataFrame:
    """(key, doc_id, text): key tells rows apart unless they are equal."""
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


class Phrases:
    """Triggers and phrases of the texts of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length, self.offsets = length, offsets
        self.one, self.two = Rolling(data), Rolling(data, BASE2)
        empty = np.zeros(0, np.int64)
        self.start, self.at, self.row = empty, empty, empty
        width = length - ANCHOR + 1
        self.step = -(-width // CELLS)
        if len(data) < length:
            return
        place = np.arange(len(data) - ANCHOR + 1)
        h = self.one.of(place, place + ANCHOR)
        least = sliding_min(h, width)  # of the window that begins at each place
        # strings inside one row only
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        ok = np.arange(len(least)) + length <= offsets[row + 1]
        start = np.flatnonzero(ok)
        # first place of the least hash: go on from the window's begin to the next place with that hash
        at = self._first(h, least, start, width)
        self.start, self.at, self.row = start, at, row[start]

    @staticmethod
    def _first(h: np.ndarray, least: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """For each window its first place with its least hash. The place at or after a window's begin that is least of the windows is found from the right."""
        n = len(h)
        # candidates: places whose hash is the least of some window that begins up to width - 1 before
        pad = np.zeros(width - 1, np.uint64)
        most = ~sliding_min(~np.concatenate([pad, least, pad]), width)
        chosen = np.flatnonzero(most[:n] == h)
        # windows see a run of chosen places; the first with the least value is wanted
        lo = np.searchsorted(chosen, start, "left")
        at = chosen[np.minimum(lo, len(chosen) - 1)]
        todo = np.flatnonzero(h[at] != least[start])
        while len(todo):
            lo[todo] += 1
            at[todo] = chosen[lo[todo]]
            todo = todo[h[at[todo]] != least[start[todo]]]
        return at

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last index into ``start`` of the strings of each (row, trigger, cell)."""
        if not len(self.start):
            return self.start, self.start
        cell = (self.at - self.start) // self.step
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (self.at[1:] != self.at[:-1]) | (self.row[1:] != self.row[:-1]) | (self.start[1:] != self.start[:-1] + 1)) + 1
        return np.concatenate([[0], cut]), np.concatenate([cut, [len(self.start)]]) - 1

    def triggers(self) -> np.ndarray:
        """Hash of each trigger, once for each run of its strings."""
        first, _ = self.runs()
        at = self.at[first]
        return mixed(self.one.of(at, at + ANCHOR) ^ self.two.of(at, at + ANCHOR) * np.uint64(3))

    def table(self) -> dict[str, np.ndarray]:
        """Per run: the trigger's hash, the hash of the cell's core, its row, and its strings' first start in the slice, number and first distance to the trigger."""
        first, last = self.runs()
        at, a, b = self.at[first], self.start[first], self.start[last]
        cell = (at - a) // self.step
        low = at - cell * self.step
        high = low - self.step + 1 + self.length
        core = mixed(self.one.of(low, high) + mixed(self.two.of(low, high) + cell.astype(np.uint64)))
        return {"trigger": self.triggers(), "core": core, "row": self.row[first], "at": a, "n": b - a + 1, "far": at - a}


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, label: np.ndarray) -> pa.Array:
    """128-bit digests of the ranges of ``data``, each with the number ``label`` beside it."""
    raw, hashed = data.tobytes(), hashlib.blake2b
    out = b"".join([hashed(raw[a:b], digest_size=16, salt=c.to_bytes(8, "big")).digest() for a, b, c in zip(start.tolist(), stop.tolist(), label.tolist(), strict=True)])
    return pa.Array.from_buffers(pa.binary(16), len(start), [None, pa.py_buffer(out)]).cast(pa.binary())


def phrases(texts: DataFrame, length: int, twice: Bits) -> DataFrame:
    """(core, phrase, key, begin, n, far) of the runs of (key, text) whose trigger ``twice`` lets through; the parse."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text", SLICE):
            t = Phrases(data, offsets, length).table()
            keep = np.flatnonzero(twice.has(t["trigger"]))
            t = {k: v[keep] for k, v in t.items()}
            yield pa.record_batch({
                "core": pa.array(t["core"].view(np.int64)), "phrase": digests(data, t["at"], t["at"] + t["n"] - 1 + length, t["far"]), "key": rows.column("key").take(pa.array(t["row"])),
                "begin": pa.array((t["at"] - offsets[t["row"]]).astype("int32")), "n": pa.array(t["n"].astype("int32")), "far": pa.array(t["far"].astype("int32")),
            })

    return texts.select("key", "text").mapInArrow(run, "core long, phrase binary, key long, begin int, n int, far int")


def trigger_counts(texts: DataFrame, length: int) -> DataFrame:
    """(trigger, c): partial counts of the triggers' places in (text), one row per slice and trigger."""

    def run(batches):
        for _, data, offsets in slices(batches, "text", SLICE):
            p = Phrases(data, offsets, length)
            first, _ = p.runs()
            own = np.ones(len(first), bool)
            own[1:] = (p.at[first[1:]] != p.at[first[:-1]]) | (p.row[first[1:]] != p.row[first[:-1]])
            got, c = np.unique(p.triggers()[own], return_counts=True)
            yield pa.record_batch({"trigger": pa.array(got.view(np.int64)), "c": pa.array(c.astype("int32"))})

    return texts.select("text").mapInArrow(run, "trigger long, c int")


def passing(texts: DataFrame, bits: Bits) -> DataFrame:
    """Rows of ``texts`` whose key the filter lets through."""

    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bits.has(mixed(key))))

    return texts.mapInArrow(run, texts.schema)


def key_bits(keys: DataFrame) -> Bits:
    def run(batches):
        for batch in batches:
            yield pa.record_batch({"h": pa.array(mixed(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))})

    return Bits(keys.select("key").mapInArrow(run, "h long"), "h")


def with_bytes(texts: DataFrame, phrases: DataFrame, length: int) -> DataFrame:
    """``phrases`` (core, key, begin, n, far, copy) with their bytes; rows with one key hold one text, which is opened once."""
    columns = ["core", "begin", "n", "far", "copy"]
    wanted = phrases.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("wanted"))  # as many as the text has triggers and cells

    def run(batches):
        for rows, data, offsets in slices(batches, "text", SLICE):
            lists, raw = rows.column("wanted"), data.tobytes()
            row = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            begin, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            at = begin + offsets[row]
            made = {"key": rows.column("key").take(pa.array(row))} | {c: flat.field(i) for i, c in enumerate(columns)}
            yield pa.record_batch(made | {"bytes": pa.array([raw[a:b] for a, b in zip(at.tolist(), (at + n - 1 + length).tolist(), strict=True)], pa.binary())})

    bits = key_bits(phrases)
    d = passing(texts.select("key", "text"), bits).join(wanted, "key").dropDuplicates(["key"])
    return d.select("key", "text", "wanted").mapInArrow(run, "key long, core long, begin int, n int, far int, copy boolean, bytes binary")


def repeated_suffixes(data: bytes, at: np.ndarray, n: np.ndarray, group: np.ndarray, far: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, place, repeats) for each string of the phrases that begin at ``at`` in ``data`` with ``n`` strings each.

    A suffix array of the phrases: the strings sort by (group, distance to the trigger, content) and equal neighbours repeat.
    """
    which = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    record = np.empty((len(which), length + 12), np.uint8)
    record[:, :8] = group[which].astype(">i8").view(np.uint8).reshape(-1, 8)
    record[:, 8:12] = (far[which] - place).astype(">i4").view(np.uint8).reshape(-1, 4)
    record[:, 12:] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[at[which] + place]
    order = np.argsort(record.view(f"V{length + 12}").ravel(), kind="stable")
    same = (record[order[1:]] == record[order[:-1]]).all(1)
    twice = np.zeros(len(which), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return which, place, twice


def runs_of(twice: np.ndarray, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first place, number) of the runs of consecutive repeated strings."""
    hit = np.flatnonzero(twice)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (which[hit[1:]] != which[hit[:-1]])
    first = np.flatnonzero(new)
    return which[hit[first]], place[hit[first]], np.diff(np.concatenate([first, [len(hit)]]))


def sorted_parts(opened: DataFrame, length: int) -> DataFrame:
    """(key, begin, n): repeated strings of the phrases (core, key, begin, n, far, copy, bytes), by suffix arrays of whole cores."""

    def judged(rows: pa.Table):
        cols = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        n, far, core = (cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "far", "core"))
        raw = cols["bytes"].to_pylist()
        ends = np.cumsum([len(x) for x in raw])
        which, place, twice = repeated_suffixes(b"".join(raw), np.concatenate([[0], ends[:-1]]), n, core, far, length)
        twice &= ~cols["copy"].to_numpy(zero_copy_only=False).astype(bool)[which]
        phrase, first, count = runs_of(twice, which, place)
        begin = cols["begin"].to_numpy(zero_copy_only=False)[phrase] + first
        return pa.record_batch({"key": cols["key"].take(pa.array(phrase)), "begin": pa.array(begin.astype("int32")), "n": pa.array(count.astype("int32"))})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < SORTED:
                continue
            table = pa.Table.from_batches(held)
            core = table.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1], "left"))  # the last core may go on
            if cut:
                yield judged(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(core) - cut
        if rows:
            yield judged(pa.Table.from_batches(held))

    parts = opened.repartition("core").sortWithinPartitions("core")
    return parts.select("core", "key", "begin", "n", "far", "copy", "bytes").mapInArrow(run, "key long, begin int, n int")


def single_strings(opened: DataFrame, length: int) -> DataFrame:
    """(string, key, begin, copy) of every string of the phrases (core, key, begin, n, far, copy, bytes), with its digest."""

    def run(batches):
        for batch in batches:
            n, far, begin = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "far", "begin"))
            raw = batch.column("bytes").to_pylist()
            ends = np.cumsum([len(x) for x in raw])
            which = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            at = (ends - [len(x) for x in raw])[which] + place if len(which) else which
            string = digests(np.frombuffer(b"".join(raw), np.uint8), at, at + length, far[which] - place)
            yield pa.record_batch({"string": string, "key": batch.column("key").take(pa.array(which)), "begin": pa.array((begin[which] + place).astype("int32")), "copy": batch.column("copy").take(pa.array(which))})

    return opened.select("key", "begin", "n", "far", "copy", "bytes").mapInArrow(run, "string binary, key long, begin int, copy boolean")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, begin, n): strings of ``length`` bytes that start at begin, begin + 1, ..., n of them, and start elsewhere too; of (key, text)."""
    counts = trigger_counts(texts, length).groupBy("trigger").agg(F.sum("c").alias("c")).filter("c > 1").select("trigger")
    parse = written(phrases(texts, length, Bits(written(counts, "pfp-triggers"), "trigger")), "pfp-parse", ROWS)
    dictionary = parse.groupBy("core", "phrase").agg(F.count("*").alias("c"), F.min(F.struct("key", "begin", "n", "far")).alias("f"))
    dictionary = written(dictionary, "pfp-dictionary")
    whole = parse.join(dictionary.filter("c > 1").select("phrase"), "phrase", "left_semi").select("key", "begin", "n").distinct()
    # cores of two phrases or more, one of them found once
    cores = dictionary.groupBy("core").agg(F.count("*").alias("m"), F.min("c").alias("least")).filter("m > 1 and least = 1").select("core", "m")
    opened = dictionary.join(cores, "core").select("core", "m", "f.*", (F.col("c") > 1).alias("copy"))
    opened = written(opened, "pfp-open")
    with_text = written(with_bytes(texts, opened.drop("m"), length), "pfp-bytes", ROWS)
    large = opened.filter(F.col("m") > GROUP).select("core").distinct()
    part = sorted_parts(with_text.join(large, "core", "left_anti"), length)
    strings = written(single_strings(with_text.join(large, "core", "left_semi"), length), "pfp-strings", ROWS)
    twice = strings.groupBy("string").agg(F.count("*").alias("c")).filter("c > 1").select("string")
    single = strings.filter("not copy").join(twice, "string", "left_semi").select("key", "begin", F.lit(1).alias("n"))
    return whole.union(part).union(single)


def removed_runs(begin: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of [begin, begin + n - 1 + length)."""
    order = np.argsort(begin, kind="stable")
    a, b = begin[order], (begin + n - 1 + length)[order]
    far = np.maximum.accumulate(b)
    cut = np.flatnonzero(a[1:] > far[:-1]) + 1
    return list(zip(a[np.concatenate([[0], cut])].tolist(), far[np.concatenate([cut - 1, [len(a) - 1]])].tolist(), strict=True))


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs`` (doc_id by default) with n_bytes, n_removed, n_spans, kept_sha256 and, if ``texts``, kept (what stays, without characters cut in two)."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.withColumns({"key": F.xxhash64("doc_id", "text"), "text": F.coalesce("text", F.lit(""))})
    spans = written(repeated_spans(rows, length), "pfp-spans", ROWS)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "n")).alias("spans"))  # as many as the text has strings
    bits = key_bits(spans)

    def clear(batches):
        yield from run(b.filter(pa.array(~bits.has(mixed(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64))))) for b in batches)

    def run(batches):
        for rows, data, offsets in slices((b for b in batches if b.num_rows), "text"):
            out = []
            lists = rows.column("spans") if "spans" in rows.schema.names else None
            for i in range(len(rows)):
                text = data[offsets[i] : offsets[i + 1]]
                runs = []
                if lists is not None and lists[i].is_valid:
                    values = lists[i].values
                    runs = removed_runs(values.field(0).to_numpy(), values.field(1).to_numpy().astype(np.int64), length)
                left, at = [], 0
                for a, b in runs:
                    left.append(text[at:a].tobytes())
                    at = b
                left.append(text[at:].tobytes())
                left = b"".join(left)
                out.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if texts else None))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = {n: pa.array(c, k) for n, c, k in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), cols, kinds, strict=True)}
            yield pa.record_batch({k: rows.column(k) for k in keep} | made)

    d = rows.select(*keep, *[c for c in ("key", "text") if c not in keep])
    schema = d.select(*keep).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string")):
        schema = schema.add(name, kind)
    clean = d.mapInArrow(clear, schema)
    rest = passing(d, bits).join(spans, "key", "left").mapInArrow(run, schema)
    out = clean.union(rest)
    return out if texts else written(out, "pfp-cut", ROWS)
