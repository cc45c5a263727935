"""Operator 5, language ID: mixtures of languages by expectation-maximisation.

Training counts byte trigrams of letters (ASCII lower-cased; other bytes of letters as they are, everything else
one separator) in ``BUCKETS`` hashed buckets for every learned language, over all training rows. A document is
a mixture: EM estimates the languages' shares from the trigrams' likelihoods, first over all languages, then
over the leading one, two, three ...; the set with the best penalised likelihood (half the logarithm of the
trigrams for every further language) stands, and its largest share names the language.

Defined results: null text and text without a letter give ``und`` and score 0; so does every text if nothing was
learned. Ties go to the language first in code point order. Repeated rows are judged alike.

The model is at most languages x BUCKETS counts, the one thing that reaches the driver; prediction needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, slices

BUCKETS = 1 << 14
#: Letters keep their byte, all else is 0. Bytes from 128 on belong to longer code points, nearly all letters.
CODES = np.array([LOWER[c] if c >= 128 or chr(c).isalpha() else 0 for c in range(256)], np.uint32)
#: Trigrams overlap, so a third of their log-likelihood counts.
OVERLAP = 3


def trigram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every letter byte of a slice, and where each row's begin."""
    lengths = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)
    codes = np.zeros(len(data) + 2 * len(lengths) + 1, np.uint32)
    codes[at] = CODES[data]
    key = (codes[at - 1] * np.uint32(65_599) + codes[at]) * np.uint32(65_599) + codes[at + 1]
    key = (key * np.uint32(2_654_435_761)) >> np.uint32(18)
    letter = codes[at] != 0
    return key[letter].astype(np.int64), np.concatenate([[0], np.cumsum(letter)])[offsets]


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the log-likelihood (buckets x languages) of each bucket, from (text, lang)."""

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for rows, data, offsets in slices(batches, "text"):
            key, ends = trigram_buckets(data, offsets)
            lang = np.array(rows.column("lang").to_pylist(), object)
            row = np.repeat(np.arange(len(lang)), np.diff(ends))
            for name in set(lang):
                got = np.bincount(key[lang[row] == name], minlength=BUCKETS)
                seen[name] = seen.get(name, 0) + got
        for name, n in seen.items():
            full = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([name] * len(full), pa.string()), "bucket": full, "n": n[full]})

    rows = rows.filter("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts}, key=lambda x: x.encode())
    table = np.full((BUCKETS, len(langs)), 0.5)
    place = {x: i for i, x in enumerate(langs)}
    for lang, bucket, n in counts:
        table[bucket, place[lang]] += n
    return langs, np.log(table / table.sum(0)) if langs else table


def mixture(p: np.ndarray, weight: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Shares that EM gives to the columns of ``p`` (likelihoods), and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = weight.sum()
    for _ in range(steps):
        mixed = p @ share
        new = share * ((weight / mixed) @ p) / total
        done = np.abs(new - share).max() < 2e-3
        share = new
        if done:
            break
    return share, float(weight @ np.log(p @ share))


def judge(logs: np.ndarray, weight: np.ndarray) -> tuple[int, float, list[tuple[int, float]]]:
    """(column of the language, score, columns and shares of the chosen set) for one document with ``weight`` times the trigrams of log-likelihoods ``logs``."""
    alone = weight @ logs
    best = int(alone.argmax())
    rest = np.exp(np.clip((alone - alone[best]) / OVERLAP, -700, 0))
    pick, score, chosen = best, float(1 / rest.sum()), [(best, 1.0)]
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top)
    offset = float(weight @ top[:, 0])
    share, _ = mixture(p, weight)
    order = np.argsort(-share, kind="stable")
    penalty = 0.5 * np.log(max(weight.sum(), 2.0))
    reached = alone[best] / OVERLAP
    for k in range(2, len(order) + 1):
        if share[order[k - 1]] < 0.02:
            break
        part, like = mixture(p[:, order[:k]], weight)
        value = (like + offset) / OVERLAP - penalty * (k - 1)
        if value > reached:
            reached, at = value, int(part.argmax())
            pick, score = int(order[at]), float(part[at])
            chosen = list(zip(order[:k].tolist(), part.tolist(), strict=True))
    return pick, min(1.0, score), chosen


MIXTURE = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and mixture: the chosen languages with their shares, the largest first (empty for ``und``)."""
    langs, logs = model
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches):
        for rows, data, offsets in slices(batches, "text"):
            key, ends = trigram_buckets(data, offsets)
            names, scores, sets = [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                part = data[offsets[i] : offsets[i + 1]]
                lettered = b > a and (bool(((part | 32) - 97 < 26).any()) or any(map(str.isalpha, bytes(part).decode("utf-8", "ignore"))))
                if not lettered or not langs:
                    names.append("und")
                    scores.append(0.0)
                    sets.append([])
                    continue
                n = np.bincount(key[a:b])
                full = n.nonzero()[0]
                at, score, chosen = judge(logs[full], n[full].astype(float))
                names.append(langs[at])
                scores.append(score)
                sets.append([{"lang": langs[c], "share": round(x, 4)} for c, x in sorted(chosen, key=lambda x: (-x[1], x[0]))])
            out = {k: rows.column(k) for k in keep}
            yield pa.record_batch(out | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "mixture": pa.array(sets, kind)})

    fields = docs.select(*keep).schema
    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(predict, fields.add("lang_pred", "string").add("score", "double").add("mixture", MIXTURE))


def held_out() -> Column:
    """True for documents that training leaves out: crc32 of doc_id as text leaves 1 modulo 3 (a null id is text of length 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_of(docs: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) for ``docs``; learned from the rows of ``train_on`` (or ``docs``) that are not held out."""
    model = train((docs if train_on is None else train_on).filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
