"""Language identification: multinomial naive Bayes over hashed character n-grams.

Nulls, empties: a null text or one without a letter gets ``und`` and score 0. A table without
usable training rows gives ``und`` for every row. Repeated rows and ties are harmless: ties of
the best language go to the first in alphabetical order. Columns other than ``doc_id``, ``text``
and ``lang`` are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .textkit import U64

UNKNOWN = "und"
_TABLE: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """For each code point of the basic plane: its lower case if a letter, else a blank."""
    global _TABLE
    if _TABLE is None:
        low = [c.lower() if (c := chr(i)).isalpha() else " " for i in range(0x10000)]
        _TABLE = np.array([ord(c) if len(c) == 1 else ord(c[0]) for c in low], np.uint32)
    return _TABLE


def grams(data: np.ndarray, off: np.ndarray, buckets_log2: int, orders: tuple[int, ...]):
    """Yield (bucket of the n-gram at each character, row starts, row has a letter); bucket 2**buckets_log2 means none."""
    text = data.tobytes().decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    starts = chars[off]
    if len(code) != starts[-1]:  # bytes that aren't UTF-8: row by row
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *map(len, rows)])
    table = _fold_table()
    far = code >= 0x10000
    folded = table[np.where(far, 0, code)]
    if far.any():
        high = np.unique(code[far])
        alpha = np.array([chr(int(c)).isalpha() for c in high])
        folded = np.where(far, np.where(alpha[np.searchsorted(high, np.where(far, code, high[0]))], code, 32), folded)
    letter = textkit.segment_sum((folded != 32).astype(np.int64), starts[:-1], starts[1:]) > 0
    wide, n = folded.astype(U64), len(folded)
    value, out = np.zeros(n, U64), []
    for k in range(max(orders)):
        if k:
            value[: n - k] = value[: n - k] * U64(0x100000001B3) + wide[k:]
        else:
            value = wide + U64(1)
        if k + 1 in orders:
            h = (value * U64(0x9E3779B97F4A7C15 + 2 * k)) >> U64(64 - buckets_log2)
            h = h.astype(np.int64)
            for back in range(1, k + 1):  # n-grams that would run over the row's end
                ends = starts[1:] - back
                h[ends[(ends >= starts[:-1])]] = 1 << buckets_log2
            out.append(h)
    return out, starts, letter


def fit(docs: DataFrame, *, buckets_log2: int = 15, orders=(1, 2, 3), smoothing: float = 0.5, rows_per_language: int = 5000) -> dict:
    """Count hashed n-grams by language over at most about ``rows_per_language`` rows of each (a documented bound).

    The counts come back as one row per (language, bucket): at most languages x 2**buckets_log2.
    """
    runtime.ship(docs.sparkSession)
    sample = runtime.bounded_rows(docs.select("doc_id", "text", "lang").where("text is not null and lang is not null"), "doc_id", "lang", rows_per_language)
    size = 1 << buckets_log2

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = textkit.columns(batch, "text", "lang")
            names = np.array(langs.to_pylist(), object)
            for i, j, data, off in textkit.slices(texts):
                hs, starts, _ = grams(data, off, buckets_log2, orders)
                row = np.repeat(np.arange(j - i), np.diff(starts))
                for name in set(names[i:j]):
                    own = (names[i:j] == name)[row]
                    c = total.setdefault(name, np.zeros(size + 1, np.int64))
                    for h in hs:
                        c += np.bincount(h[own], minlength=size + 1)
        for name, c in total.items():
            at = np.flatnonzero(c[:size])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(textkit.tidied(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    matrix = np.full((size + 1, max(1, len(languages))), smoothing)
    if languages:
        place = {x: k for k, x in enumerate(languages)}
        matrix[counted.column("bucket").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] += counted.column("n").to_numpy()
    matrix = np.log(matrix / matrix[:size].sum(axis=0))
    matrix[size] = 0
    return {"languages": languages, "log_prob": matrix, "buckets_log2": buckets_log2, "orders": tuple(orders)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the predicted language, equal priors) for every whole text."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        names = np.array([*m["languages"], UNKNOWN], object)
        weight, langs = m["log_prob"], len(m["languages"])
        limit = max(1 << 16, (4 << 20) // max(1, langs))
        for batch in batches:
            ids, texts = textkit.columns(batch, "doc_id", "text")
            pred, conf = np.full(len(ids), UNKNOWN, object), np.zeros(len(ids))
            for i, j, data, off in textkit.slices(texts, limit) if langs else ():
                hs, starts, letter = grams(data, off, m["buckets_log2"], m["orders"])
                ll = sum(textkit.segment_sum(weight[h], starts[:-1], starts[1:]) for h in hs)
                best = ll.argmax(axis=1)
                post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                pred[i:j] = np.where(letter, names[best], UNKNOWN)
                conf[i:j] = np.where(letter, post, 0.0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(conf)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(textkit.tidied(score), "doc_id long, lang_pred string, score double")


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    part = runtime.crc_mod(F.col("doc_id"), 5)
    model = fit(docs.where(part != 0))
    return predict(docs, model).select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
