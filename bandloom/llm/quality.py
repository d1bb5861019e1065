"""Quality: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Twenty measures of a whole text are cut into bins; rounds of small trees visit the measures in
turn and add to one lookup table for each, then to tables for the pairs whose joint cells explain
most of what is left. A score is the sum of table entries.

Null texts count as empty; empty texts get a score like any other. Without both labels the score
is the base rate. Several labels of one document count as their maximum; labels other than 0 and
1 don't train. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .toxicity import labelled

MEASURES = ("bytes", "words", "letters", "capitals", "digits", "blanks", "marks", "stops", "word_length", "repeats_next", "distinct", "top_word", "markless", "ends_odd", "shouts", "pipes", "line_words", "line_repeats", "short_words", "long_words")
_KIND = np.zeros((8, 256), bool)
_KIND[0, 0x41:0x5B] = _KIND[0, 0x61:0x7B] = _KIND[0, 0x80:] = True
_KIND[1, 0x41:0x5B] = True
_KIND[2, 0x30:0x3A] = True
_KIND[3] = textkit.WHITE
_KIND[5, [0x2E, 0x2C, 0x3B, 0x3A]] = True
_KIND[4] = ~(_KIND[0] | _KIND[2] | _KIND[3] | _KIND[5])
_KIND[6, 0x21] = True
_KIND[7, 0x7C] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_ODD = ~(_KIND[0] | _KIND[2])
_ODD[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x22, 0x27, 0x29]] = False


def _repeats(hashes: np.ndarray, row: np.ndarray, n: int):
    """By row: the distinct values and the largest count of one value."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], size)
    return np.bincount(r[at], minlength=n), top


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of MEASURES for each text."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    kinds = [textkit.segment_sum(k[data], off[:-1], off[1:]) / size for k in _KIND]
    start, end, row = textkit.tokens(data, off, textkit.WHITE)
    words = np.bincount(row, minlength=n)
    per = np.maximum(words, 1).astype(float)
    h = textkit.span_hashes(textkit.LOWER[data], start, end)
    length = (end - start).astype(float)
    share = lambda flag: np.bincount(row, weights=flag, minlength=n) / per
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    distinct, top = _repeats(h, row, n)
    alnum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_KIND[0][data] | _KIND[2][data], out=alnum[1:])
    l_start, l_end, l_row = textkit.tokens(data, off, _NEWLINE)
    lines = np.bincount(l_row, minlength=n)
    l_distinct, _ = _repeats(textkit.span_hashes(data, l_start, l_end), l_row, n)
    return np.column_stack([
        np.log1p(np.diff(off)), np.log1p(words), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        np.bincount(row, weights=length, minlength=n) / per, share(again), distinct / per, top / per,
        share(alnum[end] == alnum[start]), share(_ODD[data[end - 1]] if len(end) else np.zeros(0)), kinds[6], kinds[7],
        words / np.maximum(lines, 1), 1 - l_distinct / np.maximum(lines, 1), share(length <= 3), share(length >= 12),
    ])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """The leaf values of a tree with at most ``leaves`` leaves over ordered bins, from gradient and curvature sums."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                c = np.arange(a + 1, b)
                won = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], (a, b), int(c[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 6, rate: float = 0.1) -> dict:
    """Lookup tables by measure and by chosen pair of measures."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    small = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, coarse + 1)[1:-1])) for j in range(k)]
    at = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="right") for j in range(k)])
    low = np.column_stack([np.searchsorted(small[j], x[:, j], side="right") for j in range(k)])
    mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    z = np.full(n, bias)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slope():
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slope()
            step = rate * _tree(np.bincount(at[:, j], weights=g, minlength=len(tables[j])), np.bincount(at[:, j], weights=h, minlength=len(tables[j])))
            tables[j] += step
            z += step[at[:, j]]
    g, h = slope()
    found = []
    for a in range(k):
        for b in range(a + 1, k):
            cell = low[:, a] * (coarse + 1) + low[:, b]
            cg, ch = (np.bincount(cell, weights=s, minlength=(coarse + 1) ** 2) for s in (g, h))
            found.append(((cg**2 / (ch + 1)).sum(), a, b))
    chosen = [(a, b) for _, a, b in sorted(found, reverse=True)[:pairs]]
    grids = [np.zeros((coarse + 1, coarse + 1)) for _ in chosen]
    for _ in range(rounds // 3):
        for i, (a, b) in enumerate(chosen):
            g, h = slope()
            cell = low[:, a] * (coarse + 1) + low[:, b]
            cg, ch = (np.bincount(cell, weights=s, minlength=(coarse + 1) ** 2).reshape(coarse + 1, -1) for s in (g, h))
            rows = _tree(cg.sum(axis=1), ch.sum(axis=1), 2)  # a cut along one measure, then one along the other in each part
            step = np.zeros_like(cg)
            for value in np.unique(rows):
                part = rows == value
                step[part] = rate * _tree(cg[part].sum(axis=0), ch[part].sum(axis=0), 2)
            grids[i] += step
            z += step.ravel()[cell]
    return {"bias": bias, "cuts": cuts, "small": small, "tables": tables, "pairs": chosen, "grids": grids}


def additive(model: dict, x: np.ndarray) -> np.ndarray:
    """The score of each row of measures."""
    z = np.full(len(x), model["bias"])
    for j, table in enumerate(model["tables"]):
        z += table[np.searchsorted(model["cuts"][j], x[:, j], side="right")]
    for (a, b), grid in zip(model["pairs"], model["grids"]):
        z += grid[np.searchsorted(model["small"][a], x[:, a], side="right"), np.searchsorted(model["small"][b], x[:, b], side="right")]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _measure_rows(batches, extra: str):
    for batch in batches:
        key, texts = textkit.columns(batch, extra, "text")
        out = [np.zeros((0, len(MEASURES)))]
        for _, _, data, off in textkit.slices(texts):
            out.append(measures(data, off))
        yield key, np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows_per_label: int = 10000) -> dict:
    """Train on at most about ``rows_per_label`` rows of each label (a documented bound); only measures reach the driver."""
    runtime.ship(docs.sparkSession)
    sample, counts = labelled(docs, labels, label, rows_per_label)

    def run(batches):
        for y, x in _measure_rows(batches, "y"):
            yield pa.RecordBatch.from_arrays([y, pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.mapInArrow(textkit.tidied(run), "y int, x array<double>").toArrow()
    runtime.drop_stored(sample)
    y = rows.column("y").to_numpy().astype(float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return {"bias": float(np.log(rate / (1 - rate))), "cuts": [], "small": [], "tables": [], "pairs": [], "grids": []}
    x = np.array(rows.column("x").to_pylist())
    weight = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    return train(x, y, weight / weight.mean())


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and ``score``, the probability that label 1 fits the whole text."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for key, x in _measure_rows(batches, "doc_id"):
            yield pa.RecordBatch.from_arrays([key, pa.array(additive(shared.value, x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(textkit.tidied(run), "doc_id long, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels")
    part = runtime.crc_mod(F.col("doc_id"), 4)
    model = fit(docs, labels.where(part != 2))
    return score(docs, model).select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
