"""Toxicity: a counterfactually regularised logistic classifier over words and word beginnings.

A document's features are the distinct words and word prefixes it holds (presence, not counts). Those
take part that stand in ``min_rows`` labelled rows and whose frequencies under the two labels differ by
``z`` standard errors (a test for evidence, from the counts of all labelled rows in the sample, with no
bound on how many pass), and every group term. Each labelled row gets a counterfactual twin: one that
names groups (``IDENTITY_SWAPS``) has its terms swapped, any other has a term inserted (which, by its
text). Training adds ``penalty`` times the squared change of the log-odds between a row and its twin,
so that a neutral mention of a group moves no score, whether or not the corpus names groups.

Null and empty texts get the score of a document without features. Rows without a label, labels
without a document, and labels other than 0 and 1 don't train; several labels of one document
count as their maximum. Without both labels present, the score is the base rate. Equal texts get
equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit

#: Identity terms and the term that each is swapped with, by language.
IDENTITY_SWAPS = {
    "women": "men", "men": "women", "woman": "man", "man": "woman", "girls": "boys", "boys": "girls",
    "gay": "straight", "straight": "gay", "lesbian": "heterosexual", "heterosexual": "lesbian",
    "muslim": "christian", "christian": "muslim", "jewish": "buddhist", "buddhist": "jewish",
    "muslims": "christians", "christians": "muslims", "jews": "hindus", "hindus": "jews",
    "black": "white", "white": "black", "african": "european", "european": "african",
    "immigrants": "citizens", "citizens": "immigrants", "disabled": "abled", "abled": "disabled",
    "femmes": "hommes", "hommes": "femmes", "musulmans": "chrétiens", "chrétiens": "musulmans",
    "frauen": "männer", "männer": "frauen", "juden": "christen", "christen": "juden",
    "mujeres": "hombres", "hombres": "mujeres", "musulmanes": "cristianos", "cristianos": "musulmanes",
}
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)


def _word_features(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    cuts = [len(data), *(p for p in PREFIXES if p < len(data))]
    return np.concatenate([textkit.span_hashes(data, np.array([0]), np.array([c])) ^ textkit.U64(k) for k, c in zip([0, *PREFIXES], cuts)])


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and word prefix."""
    low = textkit.fold_case(data)
    start, end, row = textkit.tokens(low, off, textkit.NOT_ALNUM)
    rows, hashes = [row], [textkit.span_hashes(low, start, end)]
    for p in PREFIXES:
        long = np.flatnonzero(end - start > p)
        rows.append(row[long])
        hashes.append(textkit.span_hashes(low, start[long], start[long] + p) ^ textkit.U64(p))
    return np.concatenate(rows), np.concatenate(hashes)


class Swaps:
    """What a row's counterfactual twin has more and less of, as vocabulary positions."""

    def __init__(self, look: "Lookup"):
        self.look = look
        self.own = {w: self._known(w) for w in IDENTITY_SWAPS}
        self.whole = np.array([_word_features(w)[0] for w in IDENTITY_SWAPS], textkit.U64)
        self.order = np.argsort(self.whole)
        self.terms = list(IDENTITY_SWAPS)

    def _known(self, word: str) -> set[int]:
        h = _word_features(word)
        return set(self.look(np.zeros(len(h), np.int64), h)[1].tolist())

    def __call__(self, have: np.ndarray, low: np.ndarray) -> tuple[list[int], list[int]]:
        """For the features and the folded bytes of one text; a prefix that another word has, too, stays."""
        start, end, _ = textkit.tokens(low, np.array([0, len(low)]), textkit.NOT_ALNUM)
        word = textkit.span_hashes(low, start, end)
        at = np.minimum(np.searchsorted(self.whole[self.order], word), len(self.whole) - 1)
        named = self.whole[self.order][at] == word
        if not named.any():
            new = self.own[self.terms[int(np.bitwise_xor.reduce(word, initial=0)) % len(self.terms)]]
            return sorted(new.difference(have.tolist())), []
        terms = {self.terms[i] for i in self.order[at[named]]}
        rest = word[~named]
        stay = set()
        for p in PREFIXES:  # beginnings of the other words
            long = ~named & (end - start > p)
            stay.update(self.look(np.zeros(int(long.sum()), np.int64), textkit.span_hashes(low, start[long], start[long] + p) ^ textkit.U64(p))[1].tolist())
        stay.update(self.look(np.zeros(len(rest), np.int64), rest)[1].tolist())
        twin = stay.union(*(self.own[IDENTITY_SWAPS[t]] for t in terms))
        mine = stay.union(*(self.own[t] for t in terms))
        return sorted(twin - mine), sorted(mine - twin)


class Lookup:
    """Positions of hashes in a sorted vocabulary, behind a bit table that turns most away."""

    def __init__(self, vocabulary: np.ndarray, bits: int = 20):
        self.vocabulary, self.shift = vocabulary, textkit.U64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(vocabulary >> self.shift).astype(np.int64)] = True

    def __call__(self, rows: np.ndarray, hashes: np.ndarray):
        """The distinct (row, vocabulary position) pairs among the given ones."""
        maybe = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        pair = np.unique(rows[maybe][good] * max(1, len(self.vocabulary)) + at[good])
        return pair // max(1, len(self.vocabulary)), pair % max(1, len(self.vocabulary))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows_per_label: int) -> tuple[DataFrame, dict]:
    """Texts of at most about ``rows_per_label`` rows of each label as a stored table, and the labels' row counts."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = runtime.bounded_rows(known, "doc_id", "y", rows_per_label)
    # bounded by 2 * rows_per_label rows of 12 bytes
    return runtime.stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled"), counts


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows_per_label: int = 10000, min_rows: int = 3, z: float = 3.0, penalty: float = 1.0, l2: float = 1e-3, steps: int = 300) -> dict:
    runtime.ship(docs.sparkSession)
    sample, counts = labelled(docs, labels, label, rows_per_label)

    def count(batches):
        rest: list = []

        def flush():
            h = np.concatenate([x[0] for x in rest])
            y = np.concatenate([x[1] for x in rest])
            rest.clear()
            values, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            pos = np.bincount(inverse, weights=y, minlength=len(values)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n), pa.array(pos)], ["h", "n", "pos"])

        for batch in batches:
            texts, ys = textkit.columns(batch, "text", "y")
            ys = ys.to_numpy(zero_copy_only=False)
            for i, _, data, off in textkit.slices(texts):
                rows, hashes = features(data, off)
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                rest.append((hashes[first], ys[i + rows[first]].astype(np.int64)))
                if sum(len(x[0]) for x in rest) > 2_000_000:
                    yield flush()
        if rest:
            yield flush()

    base = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    n_by = {r["y"]: r["n"] for r in base}
    if len(n_by) < 2:
        rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        runtime.drop_stored(sample)
        return {"vocabulary": np.zeros(0, np.uint64), "weight": np.zeros(0), "bias": float(np.log(rate / (1 - rate)))}
    n1, n0 = n_by[1], n_by[0]
    f1, f0 = (F.col("pos") + 0.5) / (n1 + 1), (F.col("n") - F.col("pos") + 0.5) / (n0 + 1)
    strength = F.abs(F.log(f1 / f0)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("n") - F.col("pos") + 0.5))
    chosen = sample.mapInArrow(textkit.tidied(count), "h long, n long, pos long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where((F.col("n") >= min_rows) & (strength >= z))
    groups = np.array([_word_features(w)[0] for w in IDENTITY_SWAPS], textkit.U64)
    # bounded by the words of the sample
    vocabulary = np.union1d(chosen.select("h").toArrow().column("h").to_numpy().view(np.uint64), groups)
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        look = Lookup(shared.value)
        swap = Swaps(look)
        for batch in batches:
            texts, ys = textkit.columns(batch, "text", "y")
            for i, j, data, off in textkit.slices(texts):
                low = textkit.fold_case(data)
                r, f = look(*features(data, off))
                at = np.searchsorted(r, np.arange(j - i + 1))
                more, less = zip(*(swap(f[at[k] : at[k + 1]], low[off[k] : off[k + 1]]) for k in range(j - i)))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32))), pa.array(more, pa.list_(pa.int32())), pa.array(less, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([ys.slice(i, j - i), *lists], ["y", "f", "more", "less"])

    rows = sample.mapInArrow(textkit.tidied(encode), "y int, f array<int>, more array<int>, less array<int>").toArrow().combine_chunks()
    runtime.drop_stored(sample)
    y = rows.column("y").to_numpy().astype(float)
    weight = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    weight /= weight.mean()
    (r, f), (more_row, more), (less_row, less) = (_flat(rows.column(c)) for c in ("f", "more", "less"))
    twins = np.append(more_row, less_row), np.append(more, less), np.append(np.ones(len(more)), -np.ones(len(less)))
    model = _train(r, f, *twins, y, weight, len(vocabulary), penalty, l2, steps)
    return {"vocabulary": vocabulary, "weight": model[:-1], "bias": float(model[-1])}


def _flat(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy().astype(np.int64)


def _train(row, feat, twin_row, twin_feat, twin_sign, y, weight, width, penalty, l2, steps, rate=0.1):
    """Adam on the weighted log loss + penalty * (change of the log-odds under swaps)^2 + l2."""
    n = len(y)
    w = np.zeros(width + 1)
    mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    w[-1] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[feat], minlength=n) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.append(np.bincount(feat, weights=error[row], minlength=width), error.sum())
        g[:-1] += l2 * w[:-1] / np.sqrt(n)
        if len(twin_row):
            change = np.bincount(twin_row, weights=twin_sign * w[twin_feat], minlength=n)
            g[:-1] += 2 * penalty / n * np.bincount(twin_feat, weights=twin_sign * change[twin_row], minlength=width)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and ``score``, the probability that label 1 fits the whole text."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    ids = docs.select("doc_id", "text")

    def run(batches):
        m = shared.value
        look = Lookup(m["vocabulary"])
        for batch in batches:
            keys, texts = textkit.columns(batch, "doc_id", "text")
            z = np.full(len(keys), m["bias"])
            for i, j, data, off in textkit.slices(texts):
                rows, hashes = features(data, off)
                r, f = look(rows, hashes)
                if len(r):
                    z[i:j] += np.bincount(r, weights=m["weight"][f], minlength=j - i)
            yield pa.RecordBatch.from_arrays([keys, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return ids.mapInArrow(textkit.tidied(run), "doc_id long, score double")


def reject(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        look = Lookup(m["vocabulary"])
        for batch in batches:
            z = np.full(batch.num_rows, m["bias"])
            for i, j, data, off in textkit.slices(batch.column(batch.schema.get_field_index("text"))):
                rows, hashes = features(data, off)
                r, f = look(rows, hashes)
                if len(r):
                    z[i:j] += np.bincount(r, weights=m["weight"][f], minlength=j - i)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) < threshold))

    return docs.mapInArrow(textkit.tidied(run), docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels")
    part = runtime.crc_mod(F.col("doc_id"), 5)
    model = fit(docs, labels.where(part != 0))
    return score(docs, model).select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
