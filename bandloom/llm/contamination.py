"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Items are cut into units of at most ``unit`` words. A unit's BM25 impacts are divided by the score
it gives itself, so a passage that holds a unit scores 1 for it. Every passage of every document
(windows of ``2 * unit`` words, one each ``unit`` words, so that any unit lies whole in one) is a
query. A unit that reaches the threshold must get a known part of it from its rare words; passages
where no unit does are set aside by sums over arrays (an exact bound, as in WAND, but over a whole
batch). The rest go through block-max WAND, which returns all units at or above the threshold.
An item that a passage retrieves is verified on the words around it: its question (all but the last sentence)
and answer (the last sentence), by the share of their five-word shingles that occur there. A part of
fewer words is one shingle, looked for among the shingles of as many words.

A pair is a leak if the whole item overlaps by ``overlap`` or more, or question and answer both do.
Null and empty texts and items without words match nothing; empty tables give no rows. Repeated
items are matched each; repeated rows give repeated pairs only once. The benchmark is dealt over
indexes of ``block_items`` items each, one broadcast for each, all of which see a batch in one pass
over the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit

SHINGLE = 5


def _words(text: str) -> np.ndarray:
    data = textkit.fold_case(np.frombuffer(text.encode(), np.uint8))
    start, end, _ = textkit.tokens(data, np.array([0, len(data)]), textkit.NOT_ALNUM)
    return textkit.span_hashes(data, start, end)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles."""
    if not 0 < k <= len(words):
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    return textkit.mix(h)


def _part(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The width of a part's shingles, five words or all it has, and their hashes."""
    k = min(SHINGLE, len(words))
    return k, np.unique(_shingles(words, k))


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; of one sentence, its first two thirds and the rest."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, 2 * len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Postings by term with impacts, in blocks of units with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], unit: int, threshold: float, k1: float = 1.2, b: float = 0.75, block: int = 16):
        self.unit, self.block = unit, block
        self.items = []
        units, owner = [], []
        for item_id, text in items:
            words = _words(text or "")
            if not len(words):
                continue
            q, a = question_answer(text)
            self.items.append((item_id, len(words), _part(words), _part(_words(q)), _part(_words(a))))
            for i in range(0, len(words), unit):
                part = words[i : i + unit]
                if i and len(part) < unit // 4:
                    continue  # a short rest is verified with its item
                units.append(part)
                owner.append(len(self.items) - 1)
        self.owner = np.array(owner, np.int64)
        n = len(units)
        terms, unit_of, tf = [], [], []
        for u, part in enumerate(units):
            t, c = np.unique(part, return_counts=True)
            terms.append(t)
            unit_of.append(np.full(len(t), u))
            tf.append(c)
        flat = np.concatenate(terms) if n else np.zeros(0, np.uint64)
        unit_of = np.concatenate(unit_of) if n else np.zeros(0, np.int64)
        tf = np.concatenate(tf).astype(float) if n else np.zeros(0)
        self.vocabulary, term = np.unique(flat, return_inverse=True)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = np.array([len(p) for p in units], float)
        mean = length.mean() if n else 1.0
        impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[unit_of] / mean))
        own = np.bincount(unit_of, weights=impact, minlength=n)
        impact = impact / np.maximum(own[unit_of], 1e-9)
        order = np.lexsort((unit_of, term))
        bounds = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        # the commonest words that together make up at most two thirds of the threshold of any unit
        common, share = np.zeros(len(self.vocabulary), bool), np.zeros(n)
        for t in np.lexsort((np.arange(len(df)), -df)):
            at = order[bounds[t] : bounds[t + 1]]
            more = share[unit_of[at]] + impact[at]
            if len(at) < 2 or more.max() > threshold * 2 / 3:
                break
            share[unit_of[at]] = more
            common[t] = True
        self.rare, self.need = ~common, threshold - (share.max() if n else 0.0)
        self.df, self.first, self.unit_of, self.impact = df, bounds[:-1], unit_of[order], impact[order]
        self.postings, self.best = [], np.zeros(len(self.vocabulary))
        for t in range(len(self.vocabulary)):
            at = order[bounds[t] : bounds[t + 1]]
            u, w = unit_of[at], impact[at]
            last, most = u[min(block, len(u)) - 1 :: block].tolist(), [float(w[i : i + block].max()) for i in range(0, len(u), block)]
            if len(last) < len(most):
                last.append(int(u[-1]))
            self.postings.append((u.tolist(), w.tolist(), last, most))
            self.best[t] = w.max()

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of all units whose score reaches the threshold, by block-max WAND."""
        end = 1 << 60
        lists = [[self.postings[t][0][0], 0, t] for t in terms]  # unit now, place, term
        out = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, None
            for i, (_, _, t) in enumerate(lists):
                bound += self.best[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot is None:
                return out
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            near, edge = 0.0, end  # the best that the blocks around the pivot unit allow, and where they end
            for cursor in lists[: pivot + 1]:
                units, _, last, most = self.postings[cursor[2]]
                k = cursor[1] // self.block
                while k < len(last) and last[k] < unit:
                    k += 1
                if k < len(last):
                    near += most[k]
                    edge = min(edge, last[k])
            if near >= threshold:
                if lists[0][0] == unit:
                    score = 0.0
                    for cursor in lists[: pivot + 1]:
                        score += self.postings[cursor[2]][1][cursor[1]]
                    if score >= threshold:
                        out.append((unit, score))
                    target = unit + 1
                else:
                    target = unit
            else:
                target = edge + 1 if edge < end else unit + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                target = max(target, unit + 1) if lists[0][0] == unit else max(target, unit)
            for cursor in lists[: pivot + 1]:
                if cursor[0] < target:
                    units = self.postings[cursor[2]][0]
                    p = cursor[1]
                    while p < len(units) and units[p] < target:
                        p += 1
                    cursor[1], cursor[0] = p, units[p] if p < len(units) else end
            lists = [c for c in lists if c[0] != end]
        return out


def _passages(index: Index, row: np.ndarray, place: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Rows and windows, in two columns, in which the less common words of some unit reach what it needs of them.

    A unit's common words can give it no more than the threshold less ``index.need``; the rest must
    come from its rare words, whose postings are short: their impacts are summed by window and unit.
    """
    order = np.lexsort((place, term, row))
    before = np.full(len(order), -1)
    same = (row[order][1:] == row[order][:-1]) & (term[order][1:] == term[order][:-1])
    before[order[1:][same]] = place[order[:-1][same]]
    window = place // index.unit
    at = []
    for back in (0, 1):  # each word lies in the window that starts at its own unit and in the one before
        fresh = np.flatnonzero((window >= back) & (before < (window - back) * index.unit))
        at.append((row[fresh], window[fresh] - back, term[fresh]))
    rows, windows, terms = (np.concatenate(c) for c in zip(*at))
    n = index.df[terms]
    posting = np.arange(int(n.sum())) + np.repeat(index.first[terms] - textkit.exclusive(n), n)
    units, wide = len(index.owner), int(windows.max(initial=0)) + 1
    key = (np.repeat(rows, n) * wide + np.repeat(windows, n)) * units + index.unit_of[posting]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(index.impact[posting][order], first) if len(key) else np.zeros(0)
    window = np.unique(key[first][total >= index.need - 1e-9] // units)
    return np.column_stack([window // wide, window % wide])


def _shares(parts: list[tuple[int, np.ndarray]], around: np.ndarray) -> list[float]:
    """Of each part, the share of its shingles that occur among the words around."""
    there = {k: _shingles(around, k) for k, _ in parts}
    return [float(np.isin(part, there[k]).mean()) if len(part) else 0.0 for k, part in parts]


class Scanner:
    """The leaks in whole texts, by one index."""

    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(index.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, texts) -> dict[tuple[int, int], list[float]]:
        """(row, item) -> best score, overlap, question and answer overlap of every leak in a column of texts."""
        index, unit = self.index, self.index.unit
        found: dict[tuple[int, int], list[float]] = {}
        if not len(index.vocabulary):
            return found
        for i, _, data, off in textkit.slices(texts):
            low = textkit.fold_case(data)
            start, end, row = textkit.tokens(low, off, textkit.NOT_ALNUM)
            word = textkit.span_hashes(low, start, end)
            first = np.searchsorted(row, np.arange(len(off)))
            known = np.full(len(word), -1)
            maybe = np.flatnonzero(self.bits[(word >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(index.vocabulary, word[maybe]), len(index.vocabulary) - 1)
            known[maybe] = np.where(index.vocabulary[at] == word[maybe], at, -1)
            hit = np.flatnonzero((known >= 0) & index.rare[known])
            for r, w in _passages(index, row[hit], hit - first[row[hit]], known[hit]).tolist():
                terms = np.unique(known[first[r] + w * unit : min(first[r + 1], first[r] + (w + 2) * unit)])
                terms = terms[terms >= 0].tolist()
                for u, score in index.wand(terms, self.threshold):
                    item = int(index.owner[u])
                    _, size, *parts = index.items[item]
                    lo = max(first[r], first[r] + w * unit - size)
                    got = [score, *_shares(parts, word[lo : min(first[r + 1], first[r] + (w + 2) * unit + size)])]
                    if got[1] >= self.overlap or min(got[2:]) >= self.overlap:
                        old = found.setdefault((i + r, item), got)
                        found[(i + r, item)] = [max(x, y) for x, y in zip(old, got)]
        return found


def _indexes(benchmark: DataFrame, unit: int, threshold: float, block_items: int) -> list:
    """One broadcast index for each block of about ``block_items`` items."""
    items = benchmark.select("item_id", "text").where("text is not null")
    blocks = max(1, -(-items.count() // block_items))
    out = []
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id").collect()  # about block_items rows
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part], unit, threshold)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, unit: int = 48, threshold: float = 0.6, overlap: float = 0.8, block_items: int = 20000) -> DataFrame:
    """doc_id, item_id, the best passage's score and the verified overlaps of every leak.

    Rows that share a doc_id (or have none) share their rows here; ``clean`` judges each row by itself.
    """
    runtime.ship(docs.sparkSession)
    indexes = _indexes(benchmark, unit, threshold, block_items)
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]

    def run(batches):
        scanners = [Scanner(x.value, threshold, overlap) for x in indexes]
        for batch in batches:
            keys, texts = textkit.columns(batch, "doc_id", "text")
            for scanner in scanners:
                found = scanner(texts)
                rows = sorted(found)
                value = np.array([found[x] for x in rows]).reshape(len(rows), 4)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([x[0] for x in rows], pa.int64())), pa.array([scanner.index.items[x[1]][0] for x in rows], pa.int64()), *(pa.array(value[:, c]) for c in range(4))], names)

    out = docs.select("doc_id", "text").mapInArrow(textkit.tidied(run), "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in names[2:]))


def clean(docs: DataFrame, benchmark: DataFrame, *, unit: int = 48, threshold: float = 0.6, overlap: float = 0.8, block_items: int = 20000) -> DataFrame:
    """The rows of docs, all columns, whose text leaks no item; each row is judged where it lies, without a shuffle."""
    runtime.ship(docs.sparkSession)
    indexes = _indexes(benchmark, unit, threshold, block_items)

    def run(batches):
        scanners = [Scanner(x.value, threshold, overlap) for x in indexes]
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for scanner in scanners:
                stay[[row for row, _ in scanner(*textkit.columns(batch, "text"))]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(textkit.tidied(run), docs.schema)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))
