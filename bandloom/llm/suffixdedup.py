"""Repeated byte strings: suffix arrays over shards of anchored contexts.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else (in any
document, or elsewhere in its own). Matches never cross documents.

1. Anchors. Each window of ``length`` bytes has an anchor: the place of the least hash of the
   32-byte grams in it. Equal windows have equal anchors at equal distances, so windows are handled
   in runs of one anchor: the context text[lo : hi + length] around it, about one for each
   (length - 32) / 2 bytes. Equal contexts (by 192 bits of hashes or more) are merged into one with its
   number of copies. Short texts are handled together, one after the other in an array.
2. Candidates. A window that repeats holds, beside the anchor, at least half its length on one
   side. Contexts are kept whose left or right half-window at the anchor occurs in another context,
   where each has windows that reach so far to that side. Windows of one context differ from each other,
   so of other contexts all windows repeat where the context has copies, and none where it has none.
3. Shards. Contexts are dealt to shards by anchor gram, so equal windows meet in one shard; an
   anchor with more contexts than ``split`` is dealt over several shards. Each shard sorts its
   suffixes to depth ``length`` by Larsson-Sadakane refinement (ranks double in depth, sorted
   groups rest) and takes common prefixes of neighbours by Kasai's rule (a prefix is at most one
   shorter than that of the suffix one place before), done in whole arrays.
4. Merge across shards. Only windows of split anchors can repeat in another shard. Each such shard
   sends the 128-bit fingerprints of its classes; a sorted join finds those that more than one shard
   holds. ``split`` moves work between steps 3 and 4 and changes no result.
5. The marked windows go back over the merged contexts to the documents, where runs are united.

Passages (``words``): the same runs over texts in which each word (a run of bytes without white space)
is a symbol, a 32-bit hash, on windows of that many symbols, however few their bytes and whatever the
white space between them. Windows that differ in one word are taken for equal with probability
2**-32. Ranges are whole words.

Null texts count as empty; texts shorter than a window lose nothing. Rows with equal doc_id and
text are copies of each other and both count. Null doc_ids are treated like any other. Empty
tables give no rows. Extra columns are ignored (``strip`` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .textkit import U64

GRAM = 32
CODE = 4
#: Bytes of texts that are handled together.
TOGETHER = 1 << 17


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values (block prefix and suffix minima)."""
    n = len(v)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(U64).max, U64)
    padded[:n] = v
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _coded(column, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts; for a step of CODE, of their words' codes."""
    if step == 1:
        return textkit.column_bytes(column)
    codes, n = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
    for _, _, data, off in textkit.slices(column, TOGETHER):
        start, end, row = textkit.tokens(data, off, textkit.WHITE)
        codes.append((_Prefix(data)(start, end) >> U64(32)).astype("<u4"))
        n.append(np.bincount(row, minlength=len(off) - 1))
    return np.concatenate(codes).view(np.uint8), np.cumsum(np.concatenate(n)) * CODE


def _symbols(data: np.ndarray, step: int) -> np.ndarray:
    return data if step == 1 else data.view("<u4")


class _Prefix:
    """Hashes of any spans of symbols (bytes or codes), from the prefix sums of a polynomial modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.back = _powers(pow(_SPAN, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, U64)
        value = _BYTE_VALUES[symbols] if symbols.itemsize == 1 else textkit.mix(symbols.astype(U64) + U64(1))
        value *= _powers(_SPAN, n)[:n]
        np.cumsum(value, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textkit.mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64))

    def grams(self, size: int) -> np.ndarray:
        """A hash of the ``size`` symbols from each place that has as many."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.back[: len(h)]
        h ^= h >> U64(32)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(29)
        return h


_SPAN = 0x9E3779B97F4A7C15
_BYTE_VALUES = textkit.mix(np.arange(1, 257, dtype=U64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(mult: int, n: int) -> np.ndarray:
    got = _POWERS.get(mult)
    if got is None or len(got) < n + 1:
        got = np.full(max(n + 1, 1 << 17), mult, U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _POWERS[mult] = got
    return got


def window_runs(data: np.ndarray, off: np.ndarray, length: int, step: int = 1):
    """The runs of windows of one anchor in texts that lie one after the other, sorted by (text, context), and where each first context begins.

    (text, lo, hi, hashes of gram, left and right half-window and context); windows start at multiples of step
    from the start of their text, and a half that no window of its run reaches is 0. None if no text has a window.
    """
    symbols, at_text = _symbols(data, step), off // step
    deep, gram = length // step, GRAM // step
    left = (deep - gram + 1) // 2
    n, last = len(symbols), at_text[1:] - deep
    if not (last >= at_text[:-1]).any():
        return None
    span = _Prefix(symbols)
    h = span.grams(gram)
    place_bits = max(24, int(n).bit_length())
    packed = (h >> U64(place_bits)) << U64(place_bits)
    packed |= np.arange(len(h), dtype=U64)
    least = _sliding_min(packed, deep - gram + 1)
    least &= U64((1 << place_bits) - 1)
    new = np.append(True, least[1:] != least[:-1])
    new[at_text[:-1][at_text[:-1] < len(new)]] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(least)) - 1
    text = np.searchsorted(at_text, lo, side="right") - 1
    whole = lo <= last[text]  # the others reach over the end of their text
    lo, text = lo[whole], text[whole]
    hi = np.minimum(hi[whole], last[text])
    at = least[lo].astype(np.int64)
    l_key = np.where(at - lo >= left, span(np.maximum(at - left, 0), at + gram), U64(0))
    r_key = np.where(at - hi < left, span(at, np.minimum(at + deep - left, n)), U64(0))
    context = span(lo, hi + deep)
    order = np.lexsort((context, text))
    text, context = text[order], context[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (context[1:] != context[:-1])))
    start = at_text[text]
    return text, (lo[order] - start) * step, (hi[order] - start) * step, h[at][order], l_key[order], r_key[order], context, first


def contexts(keyed: DataFrame, length: int, step: int = 1) -> DataFrame:
    """One row per document and distinct context: the run's places and width, and hashes of the anchor's gram, the half-windows and the context.

    A text that repeats itself has many runs of one context; they share a row, so that a periodic
    text doesn't flood one key.
    """
    runtime.ship(keyed.sparkSession)

    def emit(batch, out):
        row, n, los, width, *hashes = (np.concatenate(c) for c in zip(*out))
        row = pa.array(row)
        los = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(los.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(c.take(row) for c in textkit.columns(batch, "kid", "kh")), los, pa.array(width.astype(np.int32)), *(pa.array(h.view(np.int64)) for h in hashes)], ["kid", "kh", "los", "width", "gram", "lk", "rk", "c1"])

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i, data, off in _coded_slices(*textkit.columns(batch, "text"), step):
                found = window_runs(data, off, length, step)
                if found is None:
                    continue
                text, lo, hi, *hashes, first = found
                out.append((i + text[first], np.diff(np.append(first, len(text))), lo, (hi - lo)[first], *(h[first] for h in hashes)))
                held += len(lo)
                if held > 20_000:
                    yield emit(batch, out)
                    out, held = [], 0
            if out:
                yield emit(batch, out)

    return keyed.mapInArrow(textkit.tidied(run), "kid long, kh long, los array<int>, width int, gram long, lk long, rk long, c1 long")


def _coded_slices(column, step: int):
    """(first row, bytes, offsets) of runs of rows, as _coded has them."""
    for i, j, data, off in textkit.slices(column, TOGETHER):
        yield i, *((data, off) if step == 1 else _coded(column.slice(i, j - i), step))


def suffix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` symbols: equal ranks, equal symbols.

    Ranks of as many symbols as fit 40 bits come first, then pairs of ranks double the depth; groups
    of one rest. Keys are sorted together with their places where both fit 64 bits. The last
    ``depth`` suffixes are short.
    """
    n = len(symbols)
    bits = U64(max(1, int(n).bit_length()))
    packs = 3 * int(bits) <= 64
    wide = 8 * symbols.itemsize
    if wide > 8:  # words: their ranks
        symbols = np.unique(symbols, return_inverse=True)[1]
        wide = max(1, int(symbols.max(initial=0)).bit_length())
    have = max(1, 40 // wide) if wide != 8 else 5
    have = min(have, depth)
    word = np.zeros(n, U64)
    for k in range(have):
        word <<= U64(wide)
        word[: n - k] |= symbols[k:].astype(U64)
    if int(bits) <= 24:
        both = np.sort(word << U64(24) | np.arange(n, dtype=U64))
        s, order = both >> U64(24), (both & U64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.argsort(word)
        s = word[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), np.arange(n), 0))
    while have < depth:
        step = min(have, depth - have)
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank] > 1)
        if not len(live):
            break
        second = rank[np.minimum(live + step, n - 1)].astype(U64)
        first = rank[live].astype(U64)
        if packs:
            both = np.sort((first << bits | second) << bits | live.astype(U64))
            who = (both & ((U64(1) << bits) - U64(1))).astype(np.int64)
            pair = both >> bits
            group = pair >> bits
        else:
            order = np.lexsort((second, first))
            who, group = live[order], first[order]
            pair = np.cumsum(np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))
        at = np.arange(len(who))
        head = np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1]), at, 0)) - np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        rank[who] += head
        have += step
    return rank


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """At each place: symbols shared with the suffix before it in ``order``, compared up to ``most``.

    Kasai's rule in whole arrays: where the neighbour of a place follows that of the place before
    it, whose first symbols agree, the prefix is one less than at the place before; only at the other
    places, the heads, symbols are compared, 64 bits at a time. Values of places up to ``most - x`` after
    a head are exact below x.
    """
    n = len(symbols)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (phi[:-1] >= 0) & (phi[:-1] + 1 == phi[1:]) & (symbols[:-1] == symbols[phi[:-1]])
    live = np.flatnonzero((phi >= 0) & ~chained)
    wide, per = 8 * symbols.itemsize, 8 // symbols.itemsize
    padded = np.append(symbols, np.zeros(2 * per, symbols.dtype)).astype(U64)
    word = np.zeros(n + per, U64)
    for k in range(per):
        word = word << U64(wide) | padded[k : k + n + per]
    plcp = np.zeros(n, np.int64)
    shared = 0
    while len(live) and shared < most:
        differ = word[np.minimum(live + shared, n)] ^ word[np.minimum(phi[live] + shared, n)]
        lead = np.zeros(len(live), np.int64)
        for k in range(1, per + 1):
            lead += differ < (U64(1) << U64(64 - wide * k)) if k < per else differ == 0
        plcp[live] += lead
        live, shared = live[lead == per], shared + per
    here = np.arange(n)
    head = np.maximum.accumulate(np.where(chained, 0, here))
    return plcp[head] + head - here


def repeats_in_shard(texts: list[bytes], copies: np.ndarray, length: int, step: int = 1):
    """For each window of the contexts of a shard: context, offset, place in data, whether it repeats, whether it is the first of its equals; and data (bytes all)."""
    size = np.array([len(t) for t in texts], np.int64) // step
    deep = length // step
    windows = size - deep + 1
    data = np.frombuffer(b"".join(texts) + b"\0" * length, np.uint8)
    symbols = _symbols(data, step)
    who = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(who)) - np.repeat(textkit.exclusive(windows), windows)
    place = textkit.exclusive(size)[who] + offset
    rank = suffix_ranks(symbols, deep)
    # the suffix array of the places that have a whole window inside their context; equal ranks by place
    order = np.sort(rank[place].astype(U64) << U64(32) | place.astype(U64))
    order = (order & U64(0xFFFFFFFF)).astype(np.int64)
    same = common_prefixes(symbols, order, 2 * deep)[order] >= deep  # as long a prefix as a window, with the one before
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    of = np.zeros(len(symbols), np.int64)
    of[place] = copies[who]
    total = np.bincount(head, weights=of[order], minlength=len(order))
    repeats = np.zeros(len(symbols), bool)
    repeats[order] = total[head] > 1
    first = np.zeros(len(symbols), bool)
    first[order[~same]] = True
    return who, offset * step, place * step, repeats[place], first[place], data


def _runs_of(who: np.ndarray, offset: np.ndarray, flag: np.ndarray, step: int = 1):
    """Runs of successive flagged windows of one context: (context, first, last)."""
    w, o = who[flag], offset[flag]
    if not len(w):
        return w, o, o
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1] + step)))
    return w[first], o[first], o[np.append(first[1:], len(w)) - 1]


def _blocks(batches, key: str, measure: str, most: int):
    """Tables of whole groups of ``key`` (by which the rows are sorted) with about ``most`` bytes of column ``measure``."""
    rest, held = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.column(batch.schema.get_field_index(measure)).nbytes))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            rest.append(part)
            held += part.column(part.schema.get_field_index(measure)).nbytes
            if held >= most:
                block = pa.Table.from_batches(rest).combine_chunks()
                keys = block.column(key).to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0  # the last group may go on
                if cut:
                    yield block.slice(0, cut)
                    held = held * (len(keys) - cut) // len(keys)
                rest = block.slice(cut).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _candidates(whole: DataFrame) -> DataFrame:
    """The contexts of anchors that aren't split that may share windows with others, and, marked ``alone``, those that share none but have copies; equal halves share their gram."""

    def run(batches):
        for block in _blocks(batches, "gram", "gram", 1 << 20):
            shared = np.zeros(len(block), bool)
            for side in ("lk", "rk"):
                half = block.column(side).to_numpy()
                _, inverse, n = np.unique(half, return_inverse=True, return_counts=True)
                shared |= (half != 0) & (n[inverse] > 1)
            keep = pa.array(shared | (block.column("copies").to_numpy() > 1))
            yield from block.append_column("alone", pa.array(~shared)).filter(keep).to_batches()

    return whole.repartition("gram").sortWithinPartitions("gram").mapInArrow(textkit.tidied(run), whole.schema.add("alone", "boolean"))


def repeated_spans(docs: DataFrame, *, length: int = 400, step: int = 1, split: int = 4096, block_bytes: int = 1 << 19) -> DataFrame:
    """``kid``, ``kh`` (id and text hash of a document) and ``spans``: places of contexts with the ranges of their windows that repeat.

    With a step of CODE, length and places count bytes of codes.
    """
    keyed = docs.select(*_key(), "text")
    runs = runtime.stored(contexts(keyed, length, step), "runs")
    same = ["gram", "lk", "rk", "c1"]
    whole = runtime.stored(runs.select("*", F.col("los")[0].alias("lo"), F.size("los").alias("n")).groupBy(*same).agg(*(F.first(c).alias(c) for c in ("kid", "kh", "lo", "width")), F.sum("n").alias("copies")), "contexts")
    # anchors with very many contexts are dealt over several shards, unfiltered
    many = whole.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("gram", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    many = runtime.stored(many, "many")
    few = _candidates(whole.join(many, "gram", "left_anti")).withColumn("shard", F.col("gram")).withColumn("split", F.lit(False))
    hot = whole.join(many, "gram").withColumn("shard", F.xxhash64("gram", F.pmod("c1", "parts"))).withColumns({"split": F.lit(True), "alone": F.lit(False)}).drop("parts")
    chosen = runtime.stored(few.unionByName(hot), "candidates")
    runtime.drop_stored(whole)
    cuts = chosen.where("not alone").groupBy("kid", "kh").agg(F.collect_list(F.struct("lo", "width", *same, "copies", "shard", "split")).alias("cuts"))
    texts = _cut(_join(keyed, cuts, "inner"), length, step).repartition("shard").sortWithinPartitions("shard")
    found = runtime.stored(_sort_shards(texts, length, block_bytes, step), "windows")
    across = found.where("fp is not null").groupBy("fp").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").select("fp")
    merged = found.where("fp is not null").join(across, "fp", "left_semi")
    every = chosen.where("alone").select(*same, F.lit(0).alias("first"), F.col("width").alias("last"))
    ranges = found.where("fp is null").unionByName(merged).select(*same, "first", "last").unionByName(every).groupBy(*same).agg(F.collect_list(F.struct("first", "last")).alias("r"))
    spans = runtime.stored(runs.join(ranges, same).groupBy("kid", "kh").agg(F.collect_list(F.struct("los", "r")).alias("spans")), "spans")
    runtime.drop_stored(runs, chosen, found, many)
    return spans


def _key():
    return F.col("doc_id").alias("kid"), F.xxhash64("text").alias("kh")


def _join(docs: DataFrame, by_key: DataFrame, how: str) -> DataFrame:
    """docs (with kid and kh) and the other columns of by_key; null ids match each other."""
    other = by_key.withColumnsRenamed({"kid": "_kid", "kh": "_kh"})
    return docs.join(other, docs.kid.eqNullSafe(other["_kid"]) & (docs.kh == other["_kh"]), how).drop("_kid", "_kh")


def _cut(once: DataFrame, length: int, step: int) -> DataFrame:
    """The text of each chosen context."""
    names = ["gram", "lk", "rk", "c1", "copies", "shard", "split"]

    def run(batches):
        for batch in batches:
            texts, cuts = textkit.columns(batch, "text", "cuts")
            data, off = _coded(texts, step)
            flat = cuts.flatten()
            base = np.repeat(off[:-1], np.diff(cuts.offsets.to_numpy()))
            lo, width = (flat.field(c).to_numpy() for c in ("lo", "width"))
            for i in range(0, len(flat), 4000):
                s = slice(i, i + 4000)
                text = [data[a:b].tobytes() for a, b in zip(base[s] + lo[s], base[s] + lo[s] + width[s] + length)]
                part = flat.slice(i, 4000)
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in names), pa.array(text, pa.binary())], [*names, "t"])

    return once.select("text", "cuts").mapInArrow(textkit.tidied(run), "gram long, lk long, rk long, c1 long, copies long, shard long, split boolean, t binary")


def _sort_shards(texts: DataFrame, length: int, block_bytes: int, step: int) -> DataFrame:
    """Ranges of repeating windows by context; for split anchors also a fingerprint of each class of equal windows, to meet other shards."""
    same = ["gram", "lk", "rk", "c1"]

    def emit(block, at, first, last, fp=None):
        at = pa.array(at)
        fp = pa.nulls(len(at), pa.binary()) if fp is None else pa.array(fp, pa.binary())
        values = [block.column(c).combine_chunks().take(at) for c in (*same, "shard")]
        values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
        return pa.RecordBatch.from_arrays([*values, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), fp], [*same, "shard", "first", "last", "fp"])

    def run(batches):
        for block in _blocks(batches, "shard", "t", block_bytes):
            # a document's repeated rows send its contexts more than once
            keys = [block.column(c).to_numpy() for c in same]
            order = np.lexsort(keys)
            block = block.take(pa.array(order[np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))]))
            copies, split = (block.column(c).to_numpy() for c in ("copies", "split"))
            who, offset, place, repeats, first, data = repeats_in_shard(block.column("t").to_pylist(), copies, length, step)
            yield emit(block, *_runs_of(who, offset, repeats, step))
            if split.any():
                at = np.flatnonzero(split[who] & first)  # the others of a class repeat here already
                for i in range(0, len(at), 100_000):
                    some = at[i : i + 100_000]
                    marks = [hashlib.blake2b(data[p : p + length], digest_size=16).digest() for p in place[some]]
                    yield emit(block, who[some], offset[some], offset[some], marks)

    return texts.mapInArrow(textkit.tidied(run), "gram long, lk long, rk long, c1 long, shard long, first int, last int, fp binary")


def _merge(starts: np.ndarray, ends: np.ndarray, touching: bool = True):
    """Unite ranges that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, a[1:] > b[:-1] if touching else a[1:] >= b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1]


def _passes(length: int | None, words: int | None) -> list[tuple[int, int]]:
    """(window, step) in bytes, or in bytes of words' codes."""
    return [(length, 1)] * (length is not None) + [(words * CODE if words else 0, CODE)] * (words is not None)


def _with_spans(docs: DataFrame, passes: list[tuple[int, int]], **options) -> tuple[DataFrame, list[str]]:
    """docs with the spans of each pass in columns whose names docs doesn't use."""
    key, word, far_key, far_word, *names = runtime.free_names(docs, "kid", "kh", "far_kid", "far_kh", *(f"spans{i}" for i in range(len(passes))))
    found = None
    for (length, step), name in zip(passes, names):
        one = repeated_spans(docs, length=length, step=step, **options)
        one = one.select(F.col("kid").alias(far_key), F.col("kh").alias(far_word), *(F.col("spans").alias(n) if n == name else F.lit(None).cast(one.schema["spans"].dataType).alias(n) for n in names))
        found = one if found is None else found.unionByName(one)
    if len(passes) > 1:
        found = runtime.stored(found.groupBy(far_key, far_word).agg(*(F.first(n, ignorenulls=True).alias(n) for n in names)), "found")
    keyed = docs.select("*", F.col("doc_id").alias(key), F.xxhash64("text").alias(word))
    both = keyed.join(found, keyed[key].eqNullSafe(found[far_key]) & (keyed[word] == found[far_word]), "left")
    return both.select(*docs.columns, *names), names


def _ranges(spans, row: int, text: np.ndarray, length: int, step: int):
    """Starts and ends of the byte ranges of one row that its spans name, united."""
    first, n, l_at, los, r_at, begin, last = spans
    if not n[row]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = [], []
    for e in range(first[row], first[row] + n[row]):
        lo = los[l_at[e] : l_at[e + 1], None]
        starts.append((lo + begin[r_at[e] : r_at[e + 1]]).ravel())
        ends.append((lo + last[r_at[e] : r_at[e + 1]]).ravel() + length)
    a, b = _merge(np.concatenate(starts), np.concatenate(ends), touching=step == 1)
    if step > 1:  # white space between two runs of words stays
        start, end, _ = textkit.tokens(text, np.array([0, len(text)]), textkit.WHITE)
        a, b = start[a // step], end[b // step - 1]
    return a, b


def _opened(column):
    """The parts of a column of spans that _ranges reads."""
    first = column.offsets.to_numpy()[:-1]
    n = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    l_list, r_list = column.values.field("los"), column.values.field("r")
    return first, n, l_list.offsets.to_numpy(), l_list.values.to_numpy().astype(np.int64), r_list.offsets.to_numpy(), *(r_list.values.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))


def _apply(batch: pa.RecordBatch, passes: list[tuple[int, int]], names: list[str]):
    """(row, text bytes, (starts, ends) of each pass) for each row that has spans."""
    data, off = textkit.column_bytes(batch.column(batch.schema.get_field_index("text")))
    spans = [_opened(c) for c in textkit.columns(batch, *names)]
    for r in np.flatnonzero(np.any([s[1] > 0 for s in spans], axis=0)).tolist():
        text = data[off[r] : off[r + 1]]
        yield r, text, [_ranges(s, r, text, *p) for s, p in zip(spans, passes)]


def _keep(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    if not len(a):
        return text.tobytes()
    return b"".join(text[x:y].tobytes() for x, y in zip(np.append(0, b), np.append(a, len(text))))


def digest(docs: DataFrame, *, length: int = 400, words: int = 51, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, by strings of ``length`` bytes.

    Beside them, passages of ``words`` words that stand elsewhere too, whatever their bytes: their
    number of maximal runs (``n_passages``), the bytes from first to last word of the runs
    (``n_passage_bytes``), and ``repeats``, whether the document holds a repeat of either kind.
    """
    passes = _passes(length, words)
    found, names = _with_spans(docs.select("doc_id", "text"), passes, **options)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            data, off = textkit.column_bytes(*textkit.columns(batch, "text"))
            gone, runs, passages, under = (np.zeros(n, np.int64) for _ in range(4))
            cut = {}
            for r, text, ((a, b), (p, q)) in _apply(batch, passes, names):
                gone[r], runs[r], passages[r], under[r] = (b - a).sum(), len(a), len(p), (q - p).sum()
                if len(a):
                    cut[r] = _keep(text, a, b)
            sha = [hashlib.sha256(cut[r] if r in cut else data[x:y]).hexdigest() for r, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist()))]
            columns = [*textkit.columns(batch, "doc_id"), pa.array(np.diff(off)), pa.array(gone), pa.array(runs), pa.array(sha, pa.string()), pa.array(passages), pa.array(under), pa.array((runs > 0) | (passages > 0))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes", "repeats"])

    return found.mapInArrow(textkit.tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long, repeats boolean")


def strip(docs: DataFrame, *, length: int | None = 400, words: int | None = None, **options) -> DataFrame:
    """docs, all columns, with the repeated bytes (and passages of so many words) taken out of text.

    Both kinds are judged on the input. A cut inside a character drops its rest.
    """
    schema, passes = docs.schema, _passes(length, words)
    found, names = _with_spans(docs, passes, **options)

    def run(batches):
        for batch in batches:
            value = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for r, text, ranges in _apply(batch, passes, names):
                a, b = (np.concatenate(c) for c in zip(*ranges))
                if len(a):
                    value[r] = _keep(text, *_merge(a, b)).decode("utf-8", "ignore")
            out = [pa.array(value, pa.string()) if c.name == "text" else batch.column(batch.schema.get_field_index(c.name)) for c in schema]
            yield pa.RecordBatch.from_arrays(out, [c.name for c in schema])

    return found.mapInArrow(textkit.tidied(run), schema)


def strip_words(docs: DataFrame, *, words: int = 51, **options) -> DataFrame:
    """``strip`` for passages of so many words alone."""
    return strip(docs, length=None, words=words, **options)


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    return digest(runtime.table(spark, sf_dir, "documents"))


#: DuckDB SQL: every window of 400 bytes (in hexadecimal, texts cut into pieces that overlap) and of 51 words, by hash.
ORACLE_OP6 = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS num, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS padded FROM documents),
parts AS (SELECT num, i, c[i] || coalesce(substr(c[i + 1], 1, 798), '') AS part FROM (SELECT num, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT num, regexp_extract_all(h, '.{1,1000}') AS c FROM docs))),
starts AS MATERIALIZED (SELECT num, (i - 1) * 500 + p AS pos, hash(substr(part, 2 * p + 1, 800)) AS k FROM (SELECT num, i, part, unnest(range(least(500, len(part) // 2 - 399))) AS p FROM parts)),
again AS MATERIALIZED (SELECT num, pos FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
jumps AS (SELECT num, pos, CASE WHEN pos > lag(pos) OVER o + 400 THEN 1 ELSE 0 END AS jump FROM again WINDOW o AS (PARTITION BY num ORDER BY pos)),
spans AS (SELECT num, min(pos) AS a, max(pos) + 400 AS b FROM (SELECT num, pos, sum(jump) OVER (PARTITION BY num ORDER BY pos) AS span FROM jumps) GROUP BY num, span),
cuts AS (SELECT num, a, b, lag(b, 1, 0) OVER (PARTITION BY num ORDER BY a) AS before FROM spans),
kept AS (SELECT num, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front FROM cuts JOIN docs USING (num) GROUP BY num),
passages AS MATERIALIZED (SELECT num, pos, hash(string_agg(x, ' ') OVER (PARTITION BY num ORDER BY pos ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS k, count(*) OVER (PARTITION BY num ORDER BY pos ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) AS n FROM (SELECT num, unnest(w) AS x, unnest(range(len(w))) AS pos FROM docs)),
twice AS (SELECT num, pos FROM passages WHERE n = 51 AND k IN (SELECT k FROM passages WHERE n = 51 GROUP BY k HAVING count(*) > 1)),
leaps AS (SELECT num, pos, CASE WHEN pos >= lag(pos) OVER o + 51 THEN 1 ELSE 0 END AS leap FROM twice WINDOW o AS (PARTITION BY num ORDER BY pos)),
runs AS (SELECT num, min(pos) AS a, max(pos) + 51 AS b FROM (SELECT num, pos, sum(leap) OVER (PARTITION BY num ORDER BY pos) AS run FROM leaps) GROUP BY num, run),
under AS (SELECT num, count(*) AS n, sum(octet_length(encode(array_to_string(padded[a + 1 : b], ''))) - octet_length(encode(regexp_extract(padded[a + 1], '^[\x20\x09-\x0D]*')))) AS bytes FROM runs JOIN docs USING (num) GROUP BY num)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(k.gone, 0)::BIGINT AS n_removed, coalesce(k.n, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN k.num IS NULL THEN h ELSE k.front || substr(h, 2 * k.last + 1) END)) AS kept_sha256, coalesce(u.n, 0)::BIGINT AS n_passages, coalesce(u.bytes, 0)::BIGINT AS n_passage_bytes, k.num IS NOT NULL OR u.num IS NOT NULL AS repeats FROM docs d LEFT JOIN kept k USING (num) LEFT JOIN under u ON u.num = d.num"""
