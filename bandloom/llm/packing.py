"""Best-fit packing of token sequences by large-item matching.

Each document becomes its token ids and a final end id, cut into pieces of ``capacity`` only if it
is longer. Packing depends on lengths alone, of which there are at most ``capacity``: the plan is
made on the histogram of lengths, with equal bins handled together, so its size doesn't follow the
corpus. Pieces above a third of the capacity are large: from the longest down, each is paired with
the largest large piece that still fits, at most two to a bin. Smaller pieces, from the longest
down, go to the fullest bin that has room. Pieces then take the places planned for their length,
numbered within (length, salt) groups so that a length that a third of the pieces share is spread.

Null and empty texts give one piece that holds the end id alone. Repeated rows are packed once
each. Null doc_ids are packed like any other. An empty table gives no pieces. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime, textkit

_TOKENIZERS: dict = {}
#: Bytes of texts that are encoded together.
SLICE = 1 << 20


#: Bytes between chunks: blank, tab, line feed and carriage return.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in punctuation]] = True
_ALNUM = ~textkit.NOT_ALNUM
_ALNUM[0x80:] = False


class Encoder:
    """Token ids of whole texts, each distinct part of them encoded once and kept.

    The tokenizer never joins over white space and drops it, and it parts a letter or digit from
    ASCII punctuation after it. So texts are cut at blanks, and trailing punctuation is cut from
    what stands before it where that is an ASCII letter or digit or a Latin-1 letter (not in texts
    that may hold the name of a special token). Parts are known by a 64-bit hash. New parts that are
    Latin-1 letters alone are one word to the tokenizer; they are encoded many at a time by the
    tokenizer's own model without its search for words, and the ids that end words show where each
    stops. All other new parts go through the tokenizer one by one.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most = Tokenizer.from_file(path), most
        self.plain = Tokenizer(self.whole.model)  # the same model, without a normaliser
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[int, bytes] = {}

    def _learn(self, parts: list[tuple[int, str]]) -> None:
        letters = []
        for h, part in parts:
            if part.isalpha() and (part.isascii() or max(part) <= "\xff"):
                letters.append((h, part))
            else:
                self.known[h] = np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        for i in range(0, len(letters), 2000):
            some = letters[i : i + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join([x for _, x in some]).lower()], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some):
                raise ValueError("the tokenizer doesn't end each word with an id of its own kind")
            whole, edges = ids.tobytes(), (4 * stop).tolist()
            for (h, _), x, y in zip(some, [0, *edges], edges):
                self.known[h] = whole[x:y]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their bounds."""
        start, end, row = textkit.tokens(data, off, _BLANK)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        if b"<|" in data.tobytes():
            core = end
        else:
            other = np.maximum.accumulate(np.where(_PUNCTUATION[data], -1, np.arange(len(data))))
            core = np.maximum(other[end - 1] + 1, start)
            last, before = data[np.maximum(core - 1, 0)], data[np.maximum(core - 2, 0)]
            fine = (core == start) | _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (core - start > 1))
            core = np.where(fine, core, end)
        a, b, r = np.concatenate([start, core]), np.concatenate([core, end]), np.concatenate([row, row])
        full = np.flatnonzero(a < b)
        order = full[np.argsort(a[full], kind="stable")]
        a, b, r = a[order], b[order], r[order]
        value, first, inverse = np.unique(textkit.span_hashes(data, a, b), return_index=True, return_inverse=True)
        keys = value.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.known]
        if new:
            if len(self.known) > self.most:
                self.known.clear()
                new = range(len(keys))
            self._learn([(keys[k], data[a[first[k]] : b[first[k]]].tobytes().decode("utf-8", "replace")) for k in new])
        parts = [self.known[h] for h in keys]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        at, n = textkit.exclusive(size)[inverse], size[inverse]
        ids = flat[np.arange(int(n.sum())) + np.repeat(at - textkit.exclusive(n), n)]
        bounds = np.zeros(len(off), np.int64)
        np.cumsum(np.bincount(r, weights=n, minlength=len(off) - 1).astype(np.int64), out=bounds[1:])
        return ids, bounds


def _encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def _encoded(texts, encoder: Encoder):
    """(row, ids as bytes) of each text."""
    for i, j, data, off in textkit.slices(texts, SLICE):
        ids, bounds = encoder(data, off)
        for k in range(j - i):
            yield i + k, ids[bounds[k] : bounds[k + 1]].tobytes()


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids of each piece."""
    runtime.ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            keys, texts = textkit.columns(batch, "doc_id", "text")
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, whole in _encoded(texts, encoder):
                whole += end
                for p, lo in enumerate(range(0, len(whole), step)):
                    part = whole[lo : lo + step]
                    at.append(k)
                    piece.append(p)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            out = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(textkit.tidied(run), schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, copies per bin, first bin, offset): ranks are within a length, from 0.

    Groups of equal bins are split and filled as a whole: at each step the next length goes to the
    fullest group of bins with room for it.
    """
    groups: list[list] = []  # [number of bins, [(length, copies), ...]]
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []

    def put(group: int, room: int) -> None:
        if room > 0:
            if not by_room.get(room):
                insort(rooms, room)
            by_room.setdefault(room, []).append(group)

    def take(room: int) -> int:
        group = by_room[room].pop()
        if not by_room[room]:
            del rooms[bisect_left(rooms, room)]
        return group

    left = {k: n for k, n in counts.items() if n > 0}
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    ascending = large[::-1]
    for a in large:  # pair with the largest large piece that fits
        while left.get(a):
            k = bisect_left(ascending, capacity - a + 1) - 1
            while k >= 0 and not left.get(ascending[k]):
                del ascending[k]
                k -= 1
            b = ascending[k] if k >= 0 and ascending[k] <= a else None
            if b is None or (b == a and left[a] < 2):
                if b == a and k > 0:  # the last of its length: try the next shorter one
                    j = k - 1
                    while j >= 0 and not left.get(ascending[j]):
                        j -= 1
                    b = ascending[j] if j >= 0 else None
                else:
                    b = None
            if b is None:
                groups.append([left[a], [(a, 1)]])
                left[a] = 0
                put(len(groups) - 1, capacity - a)
            elif b == a:
                n = left[a] // 2
                groups.append([n, [(a, 2)]])
                left[a] -= 2 * n
                put(len(groups) - 1, capacity - 2 * a)
            else:
                n = min(left[a], left[b])
                groups.append([n, [(a, 1), (b, 1)]])
                left[a] -= n
                left[b] -= n
                put(len(groups) - 1, capacity - a - b)
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[a]
        while n:
            at = bisect_left(rooms, a)
            if at == len(rooms):  # no bin has room: open new ones and fill them with this length
                each = min(capacity // a, n)
                bins = n // each
                groups.append([bins, [(a, each)]])
                n -= bins * each
                put(len(groups) - 1, capacity - each * a)
                continue
            room = rooms[at]
            group = take(room)
            each = min(room // a, n)
            bins = min(groups[group][0], n // each)
            if bins < groups[group][0]:
                groups.append([groups[group][0] - bins, list(groups[group][1])])
                put(len(groups) - 1, room)
                groups[group][0] = bins
            groups[group][1].append((a, each))
            n -= bins * each
            put(group, room - each * a)
    used: dict[int, int] = {}
    out, first = [], 0
    for bins, content in groups:
        offset = 0
        for length, each in content:
            rank = used.get(length, 0)
            out.append((length, rank, rank + bins * each, each, first, offset))
            used[length] = rank + bins * each
            offset += length * each
        first += bins
    return np.array(out, np.int64).reshape(-1, 6)


def assign(parts: DataFrame, *, capacity: int = 4096, salts: int | None = None) -> DataFrame:
    """``parts`` (stored; with doc_id, piece and length) and for each piece its sequence_id and offset.

    The driver gets the histogram by (salt, length): salts x capacity small rows at most. There is a salt
    for every four million pieces, from 256 to 2048, so that numbering a length's pieces stays a small task.
    """
    spark = parts.sparkSession
    salts = salts or max(256, min(2048, parts.count() >> 22))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    parts = parts.withColumn("_salt", salt)
    sizes = parts.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).toArrow()
    length, at, n = (sizes.column(c).to_numpy() for c in ("length", "_salt", "n"))
    order = np.lexsort((at, length))
    length, at, n = length[order], at[order], n[order]
    before = textkit.exclusive(n) if len(n) else n
    first = np.ones(len(n), bool)
    first[1:] = length[1:] != length[:-1]
    base = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(n)))) if len(n) else before
    places = plan(dict(zip(length[first].tolist(), np.add.reduceat(n, np.flatnonzero(first)).tolist())) if len(n) else {}, capacity)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    shared = spark.sparkContext.broadcast((places, length * salts + at, base))
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    schema = parts.drop("_salt").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        table, keys, bases = shared.value
        top = int(table[:, 2].max()) + 1 if len(table) else 1
        starts = table[:, 0] * top + table[:, 1]
        for batch in batches:
            size, slot, rank = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in textkit.columns(batch, "length", "_salt", "_rank"))
            rank = rank + bases[np.searchsorted(keys, size * salts + slot)]
            row = table[np.searchsorted(starts, size * top + rank, side="right") - 1]
            within = rank - row[:, 1]
            names = [f.name for f in schema if f.name not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*textkit.columns(batch, *names), pa.array(row[:, 4] + within // row[:, 3]), pa.array(row[:, 5] + within % row[:, 3] * size)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(textkit.tidied(run), schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece with the sequence and the offset it is packed at (and its ids, if wanted)."""
    return assign(runtime.stored(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces"), capacity=capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
