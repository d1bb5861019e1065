"""Near-duplicate documents: MinHash with banding, signature check, exact confirmation, components.

Documents with equal shingle sets are first merged into one class under their least doc_id. Class
signatures (``bands * band_rows`` universal hash minima) are cut into bands; classes that share a
band with the least class of that band become a candidate pair. Pairs whose signatures agree too
little are dropped (far below the threshold only), the rest confirmed on their full sets. Buckets
whose members are still in different components are then compared with further members as pivots
(another one for each bucket and turn), which joins groups whose members differ from the first one.
What is left, members of a bucket in different components, is compared pair by pair, unless their
exact similarities to the bucket's least class (by the triangle inequality of the Jaccard
distance), their sizes, their signatures or longer sketches (2048 minima) rule a link out. So every pair that shares a band is
linked, refuted or already in one component, and no bucket's pairs are all listed. With 32 bands
of 4 rows, a pair at the threshold of 0.8 shares no band with probability 5e-8.

Null and empty texts, and texts without words, have an empty set and are linked with nothing.
Fewer words than a shingle has count as one shingle. Rows that share a doc_id count as one
document. A row with a null doc_id is linked with nothing and kept. Empty tables give no rows.
Extra columns are ignored (``dedupe`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .components import components
from .textkit import U64


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted within it, one after the other, and their bounds."""
    low = textkit.LOWER[data]
    start, end, row = textkit.tokens(low, off, textkit.WHITE)
    word = textkit.span_hashes(low, start, end)
    n = len(off) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    value = np.zeros(max(0, len(word) - width + 1), U64)
    for k in range(width):
        value = value * U64(0x9E3779B97F4A7C15) + word[k : len(word) - width + 1 + k]
    value = textkit.mix(value)
    out, bounds = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            own = np.unique(value[a : b - width + 1])
        elif b > a:
            short = np.array([b - a], U64)
            for w in word[a:b]:
                short = short * U64(0xC2B2AE3D27D4EB4F) + w
            own = textkit.mix(short)
        else:
            own = np.zeros(0, U64)
        out.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return np.concatenate(out) if out else np.zeros(0, U64), bounds


def _minima(value: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` universal hash minima of each non-empty set (rows in the order of the sets)."""
    rng = np.random.default_rng(20240229)
    scale = rng.integers(1, 1 << 63, count, dtype=U64) * U64(2) + U64(1)
    shift = rng.integers(0, 1 << 63, count, dtype=U64)
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, count), U64)
    if len(full):
        for j in range(count):
            out[full, j] = np.minimum.reduceat(value * scale[j] + shift[j], bounds[full])
    return out


def signatures(docs: DataFrame, *, width: int, bands: int, band_rows: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (128 bits that stand for the set), band keys and a byte of each minimum."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keys, texts = textkit.columns(batch, "doc_id", "text")
            for i, j, data, off in textkit.slices(texts, 1 << 20):
                value, bounds = shingles(data, off, width)
                s1 = textkit.segment_sum(textkit.mix(value + U64(0x51)), bounds[:-1], bounds[1:])
                s2 = textkit.segment_sum(textkit.mix(value ^ U64(0xA24BAED4963EE407)), bounds[:-1], bounds[1:])
                low = _minima(value, bounds, bands * band_rows)
                key = np.zeros((j - i, bands), U64)
                for r in range(band_rows):
                    key = key * U64(0x9E3779B97F4A7C15) + low[:, r::band_rows]
                key = textkit.mix(key + np.arange(bands, dtype=U64) * U64(0xD6E8FEB86659FD93))
                byte = (textkit.mix(low) >> U64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(np.diff(bounds)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(list(key.view(np.int64)), pa.list_(pa.int64())), pa.array(list(byte.view(np.int64)), pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "s1", "s2", "band_keys", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(textkit.tidied(run), "doc_id long, n_shingles long, s1 long, s2 long, band_keys array<long>, sig array<long>")


def shingle_sets(docs: DataFrame, *, width: int) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of its text."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keys, texts = textkit.columns(batch, "doc_id", "text")
            for i, j, data, off in textkit.slices(texts):
                value, bounds = shingles(data, off, width)
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(textkit.tidied(run), "doc_id long, shingles array<long>")


def _agree(pairs: DataFrame, sig: DataFrame, need: int) -> DataFrame:
    """The pairs whose signatures agree in at least ``need`` of the minima (by one byte of each)."""
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.where(_equal_bytes(F.col("sig_a"), F.col("sig_b")) >= need).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the sizes of the intersection and the union of their full sets."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return two.select("a", "b", both.alias("i"), (F.size("x") + F.size("y") - both).alias("u"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 32, band_rows: int = 4, pivots: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; linked at 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    made = runtime.stored(signatures(docs, width=width, bands=bands, band_rows=band_rows), "signatures")
    full = made.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "s1", "s2"]
    # combined before the shuffle, so a class with a third of all rows costs a row a task
    classes = runtime.stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min_by(F.struct("band_keys", "sig"), "doc_id").alias("m")), "classes")
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "m.band_keys", "m.sig")
    members = reps.select("rep", "n", F.explode("band_keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    buckets = runtime.stored(members.join(shared, "key"), "buckets")
    linkable = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    size_of = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = buckets.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b"), F.col("n").alias("na")).distinct()
    pairs = pairs.join(size_of, "b").where(linkable).select("a", "b")
    # of a pair at the threshold, fewer equal minima are over 5.5 standard deviations off (2e-8)
    share, count = percent / 100, bands * band_rows
    need = int(count * share - 5.5 * (count * share * (1 - share)) ** 0.5)
    sig = reps.select("rep", "sig")
    pairs = runtime.stored(_agree(pairs, sig, need), "pairs")
    some = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = runtime.stored(shingle_sets(docs.select("doc_id", "text").join(some, "doc_id", "left_semi"), width=width).dropDuplicates(["doc_id", "shingles"]), "sets")
    star = runtime.stored(_similar(pairs, sets), "star")
    linked = F.col("i") * 100 >= F.col("u") * percent
    edges = star.where(linked).select("a", "b").distinct()
    found = runtime.stored(components(edges), "components")
    temporary = [found]
    for turn in range(pivots):
        mixed = _mixed(buckets, found)
        temporary.append(mixed)
        more = _similar(_agree(_turned(mixed, turn, percent), sig, need), sets).where(linked).select("a", "b").distinct()
        more = runtime.stored(more, "more")
        temporary.append(more)
        if not more.limit(1).count():
            break
        found = _joined(found, more)
        temporary.append(found)
    mixed = _mixed(buckets, found)
    temporary.append(mixed)
    rest = runtime.stored(_unresolved(mixed, reps.join(_sketches(mixed, sets), "rep"), star, percent, need), "rest")
    more = runtime.stored(_similar(rest, sets).where(linked).select("a", "b").distinct(), "more")
    temporary += [rest, more]
    if more.limit(1).count():
        found = _joined(found, more)
        temporary.append(found)
    of_class = runtime.stored(classes.select(*same, "rep", "size").join(found, F.col("rep") == found.node, "left").select(*same, "size", F.coalesce("component", "rep").alias("_c")), "of_class")
    out = _back(made.select("doc_id", *same), of_class, same)
    own = F.coalesce(F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_c")), F.col("doc_id"))
    out = runtime.stored(out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")), "neardup")
    runtime.drop_stored(made, classes, buckets, pairs, sets, star, of_class, *temporary)
    return out


#: Rows of a class from which on it is looked up by a broadcast table, at least; and how many such classes there are at most.
HOT_ROWS, HOT_CLASSES = 1000, 10000


def _back(rows: DataFrame, of_class: DataFrame, same: list[str]) -> DataFrame:
    """rows with the component of their class. Large classes, of which there can be no more than HOT_CLASSES, are broadcast; the rest is joined."""
    large = F.col("size") > max(HOT_ROWS, rows.count() // HOT_CLASSES)
    hot, rest = F.broadcast(of_class.where(large).drop("size")), of_class.where(~large).drop("size")
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(rest, same, "left"))


def _equal_bytes(a, b):
    """How many bytes of two signatures (as arrays of 64-bit words of eight) are equal.

    A byte of the exclusive or is zero where they agree; folding its bits into the lowest leaves
    one bit set for each byte that differs.
    """

    def differing(x, y):
        v = x.bitwiseXOR(y)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 4))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))

    return 8 * F.size(a) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, v: s + v)


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components after further edges."""
    stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return runtime.stored(components(stars.unionByName(more)), "components")


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their component, of the buckets that hold more than one component."""
    label = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return runtime.stored(label.join(mixed, "key", "left_semi"), "mixed")


def _turned(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a mixed bucket with a pivot of it (another one for each bucket and turn) of another component."""
    pivot = mixed.groupBy("key").agg(F.min_by(F.struct("rep", "component", "n"), F.xxhash64(F.lit(turn), "key", "rep")).alias("p"))
    both = mixed.join(pivot, "key").where((F.col("component") != F.col("p.component")) & (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent))
    return both.select(F.greatest("rep", "p.rep").alias("a"), F.least("rep", "p.rep").alias("b")).distinct()


#: Minima of the long sketch that members of mixed buckets get, two bits of each.
SKETCH = 2048


def _sketches(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, sketch) of each member of a mixed bucket: two bits of each of SKETCH minima of its full set."""
    own = sets.join(mixed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lane = U64(2) * np.arange(32, dtype=U64)

    def run(batches):
        for batch in batches:
            keys, lists = textkit.columns(batch, "doc_id", "shingles")
            bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(U64)
            for i in range(0, len(keys), 128):
                part = bounds[i : i + 129]
                low = _minima(flat[part[0] : part[-1]], part - part[0], SKETCH)
                bits = (textkit.mix(low) >> U64(62)).reshape(len(part) - 1, -1, 32)
                words = np.bitwise_or.reduce(bits << lane, axis=2)
                yield pa.RecordBatch.from_arrays([keys.slice(i, len(part) - 1), pa.array(list(words.view(np.int64)), pa.list_(pa.int64()))], ["rep", "sketch"])

    return own.select("doc_id", "shingles").mapInArrow(textkit.tidied(run), "rep long, sketch array<long>")


def _equal_lanes(a, b):
    """How many of the two-bit lanes of two sketches are equal."""

    def differing(x, y):
        v = x.bitwiseXOR(y)
        return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return SKETCH - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, v: s + v)


def _unresolved(mixed: DataFrame, reps: DataFrame, star: DataFrame, percent: int, need: int) -> DataFrame:
    """Pairs of one bucket in different components that nothing rules out.

    Ruled out are pairs by their sizes, by their distances to the bucket's least class, by too few
    equal signature bytes or sketch lanes, and in all buckets that they share but one.
    """
    near = star.select(F.col("a").alias("rep"), F.col("b").alias("centre"), (F.col("i") / F.col("u")).alias("j"))
    rows = mixed.where("rep <> centre").join(near, ["rep", "centre"], "left").join(reps.select("rep", "band_keys", "sig", "sketch"), "rep")
    side = lambda s, **names: rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "component", "j", "band_keys", "sketch")), F.col("sig").alias(f"sig_{s}"))
    slack = (100 - percent) / 100 + 1e-9
    apart = F.coalesce(F.abs(F.col("j_x") - F.col("j_y")) > slack, F.lit(False))
    size = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    x, y = side("x"), side("y")
    once = F.array_min(F.array_intersect("band_keys_x", "band_keys_y")) == x.key
    same = percent / 100 + (1 - percent / 100) / 4  # chance that a lane of a pair at the threshold is equal
    fine = _equal_lanes(F.col("sketch_x"), F.col("sketch_y")) >= int(SKETCH * same - 5.5 * (SKETCH * same * (1 - same)) ** 0.5)
    agree = _equal_bytes(F.col("sig_x"), F.col("sig_y")) >= need
    both = x.join(y, (x.key == y.key) & (F.col("component_x") < F.col("component_y")) & size & ~apart & agree & fine & once)
    return both.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that no other row of their component stands for.

    Rows are told apart by text, too: where a doc_id is null or stands in several rows, each
    different text is a document of its own, under a number made of id and text (above 2**62, and those
    without an id above the others, so that the least id still stands for a group). Of rows equal in doc_id and text one stays, any of them
    if other columns differ. Rows without words are linked with nothing, but repeated ones go.
    """
    key, own, gone_key = runtime.free_names(docs, "row_key", "own_id", "gone_key")
    # ids that don't tell rows apart; as a written table its size is known, so that a small one is broadcast
    many = runtime.stored(docs.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")).where(F.col(own).isNull() | (F.col("n") > 1)).select(own, F.lit(True).alias(key)), "repeated")
    if many.isEmpty():
        once = docs.withColumn(key, F.col("doc_id"))
    else:
        base = F.when(F.col("doc_id").isNull(), 3 << 61).otherwise(1 << 62)
        made = F.shiftrightunsigned(F.xxhash64(F.lit(41), "doc_id", F.coalesce("text", F.lit(""))), 3).bitwiseOR(base)
        rows = docs.join(many, docs.doc_id.eqNullSafe(many[own]), "left")
        alone = rows.where(F.col(key).isNull()).select(*docs.columns, F.col("doc_id").alias(key))
        once = alone.unionByName(rows.where(F.col(key)).select(*docs.columns, made.alias(key)).dropDuplicates([key]))
    gone = near_duplicates(once.select(F.col(key).alias("doc_id"), "text"), **options).where("not kept").select(F.col("doc_id").alias(gone_key))
    gone = runtime.stored(gone, "gone")  # its size is known then
    return once.join(gone, once[key] == gone[gone_key], "left_anti").select(*docs.columns)


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(runtime.table(spark, sf_dir, "documents"), width=2)


#: DuckDB SQL: all pairs that share a shingle, and everything reachable from each document.
ORACLE_OP2 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
edges AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM reach r JOIN links e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id"""
