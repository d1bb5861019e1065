"""Splits as long tables: (iteration_id, role, sample_idx). Order is by md5 of seed and sample, so a split is the same on any engine."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NeedsConfirmation, require
from ..functions import arrow, blocks, ranks

#: Other names of roles.
ROLES = {"train": "train", "training": "train", "calibration": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test", "prediction": "test"}
#: Metadata columns that can be groups, best first.
GROUP_COLUMNS = ("group_id", "group", "batch", "year", "origin", "replicate_id")


def parse_ratio(text: str) -> list[float]:
    """``8:2``, ``6:2:2``, with ``:``, ``/``, ``,`` or a full-width colon; shares that add up to 1."""
    parts = re.split(r"[:/,：]", text.strip())
    if any(not p.strip() for p in parts):
        raise NeedsConfirmation("RATIO_INCOMPLETE", "a part of the ratio is missing", text=text)
    values = [float(p) for p in parts]
    require(len(values) in (2, 3) and all(v > 0 for v in values), "RATIO", "a ratio has two or three positive parts", text=text)
    return [v / sum(values) for v in values]


def allocate(n: int, shares: list[float]) -> list[int]:
    """Counts by share: rounded down but at least 1, then the largest excess is cut or the largest deficit filled."""
    require(n >= len(shares), "TOO_FEW", "there are fewer samples than parts", samples=n, parts=len(shares))
    out = [max(1, int(n * s + 1e-9)) for s in shares]
    while sum(out) > n:
        k = max((i for i in range(len(out)) if out[i] > 1), key=lambda i: (out[i] - n * shares[i], -i))
        out[k] -= 1
    while sum(out) < n:
        k = max(range(len(out)), key=lambda i: (n * shares[i] - out[i], -i))
        out[k] += 1
    return out


#: Groups or classes that a driver-side table may hold.
MAX_GROUPS = 1_000_000


def placed(df: DataFrame, seed, *keys: str, by: str = "sample_idx") -> DataFrame:
    """df with ``place``, from 1, in pseudo-random order of ``by`` within the keys; no task holds a whole order."""
    h = F.md5(F.concat_ws(":", F.lit(seed) if not isinstance(seed, Column) else seed, F.col(by).cast("string")))
    return ranks.hash_places(df, h, by, *keys)


def _counts(df: DataFrame, key: str) -> list:
    """A row per class or group, refused above MAX_GROUPS."""
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    require(len(rows) <= MAX_GROUPS, "TOO_MANY_GROUPS", f"{key} has too many different values for this split", bound=MAX_GROUPS)
    return rows


def _roles(place: Column, counts: list[int]) -> Column:
    names = ["train", "test"] if len(counts) == 2 else ["train", "val", "test"]
    out, edge = F.lit(names[-1]), sum(counts) - counts[-1]
    for name, count in reversed(list(zip(names[:-1], counts[:-1]))):
        out = F.when(place <= edge, name).otherwise(out)
        edge -= count
    return out


def random_split(df: DataFrame, shares: list[float], seed: int = 42) -> DataFrame:
    """Cut the pseudo-random order by counts. The cut points come from order statistics, so no row is numbered in one task.

    The hash of a row is compared with the hash at each cut, found by sorting the hashes over the
    cluster; ``sample_idx`` must be unique.
    """
    counts = allocate(df.count(), shares)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_idx").cast("string")))
    keyed = df.select("sample_idx", key.alias("h"))
    edges = _order_statistics(keyed, [sum(counts[: i + 1]) for i in range(len(counts) - 1)])
    names = ["train", "test"] if len(counts) == 2 else ["train", "val", "test"]
    out = F.lit(names[-1])
    for name, edge in reversed(list(zip(names[:-1], edges))):
        out = F.when(F.struct("h", "sample_idx") <= F.struct(F.lit(edge[0]), F.lit(edge[1]).cast("long")), name).otherwise(out)
    return keyed.select("sample_idx", out.alias("role"))


def _order_statistics(keyed: DataFrame, ranks: list[int]) -> list[tuple[str, int]]:
    """The (h, sample_idx) at each rank (from 1): counts by the hash's first four digits, then one such range in detail."""
    by = {r["p"]: r["n"] for r in keyed.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 536 rows at most
    out = []
    for rank in ranks:
        seen = 0
        for p in sorted(by):
            if seen + by[p] >= rank:
                row = keyed.where(F.substring("h", 1, 4) == p).orderBy("h", "sample_idx").offset(rank - seen - 1).limit(1).first()
                out.append((row["h"], row["sample_idx"]))
                break
            seen += by[p]
    return out


def _by_class(df: DataFrame, label: str, each: dict) -> tuple[DataFrame, Column]:
    """A table of the ranks where each class's parts end, and the condition to join it on."""
    kind = df.schema[label].dataType.simpleString()
    rows = [(k, *(sum(c[: i + 1]) for i in range(len(c) - 1)), *[None] * (3 - len(c))) for k, c in each.items()]
    edges = df.sparkSession.createDataFrame(rows, f"_class {kind}, first_edge long, second_edge long")
    return edges, F.col(label).eqNullSafe(F.col("_class"))


def _edge_role(parts: int) -> Column:
    last = F.lit("test") if parts == 2 else F.when(F.col("place") <= F.col("second_edge"), "val").otherwise("test")
    return F.when(F.col("place") <= F.col("first_edge"), "train").otherwise(last)


def stratified_split(df: DataFrame, shares: list[float], seed: int = 42, label: str = "label") -> DataFrame:
    """Each class cut by its own counts, then single samples moved so that the totals are those of the whole."""
    sizes = {r[label]: r["n"] for r in _counts(df, label)}
    small = [k for k, n in sizes.items() if n < len(shares)]
    require(not small, "CLASS_TOO_SMALL", "a class has fewer samples than parts", classes=small)
    want = allocate(sum(sizes.values()), shares)
    each = {k: allocate(n, shares) for k, n in sorted(sizes.items(), key=lambda t: str(t[0]))}
    while (have := [sum(c[i] for c in each.values()) for i in range(len(shares))]) != want:
        over = max(range(len(shares)), key=lambda i: (have[i] - want[i], -i))
        under = min(range(len(shares)), key=lambda i: (have[i] - want[i], i))
        able = [k for k in each if each[k][over] > 1]
        if not able:
            break
        k = max(able, key=lambda k: (each[k][over] - sizes[k] * shares[over], str(k)))
        each[k][over] -= 1
        each[k][under] += 1
    return placed(df.select("sample_idx", label), seed, label).join(*_by_class(df, label, each)).select("sample_idx", _edge_role(len(shares)).alias("role"))


def predefined(df: DataFrame, column: str) -> DataFrame:
    """Roles from a column; an unknown name is an error, and train and test must not be empty."""
    name = F.lower(F.trim(F.col(column)))
    known = F.create_map(*(F.lit(v) for kv in ROLES.items() for v in kv))
    out = df.select("sample_idx", known[name].alias("role"))
    seen = {r["role"] for r in out.select("role").distinct().collect()}
    require(None not in seen, "UNKNOWN_ROLE", f"{column} holds a name that isn't a role")
    require({"train", "test"} <= seen, "EMPTY_ROLE", "train and test must both have samples", roles=sorted(seen))
    return out


def _fold(place: Column, k: int) -> Column:
    return ((place - 1) % k).cast("int")


def _as_folds(folds: DataFrame, k: int) -> DataFrame:
    """(fold, sample_idx) -> one iteration per fold, its fold as val and the others as train."""
    its = folds.withColumn("iteration_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return its.select("iteration_id", F.when(F.col("fold") == F.col("iteration_id"), "val").otherwise("train").alias("role"), "sample_idx")


def kfold(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return _as_folds(placed(df.select("sample_idx"), seed).select("sample_idx", _fold(F.col("place"), k).alias("fold")), k)


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """Round robin inside each class; a class smaller than k is an error."""
    small = df.groupBy(label).count().where(F.col("count") < k).limit(1).collect()
    require(not small, "CLASS_TOO_SMALL", "a class has fewer samples than folds")
    return _as_folds(placed(df.select("sample_idx", label), seed, label).select("sample_idx", _fold(F.col("place"), k).alias("fold")), k)


def leave_one_out(df: DataFrame) -> DataFrame:
    """n iterations of n rows by nature: a theta self-join on <>; refused above MAX_SEQUENTIAL rows."""
    ids = df.select("sample_idx")
    require(ids.limit(MAX_SEQUENTIAL + 1).count() <= MAX_SEQUENTIAL, "TOO_MANY_ROWS", "leaving one out makes n * n rows and is refused above its bound", bound=MAX_SEQUENTIAL)
    test = ids.select(F.col("sample_idx").alias("iteration_id"))
    return test.crossJoin(ids).select("iteration_id", F.when(F.col("iteration_id") == F.col("sample_idx"), "val").otherwise("train").alias("role"), "sample_idx")


def monte_carlo(df: DataFrame, repeats: int, shares: list[float], seed: int = 42, label: str | None = None) -> DataFrame:
    """Repeated random (or, by label, stratified) splits; repeat r uses seed + r - 1. All repeats in one job."""
    own = [label] if label else []
    its = df.select("sample_idx", *own, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("iteration_id"))
    rows = placed(its, (F.col("iteration_id") + (seed - 1)).cast("string"), "iteration_id", *own)
    if not label:
        return rows.select("iteration_id", _roles(F.col("place"), allocate(df.count(), shares)).alias("role"), "sample_idx")
    each = {r[label]: allocate(r["n"], shares) for r in _counts(df, label)}
    return rows.join(*_by_class(df, label, each)).select("iteration_id", _edge_role(len(shares)).alias("role"), "sample_idx")


def y_bins(df: DataFrame, n: int, parts: int, y: str = "y") -> DataFrame:
    """Rank bins of a target, for stratifying regression: min(10, floor(sqrt(n)), floor(n / parts)) bins of equal rank width."""
    bins = max(1, min(10, int(n**0.5), n // parts))
    rows = ranks.running(ranks.with_bucket(df.select("sample_idx", y), y), F.col("_cut"), [y, "sample_idx"], {"rank": F.lit(1).cast("long")}, inclusive=False)
    return rows.select("sample_idx", y, (F.least(F.lit(bins - 1), F.floor(F.col("rank") * bins / n)) + 1).cast("int").alias("bin"))


def group_split(df: DataFrame, shares: list[float], group: str, seed: int = 42) -> DataFrame:
    """Whole groups by a random split of the group names."""
    names = df.select(F.col(group).alias("sample_idx")).distinct()
    counts = allocate(names.count(), shares)
    roles = placed(names, seed).select("sample_idx", _roles(F.col("place"), counts).alias("role"))
    return df.select("sample_idx", group).join(roles.withColumnRenamed("sample_idx", group), group).select("sample_idx", "role")


def balanced_groups(df: DataFrame, shares: list[float], group: str) -> DataFrame:
    """Whole groups, the largest first, each to the part that lacks most. The loop is over group counts only."""
    sizes = _counts(df, group)
    total = sum(r["n"] for r in sizes)
    lack = [total * s for s in shares]
    names = ["train", "test"] if len(shares) == 2 else ["train", "val", "test"]
    rows = []
    for r in sorted(sizes, key=lambda r: (-r["n"], str(r[group]))):
        k = max(range(len(lack)), key=lambda i: (lack[i], -i))
        lack[k] -= r["n"]
        rows.append((r[group], names[k]))
    roles = df.sparkSession.createDataFrame(rows, f"{group} {df.schema[group].dataType.simpleString()}, role string")
    return df.select("sample_idx", group).join(roles, group).select("sample_idx", "role")


# Representative selection: sequential by nature, one row after the other on the driver.

#: The most rows that are left out one by one.
MAX_SEQUENTIAL = 20_000


def _distance_sample(df: DataFrame, y: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    ids, x, *target = arrow.collected(df, *([y] if y else []))
    std = x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    x = (x - x.mean(axis=0)) / np.where(std > 0, std, 1.0)
    return ids, x, target[0].astype(float) if y else None


class _Away:
    """Distances between rows of x, with y as a share of two scaled parts; exact term by term, or a lower or upper bound by a matrix product."""

    def __init__(self, x: np.ndarray, y: np.ndarray | None = None, scale: float = 1.0, spread: float = 1.0):
        self.x, self.y, self.scale, self.spread = x, y, scale, spread
        self.spare = 2 * blocks.slack(x, x[:0])

    def exact(self, i, j) -> np.ndarray:
        d = np.sqrt(((self.x[i] - self.x[j]) ** 2).sum(axis=1))
        return d if self.y is None else d / self.scale + np.abs(self.y[i] - self.y[j]) / self.spread

    def bound(self, i, j, side: int) -> np.ndarray:
        """A bound of every pair of i and j: from above with side 1, from below with -1."""
        d = np.sqrt(np.maximum(blocks.squares(self.x[i], self.x[j]) + side * self.spare, 0))
        if self.y is not None:
            d = d / self.scale + np.abs(self.y[i][:, None] - self.y[j]) / self.spread
        return d * (1 + side * 1e-14)


def _farthest(spark, away: _Away, rows: np.ndarray) -> tuple[float, int, int]:
    """The farthest pair i < j of these rows with its distance, the first of equals; stripes of rows are tasks."""
    shared = spark.sparkContext.broadcast((away, rows))
    stripe, width = 512, 4096

    def run(batches):
        away, rows = shared.value
        for pdf in batches:
            for s in pdf["id"]:
                i, best = rows[s * stripe : (s + 1) * stripe], (-1.0, 0, 0)
                for at in range(s * stripe, len(rows), width):
                    j = rows[at : at + width]
                    high = np.where(i[:, None] < j, away.bound(i, j, 1), -1.0)
                    a, b = np.unravel_index(high.argmax(), high.shape)
                    if high[a, b] < max(best[0], 0.0):
                        continue
                    a, b = np.nonzero(high >= max(best[0], away.exact(i[a : a + 1], j[b : b + 1])[0]))
                    d = away.exact(i[a], j[b])
                    for k in np.flatnonzero(d == d.max()):
                        best = max(best, (float(d[k]), -int(i[a[k]]), -int(j[b[k]])))
                yield pd.DataFrame({"d": [best[0]], "i": [best[1]], "j": [best[2]]})

    parts = blocks.count(len(rows), stripe)
    arrow.shared.ship(spark)
    found = spark.range(parts).repartition(min(parts, 200)).mapInPandas(run, "d double, i long, j long").collect()
    d, i, j = max((r["d"], r["i"], r["j"]) for r in found)
    shared.destroy()
    return d, -i, -j


class _Part:
    """A part that grows by the free row farthest from its own.

    Distances to the part only fall. So the rows that lead are kept up to date at every step, and the
    others, in one matrix product, only when the best of the leaders no longer beats what they had.
    Bounds tell which distances can lower a row's least one; those are measured term by term.
    """

    LEADERS = 2048

    def __init__(self, away: _Away, n: int):
        self.away, self.near, self.rows, self.late = away, np.full(n, np.inf), [], []
        self.lead, self.other = np.zeros(0, np.int64), np.inf

    def add(self, k: int) -> None:
        self.rows.append(k)
        self.late.append(k)
        self.near[self.lead] = np.minimum(self.near[self.lead], self.away.exact(self.lead, np.full(len(self.lead), k)))

    def _refresh(self, free: np.ndarray) -> None:
        led = np.zeros(len(free), bool)
        led[self.lead] = True
        rest, late = np.flatnonzero(free & ~led), np.array(self.late, np.int64)
        for at in range(0, len(rest), 2048):
            i = rest[at : at + 2048]
            for c in range(0, len(late), 2048):
                j = late[c : c + 2048]
                a, b = np.nonzero(self.away.bound(i, j, -1) <= self.near[i][:, None])
                for e in range(0, len(a), 100_000):
                    np.minimum.at(self.near, i[a[e : e + 100_000]], self.away.exact(i[a[e : e + 100_000]], j[b[e : e + 100_000]]))
        self.late = []
        at = np.flatnonzero(free)
        near = self.near[at]
        edge = np.partition(near, -self.LEADERS)[-self.LEADERS] if len(at) > self.LEADERS else -np.inf
        self.lead = at[near >= edge]
        self.other = near[near < edge].max(initial=-1.0)

    def best(self, free: np.ndarray) -> int:
        """The free row farthest from the part, the first of equals."""
        while True:
            near = np.where(free[self.lead], self.near[self.lead], -1.0)
            if len(near) and near.max() > self.other:
                return int(self.lead[near.argmax()])
            self._refresh(free)


def kennard_stone(df: DataFrame, shares: list[float], y: str | None = None) -> DataFrame:
    """Training rows by max-min distance from the farthest pair on (with y: SPXY); the rest is dealt in hash order."""
    spark = df.sparkSession
    ids, x, target = _distance_sample(df, y)
    counts, every = allocate(len(ids), shares), np.arange(len(ids))
    away = _Away(x)
    if y:
        away = _Away(x, target, _farthest(spark, away, every)[0] if len(ids) > 1 else 1.0, target.max() - target.min() or 1.0)
        away.scale = away.scale if away.scale > 0 else 1.0
    part, free = _Part(away, len(ids)), np.ones(len(ids), bool)
    for k in _farthest(spark, away, every)[1:][: counts[0]]:
        part.add(k)
        free[k] = False
    while len(part.rows) < counts[0]:
        k = part.best(free)
        part.add(k)
        free[k] = False
    train = _as_rows(spark, ids[part.rows], "train")
    rest = df.select("sample_idx").join(train, "sample_idx", "left_anti")
    if len(counts) == 2:
        return train.unionByName(rest.withColumn("role", F.lit("test")))
    return train.unionByName(placed(rest, 42).select("sample_idx", F.when(F.col("place") <= counts[1], "val").otherwise("test").alias("role")))


def _as_rows(spark, ids: np.ndarray, role: str) -> DataFrame:
    return spark.createDataFrame(pa.table({"sample_idx": ids.astype(np.int64)})).withColumn("role", F.lit(role))


def duplex(df: DataFrame, shares: list[float]) -> DataFrame:
    """Parts take turns: each starts with the farthest free pair and goes on with the free sample farthest from its own."""
    spark = df.sparkSession
    ids, x, _ = _distance_sample(df, None)
    counts = allocate(len(ids), shares)
    names = ["train", "test"] if len(shares) == 2 else ["train", "val", "test"]
    free, left = np.ones(len(ids), bool), len(ids)
    away = _Away(x)
    parts = [_Part(away, len(ids)) for _ in shares]

    while left:
        for p, part in enumerate(parts):
            room = counts[p] - len(part.rows)
            if not room or not left:
                continue
            if not part.rows and room > 1 and left > 1:
                picked = _farthest(spark, away, np.flatnonzero(free))[1:]
            elif part.rows:
                picked = [part.best(free)]
            else:
                at = np.flatnonzero(free)
                picked = [int(at[away.exact(at, np.full(len(at), at[0])).argmax()])]
            for k in picked:
                part.add(k)
                free[k] = False
                left -= 1
    return reduce(DataFrame.unionByName, (_as_rows(spark, ids[part.rows], name) for part, name in zip(parts, names)))


# Reports.


def label_distribution(df: DataFrame, split: DataFrame) -> DataFrame:
    """Samples by role and label."""
    return df.select("sample_idx", "label").join(split, "sample_idx").groupBy("role", "label").agg(F.count(F.lit(1)).alias("n"))


def leakage(df: DataFrame, split: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one role."""
    return df.select("sample_idx", group).join(split, "sample_idx").groupBy(group).agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def coverage(df: DataFrame, split: DataFrame) -> DataFrame:
    """Mean distance to the overall centre by role."""
    from .quality import band_means

    away = df.crossJoin(F.broadcast(band_means(df))).select("sample_idx", F.sqrt(F.aggregate(F.zip_with("x", "mean_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("d"))
    return away.join(split, "sample_idx").groupBy("role").agg(F.avg("d").alias("mean_distance"), F.count(F.lit(1)).alias("n"))


def sizes(split: DataFrame) -> DataFrame:
    """Least, most and mean rows of each role over the iterations."""
    each = split.groupBy("iteration_id", "role").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("role").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def require_complete(df: DataFrame, split: DataFrame) -> None:
    """Every sample exactly once."""
    row = split.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_idx").alias("d")).first()
    require(row.n == row.d == df.count(), "SPLIT_INCOMPLETE", "a split must hold every sample exactly once", rows=row.n, distinct=row.d)
    require(not split.join(df, "sample_idx", "left_anti").limit(1).count(), "SPLIT_UNKNOWN", "a split holds an unknown sample")
