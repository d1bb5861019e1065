"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Equal vectors are merged into one point that keeps its least ``k + 1`` vec_ids, so a vector that
many rows share is searched once. The tree is fitted on at most ``fit_rows`` points (chosen by
hash, a documented bound); every point is then put into its leaf. A search walks the tree with a
priority queue on the inner product with the node centres and visits leaves in that order. How
many leaves are visited is calibrated: for ``probe`` queries the true neighbours are found by brute
force, and visits are widened until the share of them that lies in visited leaves reaches
``recall``. Leaves are dealt over groups of bounded size (a large leaf over several). A group is sent
once for each ``block_queries`` of the queries that ask for it, and each such (group, block) pair is one
small product of matrices. A pair keeps every point that may belong to a query's nearest, all ties at
the last place among them; scores are then taken anew in double precision and cut by score and vec_id.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part. Equal rows count once; where rows share a vec_id, the least of their vectors counts. With fewer candidates than ``k`` all are returned; an empty
table gives no rows. Ties go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime, textkit


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) and h (hash of v) of the rows that take part, each once."""
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (sizes.d if sizes else 0))
    return rows.select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))


def points(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: its hash, the vector and its ``keep`` least vec_ids."""
    rank = F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))
    least = rows.withColumn("r", rank).where(F.col("r") <= keep)
    return least.groupBy("h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))


class Tree:
    """A k-means tree: children of inner nodes, centres of all nodes, leaf numbers."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaf_rows: int = 64, rounds: int = 8, seed: int = 5):
        self.centres, self.children, self.leaf = [x.mean(axis=0)], [None], [-1]
        rng, todo, self.leaves = np.random.default_rng(seed), [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            label = self._split(x[rows], branch, rounds, rng) if len(rows) > leaf_rows else None
            if label is None or label.max() == 0:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            kids = []
            for c in range(label.max() + 1):
                own = rows[label == c]
                kids.append(len(self.centres))
                self.centres.append(x[own].mean(axis=0))
                self.children.append(None)
                self.leaf.append(-1)
                todo.append((kids[-1], own))
            self.children[node] = np.array(kids)
        self.centres = np.array(self.centres)
        self.leaf = np.array(self.leaf)

    @staticmethod
    def _split(x, branch, rounds, rng):
        centre = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        label = None
        for _ in range(rounds):
            label = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
            label = np.unique(label, return_inverse=True)[1]
            centre = np.array([x[label == c].mean(axis=0) for c in range(label.max() + 1)])
        return label

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by descent to the nearest child."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.leaf[node] < 0
            if not inner.any():
                return self.leaf[node]
            for at in np.unique(node[inner]):
                own = np.flatnonzero(node == at)
                kids = self.children[at]
                c = self.centres[kids]
                node[own] = kids[(x[own] @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)]

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        score = self.centres @ q
        heap, out = [(-score[0], 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            else:
                for kid in self.children[node]:
                    heapq.heappush(heap, (-score[kid], int(kid)))
        return out


def build(rows: DataFrame, *, k: int, fit_rows: int = 20000, probe: int = 100, recall: float = 0.97):
    """(stored points with their leaf, tree, visits needed)."""
    spark = rows.sparkSession
    runtime.ship(spark)
    distinct = runtime.stored(points(rows, k + 1), "points")
    total = distinct.count()
    if not total:
        return distinct.withColumn("leaf", F.lit(0)), None, 0
    space = 1 << 30
    sample = _matrix(distinct.where(F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(space)) < int(space * min(1.0, fit_rows / total))).orderBy("h").select("v").toArrow().combine_chunks().column("v").combine_chunks())
    if not len(sample):
        sample = _matrix(distinct.orderBy("h").limit(1).select("v").toArrow().combine_chunks().column("v").combine_chunks())
    tree = spark.sparkContext.broadcast(Tree(sample))

    def place(batches):
        for batch in batches:
            h, ids, v = textkit.columns(batch, "h", "ids", "v")
            yield pa.RecordBatch.from_arrays([h, ids, v, pa.array(tree.value.place(_matrix(v)).astype(np.int32))], ["h", "ids", "v", "leaf"])

    placed = runtime.stored(distinct.mapInArrow(textkit.tidied(place), "h long, ids array<long>, v array<double>, leaf int"), "placed")
    runtime.drop_stored(distinct)
    chosen = placed.where(F.pmod(F.xxhash64(F.lit(11), "h"), F.lit(space)) < int(space * min(1.0, 2 * probe / total))).orderBy("h").limit(probe).select("v").toArrow().combine_chunks()
    chosen = _matrix(chosen.column("v").combine_chunks()) if len(chosen) else sample[:probe]
    probes = spark.sparkContext.broadcast(chosen)

    def brute(batches):
        for batch in batches:
            v, leaf = textkit.columns(batch, "v", "leaf")
            x, leaf = _matrix(v), leaf.to_numpy()
            score = probes.value @ x.T
            top = np.argsort(-score, axis=1)[:, : k + 1]
            q = np.repeat(np.arange(len(score)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, top.ravel()]), pa.array(leaf[top.ravel()])], ["q", "s", "leaf"])

    best = placed.select("v", "leaf").mapInArrow(textkit.tidied(brute), "q long, s double, leaf int").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "leaf"))).where(F.col("r") <= k + 1).toArrow()
    q, leaf = best.column("q").to_numpy(), best.column("leaf").to_numpy()
    leaves = tree.value.leaves
    at = np.empty(len(q))
    for i, vector in enumerate(chosen):
        order = np.empty(leaves, np.int64)
        order[tree.value.visits(vector, leaves)] = np.arange(leaves)
        at[q == i] = order[leaf[q == i]]
    need = int(np.sort(at)[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else leaves
    return placed, tree, need


def search(vectors: DataFrame, is_query, *, k: int = 20, group_rows: int = 16384, block_queries: int = 2048, **options) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    rows = runtime.stored(valid(vectors), "vectors")
    placed, tree, need = build(rows, k=k, **options)
    schema = "query_id long, rank int, vec_id long, score double"
    if tree is None:
        return spark.createDataFrame([], schema)
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row per leaf of the bounded tree
    leaves = tree.value.leaves
    count = np.zeros(leaves, np.int64)
    count[sizes.column("leaf").to_numpy()] = sizes.column("n").to_numpy()
    parts = np.maximum(1, -(-count // group_rows))  # a large leaf goes to several groups
    first, group, room = np.zeros(leaves, np.int64), 0, group_rows
    for leaf in range(leaves):
        if parts[leaf] > 1:
            first[leaf], group, room = group + 1, group + 1 + int(parts[leaf]), group_rows
        else:
            if count[leaf] > room:
                group, room = group + 1, group_rows
            first[leaf] = group
            room -= count[leaf]
    asked = rows.where(is_query).select("vec_id", "h")
    shared = spark.sparkContext.broadcast((first, parts))

    def to_group(batches):
        start, many = shared.value
        for batch in batches:
            h, ids, v, leaf = textkit.columns(batch, "h", "ids", "v", "leaf")
            at = leaf.to_numpy()
            salt = (textkit.mix(h.to_numpy().view(np.uint64)) % many[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(start[at] + salt), h, ids, v, leaf], ["g", "h", "ids", "v", "leaf"])

    def ask(batches):
        start, many = shared.value
        for batch in batches:
            h, v = textkit.columns(batch, "h", "v")
            who, where, which = [], [], []
            for i, q in enumerate(_matrix(v)):
                own: dict[int, list[int]] = {}
                for leaf in tree.value.visits(q, need):
                    for g in range(start[leaf], start[leaf] + many[leaf]):
                        own.setdefault(int(g), []).append(leaf)
                who += [i] * len(own)
                where += own.keys()
                which += own.values()
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), h.take(at), v.take(at), pa.array(which, pa.list_(pa.int32()))], ["g", "h", "v", "leaves"])

    def meet(key, left, right):
        q, x = left.combine_chunks(), right.combine_chunks()
        if not len(q) or not len(x):
            return pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qh, qv, lv = q.column("h").to_numpy(), _matrix(q.column("v").combine_chunks()), q.column("leaves").combine_chunks()
        xv, leaf, ids = _matrix(x.column("v").combine_chunks()), x.column("leaf").to_numpy(), x.column("ids").combine_chunks()
        id_from, id_all = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        open_from, open_all = lv.offsets.to_numpy() - lv.offsets[0].as_py(), lv.flatten().to_numpy()
        local = np.unique(leaf, return_inverse=True)
        out = []
        for lo in range(0, len(q), 256):
            hi = min(lo + 256, len(q))
            score = qv[lo:hi] @ xv.T
            seen = np.zeros((hi - lo, len(local[0])), bool)
            mine = np.repeat(np.arange(hi - lo), np.diff(open_from[lo : hi + 1]))
            to = np.searchsorted(local[0], opened := open_all[open_from[lo] : open_from[hi]])
            good = (to < len(local[0])) & (local[0][np.minimum(to, len(local[0]) - 1)] == opened)
            seen[mine[good], to[good]] = True
            score[~seen[:, local[1]]] = -np.inf
            # every point that may reach the (k + 1)th best, within what rounding can do to a product
            last = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)] if score.shape[1] > k else np.full(hi - lo, -np.inf)
            slack = 4 * np.finfo(float).eps * qv.shape[1] * np.abs(qv[lo:hi]).max(axis=1) * np.abs(xv).max() * qv.shape[1]
            row, col = np.nonzero((score >= (last - slack)[:, None]) & np.isfinite(score))
            exact = (qv[lo + row] * xv[col]).sum(axis=1)
            size = id_from[col + 1] - id_from[col]
            each = np.repeat(np.arange(len(row)), size)
            place = np.arange(len(each)) - np.repeat(textkit.exclusive(size), size) + np.repeat(id_from[col], size) - id_from[0]
            out.append((qh[lo + row[each]], id_all[place], exact[each]))
        cols = [np.concatenate(c) for c in zip(*out)]
        order = np.lexsort((cols[1], -cols[2], cols[0]))
        cols = [c[order] for c in cols]
        begin = np.maximum.accumulate(np.where(np.append(True, cols[0][1:] != cols[0][:-1]), np.arange(len(cols[0])), 0)) if len(cols[0]) else np.zeros(0, np.int64)
        keep = np.arange(len(cols[0])) - begin <= k
        return pa.table({"q": pa.array(cols[0][keep], pa.int64()), "vec_id": pa.array(cols[1][keep], pa.int64()), "score": pa.array(cols[2][keep], pa.float64())})

    data = placed.mapInArrow(textkit.tidied(to_group), "g long, h long, ids array<long>, v array<double>, leaf int")
    questions = placed.join(asked.select("h").distinct(), "h", "left_semi").select("h", "v").mapInArrow(textkit.tidied(ask), "g long, h long, v array<double>, leaves array<int>")
    questions = runtime.stored(questions, "questions")
    # a group is sent to as many blocks as the queries that ask for it fill
    blocks = runtime.stored(questions.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks")), "blocks")
    data = data.join(blocks, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    questions = questions.join(blocks, "g").withColumn("b", F.pmod(F.xxhash64(F.lit(9), "h"), F.col("blocks")).cast("int")).drop("blocks")
    found = questions.groupBy("g", "b").cogroup(data.groupBy("g", "b")).applyInArrow(meet, "q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    nearest = found.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    lists = asked.join(nearest, asked.h == nearest.q).select(F.col("vec_id").alias("query_id"), F.expr(f"slice(filter(near, x -> x.vec_id <> vec_id), 1, {k})").alias("near"))
    out = runtime.stored(lists.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")), "nearest")
    runtime.drop_stored(rows, placed, questions, blocks)
    return out


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return search(runtime.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
