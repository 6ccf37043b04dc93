"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every vector is dealt to a leaf. A query pops nodes from a priority queue by
the inner product with their centres and lists leaves in that order. How many leaves to visit is calibrated: visits are widened until
the recall of calibration queries against exact search over all rows reaches the goal. Leaves are cut into blocks of a bounded number of rows,
so that a leaf of any size (one vector repeated, say) is spread over tasks; queries meet blocks in joins by leaf, and
each block gives those of its best k that are not below the query's k-th product with a sample's rows in the leaves it visits: the
k nearest found all reach that bound, since those rows are among the found.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components take no part;
ties go to the smaller id; all rows with the query's own id are left out; a repeated query id is one query; fewer than k other
rows are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.llm.common import materialize, shuffle_partitions

#: Rows that the tree is fitted on, calibration queries, and the recall asked of them.
SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 300
RECALL_GOAL = 0.94
BRANCH = 16
LEAF_ROWS = 400
MOST_LEAVES = 4000
BLOCK_ROWS = 2048
QUERY_ROWS = 1024


@dataclass
class Tree:
    """Nodes in arrays: centres, children (empty for a leaf), number of the leaf (-1 inside)."""

    centers: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going down to the nearest centre."""
        out = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            pick = _nearest(vectors[rows], self.centers[kids])
            stack += [(kid, rows[pick == k]) for k, kid in enumerate(kids)]
        return out

    def visit(self, query: np.ndarray, counts: np.ndarray, leaves: int, least: int) -> list[int]:
        """Leaves best bin first: so many that hold rows, and on until ``least`` rows are seen."""
        near = self.centers @ query
        heap, out, rows = [(-np.inf, 0)], [], 0
        while heap and (len(out) < leaves or rows < least):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                if counts[self.leaf[node]]:
                    out.append(self.leaf[node])
                    rows += int(counts[self.leaf[node]])
            else:
                for kid in self.children[node]:
                    heapq.heappush(heap, (-near[kid], kid))
        return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1) - 2 * x @ centers.T, axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers, _nearest(x, centers)


def fit_tree(sample: np.ndarray, leaf_rows: int, branch: int = BRANCH) -> Tree:
    """A tree whose leaves hold about ``leaf_rows`` sample rows."""
    rng = np.random.default_rng(5)
    centers, children, leaf = [sample.mean(0)], [[]], [-1]
    stack, leaves = [(0, sample)], 0
    while stack:
        node, rows = stack.pop()
        kinds = len(np.unique(rows[:: max(1, len(rows) // 500)], axis=0))
        k = min(branch, -(-len(rows) // leaf_rows), kinds)
        if k >= 2:
            found, own = _k_means(rows, k, rng)
            parts = [(found[j], rows[own == j]) for j in range(k) if (own == j).any()]
        if k < 2 or len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for center, part in parts:
            children[node].append(len(centers))
            stack.append((len(centers), part))
            centers.append(center)
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centers), children, leaf)


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part; of the given length, or else of the commonest."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine & F.col("vec_id").isNotNull())
    if length is None:
        size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = size["d"] if size else 0
    return rows.where(F.size("v") == length)


def bounds(queries: np.ndarray, query_ids: np.ndarray, visits: list[list[int]], sample: np.ndarray, sample_ids: np.ndarray, sample_leaf: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that the k-th row found reaches at least: its k-th product with the sample's rows in the leaves that it visits, less the room for rounding."""
    out = np.full(len(queries), -np.inf)
    if len(sample) < k:
        return out
    for at in range(0, len(queries), 64):
        about = queries[at : at + 64] @ sample.T
        room = 1e-9 * (1 + np.abs(about).max(initial=0))
        seen = np.zeros((len(about), int(sample_leaf.max()) + 1), bool)
        for own, leaves in zip(seen, visits[at : at + 64], strict=True):
            own[[x for x in leaves if x < len(own)]] = True
        about[~seen[:, sample_leaf] | (query_ids[at : at + 64, None] == sample_ids[None, :])] = -np.inf
        out[at : at + 64] = np.partition(about, len(sample) - k, axis=1)[:, len(sample) - k] - room
    return out


def best(queries: np.ndarray, query_ids, vectors: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None):
    """Rows (query_id, vec_id, score): for each query its k largest inner products, ties to smaller ids; none below ``least``.

    A fast product picks candidates with room for its rounding; scores are sums in one fixed order,
    so that equal vectors score equally in every block.
    """
    out_q, out_v, out_s = [], [], []
    about = queries @ vectors.T
    room = 1e-9 * (1 + np.abs(about).max(initial=0))
    for j, q in enumerate(query_ids):
        row = np.where(ids == q, -np.inf, about[j])
        n = min(k, int((ids != q).sum()))
        if not n:
            continue
        floor = np.partition(row, len(row) - n)[len(row) - n] - room
        some = np.flatnonzero(row >= (floor if least is None else max(floor, least[j])))
        exact = (vectors[some] * queries[j]).sum(1)
        order = np.lexsort((ids[some], -exact))[:n]
        out_q += [q] * len(order)
        out_v += ids[some][order].tolist()
        out_s += exact[order].tolist()
    return out_q, out_v, out_s


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)


def _exact(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries over all rows, in blocks."""
    ids, matrix = [q for q, _ in queries], np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                own = batch.column("vec_id").to_numpy()
                q, v, s = best(matrix, ids, _matrix(batch.column("v")), own, k)
                leaf_of = dict(zip(own.tolist(), batch.column("leaf").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()), pa.array([leaf_of[x] for x in v], pa.int32())], ["query_id", "vec_id", "score", "leaf"])

    return _top(rows.mapInArrow(run, "query_id long, vec_id long, score double, leaf int"), k)


def calibrate(tree: Tree, counts: np.ndarray, rows: DataFrame, k: int, goal: float) -> int:
    """How many leaves to visit: widened by a sixteenth at a time until the goal is reached."""
    some = [(r["vec_id"], r["v"]) for r in rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION_QUERIES).collect()]
    some = list({q: (q, v) for q, v in some}.values())
    true = _exact(rows, some, k).select("query_id", "leaf").collect()  # k rows a calibration query
    place = {q: {leaf: n for n, leaf in enumerate(tree.visit(np.array(v), counts, tree.leaves, 0))} for q, v in some}
    at = np.sort([place[r["query_id"]][r["leaf"]] for r in true])
    if not len(at):
        return tree.leaves
    visits = 1
    while visits < tree.leaves and np.searchsorted(at, visits) < goal * len(at):
        visits += max(1, visits // 16)
    return visits


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", goal: float = RECALL_GOAL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all rows of ``vectors``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = usable(vectors, id_col, vector_col)
    total = base.count()
    if not total:
        return empty
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()  # bounded by the limit
    x = np.concatenate([_matrix(c) for c in sample.column("v").chunks])
    leaves = max(1, min(MOST_LEAVES, total // LEAF_ROWS))
    tree = fit_tree(x, max(2, len(x) // leaves))

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["vec_id", "v", "leaf"])

    rows = materialize(base.mapInArrow(deal, "vec_id long, v array<double>, leaf int"))
    counted = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # a row a leaf, at most a few times MOST_LEAVES
    counts = np.array([counted.get(i, 0) for i in range(tree.leaves)])
    visits = calibrate(tree, counts, rows, k, goal)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()  # bounded by the limit
    x, x_ids, x_leaf = np.concatenate([_matrix(c) for c in some.column("v").chunks]), some.column("vec_id").to_numpy(), some.column("leaf").to_numpy()

    def plan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = _matrix(batch.column("v"))
            lists = [tree.visit(v, counts, visits, k + own) for v, own in zip(vectors, batch.column("own").to_pylist(), strict=True)]  # rows of its own id are no candidates
            least = bounds(vectors, batch.column("vec_id").to_numpy(), lists, x, x_ids, x_leaf, k) if batch.num_rows else np.zeros(0)
            of = [i for i, own in enumerate(lists) for _ in own]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(of, pa.int64())), batch.column("v").take(pa.array(of, pa.int64())), pa.array([leaf for own in lists for leaf in own], pa.int32()), pa.array(least[of] if of else [], pa.float64())], ["query_id", "q", "leaf", "least"])

    # dealt by another key than that of the distinct ids, so that planning has many tasks
    asking = usable(queries, id_col, vector_col, x.shape[1]).groupBy("vec_id").agg(F.min("v").alias("v"))  # of a repeated id the vector that is first in order asks
    sizes = rows.groupBy("vec_id").count().where("count > 1").select("vec_id", F.col("count").alias("own"))
    wanted = asking.join(sizes, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own")).repartition(shuffle_partitions(spark), F.xxhash64("vec_id", F.lit(2)))
    asked = materialize(wanted.mapInArrow(plan, "query_id long, q array<double>, leaf int, least double"))
    load = asked.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("parts"))
    # a row a leaf
    cut = F.broadcast(load.join(rows.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "leaf"))
    left = asked.join(cut, "leaf").select("query_id", "q", "least", "leaf", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.join(cut, "leaf").select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def meet(asking, held):
        import pandas as pd

        if not len(asking) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, s = best(np.stack(asking["q"].to_numpy()), asking["query_id"].tolist(), np.stack(held["v"].to_numpy()), held["vec_id"].to_numpy(), k, asking["least"].to_numpy())
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    keys = ["leaf", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
