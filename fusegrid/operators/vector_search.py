"""Vector search: filtered top-k by metric, per collection and merged, batched queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.functions import vectors as V
from fusegrid.functions.arrow import matrix

#: About so many rows of queries, and so many of points, meet in one task at once, or more, up to so many values of vectors, where there are enough tasks;
#: and so many queries are scored together there.
BLOCK_ROWS, BLOCK_VALUES, SCORED_ROWS = 4096, 1 << 21, 256
#: Enough tasks.
MEETINGS = 36
METRICS = {"cosine": (V.cosine, True), "dot": (V.dot, True), "euclid": (V.euclid, False), "manhattan": (V.manhattan, False)}


def search_filter(category=None, design_system=None, min_confidence=None, collection=None, tags: list[str] | None = None) -> list[Column]:
    """Predicates that must all hold; every one reaches the scan."""
    out = [F.col(name) == F.lit(v) for name, v in (("category", category), ("design_system", design_system), ("collection", collection)) if v is not None]
    if min_confidence is not None:
        out.append(F.col("confidence") >= F.lit(min_confidence))
    return out + [F.array_contains("tags", t) for t in tags or ()]


def top_k(points: DataFrame, query: list[float], k: int, metric: str = "cosine", where: list[Column] = (), digits: int = 6) -> DataFrame:
    """The k best points of one query; TakeOrderedAndProject keeps k rows a task."""
    measure, descending = METRICS[metric]
    for condition in where:
        points = points.where(condition)
    scored = points.withColumn("score", F.round(measure(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), digits))
    return scored.orderBy(F.desc("score") if descending else F.asc("score"), "id").limit(k)


def top_k_per_collection(points: DataFrame, query: list[float], k: int, digits: int = 6) -> DataFrame:
    """k of each collection, merged to k: the same as k over all, and what a store of collections does."""
    scored = points.withColumn("score", F.round(V.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), digits))
    each = Window.partitionBy("collection").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(each)).where(F.col("place") <= k).orderBy(F.desc("score"), "id").limit(k)


def knn_join(points: DataFrame, queries: DataFrame, k: int, digits: int = 6, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours of each query among all points.

    Queries and points are dealt to blocks by a hash of the id, and each block of queries meets each block of points in a task of its own, which gives
    the k best a query; a window keeps the k best of these. No vector comes to the driver. All pairs are scored, and a vector moves once for every block
    of the other side: so blocks are as large as a task's memory allows, once there is work for ``MEETINGS`` tasks.
    """
    n_queries, n_points = blocks(*(df.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first() for df in (queries, points)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of its own, as queries are often rows of the points themselves
    asked = queries.select(F.col("id").alias("id"), F.col("vector").alias("vector"), block(n_queries).alias("q"), every(n_points).alias("p")).groupBy("q", "p")
    held = points.select("id", "vector", block(n_points).alias("p"), every(n_queries).alias("q")).groupBy("q", "p")

    def meet(left, right):
        return _best(left, right, k, digits, exclude_self)

    found = asked.cogroup(held).applyInArrow(meet, "query_id long, id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def blocks(queries: tuple[int, int], points: tuple[int, int]) -> tuple[int, int]:
    """Numbers of blocks of queries and of points, from rows and vector length of each."""
    least = [-(-rows // max(1, BLOCK_VALUES // max(size, 1))) for rows, size in (queries, points)]
    fine = [max(1, -(-rows // BLOCK_ROWS)) for rows, _ in (queries, points)]
    n_queries = max(least[0], min(fine[0], int(MEETINGS**0.5)))
    return n_queries, max(least[1], min(fine[1], -(-MEETINGS // n_queries)))


def _unit(vectors):
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.min_max(pc.list_value_length(vectors)).as_py()
    if vectors.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("vectors must be there and of one length")
    v = matrix(vectors)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)


def _best(queries, points, k: int, digits: int, exclude_self: bool):
    """The k best points of a block for each query of a block, as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    q, x, s = [], [], []
    if queries.num_rows and points.num_rows:
        ids, own = queries.column("id").to_numpy(), points.column("id").to_numpy()
        asked, v = _unit(queries.column("vector")), _unit(points.column("vector"))
        for at in range(0, len(ids), SCORED_ROWS):
            some = ids[at : at + SCORED_ROWS]
            score = np.round(asked[at : at + SCORED_ROWS] @ v.T, digits)
            if exclude_self:
                score[some[:, None] == own[None, :]] = -np.inf
            for j in range(len(some)):
                row = score[j]
                best = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))  # all that tie with the last
                best = best[np.lexsort((own[best], -row[best]))][:k]
                best = best[row[best] > -np.inf]
                q += [some[j]] * len(best)
                x += own[best].tolist()
                s += score[j][best].tolist()
    return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(x, pa.int64()), "score": pa.array(s, pa.float64())})


def collection_info(points: DataFrame) -> DataFrame:
    return points.groupBy("collection").agg(F.count("*").alias("points"))


def delete_points(points: DataFrame, gone: DataFrame) -> tuple[DataFrame, int]:
    """Points without the ids of ``gone``, and how many ids were asked for (not how many were found)."""
    return points.join(gone.select("id").distinct(), "id", "left_anti"), gone.count()
