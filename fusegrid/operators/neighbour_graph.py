"""Approximate nearest neighbours: a k-neighbour graph built by joining neighbours of neighbours (NN-descent), with its recall measured.

A point's neighbours are likely to be neighbours of each other. Each round, the points around a centre (its neighbours, and the points that
have it as one) are scored against each other, and each keeps the best it has seen; pairs of which neither is new since the centre's last round are left out.
A centre's group holds a bounded sample of its new neighbours and of those that point at it, so that a hub's group is no larger than another's.
Rounds end when few neighbours change. No vector comes to the driver; each round is written and read again.

A vector moves once for every group it is in. So the rounds work on unit vectors in whole steps of 1 / ``STEPS``, two bytes a component, whose products are exact;
of what they keep, all that may be among the k best, by the most that steps can change a score, is scored again on whole vectors. Groups without a pair to score do not move.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.functions import vectors as V
from fusegrid.functions.arrow import matrix, sorted_groups
from fusegrid.operators.vector_search import knn_join
from fusegrid.sources.io import materialize

#: Neighbours kept while the graph is built, and the sample of new, and of reverse, ones that a round joins.
WIDTH, SAMPLE = 30, 15
ROUNDS, STILL = 8, 0.02
#: Queries by which recall is measured.
MEASURED = 200
#: Steps from 0 to 1 in the components of the vectors that move.
STEPS = 32767


def _steps(unit: Column) -> Column:
    """A unit vector in whole steps; what is not a number is null, and so in no pair."""
    return F.transform(unit, lambda x: F.when(~F.isnan(x), F.rint(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * STEPS).cast("short")))


def _margin(size: int, digits: int) -> float:
    """How far two scores in steps may be apart when the whole vectors' rounded scores are in the other order, or equal."""
    r = 0.5 / STEPS * size**0.5
    return 2 * (2 * r + r * r) + 2 * 10.0**-digits


def _working(members: DataFrame) -> DataFrame:
    """(centre, id, fresh), each id once, of the groups that have a pair to score: two members, one of them new."""
    once = members.repartition("centre").groupBy("centre", "id").agg(F.max("fresh").alias("fresh"))
    group = Window.partitionBy("centre")
    return once.withColumns({"_any": F.max("fresh").over(group), "_n": F.count("*").over(group)}).where("_any and _n > 1").drop("_any", "_n")


def _score_groups(members: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """(src, dst, score): for each member of a centre's group its best in the group, where better than the worst it holds (``worst``, null: none yet)."""
    rows = members.join(points, "id").repartition("centre").sortWithinPartitions("centre").select("centre", "fresh", "id", "worst", "vector")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, group in sorted_groups(batches, ["centre"]):
            ids, fresh = group.column("id").to_numpy(), group.column("fresh").to_numpy()
            worst = group.column("worst").to_numpy()
            v = matrix(group.column("vector"))
            score = v @ v.T / STEPS**2  # products of whole numbers: the same in every group
            off = ~(fresh[:, None] | fresh[None, :]) | (ids[:, None] == ids[None, :])
            score[off] = -np.inf
            score[~(score > np.where(np.isnan(worst), -np.inf, worst)[:, None])] = -np.inf
            if len(ids) > width:  # no more than the graph can keep
                cut = np.partition(score, len(ids) - width, axis=1)[:, len(ids) - width]
                score[score < cut[:, None]] = -np.inf
            a, b = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(score[a, b])], ["src", "dst", "score"])

    return rows.mapInArrow(run, "src long, dst long, score double")


def _merged(found: DataFrame, width: int, graph: DataFrame | None = None, joined: DataFrame | None = None) -> DataFrame:
    """(src, dst, score, fresh, changed, place): the best ``width`` a point of the edges found and those of ``graph``, all of which move once, to their point.

    An edge that was there keeps its flag, but one that was joined this round is not new any more.
    """
    row = lambda df, score, fresh, was, done: df.select("src", "dst", F.expr(score).alias("score"), F.expr(fresh).alias("fresh"), F.lit(was).alias("was"), F.lit(done).alias("done"))
    rows = row(found, "score", "true", False, False)
    if graph is not None:
        rows = rows.union(row(graph, "score", "fresh", True, False)).union(row(joined, "cast(null as double)", "true", False, True))
    once = rows.repartition("src").groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"), F.max("was").alias("was"), F.max("done").alias("done"))
    best = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    kept = once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= width)
    return kept.select("src", "dst", "score", (F.col("fresh") & ~F.col("done")).alias("fresh"), (~F.col("was")).alias("changed"), "place")


def _sampled(edges: DataFrame, key: str, size: int, salt: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.xxhash64("src", "dst", F.lit(salt)), "src", "dst")
    return edges.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= size).drop("_k")


def _scored_again(graph: DataFrame, points: DataFrame, k: int, digits: int, margin: float) -> DataFrame:
    """(query_id, id, score, rank): the k best of a point's edges by the scores of the whole unit vectors."""
    least = graph.withColumn("_least", F.min(F.when(F.col("place") <= k, F.col("score"))).over(Window.partitionBy("src")))
    edges = least.where(F.col("score") >= F.col("_least") - margin).select("src", "dst")
    both = edges.join(points.select(F.col("id").alias("dst"), F.col("unit").alias("_b")), "dst").join(points.select(F.col("id").alias("src"), F.col("unit").alias("_a")), "src")
    scored = both.select(F.col("src").alias("query_id"), F.col("dst").alias("id"), (F.rint(V.dot(F.col("_a"), F.col("_b")) * 10.0**digits) / 10.0**digits).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def knn_graph(points: DataFrame, k: int, digits: int = 6, width: int | None = None, sample: int | None = None, rounds: int | None = None) -> DataFrame:
    """(query_id, id, score, rank, recall, scored_share): about the k nearest by cosine of every point.

    ``recall`` is measured against the exact join for up to ``MEASURED`` points in the order of a hash; ``scored_share`` is the share of all pairs that were scored, those scored twice counted twice.
    Null ids and vectors are left out, of a repeated id the vector that is first in order counts; ties go to the smaller id.
    """
    width, sample, rounds = width or WIDTH, sample or SAMPLE, rounds or ROUNDS
    width = max(width, k)
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    unit = F.transform("vector", lambda x: x / F.greatest(F.sqrt(length), F.lit(1e-300)))
    given = points.where("id is not null and vector is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("vector").alias("vector"))
    unit_points = materialize(given.withColumn("unit", unit).withColumn("steps", _steps(F.col("unit"))))
    n, size = unit_points.agg(F.count("*"), F.coalesce(F.max(F.size("unit")), F.lit(0))).first()
    pairs_of = F.sum(F.expr("new * (new - 1) / 2 + new * old"))

    def worked(members: DataFrame) -> float:
        sizes = members.groupBy("centre").agg(F.count_if("fresh").alias("new"), F.count_if(~F.col("fresh")).alias("old"))
        return sizes.agg(pairs_of).first()[0] or 0.0

    scored = 0.0
    # to begin with, chance neighbours: points dealt to buckets by hashes
    buckets = max(1, -(-n // (width + 1)))
    members = unit_points.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(buckets)).alias("b")) for s in range(2)])).alias("c"), "id")
    members = members.select((F.col("c.b") * 2 + F.col("c.s")).alias("centre"), "id", F.lit(True).alias("fresh"))
    state = unit_points.select("id", F.col("steps").alias("vector"), F.lit(None).cast("double").alias("worst"))
    scored += worked(members)
    graph = materialize(_merged(_score_groups(members, state, width), width))
    for number in range(rounds):
        joined = _sampled(graph.where("fresh"), "src", sample, number).select("src", "dst", "fresh")
        old = graph.where("not fresh").select("src", "dst", "fresh")
        reverse = _sampled(joined, "dst", sample, number + 100).union(_sampled(old, "dst", sample, number + 200))
        members = joined.union(old).select(F.col("src").alias("centre"), F.col("dst").alias("id"), "fresh").union(reverse.select(F.col("dst"), F.col("src"), "fresh"))
        members = materialize(_working(members))
        scored += worked(members)
        full = graph.groupBy("src").agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
        state = unit_points.select("id", F.col("steps").alias("vector")).join(full, F.col("id") == F.col("src"), "left").select("id", "vector", F.when(F.col("_n") >= width, F.col("_least")).alias("worst"))
        graph = materialize(_merged(_score_groups(members, state, width), width, graph, joined))
        if graph.where("changed").count() <= STILL * n * width:
            break
    near = materialize(_scored_again(graph, unit_points, k, digits, _margin(size, digits)))  # read for the recall and as the result
    asked = unit_points.orderBy(F.xxhash64("id"), "id").limit(MEASURED).select("id", "vector")
    truth = knn_join(unit_points.select("id", "vector"), asked, k, digits).select("query_id", "id")
    recall = truth.join(near.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left").agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]
    return near.withColumn("recall", F.lit(recall).cast("double")).withColumn("scored_share", F.lit(min(scored / (n * (n - 1) / 2), 9e9) if n > 1 else 0.0))
