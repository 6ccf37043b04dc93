"""Property-graph operators: upserts and deletes as DataFrame to DataFrame, neighbours, degrees, counts, k-hop expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, created: str | None = None) -> DataFrame:
    """MERGE by key: new rows win, of several the last in the order of their JSON text; the first creation time stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    own = Window.partitionBy(key)
    if created:
        both = both.withColumn(created, F.min(created).over(own))
    return both.withColumn("_n", F.row_number().over(own.orderBy(F.desc("_new"), F.desc(F.to_json(F.struct(*old.columns)))))).where("_n = 1").drop("_n", "_new")


def upsert_edges(old: DataFrame, new: DataFrame, keys=("src", "dst", "rel_type")) -> DataFrame:
    """MERGE of edges: one row a key, the new one's properties win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_new", *others)).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in others])


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids of ``gone`` (a column of the key's name)."""
    ids = gone.select(F.col(key).alias("_id")).distinct()
    left = edges.join(ids, edges["src"] == F.col("_id"), "left_anti").join(ids, F.col("dst") == F.col("_id"), "left_anti")
    return nodes.join(ids, F.col(key) == F.col("_id"), "left_anti"), left


def delete_edges(edges: DataFrame, gone: DataFrame, keys=("src", "dst", "rel_type")) -> DataFrame:
    """Edges, or stars of hyperedges, without those of the same keys in ``gone``, which may be as many."""
    return edges.join(gone.select(*keys).distinct().hint("merge"), list(keys), "left_anti")


def orphans(membership: DataFrame, group: str, member: str, gone: DataFrame) -> DataFrame:
    """Members of the groups in ``gone`` that no other group has."""
    inside = membership.join(gone.select(group).distinct(), group, "left_semi").select(member).distinct()
    outside = membership.join(gone.select(group).distinct(), group, "left_anti").select(member)
    return inside.join(outside, member, "left_anti")


def link_by_name(nodes: DataFrame, names: DataFrame, rel_type: str) -> DataFrame:
    """Edges from nodes to the systems that exist: names(name)."""
    known = names.select(F.col("name").alias("_name"))
    return nodes.join(known, F.col("design_system") == F.col("_name")).select(F.col("element_id").alias("src"), F.col("_name").alias("dst"), F.lit(rel_type).alias("rel_type"))


def membership_edges(groups: DataFrame, members: DataFrame, group: str, ids: str, member: str) -> DataFrame:
    """(group, member) edges of an array column of ids; an edge needs both its ends to exist."""
    pairs = groups.select(group, F.explode(ids).alias(member)).distinct()
    return pairs.join(members.select(member), member, "left_semi").select(group, member)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row with a map of value to count; for columns of few values."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n"))))
    return count_by(df, column).agg(entries.alias("counts"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows of a page; page 0 counts as 1."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def neighbours(edges: DataFrame, nodes: DataFrame, source, key: str) -> DataFrame:
    return edges.where(F.col("src") == F.lit(source)).join(nodes, F.col("dst") == F.col(key))


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree over all edges given; one partial aggregation after the explode."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n"))


def count_labels(frames: dict[str, DataFrame]) -> DataFrame:
    """label, n of the non-empty ones."""
    out = None
    for label, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def statistics(nodes: DataFrame, edges: DataFrame, count: Column | None = None) -> DataFrame:
    """nodes, relationships, avg_degree = 2 E / N (0 without nodes): two scalar aggregates, one row. ``count``: what counts the edges, if not their rows."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg((F.count("*") if count is None else count).alias("relationships"))
    degree = F.when(F.col("nodes") > 0, F.lit(2.0) * F.col("relationships") / F.col("nodes")).otherwise(F.lit(0.0))
    return n.crossJoin(e).select("nodes", "relationships", degree.alias("avg_degree"))  # of one row each


def k_hop(edges: DataFrame, sources: DataFrame, hops: int, stop: Column | None = None) -> DataFrame:
    """(source, id, hop) with the least hop from 1 to ``hops``; the source itself is not listed.

    One join a hop; ids seen before leave by an anti join, so the frontier never goes back.
    """
    links = edges.select("src", "dst").distinct()
    seen = sources.select(F.col("id").alias("source"), F.col("id"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        near = frontier.join(links, frontier["id"] == links["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = near.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")
