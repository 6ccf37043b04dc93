"""Hybrid retrieval: vector, full-text and graph candidates of many queries in one plan, weighed, scored, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.functions import scalar as S

WEIGHTS = {"vector": 0.4, "fulltext": 0.3, "graph": 0.3}
ORDER = {"vector": 0, "fulltext": 1, "graph": 2}
COLUMNS = ["query_id", "element_id", "name", "category", "similarity", "graph_degree", "source"]


def tag_match(wanted, tags):
    """Whether any wanted word and any tag hold one another, without regard to case."""
    return F.exists(wanted, lambda a: F.exists(tags, lambda t: F.contains(F.lower(t), F.lower(a)) | F.contains(F.lower(a), F.lower(t))))


def graph_candidates(queries: DataFrame, elements: DataFrame, degrees: DataFrame, most: int = 10) -> DataFrame:
    """Elements of the wanted categories: queries(query_id, categories, attributes); degrees by one left join."""
    asked = queries.select("query_id", "attributes", F.posexplode("categories").alias("ord", "category"))
    found = asked.join(elements, "category").where((F.size("attributes") == 0) | tag_match(F.col("attributes"), F.col("tags")))
    first = Window.partitionBy("query_id").orderBy("ord", "name", "element_id")
    kept = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    joined = kept.join(degrees.hint("merge"), kept["element_id"] == degrees["id"], "left")  # a row an element: not sent through the driver
    degree = S.degree_score(F.coalesce("degree", F.lit(0)))
    return joined.select("query_id", "element_id", "name", "category", F.lit(0.8).alias("similarity"), degree.alias("graph_degree"), F.lit("graph").alias("source"))


def fulltext_candidates(queries: DataFrame, elements: DataFrame, most: int = 10) -> DataFrame:
    """Elements by the number of wanted terms in their name: queries(query_id, terms)."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    words = elements.select("element_id", "name", "category", F.explode(F.array_distinct("tags")).alias("term"))
    hits = asked.join(words, "term").groupBy("query_id", "element_id", "name", "category").agg(F.count("*").cast("double").alias("similarity"))
    first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "element_id")
    kept = hits.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return kept.select("query_id", "element_id", "name", "category", "similarity", F.lit(0.0).alias("graph_degree"), F.lit("fulltext").alias("source"))


def scored_candidates(scores: DataFrame, elements: DataFrame, source: str, most: int = 10) -> DataFrame:
    """The best elements of each query from rows (query_id, id, score) of a search."""
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kept = scores.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    joined = kept.join(elements, kept["id"] == elements["element_id"])
    return joined.select("query_id", "element_id", "name", "category", F.col("score").alias("similarity"), F.lit(0.0).alias("graph_degree"), F.lit(source).alias("source"))


def vector_candidates(neighbours: DataFrame, elements: DataFrame) -> DataFrame:
    """From rows (query_id, id, score) of a vector search."""
    joined = neighbours.join(elements.hint("merge"), neighbours["id"] == elements["element_id"])  # the same
    return joined.select("query_id", "element_id", "name", "category", F.col("score").alias("similarity"), F.lit(0.0).alias("graph_degree"), F.lit("vector").alias("source"))


def weigh(candidates: DataFrame) -> DataFrame:
    w = None
    for source, value in WEIGHTS.items():
        w = F.when(F.col("source") == source, value) if w is None else w.when(F.col("source") == source, value)
    return candidates.withColumn("similarity", F.col("similarity") * w)


def rank(candidates: DataFrame) -> DataFrame:
    """With final_score of narsese_confidence, similarity and graph_degree."""
    return candidates.withColumn("final_score", S.final_score(F.col("narsese_confidence"), F.col("similarity"), F.col("graph_degree")))


def source_order():
    return F.try_element_at(F.create_map(*[F.lit(x) for p in ORDER.items() for x in p]), F.col("source"))


def dedup(ranked: DataFrame, id_col: str = "element_id", group: str = "query_id") -> DataFrame:
    """Max fusion: of rows of one element the best stays, with its own source's fields."""
    best = Window.partitionBy(group, id_col).orderBy(F.desc("final_score"), source_order())
    return ranked.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def top(ranked: DataFrame, k: int = 10, group: str = "query_id", id_col: str = "element_id") -> DataFrame:
    best = Window.partitionBy(group).orderBy(F.desc("final_score"), id_col)
    return ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def include(rows: DataFrame, switches: dict[str, str]) -> DataFrame:
    """The rows with each column of ``switches`` only where its boolean column is true, else null."""
    return rows.withColumns({c: F.when(F.col(flag), F.col(c)) for c, flag in switches.items()})
