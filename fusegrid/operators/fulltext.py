"""Full-text search: an inverted index as a table, BM25 scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Terms of queries that are broadcast at most.
BROADCAST_TERMS = 100_000


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, length) with terms of ASCII letters and digits, lower-cased."""
    terms = F.filter(F.split(F.lower(text_col), "[^a-z0-9]+"), lambda t: t != "")
    rows = docs.select(F.col(id_col).alias("id"), terms.alias("terms")).select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) for queries(query_id, term), terms joined by OR.

    The queries' terms filter the exploded terms before anything is grouped, so only postings that are asked for are shuffled; up to
    ``BROADCAST_TERMS`` of them (counted) are broadcast for it, more are joined by a shuffle. Lengths are counted without splitting.
    """
    asked = queries.select("query_id", "term").distinct()
    sought = asked.select("term").distinct()
    sought = F.broadcast(sought) if sought.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else sought
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    rows = low.select("id", "low", F.regexp_count("low", F.lit("[a-z0-9]+")).alias("length"))
    whole = rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    wanted = rows.select("id", "length", F.explode(F.split("low", "[^a-z0-9]+")).alias("term")).join(sought, "term", "left_semi")
    postings = wanted.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("mean")))
    scored = postings.join(df, "term").crossJoin(F.broadcast(whole)).select("term", "id", (idf * weight).alias("part"))  # one row of totals
    return asked.where("term <> ''").join(scored, "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
