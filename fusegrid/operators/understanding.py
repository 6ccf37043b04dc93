"""Query understanding: intent, component, attribute and context terms of natural-language requests, and their statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L
from fusegrid.functions import scalar as S


def process(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """The queries with intent, components, attributes, context and terms (all of them in this order)."""
    t = F.col(text_col)
    out = queries.withColumn("intent", S.intent(t)).withColumn("components", S.search_terms(t, L.COMPONENTS)).withColumn("attributes", S.search_terms(t, L.ATTRIBUTES))
    out = out.withColumn("context", S.context_words(t, F.col("components"), F.col("attributes")))
    return out.withColumn("terms", F.concat("components", "attributes", "context"))


def fulltext_query(terms):
    """One term as it is, several joined by OR."""
    return F.array_join(terms, " OR ")


def statements(queries: DataFrame, text_col: str = "text", id_col: str = "query_id") -> DataFrame:
    """(query, ord, statement, frequency, confidence): what the reasoner is told about each request."""
    t = F.col(text_col)
    found = S.search_terms(t, L.REASONER_COMPONENTS)
    base = queries.select(
        F.col(id_col),
        S.intent(t, L.REASONER_INTENTS).alias("intent"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("component"))).alias("cs"),
        S.search_terms(t, L.REASONER_ATTRIBUTES).alias("attrs"),
    )
    row = lambda text, confidence: F.struct(text.alias("statement"), F.lit(1.0).alias("frequency"), F.lit(confidence).alias("confidence"))
    one = F.array(row(F.concat(F.lit("<query --> ["), "intent", F.lit("]>")), 0.9))
    parts = F.flatten(F.transform("cs", lambda c: F.array(row(F.concat(F.lit("<"), c, F.lit(" --> component>")), 0.9), row(F.concat(F.lit("<query --> "), c, F.lit(">")), 0.8))))
    traits = F.transform("attrs", lambda a: row(F.concat(F.lit("<query --> ["), a, F.lit("]>")), 0.7))
    pairs = F.flatten(F.transform("cs", lambda c: F.transform("attrs", lambda a: row(F.concat(F.lit("<("), c, F.lit(" * "), a, F.lit(") --> has_attribute>")), 0.6))))
    return base.select(id_col, F.posexplode(F.concat(one, parts, traits, pairs)).alias("ord", "s")).select(id_col, "ord", "s.statement", "s.frequency", "s.confidence")


def terms_of_statements(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, terms): subjects but for "query", then bracketed attributes, statement by statement, first occurrences only."""
    subjects = F.filter(F.regexp_extract_all("statement", F.lit(r"<(\w+)\s*-->"), 1), lambda x: x != "query")
    traits = F.regexp_extract_all("statement", F.lit(r"\[(\w+)\]"), 1)
    each = rows.select(id_col, F.struct("ord", F.concat(subjects, traits).alias("found")).alias("o"))
    # a request has a few dozen statements at most
    grouped = each.groupBy(id_col).agg(F.array_sort(F.collect_list("o")).alias("all"))
    return grouped.select(id_col, F.array_distinct(F.flatten(F.transform("all", lambda o: o["found"]))).alias("terms"))
