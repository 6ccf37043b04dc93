"""Reasoning over (subject, copula, predicate, frequency, confidence) statements, and texts of reasoners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L
from fusegrid.sources.io import materialize

STATEMENT = "subject string, copula string, predicate string, frequency double, confidence double"


def knowledge_base(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.ontology(), STATEMENT)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.RULES, "premise string, conclusion string, rule_frequency double, rule_confidence double")


def close(statements: DataFrame, rounds: int | None = None) -> DataFrame:
    """(subject, predicate, frequency, confidence, depth) of all inheritance that deduction gives, or that ``rounds`` of it give.

    f = f1 f2 and c = f1 f2 c1 c2; of several proofs the surest stays, the shorter of equals. Each round takes only what the last one found one statement further: proofs that no other
    of the same conclusion equals or beats in both numbers, as either may give the surest in the end. It ends when there are none. A proof carries the stamps of the statements that it
    rests on and takes none of them twice. Rounds are written and read again.
    """
    base = statements.where("copula = '-->'").groupBy("subject", "predicate").agg(F.max(F.struct("confidence", "frequency")).alias("m")).select("subject", "predicate", "m.frequency", "m.confidence")
    base = materialize(base.withColumn("stamp", F.xxhash64("subject", "predicate")))
    step = base.select(F.col("subject").alias("via"), F.col("predicate").alias("next"), F.col("frequency").alias("f2"), F.col("confidence").alias("c2"), F.col("stamp").alias("s2"))
    known = base.select("subject", "predicate", "frequency", "confidence", F.lit(1).alias("depth"), F.array("stamp").alias("stamps"))
    fresh = known
    depth = 1
    while rounds is None or depth < rounds:
        depth += 1
        f = F.col("frequency") * F.col("f2")
        found = fresh.join(step, F.col("predicate") == F.col("via")).where((F.col("subject") != F.col("next")) & ~F.array_contains("stamps", F.col("s2")))
        found = found.select("subject", F.col("next").alias("predicate"), f.alias("frequency"), (f * F.col("confidence") * F.col("c2")).alias("confidence"), F.lit(depth).alias("depth"), F.array_append("stamps", F.col("s2")).alias("stamps"))
        better = Window.partitionBy("subject", "predicate").orderBy(F.desc("frequency"), F.desc("confidence"), "depth", "stamps").rowsBetween(Window.unboundedPreceding, -1)
        every = known.unionByName(found).withColumn("_c", F.max("confidence").over(better))
        known = materialize(every.where("_c is null or confidence > _c").drop("_c"))
        fresh = known.where(F.col("depth") == depth)
        if fresh.isEmpty():
            break
    top = F.max(F.struct("confidence", (-F.col("depth")).alias("d"), "frequency")).alias("m")
    return known.groupBy("subject", "predicate").agg(top).select("subject", "predicate", "m.frequency", "m.confidence", (-F.col("m.d")).alias("depth"))


def apply_rules(facts: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Conclusions of the rules whose premise a fact's predicate is."""
    f = F.col("frequency") * F.col("rule_frequency")
    joined = facts.join(F.broadcast(rule_table), facts["predicate"] == F.col("premise"))  # a handful of rules
    return joined.select("subject", F.col("conclusion").alias("predicate"), f.alias("frequency"), (f * F.col("confidence") * F.col("rule_confidence")).alias("confidence"))


def revise(evidence: DataFrame, keys=("statement",)) -> DataFrame:
    """One row a statement: frequencies weighed by evidence w = c / (1 - c); c = w / (w + 1) of the sum."""
    w = F.col("confidence") / (1 - F.col("confidence"))
    summed = evidence.groupBy(*keys).agg(F.sum(w * F.col("frequency")).alias("wf"), F.sum(w).alias("w"))
    return summed.select(*keys, (F.col("wf") / F.col("w")).alias("frequency"), (F.col("w") / (F.col("w") + 1)).alias("confidence"))


def parse_reasoner(outputs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, kind, statement, frequency, confidence) from answer lines, then derived lines; a bad number is 0."""
    kinds = L.REASONER_LINES
    parts = []
    for i, (kind, pattern) in enumerate(kinds.items()):
        groups = [F.regexp_extract_all(text_col, F.lit(pattern), g) for g in (1, 2, 3)]
        zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "sfc", strict=True)])
        rows = outputs.select(id_col, F.posexplode(zipped).alias("ord", "z"))
        value = lambda n: F.coalesce(F.col(f"z.{n}").try_cast("double"), F.lit(0.0))
        parts.append(rows.select(id_col, (F.lit(1000 * i) + F.col("ord")).alias("ord"), F.lit(kind).alias("kind"), F.col("z.s").alias("statement"), value("f").alias("frequency"), value("c").alias("confidence")))
    return parts[0].unionByName(parts[1]).where("statement <> ''")


#: What joins two terms of a statement; a private character stands for each while brackets are paired.
COPULAS = {"-->": "\ue000", "==>": "\ue001", "<->": "\ue002", "<=>": "\ue003"}


def _bracketed(depth: int) -> str:
    """A pattern of a text in angle brackets with others inside, down to a depth."""
    inside = "[^<>]"
    for _ in range(depth):
        inside = f"(?:[^<>]|<{inside}*>)"
    return f"<{inside}*>"


def parse_translation(outputs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, statement, frequency, confidence): the first statement of each line of a reply, ord the line's number.

    A statement is a pair of angle brackets with all that is in it (others down to three deep, and copulas), perhaps a full stop, and perhaps a truth value ``{f|c}``; without one it
    holds with frequency 1 and confidence 0.9. Lines of a comment (after // or #) say nothing.
    """
    line = F.col("_line")
    for sign, stand_in in COPULAS.items():
        line = F.replace(line, F.lit(sign), F.lit(stand_in))
    whole = f"({_bracketed(3)})" + r"[ \t]*\.?[ \t]*(?:\{[ \t]*(\d*\.?\d+)[ \t]*\|[ \t]*(\d*\.?\d+)[ \t]*\})?"
    rows = outputs.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("ord", "_line")).where(~F.col("_line").rlike(r"^\s*(//|#)")).withColumn("_l", line)
    statement = F.regexp_extract("_l", whole, 1)
    for sign, stand_in in COPULAS.items():
        statement = F.replace(statement, F.lit(stand_in), F.lit(sign))
    number = lambda i, otherwise: F.coalesce(F.regexp_extract("_l", whole, i).try_cast("double"), F.lit(otherwise))
    return rows.select(id_col, "ord", statement.alias("statement"), number(2, 1.0).alias("frequency"), number(3, 0.9).alias("confidence")).where("statement <> ''")


def parse_truth(text):
    """Struct (statement, frequency, confidence) of any of the three notations {f|c}, {f c} and %f;c%."""
    pattern = r"^(.*?)\.?\s*[{%]([\d.]+)[|;\s]+([\d.]+)[}%]\s*$"
    return F.struct(F.regexp_extract(text, pattern, 1).alias("statement"), F.regexp_extract(text, pattern, 2).try_cast("double").alias("frequency"), F.regexp_extract(text, pattern, 3).try_cast("double").alias("confidence"))


def humanize(text):
    """A statement in words, by the first of the known forms that it has."""
    out = text
    for pattern, words in reversed(L.STATEMENT_FORMS):
        first, between, last = words.split("{1}")[0], words.split("{1}")[1].split("{2}")[0], words.split("{2}")[1]
        said = F.concat(F.lit(first), F.regexp_extract(text, pattern, 1), F.lit(between), F.regexp_extract(text, pattern, 2), F.lit(last))
        out = F.when(text.rlike(pattern), said).otherwise(out)
    return out


def confidence_of(candidates: DataFrame, statements: DataFrame, otherwise: float = 0.5) -> DataFrame:
    """Candidates with ``narsese_confidence``: the largest of the statements whose text holds their category or name.

    Only distinct (query, category, name) meet the statements of their own query, by an equi join on the query,
    and the substring test filters inside it.
    """
    keys = candidates.select("query_id", "category", "name").distinct()
    met = keys.join(statements.select("query_id", "statement", "confidence"), "query_id").where(F.col("statement").contains(F.col("category")) | F.col("statement").contains(F.col("name")))
    top = met.groupBy("query_id", "category", "name").agg(F.max("confidence").alias("_c"))
    return candidates.join(top, ["query_id", "category", "name"], "left").withColumn("narsese_confidence", F.coalesce("_c", F.lit(otherwise))).drop("_c")
