"""Retrieval evaluation: precision, recall, F1, hallucination, percentiles, improvements, reports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.functions import scalar as S
from fusegrid.sources.io import materialize


def query_metrics(results: DataFrame, *keys: str) -> DataFrame:
    """From results(query_id, expected array, returned array, latency): hits count sets, denominators count list lengths."""
    hits = F.size(F.array_intersect("expected", "returned"))
    return counted_metrics(results.withColumns({"hits": hits, "returned": F.size("returned"), "expected": F.size("expected")}), *keys)


def counted_metrics(results: DataFrame, *keys: str) -> DataFrame:
    """The same from results(query_id, hits, returned, expected, latency) that are counts, where a list would grow with the data."""
    precision, recall = S.ratio(F.col("hits"), F.col("returned")), S.ratio(F.col("hits"), F.col("expected"))
    out = results.select(*keys, "query_id", precision.alias("precision"), recall.alias("recall"), F.when(F.col("returned") > 0, 1 - precision).otherwise(F.lit(0.0)).alias("hallucination"), "latency")
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def aggregate(metrics: DataFrame) -> DataFrame:
    """Means over queries and nearest-rank percentiles of latency; zeros without queries. The rows, one a query, are written once, as they are read several times."""
    metrics = materialize(metrics)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    means = metrics.agg(F.count("*").alias("queries"), *[mean(c) for c in ("precision", "recall", "f1", "hallucination", "latency")])
    ranks = nearest_rank_percentiles(metrics, "latency", [])
    return means.crossJoin(ranks.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ranks.columns if c != "n"]))  # one row each


def nearest_rank_percentiles(df: DataFrame, column: str, groups: list[str], shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """(groups, n, p50, p95, p99): the value whose place in its group's order is round(share (n - 1)); nulls are left out.

    Counts a distinct value come first, then counts a bucket of a hundredth of the logarithm: at most some 142,000 buckets a group
    whatever its size. Only the buckets that hold a place sought are put in order inside.
    """
    value = F.col(column).cast("double")
    bucket = F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise((F.signum(value) * F.floor(F.log1p(F.abs(value)) * 100)).cast("long"))
    counted = df.where(F.col(column).isNotNull()).groupBy(*groups, bucket.alias("_b"), F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*groups)
    buckets = counted.groupBy(*groups, "_b").agg(F.sum("_c").alias("_in"))
    buckets = buckets.withColumn("_before", F.sum("_in").over(own.orderBy("_b")) - F.col("_in")).withColumn("_n", F.sum("_in").over(own))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.round(F.lit(s) * (F.col("_n") - 1)) - F.col("_before")).alias("at")) for i, s in enumerate(shares)])
    sought = buckets.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_b").alias("_at"), "_n", "_in", F.explode(places).alias("_p")).where("_p.at >= 0 and _p.at < _in")
    inside = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*groups, "_b").orderBy("_v")))
    same = F.col("_b") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    found = inside.join(sought, same).where(F.col("_upto") > F.col("_p.at"))
    return found.groupBy(*groups).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_p.i") == i, F.col("_v"))).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def improvements(systems: DataFrame, base: str, new: str, columns: dict[str, int]) -> DataFrame:
    """One row of percentages of a system against another; columns maps a name to its sign (-1 where less is better)."""
    a = systems.where(F.col("system") == base).select(*[F.col(c).alias(f"a_{c}") for c in columns])
    b = systems.where(F.col("system") == new).select(*[F.col(c).alias(f"b_{c}") for c in columns])
    return a.crossJoin(b).select(*[(sign * S.improvement_percent(F.col(f"a_{c}"), F.col(f"b_{c}"))).alias(c) for c, sign in columns.items()])  # one row each


def report_lines(summary: DataFrame, title: str) -> DataFrame:
    """(ord, value) lines of a Markdown report of one summary row."""
    head = [F.lit(f"# {title}"), F.lit(""), F.lit("| metric | value |"), F.lit("|---|---|")]
    body = [F.concat(F.lit(f"| {c} | "), text, F.lit(" |")) for c, text in _numbers(summary)]
    return summary.select(F.posexplode(F.array(*head, *body)).alias("ord", "value"))


def _numbers(summary: DataFrame) -> list[tuple[str, Column]]:
    """Names and texts of four digits of a summary's numbers."""
    return [(c, F.format_string("%.4f", F.col(c).cast("double"))) for c, t in summary.dtypes if t in ("double", "bigint", "int")]


def report_json(summary: DataFrame, title: str) -> DataFrame:
    """(value): one JSON object a summary row, with the title and the metrics by name."""
    return summary.select(F.to_json(F.struct(F.lit(title).alias("title"), F.struct(*[c for c, _ in _numbers(summary)]).alias("metrics"))).alias("value"))


def report_html(summary: DataFrame, title: str) -> DataFrame:
    """(value): one HTML table a summary row."""
    rows = [F.concat(F.lit(f"<tr><td>{c}</td><td>"), text, F.lit("</td></tr>")) for c, text in _numbers(summary)]
    head = "<table><caption>" + html.escape(title) + "</caption><tr><th>metric</th><th>value</th></tr>"
    return summary.select(F.concat(F.lit(head), *rows, F.lit("</table>")).alias("value"))
