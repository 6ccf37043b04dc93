"""Sources and sinks: registered tables, statement files, message envelopes, JSON rows with payloads, report files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.sources import schemas, views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; only a local master may leave that unset and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fusegrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> list[str]:
    """Temporary views of a data folder; what a graph's schema set-up is here."""
    for name in names:
        views.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return names


def unregister(spark: SparkSession, names: list[str] = TABLES) -> int:
    return sum(bool(spark.catalog.dropTempView(n)) for n in names)


def write_points(points: DataFrame, path: str, dim: int | None = None) -> None:
    """Vector points, a folder a collection, so that a search in one collection reads one folder."""
    out = check_dimension(points, dim) if dim else points
    out.write.partitionBy("collection").mode("overwrite").parquet(path)


def check_dimension(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The same rows; the job fails if any vector has another length."""
    size = F.size(vector)
    message = F.concat(F.lit(f"expected {dim} dimensions, got "), size.cast("string"))
    return points.withColumn(vector, F.when(size == dim, F.col(vector)).otherwise(F.raise_error(message).cast(points.schema[vector].dataType)))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a statement file without blank ones and comments."""
    return parse_statement_lines(spark.read.text(path))


def parse_statement_lines(lines: DataFrame) -> DataFrame:
    line = F.trim("value")
    kept = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("//"))
    number = lambda i: F.expr(f"try_cast(regexp_extract(line, '\\\\{{([0-9.]+)[|]([0-9.]+)\\\\}}', {i}) as double)")
    return kept.select(F.regexp_extract("line", r"^(.*?)\.?\s*(?:\{[^}]*\})?$", 1).alias("statement"), F.coalesce(number(1), F.lit(1.0)).alias("frequency"), F.coalesce(number(2), F.lit(0.9)).alias("confidence"))


def decode_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelope columns of JSON lines; a line that is no envelope becomes a row of type error."""
    parsed = F.from_json(column, schemas.MESSAGE)
    fine = parsed["id"].isNotNull() & parsed["type"].isNotNull()
    return lines.select(
        F.when(fine, parsed["id"]).alias("id"),
        F.when(fine, parsed["type"]).otherwise("error").alias("type"),
        F.when(fine, parsed["timestamp"]).alias("timestamp"),
        F.when(fine, parsed["payload"]).otherwise(F.col(column)).alias("payload"),
    )


def with_payload(rows: DataFrame, required: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows read from a store: those without a required key go, missing arrays are empty."""
    out = rows.dropna(subset=required)
    for name in arrays:
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def write_report(lines: DataFrame, path: str, by: str = "ord") -> None:
    """One text file of a report's ordered lines (a report is a few dozen rows)."""
    lines.orderBy(by).select("value").coalesce(1).write.mode("overwrite").text(path)
