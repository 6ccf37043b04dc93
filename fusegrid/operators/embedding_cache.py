"""Embeddings by content: a table of (digest, embedding) from which known texts are taken, and to which only the others are computed and added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.functions import vectors as V

ROWS = "digest string, embedding array<double>"


class EmbeddingCache:
    """A folder of batches; a batch that breaks off has no ``_SUCCESS`` and is not read, and is written over when it comes again."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column] | None = None, model: str = "hash-1536"):
        self.spark, self.folder, self.embed, self.model = spark, f"{folder.rstrip('/')}/model={model}", embed or V.hash_embedding, model

    def _batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/_SUCCESS")) or []
        return sorted(f.getPath().getParent().toString() for f in found)

    def read(self, but: int | None = None) -> DataFrame:
        paths = [p for p in self._batches() if not p.endswith(f"/batch={but}")]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def get_or_compute(self, texts: DataFrame, batch: int, id_col: str = "id", text_col: str = "text", want: list[Column] | None = None) -> tuple[DataFrame, dict[str, int]]:
        """(id, digest, embedding) for every row, and counts: texts, distinct, hits (distinct texts that were held) and misses (computed now).

        A null text counts as an empty one; rows with one text share one embedding; the batch's number makes a repetition harmless.
        ``want``: columns made of ``embedding`` that take its place; they are made where the table is read, so that no whole embedding moves.
        """
        asked = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("digest", F.sha2("_text", 256))
        held = self.read(but=batch).select("digest")
        missing = asked.join(held, "digest", "left_anti").groupBy("digest").agg(F.first("_text").alias("_text"))
        missing.select("digest", self.embed(F.col("_text")).cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        new = self.spark.read.schema(ROWS).parquet(f"{self.folder}/batch={batch}").count()
        sizes = asked.agg(F.count("*").alias("texts"), F.countDistinct("digest").alias("distinct")).first()
        counts = {"texts": sizes["texts"], "distinct": sizes["distinct"], "hits": sizes["distinct"] - new, "misses": new}
        held = self.read().select("digest", *(want or ["embedding"]))
        return asked.select("id", "digest").join(held, "digest").select("id", *held.columns), counts
