"""A corpus pipeline of five stages; each takes and returns documents, but for the last, which returns their tokens.

Toxic documents go; lines in ten or more documents go; of each group of near copies the document with the
smallest id stays; sources are mixed to their weights, a document once for each time that the mix takes it, the one at
a source's cut with only the words before the cut; the texts are encoded and decoded.

Defined results: texts that a stage changes get their own n_chars; null texts become empty in line dedup; rows with a null id pass toxicity, line dedup and
the join; of the rows of one id that the join keeps, which it takes for one document, the first by text stays, null texts last; documents without words are in no mix; empty documents give an empty result at every stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusegrid.llm import line_dedup, mixing, ngram_join, piece_bpe, toxicity
from fusegrid.llm.common import WORD, materialize, slices, table

TOXIC_FROM = 0.3


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"), 4, 2))
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels), TOXIC_FROM)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(docs, line_dedup.build_state(docs, min_docs=10, min_chars=1))
    return _with_text(out.drop("text").withColumnRenamed("kept_text", "text"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.jaccard_components(docs)
    stay = materialize(groups.where("component_id = doc_id").select("doc_id").distinct())
    kept = docs.join(F.broadcast(stay) if stay.count() <= ngram_join.BROADCAST_ROWS else stay, "doc_id", "left_semi")
    repeated = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():  # an id with several texts is one document: its first text that is not null stays
        kept = materialize(kept)
        first = kept.join(repeated, "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), "text", F.to_json(F.struct(*docs.columns)))))
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(first.where("_n = 1").select(*kept.columns))
    return kept.unionByName(docs.where("doc_id is null").select(*kept.columns)).select(*docs.columns)


def _cut(batches: Iterator) -> Iterator:
    """Texts up to the word at which the mix stops."""
    import pyarrow as pa

    word = re.compile(WORD)
    for batch in slices(batches):
        texts = []
        for text, n in zip(batch.column("text").to_pylist(), batch.column("_words").to_pylist(), strict=True):
            last = next(islice(word.finditer(text), n - 1, None), None)
            texts.append(text[: last.end()] if last else text)
        cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    # the mix is planned on sizes alone; texts meet the plan once
    plan = mixing.mix(numbered.withColumnRenamed("_row", "row_of_mix"), keep=["row_of_mix"])
    taken = materialize(plan.where("taken > 0").select(F.col("row_of_mix").alias("_row"), F.floor(F.col("taken") / F.col("size")).cast("int").alias("_times"), (F.col("taken") % F.col("size")).alias("_words")))
    mixed = numbered.join(taken, "_row")
    whole = mixed.where("_times > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
    part = mixed.where("_words > 0").select(*docs.columns, "_words")
    return whole.unionByName(_with_text(part.mapInArrow(_cut, part.schema), docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.digests(piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: The first stage learns a model, so SQL cannot express the whole; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
