"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters on the normalised bytes, sorted within
partitions by Spark's external sort in the order of their bytes, and compared with their neighbour in full. A splitter
holds a bounded beginning of the bytes, then the digest, the id and the row's number, so that splitters stay
small however long the texts are, and a group of copies of any size, even of one id, is cut between partitions. Texts that
share the whole beginning of a splitter go to one side of it by their digests. So only the runs with the least and the
largest (beginning, digest) of a partition can go on in another: these are joined by digest and length, two rows a partition.

Defined results: null text counts as empty; a null id sorts first and so is the smallest;
repeated rows (same id, same text) are rows of their own, of which the first is kept; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.llm.common import SPACE_RUN, materialize, shuffle_partitions, slices

PREFIX_CHARS = 128
#: Groups that go over an edge (at most two for each partition) are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
_OUT = "doc_id long, text_sha256 string, run_id string, run_first long, run_size long, nth long, part int, edge boolean, length long"


def _runs(batches: Iterator) -> Iterator:
    """Rows of runs of equal texts in one sorted partition; and, without texts, the runs that may go on in another partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]

    def record(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def rows(runs):
        cols = [[] for _ in names]
        for (place, number, length), members in runs:
            n = len(members)
            for col, more in zip(cols, (members, [place[1]] * n, [f"{part}-{number}"] * n, [members[0]] * n, [n] * n, range(n), [part] * n, [False] * n, [length] * n), strict=True):
                col += more
        return record(cols)

    number, text, run, done, least, most = -1, None, None, [], None, None

    def close():
        nonlocal least, most
        own = (*run[0], run[1][0], len(run[1]))
        least = own if least is None or own[0] < least[0] else least
        most = own if most is None or own[0] > most[0] else most
        done.append(run)

    for batch in slices(batches):
        for doc_id, norm, head, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "norm", "head", "digest")), strict=True):
            if run is not None and run[0][0][1] == digest and text == norm:
                run[1].append(doc_id)
                continue
            if run is not None:
                close()
            number, text = number + 1, norm
            run = (((head.encode(), digest), number, len(norm)), [doc_id])
        if done:
            yield rows(done)
            done.clear()
    if run is not None:
        close()
        yield rows(done)
        for (_, digest), n, length, first, size in {least, most}:
            yield record([[x] for x in (None, digest, f"{part}-{n}", first, size, None, part, True, length)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " ").alias("norm"))
    keyed = norm.withColumn("digest", F.sha2("norm", 256)).withColumn("head", F.substring("norm", 1, PREFIX_CHARS)).withColumn("row", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(partitions or shuffle_partitions(spark), "head", "digest", "doc_id", "row")
    placed = placed.sortWithinPartitions("norm", "doc_id", "row").select("doc_id", "norm", "head", "digest")
    runs = materialize(placed.mapInArrow(_runs, _OUT))

    # two rows a partition at most; parts of one group follow each other in the order of partitions
    edges = runs.where("edge").select("run_id", "text_sha256", "length", "part", "run_first", "run_size")
    whole = Window.partitionBy("text_sha256", "length")
    linked = edges.select(
        "run_id",
        F.first("run_first").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("chain_first"),
        F.min("part").over(whole).alias("chain_part"),
        F.sum("run_size").over(whole).alias("chain_size"),
        F.count("*").over(whole).alias("parts"),
    )
    linked = materialize(linked.where("parts > 1").drop("parts"))
    rows = runs.where("not edge").join(F.broadcast(linked) if linked.count() <= BROADCAST_ROWS else linked, "run_id", "left")
    begins = F.col("chain_part").isNull() | (F.col("chain_part") == F.col("part"))
    return rows.select(
        "doc_id",
        F.when(F.col("chain_part").isNull(), F.col("run_first")).otherwise(F.col("chain_first")).alias("keep_id"),
        F.coalesce("chain_size", "run_size").alias("group_size"),
        (begins & (F.col("nth") == 0)).alias("kept"),
        "text_sha256",
    )
