"""Shared pieces of the training-data operators: folders, tables, text hashing, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Only a local master may leave that unset: it then gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fusegrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; it survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(batches: Iterator, name: str = "text", most: int = 1 << 22, rows: int = 4096) -> Iterator:
    """Arrow batches cut to a bounded number of rows and of bytes in one column (a longer value comes alone)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in slices(batches, rows):
        size = pc.fill_null(pc.binary_length(batch.column(name).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(int(np.searchsorted(total, before + most, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def in_groups(batches: Iterator, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of rows that come in the order of their keys; rows are read as they are asked for, one group after the other."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in byte_slices(batches, columns[-1]):
            yield from zip(*(batch.column(c).to_pylist() for c in [*keys, *columns]), strict=True)

    for key, part in groupby(rows(), key=lambda r: r[: len(keys)]):
        yield key, (r[len(keys) :] for r in part)


def text_bytes(batch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut to a bounded number of rows; at the end the worker gives back what Arrow's pool holds free."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a fresh array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[list(SPACES)] = True


def word_spans(data: np.ndarray, outside: np.ndarray = _SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in an array of bytes; ``outside`` marks the bytes that are in no word."""
    inside = np.concatenate([[False], ~outside[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


_CHUNK = 8
#: Longer spans are hashed one by one by blake2b.
_MOST_CHUNKS = 5
_CHUNK_MASK = np.array([(1 << 8 * n) - 1 for n in range(_CHUNK + 1)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: its length and its chunks of eight bytes, mixed in one after the other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(_CHUNK, np.uint8)])
    chunk_at = np.lib.stride_tricks.sliding_window_view(padded, _CHUNK)
    size = ends - starts
    out = mix64(size.astype(np.uint64))
    of, at = np.arange(len(starts)), 0
    while len(of) and at < _MOST_CHUNKS * _CHUNK:
        chunk = np.ascontiguousarray(chunk_at[starts[of] + at]).view("<u8").ravel()
        out[of] = mix64(out[of] * np.uint64(0xD6E8FEB86659FD93) + (chunk & _CHUNK_MASK[np.minimum(size[of] - at, _CHUNK)]))
        at += _CHUNK
        of = of[size[of] > at]
    for i in of.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of one size hold the same bytes, eight at a time. Both arrays need eight bytes to spare behind their spans."""
    view_a, view_b = (np.lib.stride_tricks.sliding_window_view(x, _CHUNK) for x in (a, b))
    same, of, at = np.ones(len(size), bool), np.arange(len(size)), 0
    while len(of):
        x = np.ascontiguousarray(view_a[at_a[of] + at]).view("<u8").ravel() ^ np.ascontiguousarray(view_b[at_b[of] + at]).view("<u8").ravel()
        fine = (x & _CHUNK_MASK[np.minimum(size[of] - at, _CHUNK)]) == 0
        same[of[~fine]] = False
        at += _CHUNK
        of = of[fine & (size[of] > at)]
    return same


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text."""
    data = np.frombuffer(text, np.uint8)
    return span_hashes(data, *word_spans(data)) if len(data) else np.zeros(0, np.uint64)


#: Edges that are joined to stars at a time, inside a task.
STAR_EDGES = 200_000


def _local_stars(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Edges (u, v) of the same components, fewer: each bounded run of a task's edges becomes stars around the least id (``roots``: which gets an edge to itself)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        root: dict[int, int] = {}

        def find(x: int) -> int:
            at = x
            while (up := root.setdefault(at, at)) != at:
                at = up
            while root[x] != at:
                root[x], x = at, root[x]
            return at

        def stars() -> Iterator:
            pairs = [(x, find(x)) for x in root]
            pairs = [p for p in pairs if roots or p[0] != p[1]]
            root.clear()
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        seen = 0
        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= STAR_EDGES:
                yield from stars()
                seen = 0
        yield from stars()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` as rows ``(id, component)``, component the smallest id.

    Tasks first join their own edges to stars. Where what is left has no more than ``STAR_EDGES`` rows, one task joins these in the same way, and that is all. Otherwise large-star and
    small-star steps alternate, each a partial aggregation and a join, until nothing changes. Every round is cut by a written table: a lost executor costs one round at most.
    Ids without an edge have no row. Null ids are ignored.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        else:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        both = near.join(least, "u")
        if large:
            out = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def signed(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    given = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = materialize(_local_stars(given))
    if now.count() <= STAR_EDGES:
        return materialize(_local_stars(now.coalesce(1), roots=True).select(F.col("u").alias("id"), F.col("v").alias("component")))
    was = None
    for _ in range(60):
        now = materialize(_local_stars(star(star(now, True), False)).distinct())
        sign = signed(now)
        if was == sign:
            break
        was = sign
    least = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return materialize(least.union(least.select(F.col("component").alias("id"), "component").distinct()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
