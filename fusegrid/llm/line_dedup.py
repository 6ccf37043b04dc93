"""Line dedup over sharded cuckoo filters backed by exact reference counts.

State: a table ``refs(key, refs)`` with the exact number of documents that hold each line key, and
for each shard of keys a cuckoo filter of the keys at or above the threshold. Documents can be
added and removed: counts are summed (removal with sign -1), and filters gain and lose only the keys that
cross the threshold, so that adding and removing the same documents restores both.

The number of shards is the power of two that the keys at the threshold ask for, so that it too is restored; when it
changes, filters are built anew from the exact counts.

Dropping deals the line keys of documents, and the filters, to groups by shard; a shard with many lines has several groups, each
with a copy of its filter. Keys that a filter claims but the exact table denies are found by probing all keys
below the threshold, so no line goes by a false positive. No filter comes to the driver.

Defined results: null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; a document counts once for a key however often it holds the line; every input row is a
document of its own, also when ids repeat or are null; extra columns stay untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.common import SPACES, materialize, shuffle_partitions, slices, text_bytes

SLOTS = 4
MAX_KICKS = 500
KEYS_PER_SHARD = 200_000
#: Rows that probe one copy of a filter.
ROWS_PER_GROUP = 500_000
#: Tables of shards and of keys claimed wrongly (about one in 500 million is) are broadcast up to so many rows.
BROADCAST_ROWS = 200_000


class CuckooFilter:
    """32-bit fingerprints in buckets of four; supports insert, delete and membership of 16-byte keys."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1
        while buckets * SLOTS * 0.85 < max(capacity, 4):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @staticmethod
    def load(data: bytes) -> CuckooFilter:
        return CuckooFilter(0, np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = int.from_bytes(key[:4], "little") or 1
        first = int.from_bytes(key[4:10], "little") & mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ ((mark * 0x5BD1E995) >> 8)) & (len(self.table) - 1)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())

    def claims(self, keys: np.ndarray) -> np.ndarray:
        """Membership of many keys, given as rows of 16 bytes."""
        size = np.uint64(len(self.table) - 1)
        mark = np.ascontiguousarray(keys[:, :4]).view("<u4").ravel().astype(np.uint64)
        mark[mark == 0] = 1
        first = (np.ascontiguousarray(keys[:, 4:12]).view("<u8").ravel() & np.uint64((1 << 48) - 1)) & size
        other = (first ^ ((mark * np.uint64(0x5BD1E995)) >> np.uint64(8))) & size
        found = (self.table[first.astype(np.int64)] == mark[:, None]).any(1)
        return found | (self.table[other.astype(np.int64)] == mark[:, None]).any(1)

    def insert(self, key: bytes) -> bool:
        """False if no place is found; the caller then builds a larger filter."""
        mark, at, other = self._places(key)
        for bucket in (at, other):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    @staticmethod
    def of(keys: list[bytes]) -> CuckooFilter:
        size = len(keys)
        while True:
            out = CuckooFilter(size)
            if all(out.insert(k) for k in keys):
                return out
            size = 2 * size + 8


@dataclass
class LineState:
    """refs: key binary, refs long. filters: shard int, keys long, filter binary."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    keys_per_shard: int = KEYS_PER_SHARD


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # of bytes: A-Z only


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _chars(key: bytes) -> int:
    return len(key) - sum(0x80 <= b < 0xC0 for b in key) if not key.isascii() else len(key)


def _keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """Digest of each line's key; None where the key is too short to be dropped."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        out.append(_digest(key) if len(key) >= min_chars and _chars(key) >= min_chars else None)
    return out


def line_keys(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """A row ``key`` for each document and distinct line key."""

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            out = [k for t in text_bytes(batch) for k in {*_keys_of(t, min_chars)} - {None}]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(keys, "key binary")


def _shard(shards: int):
    """From three bytes of the digest that the filter doesn't use."""
    return (F.conv(F.hex(F.substring("key", 13, 3)), 16, 10).cast("long") % F.lit(shards)).cast("int")


def _shards_for(hot: int, keys_per_shard: int) -> int:
    return 1 << max(0, -(-hot // keys_per_shard) - 1).bit_length()


def _build_filters(refs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    def build(frame):
        import pandas as pd

        keys = [bytes(k) for k in frame["key"]]
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "keys": [len(keys)], "filter": [CuckooFilter.of(keys).dump()]})

    hot = refs.where(F.col("refs") >= min_docs).select("key", _shard(shards).alias("shard"))
    return hot.groupBy("shard").applyInPandas(build, "shard int, keys long, filter binary")


def build_state(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = KEYS_PER_SHARD) -> LineState:
    """The state of a first set of documents."""
    refs = materialize(line_keys(docs, text_col, min_chars).groupBy("key").agg(F.count("*").alias("refs")))
    shards = _shards_for(refs.where(F.col("refs") >= min_docs).count(), keys_per_shard)
    return LineState(refs, materialize(_build_filters(refs, shards, min_docs)), shards, min_docs, min_chars, keys_per_shard)


def _change(state: LineState, docs: DataFrame, text_col: str, sign: int) -> LineState:
    own = line_keys(docs, text_col, state.min_chars).groupBy("key").agg((F.count("*") * sign).alias("by"))
    both = state.refs.join(own, "key", "full").select("key", F.coalesce("refs", F.lit(0)).alias("was"), (F.coalesce("refs", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("refs"))
    both = materialize(both)
    left = both.where("refs > 0").select("key", "refs")
    shards = _shards_for(both.where(F.col("refs") >= state.min_docs).count(), state.keys_per_shard)
    if shards != state.shards:
        return LineState(left, materialize(_build_filters(left, shards, state.min_docs)), shards, state.min_docs, state.min_chars, state.keys_per_shard)
    cross = both.where((F.col("was") >= state.min_docs) != (F.col("refs") >= state.min_docs))
    cross = cross.select(_shard(state.shards).alias("shard"), "key", (F.col("refs") >= state.min_docs).alias("enters"))
    all_hot = both.where(F.col("refs") >= state.min_docs).select(_shard(state.shards).alias("shard"), "key")

    def update(key, filters, changes):
        import pandas as pd

        old = CuckooFilter.load(bytes(filters["filter"].iloc[0])) if len(filters) else CuckooFilter(len(changes))
        n, full = int(filters["keys"].iloc[0]) if len(filters) else 0, False
        for k, enters in sorted(zip(map(bytes, changes["key"]), changes["enters"], strict=True), key=lambda x: x[1]):
            full |= not (old.insert(k) if enters else old.delete(k))
            n += 1 if enters else -1
        return pd.DataFrame({"shard": [int(key[0])], "keys": [n], "filter": [None if full else old.dump()]})

    new = materialize(state.filters.groupBy("shard").cogroup(cross.groupBy("shard")).applyInPandas(update, "shard int, keys long, filter binary"))
    full = new.where("filter is null").select("shard")
    if not full.isEmpty():  # a shard that outgrew its filter is built anew from the exact counts
        again = _build_filters(both.join(all_hot.join(full, "shard").select("key"), "key", "left_semi").select("key", "refs"), state.shards, state.min_docs)
        new = materialize(new.where("filter is not null").unionByName(again))
    return LineState(left, new, state.shards, state.min_docs, state.min_chars, state.keys_per_shard)


def add_documents(state: LineState, docs: DataFrame, text_col: str = "text") -> LineState:
    return _change(state, docs, text_col, 1)


def remove_documents(state: LineState, docs: DataFrame, text_col: str = "text") -> LineState:
    """Undo add_documents (or build_state) for these documents."""
    return _change(state, docs, text_col, -1)


def claimed(state: LineState, rows: DataFrame) -> DataFrame:
    """The rows of ``rows(row, key)`` whose key the filter of its shard claims to hold."""
    spark = rows.sparkSession
    rows = rows.withColumn("shard", _shard(state.shards))
    least = -(-2 * shuffle_partitions(spark) // state.shards)
    # a row a shard: how many lines its keys have, and so how many groups
    load = state.refs.groupBy(_shard(state.shards).alias("shard")).agg(F.sum("refs").alias("lines"))
    load = load.select("shard", F.greatest(F.lit(least), F.ceil(F.col("lines") / ROWS_PER_GROUP)).cast("int").alias("groups"))
    load = F.broadcast(load) if state.shards <= BROADCAST_ROWS else load
    asking = rows.join(load, "shard").select("shard", F.pmod(F.xxhash64("row", "key"), F.col("groups")).cast("int").alias("group"), F.lit(1).alias("role"), "row", "key")
    filters = state.filters.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("row"), F.col("filter").alias("key"))
    dealt = filters.unionByName(asking).repartition(shuffle_partitions(spark), "shard", "group").sortWithinPartitions("shard", "group", "role")

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, at = None, None
        for batch in slices(batches, 20_000):
            place = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("group").to_numpy()
            role, starts = batch.column("role").to_numpy(), np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            for x, y in zip(starts, [*starts[1:], len(place)], strict=True):
                if place[x] != at:  # a shard without keys at the threshold has no filter
                    own, at = None, place[x]
                if role[x] == 0:
                    own, x = CuckooFilter.load(batch.column("key")[x].as_py()), x + 1
                if own is not None and x < y:
                    some = batch.slice(x, y - x)
                    fine = pa.array(own.claims(np.frombuffer(b"".join(some.column("key").to_pylist()), np.uint8).reshape(-1, 16)), pa.bool_())
                    yield pa.RecordBatch.from_arrays([some.column("row").filter(fine), some.column("key").filter(fine)], ["row", "key"])

    return dealt.mapInArrow(probe, "row long, key binary")


def _kept(text: bytes, keys: list, hot) -> tuple[int, int, str]:
    keep = [line for line, k in zip(text.split(b"\n"), keys, strict=True) if k is None or not hot(k)]
    return len(keys), len(keys) - len(keep), b"\n".join(keep).decode()


def drop_lines(docs: DataFrame, state: LineState, text_col: str = "text") -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` (before) and ``n_dropped`` added."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    own = ["kept_text", "n_lines", "n_dropped"]
    base = docs.drop(*own)
    schema = StructType([*base.schema.fields, StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    min_chars = state.min_chars
    numbered = materialize(base.withColumn("_row", F.monotonically_increasing_id()))

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            rows = [(r, k) for r, t in zip(batch.column("_row").to_pylist(), text_bytes(batch), strict=True) for k in {*_keys_of(t, min_chars)} - {None}]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.binary())], ["row", "key"])

    lines = numbered.select("_row", F.col(text_col).alias("text")).mapInArrow(keys, "row long, key binary")
    # every key of the corpus is a row of the exact table: those claimed below the threshold are the false positives
    wrong = materialize(claimed(state, state.refs.where(F.col("refs") < state.min_docs).select(F.lit(0).cast("long").alias("row"), "key")).select("key"))
    denied = wrong.count()
    hot = claimed(state, lines)
    if denied:
        hot = hot.join(F.broadcast(wrong) if denied <= BROADCAST_ROWS else wrong, "key", "left_anti")
    found = hot.groupBy(F.col("row").alias("_row")).agg(F.collect_list("key").alias("_hot"))  # a document's own keys
    joined = numbered.join(found, "_row", "left").drop("_row")

    def drop(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            hots = [{*(h or ())} for h in batch.column("_hot").to_pylist()]
            rows = [_kept(t, _keys_of(t, min_chars), h.__contains__) for t, h in zip(text_bytes(batch, text_col), hots, strict=True)]
            cols = [batch.column(c) for c in batch.schema.names if c != "_hot"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[2] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema.names)

    return joined.mapInArrow(drop, schema)
