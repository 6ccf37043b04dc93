"""Structured Streaming over events: windowed counts, sessions, incremental confidence, a circuit breaker and a cache with keyed state, an idempotent sink.

Each function takes and returns a streaming DataFrame, or runs a finite stream to its end (``drain``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from fusegrid.functions import scalar as S
from fusegrid.operators import health

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """The events table as a stream; ts with a time zone, as watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def feedback_totals(events: DataFrame) -> DataFrame:
    """Running sums of feedback deltas an element."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "thumbs_up").when(F.col("event_type") == "error", "thumbs_down")
    rows = events.select(F.get_json_object("props", "$.k").cast("bigint").alias("element_id"), S.feedback_delta(kind).alias("delta")).where("delta is not null")
    return rows.groupBy("element_id").agg(F.sum("delta").alias("delta"))


def breaker(events: DataFrame) -> DataFrame:
    """(service, event_id, state): a circuit breaker a service, its state kept between batches."""

    def run(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        held = state.get if state.exists else ("closed", 0, 0.0)
        frame = pd.concat(list(frames)).sort_values(["at", "event_id"])
        states = []
        for ok, at in zip(frame["ok"], frame["at"], strict=True):
            held = health.step(held[0], held[1], held[2], bool(ok), float(at))
            states.append(held[0])
        state.update(held)
        yield pd.DataFrame({"service": [key[0]] * len(frame), "event_id": frame["event_id"], "state": states})

    rows = events.select((F.col("user_id") % 5).alias("service"), "event_id", (F.col("event_type") != "error").alias("ok"), (F.unix_micros("ts") / F.lit(1e6)).alias("at"))
    return rows.groupBy("service").applyInPandasWithState(run, "service long, event_id long, state string", "state string, failures int, opened double", "append", "NoTimeout")


class CacheProcessor(StatefulProcessor):
    """A cache entry a key: its time of storage as state, and a timer of event time that gives it up when it is older than the time to live.

    A request finds the entry (hit) while its age is the time to live or less; otherwise it stores a new one (miss). An expired entry is told once (evicted), by its
    timer or by the request that replaces it.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  names of the interface
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        held = self.stored.get()[0] if self.stored.exists() else None
        before, out = held, []
        for event, at in zip(frame["event_id"].tolist(), frame["at"].tolist(), strict=True):
            if held is not None and at - held <= self.ttl_ms:
                out.append((key[0], event, "hit", at))
                continue
            if held is not None:
                out.append((key[0], None, "evicted", held))
            held = at
            out.append((key[0], event, "miss", at))
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.handle.registerTimer(held + self.ttl_ms)
            self.stored.update((held,))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        held = self.stored.get()[0] if self.stored.exists() else None
        if held is not None and held + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.stored.clear()
            yield self._rows([(key[0], None, "evicted", held)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(out: list):
        import pandas as pd

        names = ["key", "event_id", "outcome", "at"]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"key": "int64", "event_id": "Int64", "outcome": object, "at": "int64"})


def cache(requests: DataFrame, ttl_s: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, outcome, at) from requests(key, event_id, ts): outcome is hit or miss a request, and evicted (without event) an entry that expired; at in milliseconds.

    The state store must hold timers: ``spark.sql.streaming.stateStore.providerClass`` is set to the one of RocksDB. Requests later than the watermark are dropped; a null key is no request.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.where("key is not null").withWatermark("ts", late).select("key", "event_id", F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(CacheProcessor(1000 * ttl_s), "key long, event_id long, outcome string, at long", "append", "EventTime")


def drain(stream: DataFrame, keys: list[str], mode: str, folder: str, name: str | None = None) -> DataFrame:
    """Run a finite stream to its end and return its last row a key (all rows where ``keys`` is empty).

    Every batch is written to its own subfolder, so that a batch that is done again replaces itself. With the ``name`` of an earlier run it goes on from its checkpoint.
    """
    spark, run = stream.sparkSession, f"{folder}/{name or uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{run}/state").foreachBatch(put).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    out = spark.read.schema(schema).parquet(f"{run}/out")
    if not keys:
        return out.drop("batch")
    others = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in others])


class UpsertTable:
    """A table of one row a key in a folder of partitions, to which batches are merged so that a batch that comes again changes nothing.

    Each merge writes the partitions it touches anew, under ``data/version=<batch>``, and then one ledger file ``ledger/batch=<batch>`` that lists for these partitions that
    version. A partition's rows are those of its last version in the ledger, so that readers see a batch whole or not at all, and a batch whose merge
    was cut off half-way is written again to its own folder. A batch that the ledger has is left out. ``retain`` drops partitions below a bound by a ledger entry, too.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, partition: str):
        self.spark, self.folder, self.schema, self.key, self.partition = spark, folder.rstrip("/"), schema, key, partition

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def ledger(self) -> DataFrame:
        """(part, version, batch): every partition that a batch wrote; version null: dropped."""
        kind = "part string, version long, batch long"
        if not self._exists(f"{self.folder}/ledger"):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/ledger")

    def has(self, batch: int) -> bool:
        return self._exists(f"{self.folder}/ledger/batch={batch}/_SUCCESS")

    def _current(self) -> DataFrame:
        last = self.ledger().groupBy("part").agg(F.max(F.struct("batch", "version")).alias("m"))
        return last.where("m.version is not null").select(F.col("part").alias("_part"), F.col("m.version").alias("_version"))

    def read(self) -> DataFrame:
        names = [x.strip().split()[0] for x in self.schema.split(",")]
        if not self._exists(f"{self.folder}/data"):
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(f"{self.schema}, part string, version long").parquet(f"{self.folder}/data")
        # one row a partition
        return stored.join(self._current(), (F.col("part") == F.col("_part")) & (F.col("version") == F.col("_version"))).select(*names)

    def merge(self, rows: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Merge a batch; ``combine(old, new)`` gives the rows of the partitions that ``rows`` touch. False if the ledger has it already."""
        if self.has(batch):
            return False
        part = F.coalesce(F.col(self.partition).cast("string"), F.lit("none"))
        touched = rows.select(part.alias("_touched")).distinct()
        old = self.read().join(touched, part == F.col("_touched"), "left_semi")
        merged = combine(old, rows).withColumn("part", part).withColumn("version", F.lit(batch).cast("long"))
        self._write(merged, batch)
        written = self.spark.read.schema(f"{self.schema}, part string, version long").parquet(f"{self.folder}/data").where(F.col("version") == batch)
        self._tell(written.select("part").distinct().select("part", F.lit(batch).cast("long").alias("version")), batch)
        return True

    def retain(self, least: str, batch: int) -> bool:
        """Drop the partitions whose value, as text, is below ``least``."""
        if self.has(batch):
            return False
        self._tell(self._current().where(F.col("_part") < F.lit(least)).select(F.col("_part").alias("part"), F.lit(None).cast("long").alias("version")), batch)
        return True

    def _write(self, rows: DataFrame, batch: int) -> None:
        # only the partitions of this version are written over, should the batch come again
        rows.write.partitionBy("version", "part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/data")

    def _tell(self, parts: DataFrame, batch: int) -> None:
        parts.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")


def merge_stream(stream: DataFrame, table: UpsertTable, combine: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> None:
    """Run a finite stream to its end, each batch merged into the table once."""

    def put(batch: DataFrame, number: int) -> None:
        table.merge(batch, number, combine)

    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()
