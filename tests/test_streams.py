"""The keyed cache and the idempotent sink: against one event after the other, across restarts and repeated or broken batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fusegrid.operators.graph import upsert
from fusegrid.streaming import state as T

BEGIN = dt.datetime(2024, 3, 1)


def write(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={number}")


def outcomes(rows, ttl):
    held, out = {}, []
    for event, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if key is None:
            continue
        if key in held and ts - held[key] <= ttl:
            out.append((key, event, "hit"))
            continue
        if key in held:
            out.append((key, None, "evicted"))
        held[key] = ts
        out.append((key, event, "miss"))
    return out, held


def test_cache_with_timers_and_restart(spark, tmp_path):
    r = random.Random(4)
    schema = "event_id long, key long, ts timestamp"
    at, parts = BEGIN, []
    for part in range(5):
        rows = []
        for _ in range(60):
            at += dt.timedelta(seconds=r.choice([1, 40, 300, 1500]))
            rows.append((len(rows) + 1000 * part, r.choice([1, 2, 3, 4, 5, 6, None]) if part < 4 else 7, at))
        parts.append(rows)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    for number in range(2):
        write(spark, tmp_path, number, parts[number], schema)
    T.drain(T.cache(read(), 1800), [], "append", str(tmp_path), "run").count()
    for number in range(2, 5):
        write(spark, tmp_path, number, parts[number], schema)
    found = T.drain(T.cache(read(), 1800), [], "append", str(tmp_path), "run")  # goes on from the checkpoint
    every = [row for rows in parts for row in rows]
    want, held = outcomes(every, dt.timedelta(seconds=1800))
    last = max(ts for _, _, ts in every) - dt.timedelta(hours=1)
    want += [(key, None, "evicted") for key, ts in held.items() if ts + dt.timedelta(seconds=1800) <= last]
    got = [tuple(x) for x in found.select("key", "event_id", "outcome").collect()]
    order = lambda x: (x[0], -1 if x[1] is None else x[1], x[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {k for k, _, o in got if o == "evicted"} >= {1, 2, 3, 4, 5, 6} and 7 in held


SCHEMA = "id long, value string, day string"


def put(old, new):
    return upsert(old, new, "id")


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_a_batch_counts_once(spark, tmp_path):
    table = T.UpsertTable(spark, f"{tmp_path}/t", SCHEMA, "id", "day")
    assert content(table) == []
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert table.merge(frame([(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2"), (9, "n", None)]), 0, put)
    assert table.merge(frame([(2, "B", "d1"), (4, "d", "d3")]), 1, put)
    now = [(1, "a", "d1"), (2, "B", "d1"), (3, "c", "d2"), (4, "d", "d3"), (9, "n", None)]
    key = lambda r: (r[0], r[1])
    assert sorted(content_of(table), key=key) == now
    assert not table.merge(frame([(1, "again", "d1")]), 0, put) and sorted(content_of(table), key=key) == now
    # a batch that broke after its data and before its entry in the ledger: unseen, and written over when it comes again
    table._write(frame([(3, "broken", "d2")]).withColumn("part", F.col("day")).withColumn("version", F.lit(2).cast("long")), 2)
    assert sorted(content_of(table), key=key) == now and not table.has(2)
    assert table.merge(frame([(3, "C", "d2")]), 2, put)
    now[2] = (3, "C", "d2")
    assert sorted(content_of(table), key=key) == now
    assert table.retain("d2", 3) and not table.retain("d9", 3)
    assert sorted(content_of(table), key=key) == [x for x in now if x[2] != "d1"]
    assert table.merge(frame([(7, "new", "d1")]), 4, put)
    assert (7, "new", "d1") in content_of(table) and (1, "a", "d1") not in content_of(table)


def content_of(table):
    return [tuple(r) for r in table.read().collect()]


def test_stream_into_the_table_and_again(spark, tmp_path):
    for number in range(3):
        write(spark, tmp_path, number, [(i % 5, f"v{number}", f"d{i % 3}") for i in range(number, number + 4)], SCHEMA)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    table = T.UpsertTable(spark, f"{tmp_path}/t", SCHEMA, "id", "day")
    last = lambda old, new: upsert(old, new.groupBy("id").agg(F.max_by(F.struct("value", "day"), "value").alias("x")).select("id", "x.*"), "id")
    T.merge_stream(read(), table, last, f"{tmp_path}/state")
    once = content(table)
    T.merge_stream(read(), table, last, f"{tmp_path}/other-state")  # the same batches under a checkpoint that was lost
    assert content(table) == once and table.ledger().select("batch").distinct().count() == 3
