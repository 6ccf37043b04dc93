"""Service state in batch: failure runs, circuit-breaker trace, degradation modes, cache ages, retries, moving averages."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.functions import scalar as S
from fusegrid.sources.io import materialize

OPEN_AFTER, HALF_OPEN_S = 5, 30
DEGRADED_AFTER, OFFLINE_AFTER = 3, 5


def _sliced(outcomes: DataFrame) -> DataFrame:
    """With ``_t``, the hour: what is known at its start is carried from hour to hour, so that no task holds a service's history."""
    return outcomes.withColumn("_t", F.date_trunc("hour", "ts"))


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    own = carry.withColumnsRenamed({"service": "_s", "_t": "_h"})
    return rows.join(own, F.col("service").eqNullSafe(F.col("_s")) & F.col("_t").eqNullSafe(F.col("_h"))).drop("_s", "_h", "_t")


def _hours():
    return Window.partitionBy("service").orderBy("_t")


def failure_runs(outcomes: DataFrame) -> DataFrame:
    """With ``failures``: consecutive ones up to and with this event (gaps and islands).

    Runs are counted within an hour; those before its first success go on from the failures at the end of the hours before.
    """
    by = Window.partitionBy("service", "_t").orderBy("ts", "event_id")
    island = _sliced(outcomes).withColumn("_i", F.sum(F.col("ok").cast("int")).over(by))
    within = Window.partitionBy("service", "_t", "_i").orderBy("ts", "event_id")
    runs = island.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(within))
    ends = runs.groupBy("service", "_t").agg(F.max("ok").cast("int").alias("_any"), F.max(F.struct("ts", "event_id", "failures"))["failures"].alias("_end"))
    ends = ends.withColumn("_k", F.sum("_any").over(_hours())).withColumn("_sum", F.sum("_end").over(Window.partitionBy("service", "_k").orderBy("_t")))
    carry = ends.select("service", "_t", F.coalesce(F.lag("_sum").over(_hours()), F.lit(0)).alias("_carry"))
    return _with_carry(runs, carry).withColumn("failures", F.col("failures") + F.when(F.col("_i") == 0, F.col("_carry")).otherwise(0)).drop("_i", "_carry")


def service_status(outcomes: DataFrame) -> DataFrame:
    """healthy, degraded (3 failures in a row) or offline (5) after each event; a success resets."""
    n = F.col("failures")
    return failure_runs(outcomes).withColumn("status", F.when(n >= OFFLINE_AFTER, "offline").when(n >= DEGRADED_AFTER, "degraded").otherwise("healthy"))


def latest_status(outcomes: DataFrame) -> DataFrame:
    """One row a service: its status after its last event, by a partial aggregation."""
    last = F.max(F.struct("ts", "event_id", "status", "failures")).alias("m")
    return service_status(outcomes).groupBy("service").agg(last).select("service", "m.status", "m.failures")


def system_mode(statuses: DataFrame, required: list[int]) -> DataFrame:
    """One row: offline if a required service is, partial if another is, degraded if any is, else full."""
    need = F.col("service").isin(*required)
    flags = statuses.agg(
        F.max((need & (F.col("status") == "offline")).cast("int")).alias("r"),
        F.max((~need & (F.col("status") == "offline")).cast("int")).alias("o"),
        F.max((F.col("status") == "degraded").cast("int")).alias("d"),
    )
    return flags.select(F.when(F.col("r") == 1, "offline").when(F.col("o") == 1, "partial").when(F.col("d") == 1, "degraded").otherwise("full").alias("mode"))


def step(state: str, failures: int, opened: float, ok: bool, at: float) -> tuple[str, int, float]:
    """One event at a circuit breaker: closed, open after OPEN_AFTER failures in a row, half-open HALF_OPEN_S later."""
    if state == "open" and at - opened >= HALF_OPEN_S:
        state = "half_open"
    if state == "open":
        return state, failures, opened  # not let through
    if ok:
        return "closed", 0, opened
    failures += 1
    if state == "half_open" or failures >= OPEN_AFTER:
        return "open", failures, at
    return state, failures, opened


def breaker_trace(outcomes: DataFrame) -> DataFrame:
    """(service, event_id, state) after each event; events without a time are left out, without an outcome they failed. No task holds more than an hour of a service's events, or a list of hours or days without events.

    An hour of events is a map from the state at its start to that at its end (``SliceMap``). The maps of a day's hours compose to the day's;
    from the days' come the states at their starts, from these those of the hours, and then each hour is replayed.
    """
    from fusegrid.functions.arrow import sorted_groups

    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000D")
    rows = outcomes.where("ts is not null").select("service", "event_id", F.coalesce("ok", F.lit(False)).alias("ok"), at.alias("at"), F.floor(at / 3600).alias("hour"))
    maps = "service long, day long, hour long, map binary"

    def row(pa, service, day, hour, value: bytes):
        return pa.RecordBatch.from_arrays([pa.array([service], pa.int64()), pa.array([day], pa.int64()), pa.array([hour], pa.int64()), pa.array([value], pa.binary())], ["service", "day", "hour", "map"])

    def of_hours(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (service, hour), group in sorted_groups(batches, ["service", "hour"]):
            yield row(pa, service, hour // 24, hour, SliceMap.of(group.column("at").to_pylist(), group.column("ok").to_pylist(), hour * 3600.0).packed())

    def of_days(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (service, day), group in sorted_groups(batches, ["service", "day"]):
            parts = [SliceMap.unpacked(m) for m in group.column("map").to_pylist()]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.then(part)
            yield row(pa, service, day, None, whole.packed())

    def starts(keys: list[str], given: bool):
        """The state before each row of a group, from ``start`` of its first row or, at the very beginning, closed."""

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for (service, *_), group in sorted_groups(batches, keys):
                held = (group.column("failures")[0].as_py(), group.column("opened")[0].as_py()) if given else (0, None)
                before = []
                for m in group.column("map").to_pylist():
                    before.append(held)
                    held = SliceMap.unpacked(m).end(held)
                n = group.num_rows
                cols = [pa.array([service] * n, pa.int64()), group.column("day"), group.column("hour"), pa.array([x[0] for x in before], pa.int32()), pa.array([x[1] for x in before], pa.float64())]
                yield from pa.table(cols, ["service", "day", "hour", "failures", "opened"]).to_batches()

        return run

    def replay(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (service, _), group in sorted_groups(batches, ["service", "hour"]):
            failures, opened = group.column("failures")[0].as_py(), group.column("opened")[0].as_py()
            held = ("closed", failures, 0.0) if opened is None else ("open", failures, opened)
            states = []
            for ok, at in zip(group.column("ok").to_pylist(), group.column("at").to_pylist(), strict=True):
                held = step(*held, ok, at)
                states.append(held[0])
            yield from pa.table([pa.array([service] * len(states), pa.int64()), group.column("event_id"), pa.array(states, pa.string())], ["service", "event_id", "state"]).to_batches()

    state = "service long, day long, hour long, failures int, opened double"
    hours = materialize(rows.select("service", "hour", "at", "event_id", "ok").repartition("service", "hour").sortWithinPartitions("service", "hour", "at", "event_id").mapInArrow(of_hours, maps))
    days = hours.repartition("service", "day").sortWithinPartitions("service", "day", "hour").mapInArrow(of_days, maps)
    day_starts = days.repartition("service").sortWithinPartitions("service", "day").mapInArrow(starts(["service"], False), state)
    both = hours.withColumnRenamed("service", "s").withColumnRenamed("day", "d").join(day_starts.drop("hour"), F.col("s").eqNullSafe(F.col("service")) & (F.col("d") == F.col("day"))).drop("s", "d")
    hour_starts = both.repartition("service", "day").sortWithinPartitions("service", "day", "hour").mapInArrow(starts(["service", "day"], True), state)
    told = hour_starts.select(F.col("service").alias("s"), F.col("hour").alias("h"), "failures", "opened")
    placed = rows.join(told, F.col("s").eqNullSafe(F.col("service")) & (F.col("h") == F.col("hour"))).drop("s", "h")
    return placed.repartition("service", "hour").sortWithinPartitions("service", "hour", "at", "event_id").select("service", "hour", "event_id", "ok", "at", "failures", "opened").mapInArrow(replay, "service long, event_id long, state string")


class SliceMap:
    """What a slice of time does to a circuit breaker's state, for every state at its start.

    A state is (failures, None) when closed, with fewer than OPEN_AFTER failures, or (failures, time it opened). ``closed`` has the end for each closed start. From an open start
    nothing happens until an event HALF_OPEN_S later or more: ``let`` has the times of the events that may be the first let through, ``ends`` the end for each.
    Without such an event the state stays. ``full``: there is one for every open start.
    """

    def __init__(self, closed: list, let: list[float], ends: list, full: bool):
        self.closed, self.let, self.ends, self.full = closed, let, ends, full

    @classmethod
    def of(cls, at: list[float], ok: list[bool], begin: float) -> SliceMap:
        """From events in order; ``begin``: no start state opened later than this. Ends are found backwards, once an event and state."""
        n = len(at)
        later, j = [0] * n, n  # the first event let through after one opened the breaker
        for i in range(n - 1, -1, -1):
            while j - 1 > i and at[j - 1] - at[i] >= HALF_OPEN_S:
                j -= 1
            later[i] = j
        closed = [(f, None) for f in range(OPEN_AFTER)]  # ends of starting closed behind the last event
        half: list = [None] * (n + 1)  # ends of event i being let through half-open
        for i in range(n - 1, -1, -1):
            opened = half[later[i]] if later[i] < n else (OPEN_AFTER, at[i])
            half[i] = closed[0] if ok[i] else opened
            closed = [closed[0]] * OPEN_AFTER if ok[i] else [*closed[1:], opened]
        most = next((i + 1 for i in range(n) if at[i] - begin >= HALF_OPEN_S), None)
        return cls(closed, at[:most], half[: n if most is None else most], most is not None)

    def end(self, state: tuple) -> tuple:
        failures, opened = state
        if opened is None:
            return self.closed[failures]
        return next((e for t, e in zip(self.let, self.ends, strict=True) if t - opened >= HALF_OPEN_S), state)

    def then(self, other: SliceMap) -> SliceMap:
        """This slice and, after it, another."""
        more = ([], []) if self.full else (other.let, other.ends)
        return SliceMap([other.end(e) for e in self.closed], self.let + more[0], [other.end(e) for e in self.ends] + more[1], self.full or other.full)

    def packed(self) -> bytes:
        return json.dumps([self.closed, self.let, self.ends, self.full]).encode()

    @classmethod
    def unpacked(cls, data: bytes) -> SliceMap:
        closed, let, ends, full = json.loads(data)
        return cls([tuple(x) for x in closed], let, [tuple(x) for x in ends], full)


def cache_state(entries: DataFrame, now, ttl_s: int) -> DataFrame:
    """entries(key, stored_at) with age and whether they are fresh (age <= ttl)."""
    age = F.expr("timestampdiff(SECOND, stored_at, _now)")
    return entries.withColumn("_now", F.lit(now).cast("timestamp_ntz")).withColumn("age", age).withColumn("fresh", F.col("age") <= ttl_s).drop("_now")


def hit_ratio(hits, misses):
    return S.ratio(hits, hits + misses)


def retry_stats(operations: DataFrame) -> DataFrame:
    """From operations(ok, retries): rate 1 and average 0 without any."""
    n = F.count("*")
    out = operations.agg(n.alias("operations"), F.count_if("ok").alias("successes"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"))
    return out.select("operations", S.ratio(F.col("successes"), F.col("operations"), 1.0).alias("success_rate"), S.ratio(F.col("retries"), F.col("operations")).alias("average_retries"))


def moving_average(outcomes: DataFrame, rows: int = 1000) -> DataFrame:
    """With sum and mean of a service's last ``rows`` latencies and the count of all so far.

    Places come from those within an hour and the counts of the hours before. Frames are within blocks of 16 ``rows`` places, and
    the last ``rows`` - 1 of a block are given to the next one too.
    """
    sliced = _sliced(outcomes)
    before = sliced.groupBy("service", "_t").agg(F.count("*").alias("_c")).select("service", "_t", (F.sum("_c").over(_hours()) - F.col("_c")).alias("_before"))
    placed = sliced.withColumn("_n", F.row_number().over(Window.partitionBy("service", "_t").orderBy("ts", "event_id")))
    placed = _with_carry(placed, before).withColumn("seen", F.col("_n") + F.col("_before")).drop("_n", "_before")
    size, at = 16 * rows, F.col("seen") - 1
    own = F.floor(at / size)
    dealt = placed.withColumn("_own", own).withColumn("_b", F.explode(F.when(at % size > size - rows, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("service", "_b").orderBy("seen").rowsBetween(1 - rows, 0)
    return dealt.withColumn("total", F.sum("latency").over(last)).withColumn("moving", F.avg("latency").over(last)).where("_b = _own").drop("_own", "_b")


def rate_limit(events: DataFrame, seconds: int = 60, most: int = 100) -> DataFrame:
    """(start, requests, limited) of tumbling windows."""
    windows = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return windows.select(F.col("w.start").alias("start"), "requests", (F.col("requests") > most).alias("limited"))


def cache_put(entries: DataFrame, new: DataFrame, ttl_s: int, capacity: int) -> DataFrame:
    """entries(key, stored_at) after ``new``, one row of the same columns, is stored.

    Only a cache that is full gives up entries, and only expired ones, so that it may hold more than its capacity; a row of the same key is replaced.
    """
    held = entries.agg(F.count("*").alias("_held")).crossJoin(new.select(F.col("stored_at").alias("_now"), F.col("key").alias("_new")))  # one row
    age = F.expr("timestampdiff(MICROSECOND, stored_at, _now)")
    kept = entries.crossJoin(F.broadcast(held)).where((F.col("_held") < capacity) | (age <= ttl_s * 1_000_000)).where("key <> _new")
    return kept.select("key", "stored_at").unionByName(new.select("key", "stored_at"))
