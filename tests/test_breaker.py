"""The circuit breaker by maps of time slices against one event after the other."""

import datetime as dt
import random

import pytest

from fusegrid.operators import health as C


def events(seed, n, gap):
    r = random.Random(seed)
    at, out, failing = 1_700_000_000.0, [], False
    for _ in range(n):
        at += r.choice([0.0, 0.5, r.random() * gap, 30.0, 29.999])
        failing = failing if r.random() < 0.9 else not failing
        out.append((at, r.random() < (0.15 if failing else 0.8)))
    return out


def trace(rows, state=("closed", 0, 0.0)):
    for at, ok in rows:
        state = C.step(*state, ok, at)
    return state


def shown(state):
    return ("closed", state[0]) if state[1] is None else ("open", state[1])


@pytest.mark.parametrize("gap", [2, 20, 90])
def test_maps_of_slices_and_their_compositions(gap):
    for seed in range(30):
        rows = events(seed, 120, gap)
        cuts = sorted(random.Random(seed).sample(range(1, 120), 3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 120], strict=True)]
        maps = [C.SliceMap.unpacked(C.SliceMap.of([a for a, _ in p], [ok for _, ok in p], p[0][0]).packed()) for p in parts]
        whole = maps[0].then(maps[1]).then(maps[2].then(maps[3]))
        first = rows[0][0]
        starts = [(f, None) for f in range(5)] + [(5, first - x) for x in (0.0, 0.25, 5, 29.9, 30, 31, 400)]
        for failures, opened in starts:
            want = trace(rows, ("closed", failures, 0.0) if opened is None else ("open", failures, opened))
            assert shown(whole.end((failures, opened))) == (want[0], want[2] if want[0] == "open" else want[1])


def test_trace_equals_one_event_after_the_other(spark):
    rows, number = [], 0
    for service in (1, 2, None):
        for at, ok in events(service or 7, 400, 600):
            rows.append((service, number, None if number % 50 == 3 else ok, dt.datetime.fromtimestamp(at, dt.UTC).replace(tzinfo=None)))
            number += 1
    rows.append((9, number, True, None))
    df = spark.createDataFrame(rows, "service long, event_id long, ok boolean, ts timestamp_ntz").repartition(5)
    want = {}
    for service in (1, 2, None):
        state = ("closed", 0, 0.0)
        for _, event, ok, ts in sorted((r for r in rows if r[0] == service and r[3]), key=lambda r: (r[3], r[1])):
            state = C.step(*state, bool(ok), ts.replace(tzinfo=dt.UTC).timestamp())
            want[event] = (service, state[0])
    got = {r["event_id"]: (r["service"], r["state"]) for r in C.breaker_trace(df).collect()}
    assert got == want and {s for _, s in want.values()} == {"open", "closed"}
    assert C.breaker_trace(df.where("false")).count() == 0
