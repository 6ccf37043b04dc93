"""Feedback analytics, rewards, service health and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fusegrid.functions import scalar as S
from fusegrid.operators import feedback as B
from fusegrid.operators import graph as G
from fusegrid.operators import health as C
from fusegrid.operators import hyperedges as HE
from fusegrid.plans.graph_queries import similar_edges
from fusegrid.sources import io
from fusegrid.sources import views as W
from fusegrid.sources.views import with_views as sql

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = (f, oracle)
        return f

    return put


_DELTA = "case feedback_type when 'thumbs_up' then 0.1::double else -0.15::double end"


@query("feedback_by_element", sql("v_feedback", "select id, generation_id, element_id, feedback_type from v_feedback where element_id = 7"))
def _(spark, d):
    return W.feedback(spark, d).where("element_id = 7").select("id", "generation_id", "element_id", "feedback_type")


@query("feedback_by_generation", sql("v_feedback", "select id, element_id, feedback_type from v_feedback where generation_id = 12"))
def _(spark, d):
    return W.feedback(spark, d).where("generation_id = 12").orderBy(F.desc("created_at"), "id").select("id", "element_id", "feedback_type")


@query("feedback_recent", sql("v_feedback", "select id, element_id, feedback_type from v_feedback order by created_at desc, id limit 20 offset 5"))
def _(spark, d):
    return W.feedback(spark, d).orderBy(F.desc("created_at"), "id").offset(5).limit(20).select("id", "element_id", "feedback_type")


@query("feedback_retention", sql("v_feedback", "select count(*) as kept from v_feedback where created_at >= timestamp '2024-01-20 00:00:00' - interval 7 day"))
def _(spark, d):
    return B.retain(W.feedback(spark, d), "2024-01-20 00:00:00", 7).agg(F.count("*").alias("kept"))


_SUMMARY = f"select element_id, count(*) filter (feedback_type = 'thumbs_up') as ups, count(*) filter (feedback_type = 'thumbs_down') as downs, round(sum({_DELTA}), 6)::double as net_delta"


@query("feedback_summary", sql("v_feedback", _SUMMARY + ", epoch_us(max(created_at)) as last_us from v_feedback group by 1"))
def _(spark, d):
    out = B.summary(W.feedback(spark, d))
    return out.select("element_id", "ups", "downs", F.round("net_delta", 6).alias("net_delta"), F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"))


_METRICS = f"""select count(*) as total, count(*) filter (feedback_type = 'thumbs_up') as ups, count(*) filter (feedback_type = 'thumbs_down') as downs,
  round(coalesce(sum({_DELTA}), 0), 6)::double as net, round(count(*) filter (feedback_type = 'thumbs_up') / greatest(count(*), 1), 6)::double as positive_ratio, round(count(*) filter (feedback_type = 'thumbs_down') / greatest(count(*), 1), 6)::double as negative_ratio, round(coalesce(avg({_DELTA}), 0), 6)::double as average_delta from v_feedback"""


@query("feedback_metrics", sql("v_feedback", _METRICS))
def _(spark, d):
    m = B.metrics(W.feedback(spark, d))
    return m.select("total", "ups", "downs", *[F.round(c, 6).alias(c) for c in ("net", "positive_ratio", "negative_ratio", "average_delta")])


@query("metrics_collector", sql("v_feedback", f"select count(*) as total, round(sum(trunc({_DELTA} * 10000)) / 10000, 6)::double as fixed_net, round(sum(trunc({_DELTA} * 10000)) / 10000 / count(*), 6)::double as fixed_average, round(sum(trunc({_DELTA} * 10000)) / 10000, 6)::double as net_impact from v_feedback"))
def _(spark, d):
    return B.metrics(W.feedback(spark, d)).select("total", *[F.round(c, 6).alias(c) for c in ("fixed_net", "fixed_average", "net_impact")])


@query("metrics_trend", sql("v_feedback", ", r as (select element_id, count(*) filter (feedback_type = 'thumbs_up') / count(*) as p from v_feedback group by 1) select element_id, p > 0.6 as positive, p < 0.4 as negative, p between 0.4 and 0.6 as balanced from r"))
def _(spark, d):
    p = S.ratio(F.col("ups"), F.col("ups") + F.col("downs"))
    return B.summary(W.feedback(spark, d)).select("element_id", (p > 0.6).alias("positive"), (p < 0.4).alias("negative"), p.between(0.4, 0.6).alias("balanced"))


@query("confidence_update", sql("v_feedback", f"select id, round(greatest(0.1, least(0.99, 0.5 + {_DELTA})), 6)::double as confidence, round(greatest(0.1, least(0.99, 0.95 + {_DELTA})), 6)::double as from_high from v_feedback"))
def _(spark, d):
    up = lambda x: F.round(S.updated_confidence(F.lit(x), F.col("delta")), 6)
    return B.with_delta(W.feedback(spark, d)).select("id", up(0.5).alias("confidence"), up(0.95).alias("from_high"))


@query("confidence_cumulative", sql("v_feedback", f"select element_id, round(greatest(0.1, least(0.99, 0.5 + sum({_DELTA}))), 6)::double as confidence from v_feedback group by 1"))
def _(spark, d):
    return B.cumulative(W.feedback(spark, d)).select("element_id", F.round("confidence", 6).alias("confidence"))


@query("confidence_sequential", sql("v_feedback", f", l as (select element_id, list({_DELTA} order by created_at, id) as ds from v_feedback group by 1) select element_id, round(list_reduce(list_prepend(0.5::double, ds), lambda x, y: greatest(0.1::double, least(0.99::double, x + y))), 6)::double as confidence from l"))
def _(spark, d):
    return B.sequential(W.feedback(spark, d)).select("element_id", F.round("confidence", 6).alias("confidence"))


def _reward_inputs(spark, d, approximate=False):
    p = W.points(spark, d)
    feedback = W.feedback(spark, d)
    own = p.select("id").join(B.cumulative(feedback), p["id"] == F.col("element_id"), "left").select("id", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    edges = io.materialize(similar_edges(spark, d, approximate))
    return B.reward_inputs(own, edges, G.degrees(edges), feedback)


_REWARD = f""", c as (select p.id, greatest(0.1, least(0.99, 0.5 + coalesce(s, 0)))::double as base from v_point p left join (select element_id, sum({_DELTA}) as s from v_feedback group by 1) f on f.element_id = p.id),
 g as (select id, count(*) as degree from (select src as id from e_similar union all select dst from e_similar) group by 1),
 f as (select element_id, count(*) filter (feedback_type = 'thumbs_down') / count(*) as negative from v_feedback group by 1),
 i as (select c.id, c.base, coalesce((select avg(o.base) from e_similar e join c o on o.id = e.dst where e.src = c.id), 0)::double as neighbours, coalesce(ln(1 + degree) / ln(1 + (select max(degree) from g)), 0)::double as connected, coalesce(negative, 0)::double as negative from c left join g using (id) left join f on f.element_id = c.id),
 w as (select *, greatest(0, least(1, 0.4 * base + 0.3 * neighbours + 0.2 * connected - 0.1 * negative)) as reward from i)"""


@query("reward_scores", sql("v_point v_feedback e_similar", _REWARD + " select id, round(base, 6)::double as base, round(neighbours, 6)::double as neighbours, round(connected, 6)::double as connected, round(negative, 6)::double as negative, round(reward, 6)::double as reward, round(0.4 * base, 6)::double as quick, case when reward > 0.7 then 'high' when reward < 0.3 then 'low' else 'middle' end as level from w"))
def _(spark, d):
    r = B.rewards(_reward_inputs(spark, d))
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("base", "neighbours", "connected", "negative", "reward", "quick")], "level")


@query("reward_dominant", sql("v_point v_feedback e_similar", _REWARD + " select id, case when 0.1 * negative >= greatest(0.4 * base, 0.3 * neighbours, 0.2 * connected) then 'negative' when 0.2 * connected >= greatest(0.4 * base, 0.3 * neighbours) then 'connected' when 0.3 * neighbours >= 0.4 * base then 'neighbours' else 'base' end as dominant from w"))
def _(spark, d):
    return B.rewards(_reward_inputs(spark, d)).select("id", "dominant")


@query("connectivity_norm", sql("e_replace", ", d as (select id, count(*) as degree from (select src as id from e_replace union all select dst from e_replace) group by 1) select id, round(ln(1 + degree) / ln(1 + (select max(degree) from d)), 6)::double as connectivity from d"))
def _(spark, d):
    degree = HE.degrees(W.replace_classes(spark, d))
    most = degree.agg(F.max("degree").alias("most"))
    return degree.crossJoin(F.broadcast(most)).select("id", F.round(S.connectivity(F.col("degree"), F.col("most")), 6).alias("connectivity"))  # one row


_RUNS = """, i as (select *, sum(ok::int) over (partition by service order by ts, event_id) as island from v_outcome),
 r as (select *, sum((not ok)::int) over (partition by service, island order by ts, event_id) as failures from i),
 s as (select *, case when failures >= 5 then 'offline' when failures >= 3 then 'degraded' else 'healthy' end as status from r)"""


@query("service_status", sql("v_outcome", _RUNS + " select service, event_id, failures, status from s"))
def _(spark, d):
    return C.service_status(W.outcomes(spark, d)).select("service", "event_id", "failures", "status")


@query("degradation_mode", sql("v_outcome", _RUNS + ", l as (select service, arg_max(status, (ts, event_id)) as status from s group by 1) select case when max((service in (0, 1) and status = 'offline')::int) = 1 then 'offline' when max((status = 'offline')::int) = 1 then 'partial' when max((status = 'degraded')::int) = 1 then 'degraded' else 'full' end as mode from l"))
def _(spark, d):
    return C.system_mode(C.latest_status(W.outcomes(spark, d)), [0, 1])


@query("circuit_breaker_trace", sql("v_outcome", """, n as (select service, event_id, ok, epoch_us(ts) / 1000000.0::double as at, row_number() over (partition by service order by ts, event_id) as k from v_outcome),
 b as (select service, event_id, k, case when ok then 'closed' else 'closed' end as state, case when ok then 0 else 1 end as failures, 0.0::double as opened from n where k = 1
   union all select n.service, n.event_id, n.k,
     case when b.state = 'open' and n.at - b.opened < 30 then 'open' when n.ok then 'closed' when b.state = 'open' or b.failures + 1 >= 5 then 'open' else b.state end,
     case when b.state = 'open' and n.at - b.opened < 30 then b.failures when n.ok then 0 else b.failures + 1 end,
     case when b.state = 'open' and n.at - b.opened < 30 then b.opened when n.ok then b.opened when b.state = 'open' or b.failures + 1 >= 5 then n.at else b.opened end
   from b join n on n.service = b.service and n.k = b.k + 1) select service, event_id, state from b"""))
def _(spark, d):
    return C.breaker_trace(W.outcomes(spark, d))


@query("cache_ttl", "with a as (select event_id as key, trunc((epoch_us(timestamp '2024-01-30 00:00:00') - epoch_us(ts)) / 1000000)::bigint as age from events) select key, age, age <= 86400 as fresh from a")
def _(spark, d):
    entries = W.table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("stored_at"))
    return C.cache_state(entries, "2024-01-30 00:00:00", 86400).select("key", "age", "fresh")


@query("cache_hit_ratio", sql("v_outcome", "select service, round(count(*) filter (ok) / count(*), 6)::double as hit_ratio from v_outcome group by 1"))
def _(spark, d):
    n = W.outcomes(spark, d).groupBy("service").agg(F.count_if("ok").alias("h"), F.count_if(~F.col("ok")).alias("m"))
    return n.select("service", F.round(C.hit_ratio(F.col("h"), F.col("m")), 6).alias("hit_ratio"))


@query("retry_stats", "select count(*) as operations, round(count(*) filter (event_type <> 'error') / count(*), 6)::double as success_rate, round(sum(event_id % 3) / count(*), 6)::double as average_retries from events")
def _(spark, d):
    ops = W.table(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3).alias("retries"))
    out = C.retry_stats(ops)
    return out.select("operations", F.round("success_rate", 6).alias("success_rate"), F.round("average_retries", 6).alias("average_retries"))


@query("backoff_delay", "select event_id, (event_id % 12)::int as attempt, least(100.0 * power(2, event_id % 12), 10000.0)::double as delay_ms from events where event_type = 'error'")
def _(spark, d):
    failed = W.table(spark, d, "events").where("event_type = 'error'").withColumn("attempt", (F.col("event_id") % 12).cast("int"))
    return failed.select("event_id", "attempt", S.backoff_ms(F.col("attempt")).alias("delay_ms"))


@query("rolling_latency", sql("v_outcome", ", w as (select service, event_id, round(sum(latency) over (partition by service order by ts, event_id rows between 999 preceding and current row), 2)::double as total, row_number() over (partition by service order by ts, event_id) as seen from v_outcome) select service, event_id, total / least(seen, 1000) as moving, seen from w"))
def _(spark, d):
    out = C.moving_average(W.outcomes(spark, d)).select("service", "event_id", F.round("total", 2).alias("total"), F.col("seen").cast("long").alias("seen"))
    return out.select("service", "event_id", (F.col("total") / F.least("seen", F.lit(1000))).alias("moving"), "seen")


@query("rate_limit_windows", "select epoch_us(time_bucket(interval 6 hour, ts)) as start_us, count(*) as requests, count(*) > 80 as limited from events group by 1")
def _(spark, d):
    events = W.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.rate_limit(events, 21600, 80).select(F.unix_micros("start").alias("start_us"), "requests", "limited")


@query("session_activity", "with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k")
def _(spark, d):
    events = W.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


_DAILY = "select epoch_us(date_trunc('day', ts)) as start_us, event_type, count(*) as n from events group by 1, 2"


@query("daily_event_counts", _DAILY)
def _(spark, d):
    return W.table(spark, d, "events").groupBy(F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("start_us"), "event_type").agg(F.count("*").alias("n"))


def _folder(spark) -> str:
    return io.shared_folder(spark) + "/streams"


@query("stream_counts", _DAILY)
def _(spark, d):
    from fusegrid.streaming import state as T

    out = T.drain(T.window_counts(T.event_stream(spark, d)), ["start", "event_type"], "update", _folder(spark))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_confidence", sql("v_feedback", f"select element_id, round(greatest(0.1, least(0.99, 0.5 + sum({_DELTA}))), 6)::double as confidence from v_feedback group by 1"))
def _(spark, d):
    from fusegrid.streaming import state as T

    out = T.drain(T.feedback_totals(T.event_stream(spark, d)), ["element_id"], "update", _folder(spark))
    return out.select("element_id", F.round(S.updated_confidence(F.lit(0.5), F.col("delta")), 6).alias("confidence"))


@query("stream_circuit_breaker", QUERIES["circuit_breaker_trace"][1])
def _(spark, d):
    from fusegrid.streaming import state as T

    return T.drain(T.breaker(T.event_stream(spark, d)), [], "append", _folder(spark))


@query("stream_cache", """with recursive n as (select user_id as key, event_id, epoch_ms(ts) as asked, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as k from events),
 b as (select key, event_id, k, asked as stored, 'miss' as outcome from n where k = 1
   union all select n.key, n.event_id, n.k, case when n.asked - b.stored <= 86400000 then b.stored else n.asked end, case when n.asked - b.stored <= 86400000 then 'hit' else 'miss' end from b join n on n.key = b.key and n.k = b.k + 1)
 select key, event_id, outcome from b""")
def _(spark, d):
    """Each event asks a cache for its user's entry, which lives a day."""
    from fusegrid.streaming import state as T

    requests = T.event_stream(spark, d).select(F.col("user_id").alias("key"), "event_id", "ts")
    return T.drain(T.cache(requests, 86400), [], "append", _folder(spark)).where("outcome <> 'evicted'").select("key", "event_id", "outcome")


FEEDBACK = "id long, generation_id long, element_id long, feedback_type string, delta double, created_at timestamp_ntz, day date"


def feedback_rows(events):
    """The rows of the feedback table from events, with the change of confidence taken when they are written."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "thumbs_up").when(F.col("event_type") == "error", "thumbs_down")
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("generation_id"), F.get_json_object("props", "$.k").cast("bigint").alias("element_id"), kind.alias("feedback_type"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return B.with_delta(rows.where("feedback_type is not null")).withColumn("day", F.to_date("created_at")).selectExpr(*[x.split()[0] for x in FEEDBACK.split(", ")])


@query("stream_feedback_store", sql("v_feedback", f"select id, generation_id, element_id, feedback_type, {_DELTA}::double as delta, epoch_us(created_at) as created_us from v_feedback where created_at >= timestamp '2024-01-08 00:00:00'"))
def _(spark, d):
    """Feedback written by a stream, its first batch handed in again, days before the bound dropped."""
    from fusegrid.streaming import state as T

    folder = f"{_folder(spark)}/{uuid.uuid4().hex}"
    store = T.UpsertTable(spark, f"{folder}/table", FEEDBACK, "id", "day")
    put = lambda old, new: G.upsert(old, new, "id")
    T.merge_stream(feedback_rows(T.event_stream(spark, d)), store, put, f"{folder}/state")
    store.merge(feedback_rows(W.table(spark, d, "events")), 0, put)
    store.retain("2024-01-08", 1_000_000)
    return store.read().select("id", "generation_id", "element_id", "feedback_type", "delta", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', created_at)").alias("created_us"))


@query("stream_sessions", QUERIES["session_activity"][1].replace("select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k", "select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k having max(ts) + interval 6 hour <= (select max(ts) from events) - interval 1 hour"))
def _(spark, d):
    from fusegrid.streaming import state as T

    return T.drain(T.sessions(T.event_stream(spark, d), "6 hours"), [], "append", _folder(spark)).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("message_decode", """select case when event_id % 5 < 3 then event_id::varchar end as id, case when event_id % 5 < 3 then event_type else 'error' end as type, case when event_id % 5 < 3 then user_id end as timestamp,
  case event_id % 5 when 3 then 'broken {' || event_id when 4 then '{"type": "ping", "n": ' || event_id || '}' else replace(props, ' ', '') end as payload from events""")
def _(spark, d):
    n = F.col("event_id")
    whole = F.concat(F.lit('{"id": "'), n.cast("string"), F.lit('", "type": "'), "event_type", F.lit('", "timestamp": '), F.col("user_id").cast("string"), F.lit(', "payload": '), "props", F.lit("}"))
    line = F.when(n % 5 == 3, F.concat(F.lit("broken {"), n.cast("string"))).when(n % 5 == 4, F.concat(F.lit('{"type": "ping", "n": '), n.cast("string"), F.lit("}"))).otherwise(whole)
    return io.decode_messages(W.table(spark, d, "events").select(line.alias("value")))


@query("statement_lines", "select '<' || p_name || case when p_partkey % 5 = 2 then ' --> [' || p_type || ']>' else ' --> ' || p_type || '>' end as statement, case p_partkey % 5 when 1 then 1.0 when 2 then 0.5 else 1.0 end::double as frequency, case p_partkey % 5 when 1 then 0.99 when 2 then 0.8 else 0.9 end::double as confidence from part where p_partkey % 5 in (1, 2, 3)")
def _(spark, d):
    """A statement file written from the parts, with comments and empty lines, and read again."""
    n = F.col("p_partkey") % 5
    text = lambda form: F.format_string(form, "p_name", "p_type")
    line = F.when(n == 0, text("// %s %s")).when(n == 1, text("<%s --> %s>. {1.0|0.99}")).when(n == 2, text("  <%s --> [%s]>. {0.5|0.8}")).when(n == 3, text("<%s --> %s>.")).otherwise(F.lit(" "))
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    W.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return io.read_statements(spark, path)


_HEX = "md5(url)"
_AS_ID = "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"


@query("uuid_or_nil", f"with i as (select page_id, url, {_HEX} as h from pages) select page_id, case page_id % 3 when 2 then '00000000-0000-0000-0000-000000000000' else {_AS_ID} end as id from i")
def _(spark, d):
    h = F.md5("url")
    own = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.when(F.col("page_id") % 3 == 0, own).when(F.col("page_id") % 3 == 1, F.upper(own)).otherwise(F.concat(own, F.lit("x")))
    return W.table(spark, d, "pages").select("page_id", S.uuid_or_nil(text).alias("id"))


@query("info_values", "select event_id, user_id as hits, case when event_id % 2 = 0 then event_id end as misses from events")
def _(spark, d):
    text = F.concat(F.lit("# Stats\nkeyspace_hits:1\nhits:"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\nmisses:"), F.col("event_id").cast("string"), F.lit("\n"))).otherwise(F.lit("\nmisses:none")))
    return W.table(spark, d, "events").select("event_id", S.info_value(text, "hits").cast("long").alias("hits"), S.info_value(text, "misses").cast("long").alias("misses"))


@query("cache_eviction", "with e as (select event_id as key, ts as stored_at from events), n as (select 7::bigint as key, timestamp '2024-01-30 00:00:00' as stored_at), h as (select count(*) as held from e)"
  " select c.capacity, count(*) filter (e.key <> 7 and (h.held < c.capacity or epoch_us(n.stored_at) - epoch_us(e.stored_at) <= 864000000000)) + 1 as entries from e, n, h, (values (100), (1000000000)) c(capacity) group by 1")
def _(spark, d):
    """A full and a roomy cache after one entry more."""
    entries = W.table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("stored_at"))
    new = spark.range(1).select(F.lit(7).cast("bigint").alias("key"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("stored_at"))
    after = [C.cache_put(entries, new, 864_000, n).agg(F.lit(n).alias("capacity"), F.count("*").alias("entries")) for n in (100, 1_000_000_000)]
    return after[0].unionByName(after[1])


@query("truth_values", sql("v_feedback", """, s as (select element_id, count(*) filter (feedback_type = 'thumbs_up') / count(*) as f, count(*) / (count(*) + 1.0::double) as c from v_feedback group by 1)
  select element_id, case when f >= 0.7 then 'green' when f >= 0.4 then 'yellow' else 'red' end as frequency_color, case when c >= 0.7 then 'green' when c >= 0.4 then 'yellow' else 'red' end as confidence_color,
  round(c * (f - 0.5) + 0.5, 6)::double as expectation, format('%{:.2f};{:.2f}%', f, c) as percent from s"""))
def _(spark, d):
    """Feedback as evidence: frequency of approval, confidence n / (n + 1), their colours and text."""
    n = F.col("ups") + F.col("downs")
    f, c = S.ratio(F.col("ups"), n), S.ratio(n, n + 1)
    e = F.round(S.truth_expectation(f, c), 6).alias("expectation")
    return B.summary(W.feedback(spark, d)).select("element_id", S.truth_color(f).alias("frequency_color"), S.truth_color(c).alias("confidence_color"), e, S.percent_truth(f, c).alias("percent"))
