"""Feedback: summaries, metrics, cumulative and sequential confidence, propagation with decay, rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import scalar as S
from fusegrid.operators.graph import k_hop


def with_delta(feedback: DataFrame) -> DataFrame:
    return feedback.withColumn("delta", S.feedback_delta(F.col("feedback_type")))


def retain(feedback: DataFrame, now, days: int) -> DataFrame:
    """Without rows older than so many days before ``now``."""
    return feedback.where(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def summary(feedback: DataFrame, key: str = "element_id") -> DataFrame:
    up, down = F.count_if(F.col("feedback_type") == "thumbs_up"), F.count_if(F.col("feedback_type") == "thumbs_down")
    return with_delta(feedback).groupBy(key).agg(up.alias("ups"), down.alias("downs"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("net_delta"), F.max("created_at").alias("last_at"))


def metrics(feedback: DataFrame) -> DataFrame:
    """total, ups, downs, ratios (0 without rows), average delta; the sum as kept in ten-thousandths, cut toward zero."""
    up, down = F.count_if(F.col("feedback_type") == "thumbs_up"), F.count_if(F.col("feedback_type") == "thumbs_down")
    fixed = F.coalesce(F.sum((F.col("delta") * F.lit(10000.0)).cast("bigint")), F.lit(0)) / F.lit(10000.0)
    out = with_delta(feedback).agg(F.count("*").alias("total"), up.alias("ups"), down.alias("downs"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("net"), fixed.alias("fixed_net"))
    n = F.col("total")
    out = out.select("total", "ups", "downs", "net", "fixed_net", S.ratio(F.col("ups"), n).alias("positive_ratio"), S.ratio(F.col("downs"), n).alias("negative_ratio"), S.ratio(F.col("net"), n).alias("average_delta"), S.ratio(F.col("fixed_net"), n).alias("fixed_average"))
    return out.withColumn("net_impact", F.col("fixed_average") * n)


def cumulative(feedback: DataFrame, start: float = 0.5, key: str = "element_id") -> DataFrame:
    """Sum of deltas, then one clamp."""
    return with_delta(feedback).groupBy(key).agg(F.sum("delta").alias("_d")).select(key, S.updated_confidence(F.lit(start), F.col("_d")).alias("confidence"))


def sequential(feedback: DataFrame, start: float = 0.5, key: str = "element_id", low: float = 0.1, high: float = 0.99) -> DataFrame:
    """A clamp at every event in the order of time and id.

    A clamped step is a map x -> min(high, max(low, x + d)); such maps compose to one of the same form, so that
    events are first folded within minutes, these within hours, these within days, and then the days: no key's history has to fit one row.
    """
    # as (shift, floor, ceiling): x -> min(ceiling, max(floor, x + shift))
    one = F.struct(F.lit(0.0).alias("d"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))
    put = lambda a, b: F.struct(  # noqa: E731  first a, then b
        (a["d"] + b["d"]).alias("d"),
        F.least(b["hi"], F.greatest(b["lo"], a["lo"] + b["d"])).alias("lo"),
        F.least(b["hi"], F.greatest(b["lo"], a["hi"] + b["d"])).alias("hi"),
    )
    step = F.struct(F.col("delta").alias("d"), F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    fold = lambda order: F.aggregate(F.array_sort(F.collect_list(F.struct(*order, "f"))), one, lambda a, e: put(a, e["f"])).alias("f")
    rows = with_delta(feedback).select(key, "created_at", "id", step.alias("f"))
    order = ["created_at", "id"]
    for unit in ("minute", "hour", "day"):  # a row holds a key's events of a minute, then its minutes of an hour, its hours of a day
        rows = rows.withColumn("_t", F.date_trunc(unit, order[0])).groupBy(key, "_t").agg(fold(order)).withColumnRenamed("_t", unit)
        order = [unit]
    whole = rows.groupBy(key).agg(fold(order))
    return whole.select(key, F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.lit(start) + F.col("f.d"))).alias("confidence"))


def propagate(edges: DataFrame, sources: DataFrame, factor: float = 0.5, hops: int = 2) -> DataFrame:
    """(source, id, hop, delta) from sources(id, delta): the source's change, less with every hop."""
    reached = k_hop(edges, sources, hops)
    return reached.join(sources.select(F.col("id").alias("source"), "delta"), "source").select("source", "id", "hop", (F.col("delta") * S.decay(factor, F.col("hop"))).alias("delta"))


def apply_changes(changes: DataFrame, confidence: DataFrame) -> DataFrame:
    """(source, id, hop, old, new, delta) from the snapshot confidence(id, confidence); 0.5 where there is none."""
    old = F.coalesce("confidence", F.lit(0.5))
    new = S.updated_confidence(old, F.col("delta"))
    return changes.join(confidence, "id", "left").select("source", "id", "hop", old.alias("old"), new.alias("new"), (new - old).alias("actual_delta"))


def reward_inputs(confidence: DataFrame, similar: DataFrame, degrees: DataFrame, feedback: DataFrame) -> DataFrame:
    """(id, base, neighbours, connected, negative): own confidence, mean of neighbours', connectivity, share of thumbs down."""
    near = similar.join(confidence, similar["dst"] == confidence["id"]).groupBy("src").agg(F.avg("confidence").alias("near"))
    most = degrees.agg(F.max("degree").alias("most"))
    linked = degrees.crossJoin(F.broadcast(most)).select(F.col("id").alias("_i"), S.connectivity(F.col("degree"), F.col("most")).alias("connected"))  # one row
    share = summary(feedback).select(F.col("element_id").alias("_e"), S.ratio(F.col("downs"), F.col("ups") + F.col("downs")).alias("negative"))
    out = confidence.join(near, confidence["id"] == near["src"], "left").join(linked, F.col("id") == F.col("_i"), "left").join(share, F.col("id") == F.col("_e"), "left")
    return out.select("id", F.col("confidence").alias("base"), F.coalesce("near", F.lit(0.0)).alias("neighbours"), F.coalesce("connected", F.lit(0.0)).alias("connected"), F.coalesce("negative", F.lit(0.0)).alias("negative"))


def rewards(inputs: DataFrame) -> DataFrame:
    b, s, c, n = (F.col(x) for x in ("base", "neighbours", "connected", "negative"))
    value = S.reward(b, s, c, n)
    parts = {"base": 0.4 * b, "neighbours": 0.3 * s, "connected": 0.2 * c, "negative": 0.1 * n}
    out = inputs.withColumn("reward", value).withColumn("dominant", S.dominant(parts))
    return out.withColumn("level", F.when(F.col("reward") > 0.7, "high").when(F.col("reward") < 0.3, "low").otherwise("middle")).withColumn("quick", 0.4 * b)
