"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; within its source, documents are dealt to ranges of that
key and sorted in each; prefix sums of sizes over the ranges and then inside each range place every
document, and the source's exact budget cuts the order: whole epochs first, then the documents
before the cut, of the one at the cut only the words that are left.

Defined results: null or empty text has size 0 and nothing is taken of it; a null source is a source
of its own, last in order; repeated rows count each; ties of the key go by id, size and a digest of the text; null ids
are hashed as an empty string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.llm.common import WORD, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 4096
KEY_BITS = 60
SEED = "mix-1"


def random_key(id_col: Column, seed: str = SEED) -> Column:
    """15 hex digits of a digest, as a long: uniform, and the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size, rows)`` with ``target``: sources by code point, null last, weigh in
    turn; a target stops at ``max_epochs`` times its source's size and the excess goes to the others by weight.

    Sources in the order of size / weight stop one after the other as the common level rises, so the
    level is found from running sums. One row a source is all this sorts.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = sizes.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(max_epochs)))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    own = own.withColumn("full", F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    own = own.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("full")) / F.col("left"))
    # the level is that of the first source which does not stop; if all stop there is none
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)
    own = own.withColumn("at", level.getField("level"))
    return own.select("source", "source_size", "rows", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("at") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_range: int = ROWS_PER_RANGE, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns of ``keep``, best short ones: they go through every shuffle) for every document."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    more = [F.col(c).alias(f"_keep_{c}") for c in keep or ()]
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("digest"), *more).withColumn("key", random_key(F.col("doc_id"))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = materialize(targets(sizes).withColumn("ranges", F.ceil(F.col("rows") / F.lit(rows_per_range))))
    # one row a source; sort-merge joins take over where that is too much to send out
    placed = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    width = F.ceil(F.lit(float(2**KEY_BITS)) / F.col("ranges")).cast("long")
    placed = placed.withColumn("range", F.floor(F.col("key") / width).cast("long"))
    per_range = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = per_range.select("source", "range", (F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")).alias("before_range"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "digest")
    local = placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = local.join(before.withColumnRenamed("source", "s").withColumnRenamed("range", "r"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    first = F.col("before_range") + F.col("upto") - F.col("size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - first))
    return full.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep or ()])


ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as weight, source_size * 2.0::double as most from s),
r as (select *, coalesce(sum(most) over (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as stopped,
             sum(weight) over (order by most / weight, source is null, source rows between current row and unbounded following) as open_weight,
             sum(source_size) over () * 1.5::double as want from w),
l as (select *, (want - stopped) / open_weight as level from r),
a as (select *, (select level from l where level * weight < most order by most / weight limit 1) as at_level from l),
t as (select source, source_size, case when at_level is null then most else least(most, at_level * weight) end as target from a),
p as (select d.*, t.source_size, t.target, sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as first
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then round(target)::bigint // source_size else 0 end * size
        + greatest(0, least(size, round(target)::bigint - case when source_size > 0 then round(target)::bigint // source_size else 0 end * source_size - first)))::bigint as taken
from p
"""
