"""Known values of single operators."""

import pytest
from pyspark.sql import functions as F

from fusegrid.functions import scalar as S
from fusegrid.functions import vectors as V
from fusegrid.operators import evaluation as X
from fusegrid.operators import feedback as B
from fusegrid.operators import fusion as H


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else row


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_final_score(spark):
    assert one(spark, x=S.final_score(*lit(0.8, 0.6, 0.4))) == pytest.approx(0.66)


@pytest.mark.parametrize(("old", "kind", "new"), [(0.5, "thumbs_up", 0.6), (0.5, "thumbs_down", 0.35), (0.95, "thumbs_up", 0.99), (0.15, "thumbs_down", 0.1)])
def test_confidence_update(spark, old, kind, new):
    assert one(spark, x=S.updated_confidence(F.lit(old), S.feedback_delta(F.lit(kind)))) == pytest.approx(new)


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        S.updated_confidence(F.lit(0.5), F.lit(0.1), 0.9, 0.2)
    with pytest.raises(ValueError):
        S.decay(1.5, F.lit(1))


@pytest.mark.parametrize(("parts", "want"), [((0.8, 0.7, 0.5, 0.1), 0.62), ((1, 1, 1, 0), 0.9), ((0.2, 0.1, 0.1, 0.8), 0.05), ((0, 0, 0, 1), 0.0)])
def test_reward(spark, parts, want):
    assert one(spark, x=S.reward(*lit(*parts))) == pytest.approx(want)


def test_weights():
    assert S.weights_valid((0.5, 0.3, 0.2)) and not S.weights_valid((0.5, 0.6))
    assert S.normalised_weights((1, 1, 2)) == (0.25, 0.25, 0.5)


@pytest.mark.parametrize(("count", "most", "want"), [(0, 100, 0.0), (100, 100, 1.0), (10, 0, 0.0)])
def test_connectivity(spark, count, most, want):
    assert one(spark, x=S.connectivity(F.lit(count), F.lit(most))) == pytest.approx(want)


def test_nearest_rank(spark):
    values = F.array(*[F.lit(float(i)) for i in range(10, 0, -1)])
    assert [one(spark, x=S.nearest_rank(values, p)) for p in (0.5, 0.95, 0.99)] == [6.0, 10.0, 10.0]
    frame = spark.createDataFrame([(i % 2, float(i)) for i in range(1, 21)], "g int, v double")
    rows = {r["g"]: (r["p50"], r["p95"]) for r in X.nearest_rank_percentiles(frame, "v", ["g"]).collect()}
    assert rows == {0: (12.0, 20.0), 1: (11.0, 19.0)}  # of ten values the sixth and the tenth


def test_improvement(spark):
    assert one(spark, a=S.improvement_percent(*lit(0.5, 0.75)), b=S.improvement_percent(*lit(0, 0.5))) == (50.0, 0.0)


def test_backoff(spark):
    assert [r[0] for r in spark.range(3).select(S.backoff_ms(F.col("id"))).collect()] == [100.0, 200.0, 400.0]


def test_query_metrics(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 9], 5.0), (2, [1], [], 7.0)], "query_id int, expected array<int>, returned array<int>, latency double")
    rows = {r["query_id"]: r for r in X.query_metrics(df).collect()}
    assert rows[1]["precision"] == rows[1]["recall"] == pytest.approx(2 / 3) and rows[1]["f1"] == pytest.approx(2 / 3) and rows[1]["hallucination"] == pytest.approx(1 / 3)
    assert (rows[2]["precision"], rows[2]["f1"], rows[2]["hallucination"]) == (0.0, 0.0, 0.0)
    assert X.aggregate(X.query_metrics(df)).first()["p50"] == 7.0
    assert X.aggregate(X.query_metrics(df.where("false"))).first()["mean_f1"] == 0.0


def history(spark, kinds, key=1):
    rows = [(i, key, k, f"2024-01-0{1 + i // 2} 00:00:0{i}") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "id int, element_id int, feedback_type string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))


def test_feedback(spark):
    up, down = "thumbs_up", "thumbs_down"
    assert B.cumulative(history(spark, [up, up, down])).first()["confidence"] == pytest.approx(0.55)
    assert B.sequential(history(spark, [up, up, down, up, up])).first()["confidence"] == pytest.approx(0.75)
    assert B.sequential(history(spark, [up] * 6 + [down])).first()["confidence"] == pytest.approx(0.84)
    m = B.metrics(history(spark, [up, up, down])).first()
    assert m["positive_ratio"] == pytest.approx(2 / 3) and m["fixed_average"] == pytest.approx(0.05 / 3)
    assert B.metrics(history(spark, [up]).where("false")).first()["positive_ratio"] == 0.0


def test_propagation(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 0), (0, 0)], "src int, dst int")
    rows = B.propagate(edges, spark.createDataFrame([(0, 0.1)], "id int, delta double")).collect()
    assert {r["id"]: (r["hop"], round(r["delta"], 6)) for r in rows} == {1: (1, 0.05), 2: (2, 0.025)}
    down = B.propagate(edges, spark.createDataFrame([(0, -0.15)], "id int, delta double"), hops=1).first()
    assert down["delta"] == pytest.approx(-0.075)
    changed = B.apply_changes(B.propagate(edges, spark.createDataFrame([(0, 0.1)], "id int, delta double")), spark.createDataFrame([(1, 0.98)], "id int, confidence double"))
    assert {r["id"]: round(r["new"], 6) for r in changed.collect()} == {1: 0.99, 2: 0.525}


def test_max_fusion(spark):
    rows = [(1, 7, 0.5, "vector"), (1, 7, 0.7, "graph"), (1, 8, 0.4, "graph"), (1, 8, 0.4, "vector")]
    out = H.dedup(spark.createDataFrame(rows, "query_id int, element_id int, final_score double, source string")).collect()
    assert {(r["element_id"], r["final_score"], r["source"]) for r in out} == {(7, 0.7, "graph"), (8, 0.4, "vector")}


def test_vectors(spark):
    a, b = F.array(*lit(1, 0)), F.array(*lit(0, 2))
    assert one(spark, s=V.cosine(a, a), o=V.cosine(a, b), z=V.cosine(a, F.array(*lit(0, 0))), d=V.cosine(a, F.array(*lit(1)))) == (1.0, 0.0, 0.0, 0.0)
    assert one(spark, e=V.euclid(a, b), m=V.manhattan(a, b), t=V.dot(a, b)) == (pytest.approx(5**0.5), 3.0, 0.0)
    assert one(spark, n=V.norm(V.hash_embedding(F.lit("x"), 128))) == pytest.approx(1.0)


def test_terms(spark):
    assert one(spark, a=S.sanitize_term(F.lit("a-b.c #d:/(e)")), b=S.capitalize(F.lit("date-picker"))) == ("a_b_c_d__e", "Date-picker")
    assert one(spark, a=S.truth_expectation(*lit(1, 0.9)), b=S.shorten(F.lit("x" * 20))) == (pytest.approx(0.95), "x" * 12 + "...")
    assert one(spark, a=S.ensure_question(F.lit("<a --> b>")), b=S.ensure_question(F.lit("<a --> b>?"))) == ("<a --> b>?", "<a --> b>?")
    assert one(spark, a=S.dominant({"x": F.lit(0.2), "y": F.lit(0.2), "z": F.lit(0.1)})) == "y"
    names = ["mui", "TailwindCSS", "", "foundation"]
    assert [one(spark, x=S.collection_of(F.lit(n))) for n in names] == ["material-ui", "tailwind", "custom", None]


def test_hash_embedding_equals_plain_python(spark):
    import hashlib

    text, size = "a blue card", 100
    h = hashlib.md5(text.encode()).hexdigest()
    raw = [(int(hashlib.md5(f"{h}:{i // 64}".encode()).hexdigest()[:15], 16) + i % 64) % 10000 / 5000 - 1 for i in range(size)]
    length = sum(x * x for x in raw) ** 0.5
    assert one(spark, v=V.hash_embedding(F.lit(text), size)) == pytest.approx([x / length for x in raw])


def test_cache_gives_up_expired_entries_only_when_full(spark):
    from fusegrid.operators import health as C

    at = lambda second: f"timestamp_ntz'2024-01-01 00:00:{second:02d}'"
    held = spark.sql(f"select * from values (1L, {at(0)}), (2L, {at(50)}), (3L, {at(55)}) t(key, stored_at)")
    put = lambda key, capacity: sorted(r["key"] for r in C.cache_put(held, spark.sql(f"select {key}L as key, {at(59)} as stored_at"), 10, capacity).collect())
    assert put(4, 4) == [1, 2, 3, 4]
    assert put(4, 3) == [2, 3, 4]
    assert put(4, 1) == [2, 3, 4]  # more than its capacity
    assert put(2, 3) == [2, 3]
    assert sorted(r["key"] for r in C.cache_put(held.where("false"), held.where("key = 1"), 10, 0).collect()) == [1]


def test_delete_points_counts_what_was_asked(spark):
    from fusegrid.operators import vector_search as K

    left, asked = K.delete_points(spark.range(5), spark.createDataFrame([(1,), (1,), (9,)], "id long"))
    assert (sorted(r["id"] for r in left.collect()), asked) == ([0, 2, 3, 4], 3)


def test_scores_are_rounded_as_doubles_are(spark, data_dir):
    """Every size and degree of a candidate, as SQL rounds them: many scores are a half at the seventh digit, or a double beside it."""
    duckdb = pytest.importorskip("duckdb")
    parts = spark.range(800).select(F.lit(0.5).alias("narsese_confidence"), (F.floor(F.col("id") / 16) / 64.0).alias("similarity"), (F.col("id") % 16 / 16.0).alias("graph_degree"), "id")
    got = {r.id: r.s for r in H.rank(parts).select("id", S.rounded(F.col("final_score"), 6).alias("s")).collect()}
    assert got == dict(duckdb.sql("select i, round(0.5 * 0.5 + 0.3 * (i // 16 / 64.0::double) + 0.2 * (i % 16 / 16.0::double), 6)::double from range(800) t(i)").fetchall())
    assert one(spark, x=S.rounded(F.lit(-2.5), 0)) == -3 and one(spark, x=S.rounded(F.lit(None).cast("double"), 6)) is None
