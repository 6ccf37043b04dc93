"""The tables of a hybrid search grow: neither elements nor degrees go through the driver."""

from pyspark.sql import functions as F

from fusegrid.operators import fusion as H


def test_elements_and_degrees_are_not_broadcast(spark):
    elements = spark.range(50).select(F.col("id").alias("element_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("c").alias("category"), F.array(F.lit("t")).alias("tags"))
    degrees = spark.range(50).select("id", F.lit(5).alias("degree"))
    near = spark.range(3).select(F.lit(1).alias("query_id"), "id", F.lit(0.5).alias("score"))
    asked = spark.createDataFrame([(1, ["c"], [])], "query_id int, categories array<string>, attributes array<string>")
    vector, graph = H.vector_candidates(near, elements), H.graph_candidates(asked, elements, degrees)
    assert {r["element_id"] for r in vector.collect()} == {0, 1, 2} and {r["graph_degree"] for r in graph.collect()} == {0.1}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(vector) and "Broadcast" not in plan(vector)
    assert "SortMergeJoin" in plan(graph)
