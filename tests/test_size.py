"""What keeps queries whole on larger tables: no table of theirs through the driver, no pairs that move, work dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from fusegrid.operators import extraction as E
from fusegrid.operators import graph as G
from fusegrid.operators import hyperedges as HE
from fusegrid.operators import vector_search as K
from fusegrid.operators.embedding_cache import EmbeddingCache
from fusegrid.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["category_rules", "embedding_text", "narsese_generate"])
def test_a_mapping_sends_no_table_to_every_executor(spark, data_dir, name):
    assert "Broadcast" not in plan(catalog.queries()[name](spark, data_dir))


def test_systems_of_pages_are_merged_with_their_elements(spark):
    nodes = spark.createDataFrame([(1, "button", 0), (2, "a", 0), (2, "p", 1)], "page_id long, tag string, depth int")
    nodes = nodes.select("*", *[F.array().cast("array<string>").alias(c) for c in ("classes", "names", "vals")])
    systems = spark.range(1, 3).selectExpr("id as page_id", "if(id = 1, 'tailwind', 'custom') as design_system", "id = 1 as interactive")  # known to be small
    out = E.map_elements(nodes, systems)
    assert "Broadcast" not in plan(out)
    assert sorted(out.select("page_id", "element_type", "interactive").collect()) == [(1, "tailwind-button", True), (2, "custom-link", False)]


@pytest.mark.parametrize("name", ["delete_edges", "upsert_edges"])
def test_pairs_of_a_class_move_nowhere(spark, data_dir, name):
    text = plan(catalog.queries()[name](spark, data_dir))
    assert text.count("Inner") == 1  # they are made once,
    assert 0 < text.index("Inner") < text.index("Exchange")  # by a join after all shuffles


def test_stars_are_edges_to_the_others_of_a_class(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "class string, id long")
    old = members.selectExpr("class", "id as src", "'R' as rel_type", "0.5D as score")
    merged = G.upsert_edges(old, old.where("src = 1").withColumn("score", F.lit(0.9)), ("class", "src", "rel_type"))
    assert sorted(map(tuple, HE.edges_of(merged, members).collect())) == [(s, d, "R", 0.9 if s == 1 else 0.5) for s in (1, 2, 3) for d in (1, 2, 3) if s != d]
    into = members.selectExpr("class", "id as dst", "'R' as rel_type")
    left = G.delete_edges(into, into.where("dst = 2"), ("class", "dst", "rel_type"))
    assert sorted(map(tuple, HE.edges_of(left, members, "dst").collect())) == [(1, 3, "R"), (2, 1, "R"), (2, 3, "R"), (3, 1, "R")]


@pytest.mark.parametrize("name", ["query_context", "query_terms", "statements_from_query", "template_lookup", "css_tokens", "script_functions"])
def test_texts_are_dealt_to_tasks_before_they_are_looked_through(spark, data_dir, name):
    text = plan(catalog.queries()[name](spark, data_dir))
    below = text[text.index("RoundRobinPartitioning") :]
    assert "RLIKE" not in below and "MapInArrow" not in below


def test_captured_terms_are_looked_for_once_a_text(spark, data_dir):
    text = catalog.queries()["query_context"](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in text and "array_contains(concat(" not in text


def test_vectors_meet_in_blocks_as_large_as_a_task_holds():
    assert K.blocks((100, 64), (100, 64)) == (1, 1)
    assert K.blocks((40_000, 64), (40_000, 64)) == (6, 6)  # enough tasks
    assert K.blocks((720_000, 64), (720_000, 64)) == (22, 22)  # each vector moved 22 times, not 176
    assert K.blocks((3, 64), (200_000, 64)) == (1, 36)
    assert K.blocks((0, 1), (0, 1)) == (1, 1)


def test_a_cache_gives_columns_made_of_embeddings(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, text string")
    cache = EmbeddingCache(spark, str(tmp_path))
    whole = {r.id: r.embedding[0] for r in cache.get_or_compute(texts, 1)[0].collect()}
    rows, counts = cache.get_or_compute(texts, 2, want=[F.get("embedding", F.lit(0)).alias("first")])
    assert rows.columns == ["id", "digest", "first"] and {r.id: r["first"] for r in rows.collect()} == whole
    assert counts == {"texts": 3, "distinct": 2, "hits": 2, "misses": 0}
    text = plan(rows)
    assert text.rindex("AS first") > text.index("Join")  # made below the join


@pytest.mark.parametrize("name", ["page_extraction", "ontology_map", "page_statements"])
def test_pages_are_read_once_and_what_is_left_moves_once_to_a_given_number_of_tasks(spark, data_dir, name):
    text = plan(catalog.queries()[name](spark, data_dir))
    assert text.count("FileScan parquet") == text.count("Exchange") == text.count("REPARTITION_BY_NUM") == 1 and "Join" not in text


def test_pages_of_one_id_meet_and_a_null_id_has_no_elements(spark):
    pages = spark.createDataFrame([(1, '<p class="BTN-a">x</p><p>y</p>'), (1, "<style>a{--x:1px;b:c}</style>"), (None, "<p>z</p><style>a{b:c}</style>"), (2, "")], "page_id long, html string")
    elements = E.extract(pages)
    assert sorted(map(tuple, elements.select("page_id", "node_id", "tag", "element_type").collect())) == [
        (1, 0, "p", "bootstrap-button"), (1, 0, "p", "unknown-button"), (1, 0, "style", "bootstrap-unknown"), (1, 0, "style", "unknown-unknown"), (1, 1, "p", "bootstrap-text"), (1, 1, "p", "unknown-text")]
    assert sorted(map(tuple, E.page_statements(pages).collect())) == sorted(map(tuple, E.statements(elements).collect()))
    full = {r["page_id"]: (r["elements"], r["rules"], len(r["tokens"]), r["statements"], r["text"] != "") for r in E.extract_full(pages, 16).collect()}
    assert full == {1: (6, 2, 1, E.statements(elements).count() + 1, True), None: (0, 0, 0, 0, False), 2: (0, 0, 0, 0, False)}
