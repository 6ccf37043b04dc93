"""The neighbour graph against the exact join, and hyperedges against pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from fusegrid.operators import feedback as B
from fusegrid.operators import graph as G
from fusegrid.operators import hyperedges as HE
from fusegrid.operators.neighbour_graph import _working, knn_graph
from fusegrid.operators.vector_search import knn_join


def vectors(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<double>").repartition(4)


def test_graph_finds_nine_of_ten_with_few_pairs(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(5000, 5)) @ r.normal(size=(5, 24)) + 0.05 * r.normal(size=(5000, 24))  # few directions that count, as embeddings have
    rows = knn_graph(vectors(spark, v), 5, width=12, sample=6).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    truth = np.argsort(-s, axis=1, kind="stable")[:, :5]
    hits = sum(i in set(truth[q]) for q, i in zip(rows["query_id"], rows["id"], strict=True))
    assert len(rows) == 25000 and hits / 25000 >= 0.9
    assert abs(rows["recall"].iloc[0] - hits / 25000) < 0.05 and rows["scored_share"].iloc[0] < 0.3
    assert all(abs(s[q, i] - x) < 1e-6 for q, i, x in zip(rows["query_id"], rows["id"], rows["score"], strict=True))
    assert rows.groupby("query_id")["rank"].max().eq(5).all() and (rows["query_id"] != rows["id"]).all()


def test_small_equal_and_missing_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 2.0]), (101, [0.0, 1.0]), (102, None), (None, [1.0, 1.0]), (101, [0.0, 1.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in knn_graph(points, 2).collect()}
    want = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in knn_join(points.where("id is not null and vector is not null").distinct(), points.where("id is not null and vector is not null").distinct(), 2).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and got[(100, 1)] == (101, 1.0)
    assert knn_graph(points.where("id = 100"), 2).count() == 0 and knn_graph(points.where("false"), 2).count() == 0


def shuffled(spark):
    """Bytes that tasks of this session have shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in iter_seq(context.statusStore().executorList(False)))


def iter_seq(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_vectors_move_in_two_bytes_a_component_and_edges_once(spark):
    v = np.random.default_rng(2).normal(size=(1500, 96))
    points = vectors(spark, v)
    before = shuffled(spark)
    rows = knn_graph(points, 3, width=12, sample=6, rounds=3).toPandas()
    assert (shuffled(spark) - before) / 1500 < 17 * 96 * 8  # bytes a point: the vectors of 17 points as doubles; it was 25, now 13
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(abs(u[q] @ u[i] - x) <= 5.1e-7 for q, i, x in zip(rows["query_id"], rows["id"], rows["score"], strict=True))


def test_scores_nearer_than_a_step_are_told_apart_on_whole_vectors(spark):
    angles = [0.0] + [0.3 + 4e-6 * i for i in range(20)]  # from 0: cosines that differ by a millionth, in steps often equal or in the other order
    points = spark.createDataFrame([(99 - i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)] + [(200, [float("nan"), 1.0])], "id long, vector array<double>")
    got = [(r["id"], r["score"]) for r in knn_graph(points, 3).where("query_id = 99").orderBy("rank").collect()]
    scores = {99 - i: round(float(np.cos(a)), 6) for i, a in enumerate(angles)}
    assert got == sorted(((i, s) for i, s in scores.items() if i != 99), key=lambda x: (-x[1], x[0]))[:3]


def test_groups_without_a_pair_to_score_do_not_move(spark):
    rows = [(1, 1, True), (1, 2, False), (1, 2, True), (2, 1, False), (2, 2, False), (3, 1, True), (4, 5, True), (4, 6, False)]
    kept = _working(spark.createDataFrame(rows, "centre long, id long, fresh boolean")).collect()
    assert sorted(map(tuple, kept)) == [(1, 1, True), (1, 2, True), (4, 5, True), (4, 6, False)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hyperedges_equal_pairs(spark, seed):
    r = random.Random(seed)
    members = [(f"c{r.randrange(6)}", i) for i in range(60) if r.random() < 0.8]
    edges = [(r.randrange(70), r.randrange(70)) for _ in range(60)]
    classes = defaultdict(list)
    for c, i in members:
        classes[c].append(i)
    pairs = [(a, b) for m in classes.values() for a in m for b in m if a != b]
    of = spark.createDataFrame(members, "class string, id long")
    link = spark.createDataFrame(edges, "src long, dst long")
    both = link.union(spark.createDataFrame(pairs, "src long, dst long"))
    assert HE.edge_count(of).first()["edges"] == len(pairs)
    as_pairs = spark.createDataFrame(pairs, "src long, dst long")
    assert sorted(map(tuple, HE.degrees(of).collect())) == sorted(map(tuple, G.degrees(as_pairs).collect()))
    sources = spark.createDataFrame([(i, 0.1 if i % 2 else -0.2) for i in range(0, 70, 3)], "id long, delta double")
    confidence = spark.createDataFrame([(i, i / 100) for i in range(0, 70, 2)], "id long, confidence double")
    for hops in (1, 2, 3):
        want = B.apply_changes(B.propagate(both, sources, hops=hops), confidence)
        got = HE.propagate(link, of, sources, confidence, hops=hops)
        shown = lambda df: sorted((x["source"], x["id"], x["hop"], round(x["old"], 9), round(x["new"], 9), round(x["actual_delta"], 9)) for x in df.collect())
        assert shown(got) == shown(want)


def test_no_pairs_are_shuffled(spark):
    """A class of 2,000 members reached by 50 sources: 100,000 rows out, none of which is exchanged."""
    of = spark.range(2000).selectExpr("'one' as class", "id")
    sources = spark.range(50).selectExpr("id", "0.1D as delta")
    edges = spark.createDataFrame([(0, 5000)], "src long, dst long")
    out = HE.propagate(edges, of, sources, sources.selectExpr("id", "0.5D as confidence"), hops=1)
    assert out.count() == 50 * 1999 + 1
    listed, classes = HE.reach(edges, of, sources, 1)
    assert listed.count() == 1 and classes.count() == 50
    gone = spark.range(500).selectExpr("id as element_id")
    nodes, left = HE.delete_nodes(spark.range(2000).selectExpr("id as element_id"), of, gone, "element_id")
    assert nodes.count() == 1500 and HE.edge_count(left).first()["edges"] == 1500 * 1499
