import random

import pytest

from fusegrid.llm import common as C


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 7), (3, 1)])
def test_components_equal_union_find(spark, monkeypatch, seed, most):
    monkeypatch.setattr(C, "STAR_EDGES", most)
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(40)] + [(5, None), (None, 6), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert sorted(map(tuple, C.components(df).collect())) == sorted((x, find(x)) for x in root)
    assert C.components(df.where("false")).count() == 0
