import math
import random

import numpy as np
import pytest

from fusegrid.llm import minhash as M
from tests.llm.conftest import documents
from tests.llm.test_near_copies import near_copies


def brute(texts, percent):
    sets = [M.shingles((t or "").encode()) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return [(i, len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)]


def chains(seed):
    """Texts of which neighbours link and those farther apart do not, and texts that share just too little."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(4):
        long = r.sample(words, 260)
        out += [" ".join(long[k : k + 200]) for k in range(0, 60, 6)]
        half = r.sample(words, 150)
        out += [" ".join(half + r.sample(words, 50)) for _ in range(12)]
    return out


@pytest.mark.parametrize("bounds", [{}, {"MEMBERS": 3}, {"MEMBERS": 3, "MOST_BLOCKS": 1, "BLOCK": 4}])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(M, name, value)
    texts = near_copies(seed) + chains(seed)
    want = brute(texts, 85)
    assert 20 < sum(not w[3] for w in want)
    assert sorted(tuple(r) for r in M.near_copies(documents(spark, texts), 85).collect()) == want


def test_second_round_finds_every_link(spark, monkeypatch):
    texts = chains(3) + near_copies(3)
    sets = [M.shingles((t or "").encode()) for t in texts]
    docs = documents(spark, texts)
    own = M.features(docs.select("doc_id", "text")).where("n > 0").withColumnRenamed("doc_id", "rep")
    members = M._bands(own).join(M._signs(docs).drop("n"), "rep").selectExpr("band", "rep", "n", "rep as component", "sign")
    pairs = {(r["a"], r["b"]) for r in M.candidates(members, 85).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i]) and len(sets[j]) and M.links(sets[i], sets[j], 85)}
    assert want and pairs >= want and len(pairs) < len(sets) ** 2 / 8


def test_posterior_bound():
    for hashes in range(M.BATCH, M.HASHES + 1, M.BATCH):
        least = M.least_matches(85, hashes, M.MISS)
        # the posterior by summing the density over a grid of similarities
        s = (np.arange(200_000) + 0.5) / 200_000
        for m, enough in ((least, True), (least - 1, False)):
            log = m * np.log(s) + (hashes - m) * np.log(1 - s)
            density = np.exp(log - log.max())
            assert (density[s >= 0.85].sum() / density.sum() >= M.MISS) == enough
        miss = sum(math.comb(hashes, m) * 0.85**m * 0.15 ** (hashes - m) for m in range(least))
        assert miss < 3 * M.MISS
    assert (1 - 0.85**M.ROWS) ** M.BANDS < 1e-8


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    for share in (0.5, 0.85, 0.95):
        found = []
        for _ in range(40):
            x = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
            k = round(len(x) * 2 * share / (1 + share))
            y = np.concatenate([x[:k], r.integers(0, 2**63, len(x) - k).astype(np.uint64)])
            found.append((M.signature(x) == M.signature(y)).mean())
        assert abs(np.mean(found) - share) < 0.03


def test_repeated_and_null_ids_and_empty(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (3, text), (3, "other words are here now ok"), (9, "other words are here now ok"), (1, text), (7, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in M.near_copies(docs).collect())
    assert rows == [(-1, None, True), (1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True), (9, 1, False)]
    assert M.near_copies(docs.where("false")).count() == 0
