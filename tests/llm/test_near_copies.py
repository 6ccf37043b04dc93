import random
import re

import pytest

from fusegrid.llm import ngram_join as J
from tests.llm.conftest import ODD, documents


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def near_copies(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(r.choice([5, 8, 40, 120, 400]))]
        for _ in range(r.randint(1, 7)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.4:
                own = own[: r.randint(1, len(own))]
            if r.random() < 0.3:
                own += passage
            texts.append(" ".join(own).upper() if r.random() < 0.2 else "\n".join(own))
    texts += [" ".join([word() for _ in range(30)] + passage) for _ in range(20)]
    return texts


@pytest.mark.parametrize(("seed", "frequent"), [(1, 40), (2, 2)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "MEMBERS_PER_TREE", 3)
    monkeypatch.setattr(J, "ROWS_PER_TREE", 4)
    texts = near_copies(seed)
    n, comp = brute(texts)
    rows = J.jaccard_components(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (n[i], comp[i]) for i in range(len(texts))}


@pytest.mark.parametrize("rows_per_tree", [3, 512])
def test_trees_find_every_link(spark, monkeypatch, rows_per_tree):
    monkeypatch.setattr(J, "band_keys", lambda s: [])  # so nothing is joined before the second round
    monkeypatch.setattr(J, "ROWS_PER_TREE", rows_per_tree)
    texts = near_copies(4)
    n, comp = brute(texts)
    docs = documents(spark, texts)
    known = docs.select("doc_id", "text")
    labelled = known.selectExpr("doc_id", "text", "doc_id as component")
    found = J.blocks(labelled, J.frequent_shingles(labelled))
    pairs = {(r["a"], r["b"]) for r in J.candidates(known, found).collect()}
    sets = [J.shingles((t or "").encode()) for t in texts]
    assert pairs >= {(i, j) for j in range(len(texts)) for i in range(j) if J.links(sets[i], sets[j])}
    assert {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect()} == dict(enumerate(comp))


def test_traversal_equals_all_pairs():
    r = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    base = [r.choices(words, k=r.randint(5, 300)) for _ in range(30)]
    texts = [" ".join(w if r.random() > 0.03 else "other" for w in b[: r.randint(len(b) * 3 // 4, len(b))]) for b in base for _ in range(6)]
    sets = [J.shingles(t.encode()) for t in texts]
    n, comp = J.np.array([len(s) for s in sets]), J.np.arange(len(sets))
    bits = J.np.frombuffer(b"".join(map(J.bitmap, sets)), J.np.uint64).reshape(len(sets), -1)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if J.links(sets[i], sets[j])}
    one = J.SignatureTree(bits, n, comp)
    got = {(i, j) for x, y in J.candidates_between(one, one) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert want and got >= want and len(got) < len(sets) * (len(sets) - 1) // 4
    for cut in (1, 50, 170):  # trees of different heights
        two = J.SignatureTree(bits[:cut], n[:cut], comp[:cut]), J.SignatureTree(bits[cut:], n[cut:], comp[cut:])
        across = {(i, j + cut) for x, y in J.candidates_between(*two) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        assert across >= {(i, j) for i, j in want if i < cut <= j}


def test_words_of_one_polynomial_hash_are_told_apart():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = (J.shingles(f"{w} one two three four".encode()) for w in (word, other))
    assert a != b and not J.links(a, b)
    assert len(J.word_hashes(b"abcdefgh abcdefghi abcdefghj abcdefg abcdefgh")) == 5
    assert len(set(J.word_hashes(b"abcdefgh abcdefghi abcdefghj abcdefg abcdefgh").tolist())) == 4


def test_repeated_and_null_ids_and_empty(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (3, text), (3, "other words are here now ok"), (9, "other words are here now ok"), (1, text)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert rows == [(-1, None), (1, 1), (3, 1), (3, 1), (9, 1)]
    assert J.jaccard_components(docs.where("false")).count() == 0
