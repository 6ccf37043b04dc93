"""Shingles of many texts at once; how often the join picks the texts of all classes."""

import numpy as np

from fusegrid.llm import ngram_join as J
from tests.llm.conftest import ODD, documents


def test_texts_hashed_together(monkeypatch):
    texts = [(t or "").encode() for t in ODD + ["a b c d", "a b c d e", "A b c D e f\n", "", "a b c d e f " * 40] * 30]
    calls = []
    hashes = J.span_hashes
    monkeypatch.setattr(J, "span_hashes", lambda *args: calls.append(1) or hashes(*args))
    for most in (1, 300, 1 << 18):
        monkeypatch.setattr(J, "HASHED_BYTES", most)
        calls.clear()
        together = list(J.shingle_sets(texts))
        alone = [next(J.shingle_sets([t])) for t in texts] if most == 1 else alone  # noqa: F821
        assert len(together) == len(texts)
        for t, x, y in zip(texts, together, alone, strict=True):
            words = t.lower().split()
            kinds = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            assert len(x) == len(kinds) and np.array_equal(x, y) and x.dtype == np.uint64
    assert len(calls) == 1


def test_texts_of_classes_are_picked_once(spark, monkeypatch):
    """frequent_shingles and blocks read a written table; before, each took the texts by a join of its own."""
    read = []
    for name in ("frequent_shingles", "blocks"):
        work = getattr(J, name)
        monkeypatch.setattr(J, name, lambda texts, *args, work=work: read.append(texts._jdf.queryExecution().optimizedPlan().toString()) or work(texts, *args))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(documents(spark, [base, base + " x", "other words that stand alone here", base, None])).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    assert len(read) == 2 and not any("Join" in plan for plan in read)
