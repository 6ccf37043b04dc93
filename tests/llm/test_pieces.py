"""The encoder's pair test against plain merging, what a worker remembers, and gathered texts."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from fusegrid.llm import piece_bpe  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel.load(P.path("piece_bpe_32k.model")).ready()


def merged(model, text):
    parts = list(text)
    while True:
        found = [(-model.pieces[a + b][1], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in model.pieces]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pairs_as_plain_merging(model):
    r = random.Random(1)
    names = list(model.pieces)
    cut = [(p[:k], p[k:]) for p in r.sample(names, 1500) for k in range(1, len(p)) if p[:k] in model.pieces and p[k:] in model.pieces]
    pairs = cut + [(r.choice(names), r.choice([n for n in r.sample(names, 20) if piece_bpe.MARK not in n])) for _ in range(3000)]
    for a, b in pairs:
        assert model.stays(model.pieces[a][0], model.pieces[b][0]) == (merged(model, a + b) == [a, b]), (a, b)
    for a in r.sample(names, 500):
        assert model.stays(piece_bpe._ALONE, model.pieces[a][0]) == (merged(model, a) == [a]), a


def test_units_in_use_stay(model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_UNITS", 40)
    model.unit_memo.clear()
    model.older_units.clear()
    asked = []
    work = type(model).unit_ids
    monkeypatch.setattr(type(model), "unit_ids", lambda self, unit: asked.append(unit) or work(self, unit))
    for k in range(300):
        model.encode_text(f"often w{k}")
    assert asked.count(piece_bpe.MARK + "often") == 1
    assert len(asked) == 301 and len(model.unit_memo) + len(model.older_units) <= 40


def test_gathered_texts_in_parts(model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "GATHERED_IDS", 7)
    texts = ["", "a", "  é\U0001f600▁ x\n中", "", "internationalization of words " * 5, " "]
    rows = [model.encode_text(t) for t in texts]
    ends = np.cumsum([0] + [len(r) // 4 for r in rows])
    ids = np.frombuffer(b"".join(rows), np.int32)
    assert [t.decode() for t in model.decode_many(ids, ends)] == [model.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
