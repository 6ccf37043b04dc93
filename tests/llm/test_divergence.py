import random
import re
from collections import Counter

import numpy as np
import pytest

from fusegrid.llm import divergence as D
from tests.llm.conftest import ODD


def brute(rows, least):
    terms = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))) for t, g, s in rows]
    out = []
    for lang in {r[0] for r in terms}:
        df = Counter(w for g, _, ws in terms if g == lang for w in set(ws))
        kept = [w for w in df if df[w] >= least]
        sources = sorted({s for g, s, _ in terms if g == lang})
        count = {s: Counter(w for g, x, ws in terms if (g, x) == (lang, s) for w in ws if w in set(kept)) for s in sources}
        count[None] = sum(count.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[x][w]) for w in kept), x.encode(), x) for x in sources if x != s))
            out += [(lang, s, "pair", x, -v, i) for i, (v, _, x) in enumerate(pairs, 1)]
            best = sorted((-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > p[None][w])[:10]
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(best, 1)]
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["averyveryverylongtermofmanyletters", "averyveryverylongtermofmanyletterZ"]
    rows = [(t, r.choice(["en", None, ""]), r.choice(["a", None])) for t in ODD]
    for _ in range(120):
        source = r.choice(["a", "b", "b", "b", "c", "", None, "é"])
        some = r.sample(words, 12)
        rows.append((" 1, ".join(r.choice(some).upper() if r.random() < 0.2 else r.choice(some) for _ in range(r.randint(0, 40))), r.choice(["en", "fr", "en"]), source))
    return rows + [("lonely words", "xx", "a"), ("other", "xx", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i // 2, t, g, s, 1, "x", "y", 3) for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, block int, term string, cells string, n long").repartition(5)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("bounds", [{}, {"SHARD_KEYS": 5, "KEY_BYTES": 400, "MOST_CELLS": 40, "FAN_IN": 2, "TILE": 2}])
def test_equals_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(D, name, value)
    rows = rows_of(len(bounds))
    want = brute(rows, 5)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert result(D.audit(frame(spark, rows), least_docs=5)) == want


def test_equal_hashes_are_told_apart_by_stored_keys(monkeypatch):
    monkeypatch.setattr(D, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    keys = [b"a", b"b", b"cc", b"dd", b"eee"]
    h = D.key_hashes(keys)
    first = [0, 2, 4]
    disp, slots = D.perfect_hash(h[first])
    assert sorted(slots.tolist()) == [0, 1, 2]
    ordered = [k for _, k in sorted(zip(slots.tolist(), [b"a", b"cc", b"eee"], strict=True))] + [b"b", b"dd"]
    held = D.Shards(1, [(0, disp.tobytes(), 3, ordered)])
    data, start, size = D._packed([*keys, b"x", b"yy", b"zzzz"])
    got = held.find(data, start, start + size).tolist()
    assert [ordered[i] for i in got[:5]] == keys and got[5:] == [-1, -1, -1]


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(3).integers(0, 2**63, 1500).astype(np.uint64)
    disp, slots = D.perfect_hash(h)
    assert sorted(slots.tolist()) == list(range(1500)) and len(disp) == 376


def test_shares_beyond_64_bits():
    for c, n, v in [(0, 0, 1), (8 * 10**15, 8 * 10**15, 10**6), (123456789012345, 7 * 10**15, 10**9)]:
        assert D.shares(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_no_rows_and_no_kept_terms(spark):
    assert D.audit(frame(spark, rows_of(1)).where("false")).count() == 0
    rows = [("some words", "en", s) for s in ("a", "b", None)]
    assert result(D.audit(frame(spark, rows))) == brute(rows, 10)
