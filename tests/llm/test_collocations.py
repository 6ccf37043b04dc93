import random
import re
from collections import Counter

import numpy as np
import pytest

from fusegrid.llm import collocations as C
from tests.llm.conftest import ODD


def brute(rows, least, percent=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = [(k[0], k[1:], a) for k, a in f.items() if len(k) > 2 and a >= least]
    out = []
    for lang, w, a in found:
        if any(g == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for g, v, b in found):
            continue
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    ranks = Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score


def rows_of(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 3))) for _ in range(14)]
    passage = " ".join(r.choice(words) for _ in range(200))
    rows = [(t, r.choice(["en", None])) for t in ODD] + [(passage, "en")] * 9 + [(f"x {passage}", "fr"), ("of  the\tword of THE word", None), ("une of the", "fr")]
    for _ in range(80):
        text = " ".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words) + r.choice(["", "", "", ",", ".", "\n", "\r\n"]) for _ in range(r.randint(0, 50)))
        rows.append((text, r.choice(["en", "fr", None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i // 2, t, g, 1, "x", 2, True) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, f int, phrase string, times int, last boolean").repartition(3)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("seed", "bounds", "least", "top"), [(1, {}, 5, 2000), (2, {"PERIOD": 2, "MARKS": 1 << 16, "COUNTED_BYTES": 300}, 4, 9), (3, {"PERIOD": 1, "MARKS": 1 << 16}, 6, 2000)])
def test_equals_brute_force(spark, monkeypatch, seed, bounds, least, top):
    for name, value in bounds.items():
        monkeypatch.setattr(C, name, value)
    rows = rows_of(seed)
    want = sorted(brute(rows, least, top=top))
    assert {len(r[2].split(" ")) for r in want} >= {2, 4} and {r[0] for r in want} >= {"en", "fr"}
    assert result(C.collocations(frame(spark, rows), least, 80, top)) == want


def counted(chunks, last, times, n):
    """Phrases of n words of chunks of one language, with their weights."""
    data = np.frombuffer(b"".join(chunks) + bytes(8), np.uint8)
    words = C.Words(data, np.array([len(c) for c in chunks]), np.zeros(len(chunks), np.uint64), np.array(last))
    start, size, _, weight = words.phrases(n, np.flatnonzero(words.own & (words.left >= n)), np.array(times), np.zeros(len(chunks), np.int64))
    return [(g.encode(), w) for g, w in zip(C._texts(data, start, size).to_pylist(), weight.tolist(), strict=True)]


@pytest.mark.parametrize("period", [1, 3, 16])
def test_each_phrase_counts_once(period):
    texts = [(t or "").encode() for t, _ in rows_of(5)]
    flat, start, end, last = C.parse(texts, period)
    chunks = [flat[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    assert len(set(zip(chunks, last.tolist(), strict=True))) < len(chunks)
    for n in range(1, 5):
        want = Counter()
        for t in texts:
            for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t.lower()):
                w = re.findall(rb"[^\x20\x09]+", piece)
                want.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        got = counted(chunks, last, np.ones(len(chunks), np.int64), n)
        assert dict(got) == want and len(got) == len(want)


def test_phrases_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(C, "gram_hashes", lambda h, n, seed: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    found = Counter()
    for g, w in counted([b"a b a b ", b"b a "], [True, True], [3, 5], 2):
        found[g] += w
    assert found == {b"a b": 6, b"b a": 8}


def test_long_text_and_no_rows(spark):
    assert C.collocations(frame(spark, rows_of(1)).where("false")).count() == 0
    rows = [("long word " * 100_000 + "x" * 300_000, "en")]
    assert result(C.collocations(frame(spark, rows))) == sorted(brute(rows, 30))
