import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fusegrid.llm import line_dedup, mixing
from fusegrid.llm.common import components
from fusegrid.llm.exact_dedup import exact_dedup
from tests.llm.conftest import ODD, documents


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_exact_dedup(spark, partitions):
    texts = ODD + ["same text"] * 40 + ["same  text"] * 5 + [f"t{i % 3}" for i in range(20)] + ["z" * 200 + str(i % 4) for i in range(40)]
    rows = exact_dedup(documents(spark, texts), partitions=partitions).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (own[0], len(own), r["doc_id"] == own[0])
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_exact_dedup_repeated_null_ids_and_empty(spark):
    copies = spark.createDataFrame([(7, "one text")] * 300 + [(9, "z")], "doc_id long, text string")
    rows = exact_dedup(copies, partitions=5).collect()
    assert sum(r["kept"] for r in rows) == 2 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == {(7, 7, 300), (9, 9, 1)}
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    rows = exact_dedup(docs, partitions=2).collect()
    assert sum(r["kept"] for r in rows) == 2 and all(r["group_size"] == 2 for r in rows)
    assert {r["keep_id"] for r in rows} == {None, 2}
    assert exact_dedup(docs.where("false")).count() == 0


def brute_lines(texts, least):
    seen = defaultdict(set)
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({i: i + 32 for i in range(65, 91)})
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    return ["\n".join(x for x in (t or "").split("\n") if not (key(x) and len(seen[key(x)]) >= least)) for t in texts]


@pytest.mark.parametrize(("per_shard", "per_group"), [(200_000, 500_000), (1, 5)])
def test_line_dedup(spark, monkeypatch, per_shard, per_group):
    monkeypatch.setattr(line_dedup, "ROWS_PER_GROUP", per_group)
    texts = ODD + [f"Common LINE \nown {i}\n\tcommon line\nÉ É" for i in range(12)] + ["common line", "é é"]
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(docs, line_dedup.build_state(docs, min_docs=10, keys_per_shard=per_shard)).collect()}
    for i, want in enumerate(brute_lines(texts, 10)):
        assert out[i]["kept_text"] == want
        assert out[i]["n_lines"] - out[i]["n_dropped"] == (len(want.split("\n")) if want or out[i]["n_dropped"] == 0 else 0) or "\n" in (texts[i] or "")
    assert out[0]["key"] == "y"
    assert line_dedup.drop_lines(docs.where("false"), line_dedup.build_state(docs.where("false"))).count() == 0


def held(state):
    """The fingerprints that each filter holds, each in one of its two buckets."""
    out = {}
    for r in state.filters.collect():
        f = line_dedup.CuckooFilter.load(bytes(r["filter"]))
        marks = sorted(int(m) for bucket in f.table for m in bucket if m)
        if r["keys"]:
            assert len(marks) == r["keys"]
            out[r["shard"]] = marks
    return out


@pytest.mark.parametrize("per_shard", [200_000, 2])
def test_line_dedup_is_reversible(spark, per_shard):
    first, more = documents(spark, [f"head\nback\nx{i}" for i in range(12)]), documents(spark, ["head\n" + "\n".join(f"foot {k}" for k in range(7)) + f"\ny{i}" for i in range(11)])
    state = line_dedup.build_state(first, min_docs=10, keys_per_shard=per_shard)
    grown = line_dedup.add_documents(state, more)
    keys = [line_dedup._digest(w) for w in (b"head", b"back", *(b"foot %d" % k for k in range(7)))]
    assert {bytes(r["key"]) for r in grown.refs.where("refs >= 10").collect()} == {*keys}
    assert sum(map(len, held(grown).values())) == 9 and grown.shards == (8 if per_shard == 2 else 1)
    back = line_dedup.remove_documents(grown, more)
    assert held(back) == held(state) and back.shards == state.shards
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, state.refs.collect()))
    assert {r["n_dropped"] for r in line_dedup.drop_lines(more, grown).collect()} == {8}
    assert {r["n_dropped"] for r in line_dedup.drop_lines(more, back).collect()} == {1}


def test_keys_claimed_wrongly_drop_no_line(spark, monkeypatch):
    docs = documents(spark, [f"common\nown {i}" for i in range(12)])
    state = line_dedup.build_state(docs, min_docs=10)
    monkeypatch.setattr(line_dedup.CuckooFilter, "claims", lambda self, keys: keys[:, 0] >= 0)  # all
    assert {r["n_dropped"] for r in line_dedup.drop_lines(docs, state).collect()} == {1}


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    f = line_dedup.CuckooFilter.of(keys[:2000])
    assert all(k in f for k in keys[:2000]) and sum(k in f for k in keys[2000:]) == 0
    assert all(f.delete(k) for k in keys[:1000])
    assert all(k in f for k in keys[1000:2000]) and sum(k in f for k in keys[:1000]) == 0
    rows = line_dedup.np.frombuffer(b"".join(keys), "u1").reshape(-1, 16)
    assert f.claims(rows).tolist() == [k in f for k in keys]
    assert f.dump() == line_dedup.CuckooFilter.load(f.dump()).dump()


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, want = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        if not open_:
            return fixed
        unit = (want - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: unit * weight[s] for s in open_}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    sources = {i: [None, "a", "b", "é", "z", "big"][min(i % 9, 5)] for i in range(len(ODD) + 200)}
    texts = ODD + ["w " * (i % 37) for i in range(200)]
    docs = documents(spark, texts, sources)
    rows = mixing.mix(docs, rows_per_range=7).collect()
    assert len(rows) == len(texts)
    sizes = defaultdict(int)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    for i, n in enumerate(words):
        sizes[sources[i]] += n
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, rows_per_range=50).collect()))
    assert mixing.mix(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 40), (40, 99), (7, 7), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[99] == got[100] == got[40] == 40 and got[1049] == 1000
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "s"), (1, "a b", "s"), (1, "a b", "s"), (1, "a b c d", "s"), (2, "x", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == 6 and sum(r["taken"] for r in out if r["source_size"] == 11) == round(next(r["target"] for r in out if r["source_size"] == 11))
    assert all(r["taken"] <= 2 * r["size"] for r in out)


def test_line_dedup_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same\nown")] * 12 + [(None, "same")], "doc_id long, text string")
    out = line_dedup.drop_lines(docs, line_dedup.build_state(docs, min_docs=10)).collect()
    assert Counter((r["doc_id"], r["n_dropped"]) for r in out) == {(1, 2): 12, (None, 1): 1}
