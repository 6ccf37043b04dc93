import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from fusegrid.llm import piece_bpe, token_store  # noqa: E402
from tests.llm.conftest import ODD, documents  # noqa: E402


def random_texts(n, seed=3):
    r = random.Random(seed)
    letters = "abcdeinorst  \n\tAé√ü%&.,'▁中\U0001f600 tion the"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_piece_bpe_equals_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ODD + random_texts(300) + ["Transformation internationalization of the   unbelievable weltanschauung"]
    rows = {r["doc_id"]: r for r in piece_bpe.digests(piece_bpe.encode_decode(documents(spark, texts), P.path("piece_bpe_32k.model"))).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest(), repr(t)


def test_piece_bpe_on_documents(spark, data_dir):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in piece_bpe.encode_decode(docs, P.path("piece_bpe_32k.model")).collect()}
    for r in docs.collect():
        assert list(got[r["doc_id"]]["ids"]) == lib.encode(r["text"])
        assert got[r["doc_id"]]["decoded"] == lib.decode(lib.encode(r["text"]))


def test_piece_decode_of_ids():
    model = piece_bpe.PieceModel.load(P.path("piece_bpe_32k.model"))
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in random_texts(50, 5):
        assert model.decode(lib.encode(t)) == lib.decode(lib.encode(t))


def store_rows(spark, texts, tmp_path, name):
    path = str(tmp_path / name)
    token_store.write_store(documents(spark, texts), path, P.path("byte_bpe_50k.json"))
    return path, {r["doc_id"]: r for r in token_store.read_store(spark, path).collect()}


def test_token_store_round_trip(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ODD + random_texts(300) + ["trailing ", " leading", "a  b", "a \n b", "a  b", "x\x1c y"]
    path, rows = store_rows(spark, texts, tmp_path, "a")
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(bytes(rows[i]["ids"])) == zlib.crc32(ids.tobytes()), repr(t)
        start += len(ids)
    read = []
    monkeypatch.setattr(token_store, "read_bytes", lambda s, p, at, n, f=token_store.read_bytes: read.append(n) or f(s, p, at, n))
    got = token_store.lookup(spark, path, [3, 100, 10**9]).collect()
    assert len(read) == 2 and sum(read) < 3 * token_store.BLOCK_BYTES
    assert sorted(r["doc_id"] for r in got) == [3, 100]
    assert all(bytes(r["ids"]) == bytes(rows[r["doc_id"]]["ids"]) for r in got)


def test_token_store_empty_null_and_repeated_ids(spark, tmp_path):
    empty = documents(spark, []).select("doc_id", "text")
    token_store.write_store(empty, str(tmp_path / "e"), P.path("byte_bpe_50k.json"))
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0
    docs = spark.createDataFrame([(None, "a"), (5, "b c"), (5, "b c"), (-1, "d")], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "n"), P.path("byte_bpe_50k.json"))
    rows = token_store.read_store(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, -1, 5, 5]
    same = spark.createDataFrame([(4, f"text {i}") for i in range(300)] + [(9, "last"), (None, "first")], "doc_id long, text string")
    token_store.write_store(same, str(tmp_path / "s"), P.path("byte_bpe_50k.json"))
    rows = token_store.read_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] + [4] * 300 + [9]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    assert token_store.lookup(spark, str(tmp_path / "s"), [4]).count() == 300 and token_store.lookup(spark, str(tmp_path / "s"), [5]).count() == 0
    assert sum(r["docs"] > 0 for r in spark.read.parquet(str(tmp_path / "s/side")).collect()) > 1


def test_token_store_keeps_every_row_of_a_large_batch(spark, tmp_path):
    n = 3000
    docs = spark.range(0, n, 1, 1).selectExpr("id as doc_id", "concat('text ', id) as text")
    token_store.write_store(docs, str(tmp_path / "l"), P.path("byte_bpe_50k.json"))
    rows = token_store.read_store(spark, str(tmp_path / "l")).select("doc_id", "start", "n_tokens").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(n))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))


def test_shard_format():
    entries = [(token_store.key_of(i), bytes([i % 251, 0] * (i % 300))) for i in range(0, 4000, 2)]
    data = b"".join(r + b"\n" for r in token_store.shard_records(iter(entries), 2))
    shard = token_store.Shard(data)
    assert len(shard.index) > 3 and shard.docs == 2000
    assert [(k, bytes(v)) for k, _, v in shard.entries()] == entries
    for k, v in entries[::97]:
        assert [bytes(x) for x in shard.find(k)] == [v]
    assert shard.find(token_store.key_of(1)) == []
    assert sum(shard.may_hold(token_store.key_of(i)) for i in range(1, 4000, 2)) < 100
