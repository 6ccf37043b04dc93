"""Each stage of the pipeline against brute force, on rows with odd texts, null ids and sources, and columns of clashing names."""

import hashlib
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

from fusegrid.llm import mixing  # noqa: E402
from tests.llm.conftest import ODD  # noqa: E402
from tests.llm.test_dedup import brute_lines  # noqa: E402
from tests.llm.test_near_copies import brute, near_copies  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, key string, component_id long"


def rows(texts, ids=None):
    ids = ids or list(range(len(texts)))
    return [(i, t, None, [None, "a", "b", "c"][k % 4], len(t or ""), 1, 2, "k", 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = near_copies(8) + [f"shared line here\nown words number {i} of this text {i * i}" for i in range(12)]
    toxic = [f"you are an idiot and a moron number {i} stupid stupid clown {i}" for i in range(40)]
    texts = clean + toxic
    spark.createDataFrame(rows(texts), COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= len(clean))) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, clean


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_run(spark, folder):
    path, clean = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = stage("toxicity")(spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(clean)))

    lines = stage("line dedup")(spark, kept, path)
    got = {r["doc_id"]: r for r in lines.collect()}
    want = brute_lines(clean, 10)
    assert lines.columns == docs.columns and {i: r["text"] for i, r in got.items()} == dict(enumerate(want))
    assert all(r["n_chars"] == len(r["text"]) and r["key"] == "k" and r["taken"] == 2 for r in got.values())

    near = stage("n-gram Jaccard join")(spark, lines, path)
    _, comp = brute(want)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == sorted(set(comp))

    mixed = stage("mixing sources to target weights")(spark, near, path)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixing.mix(near, keep=["text"]).collect():
        words = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"])]
        if r["taken"]:
            out[r["doc_id"], r["text"]] += r["taken"] // len(words)
            if r["taken"] % len(words):
                out[r["doc_id"], r["text"][: words[r["taken"] % len(words) - 1]]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +out

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    expect = Counter((i, hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest()) for (i, t), n in (+out).items() for _ in range(n))
    whole = corpus_pipeline.run(spark, path)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == expect


def test_odd_rows_pass_every_stage(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame(rows([*ODD, "null id", "again", "again"], [*range(len(ODD)), None, 5, 5]), COLUMNS)
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, path)
        assert docs.count() > 0, name
        if name != "mixing sources to target weights":
            assert docs.where("doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, path)
        assert docs.count() == 0
