"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.llm import collocations, divergence, mixing
from fusegrid.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.piece_bpe import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.token_store import store_round_trip

    read = store_round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.line_dedup import build_state, drop_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs, build_state(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm import quality
    from fusegrid.llm.toxicity import held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm import secret_scan

    docs = table(spark, sf_dir, "documents")
    model = secret_scan.MarkovModel.train(secret_scan.labelled_samples(docs))
    return secret_scan.digests(secret_scan.scan(docs, model))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out_of_fold = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, labels.where(~out_of_fold))
    out = toxicity.score(docs, model)
    return out.select("doc_id", out_of_fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"), least_docs=10)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.minhash import near_copies

    return near_copies(table(spark, sf_dir, "documents"), percent=85)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fusegrid.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, contained_percent=80, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_piece_bpe, op2_jaccard_join, op3_token_store, op4_line_dedup, op5_quality, op6_vector_search, op7_source_mix, op8_secret_scan, op9_exact_dedup, op10_toxicity, op11_source_divergence, op12_minhash_dedup, op13_collocations]
    return {f.__name__: f for f in own}


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from w),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as id, doc_id as c from documents union select u.b, r.c from r join u on u.a = r.id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c) as component_id
from documents d left join n using (doc_id) join r on r.id = d.doc_id group by 1, 2
"""

OP4_SQL = r"""
with d as (select row_number() over () as row_id, doc_id, text from documents),
l as (select row_id, doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as n, unnest(string_split(coalesce(text, ''), chr(10))) as line from d),
k as (select row_id, doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
h as (select key from k where length(key) >= 1 group by key having count(distinct row_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(*) filter (key in (select key from h))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (key not in (select key from h)), '')) as kept_sha256
from k group by row_id, doc_id
"""

OP9_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm)::bigint as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d
"""


OP12_SQL = f"select *, doc_id = component_id as kept from ({OP2_SQL.replace('>= 80 *', '>= 85 *')})"


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_source_mix": mixing.ORACLE_SQL, "op9_exact_dedup": OP9_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_minhash_dedup": OP12_SQL, "op13_collocations": collocations.ORACLE_SQL}
