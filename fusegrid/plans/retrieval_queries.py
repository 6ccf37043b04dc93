"""Vector, full-text and hybrid retrieval, and its evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from fusegrid.functions import scalar as S
from fusegrid.functions import vectors as V
from fusegrid.operators import evaluation as X
from fusegrid.operators import fulltext as T
from fusegrid.operators import fusion as H
from fusegrid.operators import graph as G
from fusegrid.operators import reasoning as R
from fusegrid.operators import understanding as U
from fusegrid.operators import vector_search as K
from fusegrid.operators.embedding_cache import EmbeddingCache
from fusegrid.operators.neighbour_graph import knn_graph
from fusegrid.plans import text_queries as P
from fusegrid.sources import io
from fusegrid.sources import views as W
from fusegrid.sources.views import with_views as sql

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = (f, oracle)
        return f

    return put


def _vector_of(spark, d, i: int) -> list[float]:
    return W.points(spark, d).where(F.col("id") == i).first()["vector"]


_COS = "round(list_cosine_similarity(p.vector, q.vector), 6)"
_Q0 = "(select vector from v_point where id = {})"


@query("knn_topk", sql("v_point", f"select p.id, p.category, {_COS} as score from v_point p, (select vector from v_point where id = 0) q order by score desc, p.id limit 10"))
def _(spark, d):
    return K.top_k(W.points(spark, d), _vector_of(spark, d, 0), 10).select("id", "category", "score")


@query("knn_filtered", sql("v_point", f"select p.id, p.category, {_COS} as score from v_point p, (select vector from v_point where id = 3) q where p.category = 2 and p.id % 10 / 10.0::double >= 0.4 order by score desc, p.id limit 10"))
def _(spark, d):
    where = K.search_filter(category=2, min_confidence=0.4)
    sure = W.points(spark, d).withColumn("confidence", F.col("id") % 10 / F.lit(10.0))
    return K.top_k(sure, _vector_of(spark, d, 3), 10, where=where).select("id", "category", "score")


@query("knn_per_collection_merge", sql("v_point", f"select id, collection, score from (select p.id, p.collection, {_COS} as score, row_number() over (partition by p.collection order by {_COS} desc, p.id) as place from v_point p, (select vector from v_point where id = 5) q) where place <= 10 order by score desc, id limit 10"))
def _(spark, d):
    return K.top_k_per_collection(W.points(spark, d), _vector_of(spark, d, 5), 10).select("id", "collection", "score")


for _name, _expr, _order in (("euclid", "sqrt(list_sum(list_transform(list_zip(p.vector, q.vector), lambda z: (z[1] - z[2]) ** 2)))", "asc"), ("dot", "list_inner_product(p.vector, q.vector)", "desc"), ("manhattan", "list_sum(list_transform(list_zip(p.vector, q.vector), lambda z: abs(z[1] - z[2])))", "asc")):

    @query(f"knn_{_name}", sql("v_point", f"select p.id, round({_expr}, 6) as score from v_point p, (select vector from v_point where id = 7) q order by score {_order}, p.id limit 10"))
    def _(spark, d, metric=_name):
        return K.top_k(W.points(spark, d), _vector_of(spark, d, 7), 10, metric).select("id", "score")


@query("knn_batch_join", sql("e_similar", "select src as query_id, dst as id, score from e_similar"))
def _(spark, d):
    p = W.points(spark, d)
    return K.knn_join(p, p, 3).select("query_id", "id", "score")


@query("knn_graph")
def _(spark, d):
    """Approximate: without SQL; the recall that was measured is in each row."""
    return knn_graph(W.points(spark, d), 3)


_RAW = "((('0x' || substr(md5(md5(coalesce(text, '')) || ':' || c), 1, 15))::bigint + j) % 10000) / 5000.0::double - 1"


@query("fallback_embedding", f"select doc_id, 1.0::double as norm, 1536 as size, round(arg_max(x, -k) / sqrt(sum(x * x)), 6)::double as first, round(arg_max(x, k) / sqrt(sum(x * x)), 6)::double as last from (select doc_id, 64 * c + j as k, {_RAW} as x from documents, range(24) a(c), range(64) b(j)) group by doc_id")
def _(spark, d):
    made = W.table(spark, d, "documents").select("doc_id", V.hash_embedding(F.coalesce("text", F.lit(""))).alias("v"))
    return made.select("doc_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.size("v").alias("size"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query("embedding_cache", "with f as (" + QUERIES["fallback_embedding"][1] + "), n as (select count(distinct coalesce(text, '')) as texts from documents) select doc_id, first, last, texts as first_misses, texts as second_hits, 0::bigint as second_misses from f, n")
def _(spark, d):
    """All documents asked for twice: the second time nothing is computed, and the vectors are those of fallback_embedding."""
    cache = EmbeddingCache(spark, f"{io.shared_folder(spark)}/embeddings/{uuid.uuid4().hex}")
    docs = W.table(spark, d, "documents")
    v = F.col("embedding")
    ends = [F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last")]
    one = cache.get_or_compute(docs, 1, "doc_id")[1]
    found, two = cache.get_or_compute(docs, 2, "doc_id", want=ends)
    count = lambda n, name: F.lit(n).cast("long").alias(name)
    return found.select(F.col("id").alias("doc_id"), "first", "last", count(one["misses"], "first_misses"), count(two["hits"], "second_hits"), count(two["misses"], "second_misses"))


_TERMS = [(1, "the"), (1, "nd"), (2, "der"), (2, "und"), (2, "sch"), (3, "license"), (4, "loser"), (4, "worthless")]
_BM25 = """, q(query_id, term) as (values (1, 'the'), (1, 'nd'), (2, 'der'), (2, 'und'), (2, 'sch'), (3, 'license'), (4, 'loser'), (4, 'worthless')),
 t as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as ts from documents),
 w as (select count(*) as docs, avg(len(ts)) as mean from t),
 p as (select doc_id, term, len(ts) as length, len(list_filter(ts, lambda x: x = term)) as tf from t, (select distinct term from q) where list_contains(ts, term)),
 f as (select term, count(*) as df from p group by 1),
 s as (select query_id, doc_id as id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from q join p using (term) join f using (term), w group by 1, 2)"""


@query("fulltext_bm25", "with x as (select 1)" + _BM25 + " select query_id, id, round(score, 6)::double as score from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as place from s) where place <= 10")
def _(spark, d):
    asked = spark.createDataFrame(_TERMS, "query_id int, term string")
    scored = T.bm25(W.table(spark, d, "documents"), "doc_id", "text", asked).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(best)).where("place <= 10").select("query_id", "id", "score")


@query("fulltext_terms", "select term, count(*) as docs, sum(tf)::bigint as total from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term, 1 as tf from documents) where term <> '' group by 1".replace("count(*)", "count(distinct doc_id)"))
def _(spark, d):
    index = T.inverted_index(W.table(spark, d, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))


@query("tag_attribute_match", sql("v_element", "select element_id, name from v_element where len(list_filter(tags, lambda t: contains('small', lower(t)) or contains(lower(t), 'small') or contains('ring', lower(t)) or contains(lower(t), 'ring'))) > 0"))
def _(spark, d):
    return W.elements(spark, d).where(H.tag_match(F.array(F.lit("Small"), F.lit("ring")), F.col("tags"))).select("element_id", "name")


def _requests(spark):
    return spark.createDataFrame([(1, ["small", "ring"], ["promo"], ["small"], 0), (2, ["blue", "gear"], ["economy", "large"], [], 9), (3, ["old"], [], ["old"], 21)], "query_id int, terms array<string>, categories array<string>, attributes array<string>, vec long")


def hybrid(spark, d, requests, k: int = 10):
    """Three branches for every request, weighed, confidence of the request's statements, scored, fused."""
    elements, degrees = W.elements(spark, d), G.degrees(W.has_element(spark, d).select(F.col("snippet_id").cast("string").alias("src"), F.concat(F.lit("e"), F.col("element_id").cast("string")).alias("dst")))
    degrees = degrees.where("id like 'e%'").select(F.substring("id", 2, 20).cast("bigint").alias("id"), "degree")
    points = W.points(spark, d)
    ids = requests.select("query_id", "vec")
    near = K.knn_join(points, points.join(ids.select(F.col("vec").alias("id")).distinct(), "id", "left_semi"), 10, exclude_self=False)
    near = near.join(ids.withColumnRenamed("query_id", "r"), F.col("query_id") == F.col("vec")).select(F.col("r").alias("query_id"), "id", "score")
    found = H.vector_candidates(near, elements).unionByName(H.fulltext_candidates(requests, elements)).unionByName(H.graph_candidates(requests, elements, degrees))
    told = requests.select("query_id", F.explode("categories").alias("c")).select("query_id", F.concat(F.lit("<query --> "), "c", F.lit(">")).alias("statement"), F.lit(0.8).alias("confidence"))
    scored = H.rank(R.confidence_of(H.weigh(found), told)).withColumn("final_score", F.round("final_score", 6))
    return H.top(H.dedup(scored), k).select("query_id", "place", "element_id", "name", "category", "source", F.round("similarity", 6).alias("similarity"), F.round("graph_degree", 6).alias("graph_degree"), "narsese_confidence", "final_score")


_HYBRID = """, q as (select * from (values (1, ['small', 'ring'], ['promo'], ['small'], 0), (2, ['blue', 'gear'], ['economy', 'large'], []::varchar[], 9), (3, ['old'], []::varchar[], ['old'], 21)) t(query_id, terms, categories, attributes, vec)),
 deg as (select element_id as id, count(*) as degree from v_has_element group by 1),
 v as (select query_id, id, score from (select q.query_id, p.id, round(list_cosine_similarity(p.vector, o.vector), 6) as score, row_number() over (partition by q.query_id order by round(list_cosine_similarity(p.vector, o.vector), 6) desc, p.id) as k from q join v_point o on o.id = q.vec, v_point p) where k <= 10),
 f as (select * from (select query_id, element_id, name, category, n, row_number() over (partition by query_id order by n desc, element_id) as k from (select q.query_id, e.element_id, e.name, e.category, len(list_intersect(q.terms, e.tags))::double as n from q, v_element e) where n > 0) where k <= 10),
 g as (select * from (select q.query_id, e.element_id, e.name, e.category, coalesce(degree, 0) as degree, row_number() over (partition by q.query_id order by list_position(q.categories, e.category), e.name, e.element_id) as k
   from q join v_element e on list_contains(q.categories, e.category) left join deg on deg.id = e.element_id
   where len(q.attributes) = 0 or len(list_filter(e.tags, lambda t: len(list_filter(q.attributes, lambda a: contains(lower(t), lower(a)) or contains(lower(a), lower(t)))) > 0)) > 0) where k <= 10),
 c as (select query_id, element_id, name, category, score * 0.4 as similarity, 0.0::double as graph_degree, 'vector' as source, 0 as o from v join v_element e on e.element_id = v.id
   union all select query_id, element_id, name, category, n * 0.3, 0.0::double, 'fulltext', 1 from f
   union all select query_id, element_id, name, category, 0.8 * 0.3, least(degree / 50.0::double, 1.0::double), 'graph', 2 from g),
 n as (select c.*, case when exists (select 1 from q where q.query_id = c.query_id and len(list_filter(q.categories, lambda x: contains('<query --> ' || x || '>', c.category) or contains('<query --> ' || x || '>', c.name))) > 0) then 0.8 else 0.5 end::double as narsese_confidence from c),
 s as (select *, round(0.5 * narsese_confidence + 0.3 * similarity + 0.2 * graph_degree, 6)::double as final_score from n),
 u as (select * from (select *, row_number() over (partition by query_id, element_id order by final_score desc, o) as k from s) where k = 1)"""
_HYBRID_OUT = " select query_id, place::int as place, element_id, name, category, source, round(similarity, 6)::double as similarity, round(graph_degree, 6)::double as graph_degree, narsese_confidence, final_score from (select *, row_number() over (partition by query_id order by final_score desc, element_id) as place from u) where place <= 10"


@query("hybrid_search", sql("v_element v_point v_has_element", _HYBRID + _HYBRID_OUT + " and query_id = 1"))
def _(spark, d):
    return hybrid(spark, d, _requests(spark).where("query_id = 1"))


@query("hybrid_search_batch", sql("v_element v_point v_has_element", _HYBRID + _HYBRID_OUT))
def _(spark, d):
    return hybrid(spark, d, _requests(spark))


_CANDIDATES = """select p_partkey % 50 as query_id, p_partkey // 100 as element_id, p_name as name, lower(p_type) as category, p_size / 64.0::double as similarity, p_partkey % 16 / 16.0::double as graph_degree,
  case p_partkey % 3 when 0 then 'vector' when 1 then 'fulltext' else 'graph' end as source from part"""


def _candidates(spark, d):
    """Candidates that branches found, made of the parts: two of an element for each request."""
    n = F.col("p_partkey")
    source = F.when(n % 3 == 0, "vector").when(n % 3 == 1, "fulltext").otherwise("graph")
    return W.table(spark, d, "part").select((n % 50).alias("query_id"), F.floor(n / 100).alias("element_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"), (F.col("p_size") / 64.0).alias("similarity"), (n % 16 / 16.0).alias("graph_degree"), source.alias("source"))


_SCORE = "round(0.5 * 0.5 + 0.3 * similarity + 0.2 * graph_degree, 6)::double"


@query("rank_score", f"with c as ({_CANDIDATES}) select query_id, element_id, source, {_SCORE} as final_score from c")
def _(spark, d):
    ranked = H.rank(_candidates(spark, d).withColumn("narsese_confidence", F.lit(0.5)))
    return ranked.select("query_id", "element_id", "source", S.rounded(F.col("final_score"), 6).alias("final_score"))


@query("fusion_dedup", f"with c as ({_CANDIDATES}) select query_id, element_id, source, final_score from (select *, {_SCORE} as final_score, row_number() over (partition by query_id, element_id order by {_SCORE} desc, case source when 'vector' then 0 when 'fulltext' then 1 else 2 end) as k from c) where k = 1")
def _(spark, d):
    ranked = H.rank(_candidates(spark, d).withColumn("narsese_confidence", F.lit(0.5))).withColumn("final_score", S.rounded(F.col("final_score"), 6))
    return H.dedup(ranked).select("query_id", "element_id", "source", "final_score")


@query("confidence_theta_join", sql("v_element", ", s(query_id, statement, confidence) as (values (1, '<query --> promo>', 0.8), (1, '<small ring --> component>', 0.9), (2, '<query --> large>', 0.6)), q as (select distinct query_id from s) select q.query_id, e.element_id, coalesce((select max(confidence) from s where s.query_id = q.query_id and (contains(statement, e.category) or contains(statement, e.name))), 0.5)::double as narsese_confidence from q, v_element e where 1 + e.element_id % 2 = q.query_id"))
def _(spark, d):
    told = spark.createDataFrame([(1, "<query --> promo>", 0.8), (1, "<small ring --> component>", 0.9), (2, "<query --> large>", 0.6)], "query_id int, statement string, confidence double")
    candidates = W.elements(spark, d).withColumn("query_id", (1 + F.col("element_id") % 2).cast("int"))
    return R.confidence_of(candidates, told).select("query_id", "element_id", "narsese_confidence")


def _evaluated(spark, d):
    """Neighbours of every tenth point against the points of its label; latency from the event of the point's number."""
    p = W.points(spark, d)
    asked = p.where("id % 10 = 0")
    labels = p.groupBy("category").agg(F.count("*").alias("members"))
    wanted = asked.select(F.col("id").alias("query_id"), F.col("category").alias("wanted"))
    near = K.knn_join(p, asked, 10).select("query_id", "id").join(p.select("id", "category"), "id").join(wanted, "query_id")
    counts = near.groupBy("query_id", "wanted").agg(F.count("*").alias("returned"), F.count_if(F.col("category") == F.col("wanted")).alias("hits"))
    counts = counts.join(labels, F.col("wanted") == F.col("category")).withColumn("expected", F.col("members") - 1)
    latency = W.table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("latency"))
    return X.counted_metrics(counts.where("expected > 0").join(latency, "query_id"))


_EVAL = """, r as (select src, dst from (select a.id as src, b.id as dst, row_number() over (partition by a.id order by round(list_cosine_similarity(a.vector, b.vector), 6) desc, b.id) as k from v_point a join v_point b on a.id <> b.id where a.id % 10 = 0) where k <= 10),
 x as (select a.id as src, b.id as dst from v_point a join v_point b on a.category = b.category and a.id <> b.id where a.id % 10 = 0),
 m as (select r.src as query_id, count(*) as returned, count(x.dst) as hits from r left join x on x.src = r.src and x.dst = r.dst group by 1),
 k as (select m.query_id, hits / returned as precision, hits / (select count(*) from x where x.src = m.query_id) as recall, value as latency from m join events on event_id = m.query_id),
 e as (select query_id, precision, recall, 1 - precision as hallucination, latency, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from k)"""


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c, t in df.dtypes if t == "double" and c not in keep])


@query("eval_query_metrics", sql("v_point", _EVAL + " select query_id, round(precision, 6)::double as precision, round(recall, 6)::double as recall, round(hallucination, 6)::double as hallucination, round(latency, 6)::double as latency, round(f1, 6)::double as f1 from e"))
def _(spark, d):
    return _rounded(_evaluated(spark, d), "query_id")


_RANK = "(list(latency order by latency))[round({} * (count(*) - 1))::int + 1]"
_AGG = "count(*) as queries, " + ", ".join(f"round(avg({c}), 6)::double as mean_{c}" for c in ("precision", "recall", "f1", "hallucination", "latency")) + ", " + ", ".join(f"round({_RANK.format(p / 100)}, 6)::double as p{p}" for p in (50, 95, 99))


@query("eval_aggregate", sql("v_point", _EVAL + f" select {_AGG} from e"))
def _(spark, d):
    return _rounded(X.aggregate(_evaluated(spark, d)), "queries")


_SYSTEMS = "select l_returnflag as system, avg(l_discount) as precision, avg(l_tax) as recall, avg(l_discount * l_tax) as hallucination, avg(l_quantity) as latency from lineitem group by 1"


@query("eval_improvement", f"with s as ({_SYSTEMS}) select " + ", ".join(f"round({sign} * (b.{c} - a.{c}) / a.{c} * 100, 6)::double as {c}" for c, sign in (("precision", 1), ("recall", 1), ("hallucination", -1), ("latency", -1))) + " from s a, s b where a.system = 'A' and b.system = 'R'")
def _(spark, d):
    means = [F.avg(x).alias(c) for c, x in (("precision", F.col("l_discount")), ("recall", F.col("l_tax")), ("hallucination", F.col("l_discount") * F.col("l_tax")), ("latency", F.col("l_quantity")))]
    rows = W.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg(*means)
    return _rounded(X.improvements(rows, "A", "R", {"precision": 1, "recall": 1, "hallucination": -1, "latency": -1}))


@query("latency_percentiles", sql("v_outcome", ", n as (select service, latency, row_number() over (partition by service order by latency) as k, count(*) over (partition by service) as n from v_outcome) select service, max(n) as n, " + ", ".join(f"max(latency) filter (k = round({p / 100} * (n - 1)) + 1) as p{p}" for p in (50, 95, 99)) + " from n group by 1"))
def _(spark, d):
    return X.nearest_rank_percentiles(W.outcomes(spark, d), "latency", ["service"])


@query("evaluation_report")
def _(spark, d):
    return X.report_lines(X.aggregate(_evaluated(spark, d)), "Retrieval evaluation")


@query("evaluation_report_formats")
def _(spark, d):
    summary, title = X.aggregate(_evaluated(spark, d)), "Retrieval evaluation"
    return X.report_json(summary, title).select(F.lit("json").alias("format"), "value").union(X.report_html(summary, title).select(F.lit("html"), "value"))


def retrieve(spark, d, requests, k: int = 10, most: int = 10):
    """(asked, found): requests(query_id, text) through understanding and statements, and the candidates of all three branches.

    The vector branch embeds the search terms of the statements and searches the points of all collections, the full-text branch scores names and
    tags by BM25, the graph branch takes the wanted categories and attributes. A request without terms has no candidates from that branch.
    """
    told = U.statements(requests)
    asked, elements, points = U.process(requests), W.components(spark, d), W.points(spark, d)
    size = points.select(F.size("vector")).first()[0]
    words = U.terms_of_statements(told).select(F.col("query_id").cast("long").alias("id"), F.array_join("terms", " ").alias("text")).where("text <> ''")
    near = K.knn_join(points, words.select("id", V.hash_embedding(F.col("text"), size).alias("vector")), most, exclude_self=False)
    near = near.select(F.col("query_id").cast("int").alias("query_id"), "id", "score")
    terms = asked.select("query_id", F.explode(F.split(F.lower(F.array_join("terms", " ")), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    full = T.bm25(elements.select("element_id", F.concat_ws(" ", "name", F.array_join("tags", " ")).alias("text")), "element_id", "text", terms)
    degrees = W.has_element(spark, d).groupBy(F.col("element_id").alias("id")).agg(F.count("*").alias("degree"))
    wanted = asked.select("query_id", F.col("components").alias("categories"), "attributes")
    found = H.scored_candidates(near, elements, "vector", most).unionByName(H.scored_candidates(full.withColumn("score", F.round("score", 6)), elements, "fulltext", most))
    found = io.materialize(found.unionByName(H.graph_candidates(wanted, elements, degrees, most)))  # read by rankings and comparisons
    # products of six digits and two weights: eight digits are all of them, so that nothing is rounded at a half
    scored = H.rank(R.confidence_of(H.weigh(found), told)).withColumn("final_score", F.round("final_score", 8))
    return asked, found, H.top(H.dedup(scored), k)


_PARTS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_RETRIEVE = f""", q as (select query_id, components as categories, attributes, list_concat(list_concat(components, attributes), context) as terms from ({P.PROCESSED} select * from c)),
 told as ({P.STATEMENTS} select query_id, ord, z[1] as statement, z[2]::double as confidence from s),
 said as ({P.SEARCH_TERMS} select query_id, string_agg(term, ' ' order by first) as text from m group by 1),
 emb as (select query_id, list_transform(range((select len(vector) from v_point limit 1)), lambda j: ((('0x' || substr(md5(md5(text) || ':' || (j // 64)), 1, 15))::bigint + j % 64) % 10000) / 5000.0::double - 1.0) as vector from said where text <> ''),
 v as (select query_id, id, score from (select e.query_id, p.id, round(list_cosine_similarity(p.vector, e.vector), 6) as score, row_number() over (partition by e.query_id order by round(list_cosine_similarity(p.vector, e.vector), 6) desc, p.id) as k from emb e, v_point p) where k <= 10),
 t as (select element_id, {_PARTS.format("name || ' ' || array_to_string(tags, ' ')")} as ts from v_component),
 w as (select count(*) as docs, avg(len(ts)) as mean from t),
 qt as (select distinct query_id, unnest({_PARTS.format("array_to_string(terms, ' ')")}) as term from q),
 p as (select element_id, term, len(ts) as length, len(list_filter(ts, lambda x: x = term)) as tf from t, (select distinct term from qt) where list_contains(ts, term)),
 df as (select term, count(*) as df from p group by 1),
 s as (select query_id, element_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as n from qt join p using (term) join df using (term), w group by 1, 2),
 f as (select * from (select query_id, e.element_id, name, category, n, row_number() over (partition by query_id order by n desc, e.element_id) as k from s join v_component e using (element_id)) where k <= 10),
 deg as (select element_id as id, count(*) as degree from v_has_element group by 1),
 g as (select * from (select q.query_id, e.element_id, e.name, e.category, coalesce(degree, 0) as degree, row_number() over (partition by q.query_id order by list_position(q.categories, e.category), e.name, e.element_id) as k
   from q join v_component e on list_contains(q.categories, e.category) left join deg on deg.id = e.element_id
   where len(q.attributes) = 0 or len(list_filter(e.tags, lambda t: len(list_filter(q.attributes, lambda a: contains(lower(t), lower(a)) or contains(lower(a), lower(t)))) > 0)) > 0) where k <= 10),
 c as (select query_id, element_id, name, category, score * 0.4 as similarity, 0.0::double as graph_degree, 'vector' as source, 0 as o from v join v_component e on e.element_id = v.id
   union all select query_id, element_id, name, category, n * 0.3, 0.0::double, 'fulltext', 1 from f
   union all select query_id, element_id, name, category, 0.8 * 0.3, least(degree / 50.0::double, 1.0::double), 'graph', 2 from g),
 n as (select c.*, coalesce((select max(confidence) from told where told.query_id = c.query_id and (contains(statement, c.category) or contains(statement, c.name))), 0.5)::double as narsese_confidence from c),
 r as (select *, round(0.5 * narsese_confidence + 0.3 * similarity + 0.2 * graph_degree, 8)::double as final_score from n),
 u as (select *, row_number() over (partition by query_id order by final_score desc, element_id) as place from (select *, row_number() over (partition by query_id, element_id order by final_score desc, o) as k from r) where k = 1)"""


@query("request_hybrid", sql("v_point v_component v_has_element", _RETRIEVE + " select query_id, place::int as place, element_id, name, category, source, round(similarity, 8)::double as similarity, round(graph_degree, 6)::double as graph_degree, narsese_confidence, final_score from u where place <= 10"))
def _(spark, d):
    """Natural-language requests to ranked elements."""
    best = retrieve(spark, d, W.requests(spark))[2]
    return best.select("query_id", "place", "element_id", "name", "category", "source", F.round("similarity", 8).alias("similarity"), F.round("graph_degree", 6).alias("graph_degree"), "narsese_confidence", "final_score")


_SYSTEMS_SQL = """, x as (select query_id, element_id from (select q.query_id, e.element_id, row_number() over (partition by q.query_id order by e.element_id) as k from q join v_component e on e.category = q.categories[1]) where k <= 3),
 y as (select 'vector' as system, query_id, element_id from c where source = 'vector' union all select 'fulltext', query_id, element_id from c where source = 'fulltext' union all select 'graph', query_id, element_id from c where source = 'graph'
   union all select 'hybrid', query_id, element_id from u where place <= 10),
 h as (select system, query_id, (select count(*) from y where y.system = z.system and y.query_id = a.query_id) as returned, (select count(*) from y join x using (query_id, element_id) where y.system = z.system and y.query_id = a.query_id) as hits, (select count(*) from x where x.query_id = a.query_id) as expected
   from (select distinct query_id from x) a, (values ('vector'), ('fulltext'), ('graph'), ('hybrid')) z(system)),
 e as (select system, query_id, case when returned > 0 then hits / returned else 0 end::double as precision, hits / expected as recall, case when returned > 0 then 1 - hits / returned else 0 end::double as hallucination from h),
 k as (select system, count(*) as queries, avg(precision) as precision, avg(recall) as recall, avg(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end) as f1, avg(hallucination) as hallucination from e group by 1)"""
_GAIN = "round(case when k.{0} <> 0 then {1}(h.{0} - k.{0}) / k.{0} * 100 else 0 end, 4)::double as {0}_gain"


@query("system_comparison", sql("v_point v_component v_has_element", _RETRIEVE + _SYSTEMS_SQL + " select k.system, k.queries, " + ", ".join(f"round(k.{c}, 9)::double as {c}" for c in ("precision", "recall", "f1", "hallucination")) + ", " + ", ".join(_GAIN.format(c, "-" if c == "hallucination" else "") for c in ("precision", "recall", "f1", "hallucination")) + " from k, (select * from k where system = 'hybrid') h"))
def _(spark, d):
    """Each branch alone and the hybrid over the same requests, against three expected elements of the first component; gains are the hybrid's over each."""
    asked, found, best = retrieve(spark, d, W.requests(spark))
    place = Window.partitionBy("query_id").orderBy("element_id")
    right = asked.select("query_id", F.get("components", F.lit(0)).alias("category")).join(W.components(spark, d).select("element_id", "category"), "category").withColumn("k", F.row_number().over(place)).where("k <= 3")
    right = right.groupBy("query_id").agg(F.collect_list("element_id").alias("expected"))
    by = found.select(F.col("source").alias("system"), "query_id", "element_id").unionByName(best.select(F.lit("hybrid").alias("system"), "query_id", "element_id"))
    returned = by.groupBy("system", "query_id").agg(F.collect_list("element_id").alias("returned"))  # ten at most
    every = right.withColumn("system", F.explode(F.array(*[F.lit(x) for x in (*H.WEIGHTS, "hybrid")])))
    rows = every.join(returned, ["system", "query_id"], "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<bigint>"))).withColumn("latency", F.lit(0.0))
    names = {"precision": 1, "recall": 1, "f1": 1, "hallucination": -1}
    means = X.query_metrics(rows, "system").groupBy("system").agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])
    hybrid_row = means.where("system = 'hybrid'").select(*[F.col(c).alias(f"h_{c}") for c in names])
    gain = lambda c, sign: F.round(sign * S.improvement_percent(F.col(c), F.col(f"h_{c}")), 4).alias(f"{c}_gain")
    return means.crossJoin(F.broadcast(hybrid_row)).select("system", "queries", *[F.round(c, 9).alias(c) for c in names], *[gain(c, s) for c, s in names.items()])  # one row


_GROUPS = {"components": (20, "{} component"), "attributes": (15, "{} with rounded corners"), "forms": (15, "form with {}"), "navigation": (15, "navigation with {}"), "layout": (10, "layout of {}"), "feedback": (10, "alert near {}"), "data": (10, "table of {}"), "complex": (5, "dashboard with {} and filters")}


def benchmark_rows() -> list[tuple[int, str, str, list[str]]]:
    """A hundred queries in eight groups, three expected ids each, all by rule: (query_id, group, text, expected)."""
    import hashlib

    from fusegrid.functions import lexicon as L

    names, out = list(L.COMPONENTS), []
    for group, (count, form) in _GROUPS.items():
        for i in range(count):
            text = form.format(names[i % len(names)])
            out.append((len(out) + 1, group, text, [hashlib.md5(f"{text}#{k}".encode()).hexdigest() for k in range(3)]))
    return out


def expected_ids(text):
    return F.array(*[F.md5(F.concat(text, F.lit(f"#{k}"))) for k in range(3)])


@query("benchmark_dataset", "select item_id, 'find' as intent, len(list_filter(regexp_extract_all(text, '\\b[a-zA-Z]{3,}\\b'), lambda w: not list_contains(" + P._STOP + ", lower(w)))) as terms, md5(text || '#0') as first_expected from benchmark")
def _(spark, d):
    """The texts of the benchmark as requests, each with three expected ids by rule."""
    asked = U.process(W.table(spark, d, "benchmark"))
    return asked.select("item_id", "intent", F.size("terms").alias("terms"), F.get(expected_ids(F.col("text")), F.lit(0)).alias("first_expected"))


@query("match_reasons", f"with c as ({_CANDIDATES}) select query_id, element_id, source, 'confidence 0.50, similarity ' || format('{{:.2f}}', similarity::double) || ', connections ' || format('{{:.2f}}', graph_degree::double) as reason from c")
def _(spark, d):
    return _candidates(spark, d).select("query_id", "element_id", "source", S.match_reason(F.lit(0.5), F.col("similarity"), F.col("graph_degree")).alias("reason"))


@query("delete_points_batch", sql("v_point", "select (select count(*) from v_point where id % 7 = 3) + 2 as requested, count(*) as points, round(sum(p.vector[1]), 6)::double as first_sum from v_point p where id % 7 <> 3"))
def _(spark, d):
    """Ids of a seventh of the points and two unknown ones are asked for."""
    points = W.points(spark, d)
    left, requested = K.delete_points(points, points.where("id % 7 = 3").select("id").unionByName(spark.range(-2, 0)))
    return left.agg(F.lit(requested).cast("long").alias("requested"), F.count("*").alias("points"), F.round(F.sum(F.get("vector", F.lit(0))), 6).alias("first_sum"))


@query("include_switches", sql("v_element", "select element_id, case when element_id % 2 = 0 then css_classes[1] end as css, case when element_id % 3 = 0 then name end as js from v_element"))
def _(spark, d):
    rows = W.elements(spark, d).select("element_id", F.get("css_classes", F.lit(0)).alias("css"), F.col("name").alias("js"), (F.col("element_id") % 2 == 0).alias("with_css"), (F.col("element_id") % 3 == 0).alias("with_js"))
    return H.include(rows, {"css": "with_css", "js": "with_js"}).drop("with_css", "with_js")
