"""Canonical views over the parquet tables, and the same views as SQL text.

``SQL`` holds one SELECT a view; the catalogue joins those that a query's check needs into a WITH list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L

SYSTEMS = ["material-ui", "tailwind", "chakra", "bootstrap", "custom"]

#: Natural-language requests: (query_id, text).
REQUESTS = [
    (1, "create a responsive dark mode button"),
    (2, "blue button component"),
    (3, "find a small red ring"),
    (4, "show me large cards with shadow and rounded corners"),
    (5, "update the navigation header for accessibility"),
    (6, "build an animated modal dialog with transition"),
    (7, "I need a login form with text fields and checkboxes"),
    (8, "list all dropdown selects and sliders"),
    (9, "fix the broken sticky sidebar menu"),
    (10, ""),
    (11, "generate a full width hero carousel gradient"),
    (12, "new widget old bolt"),
    (13, "improve progress bar loading icon"),
    (14, "give me outlined secondary badges and tooltips"),
    (15, "pagination breadcrumb table footer"),
    (16, "radio buttons in a disabled form"),
    (17, "hot gear cold plate"),
    (18, "toast notifications with hover state and transparent background"),
    (19, "search for medium avatar lists"),
    (20, "make tabs and an accordion, centered, filled, fixed"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to three tasks a core: a small file is one task's, however much work each of its rows takes."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def design_system(brand):
    number = F.regexp_extract(brand, r"(\d+)", 1).cast("int") % 5
    out = None
    for i, name in enumerate(SYSTEMS[:-1]):
        out = F.when(number == i, name) if out is None else out.when(number == i, name)
    return out.otherwise(SYSTEMS[-1])


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("element_id"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("category"),
        design_system(F.col("p_brand")).alias("design_system"),
        F.split("p_name", " ").alias("tags"),
        F.array(F.concat(F.lit("p-"), F.col("p_size").cast("string"))).alias("css_classes"),
        F.col("p_retailprice").alias("recency"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as components: category and one attribute by the part's number, name of both words and the category."""
    at = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    category, trait = at(list(L.COMPONENTS), F.col("p_partkey")), at(list(L.ATTRIBUTES), F.col("p_partkey") + F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.concat_ws(" ", "p_name", category).alias("name"), category.alias("category"), F.array_append(F.split("p_name", " "), trait).alias("tags"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snippet_id"), F.col("o_orderpriority").alias("design_system"), F.col("o_orderdate").alias("created_at"))


def has_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snippet_id"), F.col("l_partkey").alias("element_id")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("category"), (F.col("label") % 5).alias("collection"), F.lit(0.5).alias("confidence"))


def replace_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAN_REPLACE as hyperedges: (class, id), each part in the class of its brand, type and size; a part without one of these is in none."""
    p = table(spark, sf_dir, "part").where("p_brand is not null and p_type is not null and p_size is not null")
    return p.select(F.to_json(F.struct("p_brand", "p_type", "p_size")).alias("class"), F.col("p_partkey").alias("id"))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_CHILD: region - nation - customer or supplier, ids with a letter before."""
    pair = lambda t, p, c, a, b: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(c), F.col(b).cast("string")).alias("dst"))
    return pair("nation", "r:", "n:", "n_regionkey", "n_nationkey").union(pair("customer", "n:", "c:", "c_nationkey", "c_custkey")).union(pair("supplier", "n:", "s:", "s_nationkey", "s_suppkey"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "thumbs_up").when(F.col("event_type") == "error", "thumbs_down")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_id").alias("id"), F.col("user_id").alias("generation_id"), F.get_json_object("props", "$.k").cast("bigint").alias("element_id"), kind.alias("feedback_type"), F.col("ts").alias("created_at"))
        .where("feedback_type is not null")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service outcomes: the event's user modulo 5 is the service, an error a failure."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("service"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), F.col("ts"))


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, "query_id int, text string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in words for the parts as components: (query_id, text)."""
    trait, kind = F.element_at("tags", -1), F.col("element_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("create a "), trait, F.lit(" "), "name")).when(kind == 1, F.concat(F.lit("show me "), "name", F.lit(" with "), trait)).when(kind == 2, F.concat(F.lit("update the "), "category", F.lit(" for "), trait))
    return components(spark, sf_dir).select(F.col("element_id").alias("query_id"), text.otherwise(F.col("name")).alias("text"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, copula, predicate, frequency, confidence): who belongs to which nation and region, what parts are and which of their words go together."""
    told = lambda df, a, b, f, c: df.select(a.alias("subject"), F.lit("-->").alias("copula"), b.alias("predicate"), F.lit(f).alias("frequency"), F.lit(c).alias("confidence")).distinct()
    part, kind = table(spark, sf_dir, "part"), F.lower("p_type")
    rows = [
        told(children(spark, sf_dir), F.col("dst"), F.col("src"), 0.95, 0.9),
        told(table(spark, sf_dir, "region"), F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")), F.lit("world"), 1.0, 0.99),
        told(part, F.col("p_name"), kind, 0.9, 0.8),
        told(part, kind, F.lit("product"), 1.0, 0.9),
        told(part, F.concat(F.lit("("), F.replace("p_name", F.lit(" "), F.lit(" * [")), F.lit("])")), F.lit("common_combination"), 1.0, 0.85),
        told(part.where("p_size > 25"), kind, F.lit("[layout]"), 1.0, 0.95),
    ]
    return reduce(DataFrame.unionByName, rows)


def _literal(rows) -> str:
    quote = lambda x: "NULL" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


SQL = {
    "v_element": """select p_partkey as element_id, p_name as name, lower(p_type) as category,
        case cast(regexp_extract(p_brand, '(\\d+)', 1) as int) % 5 when 0 then 'material-ui' when 1 then 'tailwind' when 2 then 'chakra' when 3 then 'bootstrap' else 'custom' end as design_system,
        string_split(p_name, ' ') as tags, ['p-' || p_size] as css_classes, p_retailprice as recency from part""",
    # the words are written out here, so that a wrong list elsewhere shows
    "v_component": """select p_partkey as element_id, p_name || ' ' || category as name, category, list_append(string_split(p_name, ' '), trait) as tags from (select *,
        ['button', 'form', 'card', 'navbar', 'modal', 'table', 'list', 'input', 'dropdown', 'checkbox', 'radio', 'slider', 'tabs', 'accordion', 'carousel', 'header', 'footer', 'sidebar', 'menu', 'breadcrumb',
         'pagination', 'tooltip', 'toast', 'avatar', 'badge', 'alert', 'progress'][1 + p_partkey % 27] as category,
        ['responsive', 'dark', 'light', 'animated', 'accessible', 'primary', 'secondary', 'large', 'small', 'medium', 'centered', 'rounded', 'outlined', 'filled', 'disabled', 'loading', 'icon', 'gradient', 'shadow',
         'hover', 'sticky', 'fixed', 'fullwidth', 'transparent'][1 + (p_partkey + p_size) % 24] as trait from part)""",
    "v_snippet": "select o_orderkey as snippet_id, o_orderpriority as design_system, o_orderdate as created_at from orders",
    "v_has_element": "select distinct l_orderkey as snippet_id, l_partkey as element_id from lineitem",
    "v_point": "select vec_id as id, embedding::double[] as vector, label as category, label % 5 as collection, 0.5::double as confidence from embeddings",
    "e_replace": "select a.p_partkey as src, b.p_partkey as dst from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey <> b.p_partkey",
    "e_child": """select 'r:' || n_regionkey as src, 'n:' || n_nationkey as dst from nation union all select 'n:' || c_nationkey, 'c:' || c_custkey from customer
        union all select 'n:' || s_nationkey, 's:' || s_suppkey from supplier""",
    "e_similar": """select src, dst, score from (select a.vec_id as src, b.vec_id as dst, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score,
        row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as k
        from embeddings a join embeddings b on a.vec_id <> b.vec_id) where k <= 3""",
    "v_feedback": """select event_id as id, user_id as generation_id, cast(json_extract_string(props, '$.k') as bigint) as element_id,
        case when event_type in ('purchase', 'signup') then 'thumbs_up' else 'thumbs_down' end as feedback_type, ts as created_at from events where event_type in ('purchase', 'signup', 'error')""",
    "v_asked": """select element_id as query_id, case element_id % 4 when 0 then 'create a ' || tags[-1] || ' ' || name when 1 then 'show me ' || name || ' with ' || tags[-1] when 2 then 'update the ' || category || ' for ' || tags[-1] else name end as text from v_component""",
    "v_statement": """select distinct subject, '-->' as copula, predicate, f::double as frequency, c::double as confidence from (
        select dst as subject, src as predicate, 0.95 as f, 0.9 as c from e_child union all select 'r:' || r_regionkey, 'world', 1.0, 0.99 from region union all select p_name, lower(p_type), 0.9, 0.8 from part
        union all select lower(p_type), 'product', 1.0, 0.9 from part union all select '(' || replace(p_name, ' ', ' * [') || '])', 'common_combination', 1.0, 0.85 from part union all select lower(p_type), '[layout]', 1.0, 0.95 from part where p_size > 25)""",
    "v_outcome": "select event_id, user_id % 5 as service, event_type <> 'error' as ok, value as latency, ts from events",
    "v_query": f"select * from (values {_literal(REQUESTS)}) t(query_id, text)",
}


def with_views(names: str, body: str) -> str:
    """``body`` after a WITH list of the named views; the body may go on with ', more as (...)' or begin with select."""
    head = "with recursive " + ",\n".join(f"{n} as ({SQL[n]})" for n in names.split())
    return f"{head}{'' if body.lstrip().startswith(',') else ' '}{body}"
