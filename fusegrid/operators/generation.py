"""Text side of code generation: fenced blocks of replies, an HTML check, documents, prompts, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L


def code_block(text: Column, languages: str) -> Column:
    """Trimmed content of the first fenced block of a language; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, rf"```(?:{languages})\s*\n([\s\S]*?)```", 1), r"^\s+|\s+$", "")), F.lit(""))


def parse_reply(rows: DataFrame, text_col: str) -> DataFrame:
    t = F.col(text_col)
    return rows.withColumn("html", code_block(t, "html")).withColumn("css", code_block(t, "css")).withColumn("javascript", code_block(t, "javascript|js"))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def unclosed_tags(text: Column) -> Column:
    """Tags whose opening (as a beginning of a tag's name) is counted more often than their closing, and a missing doctype."""
    found = [F.when(_count(text, f"<{t}") > _count(text, f"</{t}"), F.lit(t)) for t in L.CHECKED_TAGS]
    found.append(F.when(text.contains("<html") & ~F.lower(text).contains("<!doctype"), F.lit("!doctype")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def html_document(html: Column, css: Column, js: Column) -> Column:
    """One document of the parts that are there, their lines set in."""

    def lines(body: Column, pad: str) -> Column:
        whole = F.regexp_replace(body, r"\r?\n\z", "")
        return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(pad), F.regexp_replace(whole, r"\r?\n", f"\n{pad}"), F.lit("\n")))

    block = lambda tag, body: F.when(body.isNotNull(), F.concat(F.lit(f"  <{tag}>\n"), lines(body, "    "), F.lit(f"  </{tag}>\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(L.DOCUMENT_HEAD), block("style", css), F.lit("</head>\n<body>\n"), F.coalesce(lines(html, "  "), F.lit("")), block("script", js), F.lit("</body>\n</html>"))


def prompts(queries: DataFrame, references: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, prompt): the request and at most five references(query_id, place, name, category)."""
    few = references.where(F.col("place") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "category"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda r: F.concat(F.lit("- "), r["name"], F.lit(" ("), r["category"], F.lit(")"))), "\n")
    joined = queries.join(few, "query_id", "left")
    return joined.select("query_id", F.concat_ws("\n", F.concat(F.lit("Request: "), "text"), F.when(F.size("r") > 0, F.concat(F.lit("References:\n"), lines))).alias("prompt"))


def templates(spark: SparkSession) -> DataFrame:
    """Our own starting templates, a row a category."""
    rows = [
        (0, "button", '<button class="btn" type="button">Label</button>', ".btn{padding:8px 16px;border-radius:4px}"),
        (1, "form", '<form><label>Name<input name="name"></label><button type="submit">Send</button></form>', "form{display:grid;gap:8px}"),
        (2, "card", '<div class="card"><h2>Title</h2><p>Text</p></div>', ".card{padding:16px;box-shadow:0 1px 4px #0003}"),
        (3, "navbar", '<nav class="navbar"><a href="/">Home</a></nav>', ".navbar{display:flex;gap:16px}"),
    ]
    return spark.createDataFrame(rows, "ord int, category string, html string, css string")


def templates_for(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, ord, html) in the order of the wanted categories; unknown ones are left out."""
    # an outer explode: for an inner one Spark looks for the categories twice, the first time before the rows are dealt to tasks; a null joins nothing
    rows = wanted.select("query_id", F.posexplode_outer("categories").alias("ord", "category"))
    return rows.join(F.broadcast(known.select("category", "html")), "category").select("query_id", "ord", "category", "html")  # four rows
