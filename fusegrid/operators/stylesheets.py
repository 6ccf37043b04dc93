"""Style sheets by a stack of braces: declarations with their selector and the at-rules around them.

Strings, comments and ``url()`` are tokens of their own, so that what they hold ends nothing. A selector inside a rule is nested: it follows the outer one, or
takes its place at ``&``. The value of a custom property may hold braces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|url\(\s*(?!["'\s])(?:[^)\\]|\\.)*(?:\)|\Z)|\\.|[{};()\[\]]|[^{};()\[\]"'\\/uU]+|.""", re.DOTALL | re.IGNORECASE)
_CUSTOM = re.compile(r"\s*--[^\s:]+\s*:")
_SPACE = re.compile(r"\s+")
RULES = "ord int, context string, selector string, name string, value string"


def declarations(css: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(number of the block, at-rules around it joined by bars, selector, name, value) in the order of the sheet."""
    stack: list[tuple[str, str, int]] = []  # at-rules, selector, number of the open block
    held: list[str] = []
    blocks, inner, curly = 0, 0, 0  # open brackets, and open braces of a custom property's value

    def told() -> tuple | None:
        text = "".join(held)
        held.clear()
        name, colon, value = text.partition(":")
        if stack and colon and name.strip() and not text.lstrip().startswith("@"):
            context, selector, number = stack[-1]
            return number, context, selector, name.strip(), value.strip()
        return None

    for match in _TOKEN.finditer(css):
        token = match.group()
        if token.startswith("/*"):
            continue
        if token in ("(", "["):
            inner += 1
        elif token in (")", "]"):
            inner = max(inner - 1, 0)
        elif curly or (token == "{" and _CUSTOM.match("".join(held))):
            curly += (token == "{") - (token == "}")
        elif token == "{":
            prelude = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            inner = 0
            context, selector, _ = stack[-1] if stack else ("", "", 0)
            if prelude.startswith("@"):
                stack.append((f"{context} | {prelude}" if context else prelude, selector, blocks))
            else:
                whole = prelude.replace("&", selector) if selector and "&" in prelude else f"{selector} {prelude}".strip()
                stack.append((context, whole, blocks))
            blocks += 1
            continue
        elif token == ";" and not inner:
            row = told()
            if row:
                yield row
            continue
        elif token == "}":
            row, inner = told(), 0
            if row:
                yield row
            if stack:
                stack.pop()
            continue
        held.append(token)
    row = told()
    if row:
        yield row


def style_rules(sheets: DataFrame, id_col: str, css_col: str) -> DataFrame:
    """(id, ord, context, selector, name, value) of every declaration; a null sheet has none, one that breaks off ends where it does."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(key, *row) for key, css in zip(part.column("_id").to_pylist(), part.column("_css").to_pylist(), strict=True) for row in declarations(css or "")]
                ids = pa.array([r[0] for r in rows], part.column("_id").type)
                kinds = [pa.int32(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds)]], [id_col, "ord", "context", "selector", "name", "value"])

    kind = sheets.schema[id_col].dataType.simpleString()
    return sheets.select(F.col(id_col).alias("_id"), F.col(css_col).alias("_css")).mapInArrow(run, f"{id_col} {kind}, {RULES}")


def page_rules(pages: DataFrame, nodes: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Declarations of each page's style elements, and of style attributes: their context is ``style attribute`` and their selector the element's tag, ord its number."""
    sheets = pages.select(F.col(id_col).cast("long").alias("page_id"), F.array_join(F.regexp_extract_all(html_col, F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), 1), "\n").alias("css"))
    whole = style_rules(sheets, "page_id", "css")
    at = F.array_position("names", "style").cast("int")
    own = nodes.where(at > 0).select("page_id", "node_id", "tag", F.concat(F.lit("x{"), F.get("vals", at - 1), F.lit("}")).alias("css"))
    own = own.withColumn("key", F.to_json(F.struct("page_id", "node_id", "tag")))
    inside = style_rules(own, "key", "css").withColumn("_k", F.from_json("key", "page_id long, node_id int, tag string"))
    return whole.union(inside.select("_k.page_id", F.col("_k.node_id").alias("ord"), F.lit("style attribute").alias("context"), F.col("_k.tag").alias("selector"), "name", "value"))
