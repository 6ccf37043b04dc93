"""Extraction from HTML, CSS and JavaScript: element rows, rules and tokens, script structure, design systems, categories, statements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L
from fusegrid.functions import scalar as S
from fusegrid.functions import vectors as V
from fusegrid.operators.stylesheets import declarations, style_rules

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
NODES = "page_id long, node_id int, parent_id int, depth int, tag string, id string, classes array<string>, names array<string>, vals array<string>, text string"


class _Nodes(HTMLParser):
    """Element rows in document order; the text is the last non-empty one directly inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        while self.open and self.rows[self.open[-1]]["tag"] in _CLOSES.get(tag, ()):
            self.open.pop()
        names, vals = [k.lower() for k, _ in attrs], [(v or "").strip("\"'") for _, v in attrs]
        own = dict(reversed(list(zip(names, vals, strict=True))))
        row = {"node_id": len(self.rows), "parent_id": self.open[-1] if self.open else None, "depth": len(self.open), "tag": tag, "id": own.get("id"), "classes": own.get("class", "").split(), "names": names, "vals": vals, "text": None}
        self.rows.append(row)
        if tag not in _VOID:
            self.open.append(row["node_id"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        if self.open and data.strip():
            self.rows[self.open[-1]]["text"] = data.strip()


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row an element: page_id, node_id, parent_id, depth, tag, id, classes, attribute names and values, text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("vals", pa.list_(pa.string())), ("text", pa.string())]
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # the nodes of so many pages are held
                part, rows = batch.slice(at, 32), []
                for page, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True):
                    parser = _Nodes()
                    parser.feed(html or "")
                    parser.close()
                    rows += [{"page_id": page, **r} for r in parser.rows]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, NODES)


def distinct_sorted(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group)))


def structure(nodes: DataFrame) -> DataFrame:
    """tags, classes and ids of each page, sorted and distinct."""
    classes = nodes.select("page_id", F.explode("classes").alias("c")).groupBy("page_id").agg(F.array_sort(F.collect_set("c")).alias("classes"))
    base = nodes.groupBy("page_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.array_sort(F.collect_set("id")).alias("ids"))
    return base.join(classes, "page_id", "left").select("page_id", "tags", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), "ids")


def css_rules(sheets: DataFrame, id_col: str, css_col: str) -> DataFrame:
    """(id, ord, selector, name, value): declarations of every rule set, also inside at-rules."""
    return style_rules(sheets, id_col, css_col).drop("context")


def design_tokens(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("name").startswith("--")).withColumn("token_category", S.token_category(F.col("name"), F.col("value")))


# Structure of a script by patterns, on its text without comments and with strings emptied; regular expression literals are not told apart.
_STRING = r"""(?:"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)"""
_COMMENT = r"(?://[^\n]*|/\*[\s\S]*?\*/)"
_NAME_STRING = r"""(?:"[\w./@:-]*+"|'[\w./@:-]*+')"""
_FUNCTION = r"(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
_ARROW = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(async\s+)?(?:\(([^)]*)\)|([A-Za-z_$][\w$]*))\s*=>"
_VARIABLE = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?:=|;)"
_IMPORT = r"import\s+(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\}\s*)?(?:from\s*)?['\"]([^'\"]+)['\"]"
_LISTEN = r"addEventListener\(\s*['\"](\w+)['\"]"


def js_code(js: Column, names: bool = False) -> Column:
    """A script without comments and strings; with ``names``, strings of one plain name, as of modules and events, stay."""
    plain = F.regexp_replace(js, f"({_STRING})|{_COMMENT}", "$1 ")
    return F.regexp_replace(plain, f"({_NAME_STRING})|{_STRING}", "$1") if names else F.regexp_replace(plain, _STRING, "")


def js_structure(scripts: DataFrame, id_col: str, js_col: str) -> DataFrame:
    """(id, functions, async_functions, arrows, variables, imports, default_imports, listeners, handlers, dom_calls), arrays in order."""
    scripts = scripts.select(id_col, js_code(F.col(js_col)).alias("_code"), js_code(F.col(js_col), True).alias("_named"))
    all_of = lambda p, g: F.regexp_extract_all("_code", F.lit(p), g)
    named = lambda p, g: F.regexp_extract_all("_named", F.lit(p), g)
    handlers = F.filter(F.array(*[F.when(F.col("_code").rlike(rf"\.{h}\s*=[^=]"), F.lit(h[2:])) for h in L.HANDLERS]), lambda x: x.isNotNull())
    calls = F.filter(F.array(*[F.when(F.col("_code").contains(c), F.lit(c)) for c in L.DOM_CALLS]), lambda x: x.isNotNull())
    return scripts.select(
        id_col,
        all_of(_FUNCTION, 2).alias("functions"),
        F.regexp_extract_all("_code", F.lit(r"async\s+function\s*\*?\s*([A-Za-z_$][\w$]*)"), 1).alias("async_functions"),
        all_of(_ARROW, 1).alias("arrows"),
        F.filter(all_of(_VARIABLE, 1), lambda v: ~F.array_contains(all_of(_ARROW, 1), v)).alias("variables"),
        named(_IMPORT, 3).alias("imports"),
        F.filter(named(_IMPORT, 1), lambda x: x != "").alias("default_imports"),
        named(_LISTEN, 1).alias("listeners"),
        handlers.alias("handlers"),
        calls.alias("dom_calls"),
    )


def system_scores(text: Column, low: Column) -> list[tuple[str, Column]]:
    """0.1 a class match, 2 an import that occurs, 0.5 a component, for each design system.

    ``low`` is the text in lower case: a class that begins with letters not found in it has no match, and is not looked for by its pattern.
    """
    out = []
    for name, (classes, imports, components) in L.DESIGN_SYSTEMS.items():
        score = F.lit(0.0)
        for p in classes:
            count, begins = F.regexp_count(text, F.lit("(?i)" + p)), re.match(r"\\b([a-z-]+)(?![*+?{|])", p, re.IGNORECASE)
            score = score + (F.when(low.contains(begins[1].lower()), count).otherwise(0) if begins else count) * F.lit(0.1)
        for p in imports:
            score = score + F.when(text.rlike(p), F.lit(2.0)).otherwise(F.lit(0.0))
        if components:
            score = score + F.regexp_count(text, F.lit(f"<(?:{'|'.join(components.split())})")) * F.lit(0.5)
        out.append((name, score))
    return out


def detect_system(rows: DataFrame, *texts: str) -> DataFrame:
    """With design_system, score and system_confidence = min(score / 10, 1); ties go to the first in order, no score is unknown."""
    whole = rows.withColumn("_t", F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])).withColumn("_l", F.lower("_t"))
    best = F.array_max(F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(system_scores(F.col("_t"), F.col("_l")))]))
    out = whole.withColumn("_b", best).withColumn("score", F.col("_b.s"))
    out = out.withColumn("design_system", F.when(F.col("score") > 0, F.col("_b.n")).otherwise("unknown"))
    return out.withColumn("system_confidence", F.least(F.col("score") / 10, F.lit(1.0))).drop("_b", "_t", "_l")


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def category_of(tag: Column, classes: Column, names: Column, vals: Column) -> Column:
    """Role, then input type, then class, then tag; an unknown role changes nothing, an unknown input type is an input."""
    value = lambda n: F.get(vals, F.array_position(names, F.lit(n)).cast("int") - 1)
    joined = F.lower(F.array_join(classes, " "))
    by_class = F.coalesce(*[F.when(joined.contains(p), F.lit(c)) for p, c in L.CLASS_CATEGORIES.items()])
    by_type = F.when((tag == "input") & F.array_contains(names, "type"), F.coalesce(_mapped(value("type"), L.INPUT_TYPE_CATEGORIES), F.lit("input")))
    return F.coalesce(_mapped(value("role"), L.ROLE_CATEGORIES), by_type, by_class, _mapped(tag, L.TAG_CATEGORIES), F.lit("unknown"))


def map_elements(nodes: DataFrame, systems: DataFrame | None = None, key: str = "page_id", roots_only: bool = True) -> DataFrame:
    """Elements with category and element_type; systems(key, design_system, interactive), or none if the nodes have these columns.

    There are as many systems as pages, whatever size their files show: they are merged by key, not sent to every executor through the driver.
    """
    own = nodes.where("depth = 0") if roots_only else nodes
    own = own.withColumn("category", category_of(F.col("tag"), F.col("classes"), F.col("names"), F.col("vals")))
    whole = own if systems is None else own.join(systems.hint("merge"), key)
    return whole.withColumn("element_type", F.concat_ws("-", "design_system", "category"))


def _said(category: Column, classes: Column, system: Column, interactive: Column, frequency: float = 0.9, confidence: float = 0.5) -> Column:
    """What an element says, as an array of (kind, statement, once): what holds for a page as a whole counts once a page."""
    truth, sure = F.lit(f". %{frequency:.2f};{confidence:.2f}%"), F.lit(". %1.00;0.90%")
    term = S.element_term(category, classes)
    said = lambda kind, once, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*parts).alias("statement"), F.lit(once).alias("once"))
    parents = {c: p for p, cs in L.CATEGORY_PARENTS.items() for c in cs}
    parent = _mapped(category, parents)
    own = F.array(
        said("instance", False, F.lit("{"), term, F.lit("} --> "), S.category_term(category), truth),
        said("instance", False, F.lit("{"), term, F.lit("} --> "), S.system_term(system), truth),
        F.when(interactive, said("property", False, term, F.lit(" --> [interactive]"), truth)),
        F.when(parent.isNotNull(), said("inheritance", True, S.category_term(category), F.lit(" --> "), parent, sure)),
        *[said("inheritance", True, F.lit(p), F.lit(" --> UIElement"), sure) for p in L.CATEGORY_PARENTS],
    )
    of_classes = F.transform(classes, lambda c: said("property", False, term, F.lit(" --> ["), S.sanitize_term(c), F.lit("]"), truth))
    return F.filter(F.concat(own, of_classes), lambda x: x.isNotNull())


def statements(elements: DataFrame, key: str = "page_id", tokens: DataFrame | None = None, frequency: float = 0.9, confidence: float = 0.5) -> DataFrame:
    """(key, kind, statement): instance, class property, interactivity, system membership, tokens, used hierarchy, top level.

    The elements are read once: each gives all that it says as an array, and what holds for a page as a whole is made distinct behind it.
    """
    said = _said(F.col("category"), F.col("classes"), F.col("design_system"), F.col("interactive"), frequency, confidence)
    rows = elements.select(key, F.monotonically_increasing_id().alias("_n"), F.explode(said).alias("s")).select(key, "s.*", "_n")
    # a row of what is said once a page has no number of its own
    once = rows.withColumn("_n", F.when(~F.col("once"), F.col("_n"))).groupBy(key, "kind", "statement", "_n").agg(F.count("*").alias("_c"), F.first("once").alias("once"))
    out = once.withColumn("_r", F.explode(F.sequence(F.lit(1), F.when(F.col("once"), F.lit(1)).otherwise(F.col("_c").cast("int"))))).select(key, "kind", "statement")
    if tokens is not None:
        n, truth = S.sanitize_term(F.col("name")), F.lit(f". %{frequency:.2f};{confidence:.2f}%")
        out = out.union(tokens.select(key, F.lit("instance").alias("kind"), F.concat(F.lit("<{"), n, F.lit("} --> DesignToken_"), "token_category", F.lit("> && <{"), n, F.lit("} --> [value_"), S.sanitize_term(F.col("value")), F.lit("]>"), truth).alias("statement")))
    return out


def _text(system: Column, categories: Column, elements: Column) -> Column:
    """A page's mapping in words, of its (node_id, element_type, classes, interactive), parts joined by bars."""
    details = F.flatten(F.transform(F.array_sort(elements), lambda e: F.filter(F.array(
        F.concat(F.lit("element type: "), e["element_type"]),
        F.when(F.size(e["classes"]) > 0, F.concat(F.lit("classes: "), F.array_join(e["classes"], " "))),
        F.when(e["interactive"], F.lit("interactive: yes")),
    ), lambda x: x.isNotNull())))
    return F.array_join(F.concat(F.array(F.concat(F.lit("design system: "), system), F.concat(F.lit("categories: "), F.array_join(F.array_sort(categories), ", "))), details), " | ")


def embedding_text(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text): a page's mapping in words, parts joined by bars; roots of a page are few."""
    out = elements.groupBy(key).agg(F.first("design_system").alias("s"), F.collect_set("category").alias("c"), F.collect_list(F.struct("node_id", "element_type", "classes", "interactive")).alias("e"))
    return out.select(key, _text(F.col("s"), F.col("c"), F.col("e")).alias("text"))


def _inside(html_col: str, tag: str, between: str) -> Column:
    return F.array_join(F.regexp_extract_all(html_col, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1), between)


_ROOTS = "array<struct<node_id:int,parent_id:int,depth:int,tag:string,id:string,classes:array<string>,names:array<string>,vals:array<string>,text:string>>"
_RULES = "array<struct<name:string,value:string>>"


def page_systems(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, _h, design_system, system_confidence, interactive) of each page, ``_h`` its HTML; calls are looked for in scripts without their comments and strings."""
    systems = detect_system(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("_h"), _inside(html_col, "script", " ").alias("_j")), "_h", "_j")
    active = S.bound(js_code(F.col("_j")), lambda code: F.coalesce(*[F.when(code.contains(c), F.lit(True)) for c in [*L.DOM_CALLS, "addEventListener"]], F.lit(False)))
    return systems.select("page_id", "_h", "design_system", "system_confidence", active.alias("interactive"))


def page_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row a page id: (page_id, systems, elements, rules), arrays of its design systems, mapped root elements and declarations (name, value).

    Each page is read, looked through and parsed once, and what is left of it moves once, so that pages of one id meet: each of their elements is mapped
    with each of their systems. A null id has no elements and no rules. Few bytes are left of a page, and from these every reader makes many: they are dealt to a
    given number of tasks, else adaptive execution gathers the pages of a large table in one.
    """
    asked = page_systems(pages, id_col, html_col).withColumn("_css", _inside("_h", "style", "\n"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        texts = pa.list_(pa.string())
        root = pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", texts), ("names", texts), ("vals", texts), ("text", pa.string())]))
        rule = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # the nodes of so many pages are held
                part, roots, rules = batch.slice(at, 32), [], []
                for html, css in zip(part.column("_h").to_pylist(), part.column("_css").to_pylist(), strict=True):
                    parser = _Nodes()
                    parser.feed(html or "")
                    parser.close()
                    roots.append([r for r in parser.rows if r["depth"] == 0])
                    rules.append([{"name": name, "value": value} for *_, name, value in declarations(css or "")])
                kept = [part.column(c) for c in ("page_id", "design_system", "system_confidence", "interactive")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(roots, root), pa.array(rules, rule)], ["page_id", "design_system", "system_confidence", "interactive", "roots", "rules"])

    kind = asked.schema["page_id"].dataType.simpleString()
    parsed = asked.mapInArrow(run, f"page_id {kind}, design_system string, system_confidence double, interactive boolean, roots {_ROOTS}, rules {_RULES}")
    some = lambda c: F.when(F.col("page_id").isNotNull(), F.flatten(F.collect_list(c))).otherwise(F.array())
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = parsed.repartition(tasks, "page_id").groupBy("page_id").agg(F.collect_list(F.struct("design_system", "system_confidence", "interactive")).alias("systems"), some("roots").alias("_r"), some("rules").alias("rules"))

    def mapped(r: Column, s: Column) -> Column:
        category = category_of(r["tag"], r["classes"], r["names"], r["vals"])
        return r.withField("category", category).withField("design_system", s["design_system"]).withField("system_confidence", s["system_confidence"]).withField("interactive", s["interactive"])

    typed = lambda e: e.withField("element_type", F.concat_ws("-", e["design_system"], e["category"]))
    elements = F.transform(F.flatten(F.transform("systems", lambda s: F.transform("_r", lambda r: mapped(r, s)))), typed)
    return met.select("page_id", "systems", elements.alias("elements"), "rules")


def _page_said(elements: str) -> Column:
    """All statements of a page's elements, those that count once a page made distinct."""
    every = F.flatten(F.transform(elements, lambda e: _said(e["category"], e["classes"], e["design_system"], e["interactive"])))
    return S.bound(every, lambda a: F.concat(F.filter(a, lambda x: ~x["once"]), F.array_distinct(F.filter(a, lambda x: x["once"]))))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Root elements of pages with category, type, design system and interactivity."""
    return page_rows(pages, id_col, html_col).select(F.col("page_id").cast("long").alias("page_id"), F.inline("elements"))


def page_statements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, kind, statement): the statements of the pages' root elements, made where a page's elements are, after the only shuffle."""
    said = page_rows(pages, id_col, html_col).select(F.col("page_id").cast("long").alias("page_id"), F.explode(_page_said("elements")).alias("s"))
    return said.select("page_id", "s.kind", "s.statement")


def extract_full(pages: DataFrame, dimensions: int = 1536, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a page, of all five phases: structure, design system, mapping with tokens, statements and the embedding of the mapping's text.

    (page_id, design_system, system_confidence, interactive, elements, rules, tokens, statements, text, embedding): counts of the root elements,
    declarations and statements; tokens are the sorted, distinct ``category name value`` of the page's style sheets. A page without
    elements has an empty text and no embedding. Pages of one id count as one.
    """
    own = F.filter("rules", lambda r: r["name"].startswith("--"))
    rows = page_rows(pages, id_col, html_col).withColumns({"_own": own, "_s": F.array_min("systems")})
    named = F.transform("_own", lambda r: F.concat_ws(" ", S.token_category(r["name"], r["value"]), r["name"], r["value"]))
    shown = F.transform("elements", lambda e: F.struct(e["node_id"].alias("node_id"), e["element_type"].alias("element_type"), e["classes"].alias("classes"), e["interactive"].alias("interactive")))
    text = _text(F.col("_s.design_system"), F.array_distinct(F.transform("elements", lambda e: e["category"])), shown)
    out = rows.select(
        "page_id",
        "_s.*",
        F.size("elements").cast("long").alias("elements"),
        F.size("rules").cast("long").alias("rules"),
        F.array_sort(F.array_distinct(named)).alias("tokens"),
        (F.size(_page_said("elements")) + F.size("_own")).cast("long").alias("statements"),
        F.when(F.size("elements") > 0, text).otherwise("").alias("text"),
    )
    return out.withColumn("embedding", F.when(F.col("text") != "", V.hash_embedding(F.col("text"), dimensions)))
