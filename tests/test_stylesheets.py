"""Style sheets against a parser that goes character by character, and the embedding cache."""

import random

import pytest
from pyspark.sql import functions as F

from fusegrid.functions import vectors as V
from fusegrid.operators import extraction as E
from fusegrid.operators import stylesheets as Y
from fusegrid.operators.embedding_cache import EmbeddingCache


def slow(css):
    """One character after the other: (ord, context, selector, name, value)."""
    out, stack, text, blocks, i, depth, custom = [], [], "", 0, 0, 0, 0

    def flush():
        nonlocal text
        at, text = text, ""
        if stack and ":" in at and at.split(":", 1)[0].strip() and not at.strip().startswith("@"):
            name, value = at.split(":", 1)
            out.append((stack[-1][2], stack[-1][0], stack[-1][1], name.strip(), value.strip()))

    while i < len(css):
        c = css[i]
        if css.startswith("/*", i):
            end = css.find("*/", i + 2)
            i = len(css) if end < 0 else end + 2
            continue
        if c in "\"'":
            j = i + 1
            while j < len(css) and css[j] != c and css[j] != "\n":
                j += 2 if css[j] == "\\" else 1
            j = j + 1 if j < len(css) and css[j] == c else min(j, len(css))
            text += css[i:j]
            i = j
            continue
        if css[i : i + 4].lower() == "url(" and css[i + 4 :].lstrip()[:1] not in ('"', "'", ""):
            j = i + 4
            while j < len(css) and css[j] != ")":
                j += 2 if css[j] == "\\" else 1
            text += css[i : j + 1]
            i = j + 1
            continue
        if c == "\\":
            text += css[i : i + 2]
            i += 2
            continue
        i += 1
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif custom or (c == "{" and text.strip().startswith("--") and ":" in text and not any(x.isspace() for x in text.split(":", 1)[0].strip())):
            custom += 1 if c == "{" else -1 if c == "}" else 0
        elif c == "{":
            head = " ".join(text.split())
            text, depth = "", 0
            context, selector = stack[-1][:2] if stack else ("", "")
            if head.startswith("@"):
                stack.append((" | ".join(x for x in (context, head) if x), selector, blocks))
            elif selector and "&" in head:
                stack.append((context, head.replace("&", selector), blocks))
            else:
                stack.append((context, " ".join(x for x in (selector, head) if x), blocks))
            blocks += 1
            continue
        elif c == ";" and depth == 0:
            flush()
            continue
        elif c == "}":
            flush()
            depth = 0
            if stack:
                stack.pop()
            continue
        text += c
    flush()
    return out


SHEET = """@charset "utf-8"; @import url(a;b.css);
:root { --color-primary: #00f; --map: {a: b; c}; --s: "}{;" }
.a::before { content: "}; color: red"; background: url(data:image/png;base64,AA==) no-repeat }
/* .gone { x: y } */ .b > .c, .d { margin: 0 ; padding : 1px/2px }
@media (min-width: 10px) { @supports (display: grid) { .e { display: grid; &:hover { color: RED } .f { top: 0 } } } .g{a:b} }
@font-face { font-family: 'X;{'; src: url( "x.woff" ) }
.h { grid-template-areas: "a b" "c d"; width: calc(1px + (2 * 3px)); } .i{color:red"""


def test_sheet():
    rows = list(Y.declarations(SHEET))
    assert rows == slow(SHEET)
    found = {(r[1], r[2], r[3]): r[4] for r in rows}
    assert found[("", ".a::before", "content")] == '"}; color: red"' and found[("", ".a::before", "background")] == "url(data:image/png;base64,AA==) no-repeat"
    assert found[("@media (min-width: 10px) | @supports (display: grid)", ".e:hover", "color")] == "RED" and found[("@media (min-width: 10px)", ".g", "a")] == "b"
    assert found[("", ":root", "--map")] == "{a: b; c}" and found[("", ".i", "color")] == "red" and found[("@font-face", "", "font-family")] == "'X;{'"
    assert not any("gone" in r[2] for r in rows)


@pytest.mark.parametrize("seed", range(40))
def test_any_text(seed):
    r = random.Random(seed)
    parts = ["{", "}", ";", ":", "a", " ", "\n", '"', "'", "\\", "/*", "*/", "url(", ")", "(", "@media x", "--v:", "&", ".b", "u", "/", "[", "]", "é"]
    css = "".join(r.choice(parts) for _ in range(r.randint(0, 150)))
    assert list(Y.declarations(css)) == slow(css), css


def test_pages(spark):
    html = f"<html><style>{SHEET}</style><body><p style=\"color:red;background:url('x;y')\">t</p><STYLE media=x>.z{{top:1px}}</STYLE><p style=''>u</p></body></html>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    rows = Y.page_rules(pages, E.html_nodes(pages)).collect()
    blocks = [(r["ord"], r["context"], r["selector"], r["name"], r["value"]) for r in rows if r["context"] != "style attribute"]
    assert blocks == slow(SHEET + "\n.z{top:1px}") and {r["page_id"] for r in rows} == {1}
    assert [(r["selector"], r["name"], r["value"]) for r in rows if r["context"] == "style attribute"] == [("p", "color", "red"), ("p", "background", "url('x;y')")]


def test_cache_computes_only_new_texts(spark, tmp_path):
    embed = lambda text: V.hash_embedding(text, 8, 8)
    cache = EmbeddingCache(spark, str(tmp_path), embed, "m")
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out, counts = cache.get_or_compute(frame(["a", "b", "a", None, ""]), 1)
    assert counts == {"texts": 5, "distinct": 3, "hits": 0, "misses": 3} and out.count() == 5
    out, counts = cache.get_or_compute(frame(["b", "c", None]), 2)
    assert counts == {"texts": 3, "distinct": 3, "hits": 2, "misses": 1}
    want = {r["id"]: r["v"] for r in frame(["b", "c", ""]).withColumn("v", embed(F.col("text"))).collect()}
    assert {r["id"]: r["embedding"] for r in out.collect()} == want
    assert cache.get_or_compute(frame(["b", "c", None]), 2)[1]["misses"] == 1 and cache.read().count() == 4  # the same batch again
    assert cache.get_or_compute(frame(["b", "c", None]), 3)[1] == {"texts": 3, "distinct": 3, "hits": 3, "misses": 0}
    (tmp_path / "model=m" / "batch=2" / "_SUCCESS").unlink()  # a batch that broke off is not read
    assert cache.read().count() == 3 and cache.get_or_compute(frame(["c"]), 4)[1]["misses"] == 1
    assert EmbeddingCache(spark, str(tmp_path), embed, "other").get_or_compute(frame([]), 1)[1]["texts"] == 0
