"""Scripts by a lexer with a stack of scopes: comments, strings, templates with code inside, and regular expressions are told from code before anything is looked for."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import lexicon as L

_SPACE = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_NAME = re.compile(r"[^\W\d][\w$]*|[$#][\w$]*", re.UNICODE)
_NUMBER = re.compile(r"\.?\d[\w.]*")
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?""", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
_SIGN = re.compile(r"=>|[=!]==?|\.\.\.|\?\.|[-+*/%&|^<>]=|.", re.DOTALL)
_KINDS = [("space", _SPACE), ("name", _NAME), ("number", _NUMBER), ("text", _STRING), ("regex", _REGEX), ("sign", _SIGN)]
#: What comes next where a regular expression may begin, and behind a value, where a slash divides.
_FIRST, _BEHIND_VALUE = (re.compile("|".join(f"(?P<{k}>(?s:{p.pattern}))" if p.flags & re.DOTALL else f"(?P<{k}>{p.pattern})" for k, p in _KINDS if k != left)) for left in ("", "regex"))
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
STRUCTURE = "functions array<string>, async_functions array<string>, arrows array<string>, function_variables array<string>, variables array<string>, classes array<string>, imports array<string>, default_imports array<string>, listeners array<string>, handlers array<string>, dom_calls array<string>, nested array<string>"


def tokens(js: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, depth) of a script: name, number, text (a string's or template's content), regex, sign; depth: open braces of code around it."""
    at, depth, templates = 0, 0, []  # templates: the depths at which a template goes on behind a brace
    kind, text = "sign", ""

    def template(start: int) -> tuple[str, int, bool]:
        end = _TEMPLATE.match(js, start).end()
        inside = js.startswith("${", end)
        return js[start:end], min(end + (2 if inside else 1), len(js)), inside

    while at < len(js):
        value_before = kind in ("number", "text", "regex") or (kind == "name" and text not in _BEFORE_REGEX) or (kind == "sign" and text in (")", "]", "}"))
        found = (_BEHIND_VALUE if value_before else _FIRST).match(js, at)
        name = found.lastgroup
        if name == "space":
            at = found.end()
            continue
        c = js[at]
        if c == "`" or (c == "}" and templates and templates[-1] == depth):
            if c == "}":
                templates.pop()
                depth -= 1
            text, at, inside = template(at + 1)
            yield "text", text, depth
            kind = "text"
            if inside:
                depth += 1
                templates.append(depth)
                kind, text = "sign", "{"
            continue
        kind, text, at = name, found.group(), found.end()
        if kind == "text":
            text = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
        if kind == "sign" and text == "}":
            depth = max(depth - 1, 0)
        yield kind, text, depth
        if kind == "sign" and text == "{":
            depth += 1


def structure(js: str) -> dict[str, list[str]]:
    """What a script declares and uses, in order; see ``STRUCTURE``. ``nested``: functions declared inside braces."""
    t = [*tokens(js), *[("end", "", 0)] * 4]
    out: dict[str, list[str]] = {x.split()[0]: [] for x in STRUCTURE.split(", ")}
    sign = lambda i, *texts: t[i][0] == "sign" and t[i][1] in texts
    word = lambda i, *texts: t[i][0] == "name" and (not texts or t[i][1] in texts)

    def closing(i: int) -> int:
        """Behind the bracket that closes the one at i."""
        level = 0
        while i < len(t) - 4:
            level += sign(i, "(", "[", "{")
            level -= sign(i, ")", "]", "}")
            i += 1
            if not level:
                break
        return i

    for i in range(len(t) - 4):
        if t[i][0] != "name" or (i and sign(i - 1, ".", "?.") and t[i][1] not in L.DOM_CALLS and t[i][1] != "addEventListener" and not t[i][1].startswith("on")):
            continue
        w = t[i][1]
        after_dot = i > 0 and sign(i - 1, ".", "?.")
        if w == "function" and not after_dot:
            k = i + 1 + sign(i + 1, "*")
            if word(k) and sign(k + 1, "("):
                out["functions"].append(t[k][1])
                if i and word(i - 1, "async"):
                    out["async_functions"].append(t[k][1])
                if t[i][2]:
                    out["nested"].append(t[k][1])
        elif w in ("const", "let", "var") and not after_dot:
            k = i + 1
            while word(k):
                name, k = t[k][1], k + 1
                if sign(k, "="):
                    v = k + 1 + word(k + 1, "async")
                    if word(v, "function"):
                        out["function_variables"].append(name)
                    elif (sign(v, "(") and sign(closing(v), "=>")) or (word(v) and sign(v + 1, "=>")):
                        out["arrows"].append(name)
                    else:
                        out["variables"].append(name)
                    k = v + 1 if word(v, "function") else k + 1
                    while k < len(t) - 4 and not sign(k, ",", ";") and not (sign(k, ")", "]", "}")) and not word(k, "const", "let", "var", "function", "class", "export") and not (word(k, "import") and not sign(k + 1, "(", ".")):
                        k = closing(k) if sign(k, "(", "[", "{") else k + 1
                elif not word(k, "of", "in"):
                    out["variables"].append(name)
                if not sign(k, ","):
                    break
                k += 1
        elif w == "class" and word(i + 1) and not after_dot:
            out["classes"].append(t[i + 1][1])
        elif w == "import" and not after_dot and not sign(i + 1, "(", "."):
            k = i + 1
            if word(k) and not word(k, "from"):
                out["default_imports"].append(t[k][1])
            while k < len(t) - 4 and t[k][0] != "text" and not sign(k, ";"):
                k += 1
            if t[k][0] == "text":
                out["imports"].append(t[k][1])
        elif w == "addEventListener" and sign(i + 1, "(") and t[i + 2][0] == "text":
            out["listeners"].append(t[i + 2][1])
        elif after_dot and w.startswith("on") and w in L.HANDLERS and sign(i + 1, "="):
            out["handlers"].append(w[2:])
        if w in L.DOM_CALLS:
            out["dom_calls"].append(w)
    for name in ("handlers", "dom_calls"):
        out[name] = list(dict.fromkeys(out[name]))
    return out


def script_structure(scripts: DataFrame, id_col: str, js_col: str) -> DataFrame:
    """(id, and the columns of ``STRUCTURE``) of every row; a null script declares nothing."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in STRUCTURE.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [structure(js or "") for js in part.column("_js").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *[pa.array([r[n] for r in rows], pa.list_(pa.string())) for n in names]], [id_col, *names])

    kind = scripts.schema[id_col].dataType.simpleString()
    return scripts.select(F.col(id_col).alias("_id"), F.col(js_col).alias("_js")).mapInArrow(run, f"{id_col} {kind}, {STRUCTURE}")
