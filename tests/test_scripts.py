"""The lexer of scripts against one that goes character by character, and what is found in scripts."""

import random

import pytest

from fusegrid.operators import scripts as X

SCRIPT = r"""import React, { useState as u } from 'react'; import './a.css'; import * as all from "all"
export default async function load(x, y) { const inner = `a ${ { b: `c ${ d() } }` } } e`; function deep() {} return /[/"'{]function no() {}/g.test(x) }
function* walk() { yield /x/ }
const add = (a, b = (1, 2)) => a + b, one = z => z / 2 / 3, f = async () => {}, g = function () {}, h = async function named() {}, n = 3, m = [1, 2, { k: (5) }], s = "var t = 1; it's // x";
let bare; var p, q = 'el.onclick = a'
for (const item of items) {} for (let i = 0; i < 3; i++) {}
document.querySelector('#a').addEventListener('click', add); el.onchange = add; el.onclick === 1; obj.function; a.const = 1
// function gone() {}
/* import x from 'y'; const z = 1; */
class Box extends Base { #own = 1; go() { window?.addEventListener(`load`, () => {}) } }
const html = `<p onclick="x">function t() {}</p>`; const r = a / b; function last() {} // "
const dyn = import('later'), rest = x.map(y => y)
"""


def test_structure(spark):
    got = X.structure(SCRIPT)
    assert got["functions"] == ["load", "deep", "walk", "named", "last"] and got["async_functions"] == ["load", "named"] and got["nested"] == ["deep"]
    assert got["arrows"] == ["add", "one", "f"] and got["function_variables"] == ["g", "h"]
    assert got["variables"] == ["inner", "n", "m", "s", "bare", "p", "q", "i", "html", "r", "dyn", "rest"]
    assert got["imports"] == ["react", "./a.css", "all"] and got["default_imports"] == ["React"] and got["classes"] == ["Box"]
    assert got["listeners"] == ["click", "load"] and got["handlers"] == ["change"] and got["dom_calls"] == ["querySelector"]
    rows = X.script_structure(spark.createDataFrame([(1, SCRIPT), (2, None), (3, "let a = `${")], "k long, js string"), "k", "js").orderBy("k").collect()
    assert rows[0]["functions"] == got["functions"] and rows[1]["variables"] == [] and rows[2]["variables"] == ["a"]


def slow(js):
    """Names of code alone, one character after the other."""
    out, i, braces, back, word, last = [], 0, 0, [], "", ""

    def flush():
        nonlocal word, last
        if word:
            if not (word[0].isdigit()):
                out.append(word)
            last = "keyword" if word in X._BEFORE_REGEX else "value"
            word = ""

    def quoted(i, q):
        i += 1
        while i < len(js) and js[i] != q and js[i] != "\n":
            i += 2 if js[i] == "\\" else 1
        return min(i + 1, len(js)) if i < len(js) and js[i] == q else min(i, len(js))

    def template(i):
        """Behind the text; whether code follows."""
        while i < len(js):
            if js[i] == "\\":
                i += 2
            elif js[i] == "`":
                return i + 1, False
            elif js.startswith("${", i):
                return i + 2, True
            else:
                i += 1
        return i, False

    def regex(i):
        k, inside = i + 1, False
        while k < len(js) and js[k] != "\n":
            if js[k] == "\\":
                k += 2
                continue
            if js[k] == "[":
                end = k + 1
                while end < len(js) and js[end] != "]" and js[end] != "\n":
                    end += 2 if js[end] == "\\" else 1
                if end >= len(js) or js[end] != "]":
                    return None
                k = end + 1
                continue
            if js[k] == "/":
                if k == i + 1:
                    return None
                k += 1
                while k < len(js) and js[k].isascii() and js[k].isalpha():
                    k += 1
                return k
            k += 1
        return None

    while i < len(js):
        c = js[i]
        if c.isalnum() or c in "_$":
            word += c
            i += 1
            continue
        flush()
        if c.isspace():
            i += 1
        elif js.startswith("//", i):
            i = js.find("\n", i) if "\n" in js[i:] else len(js)
        elif js.startswith("/*", i):
            end = js.find("*/", i + 2)
            i = len(js) if end < 0 else end + 2
        elif c in "\"'":
            i, last = quoted(i, c), "value"
        elif c == "`" or (c == "}" and back and back[-1] == braces):
            if c == "}":
                back.pop()
                braces -= 1
            i, code = template(i + 1)
            last = "value"
            if code:
                braces += 1
                back.append(braces)
                last = "sign"
        elif c == "/" and last != "value" and regex(i):
            i, last = regex(i), "value"
        else:
            if c == "{":
                braces += 1
            elif c == "}":
                braces = max(braces - 1, 0)
            last = "value" if c in ")]}" else "sign"
            i += 1
    flush()
    return out


@pytest.mark.parametrize("seed", range(60))
def test_names_of_code(seed):
    r = random.Random(seed)
    parts = ["a", "let ", "return ", "function ", " ", "\n", "{", "}", "(", ")", "[", "]", '"', "'", "`", "${", "/", "//", "/*", "*/", "=", "=>", ";", ",", "\\\\", "b1", "typeof "]
    js = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
    assert [x for k, x, _ in X.tokens(js) if k == "name"] == slow(js), js
