"""Inference to its end, replies of models, statements of pages, the standard requests."""

import random

import pytest

from fusegrid.functions import lexicon as L
from fusegrid.operators import extraction as E
from fusegrid.operators import reasoning as R
from fusegrid.plans.retrieval_queries import benchmark_rows


@pytest.mark.parametrize("seed", range(3))
def test_closure_with_cycles_equals_all_proofs(spark, seed):
    r = random.Random(seed)
    facts = {}
    for _ in range(22):
        a, b = r.sample("abcdefghij", 2)
        facts[(a, b)] = (r.choice([1.0, 0.9]), r.choice([0.5, 0.8, 0.9, 0.95]))
    best = {}
    stack = [(a, b, f, c, 1, frozenset([(a, b)])) for (a, b), (f, c) in facts.items()]
    while stack:
        a, b, f, c, depth, used = stack.pop()
        known = best.get((a, b))
        if known is None or (round(c, 12), -depth) > (round(known[1], 12), -known[2]):
            best[(a, b)] = (f, c, depth)
        for (x, y), (f2, c2) in facts.items():
            if x == b and y != a and (x, y) not in used:
                stack.append((a, y, f * f2, f * f2 * c * c2, depth + 1, used | {(x, y)}))
    rows = R.close(spark.createDataFrame([(a, "-->", b, f, c) for (a, b), (f, c) in facts.items()], R.STATEMENT)).collect()
    assert {(x["subject"], x["predicate"]): round(x["confidence"], 9) for x in rows} == {k: round(v[1], 9) for k, v in best.items()}
    assert max(x["depth"] for x in rows) > 2


def test_a_chain_longer_than_any_bound_and_repeated_statements(spark):
    chain = [(f"n{i}", "-->", f"n{i + 1}", 1.0, 0.9) for i in range(7)] * 2 + [("n0", "==>", "x", 1.0, 0.9)]
    rows = {(r["subject"], r["predicate"]): r["confidence"] for r in R.close(spark.createDataFrame(chain, R.STATEMENT)).collect()}
    assert len(rows) == 28 and rows["n0", "n7"] == pytest.approx(0.9**7)
    assert R.close(spark.createDataFrame([], R.STATEMENT)).count() == 0
    assert R.close(spark.createDataFrame(chain, R.STATEMENT), 2).count() == 13


def test_replies(spark):
    text = "// <a --> b>.\n#x <a --> b>\n<button --> component>. {1.0|0.9}\r\nThe answer: <query --> [dark]>.\nbad < here\n<<a --> b> ==> <c <-> <d <=> e>>> {.5 | 0.25}\n(<(card * [big]) --> pair>){0.1|0.2}\n<a --> b> . {x|0.3}\n\n<open --> <a --> b>"
    rows = R.parse_translation(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").orderBy("ord").collect()
    assert [(r["ord"], r["statement"], r["frequency"], r["confidence"]) for r in rows] == [
        (2, "<button --> component>", 1.0, 0.9),
        (3, "<query --> [dark]>", 1.0, 0.9),
        (5, "<<a --> b> ==> <c <-> <d <=> e>>>", 0.5, 0.25),
        (6, "<(card * [big]) --> pair>", 1.0, 0.9),
        (7, "<a --> b>", 1.0, 0.9),
        (9, "<a --> b>", 1.0, 0.9),
    ]


def test_statements_of_elements(spark):
    rows = [(1, 0, "button", ["a-b", "a-b"], [], [], 0), (1, 1, "div", [], [], [], 0), (1, 2, "div", [], [], [], 0), (2, 0, "p", ["card"], [], [], 0)]
    nodes = spark.createDataFrame(rows, "page_id int, node_id int, tag string, classes array<string>, names array<string>, vals array<string>, depth int")
    systems = spark.createDataFrame([(1, "tailwind", True), (2, "custom", False)], "page_id int, design_system string, interactive boolean")
    told = sorted((r["page_id"], r["kind"], r["statement"].split(". %")[0]) for r in E.statements(E.map_elements(nodes, systems)).collect())
    tops = sorted(f"{p} --> UIElement" for p in L.CATEGORY_PARENTS)
    want = [(1, "instance", "{UIButton_a_b} --> DS_tailwind"), (1, "instance", "{UIButton_a_b} --> UIButton")] + [(1, "property", "UIButton_a_b --> [a_b]")] * 2 + [(1, "property", "UIButton_a_b --> [interactive]")]
    want += [(1, "instance", "{UIUnknown_default} --> DS_tailwind"), (1, "instance", "{UIUnknown_default} --> UIUnknown"), (1, "property", "UIUnknown_default --> [interactive]")] * 2
    want += [(2, "instance", "{UICard_card} --> DS_custom"), (2, "instance", "{UICard_card} --> UICard"), (2, "property", "UICard_card --> [card]")]
    parents = {c: p for p, cs in L.CATEGORY_PARENTS.items() for c in cs}
    want += [(n, "inheritance", t) for n in (1, 2) for t in tops] + [(1, "inheritance", f"UIButton --> {parents['button']}")] + [(2, "inheritance", f"UICard --> {parents['card']}")] * ("card" in parents)
    assert told == sorted(want)
    plan = E.statements(E.map_elements(nodes, systems))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 3


def test_standard_requests():
    rows = benchmark_rows()
    assert len(rows) == 100 and len({r[0] for r in rows}) == 100 and len({r[1] for r in rows}) == 8 and all(len(set(r[3])) == 3 for r in rows)
