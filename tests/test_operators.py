"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from fusegrid.operators import evaluation as X
from fusegrid.operators import extraction as E
from fusegrid.operators import fulltext as T
from fusegrid.operators import generation as N
from fusegrid.operators import graph as G
from fusegrid.operators import health as C
from fusegrid.operators import reasoning as R
from fusegrid.operators import understanding as U
from fusegrid.operators import vector_search as K
from fusegrid.sources import io


def understood(spark, text):
    return U.process(spark.createDataFrame([(1, text)], "query_id int, text string")).first()


def test_understanding(spark):
    r = understood(spark, "create a responsive dark mode button")
    assert (r["intent"], r["components"], r["attributes"], r["context"]) == ("create", ["button"], ["responsive", "dark"], ["mode"])
    r = understood(spark, "")
    assert (r["intent"], r["terms"]) == ("find", [])
    assert understood(spark, "please fix my inputs")["intent"] == "modify"
    assert understood(spark, "blue blue ring")["context"] == ["blue", "blue", "ring"]


def test_statement_terms(spark):
    rows = spark.createDataFrame([(1, 0, "<button --> component>"), (1, 1, "<query --> [responsive]>")], "query_id int, ord int, statement string")
    assert U.terms_of_statements(rows).first()["terms"] == ["button", "responsive"]
    told = [r["statement"] for r in U.statements(spark.createDataFrame([(1, "a dark thing")], "query_id int, text string")).orderBy("ord").collect()]
    assert told == ["<query --> [find]>", "<component --> component>", "<query --> component>", "<query --> [dark]>", "<(component * dark) --> has_attribute>"]


def test_reasoning(spark):
    facts = spark.createDataFrame([("a", "-->", "b", 1.0, 0.9), ("b", "-->", "c", 1.0, 0.9), ("c", "-->", "a", 1.0, 0.9)], R.STATEMENT)
    found = {(r["subject"], r["predicate"]): (r["confidence"], r["depth"]) for r in R.close(facts).collect()}
    assert found["a", "c"] == (pytest.approx(0.81), 2) and ("a", "a") not in found
    two = spark.createDataFrame([("s", 1.0, 0.9), ("s", 0.0, 0.9)], "statement string, frequency double, confidence double")
    r = R.revise(two).first()
    assert r["frequency"] == pytest.approx(0.5) and r["confidence"] == pytest.approx(18 / 19)


def test_design_systems(spark):
    rows = [(1, "flex p-4 bg-blue-500 hover:bg-blue-600 rounded-lg", ""), (2, "btn btn-primary col-md-6 d-flex", ""), (3, "", "import Button from '@mui/material/Button'"), (4, "", "")]
    out = E.detect_system(spark.createDataFrame(rows, "i int, h string, j string"), "h", "j").orderBy("i").collect()
    assert [r["design_system"] for r in out] == ["tailwind", "bootstrap", "material-ui", "unknown"]
    assert out[2]["system_confidence"] == pytest.approx(0.21) and out[3]["system_confidence"] == 0


def test_html_nodes(spark):
    html = '<nav ID="n"><a class="x y" href=\'/\'>One</a><br><p>a<p>b</p></nav><script>var t="</p>";</script><li>1<li>2'
    rows = E.html_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [(r["tag"], r["parent_id"], r["depth"]) for r in rows] == [("nav", None, 0), ("a", 0, 1), ("br", 0, 1), ("p", 0, 1), ("p", 0, 1), ("script", None, 0), ("li", None, 0), ("li", None, 0)]
    assert rows[1]["classes"] == ["x", "y"] and rows[1]["text"] == "One" and rows[0]["id"] == "n"


def test_extract_maps_roots(spark):
    html = '<button class="btn btn-primary">Go</button><script>document.querySelector("a")</script>'
    rows = E.extract(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("node_id").collect()
    assert (rows[0]["category"], rows[0]["design_system"], rows[0]["element_type"], rows[0]["interactive"]) == ("button", "bootstrap", "bootstrap-button", True)
    said = {r["statement"] for r in E.statements(E.extract(spark.createDataFrame([(1, html)], "page_id int, html string"))).collect()}
    assert "{UIButton_btn} --> UIButton. %0.90;0.50%" in said and "UIButton --> UIControl. %1.00;0.90%" in said and "UIOverlay --> UIElement. %1.00;0.90%" in said


def test_generation(spark):
    text = "x\n```html\n<p>a</p>\n```\n```javascript\nlet b\n```"
    r = N.parse_reply(spark.createDataFrame([(text,), ("```html no end",)], "t string"), "t").collect()
    assert (r[0]["html"], r[0]["css"], r[0]["javascript"]) == ("<p>a</p>", None, "let b") and r[1]["html"] is None
    bad = spark.createDataFrame([("<html><div><p>x</p>",), ("<div></div>",)], "t string").select(N.unclosed_tags(F.col("t")).alias("u")).collect()
    assert bad[0]["u"] == ["div", "!doctype"] and bad[1]["u"] == []


def test_graph_changes(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, created_at int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "id int, name string, created_at int")
    assert sorted(map(tuple, G.upsert(old, new, "id", "created_at").collect())) == [(1, "a", 5), (2, "B", 6), (3, "c", 9)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    nodes, left = G.delete_nodes(new, edges, spark.createDataFrame([(3,)], "id int"), "id")
    assert [r["id"] for r in nodes.collect()] == [2] and [tuple(r) for r in left.collect()] == [(1, 2)]
    assert {(r["id"], r["degree"]) for r in G.degrees(edges).collect()} == {(1, 2), (2, 2), (3, 2)}
    stats = G.statistics(old.where("false"), edges).first()
    assert (stats["nodes"], stats["avg_degree"]) == (0, 0.0)
    member = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "snippet_id int, element_id int")
    assert [r[0] for r in G.orphans(member, "snippet_id", "element_id", spark.createDataFrame([(1,)], "snippet_id int")).collect()] == [10]


def test_vector_search(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "id long, vector array<double>, collection int")
    assert [r["id"] for r in K.top_k(points, [1.0, 0.0], 2).collect()] == [5, 4]
    assert [r["id"] for r in K.top_k(points, [3.0, 1.0], 2, "euclid").collect()] == [3, 2]
    assert [r["id"] for r in K.top_k_per_collection(points, [1.0, 0.0], 3).collect()] == [5, 4, 3]
    rows = K.knn_join(points, points, 2).where("query_id = 5").orderBy("rank").collect()
    assert [r["id"] for r in rows] == [4, 3]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        io.check_dimension(points, 3).collect()


def test_bm25_orders_by_rarity(spark):
    docs = spark.createDataFrame([(1, "red ring red"), (2, "red bolt"), (3, "blue ring, blue"), (4, "")], "id int, text string")
    asked = spark.createDataFrame([(1, "bolt"), (1, "red")], "query_id int, term string")
    rows = T.bm25(docs, "id", "text", asked).orderBy(F.desc("score")).collect()
    assert [r["id"] for r in rows] == [2, 1]


def outcomes(spark, oks, seconds=1):
    rows = [(i, 1, ok, float(i), f"2024-01-01 00:{(i * seconds) // 60:02d}:{(i * seconds) % 60:02d}") for i, ok in enumerate(oks)]
    return spark.createDataFrame(rows, "event_id long, service long, ok boolean, latency double, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))


def states(df):
    return [r["state"] for r in C.breaker_trace(df).orderBy("event_id").collect()]


def test_circuit_breaker(spark):
    assert states(outcomes(spark, [False] * 5 + [True])) == ["closed"] * 4 + ["open", "open"]
    assert states(outcomes(spark, [False] * 5 + [True], 40)) == ["closed"] * 4 + ["open", "closed"]
    assert states(outcomes(spark, [False] * 6, 40)) == ["closed"] * 4 + ["open", "open"]


def test_degradation(spark):
    bad = outcomes(spark, [True] + [False] * 5)
    assert [r["status"] for r in C.service_status(bad).orderBy("event_id").collect()] == ["healthy", "healthy", "healthy", "degraded", "degraded", "offline"]
    assert C.system_mode(C.latest_status(bad), [1]).first()["mode"] == "offline"
    assert C.system_mode(C.latest_status(bad), [2]).first()["mode"] == "partial"
    assert C.system_mode(C.latest_status(outcomes(spark, [True])), [1]).first()["mode"] == "full"
    none = C.retry_stats(spark.createDataFrame([], "ok boolean, retries long")).first()
    assert (none["success_rate"], none["average_retries"]) == (1.0, 0.0)


def test_sources(spark, tmp_path, data_dir):
    assert "part" in io.register(spark, data_dir, ["part", "region"])
    assert spark.sql("select count(*) from region").first()[0] == 5 and io.unregister(spark, ["part", "region"]) == 2
    points = spark.createDataFrame([("1", "tailwind", [1.0, 2.0])], "id string, collection string, vector array<float>")
    io.write_points(points, str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).where("collection = 'tailwind'").count() == 1
    lines = spark.createDataFrame([(1, "b"), (0, "a")], "ord int, value string")
    io.write_report(lines, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]


def test_knn_join_keeps_vectors_off_the_driver(spark, monkeypatch):
    import numpy as np

    rows = np.random.default_rng(4).normal(size=(40, 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vector array<double>")

    def refuse(*_):
        raise AssertionError("vectors came to the driver")

    monkeypatch.setattr(type(points), "toArrow", refuse)
    for size in (7, 4096):
        monkeypatch.setattr(K, "BLOCK_ROWS", size, raising=False)
        got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in K.knn_join(points, points.where("id % 2 = 0"), 3).collect())
        unit = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
        score = np.round(unit @ unit.T, 6)
        want = [(i, n, j, score[i, j]) for i in range(0, 40, 2) for n, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (-score[i, j], j))[:3], 1)]
        assert got == want
    assert K.knn_join(points.where("false"), points, 3).count() == 0 and K.knn_join(points, points.where("false"), 3).count() == 0


def test_script_without_strings_and_comments(spark):
    js = """import a from './m'; // import b from './n'
/* function gone() {} */ function kept() { return "function no() {} // not a comment"; }
const q = 'it\\'s const z = 1;', r = `import c from "d" ${x}`;
el.addEventListener('click', kept); log("addEventListener('load')")"""
    r = E.js_structure(spark.createDataFrame([(1, js), (2, None)], "i int, js string"), "i", "js").orderBy("i").collect()
    assert (r[0]["functions"], r[0]["variables"], r[0]["imports"], r[0]["listeners"]) == (["kept"], ["q"], ["./m"], ["click"])
    assert r[1]["functions"] is None


def test_extract_full(spark):
    html = '<style>:root{--color-primary:#fff}.a{margin:0}</style><button class="btn btn-primary">Go</button><script>document.querySelector("a")</script>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (3, "")], "page_id long, html string")
    r = {x["page_id"]: x for x in E.extract_full(pages, 16).collect()}
    assert sorted(r) == [1, 2, 3]
    assert (r[1]["design_system"], r[1]["interactive"], r[1]["elements"], r[1]["rules"], r[1]["tokens"]) == ("bootstrap", True, 3, 2, ["Color --color-primary #fff"])
    assert r[1]["statements"] == E.statements(E.extract(pages)).where("page_id = 1").count() + 1
    assert len(r[1]["embedding"]) == 16 and sum(x * x for x in r[1]["embedding"]) == pytest.approx(1.0) and "bootstrap-button" in r[1]["text"]
    assert (r[2]["elements"], r[2]["tokens"], r[2]["text"], r[2]["embedding"]) == (0, [], "", None)


def test_service_windows_over_hours(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i % 2, rng.random() < 0.3, float(rng.randrange(100)), f"2024-01-01 {rng.randrange(0, 24, 3):02d}:{rng.randrange(60):02d}:00") for i in range(300)]
    rows += [(1000 + i, 7, False, 1.0, f"2024-01-0{1 + i} 05:00:00") for i in range(4)]
    frame = spark.createDataFrame(rows, "event_id long, service long, ok boolean, latency double, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    runs = {r["event_id"]: r["failures"] for r in C.failure_runs(frame).collect()}
    moved = {r["event_id"]: (r["total"], r["moving"], r["seen"]) for r in C.moving_average(frame, 5).collect()}
    assert len(runs) == len(moved) == len(rows)
    for service in (0, 1, 7):
        n, latencies = 0, []
        for i, _, ok, latency, _ in sorted((r for r in rows if r[1] == service), key=lambda r: (r[4], r[0])):
            n = 0 if ok else n + 1
            latencies.append(latency)
            last = latencies[-5:]
            assert runs[i] == n and moved[i] == (sum(last), pytest.approx(sum(last) / len(last)), len(latencies))


def test_percentiles_and_reports(spark):
    import json
    import random

    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * rng.expovariate(0.01) for _ in range(500)] + [7.0] * 200 + [0.0, -0.0, 1e300]
    frame = spark.createDataFrame([(1, v) for v in values] + [(None, 3.0), (2, None)], "g int, v double")
    got = {r["g"]: r for r in X.nearest_rank_percentiles(frame, "v", ["g"]).collect()}
    ordered = sorted(values)
    assert set(got) == {1, None} and got[1]["n"] == len(values) and got[None]["p95"] == 3.0
    for share in (50, 95, 99):
        assert got[1][f"p{share}"] == ordered[int(share / 100 * (len(values) - 1) + 0.5)]
    metrics = spark.createDataFrame([(1, [1, 2], [2, 3], 4.0), (2, [1], [1], 6.0)], "query_id int, expected array<int>, returned array<int>, latency double")
    summary = X.aggregate(X.query_metrics(metrics))
    told = json.loads(X.report_json(summary, "T").first()["value"])
    assert told["title"] == "T" and told["metrics"]["queries"] == 2 and told["metrics"]["mean_precision"] == 0.75 and told["metrics"]["p50"] == 6.0
    assert "<tr><td>mean_latency</td><td>5.0000</td></tr>" in X.report_html(summary, "a<b").first()["value"]
    none = X.aggregate(X.query_metrics(metrics.where("false"))).first()
    assert (none["queries"], none["mean_f1"], none["p99"]) == (0, 0.0, 0.0)
