"""Exports with their checks, focus views, previews, working trees, recording."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.index import build_index, corpus_of
from graphloom.operators import telemetry as te
from graphloom.operators.ask import ask
from graphloom.operators.nodes import describe
from graphloom.operators.traverse import flow_rows, ranked, traverse
from graphloom.record import Recorder, record_answer
from graphloom.sources import corpus, export

FILES = {
    "a.go": 'package a\n\nfunc One() {\n\tTwo()\n\texec("SELECT x FROM users")\n}\n\nfunc Two() {\n\texec("UPDATE users SET x = 1")\n\tgone()\n}\n',
    "b.go": "package a\n\nfunc Three() {\n\tOne()\n}\n",
    "c.ts": "export function far() { return 1; }\n",
}


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(list(FILES.items()), "path string, text string"))


def test_public_index_is_checked(spark, index, tmp_path):
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # a second export takes the place of the first
        manifest = export.export_public(index, folder)
    assert export.check_public(spark, folder).count() == 0
    nodes, edges = corpus.public_index(spark, folder)
    assert manifest["counts"] == {"nodes": nodes.count(), "edges": edges.count()}
    users = export.locate(nodes, "db:table:users", "/repo").collect()
    assert [(r.path, r.line, r.editor) for r in users] == [("a.go", 5, "vscode://file/repo/a.go:5"), ("a.go", 9, "vscode://file/repo/a.go:9")]
    part = next(p for p in os.listdir(f"{tmp_path}/out/edges") if p.startswith("part-"))
    with open(f"{tmp_path}/out/edges/{part}", "a") as f:
        f.write('{"id":"x","type":"call","from":"nowhere","to":"symbol:go:a.go::One","confidence":"static","more":1}\nno json\n')
    os.remove(f"{tmp_path}/out/edges/.{part}.crc")
    found = {(r.part, r.problem) for r in export.check_public(spark, folder).collect()}
    assert found == {("edges", "no_json"), ("edges", "end_without_node"), ("edges", "count_differs")}
    with pytest.raises(ValueError):
        corpus.public_index(spark, folder)


def test_whole_export(spark, index, tmp_path):
    features = spark.createDataFrame([("f", "valid"), ("g", "stale")], "feature_id string, status string")
    said = export.export_index(index, f"file://{tmp_path}/all", features)
    assert said["counts"]["symbols"] == 4 and said["feature_status"] == {"valid": 1, "stale": 1} and set(said["parser_versions"]) == {"go-3", "script-2"}
    rows = [json.loads(x.value) for x in spark.read.text(f"file://{tmp_path}/all/files").collect()]
    assert [r["path"] for r in rows] == ["a.go", "b.go", "c.ts"] and "text" not in rows[0]


def test_focus_view(spark, index):
    nodes, edges = export.public_nodes(index), export.public_edges(index)
    near = [r.id for r in export.view_nodes(nodes, edges, 50, "symbol:go:b.go::Three", 1).collect()]
    assert near[0] == "symbol:go:b.go::Three" and set(near) == {"symbol:go:b.go::Three", "symbol:go:a.go::One"}
    wide = {r.id for r in export.view_nodes(nodes, edges, 50, "symbol:go:b.go::Three", 6).collect()}
    assert "db:table:users" in wide and "symbol:typescript:c.ts::far" not in wide
    page = export.graph_html(nodes, edges, 3)
    assert page.count("<text") == 3 and "script" not in page.replace("default-src", "")


def test_flow_rows_say_what_is_left_out(spark, index):
    c = corpus_of(index)
    starts = spark.createDataFrame([(s, s) for s in ("symbol:go:b.go::Three", "symbol:typescript:c.ts::far")], "flow_id string, node_id string")
    t = traverse(c.edges, starts, max_hops=5)
    got = {r.flow_id: r for r in flow_rows(t, index.edges, describe(t.visited, c)).collect()}
    three = got["symbol:go:b.go::Three"]
    assert three.status == "partial" and [n.node_id for n in three.nodes] == ["symbol:go:b.go::Three", "symbol:go:a.go::One", "symbol:go:a.go::Two", "db:table:users"]
    assert {x.target for x in three.unresolved_links} == {"ref:call:exec", "ref:call:gone"} and three.files == ["a.go", "b.go"]
    assert [s.evidence.resolution for s in three.steps][:2] == ["unique_symbol_name"] * 2 and three.stats.visited_nodes == 4
    assert got["symbol:typescript:c.ts::far"].status == "complete"


def test_ranks_by_ranges(spark):
    rows = [("a" if i % 3 else "b", f"n{i:04d}") for i in range(500)]
    got = {(r.kind, r.node_id): r.place for r in ranked(spark.createDataFrame(rows, "kind string, node_id string"), "kind", "node_id").collect()}
    for kind in "ab":
        mine = sorted(n for k, n in rows if k == kind)
        assert [got[kind, n] for n in mine] == list(range(len(mine)))


def test_previews_and_scores(spark):
    t = "x" * 900 + " needle here password=hunter2 " + "y" * 900 + " needle again"
    df = spark.createDataFrame([(t, "src/Needle_test.ts", True)], "text string, path string, changed boolean")
    shown = df.select(text.keyword_preview(F.col("text"), ["needle", "none"], 300, 100)).first()[0]
    assert "needle here" in shown and "hunter2" not in shown and len(shown) <= 300
    assert df.select(text.lexical_score(F.col("path"), F.col("text"), ["needle", "test", "zzz"], F.col("changed"))).first()[0] == 6 + 8 + 8 + 2 + 1 + 3
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.5,), (0.1,)], "p double").select(text.classify_score(F.col("p"), 0.8, 0.4)).collect()] == ["must_read", "maybe_read", "skip"]
    assert df.select(text.json_or(F.lit("no"), "array<int>", F.array(F.lit(1)))).first()[0] == [1]


def test_git_helpers(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    assert corpus.git_head(str(tmp_path)) is None
    (tmp_path / "a b.txt").write_text("1")
    (tmp_path / "c.txt").write_text("2 lines\nof it\n")
    run("add", ".")
    run("commit", "-qm", "x")
    assert corpus.changed_files(str(tmp_path)) == [] and len(corpus.git_head(str(tmp_path))) == 40 and corpus.git_root(str(tmp_path)) == os.path.realpath(tmp_path)
    (tmp_path / "a b.txt").write_text("3")
    (tmp_path / "new.txt").write_text("4")
    run("mv", "c.txt", "d.txt")
    assert corpus.changed_files(str(tmp_path)) == ["a b.txt", "d.txt", "new.txt"]
    assert corpus.allowed_path(f"{tmp_path}/d.txt", [str(tmp_path)]).endswith("d.txt")
    with pytest.raises(ValueError):
        corpus.allowed_path(f"{tmp_path}/../x", [str(tmp_path)])


def test_recorded_events_are_valid(spark, index, tmp_path):
    log = []
    repo = spark.range(1).select(te.repository_id(F.lit("/r"))).first()[0]
    rec = Recorder(log.append, repo)
    record_answer(rec, lambda: ask(corpus_of(index), "the users table api"))
    with pytest.raises(RuntimeError), rec.request("index"):
        raise RuntimeError("no")
    Recorder(lambda row: 1 / 0, repo).event("r", "t", "graph_expanded", added_files=1)  # a sink that fails loses the event, nothing else
    rows = spark.createDataFrame([tuple(r[k] for k in ("event_id", "request_id", "trace_id", "repository_id", "event_type", "ts", "payload")) for r in log], "event_id long, request_id string, trace_id string, repository_id string, event_type string, ts string, payload string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.reason for r in te.invalid(rows).collect() if r.reason] == []
    path = f"file://{tmp_path}/log"
    assert te.append_events(rows, path) == {"accepted": len(log)}
    late = rows.limit(1).withColumn("event_id", F.lit(99).cast("long"))
    bad = rows.limit(1).withColumn("event_type", F.lit("dance"))
    assert te.append_events(late.unionByName(bad), path) == {"after_end": 1, "unknown_event_type": 1}
    assert spark.read.parquet(path).count() == len(log)


def test_a_users_analyzer_and_bad_facts(spark):
    from graphloom.extract.registry import Analyzer, registry
    from graphloom.index import parse

    def words(path, text):
        if "boom" in text:
            return [{"fact": "symbol", "name": "x"}]  # no whole symbol
        return [{"fact": "symbol", "name": w, "ref": f"python:{path}::{w}", "line_start": 1, "line_end": 1} for w in text.split()]

    mine = {"python": Analyzer("words", "7", "heuristic", words)}
    files = spark.createDataFrame([("a.py", "python", "one two"), ("b.py", "python", "boom"), ("c.go", "go", "package c\n\nfunc F() {}\n"), ("d.txt", "text", "none")], "path string, language string, text string")
    got = parse(files, mine).collect()
    assert {(r.path, r.name) for r in got if r.fact == "symbol"} == {("a.py", "one"), ("a.py", "two"), ("c.go", "F")}
    assert [(r.path, r.name) for r in got if r.fact == "failed"] == [("b.py", "words-7")]
    assert {r.path for r in parse(files).collect()} == {"c.go"}
    for bad in (Analyzer("w", "1", "unsupported", words), Analyzer("", "1", "static", words), Analyzer("w", "1", "sure", words)):
        with pytest.raises(ValueError):
            registry({"python": bad})


def test_diagnostics_name_lost_modules(spark):
    many = "".join(f"import {{ x{i} }} from './none{i}';\n" for i in range(12))
    ix = build_index(spark.createDataFrame([("a.ts", many + "export async function f() { await import('./dyn'); }\n"), ("b.ts", "import z from 'lib';\n")], "path string, text string"))
    got = [(r.path, r.severity, r.message) for r in ix.diagnostics.collect()]
    assert len(got) == 8 and all(p == "a.ts" and s == "warning" for p, s, _ in got) and ("a.ts", "warning", "cannot find module: ./none0") in got
    assert corpus_of(ix).failed == 0


def test_a_provider_changes_the_order_or_nothing(spark):
    import time

    from graphloom.operators.semantic import refine

    ranked = spark.createDataFrame([(f"f{i:02d}", i + 1, 100.0 - i, ["r"]) for i in range(40)], "path string, rank int, final double, reasons array<string>")
    last_first = lambda task, sent: [{"path": x["path"], "score": i / len(sent)} for i, x in enumerate(sent)]
    out, said = refine(ranked, "t", last_first, weight=0.35)
    assert said == {"status": "applied", "candidates": 36}
    order = [r.path for r in out.orderBy("rank").collect()]
    assert sorted(order) == sorted(f"f{i:02d}" for i in range(40)) and order[36:] == [f"f{i}" for i in range(36, 40)]
    want = sorted(range(36), key=lambda i: (-(0.65 * (1 - i / 35) + 0.35 * i / 36), i))
    assert order[:36] == [f"f{i:02d}" for i in want]
    for bad, error in ((lambda t, s: s[:-1], "ValueError"), (lambda t, s: [{"path": x["path"], "score": 2} for x in s], "ValueError"), (lambda t, s: 1 / 0, "ZeroDivisionError"), (lambda t, s: time.sleep(1), "timeout")):
        same, said = refine(ranked, "t", bad, timeout_ms=200)
        assert said == {"status": "fallback", "error": error} and same is ranked


def test_scip_round_trip(spark, index, tmp_path):
    from graphloom.sources import scip

    n = scip.write_scip(index, f"{tmp_path}/index.scip")
    assert n == 3 and scip.inspect_scip(f"{tmp_path}/index.scip") == {"documents": 3, "occurrences": 4, "symbols": 4, "languages": {"Go": 2, "TypeScript": 1}}
    doc = next(bytes(r.message) for r in scip.documents(index).collect() if r.path == "a.go")
    first = next(v for f, v in scip.fields(doc) if f == 2)
    inner = dict(scip.fields(first))
    assert list(inner[1]) == [2, 5, 8] and inner[2] == b"scip-graphloom . . . `a.go`/One()." and inner[3] == 1
    assert scip.descriptor("x", "*Service", "Run") == "scip-graphloom . . . x/Service#Run()."


def test_service_reads_the_log(spark, tmp_path):
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from graphloom.serve import serve

    log = []
    rec = Recorder(log.append, "a" * 64)
    for _ in range(3):
        with rec.request("status"):
            pass
    rows = spark.createDataFrame([tuple(r[k] for k in ("event_id", "request_id", "trace_id", "repository_id", "event_type", "ts", "payload")) for r in log], "event_id long, request_id string, trace_id string, repository_id string, event_type string, ts string, payload string").withColumn("ts", F.to_timestamp("ts"))
    te.append_events(rows, f"file://{tmp_path}/log")
    server = serve(spark, f"file://{tmp_path}/log")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.loads(urlopen(f"http://127.0.0.1:{server.server_port}{path}").read())
    try:
        assert get("/status") == {"ok": True, "events": 6}
        page = get("/requests?size=2")
        assert len(page["requests"]) == 2 and page["next"]
        rest = get(f"/requests?size=2&cursor={page['next']}")
        assert len({r["request_id"] for r in page["requests"] + rest["requests"]}) == 3 and rest["next"] is None
        one = get(f"/requests/{log[0]['request_id']}")
        assert [x["event_type"] for x in one["events"]] == ["request_started", "request_completed"]
        assert get("/metrics")["success"] == 3 and get("/effects")["measured"] == 0
        for path, method, code in (("/none", "GET", 404), ("/status", "POST", 405), ("/requests?size=x", "GET", 400)):
            with pytest.raises(HTTPError) as e:
                urlopen(Request(f"http://127.0.0.1:{server.server_port}{path}", method=method))
            assert e.value.code == code
    finally:
        server.shutdown()
