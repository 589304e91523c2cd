"""Working trees, exports, questions and streams."""

import subprocess

from graphloom import cli
from graphloom.functions.query import expand_query
from graphloom.index import build_index, corpus_of
from graphloom.operators.ask import ask
from graphloom.sources import corpus, export
from graphloom.streaming import telemetry_stream as st


def test_tree_to_export(spark, tmp_path):
    repo = tmp_path / "tree"
    (repo / "src/api").mkdir(parents=True)
    (repo / "src/api/user data.ts").write_text("export function loadUser() { return fetch('/api/users'); }\n")
    (repo / "src/main.ts").write_text("import { loadUser } from './api/user data';\nexport function main() { loadUser(); }\n")
    (repo / ".env").write_text("SECRET=1")
    (repo / "big.txt").write_bytes(b"a\0b")
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    tree = corpus.working_tree(spark, str(repo))
    got = {r.path: r.text for r in tree.collect()}
    assert set(got) == {"src/api/user data.ts", "src/main.ts", "big.txt"} and got["big.txt"] is None
    assert [r.path for r in corpus.unreadable(tree).collect()] == ["big.txt"]
    index = build_index(tree)
    assert ("call", "symbol:typescript:src/main.ts::main", "symbol:typescript:src/api/user data.ts::loadUser") in {(e.type, e.from_node_id, e.to_node_id) for e in index.edges.collect()}
    first = ask(corpus_of(index), "user loading in the api").selected[0]
    assert first["path"] == "src/api/user data.ts" and "symbol_match" in first["reasons"]
    manifest = export.export_public(index, f"file://{tmp_path}/out")
    nodes, edges = corpus.public_index(spark, f"file://{tmp_path}/out")
    assert manifest["counts"] == {"edges": index.edges.count(), "nodes": nodes.count()} and edges.count() == index.edges.count()
    assert "<svg" in export.graph_html(nodes, edges, 10)
    assert cli.flow(index, ["symbol:typescript:src/main.ts::main"]).steps.count() == 1
    assert export.locate(nodes, "symbol:typescript:src/main.ts::main").first().line == 2


def test_expansion():
    e = expand_query("更新人工任务 for the CLI")
    assert "manual_task" in e.terms and "manualtask" in e.terms and "command" in e.terms and "the" not in e.terms
    assert [a.key for a in e.applied] == ["人工任务", "cli", "更新"]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", "start", 1.0), (2, "2024-01-01 00:05:00", "a", "step", 3.0), (3, "2024-01-01 00:06:00", "a", "end", 2.0), (4, "2024-01-01 00:07:00", "a", "step", 2.0), (5, "2024-01-01 01:00:00", "b", "step", 9.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, request_id string, event_type string, value double").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    for name, out, mode in (("m", lambda s: st.windowed_metrics(s, "1 hour", "1 hour"), "complete"), ("j", lambda s: st.judged(s, "start", ("end",)), "append")):
        s = spark.readStream.schema(st.EVENT_SCHEMA).parquet(f"{tmp_path}/in")
        q = out(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.event_type, r.start.hour): r.n for r in spark.table("m").collect()} == {("start", 0): 1, ("step", 0): 2, ("end", 0): 1, ("step", 1): 1}
    assert {r.event_id: r.verdict for r in spark.table("j").collect()} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "after_end", 5: "before_start"}
