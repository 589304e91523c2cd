"""The stored index: what a refresh analyzes, what it keeps, and what a status says."""

from graphloom import store
from graphloom.index import build_index


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def edges(ix):
    return {(e.type, e.from_node_id, e.to_node_id, e.confidence) for e in ix.edges.collect()}


def test_refresh_analyzes_what_changed(spark, tmp_path):
    where = f"file://{tmp_path}/ix"
    files = {
        "src/a.ts": "// adds\nexport function add(x: number, y: number) { return x + y; }\n",
        "src/b.ts": "import { add } from './a';\nexport function twice() { return add(1, 1); }\n",
        "src/c.ts": "export function alone() { return fetch('/api/c'); }\n",
        "svc/m.go": "package svc\n\nfunc Run() { step() }\n\nfunc step() {}\n",
        "db/q.sql": "SELECT id FROM users;\n",
    }
    assert not store.exists(spark, where) and store.status(spark, tree(spark, files), where) == {"indexed": False, "stale": True}
    first = store.refresh(spark, tree(spark, files), where, meta={"head": "one"})
    assert first == {"files": 5, "analyzed": 5, "failed": 0, "removed": 0, "unreadable": 0}
    assert edges(store.load(spark, where)) == edges(build_index(tree(spark, files)))
    assert store.refresh(spark, tree(spark, files), where)["analyzed"] == 0
    said = store.status(spark, tree(spark, files), where)
    assert not said["stale"] and said["tables"]["files"] == 5 and said["meta"]["head"] == "one"

    files["src/a.ts"] = files["src/a.ts"].replace("add(x", "plus(x")  # b depends on it
    files["db/q.sql"] = None  # can't be read any more: stays as it was
    del files["svc/m.go"]
    said = store.status(spark, tree(spark, files), where)
    assert said["stale"] and (said["changed"], said["removed"], said["added"], said["unreadable"]) == (1, 1, 0, 1)
    assert said["samples"] == {"changed": ["src/a.ts"], "removed": ["svc/m.go"]}
    again = store.refresh(spark, tree(spark, files), where)
    assert again == {"files": 4, "analyzed": 2, "failed": 0, "removed": 1, "unreadable": 1}
    ix = store.load(spark, where)
    got = edges(ix)
    assert ("call", "symbol:typescript:src/b.ts::twice", "ref:call:add", "unresolved") in got
    assert ("db_read", "file:db/q.sql", "db:table:users", "static") in got
    assert not any("svc/" in e[1] for e in got)
    events = {(e.kind, e.symbol_id or e.file_path) for e in store.read_table(spark, where, "change_events").collect()}
    assert {("symbol_removed", "typescript:src/a.ts::add"), ("symbol_added", "typescript:src/a.ts::plus"), ("symbol_removed", "go:svc/m.go::Run"), ("file_reindexed", "src/b.ts")} <= events
    assert {r.symbol_id: r.description for r in ix.symbols.collect()}["typescript:src/a.ts::plus"] == "adds"


def test_failed_analysis_keeps_former_facts(spark, tmp_path):
    where = f"file://{tmp_path}/ix"
    good = "<script>\nexport function one() {}\n</script>\n"
    store.refresh(spark, tree(spark, {"v.vue": good}), where)
    bad = "<script>\nexport function one() {}\n</script>\n<script setup>\nfunction one() {}\n</script>\n"
    done = store.refresh(spark, tree(spark, {"v.vue": bad}), where)
    assert done["failed"] == 1 and done["analyzed"] == 0
    ix = store.load(spark, where)
    assert [s.name for s in ix.symbols.collect()] == ["one"] and ix.diagnostics.count() == 1
    assert store.refresh(spark, tree(spark, {"v.vue": good}), where)["failed"] == 0
    assert store.load(spark, where).diagnostics.count() == 0


def test_features_are_held_against_their_symbols(spark, tmp_path):
    from graphloom.index import corpus_of
    from graphloom.operators.ask import ask
    from graphloom.sources import corpus

    where, folder = f"file://{tmp_path}/ix", tmp_path / "defs"
    assert corpus.feature_definitions(spark, str(folder)).count() == 0
    folder.mkdir()
    step = '{"action": "adds", "symbol_id": "typescript:src/a.ts::add"}'
    (folder / "sum.json").write_text('{"id": "sum", "name": "Sums", "description": "adds numbers", "steps": [%s, {"action": "docs", "file_path": "src/b.ts"}], "invariants": ["no rest"]}' % step)
    (folder / "lost.json").write_text('{"id": "lost", "name": "Lost", "description": "points nowhere", "steps": [{"action": "x", "symbol_id": "typescript:src/zzz.ts::no"}]}')
    (folder / "bad.json").write_text('{"id": "bad"}')
    files = {"src/a.ts": "export function add(x: number) { return x; }\n", "src/b.ts": "export function other() { return 1; }\n"}
    run = lambda: store.refresh(spark, tree(spark, files), where, features=corpus.feature_definitions(spark, f"file://{folder}"))
    state = lambda: {r.feature_id: (r.status, r.needs_review, r.stale_reason) for r in store.read_table(spark, where, "features").collect()}
    run()
    assert state() == {"sum": ("valid", False, None), "lost": ("stale", True, "unresolved_feature_symbol")}
    first = {r.feature_id: r.generated_hash for r in store.read_table(spark, where, "features").collect()}
    files["src/a.ts"] = "export function add(x: number) { return x + 1; }\n"
    run()
    assert state()["sum"] == ("needs_review", True, "referenced_symbol_changed")
    run()  # nothing changed since, but nobody has looked
    assert state()["sum"][:2] == ("needs_review", True) and {r.feature_id: r.generated_hash for r in store.read_table(spark, where, "features").collect()}["sum"] != first["sum"]
    assert store.review_feature(spark, where, "sum", "fine")["status"] == "valid" and state()["sum"] == ("valid", False, None)
    for bad in ("lost", "none"):
        try:
            store.review_feature(spark, where, bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert [(r.feature_id, r.note) for r in store.read_table(spark, where, "feature_reviews").collect()] == [("sum", "fine")]
    files["src/b.ts"] = "export function other() { return 2; }\n"
    run()
    assert state()["sum"] == ("needs_review", True, "referenced_file_changed") and store.status(spark, tree(spark, files), where)["features"] == {"needs_review": 1, "stale": 1}
    (folder / "lost.json").unlink()
    (folder / "sum.json").write_text('{"id": "sum", "name": "Sums", "description": "adds anew", "steps": [%s]}' % step)
    run()
    assert state() == {"sum": ("valid", False, None)}
    found = ask(corpus_of(store.load(spark, where), store.features_of(spark, where)), "sums of numbers")
    assert found.features[0]["feature_id"] == "sum" and "feature:sum" in found.selected[0]["reasons"]
