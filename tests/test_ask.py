"""The whole answer: graph expansion from seeds, places held for intents, tests, coverage, and its two forms."""

import json

from graphloom.functions.query import expand_query
from graphloom.index import FEATURES, build_index, corpus_of
from graphloom.operators import ask as asking
from graphloom.operators import retrieve as r
from graphloom.operators.nodes import describe

FILES = {
    "backend/orders.go": 'package backend\n\nimport "net/http"\n\ntype API struct{}\n\nfunc (a *API) Mount(r *Router) {\n\tr.Handle(http.MethodPost, "/api/orders/{id}/refund", http.HandlerFunc(a.Refund))\n}\n\n// Refund gives money back\nfunc (a *API) Refund(w http.ResponseWriter, req *http.Request) {\n\ta.store("x")\n}\n\nfunc (a *API) store(id string) {\n\texec("UPDATE payments SET state = 1")\n}\n',
    "backend/reports.go": 'package backend\n\nfunc Monthly() {\n\texec("SELECT total FROM payments")\n}\n',
    "web/src/api/orders.ts": "export function refundOrder(id: string) {\n  return fetch(`/api/orders/${id}/refund`, { method: 'POST' });\n}\n",
    "web/src/pages/Checkout.vue": '<script setup lang="ts">\nimport { refundOrder } from "@/api/orders";\n// starts\nfunction go() { refundOrder("1"); }\n</script>\n',
    "web/src/router.ts": "import Checkout from './pages/Checkout.vue';\n// all views\nexport function views() { return [Checkout]; }\n",
    "web/src/other.ts": "export function unrelated() { return 1; }\n",
    "web/src/config.ts": "export function settings() { return {}; }\n",
    "backend/orders_test.go": "package backend\n\nfunc TestRefund() { check() }\n",
    "tests/cli.test.ts": "// checks the cli command\nexport function runs() { return 2; }\n",
    "bin/cli.ts": "export function main() { return 3; }\n",
    "package.json": "{}\n",
    "db/migrations/1_refund.up.sql": "CREATE TABLE payments (id int);\n",
}


def corpus(spark, features=()):
    index = build_index(spark.createDataFrame(list(FILES.items()), "path string, text string"))
    return corpus_of(index, spark.createDataFrame(list(features), FEATURES))


def test_whole_answer(spark):
    step = {"action": "give back", "symbol_id": "go:backend/orders.go::*API.Refund", "file_path": None}
    c = corpus(spark, [("f1", "refund of orders", "money goes back", "valid", False, ["a refund is paid once"], [step, {"action": "show", "symbol_id": None, "file_path": "web/src/other.ts"}]), ("f2", "unlike", "nothing", "stale", True, [], [])])
    a = asking.ask(c, "refund order payments")
    files = {x["path"]: x.asDict() for x in a.files.collect()}
    # each channel by its own rule, summed
    go = files["backend/orders.go"]["channels"]
    want_feature = 12 * 1.5 + 5  # name begins with a term, an invariant holds one (order is in the name, too)
    score = next(f["score"] for f in a.features if f["feature_id"] == "f1")
    assert score == want_feature + 12 and go["feature"] == 24 + 0.15 * score and files["web/src/other.ts"]["channels"]["feature"] == 16
    assert {"symbol", "route", "path"} <= set(go)
    # the walk reaches the page by the request, the reader of the same table, and the importer of the page
    assert "graph_reverse:api_request" in files["web/src/api/orders.ts"]["reasons"]
    assert "typed_graph" in files["web/src/pages/Checkout.vue"]["channels"]
    assert "graph_reverse:db_read" in files["backend/reports.go"]["reasons"]
    assert "graph_reverse:import" in files["web/src/router.ts"]["reasons"]
    assert "test_for:backend/orders.go" in files["backend/orders_test.go"]["reasons"]
    assert a.seeds[0].startswith("symbol:") and len(a.seeds) <= 12 and a.graph["forward_steps"] > 0 and a.graph["import_reverse_steps"] >= 1
    assert any(x.startswith("caller_of:") or x.startswith("callee_of:") for f in files.values() for x in f["reasons"])
    assert files["db/migrations/1_refund.up.sql"]["final"] == 0.25 * files["db/migrations/1_refund.up.sql"]["score"]
    assert a.coverage["status"] == "sufficient" and a.coverage["candidate_files"] == len(files)
    assert a.paths("must_read")[0] == "backend/orders.go" and "backend/orders_test.go" in a.paths("tests")
    whole, short = json.loads(asking.to_json(a)), json.loads(asking.to_json(a, short=True))
    assert [f["path"] for f in whole["must_read"]] == [f["path"] for f in short["must_read"]] == a.paths("must_read")
    assert "Refund" in " ".join(short["must_read"][0]["symbols"]) and len(asking.to_json(a, short=True)) < len(asking.to_json(a)) / 2
    assert any(s["description"] == "Refund gives money back" for s in a.symbols)


def test_places_are_held_for_intents(spark):
    c = corpus(spark)
    a = asking.ask(c, "refund order: version in the cli config, and its test", limit=4)
    assert len(a.selected) == 4 and set(a.held()) <= {f["path"] for f in a.selected}
    assert a.held("developer") == [p for p in a.held("developer") if p in ("bin/cli.ts", "web/src/config.ts")] and len(a.held("developer")) == 2
    assert set(a.paths("must_read")[:2]) == set(a.held("developer"))
    wide = asking.ask(c, "refund order: version in the cli config, and its test", limit=12)
    assert wide.held("manifest") == ["package.json"] and set(wide.held("test")) == {"tests/cli.test.ts", "backend/orders_test.go"}
    assert asking.ask(c, "zzz qqq").coverage == {"candidate_files": 0, "selected_files": 0, "exact_feature_hits": 0, "strong_symbol_hits": 0, "status": "insufficient"}


def test_reserve_replaces_from_the_end():
    group = lambda kind, most, fixed: r.Group(kind, "", most, None, None, fixed)
    rows = [{"places": {-1: 0}}, {"places": {-1: 0, 1: 1}}, {"places": {-1: 0}}, {"places": {-1: 0}}, {"places": {0: 1}}, {"places": {1: 2}}, {"places": {2: 1}}]
    groups = [group("developer", 1, True), group("builtin", 2, True), group("test", 2, False)]
    chosen, held = r.reserve(rows, groups, 4)
    assert chosen == [0, 1, 2, 4] and held == {4: "developer", 1: "builtin"}  # two places: limit // 2
    chosen, held = r.reserve(rows, groups, 8)
    assert held == {4: "developer", 1: "builtin", 5: "builtin", 6: "test"}


def test_nodes_say_what_they_are(spark):
    c = corpus(spark)
    ids = ["symbol:go:backend/orders.go::*API.Refund", "file:web/src/other.ts", "route:server:POST:/api/orders/{id}/refund", "db:table:payments", "ref:call:exec", "symbol:none", "odd"]
    got = {x.node_id: x for x in describe(spark.createDataFrame([(i,) for i in ids], "node_id string"), c).collect()}
    assert set(got) == set(ids)
    assert (got[ids[0]].file_path, got[ids[0]].line) == ("backend/orders.go", 12) and got[ids[1]].file_path == "web/src/other.ts"
    assert got[ids[2]].file_path == "backend/orders.go" and got[ids[3]].name == "payments" and got[ids[3]].file_path is None
    assert got[ids[5]].symbol_id == "none" and got[ids[5]].file_path is None


def test_project_words_anchor(spark):
    e = expand_query("Rückerstattung", {"rückerstattung": ["refund"]})
    assert e.of("project") == ["refund"]
    a = asking.ask(corpus(spark), "Rückerstattung", {"rückerstattung": ["refund"]})
    assert asking.full(a)["query_expansion"]["retrieval_mode"] == "project_anchor" and a.paths("must_read")
