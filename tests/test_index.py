"""The index over small trees: one chain from a page to a table, and what must stay unresolved."""

from graphloom.index import build_index

FILES = {
    "backend/items.go": """package backend

import "net/http"

type Repo interface {
	Load(id string) (Item, error)
}

type SQLRepo struct{ db *DB }

func (r *SQLRepo) Load(id string) (Item, error) {
	return r.query("SELECT name FROM items WHERE id = $1")
}

func (r *SQLRepo) query(q string) (Item, error) { return Item{}, nil }

type API struct {
	repo Repo
}

func (a *API) Routes(r *Router) {
	r.Handle(http.MethodGet, "/api/items/{id}", http.HandlerFunc(a.Show))
}

func (a *API) Show(w http.ResponseWriter, req *http.Request) {
	a.repo.Load("1")
}
""",
    "src/api/items.ts": """import { base } from "./base";
// export function ghost() {}
export const showItem = (itemId: string) => {
  return fetch(`/api/items/${itemId}`);
};
export function other() { return base(); }
""",
    "src/api/base.ts": "export function base() { return 1; }\n",
    "src/api/index.ts": "export { showItem as show } from './items';\nexport * from './base';\n",
    "src/pages/Items.vue": """<template><div/></template>
<script setup lang="ts">
import { show } from "@/api";
defineProps<{ id: string }>();
function load() { show("1"); missing(); }
</script>
""",
    "src/worker.ts": """export function nightly() {}
// cron.schedule("@never", nightly)
cron.schedule("@daily", nightly);
queue.subscribe("jobs", lost);
""",
    "src/lazy.ts": "export async function lazy() { const m = await import('./api/base'); return m; }\n",
    "src/api/base.test.ts": "import { base } from './base';\nexport function check() { return base(); }\n",
    "node_modules/x/index.js": "export function never() {}\n",
}


def edges_of(spark, files):
    ix = build_index(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert ix.diagnostics.filter("severity = 'error'").count() == 0
    return {(r.type, r.from_node_id, r.to_node_id, r.confidence) for r in ix.edges.collect()}, ix


def test_chain(spark):
    got, ix = edges_of(spark, FILES)
    show, load, api = "symbol:go:backend/items.go::*API.Show", "symbol:go:backend/items.go::*SQLRepo.Load", "symbol:typescript:src/api/items.ts::showItem"
    for edge in (
        ("page_api", "file:src/pages/Items.vue", api, "static"),
        ("api_request", api, "ref:api_request:GET /api/items/{param}", "unresolved"),
        ("route_handler", "route:server:GET:/api/items/{id}", show, "static"),
        ("call", show, load, "static"),
        ("call", load, "symbol:go:backend/items.go::*SQLRepo.query", "static"),
        ("db_read", load, "db:table:items", "static"),
        ("call", "symbol:vue:src/pages/Items.vue::load", "ref:call:missing", "unresolved"),
        ("import", "file:src/pages/Items.vue", "file:src/api/index.ts", "static"),
        ("import", "file:src/lazy.ts", "ref:import:./api/base", "unresolved"),
        ("test_of", "file:src/api/base.test.ts", "file:src/api/base.ts", "inferred"),
        ("test_of", "file:src/api/base.test.ts", "symbol:typescript:src/api/base.ts::base", "static"),
    ):
        if edge[0] == "api_request":
            assert any(e[0] == "api_request" and e[1] == api and e[2] == "route:server:GET:/api/items/{id}" for e in got), edge
        else:
            assert edge in got, (edge, sorted(e for e in got if e[0] == edge[0]))
    entries = {(r.entry_kind, r.entry_name) for r in ix.entries.collect()}
    assert entries == {("job", "@daily"), ("consumer", "jobs")}
    assert ("entry_handler", "entry:job:src/worker.ts:%40daily:3", "symbol:typescript:src/worker.ts::nightly", "static") in got
    assert not any("never" in e[1] + e[2] for e in got if e[0] == "call")


def test_ambiguity_stays_open(spark):
    files = {
        "a/x.go": "package a\n\ntype S interface {\n\tRun()\n}\ntype P struct{}\n\nfunc (p *P) Run() {}\n\ntype Q struct{}\n\nfunc (q *Q) Run() {}\n\ntype T struct {\n\ts S\n}\n\nfunc (t *T) Go() { t.s.Run() }\n",
        "a/r.go": 'package a\n\nfunc Mount(r *R) {\n\tr.GET("/x", Get)\n\tr.POST("/x", Put)\n}\nfunc Get() {}\nfunc Put() {}\n',
        "src/c.ts": "export function f() { return doRequest('/x'); }\n",
        "src/one.ts": "export function dup() {}\n",
        "src/two.ts": "export function dup() {}\n",
        "src/api/all.ts": "export * from '../one';\nexport * from '../two';\n",
        "src/views/V.vue": "<script>\nimport { dup } from '../api/all';\ndup();\n</script>\n",
    }
    got, _ = edges_of(spark, files)
    assert ("call", "symbol:go:a/x.go::*T.Go", "ref:call:t.s.Run", "unresolved") in got
    assert ("api_request", "symbol:typescript:src/c.ts::f", "ref:api_request:ANY /x", "unresolved") in got
    assert ("page_api", "file:src/views/V.vue", "ref:page_api:dup", "unresolved") in got


def test_path_aliases_of_the_nearest_settings(spark):
    files = {
        "web/tsconfig.base.json": '{\n  // shared\n  "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["missing/*", "lib/*"], "@lib/exact": ["lib/other.ts"], },\n  }, }\n',
        "web/tsconfig.json": '{ "extends": "./tsconfig.base" }\n',
        "web/lib/tools.ts": "export function tool() { return 1; }\n",
        "web/lib/other.ts": "export function odd() { return 2; }\n",
        "web/app/use.ts": "import { tool } from '@lib/tools';\nimport { odd } from '@lib/exact';\nimport { deep } from 'shared/deep';\nexport function run() { tool(); odd(); deep(); }\n",
        "web/shared/deep.ts": "export function deep() { return 3; }\n",
        "web/inner/tsconfig.json": '{ "compilerOptions": {} }\n',
        "web/inner/lost.ts": "import { tool } from '@lib/tools';\nexport function lost() { tool(); }\n",
        "svc/go.mod": "module example.com/svc\n\ngo 1.22\n",
        "svc/store/store.go": "package store\n\nfunc Fetch() {}\n\nfunc hidden() {}\n",
        "svc/store/store_test.go": "package store\n\nfunc Fetch2() {}\n",
        "svc/api/api.go": 'package api\n\nimport (\n\t"fmt"\n\tst "example.com/svc/store"\n)\n\nfunc Serve() {\n\tst.Fetch()\n\tst.Gone()\n\tfmt.Println()\n}\n',
    }
    got, ix = edges_of(spark, files)
    run, serve = "symbol:typescript:web/app/use.ts::run", "symbol:go:svc/api/api.go::Serve"
    for edge in (
        ("import", "file:web/app/use.ts", "file:web/lib/tools.ts", "static"),
        ("import", "file:web/app/use.ts", "file:web/lib/other.ts", "static"),
        ("import", "file:web/app/use.ts", "file:web/shared/deep.ts", "static"),
        ("call", run, "symbol:typescript:web/lib/tools.ts::tool", "static"),
        ("call", run, "symbol:typescript:web/lib/other.ts::odd", "static"),
        ("call", run, "symbol:typescript:web/shared/deep.ts::deep", "static"),
        ("import", "file:web/inner/lost.ts", "ref:import:@lib/tools", "unresolved"),
        ("call", serve, "symbol:go:svc/store/store.go::Fetch", "static"),
        ("call", serve, "ref:call:st.Gone", "unresolved"),
        ("call", serve, "ref:call:fmt.Println", "unresolved"),
    ):
        assert edge in got, (edge, sorted(e for e in got if e[0] == edge[0]))
    said = {(r.from_file, r.to_ref): r.resolution for r in ix.dependencies.collect()}
    assert said["web/app/use.ts", "@lib/tools"] == "ts_module_resolution" and said["svc/api/api.go", "st.Fetch"] == "go_types_object"
    assert said["svc/api/api.go", "st.Gone"] == "go_types_target_unindexed" and said["web/inner/lost.ts", "@lib/tools"] == "external_or_untracked_module"
    proof = {(r.type, r.to_node_id): r.evidence for r in ix.edges.collect()}
    assert proof["call", "symbol:go:svc/store/store.go::Fetch"].resolution == "go_types_object"


def test_handlers_by_what_holds_them(spark):
    files = {
        "web/api.go": 'package web\n\ntype A struct{}\n\ntype B struct{}\n\nfunc (a *A) Show() {}\n\nfunc (b *B) Show() {}\n\nfunc (a *A) Mount(r *Router) {\n\tr.GET("/a", a.Show)\n}\n\nfunc Wire(r *Router, x, b *B) {\n\tr.GET("/b", b.Show)\n\tr.GET("/n", none.Show)\n}\n',
    }
    got, ix = edges_of(spark, files)
    proof = {(e.from_node_id, e.to_node_id): e.evidence.resolution for e in ix.edges.filter("type = 'route_handler'").collect()}
    assert proof == {
        ("route:server:GET:/a", "symbol:go:web/api.go::*A.Show"): "method_receiver_type",
        ("route:server:GET:/b", "symbol:go:web/api.go::*B.Show"): "receiver_parameter_type",
        ("route:server:GET:/n", "ref:route_handler:none.Show"): "handler_not_unique",
    }
