"""Scans, filters, scalar functions and fact extraction over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import facts
from ..functions import paths, text
from ..operators.spread import KEYS, spread
from .adapter import FILES_SQL, files, table
from .registry import query

_BASE = "regexp_extract(path, '[^/]*$')"
_BLOCKED = f"(list_contains(['.env','.env.local','.env.production','.env.development','.npmrc','.pypirc','id_rsa','id_ed25519','credentials','credentials.json','secrets.json','.context-query-aliases.json'], lower({_BASE})) or regexp_matches(path, '(^|/)(\\.git|node_modules|vendor)(/|$)') or regexp_matches(lower({_BASE}), '(\\.pem|\\.key|\\.p12|\\.pfx|\\.crt|\\.cer|\\.jks|\\.keystore|\\.lock|package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock|uv\\.lock)$'))"
_EXT = f"lower(regexp_extract({_BASE}, '[^.](\\.[^.]*)$', 1))"


@query(f"with {FILES_SQL} select doc_id, path from files where not {_BLOCKED} and not regexp_matches(path, '^(dist|build|coverage|target)/') and not regexp_matches(lower(path), '(\\.min\\.js|\\.map)$') and {_EXT} in ('.go','.ts','.js','.json','.sql')")
def scan_filter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(paths.is_likely_source(F.col("path"))).select("doc_id", "path")


@query(f"with {FILES_SQL} select doc_id, path from files where {_BLOCKED}")
def blocked_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(paths.is_blocked(F.col("path"))).select("doc_id", "path")


@query(f"with {FILES_SQL} select doc_id, sha256(text) as content_hash from files")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"with {FILES_SQL} select case {_EXT} when '.go' then 'go' when '.ts' then 'typescript' when '.js' then 'javascript' when '.sql' then 'sql' else 'text' end as language, count(*) as n from files group by 1")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(paths.detect_language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query(f"with {FILES_SQL} select doc_id, regexp_matches(path, '(^|/)(test|tests|__tests__|acceptance)(/|$)') or regexp_matches(path, '(^|[._-])(test|spec)([._-]|$)') or regexp_matches(path, '_test\\.go$') as is_test from files")
def is_test_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", paths.is_test_path(F.col("path")).alias("is_test"))


@query(f"with {FILES_SQL} select doc_id, case when text = '' then 0 else 1 + length(text) - length(replace(text, chr(10), '')) end::int as line_count from files")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.line_count(F.col("text")).alias("line_count"))


@query(
    "with d as (select doc_id, coalesce(text, '') as t from documents) select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(authorization\\s*:\\s*bearer\\s+)[^\\s\"'']+', '\\1[redacted]', 'g'), '\\bsk-[A-Za-z0-9_-]{16,}\\b', '[redacted]', 'g'), '\\bts_[A-Za-z0-9_-]{12,}\\b', '[redacted]', 'g'), '\\bgh[pousr]_[A-Za-z0-9_]{20,}\\b', '[redacted]', 'g'), '(?i)((?:api[_-]?key|token|secret|password|passwd|pwd)\\s*[:=]\\s*[\"'']?)[^\\s\"'',;]+', '\\1[redacted]', 'g')) as redacted_md5 from d"
)
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.md5(F.encode(text.redact_secrets(F.col("text")), "UTF-8")).alias("redacted_md5"))


@query("with d as (select doc_id, regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_.:/\\\\-]+', ' ', 'g'), '[\\p{L}\\p{N}]{2,}') as terms from documents) select doc_id, len(terms)::int as n_terms, md5(array_to_string(terms, ' ')) as terms_md5 from d")
def raw_terms_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.raw_terms(F.col("text")).alias("terms"))
    return t.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.encode(F.array_join("terms", " "), "UTF-8")).alias("terms_md5"))


@query("select role, count(*) as n, sum(ceil(octet_length(encode(coalesce(text, ''))) / 4.0))::bigint as tokens from conversations group by role")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("role").agg(F.count("*").alias("n"), F.sum(text.token_estimate(F.octet_length(F.coalesce("text", F.lit(""))))).alias("tokens"))


_SQL_TEXT = "concat('SELECT * FROM ', lower(c_mktsegment), chr(10), 'INSERT INTO log_', cast(c_nationkey as string), ' values (1)', chr(10), 'update ', lower(c_mktsegment), ' set x = 1;')"


@query("select c_custkey, 'select' as operation, lower(c_mktsegment) as object_name, 1 as line from customer union all select c_custkey, 'insert', concat('log_', cast(c_nationkey as string)), 2 from customer union all select c_custkey, 'update', lower(c_mktsegment), 3 from customer")
def extract_sql_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), KEYS).select("c_custkey", F.expr(_SQL_TEXT.replace("chr(10)", "char(10)")).alias("text"))
    return facts.db_objects(t, ["c_custkey"]).select("c_custkey", "operation", "object_name", "line")


_ROUTE_TEXT = (
    "concat('r.Handle(http.MethodPost, \"/pay/', c_custkey, '\", wrap(http.HandlerFunc(api.Pay', c_nationkey, ')));', {nl}, 'r.get(\"/show/', c_nationkey, '\", api.Show)', {nl}, 'DELETE(\"/x/', c_custkey, '\")', {nl}, 'r.PUT(\"no\", f)')"
)


@query("select c_custkey, 'POST' as method, concat('/pay/', c_custkey) as route_path, 1 as line, concat('api.Pay', c_nationkey) as handler_ref from customer union all select c_custkey, 'GET', concat('/show/', c_nationkey), 2, 'api.Show' from customer union all select c_custkey, 'DELETE', concat('/x/', c_custkey), 3, null from customer")
def extract_links_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), KEYS).select("c_custkey", F.expr(_ROUTE_TEXT.format(nl="char(10)")).alias("text"))
    return facts.server_routes(t, ["c_custkey"])


_CLIENT_TEXT = "concat('fetch(\"/a/', c_custkey, '?q=1\")', {nl}, 'axios.post(`/b/$', '{{id}}/', c_nationkey, '`)', {nl}, 'await sendRequest(\"https://h.io//c//d\", {{ method: \"put\" }})', {nl}, 'other(\"/e\")', {nl}, 'const BASE = \"/k', c_nationkey, '\"; fetch(BASE)', {nl}, 'fetch(`$', '{{BASE}}/x/$', '{{ id }}`)', {nl}, 'call({{ method: \"delete\", url: \"/o/', c_custkey, '\" }}); call({{ url: BASE }})')"


@query(
    "select c_custkey, 'GET' as method, concat('/a/', c_custkey) as route_path, 1 as line from customer union all select c_custkey, 'POST', concat('/b/{param}/', c_nationkey), 2 from customer union all select c_custkey, 'PUT', '/c/d', 3 from customer union all select c_custkey, 'GET', concat('/k', c_nationkey), 5 from customer union all select c_custkey, 'GET', concat('/k', c_nationkey, '/x/{param}'), 6 from customer union all select c_custkey, 'DELETE', concat('/o/', c_custkey), 7 from customer union all select c_custkey, 'ANY', concat('/k', c_nationkey), 7 from customer"
)
def client_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), KEYS).select("c_custkey", F.expr(_CLIENT_TEXT.format(nl="char(10)")).alias("text"))
    return facts.client_requests(t, ["c_custkey"])


_ENTRY_TEXT = "concat('// cron.schedule(\"@never\", a)', {nl}, 'cron.schedule(\"0 ', c_nationkey, ' * *\", run.Night)', {nl}, 'queue.Subscribe(\"t', c_custkey, '\", on)')"


@query("select c_custkey, 'job' as entry_kind, concat('0 ', c_nationkey, ' * *') as entry_name, 'run.Night' as handler_ref, 2 as line from customer union all select c_custkey, 'consumer', concat('t', c_custkey), 'on', 3 from customer")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), KEYS).select("c_custkey", F.col("c_name").alias("path"), F.expr(_ENTRY_TEXT.format(nl="char(10)")).alias("text"))
    return facts.entries(t, ["c_custkey"], "path").select("c_custkey", "entry_kind", "entry_name", "handler_ref", "line")


#: Sources of one service each, by the supplier's key {k} and nation {n}.
_SOURCES = {
    "svc/s{k}.go": 'package s{k}\n\nimport "net/http"\n\nfunc Mount(r *Router) {\n\tr.Handle(http.MethodGet, "/api/s{k}/{id}", http.HandlerFunc(Show{k}))\n}\n\nfunc Show{k}() {\n\tload{k}()\n}\n\nfunc load{k}() {\n\texec("SELECT a FROM t{n}")\n}\n',
    "web/api/c{k}.ts": 'export function get{k}(id: string) {\n  return fetch("/api/s{k}/{id}");\n}\n',
    "web/pages/P{k}.vue": '<script setup lang="ts">\nimport { get{k} } from "../api/c{k}";\nfunction go() { get{k}("1"); }\n</script>\n',
    "web/api/c{k}.test.ts": "import { get{k} } from './c{k}';\nexport function check() { return get{k}('1'); }\n",
    "jobs/j{k}.ts": 'export function nightly{k}() {}\ncron.schedule("@daily", nightly{k});\n',
}
_EXPECTED = (
    ("call", "symbol:go:svc/s{k}.go::Show{k}", "symbol:go:svc/s{k}.go::load{k}", "static"),
    ("call", "symbol:go:svc/s{k}.go::load{k}", "ref:call:exec", "unresolved"),
    ("call", "symbol:go:svc/s{k}.go::Mount", "ref:call:http.HandlerFunc", "unresolved"),
    ("call", "symbol:go:svc/s{k}.go::Mount", "ref:call:r.Handle", "unresolved"),
    ("call", "symbol:typescript:web/api/c{k}.ts::get{k}", "ref:call:fetch", "unresolved"),
    ("call", "symbol:vue:web/pages/P{k}.vue::go", "symbol:typescript:web/api/c{k}.ts::get{k}", "static"),
    ("call", "symbol:typescript:web/api/c{k}.test.ts::check", "symbol:typescript:web/api/c{k}.ts::get{k}", "static"),
    ("import", "file:svc/s{k}.go", "ref:import:net/http", "unresolved"),
    ("import", "file:web/pages/P{k}.vue", "file:web/api/c{k}.ts", "static"),
    ("import", "file:web/api/c{k}.test.ts", "file:web/api/c{k}.ts", "static"),
    ("db_read", "symbol:go:svc/s{k}.go::load{k}", "db:table:t{n}", "static"),
    ("route_handler", "route:server:GET:/api/s{k}/{id}", "symbol:go:svc/s{k}.go::Show{k}", "static"),
    ("api_request", "symbol:typescript:web/api/c{k}.ts::get{k}", "route:server:GET:/api/s{k}/{id}", "static"),
    ("page_api", "file:web/pages/P{k}.vue", "symbol:typescript:web/api/c{k}.ts::get{k}", "static"),
    ("test_of", "file:web/api/c{k}.test.ts", "file:web/api/c{k}.ts", "inferred"),
    ("test_of", "file:web/api/c{k}.test.ts", "symbol:typescript:web/api/c{k}.ts::get{k}", "static"),
    ("entry_handler", "entry:job:jobs/j{k}.ts:%40daily:2", "symbol:typescript:jobs/j{k}.ts::nightly{k}", "static"),
)
_fill = lambda x: f"replace(replace('{x}', '{{k}}', s_suppkey::varchar), '{{n}}', s_nationkey::varchar)"


@query(" union all ".join(f"select '{t}' as type, {_fill(a)} as from_node_id, {_fill(b)} as to_node_id, '{c}' as confidence from supplier" for t, a, b, c in _EXPECTED))
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from sources to edges: parsers, scopes, bindings, routes, requests, entries, tests."""
    from ..index import build_index

    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("{k}"), k), F.lit("{n}"), n)
    rows = F.array(*[F.struct(fill(p).alias("path"), fill(t).alias("text")) for p, t in _SOURCES.items()])
    tree = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), KEYS).select(F.inline(rows))
    return build_index(tree).edges.select("type", "from_node_id", "to_node_id", "confidence")


@query("select p_partkey, ['a', 'b']::varchar as names, concat('map<', p_size, ', list>') as kind_b from part")
def parse_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), KEYS)
    t = rows.select("p_partkey", text.parse_params(F.concat(F.lit("a: number = f(1, 2), ...b?: map<"), F.col("p_size").cast("string"), F.lit(", list> "))).alias("p"))
    return t.select("p_partkey", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["name"]), ", "), F.lit("]")).alias("names"), F.get("p", F.lit(1))["type"].alias("kind_b"))


@query("with t as (select p_partkey, concat('é x ', p_name, '; call(', p_brand, ')') as v, split_part(p_name, ' ', 1) as w from part), n as (select *, len(regexp_extract_all(v, concat('\\b', w, '\\b'))) as k from t) select p_partkey, case when k = 1 then strlen(v[:instr(v, w) - 1]) end::int as first_byte, case when k = 1 then strlen(v[:instr(v, w) - 1]) + strlen(w) end::int as last_byte from n")
def identifier_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), KEYS).select("p_partkey", F.concat(F.lit("é x "), "p_name", F.lit("; call("), "p_brand", F.lit(")")).alias("v"), F.substring_index("p_name", " ", 1).alias("w"))
    return t.select("p_partkey", text.unique_span(F.col("v"), F.col("w")).alias("s")).select("p_partkey", F.col("s.first").alias("first_byte"), F.col("s.last").alias("last_byte"))


@query("with d as (select doc_id, coalesce(text, '') as t from documents), l as (select doc_id, unnest(string_split(t, chr(10))) as s, generate_subscripts(string_split(t, chr(10)), 1) as line from d) select doc_id, line::int as line, count(*) as n from (select doc_id, line, unnest(regexp_extract_all(s, '[0-9]{3,}')) as m from l) group by 1, 2")
def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.match_rows(files(spark, sf_dir).select("doc_id", "text"), ["doc_id"], "[0-9]{3,}", {})
    return found.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
