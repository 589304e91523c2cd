"""Edges, traversals and closures."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import traverse as tr
from ..operators.spread import IDS, spread
from .adapter import EDGES_SQL, edges, table
from .registry import query

_TYPE = "case type when 'entry_handler' then 0 when 'api_request' then 1 when 'route_handler' then 2 when 'call' then 3 when 'db_read' then 4 when 'db_write' then 5 when 'page_api' then 6 when 'test_of' then 7 when 'import' then 8 else 9 end"
_CONF = "case confidence when 'exact' then 3 when 'static' then 2 when 'inferred' then 1 else 0 end"
FORWARD = ("customer:000000001", "customer:000000002", "customer:000000004")
BACKWARD = ("region:000000001", "supplier:000000003", "nation:000000007")


def _bfs_sql(starts: tuple[str, ...], here: str, there: str, hops: int, branch: int, least: int) -> str:
    first = " union all ".join(f"select '{s}' as flow_id, '{s}' as node_id" for s in starts)
    return f"""with recursive {EDGES_SQL},
e as (select {here} as a, {there} as b from (select *, row_number() over (partition by {here} order by {_TYPE}, {_CONF} desc, edge_id) as rn from edges where {_CONF} >= {least} and confidence <> 'unresolved') where rn <= {branch}),
s as ({first}),
r(flow_id, node_id, hop) as (select flow_id, node_id, 0 from s union select r.flow_id, e.b, r.hop + 1 from r join e on e.a = r.node_id where r.hop < {hops})
select flow_id, node_id, min(hop)::int as hop from r group by 1, 2"""


def _starts(spark: SparkSession, nodes: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(n, n) for n in nodes], "flow_id string, node_id string")


def _walk(spark: SparkSession, sf_dir: str, nodes: tuple[str, ...], **options) -> tr.Traversal:
    return tr.traverse(edges(spark, sf_dir, once=False), _starts(spark, nodes), repeated=True, **options)


@query(_bfs_sql(FORWARD, "src", "dst", 3, 6, 2))
def bfs_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, FORWARD, max_hops=3, branch_limit=6, node_limit=1000).visited.drop("visit")


@query(_bfs_sql(BACKWARD, "dst", "src", 2, 5, 2))
def bfs_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, BACKWARD, direction="reverse", max_hops=2, branch_limit=5, node_limit=1000).visited.drop("visit")


@query(_bfs_sql(FORWARD, "src", "dst", 3, 6, 1))
def bfs_min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, FORWARD, max_hops=3, branch_limit=6, node_limit=1000, min_confidence="inferred").visited.drop("visit")


@query(f"with {EDGES_SQL}, e as (select *, row_number() over (partition by src order by {_TYPE}, {_CONF} desc, edge_id) rn from edges where {_CONF} >= 2) select src as flow_id, src as node_id, greatest(count(*) - 2, 0) as omitted from e where src in {FORWARD} group by 1 having count(*) > 2")
def bfs_branch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _walk(spark, sf_dir, FORWARD, max_hops=1, branch_limit=2, node_limit=1000)
    return t.frontier.filter("reason = 'branch_limit' and hop = 0").select("flow_id", "node_id", "omitted")


def _queue_sql(starts: tuple[str, ...], hops: int, branch: int, nodes: int, least: int) -> str:
    """The queue's order under a node limit, level by level: new nodes by their first (parent's visit, edge's rank)."""
    first = " union all ".join(f"select '{s}' as flow_id, '{s}' as node_id, 1 as visit, 0 as hop" for s in starts)
    parts = [EDGES_SQL, f"e as (select src as a, dst as b, rn from (select *, row_number() over (partition by src order by {_TYPE}, {_CONF} desc, edge_id) as rn from edges where {_CONF} >= {least} and confidence <> 'unresolved') where rn <= {branch})", f"s0 as ({first})"]
    for h in range(1, hops + 1):
        parts.append(f"c{h} as (select l.flow_id, e.b as node_id, min(l.visit * 1000 + e.rn) as k from s{h - 1} l join e on e.a = l.node_id where l.hop = {h - 1} and not exists (select 1 from s{h - 1} x where x.flow_id = l.flow_id and x.node_id = e.b) group by 1, 2)")
        parts.append(f"l{h} as (select c.flow_id, c.node_id, n + row_number() over (partition by c.flow_id order by k) as visit, {h} as hop from c{h} c join (select flow_id, max(visit) as n from s{h - 1} group by 1) m using (flow_id) qualify visit <= {nodes})")
        parts.append(f"s{h} as (select * from s{h - 1} union all select * from l{h})")
    return f"with {', '.join(parts)} select flow_id, node_id, hop::int as hop, visit::int as visit from s{hops}"


@query(_queue_sql(FORWARD, 4, 10, 40, 2))
def bfs_node_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, FORWARD, max_hops=4, branch_limit=10, node_limit=40).visited


_VISITED = _bfs_sql(FORWARD, "src", "dst", 2, 4, 2).removeprefix("with recursive ")
_FLOW_SQL = f"""with recursive {_VISITED.replace("select flow_id, node_id, min(hop)::int as hop from r group by 1, 2", "select flow_id, node_id, hop from v").rsplit("select flow_id, node_id, hop from v", 1)[0].rstrip()},
v as (select flow_id, node_id, min(hop) as hop from r group by 1, 2),
n as (select src as node_id, sum((confidence = 'unresolved')::int) as u, sum((confidence = 'inferred')::int) as below, sum((confidence in ('static', 'exact'))::int) as ok from edges group by 1),
f as (select v.flow_id, count(*) as nodes, sum(least(coalesce(u, 0), 4)) as unresolved, sum(coalesce(below, 0) + (coalesce(ok, 0) > 4)::int + case when hop = 2 then least(coalesce(ok, 0), 4) else 0 end) as frontier from v left join n using (node_id) group by 1)
select count(*) as flows, sum((frontier = 0 and unresolved = 0)::int)::bigint as complete, sum((frontier > 0 or unresolved > 0)::int)::bigint as partial, sum(nodes)::bigint as nodes, sum(nodes - 1)::bigint as steps, sum(unresolved)::bigint as unresolved from f"""


@query(_FLOW_SQL)
def flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.flow_summary(_walk(spark, sf_dir, FORWARD, max_hops=2, branch_limit=4, node_limit=1000))


_BUILT = """built as (
select distinct concat('file:', p_brand) as f, case when n = 1 then concat('symbol:part:', t) else concat('ref:call:', p_name) end as t, 'call' as type, case when n = 1 then 'static' else 'unresolved' end as confidence from part join (select p_name, count(*) n, min(p_partkey) t from part group by 1) using (p_name)
union select concat('customer:', c_custkey), concat('db:table:', lower(c_mktsegment)), case when c_custkey % 2 = 0 then 'db_read' else 'db_write' end, 'static' from customer
union select concat('file:', s_nationkey), case when s_suppkey % 3 = 0 then concat('symbol:', s_suppkey) else concat('file:', s_nationkey + 1) end, 'test_of', case when s_suppkey % 3 = 0 then 'static' else 'inferred' end from supplier
union select concat('route:server:GET:/', n_name), case when n_nationkey % 2 = 0 then concat('symbol:', n_nationkey) else concat('ref:route_handler:', n_name) end, 'route_handler', case when n_nationkey % 2 = 0 then 'static' else 'unresolved' end from nation
union select concat('entry:job:', n_regionkey), concat('symbol:', n_regionkey), 'entry_handler', 'static' from nation
union select concat('symbol:c', n_nationkey), case when n_nationkey % 5 > 0 then concat('route:server:GET:/', n_name) else concat('ref:api_request:GET /', n_name, 'x') end, 'api_request', case when n_nationkey % 5 > 0 then 'static' else 'unresolved' end from nation)"""


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the builders, each over facts of its kind, in one table with ids."""
    from ..operators import edges as build
    from ..operators.resolve import match_routes

    n = table(spark, sf_dir, "nation")
    key = lambda c: F.col(c).cast("string")
    server = n.select(F.lit("GET").alias("method"), F.concat(F.lit("/"), "n_name").alias("route_path"), "n_nationkey").withColumn("route_id", F.concat_ws(" ", "method", "route_path"))
    routes = server.select(F.concat(F.lit("route:server:GET:"), "route_path").alias("node_id"), F.substring("route_path", 2, 99).alias("handler_ref"), F.when(F.col("n_nationkey") % 2 == 0, key("n_nationkey")).alias("handler_symbol_id"))
    jobs = n.select(F.concat(F.lit("entry:job:"), key("n_regionkey")).alias("node_id"), F.lit("run").alias("handler_ref"), key("n_regionkey").alias("handler_symbol_id"))
    client = n.select(F.concat(F.lit("c"), key("n_nationkey")).alias("symbol_id"), F.lit("f").alias("file_path"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "n_name", F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise("")).alias("route_path"), key("n_nationkey").alias("id"))
    parts = [
        _dependencies(spark, sf_dir),
        _object_edges(spark, sf_dir),
        _test_edges(spark, sf_dir),
        build.handler_edges("route_handler", routes),
        build.handler_edges("entry_handler", jobs),
        build.request_edges(client, match_routes(client.select("id", "method", "route_path"), server.drop("n_nationkey")), server),
    ]
    return build.with_id(reduce(DataFrame.unionByName, parts))


@query(f"with {_BUILT} select type, confidence, count(*) as n, count(distinct f) as sources, count(distinct t) as targets from built group by 1, 2")
def union_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _built(spark, sf_dir)
    # two plain aggregates an end: no row is copied for the second distinct count
    ends = [e.groupBy("type", "confidence", c).agg(F.count("*").alias("k")).groupBy("type", "confidence").agg(F.count("*").alias(name), F.sum("k").alias("n")) for c, name in (("from_node_id", "sources"), ("to_node_id", "targets"))]
    return ends[0].join(ends[1].drop("n"), ["type", "confidence"])


@query(f"with {EDGES_SQL} select node_id, count(*) as degree from (select src as node_id from edges union all select dst from edges) group by 1")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.node_degree(edges(spark, sf_dir))


@query(f"with {EDGES_SQL} select dst as node_id, count(distinct src) as bridge_degree from edges where type in ('db_read', 'db_write') and confidence in ('static', 'exact') group by 1")
def bridge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.bridge_degree(edges(spark, sf_dir), ("db_read", "db_write"))


@query("with recursive p as (select distinct concat('n', n_nationkey) as src, concat('r', n_regionkey) as dst from nation union select concat('s', s_suppkey), concat('n', s_nationkey) from supplier union select concat('r', n_regionkey), concat('n', n_nationkey) from nation where n_nationkey % 5 = 0), c(start, node, depth) as (select 's3', 's3', 0 union select c.start, p.dst, c.depth + 1 from c join p on p.src = c.node where c.depth < 12) select start, node, min(depth)::int as depth from c group by 1, 2")
def export_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    pairs = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    pairs = pairs.unionByName(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))
    pairs = pairs.unionByName(n.filter("n_nationkey % 5 = 0").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")))
    return tr.closure(pairs, spark.createDataFrame([("s3",)], "node string"))


@query("with recursive p as (select distinct concat('n', n_nationkey) as src, concat('r', n_regionkey) as dst from nation union select concat('s', s_suppkey), concat('n', s_nationkey) from supplier union select concat('c', c_custkey), concat('n', c_nationkey) from customer), c(start, node, depth) as (select 'r1', 'r1', 0 union select c.start, p.src, c.depth + 1 from c join p on p.dst = c.node where c.depth < 12) select start, node, min(depth)::int as depth from c group by 1, 2")
def reverse_import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    links = (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"))
    pairs = None
    for t, a, ac, b, bc in links:
        p = table(spark, sf_dir, t).select(name(b, bc).alias("src"), name(a, ac).alias("dst"))
        pairs = p if pairs is None else pairs.unionByName(p)
    return tr.closure(pairs, spark.createDataFrame([("r1",)], "node string"))


@query("with recursive p as (select concat('n', n_nationkey) as a, concat('r', n_regionkey) as b from nation), u as (select a, b from p union select b, a from p), c(start, node, depth) as (select 'n5', 'n5', 0 union select c.start, u.b, c.depth + 1 from c join u on u.a = c.node where c.depth < 8) select start, node, min(depth)::int as depth from c group by 1, 2")
def focus_undirected_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    p = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    both = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return tr.closure(both, spark.createDataFrame([("n5",)], "node string"))


@query("with n as (select concat('part:', p_partkey) as node_id, p_type as kind from part) select node_id, kind, ((dense_rank() over (order by kind)) - 1) * 240 as x, (row_number() over (partition by kind order by node_id) - 1) * 84 as y from n")
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    out = tr.layout(p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_type").alias("kind")))
    return out.withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))


def _object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.edges import db_edges as build

    c = table(spark, sf_dir, "customer")
    return build(c.select(F.lit(None).cast("string").alias("symbol_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("table").alias("object_type"), F.lower("c_mktsegment").alias("object_name"), F.when(F.col("c_custkey") % 2 == 0, "select").otherwise("update").alias("operation")))


@query("select distinct concat('db:table:', lower(c_mktsegment)) as to_node_id, concat('customer:', c_custkey) as from_node_id, case when c_custkey % 2 = 0 then 'db_read' else 'db_write' end as type, 'static' as confidence from customer")
def db_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _object_edges(spark, sf_dir).select("to_node_id", "from_node_id", "type", "confidence")


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import edges as build
    from ..operators.resolve import unique_match
    from .adapter import symbols

    s = symbols(spark, sf_dir)
    found = unique_match(s.select("p_partkey", "name"), "p_partkey", s, ["name"], "symbol_id")
    deps = s.join(found, "p_partkey").select(F.lit("calls").alias("relation"), F.lit(None).cast("string").alias("from_symbol_id"), F.col("file_path").alias("from_file"), F.col("name").alias("to_ref"), F.lit(None).cast("string").alias("to_file"), F.col("resolved").alias("resolved_symbol_id"))
    return build.dependency_edges(deps)


@query("with o as (select p_name, count(*) n, min(p_partkey) t from part group by 1) select concat('file:', p_brand) as from_node_id, case when o.n = 1 then concat('symbol:part:', o.t) else concat('ref:call:', p.p_name) end as to_node_id, case when o.n = 1 then 'static' else 'unresolved' end as confidence, count(*) as n from part p join o using (p_name) group by all")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dependencies(spark, sf_dir).groupBy("from_node_id", "to_node_id", "confidence").agg(F.count("*").alias("n"))


def _test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.edges import test_edges as build

    s = table(spark, sf_dir, "supplier")
    hit = F.col("s_suppkey") % 3 == 0
    return build(s.select(F.col("s_nationkey").cast("string").alias("test_file"), (F.col("s_nationkey") + 1).cast("string").alias("target_file"), F.when(hit, F.col("s_suppkey").cast("string")).alias("target_symbol_id"), F.when(hit, "test_calls_symbol").otherwise("filename_pair").alias("reason")))


@query("select distinct concat('file:', s_nationkey) as from_node_id, case when s_suppkey % 3 = 0 then concat('symbol:', s_suppkey) else concat('file:', s_nationkey + 1) end as to_node_id, case when s_suppkey % 3 = 0 then 'static' else 'inferred' end as confidence from supplier")
def test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_edges(spark, sf_dir).select("from_node_id", "to_node_id", "confidence").distinct()


def _index(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """An index's tables for what is made public, over the driver's."""
    d, p, c, n, r = (table(spark, sf_dir, t) for t in ("documents", "part", "customer", "nation", "region"))
    e = edges(spark, sf_dir)
    text = lambda x: F.col(x).cast("string")
    return SimpleNamespace(
        files=d.select(F.concat(F.lit("d"), text("doc_id")).alias("path"), F.col("lang").alias("language"), F.lit("h").alias("content_hash")),
        symbols=p.select(text("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_size").alias("line_start"), F.col("p_size").alias("line_end")),
        routes=n.select(F.when(F.col("n_nationkey") % 3 == 0, "client").otherwise("server").alias("direction"), F.lit("GET").alias("method"), F.concat(F.lit("/"), text("n_regionkey")).alias("route_path"), F.col("n_name").alias("file_path"), F.lit(1).alias("line")),
        entries=r.select(F.concat(F.lit("entry:cli:"), "r_name").alias("node_id"), F.lit("cli").alias("entry_kind"), F.col("r_name").alias("entry_name"), F.col("r_name").alias("file_path"), F.lit(2).alias("line")),
        objects=c.select(F.lit("table").alias("object_type"), F.lower("c_mktsegment").alias("object_name"), F.col("c_name").alias("file_path"), F.lit(3).alias("line"), F.lit("select").alias("operation")),
        edges=e.select("edge_id", F.col("src").alias("from_node_id"), F.col("dst").alias("to_node_id"), "type", "confidence"),
    )


@query(
    f"with {EDGES_SQL}, k as (select distinct concat('file:d', doc_id) as id, 'document' as kind from documents union all select distinct concat('symbol:', p_partkey), 'symbol' from part union all select distinct concat('route:server:GET:/', n_regionkey), 'route' from nation where n_nationkey % 3 > 0 union all select concat('entry:cli:', r_name), 'entry' from region union all select distinct concat('db:table:', lower(c_mktsegment)), 'data_object' from customer), n as (select distinct src as id from edges union select dst from edges), a as (select * from k union all select id, 'reference' from n where id not in (select id from k)) select kind, count(*) as n, count(distinct id) as ids from a group by 1"
)
def public_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.export import public_nodes as build

    ids = spread(build(_index(spark, sf_dir)).select("kind", "id"), IDS, "id").groupBy("kind", "id").agg(F.count("*").alias("k"))
    return ids.groupBy("kind").agg(F.sum("k").alias("n"), F.count("id").alias("ids"))


@query("select id, count(*) as n from (select distinct substr(sha256(concat('{\"confidence\":\"static\",\"from_node_id\":\"symbol:', l_partkey, '\",\"to_node_id\":\"symbol:', l_suppkey, '\",\"type\":\"call\"}')), 1, 24) as id, l_partkey, l_suppkey from lineitem) group by 1")
def public_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.edges import with_id

    node = lambda c: F.concat(F.lit("symbol:"), F.col(c).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(node("l_partkey").alias("from_node_id"), node("l_suppkey").alias("to_node_id"), F.lit("call").alias("type"), F.lit("static").alias("confidence"))
    return with_id(rows).groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n"))


@query(
    "with i as (select distinct concat('symbol:', l_partkey * 3) as node_id from lineitem union select concat('route:server:GET:/', n_regionkey) from nation union select concat('entry:cli:', r_name) from region union select concat('db:table:', lower(c_mktsegment)) from customer union select concat('file:', n_name) from nation union select concat('ref:call:', n_name) from nation), rt as (select concat('route:server:GET:/', n_regionkey) as node_id, min(n_name) as file_path from nation where n_nationkey % 3 > 0 group by 1) select node_id, split_part(node_id, ':', 1) as kind, case when starts_with(node_id, 'symbol:') then p_brand when starts_with(node_id, 'file:') then substr(node_id, 6) when starts_with(node_id, 'entry:') then r_name else rt.file_path end as file_path, case when starts_with(node_id, 'symbol:') then p_size when starts_with(node_id, 'entry:') then 2 when rt.node_id is not null then 1 end::int as line from i left join part on node_id = concat('symbol:', p_partkey) left join region on node_id = concat('entry:cli:', r_name) left join rt using (node_id)"
)
def describe_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.nodes import describe

    ix = _index(spark, sf_dir)
    none = F.lit(None).cast("string")
    symbols = ix.symbols.select("symbol_id", F.col("name").alias("qualified_name"), F.col("path").alias("file_path"), "line_start")
    c = SimpleNamespace(symbols=symbols, entries=ix.entries, routes=ix.routes.withColumn("symbol_id", none))
    li, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation")
    one = lambda df, kind, v: df.select(F.concat(F.lit(kind), v).alias("node_id"))
    ids = [one(li, "symbol:", (F.col("l_partkey") * 3).cast("string")), one(n, "route:server:GET:/", F.col("n_regionkey").cast("string")), one(table(spark, sf_dir, "region"), "entry:cli:", F.col("r_name")), one(table(spark, sf_dir, "customer"), "db:table:", F.lower("c_mktsegment")), one(n, "file:", F.col("n_name")), one(n, "ref:call:", F.col("n_name"))]
    return describe(reduce(DataFrame.unionByName, ids).distinct(), c).select("node_id", "kind", "file_path", "line")


@query(f"with {EDGES_SQL} select src as node_id, edge_id, rn::int as rn from (select *, row_number() over (partition by src order by {_TYPE}, {_CONF} desc, edge_id) rn from edges) where rn <= 3")
def edge_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(edges(spark, sf_dir).select("src", "edge_id", "type", "confidence"), IDS, "src")
    ranked = e.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(*tr.edge_order())))
    return ranked.filter("rn <= 3").select(F.col("src").alias("node_id"), "edge_id", "rn")


@query(_queue_sql(FORWARD, 2, 4, 1000, 2).rsplit(" select flow_id", 1)[0] + ", up as (select node_id, hop, flow_id from s2) select flow_id, (count(*))::bigint as nodes, (count(*) - 1)::bigint as steps, sum((split_part(node_id, ':', 1) = 'part')::int)::bigint as parts from up group by 1")
def flow_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as rows of a manifest: what they hold, told from the gathered arrays."""
    ix = _index(spark, sf_dir)
    none = F.lit(None).cast("string")
    c = SimpleNamespace(symbols=ix.symbols.select("symbol_id", F.col("name").alias("qualified_name"), F.col("path").alias("file_path"), "line_start"), entries=ix.entries, routes=ix.routes.withColumn("symbol_id", none))
    from ..operators.nodes import describe

    e = edges(spark, sf_dir, once=False)
    t = tr.traverse(e, _starts(spark, FORWARD), repeated=True, max_hops=2, branch_limit=4, node_limit=1000)
    rows = tr.flow_rows(t, e, describe(t.visited, c))
    parts = F.size(F.filter("nodes", lambda n: n["kind"] == "part"))
    return rows.select("flow_id", F.size("nodes").cast("long").alias("nodes"), F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("steps"), parts.cast("long").alias("parts"))
