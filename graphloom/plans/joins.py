"""Joins: resolution by unique names, as-of, prefix, division, semi, anti and outer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import freshness as fr
from ..operators import resolve, retrieve
from .adapter import FILES_SQL, SYMBOLS_SQL, files, symbols, table
from .registry import query


@query(f"with {SYMBOLS_SQL}, f as (select l_orderkey, l_linenumber, concat('Brand#', cast(1 + l_partkey % 25 as string)) as file_path, cast(l_quantity as int) as line from lineitem), m as (select f.*, (select s.symbol_id from symbols s where s.file_path = f.file_path and s.line_start <= f.line order by (s.line_end >= f.line) desc, case when s.line_end >= f.line then s.line_start else -s.line_start end, case when s.line_end >= f.line then s.symbol_id end, s.symbol_id desc limit 1) as symbol_id from (select distinct file_path, line from f) f) select f.l_orderkey, f.l_linenumber, m.symbol_id from f join m using (file_path, line)")
def nearest_symbol_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    facts = li.select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), (1 + F.col("l_partkey") % 25).cast("string")).alias("file_path"), F.col("l_quantity").cast("int").alias("line"))
    # few (file, line) pairs stand for all facts: resolve those, then join back
    known = resolve.nearest_symbol(facts.select("file_path", "line").distinct(), symbols(spark, sf_dir), [])
    return facts.join(known, ["file_path", "line"]).select("l_orderkey", "l_linenumber", "symbol_id")


_LINK = "unnest(regexp_extract_all(coalesce(html, ''), 'href=\"(/[^\"]*)\"', 1))"


@query(
    f"with c as (select page_id, {_LINK} as p from pages), cc as (select row_number() over () as id, page_id, p, case page_id % 3 when 0 then 'ANY' when 1 then 'GET' else 'POST' end as m from (select distinct page_id, p from c)), s as (select distinct p from c where page_id % 2 = 0), srv as (select p, 'GET' as m from s union all select concat(p, '?x'), 'POST' from s where length(p) % 2 = 0), sh as (select *, regexp_replace(p, '[?#].*$', '') as shape from srv), ch as (select *, regexp_replace(p, '[?#].*$', '') as shape from cc), e as (select m, p, count(*) n from srv group by 1, 2), x as (select m, shape, count(*) n from sh group by 1, 2), y as (select shape, count(*) n from sh group by 1) select ch.page_id, ch.p as route_path, case when ch.m <> 'ANY' and e.n = 1 then 'method_exact_path' when ch.m <> 'ANY' and x.n = 1 then 'method_path_shape' when ch.m = 'ANY' and y.n = 1 then 'unique_path_shape_method_unknown' when ch.m <> 'ANY' and x.n > 1 then 'route_not_unique' when ch.m = 'ANY' and y.n > 1 then 'method_unresolved_route_not_unique' else 'route_not_found' end as resolution from ch left join e on e.m = ch.m and e.p = ch.p left join x on x.m = ch.m and x.shape = ch.shape left join y on y.shape = ch.shape"
)
def route_shape_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]*)"'), F.lit(1))
    c = table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("route_path")).distinct()
    method = F.when(F.col("page_id") % 3 == 0, "ANY").when(F.col("page_id") % 3 == 1, "GET").otherwise("POST")
    client = c.select(F.struct("page_id", "route_path").alias("id"), method.alias("method"), "route_path")
    s = c.filter("page_id % 2 = 0").select("route_path").distinct()
    server = s.select(F.lit("GET").alias("method"), "route_path").unionByName(s.filter(F.length("route_path") % 2 == 0).select(F.lit("POST").alias("method"), F.concat("route_path", F.lit("?x")).alias("route_path")))
    server = server.withColumn("route_id", F.concat_ws(" ", "method", "route_path"))
    return resolve.match_routes(client, server).select("id.page_id", "id.route_path", "resolution")


@query(f"with {SYMBOLS_SQL}, o as (select name, count(*) n, min(symbol_id) t from symbols group by 1) select p_partkey, o.n as candidates, case when n = 1 then t end as resolved from part join o on o.name = p_name")
def unique_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return resolve.unique_match(s.select("p_partkey", "name"), "p_partkey", s, ["name"], "symbol_id")


@query(f"with {SYMBOLS_SQL}, a as (select file_path, name, kind, count(*) n, min(symbol_id) t from symbols group by all), b as (select file_path, name, count(*) n, min(symbol_id) t from symbols where kind <> 'PROMO' group by all), c as (select name, count(*) n, min(symbol_id) t from symbols where kind = 'PROMO' group by all) select s.p_partkey, case when a.n = 1 then a.t when a.n > 1 then null when b.n = 1 then b.t when b.n > 1 then null when c.n = 1 then c.t end as resolved, case when a.n = 1 then 'qualified_name' when a.n > 1 then 'symbol_name_ambiguous' when b.n = 1 then 'same_file' when b.n > 1 then 'symbol_name_ambiguous' when c.n = 1 then 'unique_symbol_name' when c.n > 1 then 'symbol_name_ambiguous' else 'symbol_not_found' end as resolution from symbols s left join a on a.file_path = s.file_path and a.name = s.name and a.kind = case when s.p_partkey % 2 = 0 then s.kind else 'x' end left join b on b.file_path = s.file_path and b.name = s.name left join c on c.name = s.name")
def qualified_then_simple_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    refs = s.select("p_partkey", "file_path", "name", F.when(F.col("p_partkey") % 2 == 0, F.col("kind")).otherwise("x").alias("kind"))
    steps = [("qualified_name", s, ["file_path", "name", "kind"]), ("same_file", s.filter("kind <> 'PROMO'"), ["file_path", "name"]), ("unique_symbol_name", s.filter("kind = 'PROMO'"), ["name"])]
    return resolve.first_unique(refs, "p_partkey", steps, "symbol_id", "symbol_not_found", "symbol_name_ambiguous")


@query("with n as (select distinct o_custkey as iface, o_orderpriority as shape from orders where o_orderkey % 2 = 0), h as (select distinct concat(s.s_nationkey, '') as owner, o_orderpriority as shape from orders o join supplier s on s.s_suppkey = o.o_custkey), w as (select iface, count(*) w from n group by 1), g as (select iface, owner, count(*) g from n join h using (shape) group by 1, 2), f as (select iface, count(*) c, min(owner) o from g join w using (iface) where g = w group by 1) select w.iface, coalesce(c, 0) as owners, case when c = 1 then o end as owner from w left join f using (iface)")
def interface_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    needs = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("iface"), F.col("o_orderpriority").alias("shape"))
    has = o.join(s, F.col("s_suppkey") == F.col("o_custkey")).select(F.col("s_nationkey").cast("string").alias("owner"), F.col("o_orderpriority").alias("shape"))
    return resolve.implementers(needs, has)


_FOLDERS = "select '' as folder union all select 'src' union all select 'db/migrations' union all select 'tests' union all select distinct concat('lib/api/', lower(coalesce(source, 'none'))) from documents"


@query(f"with {FILES_SQL}, d as ({_FOLDERS}) select doc_id, (select folder from d where folder = '' or starts_with(f.path, concat(folder, '/')) order by length(folder) desc limit 1) as folder from files f")
def prefix_config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("lib/api/"), F.lower(F.coalesce("source", F.lit("none")))).alias("folder")).distinct()
    known = spark.createDataFrame([("",), ("src",), ("db/migrations",), ("tests",)], "folder string").unionByName(d)
    return resolve.longest_prefix(files(spark, sf_dir).select("doc_id", "path"), known).select("doc_id", "folder")


@query(f"with {SYMBOLS_SQL}, f as (select distinct p_brand as path, case when p_partkey % 2 = 0 then 'go' else 'sql' end as language from part where p_size > 25 and p_partkey % 50 = 0) select symbol_id, language as file_language from symbols left join (select path, min(language) as language from f group by 1) on path = file_path")
def left_join_symbols_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size > 25 and p_partkey % 50 = 0")
    f = p.groupBy(F.col("p_brand").alias("path")).agg(F.min(F.when(F.col("p_partkey") % 2 == 0, "go").otherwise("sql")).alias("language")).withColumn("is_test", F.lit(False))
    return resolve.with_files(symbols(spark, sf_dir), f).select("symbol_id", "file_language")


_STEPS = "steps as (select o_custkey as feature_id, case when o_orderkey % 2 = 0 then concat('s', cast(o_orderkey % 1000 as string)) end as symbol_id, concat('f', cast(o_orderkey % 500 as string)) as file_path from orders)"


@query(f"with {_STEPS.replace('as string', 'as varchar')}, hit as (select feature_id, max(case when symbol_id in ('s2', 's90', 's400') then 'referenced_symbol_changed' when symbol_id is null and file_path in ('f1', 'f77') then 'referenced_file_changed' end) as why from steps group by 1) select c_custkey as feature_id, case when why is null then 'valid' else 'needs_review' end as status, why is not null as needs_review, why as stale_reason from customer left join hit on feature_id = c_custkey")
def semi_changed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"), F.lit("valid").alias("status"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("stale_reason"))
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    return fr.mark_features(features, _feature_steps(spark, sf_dir), one("symbol_id", "s2", "s90", "s400"), one("path", "f1", "f77"))


def _feature_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature_id"), k.alias("step_order"), F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 1000).cast("string"))).alias("symbol_id"), F.concat(F.lit("f"), (k % 500).cast("string")).alias("file_path"))


@query("with old as (select p_partkey, p_brand as file_path, 'old' as version from part), gone as (select distinct p_brand as path from part where p_partkey % 100 = 1), fresh as (select p_partkey, p_brand as file_path, 'new' as version from part where p_partkey % 100 = 1) select * from old where file_path not in (select path from gone) union all select * from fresh")
def anti_removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file_path"), F.lit("old").alias("version"))
    new = old.filter("p_partkey % 100 = 1").withColumn("version", F.lit("new"))
    return fr.replace_facts(old, new, new.select(F.col("file_path").alias("path")))


_DEPS = "deps as (select concat('p', l_partkey) as from_symbol_id, concat('o', l_orderkey) as from_file, concat('s', l_suppkey) as resolved_symbol_id from lineitem)"


@query(f"with {_DEPS}, syms as (select concat('s', s_suppkey) as symbol_id, concat('n', s_nationkey) as file_path from supplier) select file_path as path, 'graph' as channel, 5.0::double as score, concat('callee_of:', from_symbol_id) as reason, symbol_id as symbol, 12 as seq from deps join syms on symbol_id = resolved_symbol_id where from_symbol_id in ('p1', 'p7', 'p30') union all select from_file, 'graph', 4.0, concat('caller_of:', resolved_symbol_id), from_symbol_id, 12 from deps where resolved_symbol_id in ('s3')")
def neighbors_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    deps = table(spark, sf_dir, "lineitem").select(key("p", "l_partkey").alias("from_symbol_id"), key("o", "l_orderkey").alias("from_file"), key("s", "l_suppkey").alias("resolved_symbol_id"))
    syms = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("symbol_id"), key("n", "s_nationkey").alias("file_path"))
    return retrieve.neighbour_hits(deps, syms, ["p1", "p7", "p30", "s3"])


@query("with t as (select concat('test', o_orderkey) as test_file, case when o_orderkey % 3 = 0 then concat('f', o_custkey) end as target_file, case when o_orderkey % 3 <> 0 then concat('s', o_custkey % 50) end as target_symbol_id from orders), p as (select test_file, target_file as f from t where target_file in ('f1', 'f2', 'f4') union select test_file, concat('f', k.k) from t join (select unnest([1, 2, 4]) as k) k on target_symbol_id in (concat('s', k.k), concat('s', k.k + 10))) select test_file as path, 'test' as channel, 7.0::double as score, concat('test_for:', f) as reason, null::varchar as symbol, 13 as seq from p")
def tests_of_best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tests = table(spark, sf_dir, "orders").select(F.concat(F.lit("test"), k.cast("string")).alias("test_file"), F.when(k % 3 == 0, F.concat(F.lit("f"), c.cast("string"))).alias("target_file"), F.when(k % 3 != 0, F.concat(F.lit("s"), (c % 50).cast("string"))).alias("target_symbol_id"))
    syms = spark.createDataFrame([(f"s{n + d}", f"f{n}") for n in (1, 2, 4) for d in (0, 10)], "symbol_id string, file_path string")
    return retrieve.test_hits(tests, syms, ["f1", "f2", "f4"])
