"""Scoring, ranking, evaluation and output shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.query import expand_query
from ..operators import retrieve
from .adapter import FILES_SQL, files, table
from .registry import query

TERMS = ["the", "ent", "an", "die"]
SURFACE = ["service", "api", "test", "package", "lib"]


def _score(col: str, terms: list[str], w: float) -> str:
    return " + ".join(f"case when contains(lower({col}), '{t}') then {w} + case when starts_with(lower({col}), '{t}') then {w / 2} else 0.0 end else 0.0 end" for t in terms)


@query(f"with {FILES_SQL} select doc_id, ({_score('text', TERMS, 2.0)})::double as score from files order by score desc, doc_id limit 50")
def text_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = files(spark, sf_dir).select("doc_id", text.text_score(F.col("text"), TERMS, 2.0).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(50)


_SHOWN = "lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))"
_SURF = " + ".join(f"case when stem = '{t}' then 24.0 when list_contains(tokens, '{t}') then 9.0 else 0.0 end" for t in SURFACE)


@query(f"with {FILES_SQL}, t as (select doc_id, split_part(regexp_extract({_SHOWN}, '[^/]*$'), '.', 1) as stem, regexp_extract_all({_SHOWN}, '[a-z0-9]+') as tokens from files) select doc_id, least(30.0, {_SURF})::double as score from t")
def path_surface_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.path_surface_score(F.col("path"), SURFACE).alias("score"))


@query(f"with {FILES_SQL} select case when regexp_matches(path, '(^|/)migrations?/') then case when ends_with(path, '.down.sql') then 0.12 else 0.25 end else 1.0 end::double as multiplier, count(*) as n from files group by 1")
def migration_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(paths.path_multiplier(F.col("path"), ["task"]).alias("multiplier")).agg(F.count("*").alias("n"))


@query(f"with {FILES_SQL} select doc_id, case regexp_extract(path, '[^/]*$') when 'package.json' then 20 else 0 end::int as score from files")
def manifest_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", paths.manifest_score(F.col("path")).cast("int").alias("score"))


@query("with c as (select p_brand as path, p_type as channel, p_size * 0.5 as score from part), m as (select path, channel, max(score) as s from c group by 1, 2) select path, sum(s)::double as score, count(*) as channels from m group by 1")
def channel_max_file_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("path"), F.col("p_type").alias("channel"), (F.col("p_size") * 0.5).alias("score"), F.col("p_name").alias("reason"), F.lit(None).cast("string").alias("symbol"), F.col("p_size").alias("seq"))
    return retrieve.file_scores(rows).select("path", "score", F.size("channels").cast("long").alias("channels"))


_DET = f"with {FILES_SQL}, r as (select path, doc_id, row_number() over (order by s desc, path) as rank from (select path, doc_id, ({_score('text', TERMS, 2.0)})::double as s from files) ), n as (select least(count(*), 36) as n from r)"


@query(f"{_DET}, f as (select path, r.rank, (1 - 0.25::double) * (case when n <= 1 then 1.0::double else 1.0::double - ((r.rank - 1)::double / (n - 1)::double) end) + 0.25::double * ((doc_id % 8) / 8.0::double) as fused from r, n where r.rank <= n) select path, row_number() over (order by fused desc, rank, path)::int as rank, fused from f")
def rerank_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    scored = f.select("path", "doc_id", text.text_score(F.col("text"), TERMS, 2.0).alias("score"))
    top = scored.orderBy(F.desc("score"), "path").limit(64)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    pool = ranked.filter("rank <= 36")
    return retrieve.rerank(pool.select("path", "rank"), pool.select("path", (F.col("doc_id") % 8 / 8.0).alias("semantic_score")), 0.25, 12)


@query("with r as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as i, count(*) over (partition by s_nationkey) as n from supplier) select s_nationkey, s_suppkey, case when n <= 1 then 1.0 else 1.0::double - ((i - 1)::double / (n - 1)::double) end::double as normalised from r")
def rank_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    s = table(spark, sf_dir, "supplier").withColumn("i", F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey"))).withColumn("n", F.count("*").over(w))
    return s.select("s_nationkey", "s_suppkey", retrieve.rank_normalised(F.col("i"), F.col("n")).alias("normalised"))


_REL = "with r as (select o_custkey as q, o_orderstatus = 'F' as relevant, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders), q as (select q, min(rank) filter (where relevant) as first from r group by 1)"


@query(f"{_REL} select count(*) as queries, sum((first <= 1)::int) as hit_1, sum((first <= 3)::int) as hit_3, sum((first <= 5)::int) as hit_5, cast(round(1000000 * avg(coalesce(1.0::double / first, 0))) as bigint) as mrr_ppm, median(first)::double as median_first from q")
def hit_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    q = retrieve.ranking_quality(r.select(F.col("o_custkey").alias("query"), "rank", (F.col("o_orderstatus") == "F").alias("relevant")))
    return q.withColumn("mrr_ppm", F.round(1_000_000 * F.col("mrr")).cast("long")).drop("mrr")


@query("select *, tp::double / (tp + fp) as precision, tp::double / (tp + fn) as recall from (select sum((quality = 1 and toxic = 1)::int) as tp, sum((quality = 0 and toxic = 1)::int) as fp, sum((quality = 1 and toxic = 0)::int) as fn, sum((quality = 0 and toxic = 0)::int) as tn from labels)")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    wanted = lab.select("doc_id", (F.col("quality") == 1).alias("present"))
    return retrieve.precision_recall(retrieve.confusion(lab.filter("toxic = 1").select("doc_id"), wanted, ["doc_id"]))


@query("select c_custkey, case when n = 0 then 'insufficient' when failed > 0 then 'review_required' when n > 60 or strong > 250 then 'broad' else 'sufficient' end as status from (select c_custkey, count(o_orderkey) as n, sum((o_totalprice > 250000)::int) as strong, sum((o_orderstatus = 'P')::int) as failed from customer left join orders on o_custkey = c_custkey group by 1)")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 250000).cast("int")).alias("strong"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("failed"))
    met = c.join(per, "c_custkey", "left").na.fill(0)
    return met.select("c_custkey", retrieve.coverage(F.col("n"), F.col("strong"), F.col("failed"), 12).alias("status"))


@query("select p_brand as path, array_to_string(list_slice(list_sort(list_distinct(list(p_name))), 1, 6), ',') as hints from part group by 1")
def compact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.lit("symbol:x::"), F.col("p_name"))
    per = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sort_array(F.collect_list(ids)).alias("symbols"))
    return per.select("path", F.array_join(retrieve.shown_symbols(F.col("symbols"), 6), ",").alias("hints"))


_TASK = "refund the order list"
_EXP = expand_query(_TASK)


@query(
    f"with f as (select s_suppkey as feature_id, concat(s_name, case when s_suppkey % 4 = 0 then ' Order' else '' end) as name, case when s_suppkey % 3 = 0 then 'the list of refunds' else 'none' end as description, case when s_suppkey % 5 = 0 then ['orders stay', 'x'] else [] end as invariants, case when s_suppkey % 2 = 0 then 'order' else 'see' end as action from supplier), s as (select feature_id, {_score('name', _EXP.terms, 12.0)} + {_score('description', _EXP.terms, 8.0)} + list_sum(list_concat([0.0], [{_score('v', _EXP.terms, 5.0)} for v in invariants])) + {_score('action', _EXP.terms, 5.0)} as score from f) select feature_id, score::double as score from s where score > 0 order by score desc, feature_id limit 3"
)
def feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    step = F.array(F.struct(F.when(k % 2 == 0, "order").otherwise("see").alias("action"), F.lit(None).cast("string").alias("symbol_id"), F.lit(None).cast("string").alias("file_path")))
    invariants = F.when(k % 5 == 0, F.array(F.lit("orders stay"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    f = table(spark, sf_dir, "supplier").select(k.alias("feature_id"), F.concat("s_name", F.when(k % 4 == 0, " Order").otherwise("")).alias("name"), F.when(k % 3 == 0, "the list of refunds").otherwise("none").alias("description"), invariants.alias("invariants"), step.alias("steps"))
    return retrieve.feature_scores(f, _EXP).select("feature_id", "score")


_FACT = expand_query("small bolt red", {"bolt": ["bolt"]})


@query(f"select * from (select p_partkey, case when ({_score('v', ['bolt'], 24.0)}) > 0 then {_score('v', ['bolt'], 24.0)} + {_score('v', _FACT.terms, 10.0)} else 0.0 end::double as score from (select p_partkey, concat('GET /', p_name) as v from part)) where score > 0")
def fact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("GET /"), "p_name").alias("v"))
    return v.select("p_partkey", retrieve.fact_score(F.col("v"), _FACT, retrieve.ROUTE_WEIGHTS).alias("score")).filter("score > 0")


_SYM = expand_query("widget small")


@query(f"with s as (select p_partkey as symbol_id, {_score('p_name', _SYM.terms, 14.0)} + {_score('p_type', _SYM.terms, 12.0)} + {_score('p_brand', _SYM.terms, 6.0)} as score from part) select symbol_id, score::double as score from s where score > 0")
def symbol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    s = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified_name"), F.col("p_brand").alias("file_path"), none.alias("description"), none.alias("signature"))
    return retrieve.symbol_scores(s, _SYM).select("symbol_id", "score")


@query("with r as (select concat('f', lpad(o_custkey::varchar, 9, '0')) as path, sum(o_totalprice)::double as final, bool_or(o_orderpriority = '1-URGENT') as urgent, max(o_orderkey) as k from orders group by 1), top as (select path, 0 as place, -1 as grp from r order by final desc, path limit 10), g as (select path, row_number() over (order by k desc, final desc, path) as place, 0 as grp from r where urgent order by place limit 6) select path, list_sort(list(grp))::varchar as groups from (select * from top union all select * from g) group by 1")
def reserved_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("f"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("path"))
    r = o.agg(F.sum("o_totalprice").alias("final"), F.when(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), F.array(F.lit("urgent"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.max("o_orderkey").alias("k"))
    group = retrieve.Group("manifest", "urgent", 1, F.col("k"), F.lit(True), False)
    found = retrieve.pool(r, [group], 10)  # one place and five that others may hold
    return found.select("path", F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(F.map_keys("places"), lambda x: x.cast("string"))), ", "), F.lit("]")).alias("groups"))


_WORDS = ["the", "Ent", "x-1"]


@query("with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents) select doc_id, (3.0 * (list_contains(w, 'the')::int + list_contains(w, 'ent')::int + list_contains(w, 'x1')::int))::double as score from t")
def exact_token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.exact_token_score(F.col("text"), _WORDS, 3.0).alias("score"))


_LEX = ["api", "an", "test"]
_LEX_SQL = " + ".join(f"case when contains(lower(path), '{t}') then 8.0 else 0.0 end + case when contains(lower(text), '{t}') then 2.0 else 0.0 end + case when len(string_split(lower(text), '{t}')) > 2 then 1.0 else 0.0 end" for t in _LEX)


@query(f"with {FILES_SQL} select doc_id, (case when doc_id % 10 = 0 then 6.0 else 0.0 end + {_LEX_SQL} + case when regexp_matches(regexp_extract(lower(path), '[^/]*$'), 'test|spec|acceptance') then 3.0 else 0.0 end)::double as score from files order by score desc, doc_id limit 40")
def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by lexical score, ties as the candidates came."""
    scored = files(spark, sf_dir).select("doc_id", text.lexical_score(F.col("path"), F.col("text"), _LEX, F.col("doc_id") % 10 == 0).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(40)


@query("select case when p >= 0.8 then 'must_read' when p >= 0.4 then 'maybe_read' else 'skip' end as verdict, count(*) as n from (select (c_custkey % 100) / 100.0 as p from customer) group by 1")
def classify_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(((F.col("c_custkey") % 100) / 100).alias("p"))
    return p.groupBy(text.classify_score(F.col("p"), 0.8, 0.4).alias("verdict")).agg(F.count("*").alias("n"))


_SURFACE = expand_query("api packages")
_API = "path_tokens as (select path, not is_test as code, stem, tokens, lower(path) as low from (select path, regexp_matches(path, '(^|/)(test|tests|__tests__|acceptance)(/|$)') or regexp_matches(path, '(^|[._-])(test|spec)([._-]|$)') or regexp_matches(path, '_test\\.go$') as is_test, split_part(regexp_extract(" + _SHOWN + ", '[^/]*$'), '.', 1) as stem, regexp_extract_all(" + _SHOWN + ", '[a-z0-9]+') as tokens from files))"
_ALIAS = " + ".join(f"case when stem = '{t}' then 24.0 when list_contains(tokens, '{t}') then 9.0 else 0.0 end" for t in ("api", "route", "router", "handler", "endpoint"))


@query(
    f"with {FILES_SQL}, {_API}, r as (select path, 'path' as channel, ({_score('low', _SURFACE.terms, 2.0)})::double as score from path_tokens where code union all select path, 'developer_intent', least(30.0, {_ALIAS})::double from path_tokens where code union all select path, 'manifest', (case when ends_with(path, '/package.json') then 20.0 + least(6.0, {_score('low', _SURFACE.focus(), 2.0)}) else 0.0 end)::double from path_tokens where code) select channel, path, score from r where score > 0"
)
def path_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("is_test", paths.is_test_path(F.col("path")))
    return retrieve.path_hits(f, _SURFACE, "api packages").select("channel", "path", "score")


_TESTS = expand_query("check the api test list")


@query(
    f"with {FILES_SQL}, {_API}, t as (select f.path, f.text, lower(f.path) as low, stem, tokens, regexp_extract_all(lower(substr(f.text, 1, 24576)), '[a-z0-9]+') as words from path_tokens p join files f using (path) where not code) select * from (select path, least(48.0, least(30.0, "
    + " + ".join(f"case when stem = '{t}' then 24.0 when list_contains(tokens, '{t}') then 9.0 else 0.0 end" for t in ("api", "route", "router", "handler", "endpoint"))
    + ") + "
    + " + ".join(f"case when list_contains(words, '{t}') then 6.0 else 0.0 end" for t in ("api", "route", "router", "handler", "endpoint"))
    + f" + least(18.0, {_score('low', _TESTS.focus(), 3.0)} + {_score('substr(text, 1, 24576)', _TESTS.focus(), 1.0)}))::double as score from t) where score > 0"
)
def direct_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("is_test", paths.is_test_path(F.col("path")))
    found = retrieve.path_hits(f, _TESTS, "check the api test list")
    return found.filter("channel = 'direct_test'").select("path", "score")
