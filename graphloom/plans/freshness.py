"""Freshness: differences of snapshots, change events, feature states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import freshness as fr
from .adapter import FILES_SQL, files, table
from .registry import query

_OLD = "old as (select path, sha256(case when doc_id % 11 = 0 then concat(text, 'x') else text end) as content_hash, case when doc_id % 13 = 0 then 'v1' else 'v2' end as parser_version from files where doc_id % 10 <> 0), new as (select path, sha256(text) as content_hash, 'v2' as parser_version from files where doc_id % 9 <> 0)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    touched = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old = f.filter("doc_id % 10 <> 0").select("path", F.sha2(touched, 256).alias("content_hash"), F.when(F.col("doc_id") % 13 == 0, "v1").otherwise("v2").alias("parser_version"))
    return old, f.filter("doc_id % 9 <> 0").select("path", F.sha2("text", 256).alias("content_hash"), F.lit("v2").alias("parser_version"))


_STATE = "case when old.path is null then 'added' when new.path is null then 'removed' when old.content_hash <> new.content_hash then 'changed' when old.parser_version <> new.parser_version then 'parser_changed' else 'fresh' end"


@query(f"with {FILES_SQL}, {_OLD} select {_STATE} as state, count(*) as n from old full join new using (path) group by 1")
def full_outer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.compare(*_snapshots(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"with {FILES_SQL}, {_OLD}, c as (select path, {_STATE} as state from old full join new using (path)) select state, path from (select *, row_number() over (partition by state order by path) rn from c where state <> 'fresh') where rn <= 8")
def stale_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.samples(fr.compare(*_snapshots(spark, sf_dir)), 8)


@query("with a as (select p_partkey as symbol_id, p_brand as file_path, cast(p_size as string) as h from part where p_partkey % 8 <> 0), b as (select p_partkey as symbol_id, p_brand as file_path, cast(p_size + case when p_partkey % 5 = 0 then 1 else 0 end as string) as h from part where p_partkey % 7 <> 0) select symbol_id, case when a.h is null then 'symbol_added' when b.h is null then 'symbol_removed' else 'symbol_changed' end as kind, a.h as old_hash, b.h as new_hash from a full join b using (symbol_id) where a.h is distinct from b.h")
def symbol_diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.filter("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("symbol_id"), F.col("p_size").cast("string").alias("hash"))
    new = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).cast("string").alias("hash"))
    return fr.symbol_events(old, new)


_FEATURES = "features as (select c_custkey as feature_id, c_custkey % 7 = 0 as needs_review, case when c_custkey % 7 = 0 then 'waits' end as stale_reason from customer), steps as (select o_custkey as feature_id, case when o_orderkey % 3 > 0 then concat('k', o_orderkey % 400) end as symbol_id, case when o_orderstatus <> 'F' then concat('h', o_orderkey % 400) when o_orderkey % 50 = 0 then 'other' end as observed from orders), state as (select f.feature_id, coalesce(bool_or(symbol_id in ('k11', 'k222')), false) as gone, coalesce(bool_or(symbol_id is not null and symbol_id not in ('k11', 'k222') and observed is not null and observed <> concat('h', substr(symbol_id, 2))), false) as changed, count(s.feature_id) as steps from features f left join steps s using (feature_id) group by 1), done as (select feature_id, case when gone then 'stale' when changed or needs_review then 'needs_review' else 'valid' end as status, gone or changed or needs_review as needs_review, case when gone then 'unresolved_feature_symbol' when changed then 'referenced_symbol_changed' else stale_reason end as stale_reason, steps from state join features using (feature_id))"


def _feature_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    held = F.col("c_custkey") % 7 == 0
    features = c.select(F.col("c_custkey").alias("feature_id"), F.lit("d").alias("definition_hash"), held.alias("needs_review"), F.when(held, "waits").alias("stale_reason"))
    name = (k % 400).cast("string")
    observed = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("h"), name)).when(k % 50 == 0, "other")
    steps = o.select(F.col("o_custkey").alias("feature_id"), k.alias("step_order"), F.when(k % 3 > 0, F.concat(F.lit("k"), name)).alias("symbol_id"), F.lit("x").alias("file_path"), observed.alias("observed_hash"))
    symbols = spark.range(400).filter("id not in (11, 222)").select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("symbol_id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("implementation_hash"))
    return fr.feature_status(features, steps, symbols)


@query(f"with {_FEATURES} select feature_id, status, needs_review, stale_reason, steps from done")
def feature_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_state(spark, sf_dir).drop("generated_hash")


@query(f"with {_FEATURES} select status, count(*) as n from done group by 1")
def feature_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.status_counts(_feature_state(spark, sf_dir))


@query("select c_custkey as feature_id, case when c_custkey % 4 = 0 then 'h2' else 'h1' end as definition_hash, case when c_custkey % 5 = 0 or c_custkey % 4 = 0 then 'valid' else 'needs_review' end as status, n.n as step_order, case when c_custkey % 5 > 0 and c_custkey % 4 > 0 then 'seen' end as observed_hash from customer, (select 1 as n union all select 7) n where c_custkey % 3 <> 0 and (n = 1 or c_custkey % 5 = 0 or c_custkey % 4 = 0)")
def sync_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("feature_id"), F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"))
    stored = c.filter(k % 5 != 0).select("feature_id", F.lit("h1").alias("definition_hash"), F.lit("needs_review").alias("status"), F.lit(True).alias("needs_review"), none.alias("stale_reason"), none.alias("generated_hash"), none.alias("reviewed_at"))
    had = stored.select("feature_id", F.lit(1).alias("step_order"), F.lit("see").alias("action"), F.lit("s").alias("symbol_id"), none.alias("file_path"), F.lit("seen").alias("observed_hash"))
    step = lambda order: F.struct(order.cast("int").alias("order"), F.lit("see").alias("action"), F.lit("s").alias("symbol_id"), none.alias("file_path"))
    defined = c.filter(k % 3 != 0).select("feature_id", F.lit("n").alias("name"), F.lit("d").alias("description"), F.when(k % 4 == 0, "h2").otherwise("h1").alias("definition_hash"), F.array(F.lit("i")).alias("invariants"), F.array(step(F.lit(None)), step(F.lit(7))).alias("steps"))
    features, steps = fr.sync_features(stored, had, defined)
    return features.join(steps, "feature_id").select("feature_id", "definition_hash", "status", "step_order", "observed_hash")


_LANG = "lang as (select path, case when ends_with(path, '.ts') then 'typescript' when ends_with(path, '.go') then 'go' else 'text' end as language from files)"


@query(
    f"with recursive {FILES_SQL}, {_LANG}, st as (select path, case when doc_id % 31 = 3 then 'changed' else 'fresh' end as state from files), imp as (select b.path as from_file, a.path as to_file from files a join files b on a.doc_id = b.doc_id // 2 and b.doc_id > 1), up(path) as (select st.path from st join lang using (path) where state = 'changed' and language = 'typescript' union select from_file from up join imp on to_file = up.path) select path from st where state = 'changed' union select path from up"
)
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", "path")
    states = f.select("path", F.when(F.col("doc_id") % 31 == 3, "changed").otherwise("fresh").alias("state"))
    language = F.when(F.col("path").endswith(".ts"), "typescript").when(F.col("path").endswith(".go"), "go").otherwise("text")
    users = f.filter("doc_id > 1").select(F.col("path").alias("from_file"), F.floor(F.col("doc_id") / 2).alias("doc_id"))
    imports = users.join(f.withColumnRenamed("path", "to_file"), "doc_id").select("from_file", "to_file")
    return fr.pending(states, f.select("path", language.alias("language")), imports)
