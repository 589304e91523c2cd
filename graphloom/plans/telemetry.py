"""Telemetry over the events table: request_id is user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry as te
from .adapter import table
from .registry import query

_RID = "concat(cast(user_id as string), '-', cast(cast(ts as date) as string))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_RID).alias("request_id"), "event_type", "value", F.col("props").alias("payload"), "user_id")


@query("select count(*) as requests, coalesce(sum((event_type = 'purchase')::int), 0)::bigint as success, coalesce(sum((event_type = 'error')::int), 0)::bigint as failure, max(value) as max_ms from events where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 00:00:00'")
def conditional_metrics_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").otherwise("running")
    m = te.metrics(e.select("ts", status.alias("status"), F.col("value").alias("duration_ms")), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"))
    return m.select("requests", "success", "failure", "max_ms")


@query(f"with e as (select *, {_RID} as request_id from events where event_type = 'purchase') select request_id, event_id, value from (select *, row_number() over (partition by request_id order by event_id desc) rn from e) where rn = 1")
def latest_event_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.latest_event(_events(spark, sf_dir), "purchase").select("request_id", "event_id", "value")


@query("select event_id from events where ts >= (select max(ts) from events) - interval 10 day order by ts desc, event_id desc limit 100")
def retention_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", F.col("event_id").alias("request_id"))
    last = e.agg(F.max("ts")).first()[0]
    return te.retain(e, F.lit(last), 10, 100).select(F.col("request_id").alias("event_id"))


@query("select event_id from events where ts < timestamp '2024-01-15 12:00:00' or (ts = timestamp '2024-01-15 12:00:00' and event_id < 500) order by ts desc, event_id desc limit 26")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", F.col("event_id").alias("request_id"))
    return te.page(e, 25, ("2024-01-15 12:00:00", 500)).select(F.col("request_id").alias("event_id"))


@query("select event_type, count(*) as measured, sum(octet_length(encode(props)))::bigint as bytes, sum(ceil(octet_length(encode(props)) / 4.0))::bigint as tokens from events group by 1")
def effects_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.effects(_events(spark, sf_dir), "event_type")


_PRE = "over (partition by request_id order by event_id rows between unbounded preceding and 1 preceding)"


@query(
    f"with e as (select event_id, event_type, {_RID} as request_id from events), s as (select *, coalesce(sum((event_type = 'signup')::int) {_PRE}, 0) as ns from e), o as (select *, ns > 0 or event_type = 'signup' as open from s), p as (select *, coalesce(sum((event_type in ('purchase', 'error') and open)::int) {_PRE}, 0) as ne, coalesce(sum(open::int) {_PRE}, 0) as n from o) select event_id, case when not open then 'before_start' when ne > 0 then 'after_end' when event_type = 'signup' and ns > 0 then 'started_twice' when n >= 128 then 'too_many' else 'accepted' end as verdict from p"
)
def request_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.request_states(_events(spark, sf_dir).select("request_id", "event_id", "event_type"), "signup", ("purchase", "error")).select("event_id", "verdict")


@query("with a as (select distinct o_custkey as request_id, o_orderpriority as path from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as request_id, o_orderpriority as path from orders where o_orderstatus = 'O') select request_id, sum((a.x is not null and b.x is not null)::int)::bigint as both, sum((b.x is null)::int)::bigint as only_selected, sum((a.x is null)::int)::bigint as only_read from (select *, true as x from a) a full join (select *, true as x from b) b using (request_id, path) group by 1")
def experiment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderpriority").alias("path"), "o_orderstatus")
    return te.overlap(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'O'").drop("o_orderstatus"))


#: Payloads by number: which are valid, and what is wrong with the others.
_CASES = (
    ("candidates_retrieved", '{"candidate_files": 3}', None),
    ("candidates_retrieved", '{"candidate_files": -3}', "bad_candidate_files"),
    ("candidates_retrieved", '{"candidate_files": 3, "extra": 1}', "unknown_field"),
    ("graph_expanded", "{}", "missing_field"),
    ("graph_expanded", "no json", "payload_not_an_object"),
    ("request_completed", '{"operation":"query","duration_ms":1.5,"status":"success","error_code":"none"}', None),
    ("request_completed", '{"operation":"query","duration_ms":1.5,"status":"success","error_code":"query_error"}', "status_and_error_code_disagree"),
    ("request_started", '{"operation":"index","query_capture":"unavailable","task_fingerprint":null}', None),
    ("request_started", '{"operation":"stop","query_capture":"unavailable","task_fingerprint":null}', "bad_operation"),
    ("query_expanded", '{"retrieval_mode":"lexical","alias_count":2,"detected_intents":["cli","api"]}', None),
    ("query_expanded", '{"retrieval_mode":"lexical","alias_count":2,"detected_intents":["cli","sing"]}', "bad_detected_intents"),
    ("index_started", '{"force": "yes"}', "bad_force"),
    ("dance", "{}", "unknown_event_type"),
)
_WHY = " ".join(f"when {n} then {'null' if why is None else repr(why)}" for n, (_, _, why) in enumerate(_CASES))


@query(f"select event_id, case event_id % {len(_CASES)} {_WHY} end as reason from events")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(_CASES)).cast("int").alias("case"), F.col("ts").cast("timestamp").alias("ts"))
    cases = spark.createDataFrame([(n, kind, payload) for n, (kind, payload, _) in enumerate(_CASES)], "case int, event_type string, payload string")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    full = e.join(F.broadcast(cases), "case").withColumn("request_id", uuid).withColumn("trace_id", uuid).withColumn("repository_id", te.repository_id(F.lit("C:\\repo")))
    return te.invalid(full).select("event_id", "reason")


@query("with p as (select event_id, ts from events where ts < timestamp '2024-01-15 12:00:00' order by ts desc, event_id desc limit 25) select event_id, (select rtrim(translate(to_base64(encode(concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '|', event_id))), '+/', '-_'), '=') from (select * from p order by ts, event_id limit 1)) as next from p")
def page_with_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("request_id"))
    found = te.page(e, 25, ("2024-01-15 12:00:00", 0))
    return te.next_cursor(found, 25).select(F.col("request_id").alias("event_id"), "next")


_ACTS = "acts as (select o_custkey as request_id, case o_orderkey % 3 when 0 then 'read' when 1 then 'edit' else 'other' end as kind, o_orderpriority as path, cast(floor(o_totalprice) as bigint) as n_bytes from orders), sel as (select distinct o_custkey as request_id, o_orderpriority as path from orders where o_orderstatus = 'O')"


@query(f'''with {_ACTS}, a as (select request_id, count(distinct path) filter (kind = 'read') as files_read, count(distinct path) filter (kind = 'edit') as files_edited, count(*) as operations, sum(n_bytes)::bigint as n_bytes from acts group by 1), r as (select distinct request_id, path from acts where kind = 'read'), o as (select coalesce(s.request_id, r.request_id) as request_id, sum((s.path is not null and r.path is not null)::int)::bigint as "both", sum((r.path is null)::int)::bigint as only_selected, sum((s.path is null)::int)::bigint as only_read from sel s full join r on s.request_id = r.request_id and s.path = r.path group by 1) select request_id, coalesce(files_read, 0) as files_read, coalesce(files_edited, 0) as files_edited, coalesce(operations, 0) as operations, coalesce(n_bytes, 0) as n_bytes, coalesce("both", 0) as "both", coalesce(only_selected, 0) as only_selected, coalesce(only_read, 0) as only_read from a full join o using (request_id)''')
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    acts = o.select(F.col("o_custkey").alias("request_id"), F.when(k == 0, "read").when(k == 1, "edit").otherwise("other").alias("kind"), F.col("o_orderpriority").alias("path"), F.floor("o_totalprice").cast("long").alias("n_bytes"))
    return te.experiment_summary(o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("request_id"), F.col("o_orderpriority").alias("path")), acts)
