"""Request telemetry: validation, the state machine of requests, retention, metrics, pages, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the event log.
RETENTION_DAYS, MAX_REQUESTS, MAX_EVENTS = 30, 5000, 128


def request_states(events: DataFrame, started: str, ended: tuple[str, ...], most: int = MAX_EVENTS) -> DataFrame:
    """events (request_id, event_id, event_type) with `verdict`: accepted, or why not.

    In the order of event_id: no event before the start, no second start, none after the end, at most `most` a request.
    """
    before = Window.partitionBy("request_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda cond: F.coalesce(F.sum(cond.cast("int")).over(before), F.lit(0))
    is_start = F.col("event_type") == started
    out = events.withColumn("_s", count(is_start)).withColumn("open", (F.col("_s") > 0) | is_start)
    out = out.withColumn("_e", count(F.col("event_type").isin(*ended) & F.col("open"))).withColumn("_n", count(F.col("open")))
    verdict = F.when(~F.col("open"), "before_start").when(F.col("_e") > 0, "after_end").when(is_start & (F.col("_s") > 0), "started_twice").when(F.col("_n") >= most, "too_many").otherwise("accepted")
    return out.withColumn("verdict", verdict).drop("_s", "_e", "_n", "open")


def retain(requests: DataFrame, now: Column, days: int = RETENTION_DAYS, newest: int = MAX_REQUESTS) -> DataFrame:
    """The newest requests (request_id, ts) that are not older than days: a top-k, so no task sorts them all."""
    fresh = requests.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    return fresh.orderBy(F.desc("ts"), F.desc("request_id")).limit(newest)


def page(requests: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """One page by (ts, request_id) downwards, one row more than size if there is a next page."""
    if after is not None:
        ts, rid = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        requests = requests.filter((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("request_id") < rid)))
    return requests.orderBy(F.desc("ts"), F.desc("request_id")).limit(min(size, 100) + 1)


def metrics(rows: DataFrame, since: Column, until: Column) -> DataFrame:
    """Counts and durations of requests (ts, status, duration_ms) of a window; 0 counts and null averages over none."""
    ok, bad = F.col("status") == "success", F.col("status") == "failure"
    some = rows.filter((F.col("ts") >= since) & (F.col("ts") < until))
    zero = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return some.agg(F.count("*").alias("requests"), zero(ok).alias("success"), zero(bad).alias("failure"), zero((~ok) & (~bad)).alias("running"), F.avg(F.when(ok, F.col("duration_ms"))).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.max("ts").alias("last"))


def latest_event(events: DataFrame, kind: str) -> DataFrame:
    """The last event of a kind of each request: an aggregate, no self-join."""
    return events.filter(F.col("event_type") == kind).groupBy("request_id").agg(F.max_by(F.struct("event_id", "payload", "value"), "event_id").alias("e")).select("request_id", "e.*")


def overlap(selected: DataFrame, read: DataFrame) -> DataFrame:
    """request_id, both, only_selected, only_read of two tables (request_id, path)."""
    a = selected.distinct().withColumn("a", F.lit(1))
    b = read.distinct().withColumn("b", F.lit(1))
    met = a.join(b, ["request_id", "path"], "full")
    n = lambda cond: F.sum(cond.cast("int")).cast("long")
    ina, inb = F.col("a").isNotNull(), F.col("b").isNotNull()
    return met.groupBy("request_id").agg(n(ina & inb).alias("both"), n(ina & ~inb).alias("only_selected"), n(inb & ~ina).alias("only_read"))


# The payload of each type of event, by field; a trailing ? marks a field that may be null, ~ one that may be missing.
FRESHNESS = ("fresh", "stale", "unavailable")
OPERATIONS = ("index", "status", "query")
INTENTS = ("cli", "mcp", "entrypoint", "version", "config", "test", "api", "migration", "project", "other")
PAYLOADS = {
    "request_started": {"operation": OPERATIONS, "query_capture": ("unavailable",), "task_fingerprint?": "hash"},
    "request_completed": {"operation": OPERATIONS, "duration_ms": "duration", "status": ("success", "failure"), "error_code": ("none", "invalid_input", "index_error", "query_error")},
    "index_status_checked": {"freshness": FRESHNESS},
    "index_started": {"force": "flag"},
    "index_completed": {"duration_ms": "duration", "status": ("success", "failure"), "changed_files?": "count", "error_code": ("none", "invalid_input", "index_error")},
    "query_expanded": {"retrieval_mode": ("lexical", "project_anchor", "unavailable"), "alias_count": "count", "detected_intents": "intents"},
    "candidates_retrieved": {"candidate_files": "count"},
    "graph_expanded": {"added_files": "count"},
    "context_selected": {"must_read_count": "count", "maybe_read_count": "count", "test_count": "count"},
    "query_completed": {
        "duration_ms": "duration", "status": ("success",), "index_freshness": FRESHNESS, "reindexed": ("yes", "no", "unavailable"),
        "must_read_count": "count", "maybe_read_count": "count", "test_count": "count", "full_bytes": "count", "compact_bytes": "count",
        "estimated_full_tokens?": "nothing", "estimated_compact_tokens?": "nothing", "token_estimation_method": ("unavailable",),
        "semantic_fallback~": "flag", "measurement_source~": ("measured",),
    },
    "query_failed": {"duration_ms": "duration", "status": ("failure",), "index_freshness": FRESHNESS, "error_code": ("invalid_input", "index_unavailable", "query_error", "semantic_fallback")},
}
#: Forms of scalar values as they stand in JSON.
FORMS = {"hash": r'^"[a-f0-9]{64}"$', "count": r"^[0-9]+$", "duration": r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "flag": r"^(true|false)$", "nothing": r"^$"}
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def repository_id(root: Column) -> Column:
    """What stands for a repository: a hash of its path with forward slashes."""
    return F.sha2(F.translate(root, "\\", "/"), 256)


def task_fingerprint(task: Column) -> Column:
    """A hash of a task in lower case with single spaces; null for none."""
    shown = F.lower(F.trim(F.regexp_replace(task, r"\s+", " ")))
    return F.when(shown != "", F.sha2(shown, 256))


def _fits(raw: Column, kind: str | tuple[str, ...]) -> Column:
    """Whether a value as it stands in JSON is of a kind."""
    if isinstance(kind, tuple):
        return raw.isin(*[f'"{v}"' for v in kind])
    if kind == "intents":
        got = F.from_json(raw, "array<string>")
        return got.isNotNull() & (F.size(got) <= 16) & (F.size(F.array_except(got, F.array(*[F.lit(x) for x in INTENTS]))) == 0)
    return raw.rlike(FORMS[kind])


def invalid(events: DataFrame) -> DataFrame:
    """events (request_id, trace_id, repository_id, event_type, ts, payload: a JSON object) with `reason`: the first rule that is broken, or null.

    Payloads are strict: a field that is not known, missing or of another kind makes the event invalid.
    """
    raw = F.from_json("payload", "map<string,string>")  # scalars as text, so kinds are told from the JSON itself
    keys = F.json_object_keys("payload")
    value = lambda name: F.regexp_extract("payload", rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,}}\s]+)', 1)
    rule = F.lit(None).cast("string")
    for kind, fields in PAYLOADS.items():
        names = [f.rstrip("?~") for f in fields]
        must = [f.rstrip("?") for f in fields if not f.endswith("~")]
        bad = F.when(keys.isNull() | raw.isNull(), "payload_not_an_object").when(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0, "unknown_field").when(F.size(F.array_except(F.array(*[F.lit(n) for n in must]), keys)) > 0, "missing_field")
        for f, form in fields.items():
            name, here = f.rstrip("?~"), value(f.rstrip("?~"))
            empty = (here == "null") if f.endswith("?") else (here == "") if f.endswith("~") else F.lit(False)
            bad = bad.when(~(empty | _fits(here, form)), f"bad_{name}")
        if kind == "request_completed":
            bad = bad.when((value("status") == '"success"') != (value("error_code") == '"none"'), "status_and_error_code_disagree")
        rule = F.when(F.col("event_type") == kind, bad).otherwise(rule)
    head = F.when(~F.coalesce(F.col("event_type").isin(*PAYLOADS), F.lit(False)), "unknown_event_type").when(~F.coalesce(F.col("request_id").rlike(UUID), F.lit(False)), "bad_request_id").when(~F.coalesce(F.col("trace_id").rlike(UUID), F.lit(False)), "bad_trace_id").when(~F.coalesce(F.col("repository_id").rlike("^[a-f0-9]{64}$"), F.lit(False)), "bad_repository_id").when(F.col("ts").isNull(), "bad_timestamp")
    return events.withColumn("reason", F.coalesce(head, rule))


def next_cursor(found: DataFrame, size: int) -> DataFrame:
    """The page itself (what page() gave, without the row too many), each row with the cursor of the next page; null on the last page."""
    from ..functions.text import cursor_encode

    place = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("request_id")))  # size + 1 rows
    rows = found.withColumn("_n", place)
    last = rows.agg(F.when(F.max("_n") > size, F.max_by(F.struct("ts", "request_id"), F.when(F.col("_n") <= size, F.col("_n")))).alias("_l"))
    return rows.filter(F.col("_n") <= size).join(F.broadcast(last)).withColumn("next", F.when(F.col("_l").isNotNull(), cursor_encode(F.col("_l.ts"), F.col("_l.request_id")))).drop("_n", "_l")


def effects(events: DataFrame, by: str | None = None) -> DataFrame:
    """Measured queries, their bytes and estimated tokens, in all or by a column; events: payload."""
    from ..functions.text import token_estimate

    size = F.octet_length("payload")
    some = events.filter("payload is not null")
    sums = [F.count("*").alias("measured"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(token_estimate(size)), F.lit(0)).cast("long").alias("tokens")]
    return some.groupBy(by).agg(*sums) if by else some.agg(*sums)


def experiment_summary(selected: DataFrame, actions: DataFrame) -> DataFrame:
    """request_id with how many files an agent read and edited, its operations and bytes, and how what it read overlaps with what was selected.

    selected: request_id, path. actions: request_id, kind (read, edit or other), path, n_bytes.
    """
    is_kind = lambda k: F.col("kind") == k
    per = actions.groupBy("request_id").agg(
        F.countDistinct(F.when(is_kind("read"), F.col("path"))).alias("files_read"),
        F.countDistinct(F.when(is_kind("edit"), F.col("path"))).alias("files_edited"),
        F.count("*").alias("operations"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    met = overlap(selected.select("request_id", "path"), actions.filter(is_kind("read")).select("request_id", "path"))
    return per.join(met, "request_id", "full").na.fill(0)


def append_events(events: DataFrame, path: str) -> dict:
    """Append what is valid and accepted by its request's states to the log at path, and say how many were not, by reason.

    events: request_id, event_id, and what invalid() reads. Rejected rows are not written; a request's former events count.
    """
    spark = events.sparkSession
    checked = invalid(events)
    good = checked.filter("reason is null").drop("reason")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.parquet(path) if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else None
    both = good.withColumn("_new", F.lit(True)) if old is None else good.withColumn("_new", F.lit(True)).unionByName(old.join(good.select("request_id").distinct(), "request_id", "left_semi").withColumn("_new", F.lit(False)))
    from .cut import cut

    judged = cut(request_states(both, "request_started", ("request_completed",)).filter("_new").drop("_new"))
    judged.filter("verdict = 'accepted'").drop("verdict").write.mode("append").parquet(path)
    counts = {r.verdict: r["count"] for r in judged.groupBy("verdict").count().collect()}
    return counts | {r.reason: r["count"] for r in checked.filter("reason is not null").groupBy("reason").count().collect()}
