"""The stored index: snapshots of its tables, a pointer to the current one, and refreshes that analyze only what changed."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import Facts, Index, extract, read_files, relate
from .operators import freshness
from .operators.cut import cut

SCHEMA_VERSION = 2
FACTS = ("parsed", "objects", "server", "client", "entries")
RELATIONS = ("symbols", "dependencies", "routes", "entries", "objects", "tests", "edges", "diagnostics")
#: Columns that came with a version: older snapshots are read with nulls in their place.
ADDED = {2: {"fact_parsed": {"doc": "string", "doc_source": "string", "hash": "string", "meaning": "string"}, "files": {"parser_version": "string"}}}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    """What the pointer says: the current snapshot and the schema version that wrote it."""
    path, fs = _fs(spark, f"{folder}/CURRENT")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{folder}/CURRENT", wholetext=True).first().value)


def exists(spark: SparkSession, folder: str) -> bool:
    return _pointer(spark, folder) is not None


def _swap(spark: SparkSession, folder: str, state: dict) -> None:
    """Point to a snapshot that is whole: the pointer is written aside and moved, so readers see the old one or the new one."""
    aside, fs = _fs(spark, f"{folder}/CURRENT.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    target, _ = _fs(spark, f"{folder}/CURRENT")
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, over)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current snapshot, with the columns that later versions added."""
    at = _pointer(spark, folder)
    if at is None:
        raise FileNotFoundError(f"{folder} holds no index")
    if at["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"{folder} was written by schema version {at['schema_version']}, this is {SCHEMA_VERSION}")
    df = spark.read.parquet(f"{folder}/{at.get('tables', {}).get(name, at['snapshot'])}/{name}")
    for version in range(at["schema_version"] + 1, SCHEMA_VERSION + 1):
        for column, kind in ADDED.get(version, {}).get(name, {}).items():
            if column not in df.columns:
                df = df.withColumn(column, F.lit(None).cast(kind))
    return df


def load(spark: SparkSession, folder: str) -> Index:
    return Index(read_table(spark, folder, "files"), *[read_table(spark, folder, r) for r in RELATIONS])


FEATURES = "feature_id string, name string, description string, definition_hash string, invariants array<string>, status string, needs_review boolean, stale_reason string, generated_hash string, reviewed_at string"
STEPS = "feature_id string, step_order int, action string, symbol_id string, file_path string, observed_hash string"
REVIEWS = "feature_id string, reviewed_at string, generated_hash string, note string"


def features_of(spark: SparkSession, folder: str) -> DataFrame:
    """Stored features with their steps gathered, as a question reads them."""
    steps = read_table(spark, folder, "feature_steps").groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("step_order", "action", "symbol_id", "file_path"))).alias("steps"))
    shown = F.transform(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), lambda s: F.struct(s["action"].alias("action"), s["symbol_id"].alias("symbol_id"), s["file_path"].alias("file_path")))
    met = read_table(spark, folder, "features").join(steps, "feature_id", "left")
    return met.select("feature_id", "name", "description", "status", "needs_review", "invariants", shown.alias("steps"))


def _refresh_features(spark: SparkSession, folder: str, stored: bool, defined: DataFrame | None, index: Index, events: DataFrame) -> dict[str, DataFrame]:
    """The features' tables after a refresh: definitions read, marked by what changed, and set by how their symbols stand now."""
    old = {n: read_table(spark, folder, n) if stored else spark.createDataFrame([], kind) for n, kind in (("features", FEATURES), ("feature_steps", STEPS), ("feature_reviews", REVIEWS))}
    features, steps = old["features"], old["feature_steps"]
    if defined is not None:
        features, steps = freshness.sync_features(features, steps, defined)
    features, steps = cut(features), cut(steps)
    changed = events.filter("kind = 'symbol_changed'").select("symbol_id")
    files = events.filter("kind = 'file_reindexed'").select(F.col("file_path").alias("path")) if stored else events.limit(0).select(F.col("file_path").alias("path"))
    marked = cut(freshness.mark_features(features, steps, changed, files))
    symbols = index.symbols.select("symbol_id", "implementation_hash", F.col("path").alias("file_path"))
    states = freshness.feature_status(marked, steps, symbols).drop("steps")
    now = marked.drop("status", "needs_review", "stale_reason", "generated_hash").join(states, "feature_id")
    return {"features": now.select(old["features"].columns), "feature_steps": freshness.observe(steps, symbols).select(old["feature_steps"].columns), "feature_reviews": old["feature_reviews"]}


def review_feature(spark: SparkSession, folder: str, feature_id: str, note: str | None = None) -> dict:
    """Mark a stored feature as reviewed and note it; the two tables take the place of the former ones, all others stay."""
    at, now = _pointer(spark, folder), datetime.now(UTC).isoformat()
    features, reviews = freshness.review(read_table(spark, folder, "features"), read_table(spark, folder, "feature_reviews"), feature_id, now, note)
    features = features.withColumn("reviewed_at", F.when(F.col("feature_id") == feature_id, now).otherwise(F.col("reviewed_at")))
    name = f"review-{uuid.uuid4().hex}"
    for table, df in (("features", features), ("feature_reviews", reviews)):
        df.write.parquet(f"{folder}/{name}/{table}")
    _swap(spark, folder, at | {"tables": at.get("tables", {}) | {"features": name, "feature_reviews": name}})
    return {"feature_id": feature_id, "reviewed_at": now, "status": "valid"}


def _meta(rows: dict, old: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Keys and values, the last of each key."""
    new = spark.createDataFrame([(k, v, 1) for k, v in rows.items()], "key string, value string, age int")
    both = new if old is None else new.unionByName(old.withColumn("age", F.lit(0)))
    return both.groupBy("key").agg(F.max_by("value", "age").alias("value"))


def _events(old: DataFrame, new: DataFrame, changed: DataFrame, at: str) -> DataFrame:
    """What a refresh changed: symbols that came, went or differ, and files that were analyzed again."""
    symbols = freshness.symbol_events(*[d.select("symbol_id", F.col("semantic_hash").alias("hash")) for d in (old, new)])
    path = F.regexp_extract("symbol_id", r"^[^:]*:(.*?)::", 1)
    rows = symbols.select("kind", path.alias("file_path"), "symbol_id", "old_hash", "new_hash")
    none = F.lit(None).cast("string")
    files = changed.select(F.lit("file_reindexed").alias("kind"), F.col("path").alias("file_path"), none.alias("symbol_id"), none.alias("old_hash"), none.alias("new_hash"))
    return rows.unionByName(files).withColumn("indexed_at", F.lit(at))


def refresh(spark: SparkSession, tree: DataFrame, folder: str, *, force: bool = False, meta: dict | None = None, features: DataFrame | None = None) -> dict:
    """Bring the stored index up to date with tree (path, text; null text: what can't be read keeps its facts) and say what was done.

    Files whose content or analyzer changed are analyzed, and those that depend on them (freshness.pending). The facts of
    all others, and of files whose analysis failed, are taken over from the last snapshot; relations, which
    any file may touch, are computed from all facts. features are definitions (sources.corpus.feature_definitions); without them the stored ones
    stay and are held against the symbols as they are now. Everything is written to a new snapshot before the pointer moves to it.
    """
    unread = cut(tree.filter("text is null").select("path").distinct())
    now = datetime.now(UTC).isoformat()
    files = cut(read_files(tree))
    stored = exists(spark, folder)
    kept_facts: dict[str, DataFrame] = {}
    if stored:
        old_files = read_table(spark, folder, "files")
        files = cut(files.unionByName(old_files.join(unread, "path", "left_semi").select(files.columns)))
        states = cut(freshness.compare(old_files, files))
        imports = read_table(spark, folder, "dependencies").filter("relation = 'imports' and to_file is not null").select("from_file", "to_file")
        languages = files.select("path", "language").unionByName(old_files.join(files, "path", "left_anti").select("path", "language"))
        todo = cut(freshness.pending(states, languages, imports, force).join(files.select("path"), "path", "left_semi"))
        removed = states.filter("state = 'removed'").select("path")
        kept_facts = {name: read_table(spark, folder, f"fact_{name}") for name in FACTS}
    else:
        todo, removed = cut(files.select("path")), None
    some = files.join(todo, "path", "left_semi")
    new = extract(some)
    parsed = cut(new.parsed)
    failed = cut(parsed.filter("fact = 'failed'").select("path").distinct())
    done = cut(todo.join(failed, "path", "left_anti"))
    tables = {}
    for name in FACTS:
        fresh = parsed if name == "parsed" else getattr(new, name)
        if stored:
            gone = done.unionByName(removed)
            kept = kept_facts[name]
            if name == "parsed":  # an old failure goes with the new attempt
                kept = kept.join(todo.withColumn("fact", F.lit("failed")), ["path", "fact"], "left_anti")
            good = fresh.join(failed, "path", "left_anti") if name != "parsed" else fresh.filter("fact = 'failed'").unionByName(fresh.join(failed, "path", "left_anti"))
            fresh = freshness.replace_facts(kept, good.select(kept.columns), gone, "path")
        tables[name] = cut(fresh)
    index = relate(files, Facts(*[tables[n] for n in FACTS]))
    name = f"snapshot-{uuid.uuid4().hex}"
    write = lambda df, t: df.write.parquet(f"{folder}/{name}/{t}")
    write(files, "files")
    for n in FACTS:
        write(tables[n], f"fact_{n}")
    for r in RELATIONS:
        write(getattr(index, r), r)
    events = _events(read_table(spark, folder, "symbols"), index.symbols, done, now) if stored else _events(index.symbols.limit(0), index.symbols, done, now)
    events = cut(events)
    for t, df in _refresh_features(spark, folder, stored, features, index, events).items():
        write(df, t)
    write(read_table(spark, folder, "change_events").unionByName(events) if stored else events, "change_events")
    write(_meta({"schema_version": str(SCHEMA_VERSION), "last_indexed_at": now} | (meta or {}), read_table(spark, folder, "meta") if stored else None, spark), "meta")
    _swap(spark, folder, {"snapshot": name, "schema_version": SCHEMA_VERSION})
    return {"files": files.count(), "analyzed": done.count(), "failed": failed.count(), "removed": removed.count() if stored else 0, "unreadable": unread.count()}


def status(spark: SparkSession, tree: DataFrame, folder: str) -> dict:
    """How the tree differs from the stored index: files by state, the first paths of each, counts of tables, and whether it is stale."""
    if not exists(spark, folder):
        return {"indexed": False, "stale": True}
    unread = tree.filter("text is null").select("path").distinct()
    states = cut(freshness.compare(read_table(spark, folder, "files").join(unread, "path", "left_anti"), read_files(tree)))
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    samples = freshness.samples(states).groupBy("state").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    states_ = ("added", "removed", "changed", "parser_changed")
    return {
        "indexed": True,
        "stale": any(counts.get(s) for s in states_) or not unread.isEmpty(),
        **{s: counts.get(s, 0) for s in states_},
        "unreadable": unread.count(),
        "samples": {r.state: r.paths for r in samples.collect()},
        "tables": {t: read_table(spark, folder, t).count() for t in ("files", *RELATIONS)},
        "features": {r.status: r.n for r in freshness.status_counts(read_table(spark, folder, "features")).collect()},
        "meta": {r.key: r.value for r in read_table(spark, folder, "meta").collect()},
    }
