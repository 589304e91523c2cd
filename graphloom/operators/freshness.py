"""Differences of snapshots, what they make pending, and feature states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCRIPT = ("typescript", "javascript")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state of snapshots (path, content_hash, parser_version): added, removed, changed, parser_changed or fresh."""
    o = old.select("path", F.col("content_hash").alias("oh"), F.col("parser_version").alias("ov"), F.lit(True).alias("o"))
    n = new.select("path", F.col("content_hash").alias("nh"), F.col("parser_version").alias("nv"), F.lit(True).alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("oh").eqNullSafe(F.col("nh")), "changed").when(~F.col("ov").eqNullSafe(F.col("nv")), "parser_changed").otherwise("fresh")
    return o.join(n, "path", "full").select("path", state.alias("state"))


def samples(states: DataFrame, k: int = 8) -> DataFrame:
    """At most k paths of each reason to be stale, the first by path."""
    ranked = states.filter("state <> 'fresh'").withColumn("rn", F.row_number().over(Window.partitionBy("state").orderBy(F.collate("path", "UNICODE"), "path")))
    return ranked.filter(F.col("rn") <= k).select("state", "path")


def pending(states: DataFrame, languages: DataFrame, imports: DataFrame, force: bool = False) -> DataFrame:
    """path of every file to analyze again: stale ones, and what depends on them.

    A changed go.mod or go.work makes all Go files pending; a ts/jsconfig or a new or removed
    script all script files; else the script files that import a changed one, at any distance. A new or
    removed script makes all Vue files pending. languages: path, language; imports: from_file, to_file.
    """
    from ..functions.paths import basename, is_config
    from .traverse import closure

    if force:
        return languages.select("path")
    stale = states.filter("state in ('added', 'removed', 'changed', 'parser_changed')").join(languages, "path", "left")
    base = basename(F.col("path"))
    script = F.col("language").isin(*SCRIPT)
    moved = script & F.col("state").isin("added", "removed")
    flags = stale.agg(
        F.coalesce(F.bool_or(base.isin("go.mod", "go.work", "go.sum")), F.lit(False)).alias("go"),
        F.coalesce(F.bool_or(is_config(F.col("path")) | moved), F.lit(False)).alias("script"),
        F.coalesce(F.bool_or(moved), F.lit(False)).alias("vue"),
    )
    wide = languages.join(F.broadcast(flags), F.lit(True))  # one row of flags
    wide = wide.filter((F.col("go") & (F.col("language") == "go")) | (F.col("script") & script) | (F.col("vue") & (F.col("language") == "vue"))).select("path")
    changed = stale.filter("state <> 'removed'").select("path")
    back = closure(imports.select(F.col("to_file").alias("src"), F.col("from_file").alias("dst")), stale.filter(script).select(F.col("path").alias("node")))
    return changed.unionByName(wide).unionByName(back.select(F.col("node").alias("path"))).distinct().join(languages.select("path"), "path", "left_semi")


def replace_facts(old: DataFrame, new: DataFrame, gone: DataFrame, path: str = "file_path") -> DataFrame:
    """The next snapshot of a fact table: facts of files in `gone` (changed and removed) go, new ones come."""
    return old.join(gone.select(F.col("path").alias(path)).distinct(), path, "left_anti").unionByName(new)


def symbol_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol_id, kind, old_hash, new_hash of symbols (symbol_id, hash) that came, went or changed."""
    met = old.withColumnRenamed("hash", "old_hash").join(new.withColumnRenamed("hash", "new_hash"), "symbol_id", "full").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "symbol_added").when(F.col("new_hash").isNull(), "symbol_removed").otherwise("symbol_changed")
    return met.select("symbol_id", kind.alias("kind"), "old_hash", "new_hash")


def feature_status(features: DataFrame, steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """features with status, needs_review, stale_reason and generated_hash as their steps' symbols stand now.

    features: feature_id, definition_hash, needs_review, stale_reason. steps: feature_id, step_order, symbol_id, file_path, observed_hash.
    symbols: symbol_id, implementation_hash. A step whose symbol is gone makes its feature stale, one whose symbol differs from what was
    observed needs review; what needs review does so until it is reviewed. One row of a step's state is gathered a feature.
    """
    met = steps.join(symbols.select("symbol_id", "implementation_hash"), "symbol_id", "left")
    named, known = F.col("symbol_id").isNotNull(), F.col("implementation_hash").isNotNull()
    gone = F.coalesce(F.bool_or(named & ~known), F.lit(False))
    changed = F.coalesce(F.bool_or(named & known & F.col("observed_hash").isNotNull() & (F.col("observed_hash") != F.col("implementation_hash"))), F.lit(False))
    row = F.struct("step_order", "symbol_id", "file_path", "implementation_hash")
    per = met.groupBy("feature_id").agg(gone.alias("_gone"), changed.alias("_changed"), F.sort_array(F.collect_list(row)).alias("_rows"), F.count("*").alias("steps"))
    out = features.join(per, "feature_id", "left")
    gone, changed = F.coalesce("_gone", F.lit(False)), F.coalesce("_changed", F.lit(False))
    review = gone | changed | F.col("needs_review")
    return out.select(
        "feature_id",
        F.when(gone, "stale").when(review, "needs_review").otherwise("valid").alias("status"),
        review.alias("needs_review"),
        F.when(gone, "unresolved_feature_symbol").when(changed, "referenced_symbol_changed").otherwise(F.col("stale_reason")).alias("stale_reason"),
        F.sha2(F.to_json(F.struct("definition_hash", F.col("_rows").alias("steps")), {"ignoreNullFields": "false"}), 256).alias("generated_hash"),
        F.coalesce("steps", F.lit(0)).cast("long").alias("steps"),
    )


def observe(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """steps with what their symbols are now, for the next comparison; a symbol that is gone leaves what was observed."""
    now = symbols.select("symbol_id", F.col("implementation_hash").alias("_h"), F.col("file_path").alias("_f"))
    met = steps.join(now, "symbol_id", "left")
    return met.withColumn("observed_hash", F.coalesce("_h", "observed_hash")).withColumn("file_path", F.coalesce("_f", "file_path")).drop("_h", "_f")


def mark_features(features: DataFrame, steps: DataFrame, symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """features of which a step names one of the symbols (symbol_id), or without a symbol one of the files (path), set to be reviewed."""
    by_symbol = steps.join(symbols.select("symbol_id"), "symbol_id", "left_semi").select("feature_id", F.lit("referenced_symbol_changed").alias("why"))
    by_file = steps.filter("symbol_id is null").join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("feature_id", F.lit("referenced_file_changed").alias("why"))
    why = by_symbol.unionByName(by_file).groupBy("feature_id").agg(F.max("why").alias("why"))
    met, hit = features.join(why, "feature_id", "left"), F.col("why").isNotNull()
    return met.withColumn("status", F.when(hit, "needs_review").otherwise(F.col("status"))).withColumn("needs_review", hit | F.col("needs_review")).withColumn("stale_reason", F.coalesce("why", "stale_reason")).drop("why")


FEATURE_KEEPS = ("status", "needs_review", "stale_reason", "generated_hash", "reviewed_at")


def sync_features(stored: DataFrame, stored_steps: DataFrame, defined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and their steps after a read of their definitions: what is new or defined otherwise starts valid, with steps not observed yet; missing ones go.

    stored: feature_id, definition_hash and FEATURE_KEEPS. defined: feature_id, name, description, definition_hash, invariants, steps (array of order,
    action, symbol_id, file_path). Steps without an order are numbered as they stand.
    """
    old = stored.select("feature_id", F.col("definition_hash").alias("_h"), *[F.col(c).alias(f"_{c}") for c in FEATURE_KEEPS])
    met = defined.join(old, "feature_id", "left").withColumn("_same", F.coalesce(F.col("_h") == F.col("definition_hash"), F.lit(False)))
    fresh = {"status": F.lit("valid"), "needs_review": F.lit(False)}
    kept = [F.when(F.col("_same"), F.col(f"_{c}")).otherwise(fresh[c]).alias(c) if c in fresh else F.when(F.col("_same"), F.col(f"_{c}")).alias(c) for c in FEATURE_KEEPS]
    features = met.select("feature_id", "name", "description", "definition_hash", "invariants", *kept)
    new = met.filter("not _same").select("feature_id", F.posexplode("steps").alias("n", "s"))
    new = new.select("feature_id", F.coalesce("s.order", F.col("n") + 1).alias("step_order"), F.coalesce("s.action", F.lit("")).alias("action"), "s.symbol_id", "s.file_path", F.lit(None).cast("string").alias("observed_hash"))
    same = stored_steps.join(met.filter("_same").select("feature_id"), "feature_id", "left_semi")
    return features, same.select(new.columns).unionByName(new)


def review(features: DataFrame, reviews: DataFrame, feature_id: str, at: str, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """features with one of them reviewed, and reviews with a row of it; one that is stale or unknown can't be."""
    row = features.filter(F.col("feature_id") == feature_id).select("status", "generated_hash").first()
    if row is None or row.status == "stale":
        raise ValueError(f"{feature_id} is stale or unknown")
    mine = F.col("feature_id") == feature_id
    out = features.withColumn("status", F.when(mine, "valid").otherwise(F.col("status"))).withColumn("needs_review", ~mine & F.col("needs_review")).withColumn("stale_reason", F.when(~mine, F.col("stale_reason")))
    one = features.sparkSession.createDataFrame([(feature_id, at, row.generated_hash or "", note)], "feature_id string, reviewed_at string, generated_hash string, note string")
    return out, reviews.unionByName(one)


def status_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("status").agg(F.count("*").alias("n"))
