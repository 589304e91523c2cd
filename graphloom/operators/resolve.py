"""Resolution joins: a reference resolves only if exactly one candidate fits, else to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import route_shape


def with_files(rows: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """rows with the language of their file and whether it is a test; null where the file is not known."""
    return rows.join(files.select(F.col("path").alias(path), F.col("language").alias("file_language"), "is_test"), path, "left")


def unique_match(refs: DataFrame, ref_key: str, candidates: DataFrame, on: list[str], target: str) -> DataFrame:
    """ref_key, resolved, candidates: the only candidate of each reference, null if there are none or several.

    Candidates are counted by key before the join (partial sums first), so a key that a third of all
    candidates share is one row when it meets the references.
    """
    once = candidates.groupBy(*on).agg(F.count("*").alias("candidates"), F.min(target).alias("_target"))
    met = refs.join(once, on, "left")
    return met.select(ref_key, F.when(F.col("candidates") == 1, F.col("_target")).alias("resolved"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def first_unique(refs: DataFrame, ref_key: str, steps: list[tuple[str, DataFrame, list[str]]], target: str, missing: str, several: str) -> DataFrame:
    """ref_key, resolved, resolution: the first step whose key has one candidate; several candidates in a step end the search."""
    out = refs
    for i, (_, candidates, on) in enumerate(steps):
        once = candidates.groupBy(*on).agg(F.count("*").alias(f"_n{i}"), F.min(target).alias(f"_t{i}"))
        out = out.join(once, on, "left")
    hit, label = F.lit(None).cast("string"), F.lit(missing)
    for i, (name, _, _) in reversed(list(enumerate(steps))):
        hit = F.when(F.col(f"_n{i}") == 1, F.col(f"_t{i}")).when(F.col(f"_n{i}") > 1, F.lit(None)).otherwise(hit)
        label = F.when(F.col(f"_n{i}") == 1, name).when(F.col(f"_n{i}") > 1, several).otherwise(label)
    return out.select(ref_key, hit.alias("resolved"), label.alias("resolution"))


BLOCK = 64  # lines


def nearest_symbol(facts: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """facts (keys, file_path, line) with the first symbol whose lines hold the line, else the last that starts at it or before.

    The join is by file and block of BLOCK lines. Of symbols that look alike from within a block (by their lines cut to it) one stays, so a
    block's row is bounded, however many symbols a file has; what starts before a block is carried on over blocks.
    """
    block, lines = lambda c: F.floor(F.col(c) / BLOCK).cast("int"), ["file_path", "line_start", "line_end"]
    once = symbols.groupBy(*lines).agg(F.min("symbol_id").alias("lo"), F.max("symbol_id").alias("hi"))
    over = once.filter("line_end >= line_start").withColumn("block", F.explode(F.sequence(block("line_start"), block("line_end"))))
    over = over.withColumn("a", F.greatest("line_start", F.col("block") * BLOCK)).withColumn("b", F.least("line_end", F.col("block") * BLOCK + BLOCK - 1))
    over = over.groupBy("file_path", "block", "a", "b").agg(F.min(F.struct("line_start", "lo")).alias("first"))
    over = over.groupBy("file_path", "block").agg(F.collect_list(F.struct("a", "b", "first")).alias("over"))
    starts = once.groupBy("file_path", "line_start").agg(F.max("hi").alias("hi")).withColumn("block", block("line_start"))
    starts = starts.groupBy("file_path", "block").agg(F.collect_list(F.struct("line_start", "hi")).alias("starts"), F.max(F.struct("line_start", "hi")).alias("last"))
    placed = facts.withColumn("block", block("line"))
    blocks = placed.select("file_path", "block").distinct().join(starts, ["file_path", "block"], "full")
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK lines
    blocks = blocks.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    met = placed.join(blocks, ["file_path", "block"], "left").join(over, ["file_path", "block"], "left")
    holds = F.array_min(F.transform(F.filter("over", lambda s: (s["a"] <= F.col("line")) & (s["b"] >= F.col("line"))), lambda s: s["first"]))["lo"]
    before = F.array_max(F.filter("starts", lambda s: s["line_start"] <= F.col("line")))["hi"]
    return met.select(*keys, "file_path", "line", F.coalesce(holds, before, F.col("carried.hi")).alias("symbol_id"))


def longest_prefix(paths: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """paths with their nearest folder that is listed: ancestors are exploded, met by equality, the longest wins."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = paths.select(path, F.explode(ups).alias(folder))
    met = up.join(folders.select(folder).distinct(), folder)
    best = met.groupBy(path).agg(F.max_by(folder, F.length(folder)).alias(folder))
    return paths.join(best, path, "left")


def match_routes(client: DataFrame, server: DataFrame) -> DataFrame:
    """client (id, method, route_path) to server (route_id, method, route_path): exact path, then shape, then shape for ANY."""
    shaped = server.withColumn("shape", route_shape(F.col("route_path")))
    one = lambda keys: shaped.groupBy(*keys).agg(F.count("*").alias("n"), F.min("route_id").alias("t"))
    c = client.withColumn("shape", route_shape(F.col("route_path")))
    exact = one(["method", "route_path"]).select("method", "route_path", F.col("n").alias("n1"), F.col("t").alias("t1"))
    shape = one(["method", "shape"]).select("method", "shape", F.col("n").alias("n2"), F.col("t").alias("t2"))
    free = one(["shape"]).select("shape", F.col("n").alias("n3"), F.col("t").alias("t3"))
    met = c.join(exact, ["method", "route_path"], "left").join(shape, ["method", "shape"], "left").join(free, "shape", "left")
    known = F.col("method") != "ANY"
    hit = F.when(known & (F.col("n1") == 1), F.col("t1")).when(known & (F.col("n2") == 1), F.col("t2")).when(~known & (F.col("n3") == 1), F.col("t3"))
    label = (
        F.when(known & (F.col("n1") == 1), "method_exact_path")
        .when(known & (F.col("n2") == 1), "method_path_shape")
        .when(~known & (F.col("n3") == 1), "unique_path_shape_method_unknown")
        .when(known & (F.col("n2") > 1), "route_not_unique")
        .when(~known & (F.col("n3") > 1), "method_unresolved_route_not_unique")
        .otherwise("route_not_found")
    )
    return met.select("id", hit.alias("route_id"), label.alias("resolution"))


def implementers(needs: DataFrame, has: DataFrame) -> DataFrame:
    """Relational division: needs (iface, shape) to has (owner, shape): owners that have every shape of an interface.

    Resolved only if there is one owner. Interfaces that need the same shapes are one, and so are owners that have the same: what meets are
    different sets of shapes, by the shape of the interface that the fewest sets of owners have; the others are looked up in the set.
    """
    sets = lambda df, key: df.groupBy(key).agg(F.sort_array(F.collect_set("shape")).alias("set"))
    wanted = sets(needs, "iface")
    owned = sets(has, "owner").groupBy("set").agg(F.count("*").alias("owners"), F.min("owner").alias("owner"))
    have = owned.select(F.explode("set").alias("shape"), F.col("set").alias("have"), "owners", "owner")
    common = have.groupBy("shape").agg(F.count("*").alias("n"))
    kinds = wanted.select("set").distinct()
    rarest = kinds.select("set", F.explode("set").alias("shape")).join(common, "shape", "left")
    rarest = rarest.groupBy("set").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shape")).alias("r")).select("set", "r.shape")
    full = rarest.join(have, "shape").filter(F.size(F.array_except("set", "have")) == 0)
    full = full.groupBy("set").agg(F.sum("owners").alias("owners"), F.min("owner").alias("owner"))
    out = wanted.join(full, "set", "left")
    return out.select("iface", F.coalesce("owners", F.lit(0)).cast("long").alias("owners"), F.when(F.col("owners") == 1, F.col("owner")).alias("owner"))
