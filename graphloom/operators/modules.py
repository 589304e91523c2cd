"""Where imports lead: relative modules, path aliases of compiler settings, and packages of Go modules, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.facts import strip_comments
from ..functions import paths
from .cut import cut
from .resolve import longest_prefix

#: What is tried behind a module's path, in this order.
TAILS = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.vue")
CONFIG = "struct<extends:string,compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"


def normal(path: Column) -> Column:
    """A path without empty steps, '.' and '..'; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    up = lambda a: F.struct(F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))
    down = lambda a, x: F.struct(F.concat(a["p"], F.array(x)).alias("p"), a["ok"].alias("ok"))
    walked = F.aggregate(parts, start, lambda a, x: F.when(x == "..", up(a)).otherwise(down(a, x)))
    return F.when(walked["ok"], F.array_join(walked["p"], "/"))


def join_path(folder: Column, rest: Column) -> Column:
    return normal(F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), rest))


def configs(files: DataFrame, depth: int = 4) -> DataFrame:
    """folder, base, pattern, target, place of the path aliases in files (path, text) of ts/jsconfig.json; base alone where there are none.

    Settings are read without their comments and trailing commas. What a file does not set comes from the file that it
    extends, `depth` files up at most. Of a folder with both kinds tsconfig.json counts.
    """
    bare = F.regexp_replace(strip_comments(F.col("text")), r",(\s*[}\]])", "$1")
    own = files.filter(F.lower(paths.basename(F.col("path"))).isin("tsconfig.json", "jsconfig.json") | paths.is_config(F.col("path")))
    own = own.select("path", F.from_json(bare, CONFIG).alias("c")).filter("c is not null")
    folder = paths.dirname(F.col("path"))
    up = F.col("c.extends")
    up = F.when(up.startswith("."), join_path(folder, F.when(up.endswith(".json"), up).otherwise(F.concat(up, F.lit(".json")))))
    at = F.when(F.col("c.compilerOptions.baseUrl").isNotNull(), join_path(folder, F.col("c.compilerOptions.baseUrl")))
    rows = own.select("path", up.alias("up"), at.alias("base"), F.when(F.col("c.compilerOptions.paths").isNotNull(), F.struct(folder.alias("folder"), F.col("c.compilerOptions.paths").alias("map"))).alias("paths"))
    rows = cut(rows)
    known = rows.select(F.col("path").alias("up"), F.col("up").alias("_up"), F.col("base").alias("_base"), F.col("paths").alias("_paths"))
    for _ in range(depth):
        rows = cut(rows.join(known, "up", "left").select("path", F.col("_up").alias("up"), F.coalesce("base", "_base").alias("base"), F.coalesce("paths", "_paths").alias("paths")))
    named = rows.filter(F.lower(paths.basename(F.col("path"))).isin("tsconfig.json", "jsconfig.json"))
    per = named.groupBy(paths.dirname(F.col("path")).alias("folder")).agg(F.max_by(F.struct("base", "paths"), paths.basename(F.col("path"))).alias("c"))  # "tsconfig" sorts last
    out = per.select("folder", F.col("c.base").alias("base"), F.coalesce("c.base", "c.paths.folder").alias("root"), F.explode_outer("c.paths.map").alias("pattern", "targets"))
    return out.select("folder", "base", "root", "pattern", F.posexplode_outer("targets").alias("place", "target"))


def alias_tries(wanted: DataFrame, settings: DataFrame) -> DataFrame:
    """(path, ref, rank, base): where the settings next to a file let its modules (not relative ones) lie, the best pattern's targets in turn.

    An exact pattern goes before one with a star, a longer head of a star before a shorter; then the base folder itself.
    """
    far = wanted.filter(~F.col("ref").startswith(".") & ~F.col("ref").startswith("/")).select("path", "ref").distinct()
    near = longest_prefix(far.select("path").distinct(), settings.select("folder").distinct()).filter("folder is not null")
    met = far.join(near, "path").join(settings, "folder")
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    starred = F.col("pattern").contains("*")
    fits = F.when(starred, F.col("ref").startswith(head) & F.col("ref").endswith(tail) & (F.length("ref") >= F.length(head) + F.length(tail))).otherwise(F.col("ref") == F.col("pattern"))
    hit = met.filter(fits).withColumn("weight", F.when(starred, F.length(head)).otherwise(100_000))
    best = hit.groupBy("path", "ref").agg(F.max(F.struct("weight", "pattern")).alias("b"))
    hit = hit.join(best, ["path", "ref"]).filter(F.col("pattern") == F.col("b.pattern"))
    star = F.when(starred, F.substr("ref", F.length(head) + 1, F.length("ref") - F.length(head) - F.length(tail))).otherwise("")
    by_pattern = hit.select("path", "ref", F.col("place").alias("rank"), join_path(F.col("root"), F.replace("target", F.lit("*"), star)).alias("base_path"))
    by_base = met.filter("base is not null").select("path", "ref", F.lit(1000).alias("rank"), join_path(F.col("base"), F.col("ref")).alias("base_path")).distinct()
    return by_pattern.unionByName(by_base).filter("base_path is not null and base_path <> ''")


def resolve_modules(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path, ref) with to_file, the first try that is a file, and how: ts_module_resolution by settings or relative, else tracked_fallback (@/).

    files: path, language, text.
    """
    folder = paths.dirname(F.col("path"))
    src = F.regexp_extract("path", r"^(.*/src/|src/)", 1)
    some = wanted.select("path", "ref").distinct()
    relative = some.filter(F.col("ref").startswith(".")).select("path", "ref", F.lit(2000).alias("rank"), join_path(folder, F.col("ref")).alias("base_path"))
    fallback = some.filter(F.col("ref").startswith("@/") & (src != "")).select("path", "ref", F.lit(3000).alias("rank"), normal(F.concat(src, F.substr("ref", F.lit(3)))).alias("base_path"))
    tries = relative.unionByName(fallback).unionByName(alias_tries(some, cut(configs(files.select("path", "text")))))
    tries = tries.filter("base_path is not null and base_path <> ''").select("path", "ref", "rank", F.posexplode(F.array(*[F.concat("base_path", F.lit(t)) for t in TAILS])).alias("attempt", "to_file"))
    hit = tries.join(files.select(F.col("path").alias("to_file")), "to_file", "left_semi")
    best = hit.groupBy("path", "ref").agg(F.min(F.struct("rank", "attempt", "to_file")).alias("b"))
    best = best.select("path", "ref", F.col("b.to_file").alias("to_file"), F.when(F.col("b.rank") >= 3000, "tracked_fallback").otherwise("ts_module_resolution").alias("resolution"))
    return wanted.join(best, ["path", "ref"], "left")


def go_packages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """import_path, folder of every folder of Go files: the name of its nearest go.mod's module, and the way from there.

    files: path, text; packages: path, name (of the package). Of two folders with one import path neither counts.
    """
    mods = files.filter(paths.basename(F.col("path")) == "go.mod").select(paths.dirname(F.col("path")).alias("folder"), F.regexp_extract("text", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1).alias("module")).filter("module <> ''")
    dirs = packages.filter(~F.col("path").endswith("_test.go") & (F.col("name") != "main")).select(paths.dirname(F.col("path")).alias("dir")).distinct()
    near = longest_prefix(dirs.withColumn("path", F.concat("dir", F.lit("/x"))), mods.select("folder")).filter("folder is not null")
    met = near.join(mods, "folder")
    rest = F.when(F.col("folder") == "", F.col("dir")).otherwise(F.substr("dir", F.length("folder") + 2))
    named = met.select(F.concat(F.col("module"), F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise("")).alias("import_path"), "dir").distinct()
    return named.groupBy("import_path").agg(F.count("*").alias("n"), F.min("dir").alias("folder")).filter("n = 1").drop("n")
