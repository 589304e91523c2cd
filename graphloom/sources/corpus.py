"""Sources: git working trees, parquet and file corpora, feature definitions, aliases, JSON lines."""

from __future__ import annotations

import glob
import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_likely_source
from ..functions.text import stable_hash

MAX_BYTES = 4_194_304


def git_files(repo: str) -> list[str]:
    """Tracked and untracked, not ignored paths of a working tree."""
    out = subprocess.run(["git", "-C", repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True, timeout=60).stdout
    return sorted({p.replace("\\", "/") for p in out.decode("utf-8", "replace").split("\0") if p})


def git_head(repo: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, timeout=60, check=False)
    return done.stdout.decode().strip() or None if done.returncode == 0 else None


def working_tree(spark: SparkSession, repo: str) -> DataFrame:
    """path and text of a tree's sources; text is null for what can't be read: links, large files, NUL bytes."""
    root = os.path.realpath(repo)
    listed = spark.createDataFrame([(p,) for p in git_files(repo) if not os.path.islink(os.path.join(root, p)) and os.path.isfile(os.path.join(root, p))], "path string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    return listed.join(_texts(read, f"file:{root}/"), "path", "left").filter(is_likely_source(F.col("path")))


def _texts(read: DataFrame, prefix: str) -> DataFrame:
    shown = F.decode("content", "UTF-8")
    rel = F.substr(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(prefix) + 1))
    fit = (F.col("length") <= MAX_BYTES) & (F.instr(shown, "\0") == 0)
    return read.select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), F.when(fit, shown).alias("text"))


def unreadable(manifest: DataFrame) -> DataFrame:
    """A diagnostic for each path without text; what was known of it stays."""
    return manifest.filter("text is null").select("path", F.lit("unreadable").alias("message"))


FEATURE = "id string, name string, description string, steps array<struct<order:int,action:string,symbol_id:string,file_path:string>>, invariants array<string>"


def feature_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions of a folder's JSON files with a hash of their content; without id, name or description none, without the folder neither."""
    if not glob.glob(f"{folder.removeprefix('file://')}/*.json"):
        raw = spark.createDataFrame([], "value string")
    else:
        raw = spark.read.text(f"{folder}/*.json", wholetext=True)
    got = raw.select(F.from_json("value", FEATURE).alias("f")).select("f.*").filter("id is not null and name is not null and description is not null")
    got = got.withColumn("steps", F.coalesce("steps", F.from_json(F.lit("[]"), "array<struct<order:int,action:string,symbol_id:string,file_path:string>>"))).withColumn("invariants", F.coalesce("invariants", F.array().cast("array<string>")))
    return got.withColumn("definition_hash", stable_hash(*[(c, F.col(c)) for c in ("id", "name", "description", "steps", "invariants")])).withColumnRenamed("id", "feature_id")


def project_aliases(path: str) -> dict:
    """A project's own aliases (an object), {} if there is no such file."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: aliases are an object")
    return found


def public_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a written public index; an error if its check finds problems."""
    from .export import check_public

    if problems := [f"{r.part}: {r.problem} ({r.n})" for r in check_public(spark, folder).collect()]:
        raise ValueError("; ".join(problems))
    nodes = spark.read.schema("id string, kind string, attributes map<string,string>").json(f"{folder}/nodes")
    edges = spark.read.schema("id string, type string, from string, to string, confidence string").json(f"{folder}/edges")
    return nodes, edges


def changed_files(repo: str) -> list[str]:
    """Paths that differ from the last commit, new ones too; of a move the new path."""
    out = subprocess.run(["git", "-C", repo, "status", "--porcelain", "-z", "--untracked-files=all"], capture_output=True, check=True, timeout=60).stdout
    fields, found = iter(out.decode("utf-8", "replace").split("\0")), set()
    for f in fields:
        if len(f) > 3:
            found.add(f[3:].replace("\\", "/"))
            if f[0] in "RC":
                next(fields, None)  # where it came from
    return sorted(found)


def git_root(repo: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, "rev-parse", "--show-toplevel"], capture_output=True, timeout=60, check=False)
    return done.stdout.decode().strip() or None if done.returncode == 0 else None


def allowed_path(path: str, roots: list[str]) -> str:
    """The real path, if it lies in one of the roots."""
    real = os.path.realpath(path)
    if not any(real == r or real.startswith(r.rstrip(os.sep) + os.sep) for r in map(os.path.realpath, roots)):
        raise ValueError(f"{path} lies outside of {', '.join(roots)}")
    return real
