"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where the session names none, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application's operators wrote in between; results that were not stored elsewhere go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(df: DataFrame, each: int = 134_217_728) -> int:
    """Tasks for a shuffle of df: one for `each` bytes of its estimated size, at least spark.sql.shuffle.partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // each), 1_000_000)) if size < 2**60 else least  # beyond: no estimate


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """df (as written by materialize) to be broadcast if it has at most `most` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """rows with `nth`, 0 on among rows with equal keys; part: the number of the partition that wrote the row.

    Rows with equal keys are ranked within their part, and parts by what stands in those before: however
    many rows are equal, no task gets more of them than a part holds.
    """
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(part))
    per = rows.groupBy(*keys, part).agg(F.count("*").alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_before", earlier).filter("_before is not null").drop("_c")
    met = rows.withColumn("_local", local).join(per, [*keys, part], "left")
    return met.withColumn("nth", F.col("_local") - 1 + F.coalesce("_before", F.lit(0))).drop("_local", "_before")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where lambdas inside body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE), "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are in chars (the body of a character class)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
