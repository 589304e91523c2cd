"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize, numbered, tasks_for, text_or_empty

def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good, by the law itself at every size.

    The library's sampler takes populations below a billion. Beyond, the law is inverted: its terms about the mode, out to
    13 standard deviations (what lies outside is below the precision of a double), are summed from their ratios.
    """
    if not draws:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n, p = good + bad, good / (good + bad)
    sd = (draws * p * (1 - p) * (n - draws) / (n - 1)) ** 0.5
    mode = (draws + 1) * (good + 1) // (n + 2)
    reach = int(13 * sd) + 20
    low, high = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log_p = np.r_[0.0, np.cumsum(steps)]
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows by shards: how many rows of each partition go to each shard of a uniform shuffle.

    Row sums are the partitions' sizes, column sums differ by one at most; the law is multivariate hypergeometric.
    """
    rng, total = np.random.default_rng(seed), sum(rows)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in rows:
        rest, line = sum(left), []
        for j in range(shards):
            x = hypergeometric(rng, left[j], rest - left[j], n) if j < shards - 1 else n
            rest -= left[j]
            n -= x
            left[j] -= x
            line.append(x)
        out.append(line)
    return out


def _dealt(base: DataFrame, shards: int, seed: int, rows_per_part: int, max_parts: int) -> DataFrame:
    """base (g: a hash of the row, part: of the partition that wrote it, and more) with shard and slot."""
    base = materialize(base, "shardrows")
    n = base.count()
    parts = max(1, min(max(max_parts, -(-n // 2_000_000)), -(-n // rows_per_part)))
    keyed = numbered(base, ["g"], "part").withColumn("h1", F.xxhash64(F.lit(seed), "g", "nth"))
    keyed = materialize(keyed.withColumn("to", F.pmod(F.col("h1"), F.lit(parts)).cast("int")), "shardplaces")
    counts = dict(keyed.groupBy("to").count().collect())  # one number a part
    matrix = communication_matrix([counts.get(i, 0) for i in range(parts)], shards, seed)
    plan = json.dumps([{"to": i, "upto": np.cumsum(line).tolist()} for i, line in enumerate(matrix)])
    plan = base.sparkSession.range(1).select(F.inline(F.from_json(F.lit(plan), "array<struct<to:int,upto:array<bigint>>>")))

    local = keyed.withColumn("k", F.row_number().over(Window.partitionBy("to").orderBy("h1", "g", "nth")))
    dealt = local.join(F.broadcast(plan), "to")  # `shards` counts a part
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda c: c < F.col("k"))).cast("int"))
    dealt = dealt.withColumn("h2", F.xxhash64(F.lit(seed + 1), "h1", "g", "nth")).drop("upto", "k", "to", "h1")
    dealt = materialize(dealt.withColumn("sub", F.pmod(F.col("h2"), F.lit(max(1, parts // shards))).cast("int")), "dealt")
    # the second permutation: hash order within the shard, counted by sub-ranges of it
    sums = dealt.groupBy("shard", "sub").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("shard", "sub", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("h2", "g", "nth"))
    out = dealt.withColumn("k", within).join(F.broadcast(starts), ["shard", "sub"])  # about as many rows as parts
    return out.withColumn("slot", (F.col("first") + F.col("k") - 1).cast("long"))


DEFAULTS = {"shards": 24, "seed": 10, "rows_per_part": 4096, "max_parts": 2048}


def shuffle_into_shards(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard and gapless slot of every row of docs.

    The planning side is one count per part (max_parts of them, or one for two million rows) and the matrix. Rows
    are dealt to parts by a hash of doc_id, text and the number of the repeat, so neither copies
    nor repeated rows gather, and the result is the same whatever the partitioning; every window is over one hash part. Null
    text has size 8 and crc32 0, null ids are rows like others, an empty table gives an empty one, other
    columns are ignored.
    """
    t = text_or_empty()
    base = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("g"), F.spark_partition_id().alias("part"))
    out = _dealt(base, **(DEFAULTS | options))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write docs with all their columns, one folder a shard (shard=k, or with underscores in front if docs has such a column), in slot order.

    Rows need no key: each is written once in between, with a number of its own by which its place finds it.
    """
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("id"))
    rows = materialize(row, "numberedrows")
    base = rows.select("id", F.xxhash64(F.to_json("row")).alias("g"), F.spark_partition_id().alias("part"))
    o = DEFAULTS | options
    at = rows.join(_dealt(base, **o).select("id", F.col("shard").alias("_s"), F.col("slot").alias("_k")), "id")
    share = max(1, -(-tasks_for(docs) // o["shards"]))
    size = -(-rows.count() // (o["shards"] * share)) or 1
    at = at.withColumn("_p", (F.col("_s") * share + F.least(F.floor(F.col("_k") / size), F.lit(share - 1))).cast("int"))
    at = at.repartitionById(o["shards"] * share, "_p").sortWithinPartitions("_s", "_k")
    at.select(F.col("_s").alias(name), "row.*").write.partitionBy(name).parquet(path)
