"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree of block quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize, numbered, small, tasks_for, text_or_empty, words_of

#: Ranges of hash values by which a total is followed to the row at which it is reached.
FANOUT = 1024


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """sk, sn, source, n, source_size, target of each source: one row per source goes through each window here.

    Targets are weights times one level, cut at cap times the source's size; the level is
    the one at which they sum to share times all sizes (excess reshared until none is above).
    """
    per = materialize(sizes.groupBy("sk", "sn").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("source_size")), "sources")
    order = Window.orderBy("sn", "sk")
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(ws, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    tight = Window.orderBy(F.col("cap") / F.col("w"), "sn", "sk")
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("after", F.sum("w").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    per = per.withColumn("level", (total - F.col("before")) / F.col("after"))
    per = per.withColumn("level", F.min_by(F.col("level"), F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "sn", "sk"))).over(whole))
    return per.select("sk", "sn", "n", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """The row, its source key (null apart from ''), its size, and two hashes of it, by which equal rows are known."""
    t = text_or_empty()
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce("source", F.lit("")).alias("sk"),
        F.col("source").isNull().cast("int").alias("sn"),
        word_count(t).alias("size"),
        F.xxhash64(F.lit(seed), *plain).alias("g"),
        F.xxhash64(F.lit(~seed), *plain).alias("g2"),
    )


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (without the row itself) written, with h: the place in the source's permutation, of each repeat its own."""
    base = materialize(rows.withColumn("part", F.spark_partition_id()), "mixrows")
    met = numbered(base, ["g", "g2"], "part").drop("part")
    return materialize(met.withColumn("h", F.xxhash64(F.lit(seed), "g", "g2", "nth")), "mixplaces")


def _range(h: str, level: int) -> Column:
    """The part of the hash range, by its bits from the top, FANOUT at each level."""
    step = FANOUT.bit_length() - 1
    return F.shiftrightunsigned(h, 64 - step * (level + 1)).bitwiseAND(F.lit(FANOUT - 1)).cast("int")


def last_taken(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(sk, sn, cut): the last h of each source's open block that is taken.

    open_: sk, sn, block, room. Documents in order of h are taken while their middle lies within the room. The range in which
    the room ends is found by sums over FANOUT ranges of h, and within it by as many again, so that only a
    millionth of a block goes through the window over single rows.
    """
    some = rows.join(open_, ["sk", "sn", "block"]).select("sk", "sn", "size", "h", "room")
    some = materialize(some.withColumn("used", F.lit(0).cast("long")), "openblocks")
    for level in range(2):
        part = _range("h", level)
        sums = some.groupBy("sk", "sn", part.alias("r")).agg(F.sum("size").alias("words"), F.max("room").alias("room"), F.max("used").alias("base"))
        run = Window.partitionBy("sk", "sn").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        ends = sums.withColumn("used", F.col("base") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        ends = ends.filter(F.col("used") < F.col("room")).groupBy("sk", "sn").agg(F.max_by(F.struct("r", "used"), "r").alias("e"))
        ends = materialize(ends.select("sk", "sn", F.col("e.r").alias("r"), F.col("e.used").alias("used")), "openranges")
        # what lies before the range is taken; a cut before its first row is the end of the range in front
        some = some.drop("used").join(ends, ["sk", "sn"]).filter(part == F.col("r")).drop("r")
    order = Window.partitionBy("sk", "sn").orderBy("u")
    some = some.withColumn("u", _unsigned("h"))
    upto = F.col("used") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("fits", upto - F.col("size") / 2 <= F.col("room"))
    first = F.min("u") - 1  # before the range's first row
    return some.groupBy("sk", "sn").agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("u"))), first).alias("cut"))


def _unsigned(h: str) -> Column:
    """The order of h's bits as an unsigned number, kept in a long."""
    return F.col(h).bitwiseXOR(F.lit(-(2**63)))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """sk, sn, shard, first, last: of each source's units 0 to quota - 1 those that each shard draws (last not included).

    The tree: at each node the units are put in the order of a fresh keyed hash, and the left child, with half of the
    node's shards, gets the first of them, its exact share. So the sources' quotas in the children follow the
    multivariate hypergeometric law, with exact sums. The place at which a node is cut is found by counts over ranges of
    the hash, so no task gets all units of a node. Units are alike until the end: a shard's count of a
    source's units, not which, comes out, and shards take runs of the source's permuted blocks in turn.
    """
    units = quotas.filter("quota > 0").select("sk", "sn", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("unit"))
    units = units.withColumn("lo", F.lit(0)).withColumn("n", F.lit(shards))
    for level in range((shards - 1).bit_length()):
        units = materialize(units.withColumn("k", F.xxhash64(F.lit(seed + level), "sk", "sn", "unit")), "mixnode")
        bins = units.groupBy("lo", "n", _range("k", 0).alias("r")).agg(F.count("*").alias("c"))
        node, run = Window.partitionBy("lo"), Window.partitionBy("lo").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0))).withColumn("units", F.sum("c").over(node))
        half = F.floor(F.col("n") / 2)
        bins = bins.withColumn("left", F.when(F.col("n") > 1, F.floor(F.col("units") * half / F.col("n"))).otherwise(F.col("units")))
        bins = materialize(bins.select("lo", "r", (F.col("left") - F.col("before")).alias("room"), "c"), "mixbins")
        met = units.withColumn("r", _range("k", 0)).join(F.broadcast(bins), ["lo", "r"])  # FANOUT rows a shard at most
        rank = F.row_number().over(Window.partitionBy("lo", "r").orderBy("k", "sk", "sn", "unit"))
        right = F.when(F.col("room") <= 0, True).when(F.col("room") >= F.col("c"), False).otherwise(rank > F.col("room"))
        units = met.withColumn("right", right).select("sk", "sn", "unit", F.when(F.col("right"), F.col("lo") + half).otherwise(F.col("lo")).cast("int").alias("lo"), F.when(F.col("n") == 1, 1).when(F.col("right"), F.col("n") - half).otherwise(half).cast("int").alias("n"))
    drawn = units.groupBy("sk", "sn", F.col("lo").alias("shard")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("sk", "sn").orderBy("shard"))
    return drawn.select("sk", "sn", "shard", (upto - F.col("c")).alias("first"), upto.alias("last"))


def mixing_plan(rows: DataFrame, *, share: float, cap: float, weights: tuple[int, ...], shards: int, seed: int, block_docs: int, max_blocks: int) -> DataFrame:
    """One row per (source, block): the copies that shards draw of it, as (shard, cut or null for the whole block), in passes.

    rows: sk, sn, size, h. A source is cut into blocks of its permutation. Its quota, counted in blocks, is what its target
    needs: p whole passes over all blocks and a rest: blocks in a second permuted order, whole
    until one would pass the rest; of that last one, documents in permuted order to the
    nearest. The tree splits the quotas among the shards, and each shard draws its run of the permuted blocks.
    """
    src = materialize(source_targets(rows, share, cap, weights), "targets")
    size = F.col("source_size")
    src = src.withColumn("passes", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    src = src.withColumn("rest", F.col("target") - F.col("passes") * size)
    src = src.withColumn("blocks", F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs))).cast("int"))
    cut_up = rows.join(small(src.select("sk", "sn", "blocks")), ["sk", "sn"]).withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
    per = cut_up.groupBy("sk", "sn", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("sk", "sn").orderBy(F.xxhash64(F.lit(seed + 1), "sk", "block"), "block")  # max_blocks rows
    per = per.join(src, ["sk", "sn"]).withColumn("place", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("filled", F.count("*").over(Window.partitionBy("sk", "sn")))
    whole = F.col("upto") <= F.col("rest")
    per = per.withColumn("open", ~whole & (F.col("upto") - F.col("words") < F.col("rest")))
    per = per.withColumn("room", F.when(F.col("open"), F.col("rest") - (F.col("upto") - F.col("words")))).withColumn("more", whole | F.col("open"))
    per = materialize(per, "blocks")
    cut = materialize(last_taken(cut_up, per.filter("open").select("sk", "sn", "block", "room")), "cuts")
    quotas = per.groupBy("sk", "sn").agg((F.max("passes") * F.max("filled") + F.sum(F.col("more").cast("int"))).cast("int").alias("quota"), F.max("filled").alias("filled"), F.max("passes").alias("passes"))
    quotas = materialize(quotas, "quotas")
    runs = materialize(split_quotas(quotas, shards, seed + 2), "shardruns")
    drawn = runs.join(quotas, ["sk", "sn"]).select("sk", "sn", "shard", "filled", "passes", F.explode(F.sequence("first", F.col("last") - 1)).alias("unit"))
    drawn = drawn.select("sk", "sn", (F.col("unit") % F.col("filled")).alias("place"), F.floor(F.col("unit") / F.col("filled")).cast("int").alias("pass"), "shard")
    drawn = drawn.join(per.select("sk", "sn", "place", "block", "open", "passes"), ["sk", "sn", "place"]).join(cut, ["sk", "sn"], "left")
    # of each source one block is drawn in part: the open one, in its last pass
    draw = F.struct("pass", "shard", F.when(F.col("open") & (F.col("pass") == F.col("passes")), F.col("cut")).alias("cut"))
    draws = drawn.groupBy("sk", "sn", "block").agg(F.sort_array(F.collect_list(draw)).alias("draws"))
    out = per.select("sk", "sn", "block", "blocks", "source_size", "target").join(draws, ["sk", "sn", "block"], "left")
    return materialize(out.withColumn("draws", F.coalesce("draws", F.array().cast(draws.schema["draws"].dataType))), "mixplan")


def _decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (sk, sn, size, h) with source_size, target and shards: those that have drawn it, one for each copy."""
    blocks = materialize(plan.groupBy("sk", "sn").agg(F.max("blocks").alias("blocks")), "blockcounts")
    met = rows.join(small(blocks), ["sk", "sn"]).withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int")).drop("blocks")
    met = met.join(small(plan, 200_000), ["sk", "sn", "block"])
    mine = F.filter("draws", lambda d: d["cut"].isNull() | (_unsigned("h") <= d["cut"]))
    return met.withColumn("shards", F.transform(mine, lambda d: d["shard"])).drop("draws", "block")


DEFAULTS = {"share": 1.5, "cap": 2.0, "weights": (5, 2, 1), "shards": 16, "seed": 3, "block_docs": 64, "max_blocks": 256}


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, the shards that drew its copies, and shuffle_key.

    taken counts what the shards have drawn. A document is taken whole, 0 to ceil(cap) times, so a source misses its target by
    half a document at most. Null text has size 0; a null source is a source of its own, last;
    sources without words have target 0; of rows that repeat each has a place of its own; other columns
    only tell rows apart; an empty table gives an empty one. Decisions are keyed hashes of the whole row and the
    number of the repeat: reruns agree whatever the partitioning.
    """
    o = DEFAULTS | options
    rows = keyed(docs, o["seed"])
    rows = placed(rows.select(F.col("row.doc_id").alias("doc_id"), "sk", "sn", "size", "g", "g2"), o["seed"])
    met = _decide(rows, mixing_plan(rows.select("sk", "sn", "size", "h"), **o))
    taken = (F.size("shards") * F.col("size")).cast("long")
    return met.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "shards", F.xxhash64(F.lit(o["seed"] + 99), "h").alias("shuffle_key"))


def _copies(docs: DataFrame, o: dict) -> DataFrame:
    """_row, _shard, _key of every copy that a shard has drawn.

    Rows that stand once are decided where they lie. Of rows that repeat one is kept, and what is drawn of them meets it by a join.
    """
    whole = keyed(docs, o["seed"])
    rows = placed(whole.drop("row"), o["seed"])
    plan = mixing_plan(rows.select("sk", "sn", "size", "h"), **o)
    twice = small(materialize(rows.filter("nth > 0").select("g", "g2").distinct(), "repeats"))
    once = whole.join(twice, ["g", "g2"], "left_anti").withColumn("h", F.xxhash64(F.lit(o["seed"]), "g", "g2", F.lit(0).cast("long")))
    first = whole.join(twice, ["g", "g2"], "left_semi").groupBy("g", "g2").agg(F.first("row").alias("row"))
    again = _decide(rows.join(twice, ["g", "g2"], "left_semi").select("g", "g2", "sk", "sn", "size", "h"), plan).join(first, ["g", "g2"])
    out = _decide(once, plan).select("row", "h", "shards").unionByName(again.select("row", "h", "shards"))
    out = out.select("row", "h", F.posexplode("shards").alias("_copy", "_shard"))
    return out.select(F.col("row").alias("_row"), "_shard", F.xxhash64(F.lit(o["seed"] + 99), "h", "_copy").alias("_key"))


def _laid_out(docs: DataFrame, o: dict) -> DataFrame:
    """The copies in partitions by shard and range of the shuffle key, sorted within (all shards are of one size)."""
    parts = -(-tasks_for(docs) // o["shards"])
    bits = max(0, (parts - 1).bit_length())
    at = F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long")
    copies = _copies(docs, o).withColumn("_at", (F.col("_shard") * (1 << bits) + at).cast("int"))
    return copies.repartitionById(o["shards"] << bits, "_at").sortWithinPartitions("_shard", F.col("_key").bitwiseXOR(F.lit(-(2**63))))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself (columns of docs): each row as often as it is taken, shard after shard, each in its shuffled order."""
    return _laid_out(docs, DEFAULTS | options).select("_row.*")


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the mix as its shards (folders _shard=k), each in its local shuffled order."""
    _laid_out(docs, DEFAULTS | options).select("_shard", "_row.*").write.partitionBy("_shard").parquet(path)
