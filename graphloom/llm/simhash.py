"""SimHash near-dedup: pigeonhole buckets, pivot distance tables, verified links, distributed components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .util import materialize, tasks_for

MAX_BITS = 4
TILE = 1024
#: Reference fingerprints of the pivot tables (fixed, so that tables of any run agree).
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the text's shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, seed) for x in runs), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        bits = np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        rest = {n: b.column(n) for n in b.schema.names[2:]}
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *rest.values()], ["doc_id", "fp", *rest])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(n: int) -> list[int]:
    """Bit masks of which any two fingerprints with at most MAX_BITS differing bits share one.

    With b blocks and 4 bits that differ, b - 4 blocks agree: there is a mask for each
    choice of them. More blocks make keys longer and buckets smaller: b grows with the number of
    fingerprints, so that chance meetings stay a few for each of them.
    """
    blocks = 6 if n < 2**24 else 7 if n < 2**29 else 8
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(blocks)]
    return [sum(part[k] for k in pick) for pick in combinations(range(blocks), blocks - MAX_BITS)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The links that join what no earlier one has joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def links_in(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the same group with at most MAX_BITS differing bits; rows are sorted by group, then side.

    side: 0 for all pairs of the group, else 1 or 2, and only pairs of a 1 with a 2 count.
    Pairs at each distance of places are compared at once: first the pivot tables, whose
    coordinates of linked fingerprints differ by MAX_BITS at most, then the bits.
    """
    f = fp.view(np.uint64)
    pivots = np.bitwise_count(f[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    n, out_a, out_b = len(f), [], []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))  # end of each row's group
    open_ = np.arange(n)
    step = 1
    while len(open_ := open_[open_ + step < last[open_]]):
        i, j = open_, open_ + step
        i, j = (i[m := (side[i] != side[j]) | (side[i] == 0)], j[m])
        for k in range(0, PIVOTS.size, 8):
            near = (np.abs(pivots[i, k : k + 8] - pivots[j, k : k + 8]) <= MAX_BITS).all(axis=1)
            i, j = i[near], j[near]
        same = np.bitwise_count(f[i] ^ f[j]) <= MAX_BITS
        out_a.append(fp[i[same]])
        out_b.append(fp[j[same]])
        step += 1
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; what a batch leaves open is held for the next (a group has about 2 * TILE rows at most)."""
    held = [np.empty(0, dtype=np.int64) for _ in range(3)]

    def done(cols: list[np.ndarray]) -> pa.RecordBatch:
        left, right = _forest(*links_in(*cols))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    for b in batches:
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield done([c[:cut] for c in cols])
    if len(held[0]):
        yield done(held)


#: Neighbours of a pivot cell, each pair of cells once; cells are MAX_BITS + 1 wide, so linked fingerprints are in one cell or in neighbours.
_STEPS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def _cell(name: str, pivot: int) -> Column:
    """The cell of a fingerprint by its distance to a reference fingerprint."""
    return F.floor(F.bit_count(F.col(name).bitwiseXOR(F.lit(int(PIVOTS[pivot : pivot + 1].view(np.int64)[0])))) / (MAX_BITS + 1)).cast("int")


def _meets(n: int, step: tuple[int, int], second: bool) -> Column:
    """(group, side) of a row (t, key, c1, c2, tile, tiles) for the n-th step: as a row of the first cell or of the second."""
    tile, (x, y) = F.col("tile"), step if second else (0, 0)

    def group(one: Column, two: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("t", "key", F.col("c1") - x, F.col("c2") - y, F.lit(n), one, two).alias("group"), side.cast("long").alias("side"))

    def make(other: Column) -> Column:
        if step == (0, 0):  # the cell with itself
            return group(F.least(tile, other), F.greatest(tile, other), F.when(other == tile, 0).when(tile < other, 1).otherwise(2))
        return group(other, tile, F.lit(2)) if second else group(tile, other, F.lit(1))

    return F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), make)


def _cell_groups() -> Column:
    return F.concat(*[_meets(n, step, second) for n, step in enumerate(_STEPS) for second in ((False, True) if n else (False,))])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints at most MAX_BITS apart, in chains that stay within the components.

    fps: one column of different fingerprints. Masks bring candidates together. Of a bucket of over TILE fingerprints only those meet whose
    coordinates differ by MAX_BITS at most: it is cut into cells by the distances to two reference fingerprints, and a
    cell meets itself and its neighbours; cells of over TILE are cut into tiles, and every two tiles that
    must meet do so in a group of their own, so no task gets more than 2 * TILE rows of one bucket (in the mean). Within a
    group the whole pivot table discards pairs where their rows lie, and the bits verify what it leaves; only a
    spanning forest of the links leaves the task.
    """
    name = fps.columns[0]
    ms = masks(fps.count())
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("key")) for i, m in enumerate(ms)])
    rows = fps.select(F.col(name).alias("fp"), F.inline(keys))
    big = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("c")).filter(F.col("c") > TILE).select("t", "key"), "bigbuckets")
    celled = rows.join(big, ["t", "key"]).withColumn("c1", _cell("fp", 0)).withColumn("c2", _cell("fp", 1))
    tiles = celled.groupBy("t", "key", "c1", "c2").agg(F.count("*").alias("c")).groupBy("t", "key").agg(F.ceil(F.max("c") / TILE).cast("int").alias("tiles"))
    tiles = materialize(tiles, "buckettiles")
    met = rows.join(tiles, ["t", "key"], "left").withColumn("c1", _cell("fp", 0)).withColumn("c2", _cell("fp", 1))
    met = met.withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "fp"), "tiles").cast("int"))
    alone = F.array(F.struct(F.xxhash64("t", "key").alias("group"), F.lit(0).cast("long").alias("side")))
    met = met.select("fp", F.inline(F.when(F.col("tiles").isNull(), alone).otherwise(_cell_groups()))).select("group", "side", "fp")
    return met.repartition(tasks_for(fps, 4_000_000), "group").sortWithinPartitions("group", "side").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Copies share a fingerprint, so only different fingerprints are compared and linked.
    Null and empty texts have fingerprint zero and are linked like any other; a null
    doc_id counts only if its component has no other; repeated rows stay; other columns
    are ignored; an empty table gives an empty one.
    """
    base = materialize(fingerprints(docs), "fingerprints")
    ids = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinctfps")
    nodes = materialize(connected_components(fingerprint_links(ids.select("fp"))), "fpcomponents")
    best = ids.join(nodes.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    best = nodes.join(best, "component").select(F.col("node").alias("fp"), "component_id")
    label = ids.join(best, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    label = materialize(label, "fplabels")
    return base.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
