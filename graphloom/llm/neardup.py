"""Near-dedup by texts: SimHash links and MinHash bands give candidates, five-word shingle sets decide."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import fingerprint, fingerprint_links
from .util import materialize, small, tasks_for, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
#: Two texts of similarity 0.8 share no band with chance (1 - 0.8**8)**64 = 8e-6; of 0.5 they share one with chance 0.22.
BANDS, ROWS = 64, 8
_RNG = np.random.default_rng(58)
_A = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_WORD = _RNG.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different hashes of the runs of five lower-cased words; of a shorter text the whole; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n, width = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
    x = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        x += h[k : k + n] * _WORD[k]
    return np.unique(_mix(x))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two shingle sets is SIMILARITY or more; texts without words are alike."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One key a band: equal for texts whose least values under the band's permutations all agree."""
    low = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 64):
        np.minimum(low, (x[k : k + 64, None] * _A + _B).min(axis=0), out=low)
    return _mix((_FOLD * (low.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1))).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, keys = np.empty(b.num_rows, dtype=np.uint64), np.empty((b.num_rows, BANDS), dtype=np.int64)
        for k, t in enumerate(b.column(2)):
            text = t.as_py()
            fps[k], keys[k] = fingerprint(text), band_keys(shingle_set(text))
        ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS)
        bands = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), bands], ["th", "doc_id", "fp", "bands"])


def simhash_links(marks: DataFrame) -> DataFrame:
    """th, least: links that connect all texts whose fingerprints are linked, by the buckets and pivot tables of op7.

    Texts of one fingerprint are linked to the least of them, and of each link between fingerprints the least texts are.
    """
    fps = materialize(marks.groupBy("fp").agg(F.min("th").alias("least"), F.max("th").alias("most")), "fingerprints")
    shared = small(materialize(fps.filter("least < most").select("fp", "least"), "sharedfps"))
    same = marks.select("th", "fp").join(shared, "fp").filter("th > least").select("th", "least").distinct()
    ends = fingerprint_links(fps.select("fp")).select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    ends = small(materialize(ends, "fplinks"))
    return same.unionByName(fps.join(ends, "fp").groupBy("a", "b").agg(F.max("least").alias("th"), F.min("least").alias("least")).select("th", "least"))


class Kept:
    """Sets of shingles that were kept, found again by their first values: sets that are alike share one of as many as may be missing, and one."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.index: dict[int, list[int]] = defaultdict(list)

    @staticmethod
    def _head(grams: np.ndarray) -> list[int]:
        return grams[: len(grams) - int(np.ceil(SIMILARITY * len(grams) - 1e-9)) + 1].tolist()

    def holds_like(self, grams: np.ndarray) -> bool:
        if not len(grams):
            return any(not len(s) for s in self.sets)
        near = {k for x in self._head(grams) for k in self.index.get(x, ())}
        return any(similar(grams, self.sets[k]) for k in near)

    def add(self, grams: np.ndarray) -> None:
        for x in self._head(grams):
            self.index[x].append(len(self.sets))
        self.sets.append(grams)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """th and whether it is like a kept text, of rows sorted by (grp, salt, kind, order).

    Leaders (kind 0) come first: each is kept if it is like none kept before. The others (kind 1) are held against the kept leaders alone.
    Leaders stand in every salt of their group, so only the first one's word on them counts.
    """
    group, kept = None, Kept()
    for b in batches:
        out = []
        for grp, salt, kind, th, text in zip(*[c.to_pylist() for c in b.columns[:4]], b.column(4), strict=True):
            if (grp, salt) != group:
                group, kept = (grp, salt), Kept()
            grams = shingle_set(text.as_py())
            hit = kept.holds_like(grams)
            if kind:
                out.append((th, hit))
            elif not hit:
                kept.add(grams)
            elif salt == 0:
                out.append((th, True))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.bool_())], ["th", "like"])


#: A group of up to so many rows and bytes of text is judged in one task; of a larger one LEADERS rows are, and the others are dealt to tasks of this size.
GROUP_ROWS, GROUP_BYTES, LEADERS = 1024, 64_000_000, 256


def _round(texts: DataFrame) -> DataFrame:
    """th, like: of leaders that are dropped, and of all others, whether they are like a leader that is kept."""
    sizes = texts.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    salts = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("size") / GROUP_BYTES)).cast("int")
    large = small(materialize(sizes.select("grp", salts.alias("salts")).filter("salts > 1"), "largegroups"))
    first = texts.join(large, "grp", "left_semi").select("grp", "th", "order")
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("order"))).filter(F.col("rn") <= LEADERS)
    first = small(materialize(first.select("th", F.lit(True).alias("leads")), "leaders"))
    rows = texts.join(large, "grp", "left").join(first, "th", "left")
    kind = F.when(F.col("salts").isNull() | F.col("leads"), 0).otherwise(1)
    mine = F.array(F.pmod(F.xxhash64("th"), F.coalesce("salts", F.lit(1))).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    rows = rows.withColumn("kind", kind).withColumn("salt", F.explode(F.when(F.col("kind") == 0, every).otherwise(mine)))
    rows = rows.repartition(tasks_for(texts), "grp", "salt").sortWithinPartitions("grp", "salt", "kind", "order")
    return materialize(rows.select("grp", "salt", "kind", "th", "text").mapInArrow(_judge, "th long, like boolean"), "judged")


def repeated_texts(docs: DataFrame) -> DataFrame:
    """th (hash of the text) of every text that is like one that is kept.

    Candidates are the links of SimHash (fingerprints at most 4 bits apart, all of them) and, for the alike texts beyond those bits, shared
    MinHash bands. Texts of one group (joined by either, in chains) are taken by least doc_id, nulls last, then hash; each is
    kept if it is unlike all kept ones. So no two kept texts that are linked or share a band
    are alike, and each other text is like a kept one. A group that is too large for one task goes in rounds: its first rows are judged, and
    all others, dealt to many tasks, are held against those kept of them; what is unlike is left for the next round.
    """
    cols = [F.xxhash64(text_or_empty()).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text"]
    marks = materialize(docs.select(*cols).mapInArrow(_marks, "th long, doc_id long, fp long, bands array<long>"), "marks")
    rows = marks.select("th", F.posexplode("bands").alias("band", "key"))
    met = rows.groupBy("band", "key").agg(F.min("th").alias("least"), F.max("th").alias("most")).filter("least < most")
    met = materialize(met.select("band", "key", "least"), "metbands")
    links = rows.join(small(met), ["band", "key"]).filter("th > least").select("th", "least").distinct().unionByName(simhash_links(marks))
    nodes = materialize(connected_components(links), "textgroups").withColumnsRenamed({"node": "th", "component": "grp"})
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("order")
    wanted = docs.select(*cols).join(small(nodes), "th")
    texts = materialize(wanted.groupBy("grp", "th").agg(order, F.min("text").alias("text")), "grouptexts")
    dropped = []
    while True:
        judged = _round(texts)
        dropped.append(judged.filter("like").select("th"))
        open_ = judged.filter("not like").select("th")
        if open_.isEmpty():
            return materialize(reduce(DataFrame.unionByName, dropped), "repeated")
        texts = materialize(texts.join(open_, "th", "left_semi"), "grouptexts")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without copies, and without texts whose five-word Jaccard similarity to a kept text is 0.8 or more.

    One row of each kept text stays, the one of the least doc_id (nulls last). Rows are told apart by text, so rows
    with null or equal ids and different texts all count. Null, empty and wordless texts are alike; the
    columns stay; an empty table gives an empty one. Texts move once.
    """
    drop = small(repeated_texts(docs.select("doc_id", "text")))
    rows = docs.select(F.xxhash64(text_or_empty()).alias("_th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(drop, F.col("_th") == F.col("th"), "left_anti")
    place = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.monotonically_increasing_id())
    return kept.select("_th", "row", place.alias("place")).groupBy("_th").agg(F.min_by("row", "place").alias("row")).select("row.*")
