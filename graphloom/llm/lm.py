"""Cross-entropy difference of a target and a background bigram model, by exact counts of every word and pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialize

WEIGHT = 8.0
#: The key of the start sign; words hold no space.
START = np.uint64(xxhash.xxh64_intdigest(b" "))
#: Tokens of one pack, and mean keys of one range of keys.
PACK, RANGE = 750_000, 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def squeeze(a: np.ndarray) -> bytes:
    """The array's bytes by significance, compressed, behind their number."""
    raw = np.ascontiguousarray(a.reshape(-1).view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def spread(data: bytes, kind: type) -> np.ndarray:
    size, item = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(item, -1).T).view(kind).reshape(-1)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which np.cumsum undoes."""
    return np.r_[keys[:1], np.diff(keys)]


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of word keys."""
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def bits(pair: np.ndarray, before: np.ndarray, word: np.ndarray, size: np.ndarray, scale: float, n_words: int) -> np.ndarray:
    """Bits of tokens under (background, target) by counts (2, n) of pair, word before, word, and of all tokens.

    Interpolated bigrams; the background's counts are scaled to the target's size.
    """
    to = np.array([scale, 1.0])[:, None]
    pair, before, word, size = pair * to, before * to, word * to, size * to
    alone = (word + 0.5) / (size + 0.5 * (n_words + 2))
    return -np.log2((pair + WEIGHT * alone) / (np.maximum(before, pair) + WEIGHT))


def _within(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """For each place, how often its key stands in its document."""
    _, at, c = np.unique(doc * n + key, return_inverse=True, return_counts=True)
    return c[at]


class Pack:
    """Documents of about PACK tokens together: token places in the pack's sorted word keys, and which are targets."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, hits: np.ndarray) -> None:
        self.words, self.tokens, self.lengths = words, tokens.astype(np.int64), lengths
        self.of = np.repeat(np.arange(len(lengths)), lengths)
        self.target = np.zeros(len(lengths), dtype=bool)
        self.target[hits] = True
        self.before = np.r_[0, self.tokens[:-1]] if len(tokens) else self.tokens
        self.before[(np.cumsum(lengths) - lengths)[lengths > 0]] = np.searchsorted(words, START)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts (2, n); the start sign's is the number of documents with words."""
        n, hit = len(self.words), self.target[self.of]
        c = np.array([np.bincount(self.tokens, minlength=n), np.bincount(self.tokens[hit], minlength=n)])
        full = self.lengths > 0
        c[:, np.searchsorted(self.words, START)] = full.sum(), (full & self.target).sum()
        return self.words, c

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = self.pairs()
        return keys, np.array([np.bincount(at, minlength=len(keys)), np.bincount(at[self.target[self.of]], minlength=len(keys))])

    def chunks(self, most: int = 100_000) -> Iterator[tuple[slice, slice]]:
        """Documents and their tokens, about `most` tokens at a time."""
        ends = np.cumsum(self.lengths)
        cuts = np.searchsorted(ends, np.arange(most, len(self.tokens), most)) + 1
        for a, b in pairwise(np.unique(np.r_[0, cuts, len(ends)]).tolist()):
            here = slice(int(ends[a - 1]) if a else 0, int(ends[b - 1]))
            if here.stop > here.start:
                yield slice(a, b), here

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_pairs(self.words[self.before], self.words[self.tokens]), return_inverse=True)


_PACKED = "pack long, n long, ids array<long>, lengths array<int>, words binary, tokens binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = TaskContext.get().partitionId() << 32

    def out(ids: list, keys: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal serial
        lengths = [len(k) for k in keys]
        words, at = np.unique(np.concatenate([np.array([START]), *keys]), return_inverse=True)
        row = [[serial], [sum(lengths)], [ids], [lengths], [squeeze(_steps(words))], [squeeze(at[1:].astype(np.uint32))]]
        serial += 1
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

    ids, keys, size = [], [], 0
    for b in batches:
        for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = words_of(text.as_py())
            ids.append(d)
            keys.append(np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w)))
            size += len(w) + 1
            if size >= PACK:
                yield out(ids, keys)
                ids, keys, size = [], [], 0
    if ids:
        yield out(ids, keys)


def _unpack(hits: list[int] | None, lengths: list[int], words: bytes, tokens: bytes) -> Pack:
    return Pack(np.cumsum(spread(words, np.uint64)), spread(tokens, np.uint32), np.array(lengths, dtype=np.int64), np.array(hits or [], dtype=np.int64))


def _with_hits(packs: DataFrame, targets: DataFrame, most: int = 16_000_000) -> tuple[DataFrame, int]:
    """packs with hits, the places of their target documents, and the number of tokens of all of those.

    Only ids meet ids; their places, four bytes for each target document, go back to the packs by a broadcast up to
    `most` of them, and beyond that packs (half as large as the texts) are written once more with them.
    """
    wanted = targets.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct()
    rows = packs.select("pack", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "of"))
    rows = rows.join(wanted, F.col("of.ids") == F.col("_id"), "left_semi")
    hits = materialize(rows.groupBy("pack").agg(F.collect_list("place").alias("hits"), F.sum("of.lengths").alias("n_target")), "targetplaces")
    n, tokens = hits.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    hits = hits.drop("n_target")
    return (packs.join(F.broadcast(hits), "pack", "left") if n <= most else materialize(packs.join(hits, "pack", "left"), "markedpacks")), tokens


def _totals(packs: DataFrame, counts: Callable[[Pack], tuple[np.ndarray, np.ndarray]], ranges: int) -> DataFrame:
    """pack, part, keys, data: for each pack and range of keys, the whole corpus's counts (2, n) of the pack's keys, in their order.

    The first row of a range, of pack -1, holds the number of its different keys. A pack sends each of its keys once to the
    key's range; the number of ranges grows with the tokens, so that a range stays of one size, and each is a task of its own.
    """
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k, *data = (c[i].as_py() for c in b.columns)
                keys, c = counts(_unpack(*data))
                at = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                some = np.flatnonzero(np.diff(at))
                rows = [squeeze(_steps(keys[at[p] : at[p + 1]])) for p in some]
                sums = [squeeze(c[:, at[p] : at[p + 1]].astype(np.int32)) for p in some]
                cols = [pa.array(np.full(len(some), k)), pa.array(some, pa.int64()), pa.array(rows, pa.binary()), pa.array(sums, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["pack", "part", "data", "counts"])

    def total(part: int, packs: list[int], data: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        some = [np.cumsum(spread(x, np.uint64)) for x, _ in data]
        sizes, keys = [len(x) for x in some], np.concatenate(some)
        c = np.concatenate([spread(x, np.int32).reshape(2, -1) for _, x in data], axis=1)
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.array([np.bincount(at, weights=x) for x in c]).astype(np.int64)
        back = np.split(at, np.cumsum(sizes)[:-1])
        rows = [b"", *[squeeze(sums[:, a]) for a in back]]
        cols = [[-1, *packs], [part] * len(rows), [len(keys)] + [0] * len(packs)]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(rows, pa.binary())], ["pack", "part", "keys", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packs, data = None, [], []
        for b in batches:
            for k, p, *x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != part and packs:
                    yield total(part, packs, data)
                    packs, data = [], []
                part = p
                packs.append(k)
                data.append(x)
        if packs:
            yield total(part, packs, data)

    schema = "pack long, part long, data binary, counts binary"
    sent = packs.select("pack", "hits", "lengths", "words", "tokens").mapInArrow(cut, schema)
    return sent.repartitionById(ranges, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(add, "pack long, part long, keys long, data binary")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and ce_diff (mean bits a token; lower: nearer to the target).

    targets: doc_id of the target documents; all rows of docs are counted for the background. Every word and pair
    counts for itself (by 64-bit keys), whatever the size: packs of documents send their different keys to ranges
    of keys and get the whole corpus's counts back, so no task or driver holds a table of all. A row is scored by models that
    have not seen it: its own counts are taken out, of the target too if it is one. The models
    share their words, their order, their smoothing and, by scaling, their size. Null and empty texts have no
    tokens and losses 0; without targets the target model is the smoothing alone; repeated rows count and are
    scored each; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    packs = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack, _PACKED), "packs")
    n, written = packs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.shiftright("pack", 32)) + 1, F.lit(1))).first()
    packs, n_target = _with_hits(packs, targets)
    tokens, ranges = np.array([[n], [n_target]], dtype=np.float64), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    scale = n_target / n if n and n_target else 1.0
    words = materialize(_totals(packs, Pack.word_counts, ranges), "wordtotals")
    n_words = (words.agg(F.sum("keys")).first()[0] or 1) - 1  # the start sign is no word
    pairs = _totals(packs, Pack.pair_counts, ranges)

    def score(ids: list[int | None], pack: Pack, word: list[bytes], pair: list[bytes]) -> pa.RecordBatch:
        word, pair = (np.concatenate([spread(x, np.int64).reshape(2, -1) for x in c], axis=1) if c else np.zeros((2, 0)) for c in (word, pair))
        keys, at = pack.pairs()
        mean = np.zeros((2, len(pack.lengths)))
        for docs_, here in pack.chunks():
            of, known = pack.of[here], pack.target[pack.of[here]]
            seen = np.array([np.ones(len(of), dtype=np.int64), known])  # which models hold the document
            own = _within(of, pack.tokens[here], len(pack.words))
            own_before = np.r_[1, own[:-1]]
            own_before[np.r_[True, of[1:] != of[:-1]]] = 1
            counts = ((pair, at[here], _within(of, at[here], len(keys))), (word, pack.before[here], own_before), (word, pack.tokens[here], own))
            x = bits(*[c[:, i] - seen * o for c, i, o in counts], tokens - seen * pack.lengths[of], scale, n_words)
            for k in range(2):
                mean[k, docs_] = np.bincount(of - docs_.start, weights=x[k], minlength=docs_.stop - docs_.start)
        mean /= np.maximum(pack.lengths, 1)
        cols = [pa.array(ids, pa.int64()), pa.array(pack.lengths), pa.array(mean[1]), pa.array(mean[0]), pa.array(mean[1] - mean[0])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "target_loss", "background_loss", "ce_diff"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pack its counts come first, by kind and range, then itself."""
        got: tuple[list[bytes], list[bytes]] = ([], [])
        for b in batches:
            for k in range(b.num_rows):
                kind, data, *rest = (c[k].as_py() for c in b.columns)
                if kind < 2:
                    got[kind].append(data)
                else:
                    yield score(rest[0], _unpack(*rest[1:]), *got)
                    got = ([], [])

    cols = ["ids", "hits", "lengths", "words", "tokens"]
    none = [F.lit(None).cast(packs.schema[c].dataType).alias(c) for c in cols]
    parts = [t.filter("pack >= 0").select("pack", F.lit(k).alias("kind"), "part", "data", *none) for k, t in enumerate((words, pairs))]
    whole = packs.select("pack", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(None).cast("binary").alias("data"), *cols)
    # packs are numbered by the task that wrote them and their turn there; by turns, then tasks, they are dealt evenly
    turn = F.col("pack").bitwiseAND(F.lit(2**32 - 1)) * written + F.shiftright("pack", 32)
    rows = parts[0].unionByName(parts[1]).unionByName(whole).repartitionById(ranges, F.pmod(turn, F.lit(ranges)).cast("int"))
    rows = rows.sortWithinPartitions("pack", "kind", "part").select("kind", "data", *cols)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, ce_diff double")
