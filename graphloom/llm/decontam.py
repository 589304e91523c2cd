"""Benchmark decontamination: BM25 index of test items, block-max WAND, verified overlaps."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialize

SHINGLE = 5
BLOCKS = 32  # ranges of items, each with the best score of every term in it
_WORD, _ASKS = re.compile(r"\w+"), re.compile(r"\?(?=\s|$)")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased: punctuation at, in or between words is no matter."""
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words, cut after its question: at the first '?' that ends a word, else before its last quarter."""
    if cut := _ASKS.search(text or ""):
        return words_of(text[: cut.end()]), words_of(text[cut.end() :])
    w = words_of(text)
    return w[: len(w) - len(w) // 4], w[len(w) - len(w) // 4 :]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of a shorter sequence the whole."""
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


@dataclass
class Posting:
    items: list[int]
    scores: list[float]
    top: float
    block_last: list[int]
    block_top: list[float]


class Index:
    """Inverted index of items of one length class. A term's score in an item is its BM25 score over the item's
    score for itself, so a passage that holds the whole item scores 1. Terms are numbers of `vocab`; items are
    cut into BLOCKS ranges, and postings are blocked by them."""

    def __init__(self, items: list[tuple[int, list[str]]], vocab: dict[str, int], k1: float = 1.2, b: float = 0.75) -> None:
        self.ids = [i for i, _ in items]
        self.longest = max(len(w) for _, w in items)
        df = Counter(t for _, w in items for t in set(w))
        mean = sum(len(w) for _, w in items) / len(items)
        found: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, w) in enumerate(items):
            tf = Counter(w)
            raw = {t: log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean)) for t, c in tf.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                found[vocab[t]].append((k, x / own))
        block = -(-len(items) // BLOCKS)
        self.postings: dict[int, Posting] = {}
        self.blocks = np.zeros((len(vocab) + 1, BLOCKS), dtype=np.float32)  # the last row: no term
        for t, p in found.items():
            ids, sc = [x[0] for x in p], [x[1] for x in p]
            top: dict[int, float] = {}
            last: dict[int, int] = {}
            for k, x in p:
                top[k // block] = max(top.get(k // block, 0.0), x)
                last[k // block] = k
            self.postings[t] = Posting(ids, sc, max(sc), list(last.values()), list(top.values()))
            self.blocks[t, list(top)] = list(top.values())
        self.tops = self.blocks.max(axis=1).astype(np.float64)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least threshold for these different terms: block-max WAND."""
        eps = 1e-9
        cursors = [[self.postings[t].items[0], 0, t] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += self.postings[c[2]].top
                if bound >= threshold - eps:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks, ends = 0.0, []
            for _, _, t in cursors[: pivot + 1]:
                p = self.postings[t]
                at = bisect_left(p.block_last, item)
                if at < len(p.block_last):
                    blocks += p.block_top[at]
                    ends.append(p.block_last[at])
            if blocks >= threshold - eps:
                if cursors[0][0] == item:
                    score = sum(self.postings[t].scores[k] for _, k, t in cursors[: pivot + 1])
                    if score >= threshold - eps:
                        out.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:  # no item up to the end of these blocks, or the next cursor's, can reach the threshold
                target = min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]], default=item + 1)
                target = max(target, item + 1)
            left = []
            for n, c in enumerate(cursors):
                if n <= pivot and c[0] < target:
                    p = self.postings[c[2]]
                    k = bisect_left(p.items, target, c[1])
                    if k == len(p.items):
                        continue
                    c = [p.items[k], k, c[2]]
                left.append(c)
            cursors = left
        return out


class Matcher:
    """Indexes by length class (items of 2**k to 2**(k+1) words), and what verification needs."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float, overlap: float) -> None:
        self.threshold, self.overlap = threshold, overlap
        kinds: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        self.parts: dict[int, tuple[set, set, set, bool]] = {}
        self.vocab: dict[str, int] = {}
        self.names = [i for i, _ in items]
        for item, (_, text) in enumerate(items):  # by row: an id may stand on several texts
            if w := words_of(text):
                kinds[len(w).bit_length()].append((item, w))
                q, a = question_and_answer(text)
                # an answer shorter than a shingle is looked up with the words in front of it
                self.parts[item] = (shingles(q if len(q) >= SHINGLE else w), shingles(a if len(a) >= SHINGLE else w[-max(SHINGLE, len(a)) :]), shingles(w), bool(a) and bool(_ASKS.search(text)))
                for t in w:
                    self.vocab.setdefault(t, len(self.vocab))
        self.indexes = [Index(v, self.vocab) for _, v in sorted(kinds.items())]

    def matches(self, text: str | None) -> list[tuple[int | None, float, float, float]]:
        """(item, best score of a passage, question overlap, answer overlap) of the items that the text holds; of an id's several texts the best.

        Of a passage's bounds the cheapest comes first: best scores of its words, repeats
        counted; best scores of its different terms in each range of items; then WAND.
        """
        words = words_of(text)
        if not words:
            return []
        best: dict[int, float] = {}
        none, enough = len(self.vocab), self.threshold - 1e-5
        ids = np.array(list(map(self.vocab.get, words, repeat(none))), dtype=np.int64)
        at = np.flatnonzero(ids < none)  # words of the index, by place
        known = ids[at]
        for index in self.indexes:
            width, step = 2 * index.longest, index.longest
            sums = np.r_[0.0, np.cumsum(index.tops[known])]
            starts = np.arange(0, max(1, len(words) - step), step)
            left, right = np.searchsorted(at, starts), np.searchsorted(at, starts + width)
            for k in np.flatnonzero(sums[right] - sums[left] >= enough):
                some = list(set(known[left[k] : right[k]].tolist()))
                if index.blocks[some].sum(axis=0).max() >= enough:
                    for n, score in index.search([t for t in some if t in index.postings], self.threshold):
                        best[index.ids[n]] = max(best.get(index.ids[n], 0.0), score)
        if not best:
            return []
        mine = shingles(words)
        out: dict[int | None, tuple[float, float, float]] = {}
        for item, score in best.items():
            q, a, whole, asks = self.parts[item]
            have = lambda s: sum(self._has(x, words, mine) for x in s) / len(s)
            qo, ao = have(q), have(a)
            # of an item that asks, the answer too must be there, but for the shingles that one changed word breaks
            answered = not asks or (ao > 0 and (1 - ao) * len(a) <= SHINGLE)
            if min(qo, ao) >= self.overlap or (answered and have(whole) >= self.overlap):
                name = self.names[item]
                out[name] = max(out.get(name, (0.0, 0.0, 0.0)), (score, qo, ao))
        return [(name, *x) for name, x in out.items()]

    @staticmethod
    def _has(run: tuple[str, ...], words: list[str], mine: set) -> bool:
        if len(run) == SHINGLE:
            return run in mine
        return any(tuple(words[i : i + len(run)]) == run for i in range(len(words) - len(run) + 1))


def _item_parts(items: DataFrame, bytes_a_part: int, null_ids: bool) -> Iterator[list[tuple[int | None, str]]]:
    """The items in parts of about bytes_a_part of text, so that each index is of bounded size; all of them are used."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items if null_ids else items.filter("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // bytes_a_part))
    for k in range(parts):
        some = items.filter(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), "text")), F.lit(parts)) == k) if parts > 1 else items
        yield sorted({(r.item_id, r.text or "") for r in some.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, bytes_a_part: int = 4_000_000, null_ids: bool = False) -> DataFrame:
    """doc_id, item_id, bm25 (1: the whole item), question_overlap, answer_overlap of each document that holds an item.

    Every document is cut into passages of twice the longest item of a length class, half
    over each other, and each passage is a query: all items that score at least `threshold` of
    their own score are retrieved and then verified on the whole document: `overlap` of the
    question's and of the answer's five-word shingles must occur in it, or of the whole item's (of an item with a
    question mark then all of the answer's but those one word breaks). Null and empty texts hold
    and are held by nothing; null item ids are left out but with null_ids; of items that repeat one counts, and
    each text of an item_id that has several;
    rows that repeat are reported each; other columns are ignored; empty tables give an
    empty one. The index goes out in parts of bounded size, one pass over docs for each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _found(rows, ["doc_id"], items, threshold, overlap, bytes_a_part, null_ids)


_FOUND = {"item_id": pa.int64(), "bm25": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}


def _found(rows: DataFrame, keys: list[str], items: DataFrame, threshold: float, overlap: float, bytes_a_part: int, null_ids: bool) -> DataFrame:
    """keys (longs of rows, which has them and text behind) and what contaminated() says of each item that the text holds."""
    spark, out = rows.sparkSession, None
    schema = ", ".join([f"{k} long" for k in keys] + ["item_id long", "bm25 double", "question_overlap double", "answer_overlap double"])
    for part in _item_parts(items, bytes_a_part, null_ids):
        shared = spark.sparkContext.broadcast(Matcher(part, threshold, overlap))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, got = [], []
                for n, t in enumerate(b.column(len(keys))):
                    mine = shared.value.matches(t.as_py())
                    at += [n] * len(mine)
                    got += mine
                own = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
                cols = list(zip(*got, strict=True)) or [[]] * len(_FOUND)
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, kind) for c, kind in zip(cols, _FOUND.values(), strict=True)]], [*keys, *_FOUND])

        found = rows.select(*keys, "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, bytes_a_part: int = 4_000_000) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Rows are told apart by 128 bits of their text, so null ids are no matter, of items neither."""
    keys = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(2), "text")}
    marked = docs.select(*[v.alias(k) for k, v in keys.items()], "text")
    bad = materialize(_found(marked, list(keys), items, threshold, overlap, bytes_a_part, True).select(*keys).distinct(), "contaminated")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])
    return row.join(bad, list(keys), "left_anti").select("row.*")
