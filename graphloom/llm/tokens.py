"""Token-id output: documents in ascending doc_id order as patched frame-of-reference files."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .util import materialize, scratch_path, tasks_for

#: Ids of one file at most (but for a longer document), held in memory while it is written.
FILE_IDS = 2_000_000
_CACHE = 800_000  # pieces a worker keeps: some 170 MB
_INNER = re.compile(r"(?<=\S) (?=\S)")


#: Latin letters, then ASCII punctuation to the end: two pre-tokens, whatever follows the piece.
_LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level BPE writes bytes as characters.
_AS_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


class WordEncoder:
    """Encodes by pieces cut at single inner spaces, each with its space in front.

    Byte-level BPE never joins characters across a space that has white space on one side at
    most, so the pieces' ids on end are the text's ids; frequent pieces are encoded once a worker. Of the others, those of one word
    go to the tokenizer's model without its pre-tokenizer, and the rest through the whole of
    it. Texts with a special token's marks, and all texts if the tokenizer is of another
    kind, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kind = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 65_536 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.runs: dict[str, list[int]] = {"": []}

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, spaced: int, piece: str) -> bytes:
        """Ids of a piece that is not known; kept while there is room."""
        if m := _LATIN.fullmatch(piece):
            core, run = m.groups()
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(_AS_CHAR)
            if (end := self.runs.get(run)) is None:
                end = self.whole(run)
                if len(self.runs) < 10_000:
                    self.runs[run] = end
            ids = [t.id for t in self.model.tokenize("\u0120" * spaced + core)] + end
        else:
            ids = self.whole(" " * spaced + piece)
        out = array(self.code, ids).tobytes()
        if len(self.known[spaced]) < _CACHE:
            self.known[spaced][piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if not self.by_piece or any(s in text for s in self.special):
            return np.array(self.whole(text), dtype=self.kind)
        cut = text.split(" ")
        head = cut.pop(0)
        found = list(map(self.known[1].get, cut))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    if not cut[i] or cut[i][0].isspace():  # white space on both sides of a cut
                        head, *cut = _INNER.split(text)
                        found = [self.known[1].get(p) or self._learn(1, p) for p in cut]
                        break
                    found[i] = self.known[1].get(cut[i]) or self._learn(1, cut[i])
        first = (self.known[0].get(head) or self._learn(0, head)) if head else b""
        return np.frombuffer(first + b"".join(found), dtype=self.kind)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def put(uri: str, data: bytes) -> None:
    """Write to the shared folder under another name and move: a file is whole or not there."""
    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(f"{path}.part") as out:
        out.write(data)
    where.move(f"{path}.part", path)


def get(uri: str) -> bytes:
    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    with where.open_input_file(path) as f:
        return f.read()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs' ids as files in folder; returns the files: part, k, path, n_docs, n_ids.

    Rows are dealt by ranges of (doc_id, hash of text), null ids first, and sorted within.
    A task that is run again writes files of other names; only those that its successful
    run returned are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, enc = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], encoder(tokenizer)
        end = np.array([end_id], dtype=enc.kind)
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        names: list[int | None] = []
        held, k = 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{k:05d}-{attempt}.pfr"
            valid = np.array([x is not None for x in names])
            put(path, pfor.encode(np.concatenate(ids), np.array(lengths), np.array([x or 0 for x in names], dtype=np.int64), valid))
            return pa.RecordBatch.from_pydict({"part": [part], "k": [k], "path": [path], "n_docs": [len(names)], "n_ids": [held]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = enc.encode(t.as_py())
                ids += [x, end]
                lengths.append(len(x) + 1)
                names.append(d)
                held += len(x) + 1
                if held >= FILE_IDS:
                    yield flush()
                    ids, lengths, names, held, k = [], [], [], 0, k + 1
        if names:
            yield flush()

    n = tasks_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    return materialize(rows.mapInArrow(run, "part int, k int, path string, n_docs long, n_ids long"), "tokenfiles")


def file_starts(files: DataFrame) -> DataFrame:
    """path, start (ids in all files before it, in the order of part and k): sums over groups of parts, then within a group."""
    some = files.withColumn("group", F.floor(F.col("part") / 512))
    groups = some.groupBy("group").agg(F.sum("n_ids").alias("ids"))
    groups = groups.select("group", (F.sum("ids").over(Window.orderBy("group")) - F.col("ids")).alias("first"))  # a row for 512 parts
    upto = F.sum("n_ids").over(Window.partitionBy("group").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("within", upto - F.col("n_ids")).join(groups, "group").select("path", (F.col("first") + F.col("within")).alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; only the number of files comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0), b.column(1), strict=True):
                got = pfor.read(get(path.as_py()))
                ends = got.ends
                begin = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(got.ids[x:y].astype("<u4").tobytes()) for x, y in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.doc_ids, mask=~got.valid), pa.array(begin + start.as_py()), pa.array(ends - begin), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = files.count()  # several files a task: a worker's start costs more than one of them
    tasks = max(1, min(n, max(-(-n // 8), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    table = materialize(file_starts(files), "filestarts").repartition(tasks)
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token files of docs (to a folder in the shared one, if none is named) and return what reading them back gives.

    Null and empty texts are the end id alone; rows of one doc_id stand by the hash of
    their texts, repeated rows each; null ids come first; other columns are ignored; an
    empty table gives no files and no rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, str(tokenizer), end_id))
