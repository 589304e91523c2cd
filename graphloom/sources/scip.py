"""Definitions of the index in the SCIP format (a public protocol buffer): one message a document, encoded on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unique_span

# Field numbers, names of languages and kinds of symbols of the format.
LANGUAGES = {"go": "Go", "typescript": "TypeScript", "javascript": "JavaScript", "vue": "Vue"}
FUNCTION, METHOD, DEFINITION, UTF8 = 17, 26, 1, 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    raw = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _name(text: str) -> str:
    """An identifier of a descriptor: plain if it may be, else between backticks."""
    return text if text and all(c.isalnum() and c.isascii() or c in "_+-$" for c in text) else "`" + text.replace("`", "``") + "`"


def descriptor(path: str, receiver: str | None, name: str) -> str:
    """A symbol of the format: the file as a namespace, a receiver as a type, a function or method."""
    owner = f"{_name(receiver.lstrip('*'))}#" if receiver else ""
    return f"scip-graphloom . . . {_name(path)}/{owner}{_name(name)}()."


def definitions(index) -> DataFrame:
    """path, language, name, receiver, description, line (from 0), first and last byte of the name on it; null bytes where the name is not once on its line."""
    texts = index.files.select("path", F.split("text", "\r?\n", -1).alias("lines"))
    met = index.symbols.join(texts, "path").withColumn("span", unique_span(F.get("lines", F.col("line_start") - 1), F.col("name")))
    return met.select("path", "language", "name", F.nullif("receiver", F.lit("")).alias("receiver"), "description", (F.col("line_start") - 1).alias("line"), "span.first", "span.last")


def _document(path: str, language: str, rows: list[dict]) -> bytes:
    out = _bytes(1, path)
    for r in rows:
        if r["first"] is not None:
            symbol = descriptor(path, r["receiver"], r["name"])
            place = b"".join(map(_varint, (r["line"], r["first"], r["last"])))
            out += _bytes(2, _bytes(1, place) + _bytes(2, symbol) + _number(3, DEFINITION))
    for r in rows:
        about = _bytes(1, descriptor(path, r["receiver"], r["name"])) + (_bytes(3, r["description"]) if r["description"] else b"")
        out += _bytes(3, about + _number(5, METHOD if r["receiver"] else FUNCTION) + _bytes(6, r["name"]))
    return out + _bytes(4, LANGUAGES.get(language, language)) + _number(6, UTF8)


def documents(index) -> DataFrame:
    """path, message: the document message of every file with symbols; a file's symbols are gathered, texts are not."""
    row: list[Column] = [F.col(c) for c in ("line", "first", "last", "name", "receiver", "description")]
    per = definitions(index).groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct(*row))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_document(p, lang, rows) for p, lang, rows in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.binary())], ["path", "message"])

    return per.mapInArrow(run, "path string, message binary")


def write_scip(index, target: str, root: str = "file:///") -> int:
    """Write the index as one file, document by document in the order of paths; returns their number."""
    tool = _bytes(1, "graphloom") + _bytes(2, "1")
    n = 0
    with open(target, "wb") as f:
        f.write(_bytes(1, _bytes(2, tool) + _bytes(3, root) + _number(4, UTF8)))
        for r in documents(index).orderBy("path").toLocalIterator(prefetchPartitions=True):
            f.write(_bytes(2, bytes(r.message)))
            n += 1
    return n


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message: numbers, or bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("a kind of field that the format does not use")


def inspect_scip(target: str) -> dict:
    """Counts of a file: documents, occurrences, symbols, and languages."""
    with open(target, "rb") as f:
        data = f.read()
    found = {"documents": 0, "occurrences": 0, "symbols": 0, "languages": {}}
    for field, value in fields(data):
        if field == 2:
            found["documents"] += 1
            for inner, x in fields(value):
                found["occurrences"] += inner == 2
                found["symbols"] += inner == 3
                if inner == 4:
                    found["languages"][x.decode()] = found["languages"].get(x.decode(), 0) + 1
    return found
