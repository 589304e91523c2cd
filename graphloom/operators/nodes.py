"""What a node of the graph stands for: its kind, file, symbol and line, from the grammar of its id and the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import Corpus


def describe(nodes: DataFrame, c: Corpus) -> DataFrame:
    """nodes (node_id and more) with kind, name, file_path, symbol_id, line; null where nothing is known of it.

    The id's first part is the kind, the rest the key of one table; each table is met by equality on its own key.
    """
    kind, key = F.substring_index("node_id", ":", 1), F.expr("substring(node_id, instr(node_id, ':') + 1)")
    known = nodes.select("node_id").distinct().select("node_id", kind.alias("kind"), key.alias("key"))
    symbols = c.symbols.select(F.col("symbol_id").alias("key"), F.col("qualified_name").alias("name"), "file_path", "symbol_id", F.col("line_start").alias("line"))
    line = lambda df: F.col("line") if "line" in df.columns else F.lit(None).cast("int")
    entries = c.entries.groupBy("node_id").agg(F.min(F.struct("entry_name", "file_path", line(c.entries).alias("line"))).alias("e"))
    entries = entries.select("node_id", F.col("e.entry_name").alias("name"), F.col("e.file_path").alias("file_path"), F.lit(None).cast("string").alias("symbol_id"), F.col("e.line").alias("line"))
    routes = c.routes.select(F.concat_ws(":", F.lit("route"), "direction", "method", "route_path").alias("node_id"), F.struct("file_path", line(c.routes).alias("line"), F.concat_ws(" ", "method", "route_path").alias("name"), "symbol_id").alias("r"))
    routes = routes.groupBy("node_id").agg(F.min("r").alias("r")).select("node_id", "r.name", "r.file_path", "r.symbol_id", "r.line")
    none = F.lit(None).cast("string")
    own = known.filter("kind not in ('symbol', 'entry', 'route')")
    own = own.select("node_id", "kind", F.when(F.col("kind") == "db", F.expr("substring(key, instr(key, ':') + 1)")).otherwise(F.col("key")).alias("name"), F.when(F.col("kind") == "file", F.col("key")).alias("file_path"), none.alias("symbol_id"), F.lit(None).cast("int").alias("line"))
    parts = [own]
    for k, table, on in (("symbol", symbols, "key"), ("entry", entries, "node_id"), ("route", routes, "node_id")):
        parts.append(known.filter(F.col("kind") == k).join(table, on, "left").select("node_id", "kind", "name", "file_path", F.coalesce("symbol_id", "key").alias("symbol_id") if k == "symbol" else F.col("symbol_id"), F.col("line").cast("int").alias("line")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return nodes.join(found, "node_id")
