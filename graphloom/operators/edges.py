"""Edge builders: facts to typed edges (from_node_id, to_node_id, type, confidence, evidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.facts import DB_EDGE


def _node(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def _owner(symbol: str, file: str) -> Column:
    return F.coalesce(_node("symbol", F.col(symbol)), _node("file", F.col(file)))


EVIDENCE = ("resolution", "file_path", "line", "operation", "reference")


def evidence(rows: DataFrame, **given: Column) -> Column:
    """What an edge rests on: the columns of EVIDENCE that rows has, or that are given; null for the others."""
    kinds = {"line": "int"}
    own = lambda c: given.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
    return F.struct(*[own(c) for c in EVIDENCE]).alias("evidence")


def with_id(edges: DataFrame) -> DataFrame:
    """edges with an id that depends on their ends, type and confidence alone, once each; of several pieces of evidence the first stays."""
    key = F.sha2(F.to_json(F.struct("confidence", "from_node_id", "to_node_id", "type")), 256)
    ends = ["from_node_id", "to_node_id", "type", "confidence"]
    once = edges.groupBy(*ends).agg(F.min("evidence").alias("evidence")) if "evidence" in edges.columns else edges.select(*ends).distinct()
    return once.withColumn("edge_id", F.substring(key, 1, 24))


def dependency_edges(deps: DataFrame) -> DataFrame:
    """deps: relation (calls, imports), from_symbol_id, from_file, to_ref, to_file, resolved_symbol_id."""
    kind = F.when(F.col("relation") == "calls", "call").otherwise("import")
    to = F.coalesce(_node("symbol", F.col("resolved_symbol_id")), F.when(kind == "import", _node("file", F.col("to_file"))), F.concat(F.lit("ref:"), kind, F.lit(":"), F.col("to_ref")))
    sure = F.col("resolved_symbol_id").isNotNull() | ((kind == "import") & F.col("to_file").isNotNull())
    return deps.select(_owner("from_symbol_id", "from_file").alias("from_node_id"), to.alias("to_node_id"), kind.alias("type"), F.when(sure, "static").otherwise("unresolved").alias("confidence"), evidence(deps, file_path=F.col("from_file"), reference=F.col("to_ref")))


def db_edges(objects: DataFrame) -> DataFrame:
    """objects: symbol_id, node_id or file_path, object_type, object_name, operation; other operations give no edge."""
    pairs = [F.lit(x) for kv in DB_EDGE.items() for x in kv]
    kind = F.create_map(*pairs)[F.col("operation")]
    start = F.coalesce(_node("symbol", F.col("symbol_id")), F.col("node_id") if "node_id" in objects.columns else _node("file", F.col("file_path")))
    out = objects.select(start.alias("from_node_id"), F.concat_ws(":", F.lit("db"), "object_type", "object_name").alias("to_node_id"), kind.alias("type"), F.lit("static").alias("confidence"), evidence(objects, reference=F.col("object_name")))
    return out.filter("type is not null")


def test_edges(tests: DataFrame) -> DataFrame:
    """tests: test_file, target_file, target_symbol_id, reason."""
    calls = (F.col("reason") == "test_calls_symbol") & F.col("target_symbol_id").isNotNull()
    to = F.coalesce(_node("symbol", F.col("target_symbol_id")), _node("file", F.col("target_file")))
    return tests.select(_node("file", F.col("test_file")).alias("from_node_id"), to.alias("to_node_id"), F.lit("test_of").alias("type"), F.when(calls, "static").otherwise("inferred").alias("confidence"), evidence(tests, resolution=F.col("reason"), file_path=F.col("test_file")))


def request_edges(client: DataFrame, matched: DataFrame, server: DataFrame) -> DataFrame:
    """client (id, symbol_id, file_path, method, route_path) with what match_routes found, to route nodes."""
    routes = server.select("route_id", F.concat_ws(":", F.lit("route:server"), "method", "route_path").alias("node"))
    met = client.join(matched, "id", "left").join(routes, "route_id", "left")
    ref = F.concat(F.lit("ref:api_request:"), "method", F.lit(" "), "route_path")
    sure = F.col("node").isNotNull()
    return met.select(_owner("symbol_id", "file_path").alias("from_node_id"), F.coalesce("node", ref).alias("to_node_id"), F.lit("api_request").alias("type"), F.when(sure, "static").otherwise("unresolved").alias("confidence"), evidence(met, reference=F.concat_ws(" ", "method", "route_path")))


def handler_edges(kind: str, starts: DataFrame) -> DataFrame:
    """starts: node_id, handler_ref, handler_symbol_id (null: unresolved) of routes or entries."""
    to = F.coalesce(_node("symbol", F.col("handler_symbol_id")), F.concat(F.lit(f"ref:{kind}:"), F.coalesce("handler_ref", F.lit(""))))
    sure = F.col("handler_symbol_id").isNotNull()
    return starts.select(F.col("node_id").alias("from_node_id"), to.alias("to_node_id"), F.lit(kind).alias("type"), F.when(sure, "static").otherwise("unresolved").alias("confidence"), evidence(starts, reference=F.col("handler_ref")))
