"""Sinks: JSON lines of an index, the public index, a graph page."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import traverse
from ..operators.cut import cut
from ..operators.spread import IDS, spread

PUBLIC_VERSION = "1.0.0"


def public_nodes(index) -> DataFrame:
    """id, kind, attributes of documents, symbols, routes, entries, data objects and whatever else edges end at; routes and objects with where they were seen."""
    attrs = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    c = F.col
    seen = lambda *cols: F.to_json(F.array_sort(F.collect_set(F.struct(*cols))))
    routes = index.routes.filter("direction = 'server'").groupBy("method", "route_path").agg(F.min(F.struct("file_path", "line")).alias("at"), seen("file_path", "line").alias("seen"))
    objects = index.objects.groupBy("object_type", "object_name").agg(F.min(F.struct("file_path", "line")).alias("at"), seen("file_path", "line", "operation").alias("seen"))
    parts = [
        index.files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("document").alias("kind"), attrs(path=c("path"), language=c("language"), content_hash=c("content_hash")).alias("attributes")),
        index.symbols.select(F.concat(F.lit("symbol:"), "symbol_id").alias("id"), F.lit("symbol").alias("kind"), attrs(name=c("name"), path=c("path"), line_start=c("line_start"), line_end=c("line_end")).alias("attributes")),
        routes.select(F.concat_ws(":", F.lit("route:server"), "method", "route_path").alias("id"), F.lit("route").alias("kind"), attrs(method=c("method"), route_path=c("route_path"), path=c("at.file_path"), line_start=c("at.line"), observations=c("seen")).alias("attributes")),
        index.entries.groupBy("node_id").agg(F.min(F.struct("entry_kind", "entry_name", "file_path", "line")).alias("e")).select(c("node_id").alias("id"), F.lit("entry").alias("kind"), attrs(entry_kind=c("e.entry_kind"), name=c("e.entry_name"), path=c("e.file_path"), line_start=c("e.line")).alias("attributes")),
        objects.select(F.concat_ws(":", F.lit("db"), "object_type", "object_name").alias("id"), F.lit("data_object").alias("kind"), attrs(name=c("object_name"), path=c("at.file_path"), line_start=c("at.line"), observations=c("seen")).alias("attributes")),
    ]
    known = parts[0]
    for p in parts[1:]:
        known = known.unionByName(p)
    ends = spread(index.edges.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id")), IDS, "id").distinct().join(known.select("id"), "id", "left_anti")
    return known.unionByName(ends.select("id", F.lit("reference").alias("kind"), F.create_map().cast("map<string,string>").alias("attributes")))


def public_edges(index) -> DataFrame:
    """id, type, from, to, confidence, and the evidence that is known."""
    proof = F.col("evidence") if "evidence" in index.edges.columns else F.lit(None).cast("struct<resolution:string>")
    return index.edges.select(F.col("edge_id").alias("id"), "type", F.col("from_node_id").alias("from"), F.col("to_node_id").alias("to"), "confidence", proof.alias("evidence"))


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """Sorted JSON lines (as many files as the range sort makes), nulls written."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _publish(spark, parts: dict[str, tuple[DataFrame, tuple[str, ...]]], folder: str, manifest: dict) -> dict:
    """Write the parts and then the manifest to a folder aside, and move it to its place when it is whole."""
    aside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    counts = {}
    for name, (df, order) in parts.items():
        write_json(df, f"{aside}/{name}", *order)
        counts[name] = spark.read.text(f"{aside}/{name}").count()
    manifest = manifest | {"counts": counts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{aside}/manifest")
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(aside), hadoop.Path(folder)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{aside} could not be moved to {folder}")
    return manifest


def export_public(index, folder: str) -> dict:
    """nodes, edges and a manifest of their counts; readers need no more."""
    parts = {"nodes": (public_nodes(index), ("id",)), "edges": (public_edges(index), ("id",))}
    return _publish(index.files.sparkSession, parts, folder, {"version": PUBLIC_VERSION})


#: The order of each table of a whole export.
TABLES = {
    "files": ("path",), "symbols": ("symbol_id",), "dependencies": ("from_file", "relation", "to_ref"), "edges": ("edge_id",), "entries": ("node_id",),
    "routes": ("file_path", "line", "method", "route_path"), "objects": ("file_path", "line", "object_name", "operation"), "tests": ("test_file", "target_file", "target_symbol_id"),
}


def export_index(index, folder: str, features: DataFrame | None = None, events: DataFrame | None = None) -> dict:
    """Every table of the index as sorted JSON lines (texts left out), features and change events if they are given, and a manifest of
    counts, parser versions and states of features."""
    spark = index.files.sparkSession
    parts = {name: (getattr(index, name).drop("text"), order) for name, order in TABLES.items()}
    manifest = {"version": PUBLIC_VERSION, "parser_versions": {r.parser_version: r["count"] for r in index.files.groupBy("parser_version").count().orderBy("parser_version").collect()}}
    if features is not None:
        parts["features"] = (features, ("feature_id",))
        manifest["feature_status"] = {r.status: r["count"] for r in features.groupBy("status").count().collect()}
    if events is not None:
        parts["change_events"] = (events, ("indexed_at", "kind", "file_path", "symbol_id"))
    return _publish(spark, parts, folder, manifest)


#: What a reader must find in each row.
REQUIRED = {"nodes": ("id", "kind", "attributes"), "edges": ("id", "type", "from", "to", "confidence")}


def check_public(spark, folder: str) -> DataFrame:
    """part, problem, n of a written public index: rows that are no JSON or lack what is required, ids that repeat, ends without a node, counts
    that differ from the manifest; no rows if it is whole. More fields than these are no problem."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    if manifest.get("version", "").split(".")[0] != PUBLIC_VERSION.split(".")[0]:
        raise ValueError(f"version {manifest.get('version')} can't be read")
    found, ids = [], {}
    for name, fields in REQUIRED.items():
        raw = spark.read.text(f"{folder}/{name}")
        got = F.from_json("value", "map<string,string>")
        bad = F.when(got.isNull(), "no_json").when(F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), F.map_keys(F.map_filter(got, lambda _, v: v.isNotNull())))) > 0, "missing_field")
        found.append(raw.select(F.lit(name).alias("part"), bad.alias("problem")).filter("problem is not null"))
        ids[name] = raw.select(*[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])
        found.append(ids[name].groupBy("id").count().filter("count > 1").select(F.lit(name).alias("part"), F.lit("repeated_id").alias("problem")))
    ends = ids["edges"].select(F.explode(F.array("from", "to")).alias("id")).join(ids["nodes"].select("id"), "id", "left_anti")
    found.append(ends.select(F.lit("edges").alias("part"), F.lit("end_without_node").alias("problem")))
    rows = [(name, manifest["counts"].get(name)) for name in REQUIRED]
    counts = spark.createDataFrame(rows, "part string, said long")
    for name in REQUIRED:
        n = ids[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        found.append(n.join(counts, "part").filter("not n <=> said").select("part", F.lit("count_differs").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("part", "problem").agg(F.count("*").alias("n"))


#: Kinds in the order in which nodes of one degree are shown.
KINDS = ("entry", "route", "symbol", "data_object", "document", "reference")
LABELS = {"document": "path", "symbol": "name", "entry": "name", "data_object": "name"}


def node_label(kind: Column, node_id: Column, attributes: Column) -> Column:
    """What a node is called in a picture: its name, a route's method and path, else its id behind the kind."""
    named = F.coalesce(*[F.when(kind == k, attributes[a]) for k, a in LABELS.items()])
    return F.coalesce(named, F.when(kind == "route", F.concat_ws(" ", attributes["method"], attributes["route_path"])), F.regexp_replace(node_id, "^[^:]*:", ""))


def view_nodes(nodes: DataFrame, edges: DataFrame, limit: int, focus: str | None = None, hops: int = 3) -> DataFrame:
    """The nodes of a picture: those of highest degree, or those within `hops` of focus in either direction, the nearest first."""
    ends = edges.select(F.col("from").alias("src"), F.col("to").alias("dst"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(len(KINDS) + 1))
    known = nodes.join(traverse.node_degree(ends), nodes["id"] == F.col("node_id"), "left").drop("node_id").na.fill(0, ["degree"])
    if focus is None:
        return known.orderBy(F.desc("degree"), rank, "id").limit(limit)
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = nodes.filter(F.col("id") == focus).select("id", F.lit(0).alias("hop"))
    level = seen
    for hop in range(1, hops + 1):
        step = both.join(level.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        level = cut(step.orderBy("id").limit(limit).withColumn("hop", F.lit(hop)))
        seen = cut(seen.unionByName(level))
    return known.join(seen, "id").orderBy("hop", F.desc("degree"), rank, "id").limit(limit)


def graph_html(nodes: DataFrame, edges: DataFrame, limit: int = 250, focus: str | None = None, hops: int = 3) -> str:
    """A page with the nodes of view_nodes (1000 at most) and the edges between them, as inline SVG without any script."""
    if not 1 <= limit <= 1000 or not 1 <= hops <= 6:
        raise ValueError("limit is 1 to 1000, hops 1 to 6")
    top = cut(view_nodes(nodes, edges, limit, focus, hops).withColumn("label", node_label(F.col("kind"), F.col("id"), F.col("attributes"))))
    placed = traverse.layout(top.select(F.col("id").alias("node_id"), "kind"))
    shown = {r.id: r.label for r in top.select("id", "label").collect()}  # `limit` rows
    at = {r.node_id: (r.x, r.y, r.kind) for r in placed.collect()}
    ids = top.select(F.col("id").alias("node_id"))
    links = edges.join(ids, F.col("from") == F.col("node_id"), "left_semi").join(ids, F.col("to") == F.col("node_id"), "left_semi")
    most = min(8000, 12 * limit)
    lines = [(r["from"], r["to"]) for r in links.select("from", "to").distinct().orderBy("from", "to").limit(most).collect()]
    marks = [f'<line x1="{at[a][0]}" y1="{at[a][1]}" x2="{at[b][0]}" y2="{at[b][1]}"/>' for a, b in lines]
    marks += [f'<text x="{x}" y="{y}"><title>{html.escape(n)}</title>{html.escape(shown[n][-32:])}</text>' for n, (x, y, _) in sorted(at.items())]
    policy = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\">"
    return f"<!doctype html><meta charset=utf-8>{policy}<title>graph</title><style>line{{stroke:#999}}text{{font:11px sans-serif}}</style><svg viewBox='-20 -20 2400 4000'>{''.join(marks)}</svg>"


def locate(nodes: DataFrame, node_id: str, root: str | None = None) -> DataFrame:
    """path, line and addresses of a node's places: where it stands, and where a route or a data object was seen.

    With the root of the tree addresses are absolute, with one for editors; without it they are relative.
    """
    own = F.array(F.struct(F.col("attributes")["path"].alias("file_path"), F.coalesce(F.col("attributes")["line_start"].cast("int"), F.lit(1)).alias("line")))
    seen = F.from_json(F.col("attributes")["observations"], "array<struct<file_path:string,line:int>>")
    rows = nodes.filter(F.col("id") == node_id).select(F.explode(F.concat(own, F.coalesce(seen, F.array().cast("array<struct<file_path:string,line:int>>")))).alias("p"))
    rows = rows.select(F.col("p.file_path").alias("path"), F.coalesce("p.line", F.lit(1)).alias("line")).filter("path is not null").distinct()
    full = F.col("path") if root is None else F.concat(F.lit(root.rstrip("/") + "/"), "path")
    head = "file:" if root is None else "file://"
    out = rows.withColumn("address", F.concat(F.lit(head), full, F.lit("#L"), F.col("line").cast("string")))
    if root is not None:
        out = out.withColumn("editor", F.concat(F.lit("vscode://file"), full, F.lit(":"), F.col("line").cast("string")))
    return out.orderBy("path", "line")
