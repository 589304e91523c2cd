"""Command line: index a tree, ask for files, walk the graph, export."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import store
from .index import Index, build_index, corpus_of
from .operators import ask as asking
from .operators import traverse
from .sources import corpus, export


def flow(index: Index, starts: list[str], **options) -> traverse.Traversal:
    """A walk from each start (32 at most)."""
    if len(starts) > 32:
        raise ValueError("32 starts at most")
    spark = index.edges.sparkSession
    rows = spark.createDataFrame([(s, s) for s in starts], "flow_id string, node_id string")
    return traverse.traverse(index.edges.select("edge_id", F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), "type", "confidence"), rows, **options)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=("index", "status", "query", "flow", "locate", "export", "graph-html", "review-feature"))
    p.add_argument("repo")
    p.add_argument("what", nargs="*", help="a task, start nodes, a node, the target, or a feature and a note")
    p.add_argument("--index", default=None, help="folder of the stored index (default: .graphloom in the repository)")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--limit", type=int, default=12)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    where = a.index or os.path.join(os.path.realpath(a.repo), ".graphloom")
    if a.command == "index":
        print(json.dumps(store.refresh(spark, corpus.working_tree(spark, a.repo), where, meta={"head": corpus.git_head(a.repo) or ""}, features=corpus.feature_definitions(spark, f"{a.repo}/.context-features"))))
        return
    if a.command == "status":
        print(json.dumps(store.status(spark, corpus.working_tree(spark, a.repo), where), indent=2))
        return
    if a.command == "review-feature":
        print(json.dumps(store.review_feature(spark, where, a.what[0], " ".join(a.what[1:]) or None)))
        return
    index = store.load(spark, where) if store.exists(spark, where) else build_index(corpus.working_tree(spark, a.repo))
    if a.command == "query":
        features = store.features_of(spark, where) if store.exists(spark, where) else None
        found = asking.ask(corpus_of(index, features), " ".join(a.what), corpus.project_aliases(f"{a.repo}/.context-query-aliases.json"), a.limit)
        print(asking.to_json(found, short=a.compact))
    elif a.command == "flow":
        flow(index, a.what).steps.orderBy("flow_id", "visit").show(200, False)
    elif a.command == "locate":
        export.locate(export.public_nodes(index), a.what[0]).show(50, False)
    elif a.command == "export":
        print(export.export_public(index, a.what[0]))
    else:
        with open(a.what[0], "w", encoding="utf-8") as f:
            f.write(export.graph_html(export.public_nodes(index), export.public_edges(index)))


if __name__ == "__main__":
    main()
