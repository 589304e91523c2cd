"""The whole answer to a task: lexical channels, graph expansion, neighbours, tests, reserved places, coverage."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.query import Expansion, expand_query
from . import retrieve as r
from .cut import cut
from .nodes import describe
from .traverse import bridge_degree, traverse

# Edge types that a question follows, and bounds of its walks.
FORWARD = ("entry_handler", "page_api", "api_request", "route_handler", "call", "db_read", "db_write")
REVERSE = (*FORWARD, "test_of")
MAX_SEEDS, MAX_IMPORT_SEEDS, MAX_SEED_SYMBOLS, MAX_TESTED, MAX_MUST, MAX_SYMBOLS = 12, 8, 30, 10, 8, 32


@dataclass
class Answer:
    """files: every candidate (path, score, final, channels, reasons, symbols); selected and the rest are what a reader gets."""

    task: str
    expansion: Expansion
    files: DataFrame
    selected: list[dict]
    coverage: dict
    features: list[dict]
    symbols: list[dict]
    seeds: list[str]
    graph: dict = field(default_factory=dict)

    def paths(self, bucket: str) -> list[str]:
        return [f["path"] for f in self.selected if f["bucket"] == bucket]

    def held(self, *kinds: str) -> list[str]:
        return [f["path"] for f in self.selected if f["held_for"] and (not kinds or f["held_for"] in kinds)]


def _best(files: DataFrame, score: Column, n: int) -> DataFrame:
    return files.withColumn("_s", score).filter("_s > 0").orderBy(F.desc("_s"), F.desc("score"), F.collate("path", "UNICODE"), "path").limit(n)


def graph_seeds(files: DataFrame, facts: DataFrame, c: r.Corpus) -> list[str]:
    """Nodes to walk from, MAX_SEEDS at most: two symbols, two entries, two routes, five data objects, an object's user, two files.

    Each kind is a top-k of its own. Data objects go by how many certain readers and writers they join.
    """
    code = cut(files.join(c.files.filter(~F.col("is_test")).select("path"), "path", "left_semi"))

    def symbols(channel: str, n: int) -> DataFrame:
        best = _best(code.filter(F.size("symbols") > 0), F.col("channels")[channel], n)
        one = best.select(F.col("_s"), "score", "path", F.posexplode("symbols").alias("pos", "symbol"))
        return one.orderBy(F.desc("_s"), F.desc("score"), F.collate("path", "UNICODE"), "pos").limit(n).select(F.concat(F.lit("symbol:"), "symbol").alias("node_id"))

    def nodes(channel: str) -> DataFrame:
        return facts.filter(F.col("channel") == channel).select("path", "node_id").distinct().orderBy(F.collate("path", "UNICODE"), "node_id").limit(2).select("node_id")

    objects = facts.filter("channel = 'db'").groupBy("node_id").agg(F.max("score").alias("score"))
    objects = objects.join(bridge_degree(c.edges, ("db_read", "db_write")), "node_id", "left").na.fill(0, ["bridge_degree"])
    objects = objects.orderBy(F.desc("bridge_degree"), F.desc("score"), F.collate("node_id", "UNICODE"), "node_id").limit(5).select("node_id")
    overall = _best(code, F.col("score"), 2).select(F.concat(F.lit("file:"), "path").alias("node_id"))
    parts = [symbols("symbol", 2), nodes("entry"), nodes("route"), objects, symbols("db", 1), overall]
    tagged = [p.select("node_id", F.lit(n).alias("part"), F.monotonically_increasing_id().alias("place")) for n, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged).orderBy("part", "place").collect()  # 14 at most
    return list(dict.fromkeys(x.node_id for x in rows))[:MAX_SEEDS]


def graph_hits(c: r.Corpus, seeds: list[str], direction: str) -> tuple[DataFrame, int]:
    """Files of the nodes reached from each seed, fewer hops counting more, and the number of steps."""
    spark = c.edges.sparkSession
    starts = spark.createDataFrame([(s, s) for s in seeds], "flow_id string, node_id string")
    walk = traverse(c.edges, starts, direction=direction, max_hops=6, branch_limit=12, node_limit=96, edge_types=FORWARD if direction == "forward" else REVERSE)
    by = walk.steps.select("flow_id", F.col("target").alias("node_id"), "type")
    met = describe(walk.visited.filter("node_id <> flow_id").join(by, ["flow_id", "node_id"], "left"), c)
    score = F.greatest(F.lit(2), F.lit(10 if direction == "forward" else 8) - F.greatest(F.lit(0), F.col("hop") - 1) * 2)
    reason = F.concat(F.lit(f"graph_{direction}:"), F.coalesce("type", F.lit("typed_edge")))
    return r.hits(met, F.col("file_path"), "typed_graph", score, reason, 10, F.col("symbol_id")), walk.steps.count()


def import_hits(c: r.Corpus, files: list[str]) -> tuple[DataFrame, int]:
    """Files that import one of these (MAX_IMPORT_SEEDS at most), tests left out."""
    starts = c.edges.sparkSession.createDataFrame([(f"file:{p}",) * 2 for p in files], "flow_id string, node_id string")
    walk = traverse(c.edges, starts, direction="reverse", max_hops=1, branch_limit=8, node_limit=32, edge_types=("import",))
    code = c.files.filter(~F.col("is_test")).select(F.col("path").alias("file_path"))
    met = describe(walk.visited.filter("node_id <> flow_id"), c).join(code, "file_path", "left_semi")
    return r.hits(met, F.col("file_path"), "typed_graph", F.lit(6.0), F.lit("graph_reverse:import"), 10, F.col("symbol_id")), walk.steps.count()


def ask(c: r.Corpus, task: str, aliases: dict | None = None, limit: int = 12) -> Answer:
    """Files that matter for a task.

    Channels score candidates; walks from the best of them, their neighbours and their tests add more. All candidates stay
    distributed; only seeds (12), seed symbols (30), tested files (10) and the pool of the selection come to the driver.
    """
    limit = max(1, limit)
    e = expand_query(task, aliases)
    features = r.feature_scores(c.features, e)
    top_features = [x.asDict() for x in features.select("feature_id", "name", "description", "status", "needs_review", "score", "invariants").collect()]  # three
    scored = cut(r.symbol_scores(c.symbols, e).select("symbol_id", "file_path", "score"))
    best_symbols = scored.orderBy(F.desc("score"), F.collate("file_path", "UNICODE"), "symbol_id").limit(r.TOP_SYMBOLS)
    facts = cut(r.fact_hits(c, e))
    lexical = r.feature_hits(features, c.symbols).unionByName(r.hits(best_symbols, F.col("file_path"), "symbol", F.col("score"), F.lit("symbol_match"), 2, F.col("symbol_id")))
    lexical = cut(lexical.unionByName(facts.drop("node_id")).unionByName(r.path_hits(c.files, e, task)))

    files = cut(r.file_scores(lexical))
    seeds = graph_seeds(files, facts, c)
    graph = {"forward_steps": 0, "reverse_steps": 0, "import_reverse_steps": 0, "added_files": 0}
    rows = lexical
    if seeds:
        found = []
        for direction in ("forward", "reverse"):
            hit, graph[f"{direction}_steps"] = graph_hits(c, seeds, direction)
            found.append(hit)
        walked = cut(reduce(DataFrame.unionByName, found))
        added = r.file_scores(walked.join(files.select("path"), "path", "left_anti"))
        code = added.join(c.files.filter(~F.col("is_test")).select("path"), "path", "left_semi")
        near = text.text_score(F.col("path"), e.of("builtin"), 1)
        imports = [x.path for x in code.orderBy(F.desc(near), F.desc("score"), F.collate("path", "UNICODE"), "path").limit(MAX_IMPORT_SEEDS).collect()]
        rows = rows.unionByName(walked)
        if imports:
            hit, graph["import_reverse_steps"] = import_hits(c, imports)
            rows = rows.unionByName(hit)
        rows = cut(rows)
        graph["added_files"] = rows.select("path").distinct().join(files.select("path"), "path", "left_anti").count()
    if e.of("builtin"):
        boost = F.least(F.lit(16.0), text.text_score(F.col("path"), e.of("builtin"), 8))
        rows = rows.unionByName(r.hits(rows.select("path").distinct(), F.col("path"), "intent", boost, F.lit("intent_path_match"), 11))
    first = lexical.filter("symbol is not null").groupBy("symbol").agg(F.min(F.struct("seq", F.negative("score"), "path")).alias("at"))
    mine = [x.symbol for x in first.orderBy("at", "symbol").limit(MAX_SEED_SYMBOLS).collect()]
    rows = cut(rows.unionByName(r.neighbour_hits(c.deps, c.symbols, mine)))
    early = [x.path for x in r.file_scores(rows).orderBy(F.desc("score"), F.collate("path", "UNICODE"), "path").limit(MAX_TESTED).collect()]
    scores = r.file_scores(rows.unionByName(r.test_hits(c.tests, c.symbols, early)))
    ranked = cut(scores.withColumn("final", F.col("score") * paths.path_multiplier(F.col("path"), e.terms)).join(c.files.select("path", "is_test"), "path", "left"))
    selected = select_files(ranked, e, limit)
    n = ranked.count()
    strong = scored.filter(F.col("score") >= r.STRONG).count()
    doubt = c.failed > 0 or any(f["status"] != "valid" or f["needs_review"] for f in top_features)
    status = "insufficient" if not n else "review_required" if doubt else "broad" if n > max(60, 5 * limit) or strong > 250 else "sufficient"
    coverage = {"candidate_files": n, "selected_files": len(selected), "exact_feature_hits": len(top_features), "strong_symbol_hits": strong, "status": status}
    wanted = c.symbols.filter(F.col("file_path").isin(*[f["path"] for f in selected]) | F.col("symbol_id").isin(*[s for f in selected for s in f["symbols"]])) if selected else c.symbols.limit(0)
    shown = wanted.join(scored.select("symbol_id", "score"), "symbol_id", "left").orderBy("file_path", "line_start", "symbol_id").limit(MAX_SYMBOLS)
    details = [x.asDict() for x in shown.select("symbol_id", "qualified_name", "file_path", "line_start", "line_end", "signature", "description", F.round(F.coalesce("score", F.lit(0.0)), 2).alias("score")).collect()]
    return Answer(task, e, ranked, selected, coverage, top_features, details, seeds, graph)


def select_files(ranked: DataFrame, e: Expansion, limit: int) -> list[dict]:
    """The selected files in rank order with bucket (must_read, maybe_read or tests) and what their place is held for.

    Code with a place held for developers' words comes first among what must be read, then that held for manifests.
    """
    groups = r.intent_groups(e)
    rows = [x.asDict() for x in r.pool(ranked, groups, limit).select("path", "final", "is_test", "reasons", "symbols", "places").collect()]
    chosen, held = r.reserve(rows, groups, limit)
    out = [{"path": rows[i]["path"], "score": round(rows[i]["final"], 2), "reasons": rows[i]["reasons"], "symbols": rows[i]["symbols"], "is_test": bool(rows[i]["is_test"]), "held_for": held.get(i)} for i in chosen]
    first = {"developer": 0, "manifest": 1}
    code = sorted((f for f in out if not f["is_test"]), key=lambda f: first.get(f["held_for"], 2))
    for n, f in enumerate(code):
        f["bucket"] = "must_read" if n < MAX_MUST else "maybe_read"
    tests = [f | {"bucket": "tests"} for f in out if f["is_test"]]
    return code + tests


def full(a: Answer) -> dict:
    """The answer as one object."""
    shown = lambda bucket: [{k: f[k] for k in ("path", "score", "reasons", "symbols")} for f in a.selected if f["bucket"] == bucket]
    project = a.expansion.of("project")
    return {
        "ok": True,
        "task": a.task,
        "terms": a.expansion.terms,
        "query_expansion": {
            "applied_aliases": [{"source": x.source, "key": x.key, "aliases": list(x.values)} for x in a.expansion.applied],
            "project_terms": project,
            "retrieval_mode": "project_anchor" if project else "lexical",
            "graph_seed_nodes": a.seeds,
        },
        "graph_expansion": a.graph,
        "selection": {"intent_reserved_files": a.held(), "manifest_reserved_files": a.held("manifest"), "test_reserved_files": a.held("test")},
        "features": a.features,
        "must_read": shown("must_read"),
        "maybe_read": shown("maybe_read"),
        "symbols": a.symbols,
        "tests": a.paths("tests"),
        "coverage": a.coverage,
        "semantic_refinement_recommended": a.coverage["status"] in ("insufficient", "broad"),
    }


def compact(a: Answer) -> dict:
    """What an agent needs of it: paths, scores and a few names of symbols."""

    def files(bucket: str, most: int) -> list[dict]:
        names = lambda f: list(dict.fromkeys(s.split("::", 1)[-1] for s in f["symbols"] if s))[:most]
        return [{"path": f["path"], "score": f["score"], "symbols": names(f)} for f in a.selected if f["bucket"] == bucket]

    whole = full(a)
    return {
        "ok": True,
        "task": a.task,
        "coverage": {k: a.coverage[k] for k in ("status", "candidate_files", "selected_files")},
        "retrieval_mode": whole["query_expansion"]["retrieval_mode"],
        "must_read": files("must_read", 6),
        "maybe_read": files("maybe_read", 3),
        "tests": whole["tests"],
        "semantic_refinement_recommended": whole["semantic_refinement_recommended"],
    }


def to_json(a: Answer, *, short: bool = False) -> str:
    return json.dumps(compact(a), ensure_ascii=False, separators=(",", ":")) if short else json.dumps(full(a), ensure_ascii=False, indent=2)
