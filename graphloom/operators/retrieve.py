"""Ranked retrieval: candidates of channels to files, reservations, coverage, rerank, evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.query import TEST_KEYS, Expansion, surface_intents


def file_scores(candidates: DataFrame) -> DataFrame:
    """path, score, channels, reasons, symbols of candidates (path, channel, score, reason, symbol, seq).

    A channel counts with its best score, a file with the sum of its channels; reasons stand as first seen.
    Both steps are plain aggregates, combined before the shuffle.
    """
    per = candidates.groupBy("path", "channel").agg(F.max("score").alias("score"), F.collect_set(F.struct("seq", "reason")).alias("rs"), F.collect_set("symbol").alias("ss"))
    out = per.groupBy("path").agg(F.sum("score").alias("score"), F.map_from_entries(F.collect_list(F.struct("channel", "score"))).alias("channels"), F.array_sort(F.flatten(F.collect_list("rs"))).alias("rs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ss")))).alias("symbols"))
    return out.select("path", "score", "channels", F.array_distinct(F.transform("rs", lambda r: r["reason"])).alias("reasons"), "symbols")


def rank_files(scores: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The best files by score times the path's multiplier (ties by path), with their rank."""
    final = F.col("score") * paths.path_multiplier(F.col("path"), terms)
    top = scores.withColumn("final", final).orderBy(F.desc("final"), F.collate("path", "UNICODE"), "path").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), F.collate("path", "UNICODE"), "path")))  # `limit` rows


# Weights of a term's hits by field, for a project's own terms and for all terms.
SYMBOL_WEIGHTS = {"name": (36, 14), "qualified_name": (30, 12), "file_path": (20, 6), "description": (12, 7), "signature": (0, 5)}
FEATURE_WEIGHTS = {"name": 12, "description": 8, "invariants": 5, "steps": 5}
#: (text of a fact, weight of all terms, weight of a project's own)
ENTRY_WEIGHTS, ROUTE_WEIGHTS, OBJECT_WEIGHTS = (11, 24), (10, 24), (8, 18)
TOP_SYMBOLS, TOP_FEATURES, STRONG = 20, 3, 20
TEST_PREVIEW = 24_576


@dataclass
class Corpus:
    """What a question is asked of. Edges: edge_id, src, dst, type, confidence; other tables as their columns say.

    files: path, is_test, text. symbols: symbol_id, file_path, name, qualified_name, description, signature, line_start, line_end.
    routes: file_path, direction, method, route_path, symbol_id. objects: file_path, object_type, object_name, operation, symbol_id.
    entries: node_id, file_path, entry_kind, entry_name, handler_ref, handler_symbol_id, symbol_id. deps: from_symbol_id, from_file,
    resolved_symbol_id. tests: test_file, target_file, target_symbol_id. features: feature_id, name, description, status, needs_review,
    invariants (array), steps (array of action, symbol_id, file_path).
    """

    files: DataFrame
    symbols: DataFrame
    routes: DataFrame
    objects: DataFrame
    entries: DataFrame
    deps: DataFrame
    tests: DataFrame
    features: DataFrame
    edges: DataFrame
    failed: int = 0


def hits(df: DataFrame, path: Column, channel: str, score: Column, reason: Column, seq: int, symbol: Column | None = None) -> DataFrame:
    """Rows (path, channel, score, reason, symbol, seq) of what scores above 0."""
    symbol = F.lit(None).cast("string") if symbol is None else symbol
    out = df.select(path.alias("path"), F.lit(channel).alias("channel"), score.cast("double").alias("score"), reason.alias("reason"), symbol.alias("symbol"), F.lit(seq).alias("seq"))
    return out.filter("score > 0 and path is not null")


def fact_score(value: Column, e: Expansion, weights: tuple[int, int]) -> Column:
    """Score of a fact's text; where a project has terms of its own, one of them must hit."""
    own, every = text.text_score(value, e.of("project"), weights[1]), text.text_score(value, e.terms, weights[0])
    return F.when(own > 0, own + every).otherwise(0.0) if e.of("project") else every


def symbol_scores(symbols: DataFrame, e: Expansion) -> DataFrame:
    """symbols that score, with score; a project's term must hit, if there are any."""
    own = reduce(Column.__add__, [text.text_score(F.col(c), e.of("project"), w) for c, (w, _) in SYMBOL_WEIGHTS.items() if w])
    every = reduce(Column.__add__, [text.text_score(F.col(c), e.terms, w) for c, (_, w) in SYMBOL_WEIGHTS.items()])
    out = symbols.withColumn("score", own + every)
    return out.filter(own > 0) if e.of("project") else out.filter("score > 0")


def feature_scores(features: DataFrame, e: Expansion) -> DataFrame:
    """The best TOP_FEATURES features, with score."""
    sum_of = lambda values, w: F.aggregate(values, F.lit(0.0), lambda a, v: a + text.text_score(v, e.terms, w))
    w = FEATURE_WEIGHTS
    score = text.text_score(F.col("name"), e.terms, w["name"]) + text.text_score(F.col("description"), e.terms, w["description"])
    score = score + sum_of(F.col("invariants"), w["invariants"]) + sum_of(F.transform("steps", lambda s: s["action"]), w["steps"])
    return features.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "feature_id").limit(TOP_FEATURES)


def feature_hits(top: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files of the steps of the best features: a step's symbol counts more than its file."""
    steps = top.select("feature_id", "score", F.explode("steps").alias("step"))
    reason = F.concat(F.lit("feature:"), "feature_id")
    by_symbol = steps.join(symbols.select("symbol_id", F.col("file_path").alias("_file")), F.col("step.symbol_id") == F.col("symbol_id"))
    by_file = steps.filter("step.symbol_id is null")
    found = hits(by_symbol, F.col("_file"), "feature", 24 + F.col("score") * 0.15, reason, 1, F.col("symbol_id"))
    return found.unionByName(hits(by_file, F.col("step.file_path"), "feature", F.lit(16.0), reason, 1))


def fact_hits(c: Corpus, e: Expansion) -> DataFrame:
    """Files of entries, routes and data objects that the terms name, with the fact's node."""
    col, ws = F.col, lambda *x: F.concat_ws(" ", *x)
    entry = c.entries.withColumn("_v", ws("entry_kind", "entry_name", F.coalesce("handler_ref", F.lit(""))))
    route = c.routes.withColumn("_v", ws("method", "route_path"))
    item = c.objects.withColumn("_v", ws("object_name", "operation"))
    named = (
        (entry, "entry", ENTRY_WEIGHTS, F.concat(F.lit("entry:"), ws("entry_kind", "entry_name")), 3, F.coalesce("handler_symbol_id", "symbol_id"), col("node_id")),
        (route, "route", ROUTE_WEIGHTS, F.concat(F.lit("route:"), "_v"), 4, col("symbol_id"), F.concat_ws(":", F.lit("route"), "direction", "method", "route_path")),
        (item, "db", OBJECT_WEIGHTS, F.concat(F.lit("db:"), "object_name"), 5, col("symbol_id"), F.concat_ws(":", F.lit("db"), "object_type", "object_name")),
    )
    parts = []
    for df, channel, weights, reason, seq, symbol, node in named:
        scored = df.select(col("file_path").alias("path"), F.lit(channel).alias("channel"), fact_score(col("_v"), e, weights).cast("double").alias("score"), reason.alias("reason"), symbol.alias("symbol"), F.lit(seq).alias("seq"), node.alias("node_id"))
        parts.append(scored.filter("score > 0"))
    return reduce(DataFrame.unionByName, parts)


def path_hits(files: DataFrame, e: Expansion, task: str) -> DataFrame:
    """Files by their paths: terms, developers' words, manifests, and tests that show what they test."""
    path, code, tests = F.col("path"), files.filter(~F.col("is_test")), files.filter("is_test")
    about_manifests, about_tests = surface_intents(task, e)
    by_path = text.text_score(path, e.of("project"), 18) if e.of("project") else text.text_score(path, e.terms, 2)
    found = [hits(code, path, "path", by_path, F.lit("path_match"), 6)]
    for a in e.applied:
        if a.source == "developer" and a.key.lower() not in TEST_KEYS:
            found.append(hits(code, path, "developer_intent", text.path_surface_score(path, a.terms()), F.lit(f"developer_intent:{a.key}"), 7))
    if about_manifests:
        base = paths.manifest_score(path)
        found.append(hits(code, path, "manifest", F.when(base > 0, base + F.least(F.lit(6.0), text.text_score(path, e.focus(), 2))), F.lit("manifest_surface"), 8))
    if about_tests and (e.focus() or e.subjects()):
        shown = F.substring("text", 1, TEST_PREVIEW)
        subject = text.path_surface_score(path, e.subjects()) + text.exact_token_score(shown, e.subjects(), 6)
        generic = text.text_score(path, e.focus(), 3) + text.text_score(shown, e.focus(), 1)
        found.append(hits(tests, path, "direct_test", F.least(F.lit(48.0), subject + F.least(F.lit(18.0), generic)), F.lit("direct_test_match"), 9))
    return reduce(DataFrame.unionByName, found)


def neighbour_hits(deps: DataFrame, symbols: DataFrame, seeds: list[str]) -> DataFrame:
    """Files of what the seed symbols (30 at most) call, 5, and of what calls them, 4."""
    mine = lambda c: F.col(c).isin(*seeds) if seeds else F.lit(False)
    at = symbols.select(F.col("symbol_id").alias("resolved_symbol_id"), F.col("file_path").alias("_file"))
    callee = deps.filter(mine("from_symbol_id")).join(at, "resolved_symbol_id")
    caller = deps.filter(mine("resolved_symbol_id") & ~F.col("resolved_symbol_id").eqNullSafe(F.col("from_symbol_id")))
    found = hits(callee, F.col("_file"), "graph", F.lit(5.0), F.concat(F.lit("callee_of:"), "from_symbol_id"), 12, F.col("resolved_symbol_id"))
    return found.unionByName(hits(caller, F.col("from_file"), "graph", F.lit(4.0), F.concat(F.lit("caller_of:"), "resolved_symbol_id"), 12, F.col("from_symbol_id")))


def test_hits(tests: DataFrame, symbols: DataFrame, top: list[str]) -> DataFrame:
    """Tests of the best files (10 at most), 7, by their file or by a symbol in it: two joins, no OR."""
    among = lambda c: F.col(c).isin(*top) if top else F.lit(False)
    by_file = tests.filter(among("target_file")).select("test_file", F.col("target_file").alias("_of"))
    at = symbols.filter(among("file_path")).select(F.col("symbol_id").alias("target_symbol_id"), F.col("file_path").alias("_of"))
    pairs = by_file.unionByName(tests.join(at, "target_symbol_id").select("test_file", "_of")).distinct()
    return hits(pairs, F.col("test_file"), "test", F.lit(7.0), F.concat(F.lit("test_for:"), "_of"), 13)


@dataclass
class Group:
    """Files for which places are held: by a reason, ranked by `order`, `most` of them."""

    kind: str
    reason: str
    most: int
    order: Column
    fits: Column
    fixed: bool  # the first `most` count even if another group holds them already


def intent_groups(e: Expansion) -> list[Group]:
    """Places for developers' words first, then for business words, manifests and direct tests."""
    aliases = sorted((a for a in e.applied if a.source in ("developer", "builtin") and a.terms()), key=lambda a: a.source != "developer")
    out = []
    for a in aliases:
        surface = text.path_surface_score(F.col("path"), a.terms())
        if a.source == "developer":
            out.append(Group("developer", f"developer_intent:{a.key}", 1, surface, surface > 0, True))
        else:
            out.append(Group("builtin", "intent_path_match", 2, F.lit(0.0), F.lit(True), True))
    out.append(Group("manifest", "manifest_surface", 1, F.coalesce(F.col("channels")["manifest"], F.lit(0.0)), F.lit(True), False))
    out.append(Group("test", "direct_test_match", 2, F.coalesce(F.col("channels")["direct_test"], F.lit(0.0)), F.lit(True), False))
    return out


def pool(ranked: DataFrame, groups: list[Group], limit: int) -> DataFrame:
    """The rows that a selection can hold: the best `limit`, and of each group those that its places may go to; in rank order.

    ranked: path, final, channels, reasons, and more. `places` gives each row its place in the groups it is in.
    """
    order = [F.desc("final"), F.collate("path", "UNICODE"), "path"]
    room = min(6, limit // 2)
    top = ranked.orderBy(*order).limit(limit).select("path")
    found = [top.withColumn("group", F.lit(-1)).withColumn("place", F.lit(0))]
    for n, g in enumerate(groups):
        mine = ranked.filter(F.array_contains("reasons", g.reason) & g.fits).withColumn("_o", g.order)
        keep = g.most if g.fixed else g.most + room
        best = mine.orderBy(F.desc("_o"), *order).limit(keep)
        best = best.select("path", F.lit(n).alias("group"), F.row_number().over(Window.orderBy(F.desc("_o"), *order)).alias("place"))  # `keep` rows
        found.append(best)
    held = reduce(DataFrame.unionByName, found).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("group", "place"))).alias("places"))
    return ranked.join(F.broadcast(held), "path").orderBy(*order)  # limit + (most + 6) a group


def reserve(rows: list[dict], groups: list[Group], limit: int) -> tuple[list[int], dict[int, str]]:
    """Places of the selected among rows (in rank order, with `places`), and for which kind of group a place is held.

    The best `limit` are selected, min(6, limit // 2) places are held for groups in turn. One that isn't among
    the best takes the place of the last selected one that no group holds.
    """
    room, held = min(6, limit // 2), {}
    for n, g in enumerate(groups):
        mine = sorted((r["places"][n], i) for i, r in enumerate(rows) if n in r["places"])
        mine = mine[: g.most] if g.fixed else [m for m in mine if m[1] not in held][: g.most]
        for _, i in mine:
            if len(held) < room:
                held.setdefault(i, g.kind)
    chosen = [i for i, r in enumerate(rows) if -1 in r["places"]]
    for i in held:
        if i not in chosen:
            free = [c for c in chosen if c not in held]
            if not free:
                break
            chosen[chosen.index(free[-1])] = i
    return sorted(chosen), {i: k for i, k in held.items() if i in chosen}


def coverage(ranked: Column, strong: Column, failed: Column, limit: int) -> Column:
    return F.when(ranked == 0, "insufficient").when(failed > 0, "review_required").when((ranked > max(60, 5 * limit)) | (strong > 250), "broad").otherwise("sufficient")


def rank_normalised(place: Column, n: Column) -> Column:
    """1 for the first place to 0 for the last; 1 if there is one."""
    return F.when(n <= 1, 1.0).otherwise(1 - (place - 1) / (n - 1))


def pool_size(n: int, limit: int) -> int:
    return min(n, max(24, 3 * limit), 64)


def rerank(ranked: DataFrame, scores: DataFrame, weight: float = 0.25, limit: int = 12) -> DataFrame:
    """ranked (path, rank) with the pool's places by (1 - weight) * rank score + weight * semantic_score.

    scores (path, semantic_score) must name each path of the pool once, with a value of 0 to 1: else the order stays.
    """
    if not 0 <= weight <= 0.35:
        raise ValueError("weight is 0 to 0.35")
    n = ranked.count()
    size = pool_size(n, limit)
    pool = ranked.filter(F.col("rank") <= size)
    met = pool.join(scores.groupBy("path").agg(F.count("*").alias("k"), F.max("semantic_score").alias("semantic_score")), "path", "full")
    bad = met.filter("rank is null or k is null or k <> 1 or semantic_score is null or isnan(semantic_score) or semantic_score < 0 or semantic_score > 1")
    if not bad.isEmpty():
        return ranked.withColumn("fused", F.lit(None).cast("double"))
    best = met.withColumn("fused", (1 - weight) * rank_normalised(F.col("rank"), F.lit(size)) + weight * F.col("semantic_score"))
    best = best.withColumn("new", F.row_number().over(Window.orderBy(F.desc("fused"), "rank", "path")))  # 64 rows at most
    rest = ranked.filter(F.col("rank") > size).select("path", "rank", F.lit(None).cast("double").alias("fused"))
    return best.select("path", F.col("new").alias("rank"), "fused").unionByName(rest)


def ranking_quality(ranked: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """queries, hit_k for each cutoff, mrr and the median rank of the first hit, of ranked (query, rank, relevant)."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    hit = [F.coalesce(F.sum((F.col("first") <= k).cast("int")), F.lit(0)).alias(f"hit_{k}") for k in cutoffs]
    return first.agg(F.count("*").alias("queries"), *hit, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.median("first").alias("median_first"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """What confusion() gives, with precision and recall; null where nothing was found or wanted."""
    ratio = lambda a, b: F.when(F.col("tp") + F.col(b) > 0, F.col(a) / (F.col("tp") + F.col(b)))
    return counts.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def shown_symbols(symbols: Column, most: int) -> Column:
    """The first names behind '::' of symbol ids, each once: six of what must be read, three of the rest."""
    return F.slice(F.array_distinct(F.filter(F.transform(symbols, text.symbol_hint), lambda x: x != "")), 1, most)


def confusion(edges: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """tp, fp, fn, tn of labelled edges (on, present) against found ones."""
    met = wanted.join(edges.select(*on).distinct().withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    n = lambda cond: F.sum(F.expr(cond).cast("int"))
    return met.agg(n("present and found").alias("tp"), n("not present and found").alias("fp"), n("present and not found").alias("fn"), n("not present and not found").alias("tn"))
