"""Graph operators over typed edges (edge_id, src, dst, type, confidence): bounded traversal, closures, degrees, layout."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut
from .spread import IDS, spread

# Edge types in the order in which a node's edges are followed, and ranks of confidence.
TYPE_ORDER = ("entry_handler", "api_request", "route_handler", "call", "db_read", "db_write", "page_api", "test_of", "import")
CONFIDENCE = {"unresolved": 0, "inferred": 1, "static": 2, "exact": 3}


def type_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), c) - 1, F.lit(len(TYPE_ORDER)))


def confidence_rank(c: Column) -> Column:
    return reduce(lambda a, kv: F.when(c == kv[0], kv[1]).otherwise(a), CONFIDENCE.items(), F.lit(0))


def edge_order() -> list[Column]:
    return [type_rank(F.col("type")), F.desc(confidence_rank(F.col("confidence"))), F.collate("edge_id", "UNICODE"), F.col("edge_id")]


@dataclass
class Traversal:
    """visited (flow_id, node_id, hop, visit), steps and frontier rows, unresolved links, and stats of each flow."""

    visited: DataFrame
    steps: DataFrame
    frontier: DataFrame
    unresolved: DataFrame
    stats: DataFrame


def _check(direction: str, hops: int, branch: int, nodes: int, least: str) -> None:
    if direction not in ("forward", "reverse"):
        raise ValueError("direction is forward or reverse")
    if least not in ("exact", "static", "inferred"):
        raise ValueError("min_confidence is exact, static or inferred")
    for name, value, most in (("max_hops", hops, 6), ("branch_limit", branch, 100), ("node_limit", nodes, 1000)):
        if not 1 <= value <= most:
            raise ValueError(f"{name} is 1 to {most}")


def traverse(edges: DataFrame, starts: DataFrame, *, direction: str = "forward", max_hops: int = 3, branch_limit: int = 20, node_limit: int = 200, min_confidence: str = "static", edge_types: tuple[str, ...] | None = None, repeated: bool = False) -> Traversal:
    """Breadth-first walks from starts (flow_id, node_id), all flows at once, a level a round.

    A level is the frontier joined to the edge table: the frontier has node_limit rows a flow at most and goes
    out by broadcast while that is small, so a round scans the edges and shuffles only those that touch it. Of
    a node's edges the first branch_limit by (type, confidence, id) are followed; a partial top-k before the
    shuffle keeps hubs from gathering. Levels equal a queue: a new node is visited in the order of its
    first (parent's visit, edge rank). What isn't followed is reported: confidence_threshold, max_hops,
    branch_limit, node_limit rows, and unresolved links. repeated: an edge may stand in several rows; only those of a level are told apart.
    """
    _check(direction, max_hops, branch_limit, node_limit, min_confidence)
    here, there = ("src", "dst") if direction == "forward" else ("dst", "src")
    usable = edges if edge_types is None else edges.filter(F.col("type").isin(*edge_types))
    usable = usable.select("edge_id", F.col(here).alias("node_id"), F.col(there).alias("target"), "type", "confidence")
    by_flow = Window.partitionBy("flow_id")
    seen = starts.distinct().withColumn("visit", F.row_number().over(by_flow.orderBy("node_id"))).withColumn("hop", F.lit(0))
    seen = cut(seen.filter(F.col("visit") <= node_limit))
    level, steps, rows, loose = seen, [], [], []
    flows = seen.agg(F.countDistinct("flow_id")).first()[0]
    near = F.broadcast if flows * node_limit <= 1_000_000 else lambda d: d
    rank = confidence_rank(F.col("confidence"))
    kind = F.when(F.col("confidence") == "unresolved", "unresolved").when(rank < CONFIDENCE[min_confidence], "below").otherwise("eligible")
    for hop in range(max_hops + 1):
        # the edges are read once a level; of these rows all else is made
        touched = usable.join(near(level.select("node_id").distinct()), "node_id", "left_semi")
        touched = cut(touched.distinct() if repeated else touched)
        met = touched.join(near(level.select("flow_id", "node_id", "visit")), "node_id").withColumn("kind", kind)
        place = Window.partitionBy("flow_id", "node_id", "kind")
        ranked = met.withColumn("rn", F.row_number().over(place.orderBy(*edge_order())))
        some = ranked.filter(F.col("rn") <= branch_limit)
        some = cut(some) if hop < max_hops else some  # of the last level only reports are made, if they are asked for
        loose.append(some.filter("kind = 'unresolved'").select("flow_id", "node_id", "edge_id", "target", "type", F.lit(hop).alias("hop")))
        below = met.filter("kind = 'below'")
        rows.append(below.select("flow_id", "node_id", F.lit("confidence_threshold").alias("reason"), "edge_id", F.lit(1).cast("long").alias("omitted"), F.lit(hop).alias("hop")))
        over = met.filter("kind = 'eligible'").groupBy("flow_id", "node_id").agg((F.count("*") - branch_limit).alias("omitted")).filter("omitted > 0")
        rows.append(over.select("flow_id", "node_id", F.lit("branch_limit").alias("reason"), F.lit(None).cast("string").alias("edge_id"), "omitted", F.lit(hop).alias("hop")))
        chosen = some.filter("kind = 'eligible'")
        if hop == max_hops:
            rows.append(chosen.select("flow_id", "node_id", F.lit("max_hops").alias("reason"), "edge_id", F.lit(1).cast("long").alias("omitted"), F.lit(hop).alias("hop")))
            break
        fresh = chosen.join(near(seen.select("flow_id", F.col("node_id").alias("target"))), ["flow_id", "target"], "left_anti")
        first = fresh.groupBy("flow_id", "target").agg(F.min(F.struct("visit", "rn", "node_id", "edge_id", "type", "confidence")).alias("by"))
        room = seen.groupBy("flow_id").agg(F.max("visit").alias("n"))
        first = first.join(near(room), "flow_id").withColumn("visit", F.col("n") + F.row_number().over(by_flow.orderBy("by.visit", "by.rn")))
        first = cut(first.filter(F.col("visit") <= node_limit).select("flow_id", "target", "by", "visit"))
        steps.append(first.select("flow_id", F.col("by.node_id").alias("node_id"), "target", F.col("by.edge_id").alias("edge_id"), F.col("by.type").alias("type"), F.col("by.confidence").alias("confidence"), F.lit(hop + 1).alias("hop"), "visit"))
        late = fresh.join(near(first.select("flow_id", "target")), ["flow_id", "target"], "left_anti")
        rows.append(late.select("flow_id", "node_id", F.lit("node_limit").alias("reason"), "edge_id", F.lit(1).cast("long").alias("omitted"), F.lit(hop).alias("hop")))
        rows.append(chosen.groupBy("flow_id").agg(F.count("*").alias("omitted")).select("flow_id", F.lit("").alias("node_id"), F.lit("followed").alias("reason"), F.lit(None).cast("string").alias("edge_id"), "omitted", F.lit(hop).alias("hop")))
        level = first.select("flow_id", F.col("target").alias("node_id"), "visit", F.lit(hop + 1).alias("hop"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)  # each level is a table of its own
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    all_rows, step_rows, links = union(rows), union(steps), union(loose)
    count = lambda d, name: d.groupBy("flow_id").agg(F.count("*").alias(name))
    frontier = all_rows.filter("reason != 'followed'")
    stats = count(seen, "nodes").join(count(step_rows, "steps"), "flow_id", "left").join(count(links, "unresolved"), "flow_id", "left").join(count(frontier, "frontier"), "flow_id", "left")
    skipped = all_rows.groupBy("flow_id").agg((F.sum(F.when(F.col("reason") == "followed", F.col("omitted")).otherwise(0)) - F.sum((F.col("reason") == "node_limit").cast("long"))).alias("tried"))
    stats = stats.join(skipped, "flow_id", "left").na.fill(0).withColumn("cycle_skips", F.col("tried") - F.col("steps")).drop("tried")
    return Traversal(seen.select("flow_id", "node_id", "hop", "visit"), step_rows, frontier, links, stats)


def flow_summary(t: Traversal) -> DataFrame:
    """One row over all flows: how many are complete (no frontier, nothing unresolved), and sums."""
    whole = (F.col("frontier") == 0) & (F.col("unresolved") == 0)
    return t.stats.agg(F.count("*").alias("flows"), F.sum(whole.cast("long")).alias("complete"), F.sum((~whole).cast("long")).alias("partial"), F.sum("nodes").alias("nodes"), F.sum("steps").alias("steps"), F.sum("unresolved").alias("unresolved"))


def closure(pairs: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, node, depth): everything reached from starts (node) along pairs (src, dst), cycles cut by what is seen."""
    seen = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, max_rounds + 1):
        step = level.join(pairs, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        level = cut(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)  # each level is a table of its own
    raise RuntimeError(f"closure did not end in {max_rounds} rounds")


def node_degree(edges: DataFrame) -> DataFrame:
    """Ends of each node, counted in tasks whose number follows the edges: a task holds its nodes, of a hub one row."""
    ends = spread(edges.select(F.explode(F.array("src", "dst")).alias("node_id")), IDS, "node_id")
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def bridge_degree(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Different sources of the certain edges of some types that lead to a node."""
    sure = edges.filter(F.col("type").isin(*types) & F.col("confidence").isin("static", "exact"))
    return sure.groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("bridge_degree"))


def flow_rows(t: Traversal, edges: DataFrame, described: DataFrame) -> DataFrame:
    """One row for each flow: status, nodes, steps with their evidence, files, frontier, unresolved links and stats.

    described: t.visited with kind, name, file_path, symbol_id, line. A flow has 1000 nodes at most, so its arrays are bounded; it is complete
    if nothing was left out and nothing is unresolved.
    """
    gather = lambda d, order, row, name: d.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*row).alias("x")))), lambda r: r["x"]).alias(name))
    if "evidence" in edges.columns:
        # of all edges only those walked meet the steps
        steps = t.steps.join(edges.select("edge_id", "evidence").join(t.steps.select("edge_id").distinct(), "edge_id", "left_semi"), "edge_id", "left")
    else:
        steps = t.steps.withColumn("evidence", F.lit(None).cast("struct<file_path:string,line:int>"))
    nodes = gather(described, ["visit"], ["node_id", "hop", "kind", "name", "file_path", "symbol_id", "line"], "nodes")
    walked = gather(steps, ["visit"], ["edge_id", "type", "confidence", F.col("node_id").alias("from_node_id"), F.col("target").alias("to_node_id"), "hop", "evidence"], "steps")
    files = described.select("flow_id", "file_path").unionByName(steps.select("flow_id", F.col("evidence.file_path").alias("file_path"))).filter("file_path is not null")
    files = files.groupBy("flow_id").agg(F.sort_array(F.collect_set("file_path")).alias("files"))
    front = gather(t.frontier, ["hop", "node_id", "reason", "edge_id"], ["node_id", "reason", "edge_id", "omitted", "hop"], "frontier_items")
    loose = gather(t.unresolved, ["hop", "node_id", "edge_id"], ["node_id", "edge_id", "target", "type", "hop"], "unresolved_links")
    whole = F.when((F.col("frontier") == 0) & (F.col("unresolved") == 0), "complete").otherwise("partial")
    stats = t.stats.select("flow_id", whole.alias("status"), F.struct(F.col("nodes").alias("visited_nodes"), F.col("steps"), F.col("unresolved").alias("unresolved_links"), "frontier", "cycle_skips").alias("stats"))
    out = stats
    for part in (nodes, walked, files, front, loose):
        out = out.join(part, "flow_id", "left")
    return out


def ranked(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with `place`, 0 on by `order` within `group`: ranks within ranges, behind what stands in the ranges before, so no task gets a whole group."""
    parted = cut(rows.repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()))
    counts = parted.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_p", (F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")).alias("_before"))  # one row a range
    local = parted.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_p").orderBy(order)) - 1)
    return local.join(before, [group, "_p"]).withColumn("place", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def layout(nodes: DataFrame, wide: int = 240, high: int = 84) -> DataFrame:
    """nodes (node_id, kind) with a column of the picture for each kind and a row for each node of it."""
    kinds = nodes.select("kind").distinct().withColumn("col", F.row_number().over(Window.orderBy("kind")) - 1)
    placed = ranked(nodes.select("node_id", "kind"), "kind", "node_id")
    return placed.join(kinds, "kind").select("node_id", "kind", (F.col("col") * wide).alias("x"), (F.col("place") * high).alias("y"))
