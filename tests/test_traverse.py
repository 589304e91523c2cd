"""Walks against a plain queue."""

import random
from collections import deque

from graphloom.operators import traverse as tr


def plain(edges, start, hops, branch, limit, least, forward=True):
    here, there = (1, 2) if forward else (2, 1)
    key = lambda e: (tr.TYPE_ORDER.index(e[3]), -tr.CONFIDENCE[e[4]], e[0])
    seen, steps, queue, skips, late = {start: 0}, [], deque([(start, 0)]), 0, 0
    while queue:
        node, hop = queue.popleft()
        mine = sorted((e for e in edges if e[here] == node and e[4] != "unresolved" and tr.CONFIDENCE[e[4]] >= tr.CONFIDENCE[least]), key=key)[:branch]
        if hop == hops:
            continue
        for e in mine:
            if e[there] in seen:
                skips += 1
            elif len(seen) >= limit:
                late += 1
            else:
                seen[e[there]] = hop + 1
                steps.append(e[0])
                queue.append((e[there], hop + 1))
    return list(seen.items()), steps, skips, late


def graph(seed, nodes=9, edges=26):
    rng = random.Random(seed)
    return [(f"e{i:03d}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice(tr.TYPE_ORDER), rng.choice(list(tr.CONFIDENCE))) for i in range(edges)]


def test_walks_equal_a_queue(spark):
    for seed, hops, branch, limit, least, way in ((1, 3, 2, 100, "static", "forward"), (2, 4, 3, 5, "inferred", "forward"), (3, 2, 1, 4, "static", "reverse"), (4, 5, 2, 6, "inferred", "reverse")):
        es = graph(seed)
        df = spark.createDataFrame(es, "edge_id string, src string, dst string, type string, confidence string")
        starts = spark.createDataFrame([(n, n) for n in ("n0", "n3")], "flow_id string, node_id string")
        t = tr.traverse(df, starts, direction=way, max_hops=hops, branch_limit=branch, node_limit=limit, min_confidence=least)
        visited, steps, frontier, stats = t.visited.collect(), t.steps.collect(), t.frontier.collect(), {r.flow_id: r for r in t.stats.collect()}
        for flow in ("n0", "n3"):
            nodes, ids, skips, late = plain(es, flow, hops, branch, limit, least, way == "forward")
            assert [(r.node_id, r.hop) for r in sorted((r for r in visited if r.flow_id == flow), key=lambda r: r.visit)] == nodes
            assert [r.edge_id for r in sorted((r for r in steps if r.flow_id == flow), key=lambda r: r.visit)] == ids
            assert sum(r.flow_id == flow and r.reason == "node_limit" for r in frontier) == late
            assert stats[flow].cycle_skips == skips


def test_unknown_start_and_empty_graph(spark):
    none = spark.createDataFrame([], "edge_id string, src string, dst string, type string, confidence string")
    t = tr.traverse(none, spark.createDataFrame([("f", "nowhere")], "flow_id string, node_id string"))
    assert [tuple(r) for r in t.visited.collect()] == [("f", "nowhere", 0, 1)]
    assert t.frontier.count() == 0 and tr.flow_summary(t).first().complete == 1


def test_bounds():
    import pytest

    for bad in ({"max_hops": 7}, {"branch_limit": 0}, {"node_limit": 1001}, {"min_confidence": "unresolved"}, {"direction": "up"}):
        with pytest.raises(ValueError):
            tr.traverse(None, None, **bad)
