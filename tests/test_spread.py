"""Work is dealt to all cores, however few row groups hold a table, and one run of a pattern finds what runs for each group find."""

import os
import re

import pytest

from pyspark.sql import functions as F

from graphloom.extract import facts
from graphloom.functions import text
from graphloom.operators.cut import cut
from graphloom.operators.spread import tasks_for
from graphloom.plans import catalog
from graphloom.plans.adapter import edges

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["client_requests", "extract_sql_objects", "extract_links_routes", "entry_points"])
def test_texts_of_one_row_group_are_dealt(spark, name):
    assert f"RoundRobinPartitioning({2 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan(catalog.queries()[name](spark, SF))


def test_matches_equal_a_plain_regex(spark):
    bodies = ["", "none", "a1b22\nc333", "x1\n\ny2\n", "\1m1\2\n\1k2\2", "p9\2", None]
    pattern = r"([a-z])(\d+)(!)?\n?"
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, text string")
    got = {(r.id, r.line, r.match, r.a, r.b, r.c) for r in facts.match_rows(rows, ["id"], pattern, {"a": 1, "b": 2, "c": 3}).collect()}
    want = {(i, 1 + t[: m.start()].count("\n"), m[0], m[1], m[2], m[3] or "") for i, t in enumerate(bodies) if t is not None for m in re.finditer(pattern, t)}
    assert got == want and len(want) == 8


def test_requests_with_marks_and_constants(spark):
    body = "const A = \"/k\"; fetch(A)\nfetch(`${A}/x/${ id }`) // \1\2\ncall({ url: A })\nfetch(B)\n"
    rows = spark.createDataFrame([(1, body), (2, body.replace("\1\2", "")), (3, "nothing"), (4, None)], "id int, text string")
    got = sorted(tuple(r) for r in facts.client_requests(rows, ["id"]).collect())
    want = [("ANY", "/k", 3), ("GET", "/k", 1), ("GET", "/k/x/{param}", 2)]
    assert got == [(i, *w) for i in (1, 2) for w in want]


@tables
@pytest.mark.parametrize("name", ["parse_params", "identifier_bytes"])
def test_signatures_of_one_row_group_are_dealt(spark, name):
    assert f"RoundRobinPartitioning({2 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan(catalog.queries()[name](spark, SF))


def test_parameters_are_cut_by_tokens(spark):
    signs = ["a: number = f(1, 2), ...b?: map<x, list> ", "", None, "x", ")a, b: (c, d) => e", "a: {b: c,\nd}, , e=[1,2]"]
    df = spark.createDataFrame([(s,) for s in signs], "s string").select("s", text.parse_params(F.col("s")).alias("p"))
    got = [None if r.p is None else [tuple(x) for x in r.p] for r in df.collect()]
    assert got[:4] == [[("a", "number"), ("b", "map<x, list>")], [], None, [("x", None)]]
    assert [[tuple(x) for x in r.p] for r in spark.createDataFrame([("a: T0, b: T1",)], "s string").select(text.parse_params(F.col("s")).alias("p")).collect()] == [[("a", "T0"), ("b", "T1")]]
    assert got[4:] == [[(")a", None), ("b", "(c"), ("d) => e", None)], [("a", "{b: c,\nd}"), ("e", None)]]
    assert "split(" not in plan(df)  # no step for each character


def test_tasks_follow_the_bytes(spark):
    few, many = (tasks_for(spark.range(n), 1 << 20) for n in (10_000_000, 100_000_000))
    assert 70 < few < 90 and 9.9 < many / few < 10.1
    assert tasks_for(spark.range(10), 1 << 20) == 2 * spark.sparkContext.defaultParallelism


def dealt(df, *columns):
    return [c for c in columns if not re.search(rf"hashpartitioning\({c}[^)]*\), REPARTITION_BY_NUM", re.sub(r"#\d+L?", "", plan(df)))]


@tables
def test_degrees_are_counted_in_tasks_that_follow_the_edges(spark):
    assert dealt(catalog.queries()["node_degree"](spark, SF), "a, b", "node_id") == []


@tables
@pytest.mark.parametrize(("name", "columns"), [("edge_order_topk", ["a, b", "src"]), ("public_nodes", ["a, b", "id"])])
def test_edges_are_ranked_and_told_apart_in_tasks_that_follow_them(spark, name, columns):
    assert dealt(catalog.queries()[name](spark, SF), *columns) == []


@tables
def test_edges_for_a_walk_are_not_shuffled(spark):
    rows = edges(spark, SF, once=False)
    assert "Exchange" not in plan(rows) and rows.distinct().count() == edges(spark, SF).count()


@tables
@pytest.mark.parametrize("name", ["flow_summary", "flow_manifest"])
def test_a_walk_writes_only_edges_it_touches(spark, name, monkeypatch):
    from graphloom.operators import traverse

    sizes = []
    monkeypatch.setattr(traverse, "cut", lambda df: (lambda d: (sizes.append(d.count()), d)[1])(cut(df)))
    monkeypatch.setattr("graphloom.plans.adapter.cut", lambda df: (lambda d: (sizes.append(d.count()), d)[1])(cut(df)))
    catalog.queries()[name](spark, SF).collect()
    assert 0 < max(sizes) < edges(spark, SF).count() // 10
