"""The engine's relations over the driver's tables. Expressions that both SQL dialects read are shared with the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cut import cut
from ..operators.spread import PAIRS, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH = (
    "concat(case cast(doc_id % 6 as int) when 0 then 'src/' when 1 then 'tests/' when 2 then 'db/migrations/' when 3 then 'node_modules/' when 4 then 'dist/' else 'lib/api/' end, "
    "lower(coalesce(source, 'none')), '/', lpad(cast(doc_id as string), 9, '0'), "
    "case cast(doc_id % 7 as int) when 0 then '/serviceApi.go' when 1 then '.test.ts' when 2 then '.min.js' when 3 then '/package.json' when 4 then '/.env' when 5 then '.down.sql' else '_test.go' end)"
)
FILES_SQL = f"files as (select doc_id, {PATH} as path, lang as language, coalesce(text, '') as text from documents)"
SYMBOLS_SQL = "symbols as (select concat('part:', cast(p_partkey as string)) as symbol_id, p_partkey, p_name as name, p_brand as file_path, p_type as kind, p_size as line_start, p_size + 3 as line_end from part)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, language, text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr(PATH).alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("text"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("symbol_id"), "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("kind"), F.col("p_size").alias("line_start"), (F.col("p_size") + 3).alias("line_end"))


#: (type, table, source kind, source key, target kind, target key)
LINKS = (
    ("entry_handler", "orders", "customer", "o_custkey", "order", "o_orderkey"),
    ("call", "lineitem", "order", "l_orderkey", "part", "l_partkey"),
    ("db_read", "lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
    ("import", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ("import", "nation", "nation", "n_nationkey", "region", "n_regionkey"),
    ("test_of", "customer", "customer", "c_custkey", "nation", "c_nationkey"),
)
_NODE = "concat('{k}:', lpad(cast({c} as string), 9, '0'))"
CONF = "case cast((a * 7 + b * 3) % 10 as int) when 0 then 'unresolved' when 1 then 'inferred' when 2 then 'inferred' when 3 then 'exact' else 'static' end"
_pairs = [f"select distinct '{t}' as type, {_NODE.format(k=s, c=a)} as src, {_NODE.format(k=d, c=b)} as dst, cast({a} as bigint) as a, cast({b} as bigint) as b from {tab}" for t, tab, s, a, d, b in LINKS]
EDGES_SQL = f"pairs as ({' union all '.join(_pairs)}), edges as (select concat(type, '/', src, '/', dst) as edge_id, src, dst, type, {CONF} as confidence from pairs)"


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a table, for what reads them more than once."""
    return cut(edges(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """edge_id, src, dst, type, confidence from the foreign keys; not `once`: an edge as often as rows say it, without any shuffle."""
    out = None
    for kind, tab, s, a, d, b in LINKS:
        t = table(spark, sf_dir, tab).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        # of keys, before ids are built, in tasks whose number follows the rows; the others are keyed by their table's key
        t = spread(t, PAIRS, "a", "b").distinct() if tab == "lineitem" and once else t
        t = t.select(F.lit(kind).alias("type"), F.expr(_NODE.format(k=s, c="a")).alias("src"), F.expr(_NODE.format(k=d, c="b")).alias("dst"), "a", "b")
        out = t if out is None else out.unionByName(t)
    return out.select(F.concat_ws("/", "type", "src", "dst").alias("edge_id"), "src", "dst", "type", F.expr(CONF).alias("confidence"))
