"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph as G
from .registry import query, read

_EDGES = "(SELECT DISTINCT 's' || s_suppkey AS a, 'n' || s_nationkey || ':' || CAST(floor(s_acctbal / 2500) AS BIGINT) AS b FROM supplier)"


@query(
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
  SELECT node, min(root) AS component FROM r GROUP BY 1"""
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that belong together by nation and balance."""
    edges = read(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey as a", "'n' || s_nationkey || ':' || cast(floor(s_acctbal / 2500) as bigint) as b").distinct()
    return G.components(edges, "a", "b")


@query(
    """WITH RECURSIVE l AS (SELECT c_custkey AS n, c_custkey // 2 AS t FROM customer WHERE c_custkey > 1), r AS (SELECT n, t, 1 AS d FROM l UNION ALL SELECT r.n, l.t, d + 1 FROM r JOIN l ON l.n = r.t)
  SELECT n AS node, arg_max(t, d) AS "end", 'resolved' AS status FROM r GROUP BY 1"""
)
def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "customer").where("c_custkey > 1").selectExpr("c_custkey as node", "c_custkey div 2 as target")
    return G.resolve_chain(links, "node", "target")


@query(
    """WITH RECURSIVE l AS (SELECT c_custkey AS b, c_custkey // 3 AS a FROM customer WHERE c_custkey > 2), r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT l.b, depth + 1 FROM r JOIN l ON l.a = r.node)
  SELECT node, min(depth) AS depth FROM r GROUP BY 1"""
)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "customer").where("c_custkey > 2").selectExpr("c_custkey div 3 as a", "c_custkey as b")
    return G.reachable(edges, "a", "b", spark.range(1, 2).select(F.col("id").alias("root")))


# customers of a block of 128 export one to the next; every third block's chain ends in a cycle of eight, the last of a block is unlinked
_EXPORTS = "(SELECT 'f' || c_custkey // 128 AS file, 's' || c_custkey % 128 AS name, CASE WHEN c_custkey % 128 = 127 AND c_custkey // 128 % 3 = 0 THEN 120 ELSE c_custkey % 128 + 1 END AS k FROM customer WHERE c_custkey % 128 < 127 OR c_custkey // 128 % 3 = 0)"


@query(
    f"""WITH RECURSIVE e AS (SELECT file, name, 's' || k AS to_name FROM {_EXPORTS}), r AS (SELECT file, name, name AS at, [name] AS seen FROM e UNION ALL
    SELECT r.file, r.name, e.to_name, list_append(seen, e.to_name) FROM r JOIN e ON e.file = r.file AND e.name = r.at WHERE NOT list_contains(seen, e.to_name))
  SELECT r.file, r.name, r.file AS end_file, arg_max(r.at, len(seen)) AS end_name, CAST(max(len(seen)) - 1 AS INTEGER) AS hops, CASE WHEN bool_or(list_contains(seen, e.to_name)) THEN 'cycle' ELSE 'resolved' END AS status
  FROM r LEFT JOIN e ON e.file = r.file AND e.name = r.at GROUP BY 1, 2"""
)
def export_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of chains of re-exports, some of which run into cycles."""
    at, block = F.col("c_custkey") % 128, F.floor(F.col("c_custkey") / 128)
    turns = (at == 127) & (block % 3 == 0)
    c = read(spark, sf_dir, "customer", "c_custkey").where((at < 127) | (block % 3 == 0))
    name = lambda k: F.concat(F.lit("s"), k.cast("string"))
    file = F.concat(F.lit("f"), block.cast("string"))
    links = c.select(file.alias("file"), name(at).alias("name"), file.alias("to_file"), name(F.when(turns, 120).otherwise(at + 1)).alias("to_name"))
    return G.follow_exports(links, links)
