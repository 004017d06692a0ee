"""Queries over intervals, unique matches, cascades, ledgers, deltas and division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins, release
from .registry import query, read


@query(
    """WITH i AS (SELECT o_custkey AS k, o_orderkey AS interval_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders), j AS (SELECT *, s + 30 + interval_id % 60 AS e FROM i)
  SELECT p.interval_id AS point_id, arg_min(j.interval_id, (j.e - j.s, -j.s, j.interval_id)) AS interval_id FROM i p LEFT JOIN j ON p.k = j.k AND j.s <= p.s AND p.s <= j.e GROUP BY 1"""
)
def interval_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the innermost order's window of its customer around it, its own among them."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", days.alias("day"))
    windows = o.select("o_custkey", F.col("o_orderkey").alias("interval_id"), F.col("day").alias("s"), (F.col("day") + 30 + F.col("o_orderkey") % 60).alias("e"))
    points = o.select(F.col("o_orderkey").alias("point_id"), "o_custkey", "day")
    return joins.enclosing_interval(points, windows, ["o_custkey"], "day", "s", "e", ["interval_id"], bin_width=45).select("point_id", "interval_id")


@query(
    """WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b, CAST(ts AS DATE) AS d FROM events GROUP BY user_id, CAST(ts AS DATE)),
  h AS (SELECT user_id, CAST(ts AS DATE) AS d, date_trunc('hour', ts) AS x FROM events GROUP BY ALL)
  SELECT s.user_id, CAST(s.d AS VARCHAR) AS day, count(*) AS overlaps FROM s JOIN h ON s.user_id = h.user_id AND s.d = h.d AND s.a <= h.x + INTERVAL 1 HOUR AND h.x <= s.b GROUP BY 1, 2"""
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_type").withColumn("d", F.to_date("ts"))
    sessions = e.groupBy("user_id", "d").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = e.select("user_id", "d", F.date_trunc("hour", "ts").alias("x")).distinct().withColumn("y", F.col("x") + F.expr("INTERVAL 1 HOUR"))
    day = 24 * 3600 * 1_000_000  # a user's day has one session and 25 hours at most
    found = joins.overlapping(sessions, hours, ["user_id", "d"], ("a", "b"), ("x", "y"), day)
    return found.groupBy("user_id", F.col("d").cast("string").alias("day")).agg(F.count("*").alias("overlaps"))


@query(
    """WITH i AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_orderkey * 8 + l_linenumber AS id, epoch_us(l_shipdate) // 1000000 AS s, CASE WHEN l_quantity >= 50 THEN 864000 ELSE CAST(l_quantity AS BIGINT) * 400 END AS w FROM lineitem)
  SELECT o.id, count(*) AS overlaps, min(f.id) AS least, max(f.id) AS most FROM i o JOIN i f ON o.flag = f.flag AND o.s <= f.s + f.w AND f.s <= o.s + o.w WHERE o.status = 'O' AND f.status = 'F' GROUP BY 1"""
)
def shipping_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each open item how many finished ones of its flag, of which there are three, were on their way at the same time."""
    i = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag", "l_shipdate")
    at = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    until = at + F.when(F.col("l_quantity") >= 50, 864_000).otherwise(F.col("l_quantity").cast("long") * 400)
    row = lambda x: [F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(f"{x}_id"), at.alias(f"{x}_from"), until.alias(f"{x}_until")]
    opened, done = i.where("l_linestatus = 'O'").select(*row("o")), i.where("l_linestatus = 'F'").select(*row("f"))
    found = joins.overlap_summary(opened, done, ["flag"], ("o_from", "o_until"), ("f_from", "f_until"), "f_id")
    return found.groupBy(F.col("o_id").alias("id")).agg(F.sum("overlaps").alias("overlaps"), F.min("least").alias("least"), F.max("most").alias("most"))


@query(
    """WITH k AS (SELECT n_nationkey * 10 + b AS key FROM nation, (SELECT unnest([0, 1, 2]) AS b)), s AS (SELECT s_nationkey * 10 + least(greatest(CAST(floor(s_acctbal / 3500) AS INTEGER), 0), 2) AS key, s_suppkey FROM supplier),
  b AS (SELECT key, count(s_suppkey) AS n, min(s_suppkey) AS one FROM k LEFT JOIN s USING (key) GROUP BY 1)
  SELECT key, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, n AS candidates, CASE WHEN n = 1 THEN one END AS resolved FROM b"""
)
def unique_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and ranges of balances with the one supplier in each."""
    keys = read(spark, sf_dir, "nation").select(F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda b: F.col("n_nationkey") * 10 + b)).alias("key"))
    suppliers = read(spark, sf_dir, "supplier").selectExpr("s_nationkey * 10 + least(greatest(cast(floor(s_acctbal / 3500) as int), 0), 2) as key", "s_suppkey")
    return joins.unique_match(keys, suppliers, "key", "s_suppkey")


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 1 WHEN c_acctbal > 5000 THEN 2 WHEN n_nationkey < 10 THEN 3 WHEN r_regionkey IS NOT NULL THEN 4 END AS rule_no,
  CASE WHEN o_totalprice > 300000 THEN o_orderpriority WHEN c_acctbal > 5000 THEN c_mktsegment WHEN n_nationkey < 10 THEN n_name WHEN r_regionkey IS NOT NULL THEN r_name END AS target
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def cascade_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = read(spark, sf_dir, "customer")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    on = oc.join(n, oc.c_nationkey == n.n_nationkey)
    rules = [
        o.where("o_totalprice > 300000").select("o_orderkey", F.col("o_orderpriority").alias("target")),
        oc.where("c_acctbal > 5000").select("o_orderkey", F.col("c_mktsegment").alias("target")),
        on.where("n_nationkey < 10").select("o_orderkey", F.col("n_name").alias("target")),
        on.join(r, on.n_regionkey == r.r_regionkey).select("o_orderkey", F.col("r_name").alias("target")),
    ]
    return joins.cascade(o.select("o_orderkey"), "o_orderkey", rules)


_EDGES = "(SELECT c_custkey AS a, CASE WHEN c_nationkey % 2 = 0 THEN (SELECT max(c_custkey) FROM customer) + 1 - c_custkey ELSE c_custkey % 10 END AS b FROM customer)"


@query(f"SELECT e.a, e.b FROM {_EDGES} e WHERE NOT EXISTS (SELECT 1 FROM {_EDGES} r WHERE r.a = e.b AND r.b = e.a)")
def reciprocal_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that point at one which does not point back."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    last = c.agg(F.max("c_custkey")).first()[0]
    edges = c.select(F.col("c_custkey").alias("a"), F.when(F.col("c_nationkey") % 2 == 0, F.lit(last) + 1 - F.col("c_custkey")).otherwise(F.col("c_custkey") % 10).alias("b"))
    return joins.not_reciprocal(edges, "a", "b")


@query(
    """WITH f AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE doc_id % 11 = 0),
  e AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1)
  SELECT doc_id, coalesce(e.n, 0) AS n_expected, coalesce(g.n, 0) AS n_found, CASE WHEN e.n IS NULL THEN 'unknown' WHEN g.n IS NULL THEN 'missing' WHEN e.n > 1 OR g.n > 1 THEN 'duplicate' ELSE 'matched' END AS status FROM e FULL JOIN g USING (doc_id)"""
)
def ledger_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels", "doc_id")
    found = labels.unionAll(labels.where("doc_id % 7 = 0")).unionAll(labels.where("doc_id % 11 = 0").select(F.col("doc_id") + 1000000000))
    return joins.ledger(read(spark, sf_dir, "documents", "doc_id"), found, "doc_id")


@query(
    """WITH b AS (SELECT o_custkey AS k, count(*) AS f FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS f FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
  SELECT k, b.f AS before, a.f AS after, CASE WHEN a.f IS NULL THEN 'removed' WHEN b.f IS NULL THEN 'added' ELSE 'changed' END AS change FROM b FULL JOIN a USING (k) WHERE a.f IS DISTINCT FROM b.f"""
)
def surface_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    count = lambda odd: o.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("f"))
    return joins.delta(count(0), count(1), "k", "f")


@query(
    """SELECT l_suppkey, count(DISTINCT p_size % 25) AS n_items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
  HAVING count(DISTINCT p_size % 25) = (SELECT count(DISTINCT p_size % 25) FROM part)"""
)
def division_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("size"))
    l = read(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")  # noqa: E741
    return joins.covers_all(l.join(part, l.l_partkey == part.p_partkey), "l_suppkey", "size", part)


@query(
    """SELECT conv_id, run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (
  SELECT *, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations)) GROUP BY 1, 2, 3"""
)
def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of one role as islands."""
    return release.runs_of(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role"])


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("valid"))
