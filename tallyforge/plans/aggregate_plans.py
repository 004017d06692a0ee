"""Queries over counts, ratios, metrics, gates, votes, costs, journals and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import aggregates as A, release
from .registry import query, read


@query(
    """SELECT CAST(user_id AS VARCHAR) AS file_path, count(*) AS commits, count(*) FILTER (event_type = 'error') AS reverts,
  array_to_string(list_filter([CASE WHEN count(*) >= 8 THEN 'high churn (' || count(*) || ' commits touched this file)' END,
    CASE WHEN count(*) FILTER (event_type = 'error') >= 1 AND count(*) >= 3 THEN 'rework-heavy file (' || count(*) || ' commits, ' || count(*) FILTER (event_type = 'error') || ' revert-like commits)' END], lambda x: x IS NOT NULL), '; ') AS reasons
  FROM events GROUP BY user_id"""
)
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path"), F.col("event_id").alias("sha"), F.when(F.col("event_type") == "error", "Revert it").otherwise("Add it").alias("subject"))
    return A.churn(commits).withColumn("reasons", F.array_join("reasons", "; "))


@query("SELECT source, arg_min(lang, (-n, lang)) AS dominant, max(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def dominant_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dominant(read(spark, sf_dir, "documents", "source", "lang"), "source", "lang")


_EVAL = """WITH j AS (SELECT lang, CASE quality WHEN 0 THEN 'slop' ELSE 'clean' END AS e, CASE WHEN toxic = 1 OR n_chars > 4000 THEN 'slop' WHEN n_chars < 300 THEN 'kinda_slop' ELSE 'clean' END AS p FROM labels JOIN documents USING (doc_id)),
  c AS (SELECT lang, count(*) AS cases, count(*) FILTER (e = 'slop' AND p = 'slop') AS slop_tp, count(*) FILTER (p = 'slop') AS sp, count(*) FILTER (e = 'slop') AS se,
    count(*) FILTER (e <> 'clean' AND p <> 'clean') AS finding_tp, count(*) FILTER (p <> 'clean') AS fp, count(*) FILTER (e <> 'clean') AS fe, count(*) FILTER (e = 'clean' AND p <> 'clean') AS false_positives FROM j GROUP BY ROLLUP (lang)),
  m AS (SELECT lang, cases, slop_tp, finding_tp, false_positives, CASE WHEN sp = 0 THEN 1.0 ELSE slop_tp / sp END AS slop_precision, CASE WHEN se = 0 THEN 1.0 ELSE slop_tp / se END AS slop_recall,
    CASE WHEN fp = 0 THEN 1.0 ELSE finding_tp / fp END AS finding_precision, CASE WHEN fe = 0 THEN 1.0 ELSE finding_tp / fe END AS finding_recall, CASE WHEN cases - fe = 0 THEN 0.0 ELSE false_positives / (cases - fe) END AS false_positive_rate FROM c)"""
_RATIOS = ["slop_precision", "slop_recall", "finding_precision", "finding_recall", "false_positive_rate"]


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars"), "doc_id")
    expected = F.when(F.col("quality") == 0, "slop").otherwise("clean")
    predicted = F.when((F.col("toxic") == 1) | (F.col("n_chars") > 4000), "slop").when(F.col("n_chars") < 300, "kinda_slop").otherwise("clean")
    return A.metrics(j.select("lang", expected.alias("expected_tier"), predicted.alias("predicted_tier")), ["lang"])


@query(_EVAL + "SELECT lang, cases, slop_tp, finding_tp, false_positives, " + ", ".join(f"round({r}, 6) AS {r}" for r in _RATIOS) + " FROM m")
def metric_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).withColumns({r: F.round(r, 6) for r in _RATIOS})


@query(
    _EVAL
    + """SELECT lang, array_to_string(list_filter([CASE WHEN slop_precision < 0.95 THEN 'slop_precision below 0.95' END, CASE WHEN finding_precision < 0.85 THEN 'finding_precision below 0.85' END,
  CASE WHEN finding_recall < 0.80 THEN 'finding_recall below 0.80' END], lambda x: x IS NOT NULL), '; ') AS errors FROM m"""
)
def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.failed_gates(_evaluated(spark, sf_dir)).select("lang", F.array_join("errors", "; ").alias("errors"))


@query(
    """WITH r AS (SELECT DISTINCT conv_id, turn % 2 AS run, role FROM conversations), s AS (SELECT conv_id, count(DISTINCT role) = 1 AS same, count(DISTINCT run) AS n FROM r GROUP BY 1)
  SELECT round(count(*) FILTER (same) / count(*), 6) AS stable_share, round(count(*) FILTER (n = (SELECT count(DISTINCT turn % 2) FROM conversations)) / count(*), 6) AS shared_share FROM s"""
)
def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("run"), "role").distinct()
    return A.repeatability(runs, "conv_id", "run", ["role"]).select(F.round("stable_share", 6).alias("stable_share"), F.round("shared_share", 6).alias("shared_share"))


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_rate FROM documents")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_rate(read(spark, sf_dir, "documents", "text"), F.sha2("text", 256)).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query(
    """WITH c AS (SELECT user_id, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, max(n) AS m FROM c GROUP BY 1)
  SELECT user_id, CASE WHEN count(*) > 1 THEN 'unresolved' ELSE min(v) END AS verdict, any_value(m) AS n_votes, count(*) > 1 AS tie FROM c JOIN t USING (user_id) WHERE n = m GROUP BY user_id"""
)
def vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(read(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type")


@query("SELECT event_id, user_id, round(s, 4) AS spent_before, s < 500 AS admitted FROM (SELECT event_id, user_id, coalesce(sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events)")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend before each event of a user; an event is admitted while that is below the limit."""
    e = release.admitted(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 500)
    return e.select("event_id", "user_id", F.round("spent_before", 4).alias("spent_before"), "admitted")


@query(
    """WITH t AS (SELECT conv_id, CAST(sum((strlen(text) + 3) // 4) FILTER (role <> 'assistant') AS BIGINT) AS i, CAST(sum((strlen(text) + 3) // 4) FILTER (role = 'assistant') AS BIGINT) AS o, count(*) AS n FROM conversations GROUP BY 1)
  SELECT conv_id, coalesce(i, 0) AS tokens_in, coalesce(o, 0) AS tokens_out, (n + 7) // 8 AS batches, round((coalesce(i, 0) - least(100, coalesce(i, 0))) * 0.14::DOUBLE + least(100, coalesce(i, 0)) * 0.0028::DOUBLE + coalesce(o, 0) * 0.28::DOUBLE, 6) AS micro_cost FROM t"""
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.floor((F.octet_length("text") + 3) / 4)
    answer = F.col("role") == "assistant"
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(~answer, tokens)), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.when(answer, tokens)), F.lit(0)).alias("tokens_out"), F.count("*").alias("n"))
    cost = A.token_cost(F.col("tokens_in"), F.lit(100), F.col("tokens_out"))
    return t.select("conv_id", "tokens_in", "tokens_out", A.batches(F.col("n")).alias("batches"), F.round(cost * 1e6, 6).alias("micro_cost"))


@query(
    """WITH f AS (SELECT o_orderkey, count(*) AS m, sum(l_quantity) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), s AS (SELECT CAST(sum(m) AS BIGINT) AS methods, CAST(sum((m + 7) // 8) AS BIGINT) AS batches, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(c * ((m + 7) // 8) + c) AS BIGINT) AS review FROM f)
  SELECT methods, batches, (2 * review + 1800 * methods + 2) // 3 AS input_low, (3 * review + chars + 6000 * methods + 2) // 3 AS input_high, 250 * methods AS output_low, 900 * methods AS output_high,
  2 * batches AS requests_low, 3 * batches AS requests_high, 5 * ((2 * batches + 3) // 4) AS seconds_low, 120 * ((3 * batches + 3) // 4) AS seconds_high FROM s"""
)
def scan_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n_methods"), F.sum("l_quantity").cast("long").alias("file_chars")).withColumn("method_chars", F.col("file_chars"))
    return A.estimate(files)


@query(
    """SELECT doc_id, count(DISTINCT reviewer) AS reviewers, count(DISTINCT sig) AS signatures, CASE WHEN count(DISTINCT reviewer) < 2 THEN 'incomplete' WHEN count(DISTINCT sig) = 1 THEN 'agreed' ELSE 'disputed' END AS status
  FROM (SELECT doc_id, 'a' AS reviewer, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS sig FROM documents UNION ALL SELECT doc_id, 'b', quality FROM labels) GROUP BY 1"""
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on lengths and the labels as two reviewers; documents without a label have one."""
    a = read(spark, sf_dir, "documents").select("doc_id", F.lit("a").alias("reviewer"), (F.col("n_chars") > 1000).cast("int").alias("sig"))
    b = read(spark, sf_dir, "labels").select("doc_id", F.lit("b").alias("reviewer"), F.col("quality").alias("sig"))
    return A.agreement(a.unionByName(b), "doc_id", "reviewer", F.col("sig"))


@query(
    """SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type in tumbling hours."""
    w = read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "n", "total")


@query(
    """SELECT user_id, session, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with gaps of an hour at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    e = read(spark, sf_dir, "events").withColumn("c", F.when(gap <= 3_600_000_000, 0).otherwise(1)).withColumn("session", F.sum("c").over(w))
    return e.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT CAST(ts AS DATE) AS d, user_id, arg_max(event_type, event_id) AS status, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
  SELECT CAST(d AS VARCHAR) AS scan, CAST(sum(n) AS BIGINT) AS events, count(*) AS units, round(sum(v), 3) AS spent, count(*) FILTER (status = 'error') AS failed FROM l GROUP BY d"""
)
def journal_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as scans: events, units, spend and units whose last event is an error."""
    e = read(spark, sf_dir, "events").withColumn("scan", F.to_date("ts").cast("string"))
    s = A.journal_summary(e, "scan", "user_id", "event_id", "event_type", "value")
    return s.select("scan", "events", "units", F.round("spent", 3).alias("spent"), F.coalesce(F.try_element_at("statuses", F.lit("error")), F.lit(0)).alias("failed"))
