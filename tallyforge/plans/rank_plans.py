"""Queries over seeded ranks, quotas, slots, commitments and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing as H
from ..operators import ranking as R
from .registry import query, read

CONTRACT, SEED = "census-rank-v1", "5f3a9c01"


def _digest_sql(*keys: str) -> str:
    return "sha256(" + " || chr(0) || ".join([f"'{CONTRACT}'", f"'{SEED}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]) + ")"


@query(f"SELECT o_orderkey, {_digest_sql('o_orderkey', 'o_custkey')} AS digest, row_number() OVER (ORDER BY {_digest_sql('o_orderkey', 'o_custkey')}, o_orderkey) AS rank FROM orders")
def hash_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hash_rank(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), CONTRACT, SEED, ["o_orderkey", "o_custkey"]).select("o_orderkey", "digest", "rank")


@query(f"SELECT doc_id, {_digest_sql('doc_id')} AS digest, row_number() OVER (ORDER BY {_digest_sql('doc_id')}) AS rank FROM documents ORDER BY digest LIMIT 50")
def hash_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of least digest."""
    return R.hash_rank(read(spark, sf_dir, "documents", "doc_id"), CONTRACT, SEED, ["doc_id"], 50)


_RANKED = f"(SELECT doc_id, lang, source, n_chars, {_digest_sql('doc_id')} AS digest FROM documents)"


@query(
    f"""SELECT doc_id, lang, CASE WHEN n_chars < 500 THEN 'excluded' WHEN row_number() OVER (PARTITION BY lang, n_chars < 500 ORDER BY digest) <= 20 THEN 'selected' ELSE 'quota_filled' END AS outcome FROM {_RANKED}"""
)
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quota_fill(_ranked(spark, sf_dir), "lang", "digest", 20, F.col("n_chars") >= 500).select("doc_id", "lang", "outcome")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").withColumn("digest", H.rank_digest(CONTRACT, SEED, F.col("doc_id")))


@query(
    f"""SELECT lang, CAST(slot AS INTEGER) AS slot, doc_id, doc_id IS NOT NULL AS filled FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL UNION SELECT 'xx') CROSS JOIN (SELECT unnest(range(1, 11)) AS slot)
  LEFT JOIN (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY digest) AS slot FROM {_RANKED}) USING (lang, slot)"""
)
def category_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten slots for every language of the documents, and for one that none has."""
    ranked = _ranked(spark, sf_dir)
    languages = sorted(r["lang"] for r in ranked.where("lang is not null").select("lang").distinct().collect())  # a row a language
    return R.category_slots(ranked, "lang", "digest", [*languages, "xx"], 10).select("lang", "slot", "doc_id", "filled")


@query(
    f"""WITH r AS (SELECT o_orderkey, c_custkey, c_mktsegment, {_digest_sql('o_orderkey')} AS digest FROM orders JOIN customer ON o_custkey = c_custkey),
  b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY digest) = 1)
  SELECT o_orderkey, c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY digest) AS INTEGER) AS slot FROM b QUALIFY slot <= 128"""
)
def greedy_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    ranked = o.join(c, o.o_custkey == c.c_custkey).withColumn("digest", H.rank_digest(CONTRACT, SEED, F.col("o_orderkey")))
    return R.greedy_slots_single(ranked, "c_custkey", "c_mktsegment", "digest", 128).select("o_orderkey", "c_custkey", "c_mktsegment", "slot")


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY digest) AS k FROM {_RANKED}),
  r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS langs, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS lang, CAST(0 AS INTEGER) AS slot UNION ALL
    SELECT d.k, CASE WHEN ok THEN list_append(taken, d.source) ELSE taken END, CASE WHEN ok THEN list_append(langs, d.lang) ELSE langs END, d.doc_id, d.source, d.lang, CAST(CASE WHEN ok THEN n + 1 ELSE 0 END AS INTEGER)
    FROM (SELECT r.taken, r.langs, d.k, d.doc_id, d.source, d.lang, len(list_filter(r.langs, lambda x: x = d.lang)) AS n, NOT list_contains(r.taken, d.source) AND len(list_filter(r.langs, lambda x: x = d.lang)) < 4 AS ok FROM r JOIN d ON d.k = r.k + 1) d)
  SELECT doc_id, source, lang, slot FROM r WHERE slot > 0"""
)
def greedy_slots_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection where repositories (sources) have several languages."""
    return R.greedy_slots(_ranked(spark, sf_dir), "source", "lang", "digest", 4).select("doc_id", "source", "lang", "slot")


@query(f"SELECT CAST(DATE '2026-01-01' + CAST({int(SEED[:8], 16)} % 180 AS INTEGER) AS VARCHAR) AS day, r_regionkey FROM region")
def seed_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(R.seed_date(SEED, "2026-01-01", 180).cast("string").alias("day"), "r_regionkey")


@query(
    """SELECT 'nation' AS name, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS commitment FROM (SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS h FROM nation)
  UNION ALL SELECT 'region', count(*), sha256(string_agg(h, chr(10) ORDER BY h)) FROM (SELECT sha256('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS h FROM region)"""
)
def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent commitments to the rows of small tables."""

    def one(name: str) -> DataFrame:
        df = read(spark, sf_dir, name)
        rows = df.select(H.commitment(*[F.col(c) for c in df.columns]).alias("h"))
        return rows.agg(F.count("*").alias("n"), H.set_commitment(F.col("h")).alias("commitment")).select(F.lit(name).alias("name"), "n", "commitment")

    return one("nation").unionByName(one("region"))


@query("SELECT doc_id, sha256(strlen(lang) || ':' || lang || strlen(source) || ':' || source || strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id) AS unit_id FROM documents")
def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "lang", "source").select("doc_id", H.unit_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("unit_id"))


@query(
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  WHERE n <= 24 OR list_contains(list_transform(range(0, 8), lambda i: i * (n - 1) // 7), pos)"""
)
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spread_sample(read(spark, sf_dir, "events", "user_id", "event_id"), "user_id", ["event_id"], 24, 8)


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  r AS (SELECT conv_id, turn, chars, k, 1 AS batch, 1 AS n, chars AS used FROM t WHERE k = 1 UNION ALL
    SELECT t.conv_id, t.turn, t.chars, t.k, CASE WHEN r.n = 8 OR r.used + t.chars > 4000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n = 8 OR r.used + t.chars > 4000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n = 8 OR r.used + t.chars > 4000 THEN t.chars ELSE r.used + t.chars END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
  SELECT conv_id, turn, chars, batch FROM r"""
)
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in batches of eight turns and 4,000 characters at most."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return R.greedy_batches(turns, "conv_id", ["turn"], "chars", 8, 4000)
