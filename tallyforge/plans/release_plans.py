"""Queries over ledgers of reviews, releases, selections, sealed results and resumable work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing, json_text, text as T
from ..operators import graph as G, joins, release as R, reviews as V
from ..sources import compiler, frames, patches, sinks
from ..storage import fresh_path
from . import fixtures as X, ledgers as L
from .registry import query, read

# ---- answers as ledgers


@query(
    """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"tier": "clean", "reason": ' || to_json(event_type) || '}' WHEN 2 THEN '{"tier": 3, "reason": "x"}' WHEN 3 THEN '[1]' WHEN 4 THEN '{"role": "library", "reason": null}' ELSE 'no json' END AS payload, CASE event_id % 6 WHEN 4 THEN 'role' ELSE 'scoped_tier' END AS schema FROM events),
  k AS (SELECT *, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN json_type(payload) END AS t FROM a),
  f AS (SELECT *, unnest(CASE schema WHEN 'role' THEN ['role', 'reason'] ELSE ['tier', 'reason'] END) AS field FROM k),
  g AS (SELECT event_id, any_value(ok) AS ok, any_value(t) AS t, coalesce(string_agg(field, ', ' ORDER BY field) FILTER (ok AND t = 'OBJECT' AND json_type(CASE WHEN ok THEN payload ELSE '{}' END, '$.' || field) IS NULL), '') AS missing,
    coalesce(string_agg(field, ', ' ORDER BY field) FILTER (ok AND t = 'OBJECT' AND json_type(CASE WHEN ok THEN payload ELSE '{}' END, '$.' || field) <> 'VARCHAR'), '') AS wrong FROM f GROUP BY 1)
  SELECT event_id, missing, wrong, CASE WHEN NOT ok OR t <> 'OBJECT' THEN 'not an object' WHEN missing <> '' THEN 'missing ' || missing WHEN wrong <> '' THEN 'wrong type of ' || wrong END AS error FROM g"""
)
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events, checked against the fields of their kind."""
    k = F.col("event_id") % 6
    said = F.concat(F.lit('{"tier": "clean", "reason": "'), "event_type", F.lit('"}'))
    payload = F.when(k == 0, F.col("props")).when(k == 1, said).when(k == 2, '{"tier": 3, "reason": "x"}').when(k == 3, "[1]").when(k == 4, '{"role": "library", "reason": null}').otherwise("no json")
    e = read(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_id", payload.alias("payload"), F.when(k == 4, "role").otherwise("scoped_tier").alias("schema"))
    return V.schema_errors(e).select("event_id", F.array_join("missing", ", ").alias("missing"), F.array_join("wrong_type", ", ").alias("wrong"), "error")


@query(X.values("answer_id int, item int, case_id string, decision string, merge_into string, error string", L.ADJUDICATED))
def adjudication_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on cases, each with the first rule that it breaks."""
    found = V.adjudications(L.answers(spark, L.ADJUDICATIONS), X.table(spark, "answer_id int, case_id string", L.CASES))
    return found.select("answer_id", "item", "case_id", "decision", "merge_into", "error")


@query(X.values("answer_id int, accepted boolean, n_errors long, error string", L.ACCEPTED))
def accepted_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers: accepted only without any error."""
    return V.accepted(V.adjudications(L.answers(spark, L.ADJUDICATIONS), X.table(spark, "answer_id int, case_id string", L.CASES)))


@query(X.values("answer_id int, item int, case_id string, edits string, error string", L.PROVEN))
def proof_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual proofs with exact edits."""
    found = V.proofs(L.answers(spark, L.PROOFS), X.table(spark, "answer_id int, case_id string", L.PROOF_CASES))
    return found.select("answer_id", "item", "case_id", "edits", "error")


@query(X.values("answer_id int, item int, case_id string, error string", L.SYNTHESIZED))
def synthesis_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases over several units with evidence from their sources."""
    found = V.synthesized(L.answers(spark, L.SYNTHESIS), X.table(spark, "unit_id string, tier string, source string", L.UNITS))
    return found.select("answer_id", "item", "case_id", "error")


@query(X.values("answer_id int, tier string, behavior_status string, error string", L.REVIEWED))
def semantic_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reviews by the contracts of their tiers."""
    return V.semantic_reviews(L.answers(spark, L.REVIEWS)).select("answer_id", "tier", "behavior_status", "error")


@query(X.values("k int, content string, salvaged string, retry string", L.CONTENTS))
def answer_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of providers' answers, the object found in each, and the class of the error that goes with it."""
    rows = X.table(spark, "k int, body string, error string", L.BODIES).repartition(2)
    content = V.content_of(F.col("body"))
    return rows.select("k", content.alias("content"), json_text.salvaged(content).alias("salvaged"), json_text.retry_class(F.col("error")).alias("retry"))


@query(X.values("k int, start int, end_line int, how string", L.LOCATED))
def quote_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes stand in a method's source."""
    rows = X.table(spark, "k int, source string, first_line int, s int, e int, quote string", L.QUOTES)
    at = V.quote_location(F.col("source"), F.col("first_line"), F.col("s"), F.col("e"), F.col("quote"))
    return rows.withColumn("at", at).select("k", F.col("at.start").alias("start"), F.col("at.end").alias("end_line"), F.col("at.how").alias("how"))


@query(
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), q AS (SELECT doc_id, CAST(len(l) AS INTEGER) AS n, l, CASE doc_id % 3 WHEN 0 THEN l[1] WHEN 1 THEN 'nothing of it' ELSE '' END AS quote FROM d)
  SELECT doc_id, quote IS NOT NULL AND trim(quote) <> '' AND contains(l[1], quote) AS valid FROM q WHERE len(l) > 0 AND l[1] IS NOT NULL"""
)
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of first lines, held against them."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    quote = F.when(F.col("doc_id") % 3 == 0, first).when(F.col("doc_id") % 3 == 1, "nothing of it").otherwise("")
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", T.evidence_valid(F.col("text"), F.lit(1), F.lit(1), quote).alias("valid"))


# ---- releases

_CASES = "SELECT doc_id AS case_id, CASE quality WHEN 0 THEN 'slop' ELSE 'clean' END AS expected_tier, lang, CASE WHEN n_chars > 2000 THEN 'blind_oss' ELSE 'historical' END AS part, CAST(doc_id % 3 AS INTEGER) AS expected_proof_level, doc_id % 4 = 0 AS maintainer FROM labels JOIN documents USING (doc_id)"
_PREDICTIONS = """SELECT 'r' || k AS run_id, doc_id * 10 + k AS prediction_id, CASE WHEN doc_id % 17 = 5 THEN NULL ELSE doc_id END AS case_id, CASE WHEN (doc_id + k) % 19 = 7 THEN 'unresolved' WHEN quality = 0 THEN 'slop' WHEN toxic = 1 THEN 'kinda_slop' ELSE 'clean' END AS tier,
  CAST(doc_id % 50 AS VARCHAR) AS fingerprint, CAST((doc_id + k) % 4 AS INTEGER) AS proof_level, doc_id % 23 <> 0 AS evidence_valid, CASE WHEN quality = 0 THEN 'accepted' WHEN toxic = 1 THEN 'rejected' ELSE 'unreviewed' END AS disposition, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.0 END AS minutes FROM labels, (SELECT unnest([1, 2]) AS k)"""
_JOINED = f"""c AS ({_CASES}), p AS ({_PREDICTIONS}), o AS (SELECT run_id, case_id, arg_min(tier, prediction_id) AS tier FROM p WHERE case_id IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT r.run_id, c.*, coalesce(o.tier, 'clean') AS t FROM c CROSS JOIN (SELECT DISTINCT run_id FROM p) r LEFT JOIN o ON o.run_id = r.run_id AND o.case_id = c.case_id)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars"), "doc_id")
    return both.selectExpr("doc_id AS case_id", "CASE quality WHEN 0 THEN 'slop' ELSE 'clean' END AS expected_tier", "lang", "CASE WHEN n_chars > 2000 THEN 'blind_oss' ELSE 'historical' END AS part", "CAST(doc_id % 3 AS INT) AS expected_proof_level", "doc_id % 4 = 0 AS maintainer")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return labels.selectExpr(
        "'r' || k AS run_id", "doc_id * 10 + k AS prediction_id", "CASE WHEN doc_id % 17 = 5 THEN NULL ELSE doc_id END AS case_id", "CASE WHEN (doc_id + k) % 19 = 7 THEN 'unresolved' WHEN quality = 0 THEN 'slop' WHEN toxic = 1 THEN 'kinda_slop' ELSE 'clean' END AS tier",
        "CAST(doc_id % 50 AS STRING) AS fingerprint", "CAST((doc_id + k) % 4 AS INT) AS proof_level", "doc_id % 23 <> 0 AS evidence_valid", "CASE WHEN quality = 0 THEN 'accepted' WHEN toxic = 1 THEN 'rejected' ELSE 'unreviewed' END AS disposition", "CASE WHEN toxic = 1 THEN 0.5D ELSE 0.0D END AS minutes",
    )


_F = "IN ('slop', 'kinda_slop')"


@query(
    f"""WITH {_JOINED}, s AS (SELECT unnest(['r1', 'r2']) AS run_id, unnest([['blind_oss', 'historical', 'research'], ['blind_oss', 'historical', 'research']]) AS parts), x AS (SELECT run_id, unnest(parts) AS part FROM s)
  SELECT x.run_id, x.part, count(case_id) AS cases, count(*) FILTER (expected_tier = 'slop' AND t = 'slop') AS slop_tp, count(*) FILTER (expected_tier = 'clean' AND t {_F}) AS false_positives,
  round(CASE WHEN count(*) FILTER (t = 'slop') = 0 THEN 1 ELSE count(*) FILTER (expected_tier = 'slop' AND t = 'slop') / count(*) FILTER (t = 'slop') END, 6) AS slop_precision,
  round(CASE WHEN count(*) FILTER (expected_tier {_F}) = 0 THEN 1 ELSE count(*) FILTER (expected_tier {_F} AND t {_F}) / count(*) FILTER (expected_tier {_F}) END, 6) AS finding_recall
  FROM x LEFT JOIN j ON j.run_id = x.run_id AND j.part = x.part GROUP BY 1, 2"""
)
def partition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each run and partition, also of a partition without cases."""
    joined = R.joined_predictions(_cases(spark, sf_dir), _predictions(spark, sf_dir))
    slices = X.table(spark, "run_id string, part string", [(r, p) for r in ("r1", "r2") for p in ("blind_oss", "historical", "research")])
    m = R.sliced_metrics(joined, slices, ["run_id", "part"])
    return m.select("run_id", "part", "cases", "slop_tp", "false_positives", F.round("slop_precision", 6).alias("slop_precision"), F.round("finding_recall", 6).alias("finding_recall"))


_RATES = f"""n AS (SELECT count(*) AS n FROM c), q AS (SELECT p.*, c.expected_proof_level, c.maintainer FROM p LEFT JOIN c USING (case_id)), d AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM p GROUP BY run_id, fingerprint)),
  a AS (SELECT count(*) AS all_, count(*) FILTER (case_id IS NULL AND tier {_F}) AS unmatched_findings, count(*) FILTER (case_id IS NULL AND tier = 'slop') AS unmatched_slop, count(*) FILTER (tier = 'unresolved') AS u, count(*) FILTER (case_id IS NULL AND tier = 'unresolved') AS uu, count(*) FILTER (tier {_F}) AS f,
    count(*) FILTER (tier {_F} AND proof_level >= expected_proof_level) AS pr, count(*) FILTER (tier {_F} AND evidence_valid) AS va, count(*) FILTER (disposition = 'accepted') AS accepted, count(*) FILTER (disposition <> 'unreviewed') AS reviewed, count(*) FILTER (maintainer) AS m, count(*) FILTER (maintainer AND disposition = 'accepted') AS ma, CAST(sum(minutes) AS DOUBLE) AS minutes FROM q),
  z AS (SELECT 2 AS run_count, unmatched_findings, unmatched_slop, accepted AS accepted_findings, reviewed AS reviewed_findings, minutes AS reviewer_minutes, CAST(d AS DOUBLE) / all_ AS duplicate_case_rate, u / (n * 2 + uu) AS unresolved_rate, pr / f AS proof_level_accuracy, va / f AS overall_evidence_validity, ma / m AS maintainer_acceptance, accepted / minutes AS accepted_findings_per_minute, 4200.0 / 1000 / 5000 AS cost_usd_per_1000_methods FROM a, d, n)"""
_RATE_NAMES = ["duplicate_case_rate", "unresolved_rate", "proof_level_accuracy", "overall_evidence_validity", "maintainer_acceptance", "accepted_findings_per_minute", "cost_usd_per_1000_methods"]


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.table(spark, "run_id string, methods long, cost_microusd long", [("r1", 2000, 1200), ("r2", 3000, 3000)])
    return R.release_rates(_predictions(spark, sf_dir), _cases(spark, sf_dir), runs)


@query(f"WITH {_JOINED}, {_RATES} SELECT CAST(run_count AS BIGINT) AS run_count, unmatched_findings, unmatched_slop, accepted_findings, reviewed_findings, reviewer_minutes, {', '.join(f'round({r}, 6) AS {r}' for r in _RATE_NAMES)} FROM z")
def release_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a submission of two runs."""
    return _rates(spark, sf_dir).withColumns({r: F.round(r, 6) for r in _RATE_NAMES})


@query(
    f"""WITH {_JOINED}, {_RATES}, e AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS place, unnest([CASE WHEN overall_evidence_validity < 1 THEN 'evidence validity < 1.00' END, CASE WHEN 0.5 < 0.9 THEN 'verdict repeatability < 0.90' END, CASE WHEN proof_level_accuracy < 1 THEN 'proof-level compliance < 1.00' END, CASE WHEN cost_usd_per_1000_methods > 0.75 THEN 'cost per 1,000 methods > 0.75' END,
    CASE WHEN duplicate_case_rate > 0.02 THEN 'duplicate-case rate > 0.02' END, CASE WHEN accepted_findings = 0 OR reviewed_findings = 0 OR reviewer_minutes <= 0 THEN 'no measurable accepted finding' END]) AS error FROM z)
  SELECT place, error FROM e WHERE error IS NOT NULL UNION ALL SELECT 6, 'not better than fast' FROM z WHERE accepted_findings_per_minute <= 1000.0"""
)
def release_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failed gates of the submission, with two baselines."""
    baselines = X.table(spark, "tool_id string, accepted long, minutes double", [("fast", 1000, 1.0), ("slow", 0, 0.0)])
    found = R.release_errors(_rates(spark, sf_dir).withColumn("verdict_repeatability", F.lit(0.5)), baselines)
    return found.select(F.col("place").cast("int").alias("place"), "error")


@query(
    f"""WITH {_JOINED}, m AS (SELECT run_id, count(*) FILTER (expected_tier = 'slop' AND t = 'slop') AS a, count(*) FILTER (t = 'slop') AS b, count(*) FILTER (expected_tier {_F} AND t {_F}) AS x, count(*) FILTER (t {_F}) AS y FROM j GROUP BY 1),
  l AS (SELECT run_id, count(*) FILTER (tier = 'slop') AS s, count(*) FILTER (tier {_F}) AS f FROM p WHERE case_id IS NULL GROUP BY 1)
  SELECT run_id, round(a / (b + coalesce(s, 0)), 6) AS slop_precision, round(x / (y + coalesce(f, 0)), 6) AS finding_precision, CASE WHEN a / (b + coalesce(s, 0)) < 0.95 THEN 'slop_precision < 0.95; ' ELSE '' END || CASE WHEN x / (y + coalesce(f, 0)) < 0.85 THEN 'finding_precision < 0.85' ELSE '' END AS errors FROM m LEFT JOIN l USING (run_id)"""
)
def adjusted_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of each run with unmatched findings counted, and the gates that it fails."""
    p = _predictions(spark, sf_dir)
    found = R.run_errors(R.adjusted_precisions(R.joined_predictions(_cases(spark, sf_dir), p), p))
    return found.select("run_id", F.round("slop_precision", 6).alias("slop_precision"), F.round("finding_precision", 6).alias("finding_precision"), F.concat(F.when(F.array_contains("errors", "slop_precision < 0.95"), "slop_precision < 0.95; ").otherwise(""), F.when(F.array_contains("errors", "finding_precision < 0.85"), "finding_precision < 0.85").otherwise("")).alias("errors"))


@query(
    """SELECT doc_id AS unit_id, 2 AS reviewers, CASE WHEN quality = 0 AND toxic = 1 THEN 'rejected' WHEN quality = 1 AND toxic = 0 AND doc_id % 4 <> 1 THEN 'accepted' ELSE 'disputed' END AS status FROM labels"""
)
def two_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, rejected and disputed labels of two reviewers."""
    labels = read(spark, sf_dir, "labels")
    other = F.col("doc_id") % 4 >= 2
    a = labels.select(F.col("doc_id").alias("unit_id"), F.lit("a").alias("reviewer_id"), F.when(F.col("quality") == 0, "reject").otherwise("accept").alias("verdict"), F.when(other, "other").otherwise("contract_fog").alias("pattern"), F.lit("Odd  Thing").alias("other_pattern"))
    b = labels.select(F.col("doc_id").alias("unit_id"), F.lit("b").alias("reviewer_id"), F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("verdict"), F.when(F.col("doc_id") % 4 == 1, "band_aid_control_flow").when(other, "other").otherwise("contract_fog").alias("pattern"), F.lit(" odd thing ").alias("other_pattern"))
    return R.two_reviewer_status(a.unionByName(b)).withColumn("reviewers", F.col("reviewers").cast("int"))


@query("SELECT doc_id AS method_id, CASE quality WHEN 0 THEN 'slop' ELSE 'clean' END AS a, CASE toxic WHEN 1 THEN 'kinda_slop' ELSE 'clean' END AS b FROM labels")
def review_worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a method with each reviewer's tier."""
    labels = read(spark, sf_dir, "labels")
    a = labels.select(F.col("doc_id").alias("method_id"), F.lit("a").alias("reviewer_id"), F.when(F.col("quality") == 0, "slop").otherwise("clean").alias("tier"))
    b = labels.select(F.col("doc_id").alias("method_id"), F.lit("b").alias("reviewer_id"), F.when(F.col("toxic") == 1, "kinda_slop").otherwise("clean").alias("tier"))
    return R.worksheets(a.unionByName(b), ["a", "b"])


@query(
    """WITH m AS (SELECT lang, CASE quality WHEN 0 THEN 'slop' WHEN 1 THEN 'clean' END AS tier FROM documents LEFT JOIN labels USING (doc_id))
  SELECT CASE WHEN tier IS NULL THEN 'pending_by_language' ELSE 'completed_by_language' END AS kind, lang AS name, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'completed_by_tier', tier, count(*) FROM m WHERE tier IS NOT NULL GROUP BY 2"""
)
def label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is labelled, by language and tier."""
    m = read(spark, sf_dir, "documents", "doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return R.label_progress(m.select(F.col("doc_id").alias("method_id"), F.col("lang").alias("language"), F.when(F.col("quality") == 0, "slop").when(F.col("quality") == 1, "clean").alias("tier")))


@query(
    """WITH m AS (SELECT source AS repository, lang AS language, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source AS repository, count(*) + CASE WHEN min(doc_id) % 2 = 0 THEN 1 ELSE 0 END AS total FROM documents GROUP BY 1), s AS (SELECT repository, sum(n) AS s FROM m GROUP BY 1)
  SELECT repository, language, n, s = total AS sums_up FROM m JOIN s USING (repository) JOIN t USING (repository)"""
)
def method_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language beside declared totals, of which some are wrong."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source")
    declared = d.groupBy(F.col("source").alias("repository")).agg((F.count("*") + F.when(F.min("doc_id") % 2 == 0, 1).otherwise(0)).alias("total"))
    return R.method_census(d.select(F.col("source").alias("repository"), F.col("lang").alias("language")), declared)


@query("SELECT source, count(*) FILTER (quality = 1) AS clean, 0 AS kinda_slop, count(*) FILTER (quality = 0) AS slop, count(*) FILTER (quality IS NULL) AS unresolved FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of documents side by side for every source."""
    d = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return R.tier_pivot(d.select("source", F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "slop").otherwise("unresolved").alias("tier")), "source")


_OUTCOME = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'unfilled' WHEN 1 THEN 'excluded' WHEN 2 THEN 'review_closed' ELSE 'accepted' END"


@query(
    f"""WITH s AS (SELECT o_orderpriority AS language, {_OUTCOME} AS outcome FROM orders), g AS (SELECT language, count(*) AS fixed, count(*) FILTER (outcome <> 'unfilled') AS selected, count(*) FILTER (outcome = 'unfilled') AS unfilled, count(*) FILTER (outcome = 'excluded') AS excluded, count(*) FILTER (outcome = 'review_closed') AS review_closed, count(*) FILTER (outcome = 'accepted') AS accepted FROM s GROUP BY ROLLUP (language))
  SELECT *, CASE WHEN language IS NULL THEN accepted >= 240 AND (SELECT min(accepted) FROM g WHERE language IS NOT NULL) >= 40 ELSE accepted >= 40 END AS passes FROM g"""
)
def slot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by language and in total, and whether enough were accepted."""
    slots = read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS language", f"{_OUTCOME} AS outcome")
    return R.slot_summary(slots, 40, 240)


@query(f"SELECT count(*) FILTER (o = 'accepted') AS accepted, count(*) FILTER (o = 'excluded') AS excluded, count(*) FILTER (o = 'never') AS never FROM (SELECT {_OUTCOME} AS o FROM orders)")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcome_counts(read(spark, sf_dir, "orders").selectExpr(f"{_OUTCOME} AS o"), "o", ["accepted", "excluded", "never"])


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_by(read(spark, sf_dir, "part", "p_brand"), "p_brand")


@query("SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(turn) AS BIGINT) AS turns, CAST(NULL AS BIGINT) AS too_many FROM conversations")
def checked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of whole numbers; one that is beyond a long is null."""
    c = read(spark, sf_dir, "conversations").select(F.octet_length("text").alias("bytes"), F.col("turn").alias("turns"), F.lit((1 << 63) - 1).alias("too_many"))
    return R.checked_sums(c, ["bytes", "turns", "too_many"])


@query(
    """WITH s AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS one FROM supplier GROUP BY 1)
  SELECT c_custkey AS atom_id, CASE WHEN n = 1 THEN one END AS subject_id, CASE WHEN n IS NULL THEN 'no subject' WHEN n > 1 THEN 'several subjects' END AS error FROM customer LEFT JOIN s ON c_nationkey = s_nationkey"""
)
def evidence_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of evidence with the one subject of their symbol."""
    atoms = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("atom_id"), F.col("c_nationkey").alias("symbol"), F.col("c_mktsegment").alias("kind"))
    subjects = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("symbol"), F.col("s_suppkey").alias("subject_id"))
    return R.evidence_subjects(atoms, subjects).select("atom_id", "subject_id", "error")


@query("SELECT DISTINCT doc_id, source FROM (SELECT doc_id, source FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def outside_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label covers."""
    return R.outside_corpus(read(spark, sf_dir, "documents", "doc_id", "source"), read(spark, sf_dir, "labels", "doc_id"), ["doc_id"])


@query(X.values("repository string, revision string, artifact_id string, status string", L.GROUPED))
def revision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed artifacts on the groups that wait for them."""
    return R.revision_groups(X.table(spark, "artifact_id string, repository string, revision string", L.ARTIFACTS), X.table(spark, "repository string, revision string", L.GROUPS))


# ---- selections


@query(
    """WITH p AS (SELECT doc_id, 'labels' AS part FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'labels' FROM labels)
  SELECT d.doc_id, coalesce(string_agg(DISTINCT part, ',' ORDER BY part), '') AS partitions FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY 1"""
)
def excluded_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all partitions that hold them."""
    labels = read(spark, sf_dir, "labels")
    parts = labels.select(F.lit("labels").alias("partition"), "doc_id").unionByName(labels.where("toxic = 1").select(F.lit("toxic").alias("partition"), "doc_id")).unionByName(labels.select(F.lit("labels").alias("partition"), "doc_id"))
    return R.excluded_partitions(read(spark, sf_dir, "documents", "doc_id"), parts, "doc_id").select("doc_id", F.array_join("partitions", ",").alias("partitions"))


_FACTS = [
    "c_custkey AS id", "c_custkey % 13 <> 1 AS accessible", "c_custkey % 11 <> 2 AS supported_shape", "c_custkey % 7 = 3 AS archived", "c_custkey % 9 = 4 AS fork", "CAST(c_custkey % 60 AS INT) AS method_count", "CASE WHEN c_custkey % 8 = 5 THEN NULL ELSE 'LICENSE' END AS license_path", "c_mktsegment AS language",
]


@query(
    f"""WITH f AS (SELECT {', '.join(_FACTS)} FROM customer), r AS (SELECT *, CASE WHEN NOT accessible THEN 'inaccessible' WHEN NOT supported_shape THEN 'unsupported_project_shape' WHEN archived THEN 'archived' WHEN fork THEN 'fork' WHEN method_count = 0 THEN 'no_supported_methods' WHEN license_path IS NULL THEN 'missing_license'
    WHEN language NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'unsupported_language' WHEN method_count < 10 THEN 'below_method_floor' WHEN method_count > 50 THEN 'above_method_ceiling' END AS stated FROM f)
  SELECT id, CASE WHEN stated IS NULL AND row_number() OVER (PARTITION BY language, stated IS NULL ORDER BY id) > 5 THEN 'quota_filled' ELSE stated END AS reason FROM r"""
)
def repository_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each repository, with the quota last."""
    facts = read(spark, sf_dir, "customer").selectExpr(*_FACTS)
    found = R.with_quota(facts, R.repository_exclusion(["AUTOMOBILE", "BUILDING", "MACHINERY"], 10, 50), "language", "id", 5)
    return found.select("id", "reason")


_HISTORY = [
    "o_orderkey AS id", "o_orderkey % 17 <> 1 AS accessible", "o_orderkey % 19 = 2 AS repository_empty", "o_orderkey % 23 <> 3 AS complete_history", "CAST(o_orderkey % 6 AS INT) AS matching_commits", "o_orderkey % 7 <> 4 AS supported_shape", "o_orderkey % 8 <> 5 AS production_change", "CAST(o_orderkey % 9 AS INT) AS affected_methods",
    "CAST(o_orderkey % 100 AS INT) AS method_count", "CAST(o_orderkey % 10 AS INT) AS lines_after", "7 AS lines_before", "CASE WHEN o_orderkey % 11 = 6 THEN ' ' ELSE 'LICENSE' END AS license_path", "CASE CAST(o_custkey % 10 AS INT) WHEN 0 THEN 'recipe_unavailable' WHEN 1 THEN 'parent_failed' WHEN 2 THEN 'timed_out' ELSE 'passed' END AS test_outcome",
]


@query(
    f"""SELECT id, CASE WHEN NOT accessible THEN 'inaccessible' WHEN repository_empty THEN 'empty_repository' WHEN NOT complete_history THEN 'incomplete_history' WHEN matching_commits = 0 THEN 'no_matching_commit' WHEN NOT supported_shape THEN 'unsupported_project_shape' WHEN NOT production_change THEN 'no_qualifying_production_change'
    WHEN affected_methods = 0 THEN 'no_affected_methods' WHEN method_count < 20 THEN 'below_method_floor' WHEN method_count > 80 THEN 'above_method_ceiling' WHEN lines_after >= lines_before THEN 'no_source_reduction' WHEN trim(license_path) = '' THEN 'missing_license' WHEN test_outcome = 'recipe_unavailable' THEN 'test_recipe_unavailable' WHEN test_outcome = 'parent_failed' THEN 'parent_tests_failed' WHEN test_outcome = 'timed_out' THEN 'test_timed_out' END AS reason FROM (SELECT {', '.join(_HISTORY)} FROM orders)"""
)
def history_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each repository's history."""
    return read(spark, sf_dir, "orders").selectExpr(*_HISTORY).select("id", R.historical_exclusion(20, 80).alias("reason"))


@query(X.values("path string, rule string, score int", L.LICENSES))
def license_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by which paths name licenses."""
    rows = X.table(spark, "path string", [(p,) for p, _, _ in L.LICENSES]).withColumn("l", R.license_file(F.col("path")))
    return rows.select("path", "l.rule", "l.score")


@query("SELECT c_custkey AS id, lower(replace(c_name, '#', '/')) AS repository, c_nationkey % 2 AS part, c_mktsegment AS language FROM customer")
def composite_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of a selection as one, with quotas that they meet exactly."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.translate("c_name", "#", "/").alias("repository"), F.col("c_custkey").cast("string").alias("revision"), F.col("c_mktsegment").alias("language"), (F.col("c_nationkey") % 2).alias("part"))
    quotas = {r["language"].lower(): r["n"] for r in c.groupBy("language").agg(F.count("*").alias("n")).collect()}  # five market segments
    both = R.composite([c.where("part = 0"), c.where("part = 1")], quotas)
    return both.join(c.select(F.col("c_custkey").alias("id"), "revision", "part", F.col("language").alias("written")), "revision").select("id", "repository", "part", F.col("written").alias("language"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 100 THEN o_orderstatus END AS assessment FROM orders")
def continued_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longer ranking that inherits the assessments of its first hundred ranks."""
    from ..operators.ranking import with_rank

    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    ranked = with_rank(o, F.lpad(F.col("o_orderkey").cast("string"), 20, "0")).drop("digest")
    prior = ranked.where("rank <= 100").withColumnRenamed("o_orderstatus", "assessment")
    return R.continued(prior, ranked.select("o_orderkey", "rank"), ["o_orderkey"]).select("o_orderkey", "rank", "assessment")


@query("SELECT conv_id, count(*) AS n, max(turn) + 1 AS highest, count(DISTINCT turn) AS distinct_ranks, count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*) AND min(turn) = 0 AS contiguous FROM (SELECT 0 AS conv_id, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS turn FROM orders) GROUP BY 1")
def contiguous_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the keys of orders run without a gap."""
    o = read(spark, sf_dir, "orders", "o_orderkey")
    least = o.agg(F.min("o_orderkey")).first()[0]
    return R.contiguous(o.select((F.col("o_orderkey") - least + 1).alias("rank"))).select(F.lit(0).alias("conv_id"), "n", "highest", "distinct_ranks", "contiguous")


@query("SELECT user_id, event_id, value, previous FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous >= value")
def not_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is not above the one before."""
    return R.rising(read(spark, sf_dir, "events", "user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query(
    """WITH e AS (SELECT event_type AS query, CAST(hour(ts) AS INTEGER) AS hour, day(ts) AS page FROM events WHERE hour(ts) <> 7 OR event_type <> 'error'), h AS (SELECT query, CAST(unnest(range(0, 24)) AS INTEGER) AS hour FROM (SELECT DISTINCT query FROM e)), g AS (SELECT query, hour, count(DISTINCT page) AS n, min(page) AS lo, max(page) AS hi FROM e GROUP BY 1, 2)
  SELECT query, hour, coalesce(n, 0) AS n_pages, coalesce(lo = 1 AND hi = n, false) AS complete FROM h LEFT JOIN g USING (query, hour)"""
)
def hour_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 hours of each kind of events, with days as pages."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("page")).where("hour <> 7 or query <> 'error'")
    return R.hours_complete(e)


# ---- commitments


@query("""SELECT n_nationkey, sha256('["' || n_name || '","' || n_regionkey || '",' || n_nationkey || ']') AS method_id, 'case-' || sha256('blind-v1' || chr(10) || n_name || chr(10) || 'c' || chr(10) || n_nationkey) AS case_id,
  sha256(strlen('+' || n_nationkey) || ':+' || n_nationkey || '1:-') AS row_sha256, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","seal":""}') AS seal FROM nation""")
def sealed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of methods, cases and rows, and rows that hold their own digest."""
    n = read(spark, sf_dir, "nation")
    s = sinks.sealed(n, ["n_nationkey", "n_name", "seal"], "seal")
    ids = n.select("n_nationkey", R.method_identity(R.json_string(F.col("n_name")), R.json_string(F.col("n_regionkey").cast("string")), F.col("n_nationkey").cast("string")).alias("method_id"), R.blind_case_id("blind-v1", F.col("n_name"), F.lit("c"), F.col("n_nationkey").cast("string")).alias("case_id"), R.projected_row_hash(F.col("n_nationkey"), F.lit(None).cast("string")).alias("row_sha256"))
    return ids.join(s.select("n_nationkey", "seal"), "n_nationkey")


@query(
    """WITH f AS (SELECT count(*) AS files, sha256(string_agg(sha256(text) || ' ' || doc_id, chr(10) ORDER BY sha256(text) || ' ' || doc_id)) AS s FROM documents), v AS (SELECT doc_id || ' ' || t AS x, t FROM (SELECT doc_id, CASE quality WHEN 0 THEN 'slop' ELSE 'clean' END AS t FROM labels)),
  g AS (SELECT count(*) AS units, count(*) FILTER (t = 'slop') AS slop, count(*) FILTER (t = 'clean') AS clean, sha256(string_agg(x, chr(10) ORDER BY x)) AS w FROM v)
  SELECT files, s AS sources_sha256, units, slop, clean, w AS verdicts_sha256, sha256('{"scan_id":"s1","contract":"v1","files":' || files || ',"sources_sha256":"' || s || '","units":' || units || ',"slop":' || slop || ',"kinda_slop":0,"clean":' || clean || ',"unresolved":0,"verdicts_sha256":"' || w || '","run_sha256":""}') AS run_sha256 FROM f, g"""
)
def completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed result over all documents and labels."""
    files = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file_path"), F.sha2("text", 256).alias("sha256"))
    verdicts = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("unit_id"), F.when(F.col("quality") == 0, "slop").otherwise("clean").alias("tier"))
    return sinks.completed_run(files, verdicts, "s1", "v1").select("files", "sources_sha256", "units", "slop", "clean", "verdicts_sha256", "run_sha256")


# ---- resumable work


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id, count(DISTINCT user_id) FILTER (event_type <> 'signup') AS own_units, count(DISTINCT user_id) FILTER (event_type = 'signup') AS reused_units FROM events GROUP BY 1")
def reuse_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a day settled and that it took over."""
    e = read(spark, sf_dir, "events")
    return R.reuse_markers(e.select(F.to_date("ts").cast("string").alias("scan_id"), F.when(F.col("event_type") == "signup", F.concat(F.lit("__reuse__:"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string")).alias("unit_id")))


@query(
    """WITH l AS (SELECT conv_id, arg_max(turn, turn) AS t, arg_max(role, turn) AS r FROM conversations WHERE conv_id % 4 > 0 GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT c.conv_id AS slot, CASE WHEN r = 'system' THEN NULL WHEN t IS NULL THEN 's0' WHEN t < 5 THEN 's' || (t + 1) END AS next_stage, CASE WHEN r = 'system' THEN 'closed' WHEN t >= 5 THEN 'done' ELSE 'open' END AS state FROM c LEFT JOIN l ON c.conv_id = l.conv_id"""
)
def slot_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do for each slot; conversations are slots and turns their stages."""
    c = read(spark, sf_dir, "conversations")
    stages = [f"s{k}" for k in range(6)]
    marks = c.where("conv_id % 4 > 0").select(F.col("conv_id").alias("slot"), F.col("turn").alias("seq"), F.concat(F.lit("s"), F.least("turn", F.lit(5)).cast("string")).alias("stage"), (F.col("role") == "system").alias("terminal"))
    return R.sweep(c.select(F.col("conv_id").alias("slot")).distinct(), marks, stages)


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS wave FROM events")
def work_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work in waves that hold each key once."""
    return R.one_in_flight(read(spark, sf_dir, "events", "event_id", "user_id"), "user_id", "event_id").select("event_id", "wave")


@query(
    """WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id, CAST(user_id AS VARCHAR) AS unit_id, event_id AS seq, event_type AS status, event_id % 9 = 0 AS m, event_id % 7 = 0 AS retry FROM events WHERE event_id % 9 > 0), l AS (SELECT scan_id, unit_id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(retry, seq) AS retry FROM e GROUP BY 1, 2)
  SELECT scan_id, unit_id, seq, status, retry, NOT retry AS reused FROM l"""
)
def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each unit, and whether a later scan may use it."""
    e = read(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("scan_id"), F.col("user_id").cast("string").alias("unit_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("event_id") % 9 == 0).alias("is_manifest"), (F.col("event_id") % 7 == 0).alias("retry_on_resume"), F.lit(1).alias("version"), F.lit("method").alias("stage"), F.lit("h").alias("source_hash"), F.col("ts").cast("date").cast("string").alias("context_hash"))
    last = frames.latest(e)
    wanted = last.select("unit_id", "stage", "source_hash", "context_hash")
    done, left = frames.reusable(wanted, e, 1)
    marked = done.select("unit_id", "context_hash", F.lit(True).alias("reused")).unionByName(left.select("unit_id", "context_hash", F.lit(False).alias("reused")))
    return last.join(marked, ["unit_id", "context_hash"]).select("scan_id", "unit_id", "seq", "status", F.col("retry_on_resume").alias("retry"), "reused")


# ---- graphs over units


@query(
    """WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS unit_id FROM lineitem WHERE l_linenumber <= 2), e AS (SELECT a.case_id AS x, b.case_id AS y FROM u a JOIN u b USING (unit_id)), n AS (SELECT DISTINCT case_id FROM u)
  SELECT count(*) AS cases, count(DISTINCT case_id) AS named FROM n"""
)
def case_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and how many have a component: all of them, each once."""
    units = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("unit_id")).distinct()
    cases = units.select("case_id").distinct().withColumn("semantics", F.col("case_id").cast("string"))
    edges = spark.createDataFrame([], "caller long, callee long")
    return G.case_components(cases, units, edges).agg(F.count("*").alias("cases"), F.count_distinct("case_id").alias("named"))


@query(X.values("case_id string, component string", L.COMPONENTS))
def case_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases linked by units, meaning and calls."""
    return G.case_components(X.table(spark, "case_id string, semantics string", L.LINKED_CASES), X.table(spark, "case_id string, unit_id string", L.CASE_UNITS), X.table(spark, "caller string, callee string", L.CASE_EDGES))


@query("SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM (SELECT c_nationkey, c_custkey % 25 AS s_nationkey FROM customer) WHERE c_nationkey // 5 <> s_nationkey // 5")
def crossing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations that customers join across groups of five."""
    edges = read(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as bigint) as caller", "c_custkey % 25 as callee")
    return G.crossing_pairs(edges, spark.range(25).select(F.col("id").alias("unit_id"), F.expr("id div 5").alias("chunk")))


@query(X.values("root string, place int, unit_id string, depth int", L.UPSTREAM))
def upstream_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers above roots in the order of a walk."""
    return G.upstream_callers(X.table(spark, "caller string, callee string", L.CALLS), X.table(spark, "unit_id string", [("a",), ("z",)]), 2, 4)


@query(X.values("unit_id string, callers string, callees string", L.NEIGHBOURS))
def call_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of each method."""
    edges = X.table(spark, "caller string, callee string", L.CALLS)
    found = G.neighbours(edges, X.table(spark, "unit_id string", [(u,) for u, _, _ in L.NEIGHBOURS]))
    return found.select("unit_id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query(X.values("caller string, callee string, unresolved long, external long", L.EDGES))
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between methods from references by name, beside the counts of what has none."""
    edges, counts = G.call_edges(X.table(spark, "file_path string, line int, name string", L.EDGE_REFS), X.table(spark, "name string, unit_id string", L.EDGE_DEFS), X.table(spark, "unit_id string, file_path string, start_line int, end_line int", L.EDGE_METHODS))
    return edges.crossJoin(counts)  # one row of counts


@query(X.values("case_id string, target string, status string", L.MERGED))
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where merged cases end."""
    return G.merge_targets(X.table(spark, "case_id string, decision string, merge_into string", L.MERGES)).withColumnRenamed("end", "target")


@query(
    """WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey // 4 AS b FROM customer WHERE c_custkey > 3 AND c_nationkey % 5 > 0), w AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT w.b FROM r JOIN w ON w.a = r.node)
  SELECT node FROM r"""
)
def agreed_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first customer reaches over agreed relationships, none of which touches a disputed one."""
    agreed = read(spark, sf_dir, "customer").where("c_custkey > 3 and c_nationkey % 5 > 0").selectExpr("c_custkey as a", "c_custkey div 4 as b")
    return G.agreed_reach(agreed, spark.createDataFrame([(-1,)], "node long"), spark.range(1, 2).select(F.col("id").alias("root"))).select("node")


# ---- files, frames, compilers


@query(X.values("repository string, n_commits int, subject string", L.LOGGED))
def captured_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of captured logs whose fields end with NUL."""
    found = sinks.captured_records(X.table(spark, "repository string, captured string", L.CAPTURED), "captured", ["sha", "subject"])
    return found.groupBy("repository").agg(F.count("*").cast("int").alias("n_commits"), F.max_by("subject", "place").alias("subject"))


@query(X.values("path string, kept boolean, evidence boolean, left_out boolean", L.PATHS))
def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are read as production code, which as tests, and which an ignore file leaves out."""
    rows = X.table(spark, "path string", [(p,) for p, *_ in L.PATHS])
    path = F.col("path")
    return rows.select("path", sinks.kept_file(path, ["node_modules", "dist"]).alias("kept"), sinks.kept_evidence(path, ["node_modules", "dist"]).alias("evidence"), sinks.gitignored(path, L.IGNORE).alias("left_out"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/?', '') || CASE page_id % 4 WHEN 0 THEN '/a.py' WHEN 1 THEN '/test_a.py' WHEN 2 THEN '/dist/b.go' ELSE '/readme' END AS file_path FROM pages), k AS (SELECT file_path, bool_or(page_id % 4 = 1 OR regexp_matches(lower(file_path), '(^|/)test')) AS e FROM p WHERE page_id % 4 < 2 AND NOT regexp_matches(lower(file_path), '(^|/)dist(/|$)') GROUP BY 1)
  SELECT file_path, e AS is_evidence FROM k"""
)
def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production files and tests of a tree, each once."""
    end = F.when(F.col("page_id") % 4 == 0, "/a.py").when(F.col("page_id") % 4 == 1, "/test_a.py").when(F.col("page_id") % 4 == 2, "/dist/b.go").otherwise("/readme")
    files = read(spark, sf_dir, "pages", "page_id", "url").select(F.concat(F.regexp_replace("url", "^https?://[^/]+/?", ""), end).alias("file_path"))
    return sinks.context_files(files, ["dist"])


@query(X.values("kind string, file_path string, symbol string, detail string", L.INDEXED))
def compiler_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, symbols and occurrences of compiler indexes in protobuf form."""
    found = compiler.read_indexes(spark.createDataFrame(L.indexes(), "index_id string, content binary"), 1000)
    span = compiler.decoded_range(F.col("range"))
    place = F.concat_ws(":", span["start_line"].cast("string"), span["start_char"].cast("string"), span["end_line"].cast("string"), span["end_char"].cast("string"))
    said = F.coalesce(F.col("error"), F.when(F.col("kind") == "occurrence", F.concat_ws(" ", F.coalesce(span["error"], place), F.array_join(compiler.decoded_roles(F.col("roles")), "+"))), F.col("display_name"), F.array_join("docs", "|"))
    return found.select("kind", "file_path", "symbol", said.alias("detail"))


@query(
    """WITH o AS (SELECT o_custkey AS f, CAST(o_orderkey % 40 AS INTEGER) AS line, o_orderkey % 97 AS symbol, o_orderstatus <> 'P' AS c FROM orders), g AS (SELECT f, line, count(DISTINCT symbol) AS n, min(symbol) AS one FROM o WHERE c GROUP BY 1, 2), m AS (SELECT c_custkey AS f, CAST(c_custkey % 40 AS INTEGER) AS line FROM customer)
  SELECT m.f AS file_path, m.line AS start_line, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN one END AS symbol FROM m LEFT JOIN g ON g.f = m.f AND g.line = m.line"""
)
def method_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods with the one symbol that is defined on their first line."""
    occurrences = read(spark, sf_dir, "orders").selectExpr("o_custkey as file_path", "cast(o_orderkey % 40 as int) as line", "o_orderkey % 97 as symbol", "o_orderstatus <> 'P' as is_callable")
    methods = read(spark, sf_dir, "customer").selectExpr("c_custkey as file_path", "c_name as name", "cast(c_custkey % 40 as int) as start_line")
    return compiler.method_symbols(methods, occurrences).select("file_path", "start_line", "status", "candidates", "symbol")


@query(X.values("shard_row long, language string, added long, deleted long, reason string, digest_known boolean", L.FRAMED))
def patch_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of a shard with their facts and the first reason against each."""
    at = fresh_path(spark, "shard")
    X.table(spark, ", ".join(f"{c} {'long' if c == 'pull_number' else 'string'}" for c in patches.READ + patches.OTHERS), L.shard_rows()).coalesce(1).write.parquet(at)
    found = patches.frame(patches.read_shards(spark, [at]), "frame-v1", "seed")
    return found.select("shard_row", "language", "added", "deleted", "reason", F.col("digest").isNotNull().alias("digest_known"))


@query(X.values("k int, place int, old_start int, old_count int, new_start int, new_count int", L.HUNKS))
def hunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of hunks."""
    return patches.hunk_ranges(X.table(spark, "k int, patch string", L.HUNKED), "k").withColumnRenamed("at", "place")


@query("SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM events WHERE event_id <> (SELECT max(event_id) FROM events)")
def written_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a journal of JSON lines whose last line is torn, and read back without it."""
    at = fresh_path(spark, "journal")
    e = read(spark, sf_dir, "events", "event_id", "event_type", "value")
    last = e.agg(F.max("event_id")).first()[0]
    sinks.append_events(e.where(F.col("event_id") <= last - 2), f"{at}/j")
    sinks.append_events(e.where(F.col("event_id") == last - 1), f"{at}/j")
    found = frames.journal(spark, f"{at}/j", "event_id long, event_type string, value double")
    return found.select("event_id", "event_type", "value")


@query("SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 3 THEN 'malformed_record' WHEN 4 THEN 'invalid_repository_identity' WHEN 5 THEN 'duplicate_repository_identity' END AS reason FROM customer")
def repository_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a repository list with the reason of each rejection."""
    k = F.col("c_custkey") % 10
    own = F.concat(F.lit("https://github.com/own/r"), F.when(k == 5, F.lit("twice")).otherwise(F.col("c_custkey").cast("string")))
    line = F.when(k == 3, F.lit("no comma")).when(k == 4, F.lit("ftp:/x y,meta")).otherwise(F.concat(own, F.lit(",a,b")))
    first = spark.createDataFrame([(1_000_000_000, "https://github.com/own/rtwice,first")], "line_number long, line string")
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 2_000_000_000).alias("line_number"), line.alias("line")).unionByName(first)
    return frames.repository_rows(rows).where("line_number > 1000000000").select((F.col("line_number") - 2_000_000_000).alias("id"), "reason")


@query("SELECT event_type AS query, n AS found, n AS total, true AS complete FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def paged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of answers made of events; each kind's pages are complete."""
    e = read(spark, sf_dir, "events", "event_id", "event_type")
    from pyspark.sql import Window

    placed = e.withColumn("page", F.expr("cast((row_number() over (partition by event_type order by event_id) - 1) div 100 + 1 as int)")).withColumn("total", F.count("*").over(Window.partitionBy("event_type")))
    item = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("own/r"), F.col("event_id").cast("string")).alias("full_name"))
    raw = placed.groupBy(F.col("event_type").alias("query"), "page").agg(F.to_json(F.struct(F.max("total").alias("total_count"), F.lit(False).alias("incomplete_results"), F.collect_list(item).alias("items"))).alias("response"))
    items, per_query = frames.pages(raw)
    n = items.groupBy("query").agg(F.count("*").alias("found"))
    return per_query.select("query", "total", "complete").join(n, "query").select("query", "found", "total", "complete")


@query("SELECT page_id, CASE WHEN length(u) > 0 THEN u END AS endpoint, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS took FROM (SELECT page_id, regexp_replace(regexp_replace(replace(url, '://', '://user:pw@') || '?q=1#x', '[?#].*$', ''), '^([a-z]+://)[^/@]*@', '\\1') AS u, page_id * 37 AS s FROM pages)")
def shown_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without user and query, and times for people."""
    url = F.concat(F.replace("url", F.lit("://"), F.lit("://user:pw@")), F.lit("?q=1#x"))
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.redacted_endpoint(url).alias("endpoint"), T.duration(F.col("page_id") * 37).alias("took"))


@query("SELECT doc_id, octet_length(encode(text)) > 20 AS cut, CASE WHEN octet_length(encode(text)) > 20 THEN k || '…' ELSE text END AS shown FROM (SELECT doc_id, text, list_max(list_transform(range(0, 21), lambda i: CASE WHEN octet_length(encode(substr(text, 1, CAST(i AS BIGINT)))) <= 20 THEN i ELSE 0 END)) AS n, substr(text, 1, CAST(n AS BIGINT)) AS k FROM documents)")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to twenty bytes of whole characters."""
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", (F.octet_length("text") > 20).alias("cut"), T.truncated(F.col("text"), 20).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, min(l_shipdate) OVER (PARTITION BY l_orderkey) = l_shipdate AS first FROM lineitem WHERE false UNION ALL SELECT p_partkey, p_size, p_partkey % 2 = 0 FROM part")
def union_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as one, of which the first goes before."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_orderkey"), F.col("p_size").alias("l_linenumber"), (F.col("p_partkey") % 2 == 0).alias("first"))
    even, every = part.where("first"), part.withColumn("first", F.lit(False))
    return joins.union_first(even, every, "l_orderkey")


@query(
    """WITH c AS (SELECT c_custkey AS case_id, unnest([0, 1]) AS k, c_mktsegment AS s, c_nationkey AS n FROM customer)
  SELECT case_id, CASE WHEN case_id % 5 = 0 THEN least('slop', 'clean') ELSE 'slop' END AS tier, s || ',v' || n AS provenance, n % 3 AS proof_level, case_id % 5 = 0 AS conflict FROM c WHERE k = 0"""
)
def merged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of one id as one: equal content, united provenance, least proof."""
    from ..operators import aggregates as A

    c = read(spark, sf_dir, "customer")
    one = lambda k: c.select(F.col("c_custkey").alias("case_id"), F.when((F.col("c_custkey") % 5 == 0) & F.lit(k == 1), "clean").otherwise("slop").alias("tier"), F.array(F.col("c_mktsegment") if k else F.concat(F.lit("v"), F.col("c_nationkey").cast("string")), F.col("c_mktsegment")).alias("provenance"), (F.col("c_nationkey") % 3 + k).alias("proof_level"))
    found = A.merge_cases(one(0).unionByName(one(1)), "case_id", ["tier"], ["provenance"], "proof_level")
    return found.select("case_id", "tier", F.array_join("provenance", ",").alias("provenance"), "proof_level", "conflict")


@query(
    """WITH r AS (SELECT l_orderkey AS k, n, CASE WHEN l_linenumber % 2 = 0 THEN l_shipmode END AS kind, l_returnflag AS doc FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 1000000 + l_partkey AS n, l_returnflag, l_linestatus AS l_shipmode FROM lineitem))
  SELECT k, arg_min(kind, n) FILTER (kind IS NOT NULL) AS kind, array_to_string(list_sort(list(DISTINCT doc)), ',') AS docs, count(DISTINCT kind) > 1 AS conflict FROM r GROUP BY 1"""
)
def filled_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols from several rows: the first known value, all documents, and conflicts."""
    from ..operators import aggregates as A

    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("n"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("kind"), F.array("l_returnflag").alias("docs"))
    return A.fill_symbols(r, "k", ["kind"], "n", ["docs"]).withColumn("docs", F.array_join("docs", ","))


@query("SELECT source, tier, n FROM (SELECT 0 AS place, 'slop' AS tier, 'all' AS source, count(*) AS n FROM labels WHERE quality = 0 UNION ALL SELECT 1, 'kinda_slop', 'all', 0 UNION ALL SELECT 2, 'unresolved', 'all', 0 UNION ALL SELECT 3, 'clean', 'all', count(*) FROM labels WHERE quality = 1)")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by tier for a report's foot."""
    v = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "slop").otherwise("clean").alias("tier"))
    return sinks.tier_counts(v).select(F.lit("all").alias("source"), "tier", "n")


@query("SELECT doc_id, sha256('cache-v1' || chr(0) || lang || chr(0) || sha256(text)) AS cache_key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a content-addressed cache of half of them lacks."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "text").select("doc_id", F.lit("x").alias("language"), F.sha2("text", 256).alias("source_hash"), "lang")
    cache = frames.cache_misses(d, spark.createDataFrame([], "cache_key string"), "cache-v1").where("doc_id % 2 = 0").select("cache_key")
    left = frames.cache_misses(d, cache, "cache-v1")
    return left.select("doc_id", F.sha2(F.concat(F.lit("cache-v1"), F.char(F.lit(0)), "lang", F.char(F.lit(0)), "source_hash"), 256).alias("cache_key"))


@query("SELECT regexp_replace(lower(n_name), '[^a-z]', '-', 'g') AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'none' ELSE 'other' END AS pattern, (n_nationkey % 2 = 0) = (n_nationkey % 5 <> 0) AS compatible FROM nation")
def pattern_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether patterns suit their tiers."""
    n = read(spark, sf_dir, "nation")
    tier, pattern = F.when(F.col("n_nationkey") % 2 == 0, "slop").otherwise("clean"), F.when(F.col("n_nationkey") % 5 == 0, "none").otherwise("other")
    return n.select(F.regexp_replace(F.lower("n_name"), "[^a-z]", "-").alias("name"), pattern.alias("pattern"), T.pattern_suits(tier, pattern).alias("compatible"))


@query("SELECT o_orderkey, list_sort([o_orderstatus, o_orderpriority]) = list_sort([o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END]) AS same FROM orders")
def equal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a patch changes exactly the paths that a commit does."""
    o = read(spark, sf_dir, "orders")
    other = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", T.same_paths(F.array("o_orderstatus", "o_orderpriority"), F.array("o_orderpriority", other)).alias("same"))


@query("SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(list_sum(list_transform(l[1:2], lambda x: strlen(x) + 1)) AS BIGINT) AS third_start FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets at which lines begin; shown is where the third would."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("s", T.line_starts(F.col("text")))
    return d.select("doc_id", (F.size("s") - 1).cast("long").alias("n_lines"), F.coalesce(F.get("s", F.lit(2)), F.element_at("s", -1)).alias("third_start"))


@query(
    """SELECT l_orderkey, l_linenumber, units_before, units_before < 1000000000 AS admitted FROM (SELECT l_orderkey, l_linenumber,
    CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS units_before FROM lineitem)"""
)
def scan_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as one scan: the cents spent before each row, and whether it is admitted below ten million."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return R.admitted_units(rows, [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "cents", 1_000_000_000).select("l_orderkey", "l_linenumber", "units_before", "admitted")


@query(
    """WITH h AS (SELECT sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem),
  leaves AS (SELECT left(h, 4) AS p, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1),
  twigs AS (SELECT left(p, 2) AS p, sum(n) AS n, sha256(string_agg(p || ':' || d, chr(10) ORDER BY p)) AS d FROM leaves GROUP BY 1)
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce(string_agg(p || ':' || d, chr(10) ORDER BY p), '')) AS commitment FROM twigs"""
)
def lineitem_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commitment to all rows of lineitem, the same for any order and partitioning."""
    columns = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return hashing.tree_commitment(rows.select(F.sha2(F.concat_ws("|", *columns), 256).alias("h")), "h")
