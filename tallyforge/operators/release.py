"""Evaluation of submissions: run metrics, release rates, gates, reviewer agreement, slot ledgers, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import identity
from .aggregates import is_finding, metrics, ratio


def joined_predictions(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every case in every run: predictions ``(run_id, case_id, tier, ...)`` beside ``cases`` (case_id, expected_tier, ...), clean where a run has none."""
    runs = sorted(r["run_id"] for r in predictions.select("run_id").where("run_id is not null").distinct().collect())  # a submission holds a handful of runs
    every = cases.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs]).cast("array<string>")))
    own = predictions.where("case_id is not null").groupBy("run_id", "case_id").agg(F.min_by("tier", "prediction_id").alias("predicted_tier"), F.count("*").alias("n_predictions"))
    return every.join(own, ["run_id", "case_id"], "left").withColumn("predicted_tier", F.coalesce("predicted_tier", F.lit("clean"))).na.fill(0, ["n_predictions"])


def sliced_metrics(joined: DataFrame, slices: DataFrame, by: list[str]) -> DataFrame:
    """Tier metrics for each of the ``slices`` (a table of ``by``), also for those without any case, whose ratios are those of nothing."""
    m = metrics_by(joined, by)
    zero = ["cases", "slop_tp", "finding_tp", "false_positives"]
    one = ["slop_precision", "slop_recall", "finding_precision", "finding_recall"]
    return slices.select(*by).distinct().join(m, by, "left").na.fill(0, zero).na.fill(1.0, one).na.fill(0.0, ["false_positive_rate"])


def metrics_by(joined: DataFrame, by: list[str]) -> DataFrame:
    """Tier metrics of each group of ``by``, without totals."""
    key = F.struct(*by)
    grouped = metrics(joined.withColumn("__by", key), ["__by"]).where("`__by` is not null")
    return grouped.select(*[F.col(f"__by.{c}").alias(c) for c in by], *[c for c in grouped.columns if c != "__by"])


def release_rates(predictions: DataFrame, cases: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of rates over all runs of a submission.

    ``predictions`` is (run_id, prediction_id, case_id, tier, fingerprint, proof_level, evidence_valid, disposition, minutes), ``cases`` is
    (case_id, expected_proof_level, maintainer), ``runs`` is (run_id, methods, cost_microusd). Here 0/0 is 0.
    """
    p = predictions.join(cases.select("case_id", "expected_proof_level", "maintainer"), "case_id", "left")
    finding, matched = is_finding(F.col("tier")), F.col("case_id").isNotNull()
    copies = predictions.groupBy("run_id", "fingerprint").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    of_maintainers = F.coalesce(F.col("maintainer"), F.lit(False))
    accepted = F.col("disposition") == "accepted"
    sums = p.agg(
        F.count("*").alias("predictions"),
        F.count_if(~matched & finding).alias("unmatched_findings"),
        F.count_if(~matched & (F.col("tier") == "slop")).alias("unmatched_slop"),
        F.count_if(F.col("tier") == "unresolved").alias("unresolved"),
        F.count_if(~matched & (F.col("tier") == "unresolved")).alias("unmatched_unresolved"),
        F.count_if(finding).alias("findings"),
        F.count_if(finding & F.coalesce(F.col("proof_level") >= F.col("expected_proof_level"), F.lit(False))).alias("proven"),
        F.count_if(finding & F.col("evidence_valid")).alias("valid"),
        F.count_if(accepted).alias("accepted_findings"),
        F.count_if(F.col("disposition") != "unreviewed").alias("reviewed_findings"),
        F.count_if(of_maintainers).alias("for_maintainers"),
        F.count_if(of_maintainers & accepted).alias("maintainer_accepted"),
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("reviewer_minutes"),
    )
    of_runs = runs.agg(F.count("*").alias("run_count"), F.coalesce(F.sum("methods"), F.lit(0)).alias("methods"), F.coalesce(F.sum("cost_microusd"), F.lit(0)).alias("cost"))
    row = sums.crossJoin(copies).crossJoin(of_runs).crossJoin(cases.agg(F.count("*").alias("n_cases")))  # single rows
    none = 0.0
    c = F.col
    return row.select(
        "run_count",
        "unmatched_findings",
        "unmatched_slop",
        "accepted_findings",
        "reviewed_findings",
        "reviewer_minutes",
        ratio(c("duplicates"), c("predictions"), none).alias("duplicate_case_rate"),
        ratio(c("unresolved"), c("n_cases") * c("run_count") + c("unmatched_unresolved"), none).alias("unresolved_rate"),
        ratio(c("proven"), c("findings"), none).alias("proof_level_accuracy"),
        ratio(c("valid"), c("findings"), none).alias("overall_evidence_validity"),
        ratio(c("maintainer_accepted"), c("for_maintainers"), none).alias("maintainer_acceptance"),
        ratio(c("accepted_findings"), c("reviewer_minutes"), none).alias("accepted_findings_per_minute"),
        ratio(c("cost") / 1000.0, c("methods"), none).alias("cost_usd_per_1000_methods"),
    )


# Gates of a release: column, comparison by which it fails, limit, name.
RELEASE_GATES = [
    ("overall_evidence_validity", "<", 1.0, "evidence validity"),
    ("verdict_repeatability", "<", 0.90, "verdict repeatability"),
    ("proof_level_accuracy", "<", 1.0, "proof-level compliance"),
    ("cost_usd_per_1000_methods", ">", 0.75, "cost per 1,000 methods"),
    ("duplicate_case_rate", ">", 0.02, "duplicate-case rate"),
]
# Gates of each run's metrics.
RUN_GATES = [("slop_precision", "<", 0.95), ("finding_precision", "<", 0.85), ("finding_recall", "<", 0.80), ("evidence_validity", "<", 1.0), ("boundary_fp_rate", ">", 0.02)]
LANGUAGE_GATES = [("slop_precision", "<", 0.90), ("slop_recall", "<", 0.70)]


def _fails(column: str, sign: str, limit: float) -> Column:
    return F.col(column) < limit if sign == "<" else F.col(column) > limit


def run_errors(rows: DataFrame, gates: list[tuple[str, str, float]] = RUN_GATES) -> DataFrame:
    """Adds ``errors``: every gate that a row of metrics fails, in the order of the gates; a gate whose column is absent is not tested."""
    errors = [F.when(_fails(*g), F.lit(f"{g[0]} {g[1]} {g[2]:.2f}")) for g in gates if g[0] in rows.columns]
    return rows.withColumn("errors", F.array_compact(F.array(*errors)))


def release_errors(rates: DataFrame, baselines: DataFrame) -> DataFrame:
    """All failed gates of a release as rows ``(place, error)``; ``baselines`` is (tool_id, accepted, minutes), each to be beaten strictly."""
    fixed = [F.when(_fails(c, sign, limit), F.lit(f"{name} {sign} {limit:.2f}")) for c, sign, limit, name in RELEASE_GATES]
    empty = (F.col("accepted_findings") == 0) | (F.col("reviewed_findings") == 0) | (F.col("reviewer_minutes") <= 0)
    fixed.append(F.when(empty, F.lit("no measurable accepted finding")))
    own = rates.select(F.posexplode(F.array(*fixed)).alias("place", "error")).where("error is not null")
    rate = ratio(F.col("accepted"), F.col("minutes"), 0.0)
    beaten = baselines.crossJoin(F.broadcast(rates.select("accepted_findings_per_minute"))).where(F.col("accepted_findings_per_minute") <= rate)  # one row
    lost = beaten.select((F.lit(len(fixed)) + F.dense_rank().over(Window.orderBy("tool_id")) - 1).alias("place"), F.concat(F.lit("not better than "), "tool_id").alias("error"))
    return own.unionByName(lost)


def adjusted_precisions(joined: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per run, precision with findings that match no case counted as wrong: (run_id, slop_precision, finding_precision)."""
    m = joined.groupBy("run_id").agg(
        F.count_if((F.col("expected_tier") == "slop") & (F.col("predicted_tier") == "slop")).alias("slop_tp"),
        F.count_if(F.col("predicted_tier") == "slop").alias("slop"),
        F.count_if(is_finding(F.col("expected_tier")) & is_finding(F.col("predicted_tier"))).alias("tp"),
        F.count_if(is_finding(F.col("predicted_tier"))).alias("findings"),
    )
    loose = predictions.where("case_id is null").groupBy("run_id").agg(F.count_if(F.col("tier") == "slop").alias("loose_slop"), F.count_if(is_finding(F.col("tier"))).alias("loose"))
    both = m.join(loose, "run_id", "left").na.fill(0, ["loose_slop", "loose"])
    return both.select("run_id", ratio(F.col("slop_tp"), F.col("slop") + F.col("loose_slop"), 0.0).alias("slop_precision"), ratio(F.col("tp"), F.col("findings") + F.col("loose"), 0.0).alias("finding_precision"))


def outside_corpus(snapshots: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots that the corpus lacks; none may be left."""
    return snapshots.join(corpus.select(*keys).distinct(), keys, "left_anti")


def two_reviewer_status(decisions: DataFrame) -> DataFrame:
    """``accepted``, ``rejected`` or ``disputed`` from two reviewers' (unit_id, reviewer_id, verdict, pattern, other_pattern).

    Two acceptances count only with the same pattern; the text of an ``other`` pattern is compared without regard to case and spaces.
    """
    other = F.when(F.col("pattern") == "other", F.lower(F.trim(F.regexp_replace("other_pattern", r"\s+", " ")))).otherwise("")
    d = decisions.withColumn("signature", F.struct("pattern", F.coalesce(other, F.lit("")).alias("other")))
    g = d.groupBy("unit_id").agg(F.count_distinct("reviewer_id").alias("reviewers"), F.bool_and(F.col("verdict") == "accept").alias("all_accept"), F.bool_and(F.col("verdict") == "reject").alias("all_reject"), F.count_distinct("signature").alias("signatures"))
    two = F.col("reviewers") == 2
    status = F.when(two & F.col("all_reject"), "rejected").when(two & F.col("all_accept") & (F.col("signatures") == 1), "accepted").when(two, "disputed").otherwise("incomplete")
    return g.select("unit_id", "reviewers", status.alias("status"))


def worksheets(decisions: DataFrame, reviewers: list[str]) -> DataFrame:
    """One row a method with each reviewer's tier as a column."""
    return decisions.groupBy("method_id").pivot("reviewer_id", reviewers).agg(F.min("tier"))


def label_progress(methods: DataFrame) -> DataFrame:
    """Counts of a worksheet (method_id, language, tier or null): by language and state, and of what is done by tier; (kind, name, n)."""
    done = F.col("tier").isNotNull()
    by_language = methods.groupBy(F.when(done, "completed_by_language").otherwise("pending_by_language").alias("kind"), F.col("language").alias("name")).agg(F.count("*").alias("n"))
    by_tier = methods.where(done).groupBy(F.lit("completed_by_tier").alias("kind"), F.col("tier").alias("name")).agg(F.count("*").alias("n"))
    return by_language.unionByName(by_tier)


def method_census(methods: DataFrame, declared: DataFrame) -> DataFrame:
    """Methods by repository and language beside the declared totals (repository, total): (repository, language, n, sums_up)."""
    counts = methods.groupBy("repository", "language").agg(F.count("*").alias("n"))
    total = counts.groupBy("repository").agg(F.sum("n").alias("sum")).join(declared, "repository", "full_outer").select("repository", F.col("sum").eqNullSafe(F.col("total")).alias("sums_up"))
    return total.join(counts, "repository", "left").select("repository", "language", F.coalesce("n", F.lit(0)).alias("n"), "sums_up")


def tier_pivot(verdicts: DataFrame, by: str) -> DataFrame:
    """Numbers of each tier side by side for every group: (by, clean, kinda_slop, slop, unresolved)."""
    return verdicts.groupBy(by).agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("clean", "kinda_slop", "slop", "unresolved")])


def slot_summary(slots: DataFrame, least_each: int, least_total: int) -> DataFrame:
    """Slots (language, outcome) by language, with the total as a null language: counts by outcome and whether enough were accepted."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    g = slots.rollup("language").agg(F.count("*").alias("fixed"), n("unfilled").alias("unfilled"), n("excluded").alias("excluded"), n("review_closed").alias("review_closed"), n("accepted").alias("accepted"), F.grouping("language").alias("is_total"))
    each = F.min(F.when(F.col("is_total") == 0, F.col("accepted"))).over(Window.partitionBy())  # one row a language
    passes = F.when(F.col("is_total") == 0, F.col("accepted") >= least_each).otherwise((F.col("accepted") >= least_total) & (each >= least_each))
    return g.select("language", "fixed", (F.col("fixed") - F.col("unfilled")).alias("selected"), "unfilled", "excluded", "review_closed", "accepted", passes.alias("passes"))


def count_by(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def outcome_counts(candidates: DataFrame, outcome: str, kinds: list[str]) -> DataFrame:
    """One row with the number of candidates of each outcome, zero where none has it."""
    return candidates.agg(*[F.count_if(F.col(outcome) == k).alias(k) for k in kinds])


def checked_sums(artifacts: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of whole numbers, null where one is beyond a long, instead of a wrong number."""
    return artifacts.agg(*[F.try_sum(F.col(c).cast("long")).alias(c) for c in columns])


def evidence_subjects(atoms: DataFrame, subjects: DataFrame) -> DataFrame:
    """Evidence atoms with the semantic subject of exactly their symbol: (atom_id, symbol, kind, subject_id, error)."""
    s = subjects.groupBy("symbol").agg(F.count("*").alias("n"), F.min("subject_id").alias("subject_id"))
    n = F.coalesce("n", F.lit(0))
    return atoms.join(s, "symbol", "left").select("atom_id", "symbol", "kind", F.when(n == 1, F.col("subject_id")).alias("subject_id"), F.when(n == 0, "no subject").when(n > 1, "several subjects").alias("error"))


def revision_groups(artifacts: DataFrame, groups: DataFrame) -> DataFrame:
    """Completed artifacts (artifact_id, repository, revision) on the corpus's groups, one to one: (repository, revision, artifact_id, status)."""
    keys = ["repository", "revision"]
    a = artifacts.groupBy(*keys).agg(F.count("*").alias("n"), F.min("artifact_id").alias("artifact_id"))
    g = groups.select(*keys).distinct().withColumn("wanted", F.lit(True))
    status = F.when(F.col("wanted").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("assigned")
    return g.join(a, keys, "full_outer").select(*keys, F.when(status == "assigned", F.col("artifact_id")).alias("artifact_id"), status.alias("status"))


# ---- selection

def excluded_partitions(candidates: DataFrame, partitions: DataFrame, key: str) -> DataFrame:
    """Candidates with the sorted names of all partitions that hold their key; ``partitions`` is (partition, key)."""
    held = partitions.groupBy(key).agg(F.array_sort(F.collect_set("partition")).alias("partitions"))
    return candidates.join(held, key, "left").withColumn("partitions", F.coalesce("partitions", F.array().cast("array<string>")))


def _cascade(rules: list[tuple[Column, str]]) -> Column:
    return reduce(lambda out, rule: out.when(F.coalesce(rule[0], F.lit(False)), rule[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1]))


def repository_exclusion(languages: list[str], least: int, most: int) -> Column:
    """The first reason against an assessed repository that does not depend on others; its quota comes after it in rank order."""
    n = F.col("method_count")
    return _cascade(
        [
            (~F.col("accessible"), "inaccessible"),
            (~F.col("supported_shape"), "unsupported_project_shape"),
            (F.col("archived"), "archived"),
            (F.col("fork"), "fork"),
            (n == 0, "no_supported_methods"),
            (F.col("license_path").isNull(), "missing_license"),
            (~F.col("language").isin(*languages) | F.col("language").isNull(), "unsupported_language"),
            (n < least, "below_method_floor"),
            (n > most, "above_method_ceiling"),
        ]
    )


def historical_exclusion(least: int, most: int) -> Column:
    """The first reason against a repository's history: its source, then its tests."""
    tests = ["recipe_unavailable", "recipe_ambiguous", "recipe_changed", "runtime_unavailable", "sandbox_unavailable", "parent_failed", "commit_failed", "timed_out"]
    named = ["test_recipe_unavailable", "test_recipe_ambiguous", "test_recipe_changed", "runtime_unavailable", "sandbox_unavailable", "parent_tests_failed", "commit_tests_failed", "test_timed_out"]
    return _cascade(
        [
            (~F.col("accessible"), "inaccessible"),
            (F.col("repository_empty"), "empty_repository"),
            (~F.col("complete_history"), "incomplete_history"),
            (F.col("matching_commits") == 0, "no_matching_commit"),
            (~F.col("supported_shape"), "unsupported_project_shape"),
            (~F.col("production_change"), "no_qualifying_production_change"),
            (F.col("affected_methods") == 0, "no_affected_methods"),
            (F.col("method_count") < least, "below_method_floor"),
            (F.col("method_count") > most, "above_method_ceiling"),
            (F.col("lines_after") >= F.col("lines_before"), "no_source_reduction"),
            (F.coalesce(F.trim("license_path"), F.lit("")) == "", "missing_license"),
            *[(F.col("test_outcome") == t, n) for t, n in zip(tests, named, strict=True)],
        ]
    )


def with_quota(assessed: DataFrame, reason: Column, by: str, rank: str, quota: int) -> DataFrame:
    """Adds ``reason``: the stateless one, or ``quota_filled`` for rows beyond their group's first ``quota`` in rank order."""
    from .ranking import quota_fill

    stated = assessed.withColumn("reason", reason)
    filled = quota_fill(stated, by, rank, quota, F.col("reason").isNull())
    return filled.withColumn("reason", F.when(F.col("outcome") == "quota_filled", "quota_filled").otherwise(F.col("reason"))).drop("outcome")


# Rules for names of license files, in order, with their score in basis points.
_BASE, _PREFERRED = "(?:un)?licen[sc]e", r"\.(?:md|markdown|txt|html)"
_ANY = r"(?:[^./]|\.[0-9])+"
_EXT, _PLAIN = rf"\.{_ANY}", rf"\.(?!xml|sh|go|gemspec){_ANY}"
_WORDS = rf"[-_][^.]*(?:\.|{_PLAIN})?"
LICENSE_NAMES = [
    ("license", f"^{_BASE}$", 10000),
    ("license_preferred_extension", f"^{_BASE}{_PREFERRED}$", 9500),
    ("copying", "^copying$", 9000),
    ("copying_preferred_extension", f"^copying{_PREFERRED}$", 8500),
    ("license_other_extension", rf"^{_BASE}\.(?!spdx|header){_ANY}$", 8000),
    ("copying_any_extension", f"^copying{_EXT}$", 7500),
    ("license_descriptor", f"^{_BASE}{_WORDS}$", 7000),
    ("copying_descriptor", f"^copying{_WORDS}$", 6500),
    ("prefixed_license", rf"^[a-z0-9_]+[-_]{_BASE}[^.]*(?:\.|{_PLAIN})?$", 6000),
    ("prefixed_copying", rf"^[a-z0-9_]+[-_]copying[^.]*(?:\.|{_PLAIN})?$", 5500),
    ("ofl_preferred_extension", f"^ofl{_PREFERRED}$", 5000),
    ("ofl_other_extension", f"^ofl{_PLAIN}$", 4500),
    ("ofl", "^ofl$", 4000),
    ("copyright", "^copyright$", 3500),
    ("copyright_preferred_extension", f"^copyright{_PREFERRED}$", 3000),
    ("copyright_other_extension", f"^copyright{_PLAIN}$", 2500),
    ("copyright_descriptor", f"^copyright{_WORDS}$", 2000),
    ("patents", "^patents$", 1500),
    ("patents_other_extension", f"^patents{_PLAIN}$", 1000),
]


def license_file(path: Column) -> Column:
    """The rule and score by which a path names a license, as a struct; null for other files and deeper folders."""
    name, none = F.lower(path), F.lit(None).cast("struct<rule:string,score:int>")
    match = lambda rule, score: F.struct(F.lit(rule).alias("rule"), F.lit(score).alias("score"))
    word = "[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?"
    out = F.when(path.rlike(f"^LICENSES/(?i:licenseref-){word}(?i:{_PREFERRED})$"), match("licenses_reference", 10000))
    out = out.when(path.rlike(f"^LICENSES/{word}(?i:{_PREFERRED})$"), match("licenses_identifier", 10000)).when(path.contains("/"), none)
    for rule, pattern, score in LICENSE_NAMES:
        out = out.when(name.rlike(pattern), match(rule, score))
    return out


def best_license(files: DataFrame, by: str, path: str) -> DataFrame:
    """Each group's license file of the highest score, ties to the least path."""
    found = files.withColumn("l", license_file(F.col(path))).where("l is not null")
    return found.groupBy(by).agg(F.min_by(F.struct(path, "l.rule", "l.score"), F.struct(-F.col("l.score"), F.col(path))).alias("b")).select(by, "b.*")


def composite(components: list[DataFrame], quotas: dict[str, int]) -> DataFrame:
    """Selections ``(repository, revision, language)`` of several components as one, sorted by repository; an error where one repeats or a quota is not met exactly."""
    every = reduce(DataFrame.unionByName, [c.select(F.lower("repository").alias("repository"), F.lower("revision").alias("revision"), F.lower("language").alias("language")) for c in components])
    again = every.groupBy("repository", "revision").agg(F.count("*").alias("n")).where("n > 1").orderBy("repository").limit(1).collect()
    if again:
        raise ValueError(f"selected twice: {again[0]['repository']}")
    counts = {r["language"]: r["n"] for r in every.groupBy("language").agg(F.count("*").alias("n")).collect()}  # a row a language
    wrong = sorted(x for x in {*counts, *quotas} if counts.get(x, 0) != quotas.get(x, 0))
    if wrong:
        raise ValueError("; ".join(f"{x}: {counts.get(x, 0)} of {quotas.get(x, 0)}" for x in wrong))
    return every.orderBy("repository")


def continued(prior: DataFrame, extended: DataFrame, facts: list[str]) -> DataFrame:
    """A longer ranked prefix with the assessments of a completed shorter one; an error where an inherited rank differs.

    Both have ``rank``; ``facts`` are the columns by which a candidate is told; ``prior`` has ``assessment`` besides.
    """
    content = lambda df: F.sha2(F.to_json(F.struct(*[df[c] for c in facts]), {"ignoreNullFields": "false"}), 256)
    old = prior.select("rank", content(prior).alias("old_content"), "assessment")
    new = extended.select("*", content(extended).alias("new_content"))
    changed = old.join(new, "rank", "left").where(~F.col("old_content").eqNullSafe(F.col("new_content"))).agg(F.min("rank")).first()[0]
    if changed is not None:
        raise ValueError(f"inherited rank {changed} changed")
    return new.join(old.select("rank", "assessment"), "rank", "left").drop("new_content")


def contiguous(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Whether ranks are 1 to n without a gap: (n, highest, distinct_ranks, contiguous)."""
    r = ranks.agg(F.count("*").alias("n"), F.coalesce(F.max(rank), F.lit(0)).alias("highest"), F.count_distinct(rank).alias("distinct_ranks"), F.coalesce(F.min(rank), F.lit(1)).alias("least"))
    return r.select("n", "highest", "distinct_ranks", ((F.col("highest") == F.col("n")) & (F.col("distinct_ranks") == F.col("n")) & (F.col("least") == 1)).alias("contiguous"))


def rising(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before it in its group: (by, order, value, previous)."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("previous", before).where(F.col("previous") >= F.col(value)).select(*by, order, value, "previous")


def runs_of(rows: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """Consecutive rows of a group that agree in ``same`` as one row each: (by, same, run, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    key = F.struct(*same)
    c = rows.withColumn("__key", key).withColumn("__new", F.when(F.lag("__key").over(w).eqNullSafe(F.col("__key")), 0).otherwise(1))
    return c.withColumn("run", F.sum("__new").over(w)).groupBy(*by, "run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def hours_complete(pages: DataFrame) -> DataFrame:
    """For each ``query`` its 24 hours with the number of pages and whether they are 1 to n: (query, hour, n_pages, complete)."""
    hours = pages.select("query").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    p = pages.groupBy("query", "hour").agg(F.count_distinct("page").alias("n_pages"), F.max("page").alias("last"), F.min("page").alias("first"))
    n = F.coalesce("n_pages", F.lit(0))
    return hours.join(p, ["query", "hour"], "left").select("query", "hour", n.alias("n_pages"), F.coalesce((F.col("first") == 1) & (F.col("last") == F.col("n_pages")), F.lit(False)).alias("complete"))


# ---- commitments

def blanked_commitment(row: list[str], blank: str) -> Column:
    """Digest of a row's JSON with the column that holds the digest itself left empty."""
    return F.sha2(F.to_json(F.struct(*[F.lit("").alias(c) if c == blank else F.col(c) for c in row]), {"ignoreNullFields": "false"}), 256)


def method_identity(*parts: Column) -> Column:
    """Digest of the JSON array of a method's facts: strings quoted, numbers as they are."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def json_string(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":|\}$', "")


def blind_case_id(contract: str, corpus: Column, commitment: Column, case_id: Column) -> Column:
    return F.concat(F.lit("case-"), F.sha2(F.concat_ws("\n", F.lit(contract), corpus, commitment, case_id), 256))


def projected_row_hash(*columns: Column) -> Column:
    """Digest of length-prefixed values; a null is told from an empty text."""
    return F.sha2(identity(*[F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in columns]), 256)


# ---- resumable work

def reuse_markers(events: DataFrame, prefix: str = "__reuse__:") -> DataFrame:
    """Per scan the units that were settled here and those taken over from earlier scans by marker rows."""
    marker = F.col("unit_id").startswith(prefix)
    return events.groupBy("scan_id").agg(F.count_distinct(F.when(~marker, F.col("unit_id"))).alias("own_units"), F.count_distinct(F.when(marker, F.col("unit_id"))).alias("reused_units"))


def admitted(events: DataFrame, by: list[str], order: str, cost: str, limit: float) -> DataFrame:
    """Adds ``spent_before`` and ``admitted``: work is taken on while the spend before it is below the limit; what was admitted is finished."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0.0))).over(w), F.lit(0.0))
    return events.withColumn("spent_before", before).withColumn("admitted", F.col("spent_before") < limit)


def admitted_units(events: DataFrame, by: list[str], order: list[str], units: str, limit: int) -> DataFrame:
    """``admitted`` for costs in whole units, with exact sums in two levels: a scan may hold any number of rows, as no window holds it.

    ``order`` should tell the rows of a scan apart. Adds ``units_before`` and ``admitted``; a null cost is none.
    """
    from .scans import running

    after = running(events.withColumn(units, F.coalesce(F.col(units).cast("long"), F.lit(0).cast("long"))), by, order, {"units_before": units}, name="budget")
    return after.withColumn("units_before", F.col("units_before") - F.col(units)).withColumn("admitted", F.col("units_before") < limit)


def sweep(slots: DataFrame, checkpoints: DataFrame, stages: list[str]) -> DataFrame:
    """What is left to do for each selected slot: (slot, next_stage, state), state done, closed or open; ``checkpoints`` is (slot, seq, stage, terminal)."""
    last = checkpoints.groupBy("slot").agg(F.max_by(F.struct("stage", "terminal"), "seq").alias("c"))
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("c.stage"))
    following = F.get(F.array(*[F.lit(s) for s in stages]), F.coalesce(place, F.lit(0)).cast("int"))
    closed = F.coalesce(F.col("c.terminal"), F.lit(False))
    state = F.when(closed, "closed").when(following.isNull(), "done").otherwise("open")
    return slots.select("slot").join(last, "slot", "left").select("slot", F.when(state == "open", following).alias("next_stage"), state.alias("state"))


def one_in_flight(work: DataFrame, key: str, order: str) -> DataFrame:
    """Work in waves in which each key occurs once: adds ``wave``."""
    return work.withColumn("wave", F.row_number().over(Window.partitionBy(key).orderBy(order)))
