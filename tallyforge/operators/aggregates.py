"""Aggregates: ratios with their 0/0 rules, metrics, gates, votes, agreement, costs, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(n: Column, d: Column, of_nothing: float = 1.0) -> Column:
    """n/d; 0/0 is 1 for precision, recall and validity and 0 for rates."""
    return F.when(d == 0, F.lit(of_nothing)).otherwise(n / F.nullif(d, F.lit(0)))


def is_finding(tier: Column) -> Column:
    return tier.isin("slop", "kinda_slop")


def metrics(joined: DataFrame, by: list[str]) -> DataFrame:
    """Tier metrics over ``expected_tier`` and ``predicted_tier`` for all rows and by each column's values (grouping sets)."""
    e, p = F.col("expected_tier"), F.col("predicted_tier")
    grouped = joined.rollup(*by) if by else joined.groupBy()
    both = is_finding(e) & is_finding(p)
    counted = grouped.agg(
        F.count("*").alias("cases"),
        F.count_if((e == "slop") & (p == "slop")).alias("slop_tp"),
        F.count_if(p == "slop").alias("slop_predicted"),
        F.count_if(e == "slop").alias("slop_expected"),
        F.count_if(both).alias("finding_tp"),
        F.count_if(is_finding(p)).alias("finding_predicted"),
        F.count_if(is_finding(e)).alias("finding_expected"),
        F.count_if(~is_finding(e) & is_finding(p)).alias("false_positives"),
    )
    return counted.select(
        *by,
        "cases",
        "slop_tp",
        "finding_tp",
        "false_positives",
        ratio(F.col("slop_tp"), F.col("slop_predicted")).alias("slop_precision"),
        ratio(F.col("slop_tp"), F.col("slop_expected")).alias("slop_recall"),
        ratio(F.col("finding_tp"), F.col("finding_predicted")).alias("finding_precision"),
        ratio(F.col("finding_tp"), F.col("finding_expected")).alias("finding_recall"),
        ratio(F.col("false_positives"), F.col("cases") - F.col("finding_expected"), 0.0).alias("false_positive_rate"),
    )


# The least precision and recall of a release.
GATES = {"slop_precision": 0.95, "finding_precision": 0.85, "finding_recall": 0.80}


def failed_gates(row: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """Adds ``errors``, every gate that fails, in the order of the gates."""
    errors = [F.when(F.col(name) < least, F.lit(f"{name} below {least:.2f}")) for name, least in gates.items()]
    return row.withColumn("errors", F.array_compact(F.array(*errors)))


def dominant(df: DataFrame, by: str, value: str) -> DataFrame:
    """Each group's most frequent value; ties go to the smallest."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("dominant"), F.max("n").alias("n"))


def repeatability(runs: DataFrame, case: str, run: str, outcome: list[str]) -> DataFrame:
    """Share of cases with one outcome in all runs, and identities found by all runs over those found by any."""
    n_runs = runs.agg(F.count_distinct(run).alias("n")).first()["n"]
    stable = runs.groupBy(case).agg((F.count_distinct(F.struct(*outcome)) == 1).alias("same"), F.count_distinct(run).alias("in_runs"))
    return stable.agg(
        ratio(F.count_if("same"), F.count("*"), 0.0).alias("stable_share"),
        ratio(F.count_if(F.col("in_runs") == n_runs), F.count("*"), 0.0).alias("shared_share"),
    )


def duplicate_rate(df: DataFrame, fingerprint: Column) -> DataFrame:
    groups = df.groupBy(fingerprint.alias("f")).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), ratio(F.sum(F.col("n") - 1), F.sum("n"), 0.0).alias("duplicate_rate"))


def majority(votes: DataFrame, unit: str, vote: str, of_tie: str = "unresolved") -> DataFrame:
    """Each unit's most frequent vote, or ``of_tie`` where several share the lead."""
    counts = votes.groupBy(unit, vote).agg(F.count("*").alias("n"))
    top = counts.groupBy(unit).agg(F.max("n").alias("n_votes"), F.max_by(vote, F.struct("n", vote)).alias("__winner"), F.sort_array(F.collect_list("n"), asc=False).alias("__ns"))
    tie = F.coalesce(F.get("__ns", F.lit(1)), F.lit(0)) == F.col("n_votes")
    return top.select(unit, F.when(tie, F.lit(of_tie)).otherwise(F.col("__winner")).alias("verdict"), "n_votes", tie.alias("tie"))


def agreement(decisions: DataFrame, unit: str, reviewer: str, signature: Column) -> DataFrame:
    """``agreed``, ``disputed`` or ``incomplete`` (fewer than two reviewers) for each unit."""
    g = decisions.groupBy(unit).agg(F.count_distinct(reviewer).alias("reviewers"), F.count_distinct(signature).alias("signatures"))
    return g.withColumn("status", F.when(F.col("reviewers") < 2, "incomplete").when(F.col("signatures") == 1, "agreed").otherwise("disputed"))


# Dollars for a million tokens in, cached and out.
RATES = (0.14, 0.0028, 0.28)


def token_cost(tokens_in: Column, cached: Column, tokens_out: Column, rates: tuple[float, float, float] = RATES) -> Column:
    """Cost in dollars; cached tokens never exceed those that went in."""
    held = F.least(cached, tokens_in)
    return ((tokens_in - held) * rates[0] + held * rates[1] + tokens_out * rates[2]) / 1e6


def batches(n: Column, size: int = 8) -> Column:
    return F.floor((n + (size - 1)) / size)


def estimate(files: DataFrame) -> DataFrame:
    """Scan estimate from files of ``(n_methods, file_chars, method_chars)``: batches, tokens, requests, seconds."""
    b = batches(F.col("n_methods"))
    s = files.agg(
        F.sum("n_methods").alias("methods"),
        F.sum(b).alias("batches"),
        F.sum("file_chars").alias("source_chars"),
        F.sum(F.col("file_chars") * b + F.col("method_chars")).alias("review_chars"),
    )
    third = lambda x: F.floor((x + 2) / 3)
    m, review = F.col("methods"), F.col("review_chars")
    return s.select(
        "methods",
        "batches",
        third(2 * review + 1800 * m).alias("input_low"),
        third(3 * review + F.col("source_chars") + 6000 * m).alias("input_high"),
        (250 * m).alias("output_low"),
        (900 * m).alias("output_high"),
        (2 * F.col("batches")).alias("requests_low"),
        (3 * F.col("batches")).alias("requests_high"),
        (5 * F.floor((2 * F.col("batches") + 3) / 4)).alias("seconds_low"),
        (120 * F.floor((3 * F.col("batches") + 3) / 4)).alias("seconds_high"),
    )


def journal_summary(journal: DataFrame, scan: str, unit: str, seq: str, status: str, cost: str) -> DataFrame:
    """One row per scan: events, units, spend, and how many units' latest event has each status."""
    latest = journal.groupBy(scan, unit).agg(F.max_by(status, seq).alias("status"), F.count("*").alias("events"), F.sum(cost).alias("spent"))
    kinds = latest.groupBy(scan, "status").agg(F.count("*").alias("units"), F.sum("events").alias("events"), F.sum("spent").alias("spent"))
    statuses = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "units"))))
    return kinds.groupBy(scan).agg(F.sum("events").alias("events"), F.sum("units").alias("units"), F.round(F.sum("spent"), 6).alias("spent"), statuses.alias("statuses"))


def merge_cases(cases: DataFrame, key: str, content: list[str], sets: list[str], least: str) -> DataFrame:
    """Cases of one id as one: content has to agree, sets are united in order, ``least`` takes the minimum."""
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    g = cases.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("__kinds"), *[F.min(c).alias(c) for c in content], *united, F.min(least).alias(least))
    return g.withColumn("conflict", F.col("__kinds") > 1).drop("__kinds")


def fill_symbols(rows: DataFrame, key: str, attributes: list[str], order: str, sets: list[str] = ()) -> DataFrame:
    """One row per symbol: the first known value of each attribute by ``order``, the united ``sets``, and whether known values differ."""
    picked = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    conflict = F.greatest(F.lit(0), *[F.count_distinct(a) for a in attributes]) > 1
    return rows.groupBy(key).agg(*picked, *united, conflict.alias("conflict"))


def architecture(methods: DataFrame, calls: DataFrame, most_methods: int = 20, most_loc: int = 100) -> DataFrame:
    """Per file the method counts, sizes, fan-out and reasons; ``calls`` is (file_path, target_file)."""
    out = calls.where("file_path <> target_file").groupBy("file_path").agg(F.count_distinct("target_file").alias("outbound"))
    into = calls.where("file_path <> target_file").groupBy(F.col("target_file").alias("file_path")).agg(F.count("*").alias("external_refs"))
    m = methods.groupBy("file_path").agg(F.count("*").alias("methods"), F.count_if("is_exported").alias("exported"), F.max("loc").alias("max_loc"), F.min(F.when(F.col("loc") > 0, F.col("loc"))).alias("min_loc"))
    m = m.join(out, "file_path", "left").join(into, "file_path", "left").na.fill(0, ["outbound", "external_refs"])
    n, spread = F.col("methods"), F.col("max_loc") / F.coalesce("min_loc", F.lit(1))
    oversized = (n > 0) & (n < 4) & (F.col("max_loc") > most_loc)
    reasons = F.array_compact(
        F.array(
            F.when((F.col("outbound") >= 5) & (n >= most_methods // 2) & ((F.col("exported") >= 4) | (n >= 10)), F.format_string("module has broad dependency fan-out (%d outbound files)", "outbound")),
            F.when((F.col("exported") >= 4) & (F.col("external_refs") >= 8), F.lit("module mixes public surface and orchestration")),
            F.when((n >= 10) & (F.col("exported") >= 4) & (spread >= 2.5), F.lit("sprawling helper surface")),
            F.when((spread >= 8) & (F.col("outbound") >= 3) & (n >= 6), F.lit("uneven method sizes")),
        )
    )
    one = F.array(F.format_string("module is dominated by one oversized method (%d LOC)", "max_loc"))
    return m.withColumn("reasons", F.when(oversized, one).otherwise(reasons))


def churn(commits: DataFrame) -> DataFrame:
    """Commits and revert-like commits per file with their reasons; ``commits`` is (file_path, sha, subject)."""
    c = commits.groupBy("file_path").agg(F.count("*").alias("commits"), F.count_if(F.lower("subject").rlike("revert|rollback|undo")).alias("reverts"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("commits") >= 8, F.format_string("high churn (%d commits touched this file)", "commits")),
            F.when((F.col("reverts") >= 1) & (F.col("commits") >= 3), F.format_string("rework-heavy file (%d commits, %d revert-like commits)", "commits", "reverts")),
        )
    )
    return c.withColumn("reasons", reasons)


def rolled_up(flags: DataFrame, by: str, severity: str, reasons: str) -> DataFrame:
    """Flags per group: verdict, number of flags and the three gravest reasons, by severity, then text."""
    each = flags.select(by, severity, F.explode(reasons).alias("reason"))
    worst = each.groupBy(by, "reason").agg(F.max(severity).alias("severity"))
    top = worst.groupBy(by).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), "reason"))), lambda x: x["reason"]), 1, 3).alias("top_reasons"), F.max("severity").alias("worst"))
    n = flags.groupBy(by).agg(F.count("*").alias("n_flags"), F.count_if(F.col(severity) == 1).alias("n_mild"))
    verdict = F.when(F.col("worst") >= 2, "slop").when(F.col("n_mild") >= 3, "slop").when(F.col("n_mild") >= 1, "kinda_slop").otherwise("clean")
    return n.join(top, by).select(by, "n_flags", verdict.alias("verdict"), "top_reasons")
