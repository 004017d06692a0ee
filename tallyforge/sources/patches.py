"""Pull-request frames: exact-schema Parquet, patch facts from unified diffs, exclusions, ranks, late payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.hashing import rank_digest
from ..functions.text import repository_identity, revision

# The columns of a shard; only the first seven are ever read.
READ = ["base_commit", "created_at", "instance_id", "license", "patch", "repo", "pull_number"]
OTHERS = ["FAIL_TO_PASS", "PASS_TO_PASS", "hints_text", "install_config", "interface", "meta", "pr_description", "problem_statement", "test_patch"]
# Languages of changed files by extension.
EXTENSIONS = {"go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "kt": "kotlin", "kts": "kotlin", "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript"}


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The seven readable columns with each row's file and place; other columns than the known ones are refused."""
    whole = spark.read.parquet(*paths)
    if sorted(whole.columns) != sorted(READ + OTHERS):
        raise ValueError(f"columns differ: {sorted(set(whole.columns) ^ set(READ + OTHERS))}")
    return whole.select(*READ, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))


def payload(spark: SparkSession, paths: list[str], chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Wide columns of chosen rows only, in a second scan; ``chosen`` is (shard, shard_row)."""
    wide = spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))
    return wide.join(chosen.select("shard", "shard_row"), ["shard", "shard_row"], "left_semi")


def _language(path: Column) -> Column:
    extension = F.regexp_extract(F.lower(path), r"\.([^.]*)$", 1)
    return F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]


def patch_facts(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """Per patch: language, changed paths, added and deleted filled lines, and the reason of its exclusion.

    Lines are numbered; running aggregates over each patch give every line its file section, whether
    a hunk has begun there, and the last paths before it. A patch is one row, so its lines fit a task.
    """
    lines = patches.select(key, F.posexplode(F.split(F.coalesce(F.col(patch), F.lit("")), "\n")).alias("at", "raw")).withColumn("line", F.regexp_replace("raw", "\r$", ""))
    order = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("section", F.count_if(F.col("line").startswith("diff --git ")).over(order))
    within = Window.partitionBy(key, "section").orderBy("at")
    hunk = F.col("line").startswith("@@ ") | (F.col("line") == "@@")
    lines = lines.withColumn("hunk", hunk).withColumn("begun", F.count_if("hunk").over(within.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    header = ~F.col("begun") & F.col("line").rlike(r"^(---|\+\+\+) ")
    value = F.trim(F.substr("line", F.lit(5)))
    bad = header & (value != "/dev/null") & (value.startswith('"') | value.contains("\t"))
    path = F.regexp_replace(value, "^[ab]/", "")
    bad = bad | (header & (value != "/dev/null") & path.rlike(r"^$|^/|(^|/)\.\.(/|$)"))
    named = F.when(header & (value != "/dev/null"), F.translate(path, "\\", "/"))
    # a header of /dev/null takes back an earlier name of its side
    of = lambda mark: F.last(F.when(header & F.col("line").startswith(mark), F.struct(named.alias("p"))), ignorenulls=True).over(within)["p"]
    lines = lines.withColumn("bad", bad).withColumn("path", F.coalesce(of("+++ "), of("--- ")))
    lines = lines.withColumn("lost", F.col("hunk") & F.col("path").isNull())
    active = F.last(F.when(F.col("hunk"), F.struct(_language(F.col("path")).alias("l"))), ignorenulls=True).over(within)["l"]
    lines = lines.withColumn("language", active)
    body = F.col("begun") & ~F.col("hunk") & F.col("language").isNotNull()
    filled = lambda sign: body & F.col("line").startswith(sign) & (F.trim(F.substr("line", F.lit(2))) != "")
    facts = lines.groupBy(key).agg(
        F.bool_or("bad").alias("bad"),
        F.bool_or("lost").alias("lost"),
        F.bool_or("hunk").alias("any_hunk"),
        F.array_sort(F.collect_set(F.when(F.col("hunk"), F.col("language")))).alias("languages"),
        F.array_sort(F.collect_set(F.when(F.col("hunk") & F.col("language").isNotNull(), F.col("path")))).alias("changed_paths"),
        F.count_if(filled("+")).alias("added"),
        F.count_if(filled("-")).alias("deleted"),
    )
    reason = (
        F.when(F.col("bad") | F.col("lost") | ~F.col("any_hunk"), "malformed_patch")
        .when(F.size("languages") == 0, "no_supported_language")
        .when(F.size("languages") > 1, "multiple_supported_languages")
        .when(F.col("added") + F.col("deleted") == 0, "no_supported_language_hunks")
        .when(F.col("deleted") <= F.col("added"), "no_net_supported_language_reduction")
    )
    return facts.select(key, F.get("languages", F.lit(0)).alias("language"), "changed_paths", "added", "deleted", reason.alias("patch_reason"))


def frame(rows: DataFrame, contract: str, seed: str) -> DataFrame:
    """Rows with their facts, the first exclusion that holds, the duplicate mark and the rank digest.

    Of the rows of one pull request the first in shard order counts, even where it is excluded itself.
    """
    rows = rows.withColumn("row_id", F.concat_ws(":", "shard", "shard_row"))
    joined = rows.join(patch_facts(rows, "row_id"), "row_id").withColumn("repository", repository_identity(F.col("repo"))).withColumn("revision", revision(F.col("base_commit")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(blank("instance_id"), "empty_instance_id")
        .when(F.col("repository").isNull(), "invalid_repository")
        .when(F.col("revision").isNull(), "invalid_base_revision")
        .when(F.coalesce(F.col("pull_number"), F.lit(0)) <= 0, "invalid_pull_number")
        .when(blank("created_at"), "empty_created_at")
        .when(blank("license"), "empty_license")
        .otherwise(F.col("patch_reason"))
    )
    later = F.row_number().over(Window.partitionBy("repository", "pull_number").orderBy("shard", "shard_row")) > 1
    duplicate = F.col("repository").isNotNull() & F.col("pull_number").isNotNull() & later
    digest = rank_digest(contract, seed, F.col("repository"), F.col("pull_number"), F.col("revision"), F.sha2("patch", 256))
    return joined.withColumn("reason", F.when(duplicate, "duplicate_pull_request").otherwise(reason)).withColumn("digest", digest).drop("patch_reason", "row_id")


def hunk_ranges(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """Old and new line ranges of every hunk; an omitted count is 1, and a count of 0 has no lines."""
    line = patches.select(key, F.posexplode(F.split(patch, "\n")).alias("at", "line")).where(F.col("line").startswith("@@ "))
    part = lambda k: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    number = lambda k, d: F.when(part(k) == "", d).otherwise(part(k).cast("int"))
    return line.where(part(1) != "").select(key, "at", number(1, None).alias("old_start"), number(2, 1).alias("old_count"), number(3, None).alias("new_start"), number(4, 1).alias("new_count"))
