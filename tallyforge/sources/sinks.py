"""Sinks: tables that are never overwritten, journals that grow, rendered reports, sealed results, inventories."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import set_commitment
from ..functions.text import has_component, is_test_file, language_of
from ..operators.release import blanked_commitment


def create_json(df: DataFrame, path: str) -> None:
    """Writes rows as JSON to a new place; an error if it exists."""
    df.write.mode("errorifexists").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Adds rows to a journal of JSON lines; earlier files are never touched, and every line ends."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def repository_csv(repositories: DataFrame, path: str) -> None:
    """A ``repo,metadata`` file in one part, ordered by numeric id: (id, full_name, created_at). Frames of repositories fit a task."""
    lines = repositories.select("id", F.concat_ws(",", F.concat(F.lit("https://github.com/"), "full_name"), F.col("created_at")).alias("value"))
    header = repositories.sparkSession.createDataFrame([(None, "repo,metadata")], lines.schema)
    header.unionByName(lines).coalesce(1).sortWithinPartitions(F.col("id").asc_nulls_first()).select("value").write.mode("errorifexists").text(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(file_path, sha256, n_bytes)`` of every file below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    return files.select(relative(F.col("path"), base).alias("file_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def relative(path: Column, base: str) -> Column:
    """The part of a path below a folder."""
    return F.substr(path, F.instr(path, F.lit(base + "/")) + len(base) + 1)


def sealed(rows: DataFrame, columns: list[str], digest: str) -> DataFrame:
    """Rows with the digest of their own JSON, for which the digest's column is left empty."""
    return rows.select(*[c for c in columns if c != digest]).withColumn(digest, F.lit("")).select(*columns).withColumn(digest, blanked_commitment(columns, digest))


def seal_errors(rows: DataFrame, columns: list[str], digest: str) -> DataFrame:
    """Rows whose digest does not follow from them."""
    return rows.withColumn("expected", blanked_commitment(columns, digest)).where(~F.col(digest).eqNullSafe(F.col("expected")))


def completed_run(files: DataFrame, verdicts: DataFrame, scan_id: str, contract: str) -> DataFrame:
    """One sealed row for a finished scan: numbers by tier, commitments to its sources (file_path, sha256) and to its verdicts (unit_id, tier)."""
    tiers = ("slop", "kinda_slop", "clean", "unresolved")
    of_files = files.agg(F.count("*").alias("files"), set_commitment(F.concat_ws(" ", "sha256", "file_path")).alias("sources_sha256"))
    of_verdicts = verdicts.agg(F.count("*").alias("units"), *[F.count_if(F.col("tier") == t).alias(t) for t in tiers], set_commitment(F.concat_ws(" ", "unit_id", "tier")).alias("verdicts_sha256"))
    row = of_files.crossJoin(of_verdicts).withColumn("scan_id", F.lit(scan_id)).withColumn("contract", F.lit(contract))  # single rows
    columns = ["scan_id", "contract", "files", "sources_sha256", "units", *tiers, "verdicts_sha256", "run_sha256"]
    return sealed(row, columns, "run_sha256")


def verify_run(run: DataFrame, files: DataFrame, verdicts: DataFrame) -> list[str]:
    """What does not agree between a sealed run and its sources and verdicts."""
    row = run.first()
    again = completed_run(files, verdicts, row["scan_id"], row["contract"]).first()
    return [c for c in run.columns if row[c] != again[c]]


def tier_counts(verdicts: DataFrame) -> DataFrame:
    """Numbers by tier for a report's foot, worst first; tiers without any are shown with zero."""
    tiers = verdicts.sparkSession.createDataFrame([(k, t) for k, t in enumerate(("slop", "kinda_slop", "unresolved", "clean"))], "place int, tier string")
    n = verdicts.groupBy("tier").agg(F.count("*").alias("n"))
    return tiers.join(n, "tier", "left").select("place", "tier", F.coalesce("n", F.lit(0)).alias("n"))


def markdown(verdicts: DataFrame) -> str:
    """A report of all flagged files (file_path, verdict, top_reasons), gravest first, and the numbers of all; read a partition at a time."""
    grade = F.when(F.col("verdict") == "slop", 0).when(F.col("verdict") == "unresolved", 1).when(F.col("verdict") == "kinda_slop", 2)
    shown = verdicts.where(grade.isNotNull()).orderBy(grade, "file_path").toLocalIterator()
    counts = tier_counts(verdicts.withColumnRenamed("verdict", "tier")).orderBy("place").collect()
    out = ["# Report", ""]
    out += [line for r in shown for line in [f"## {r['file_path']}: {r['verdict']}", *[f"- {x}" for x in r["top_reasons"]], ""]]
    return "\n".join([*out, ", ".join(f"{r['tier']} {r['n']}" for r in counts)]) + "\n"


def write_atomically(text: str, path: str) -> None:
    """Puts a whole text in place of a file, or leaves it as it was."""
    passing = f"{path}.{os.getpid()}.passing"
    with open(passing, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(passing, path)


# ---- the driver's own files

def repository_root(start: str, markers: tuple[str, ...] = (".git", "pyproject.toml", "package.json", "Cargo.toml", "go.mod")) -> str | None:
    """The nearest folder from ``start`` upwards that holds a marker."""
    at = Path(start).resolve()
    for folder in (at, *at.parents) if at.is_dir() else at.parents:
        if any((folder / m).exists() for m in markers):
            return str(folder)
    return None


def settings(start: str, name: str) -> dict:
    """The nearest settings file upwards, empty where there is none; a broken one is an error."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / name).is_file():
            with open(folder / name, "rb") as f:
                return tomllib.load(f)
    return {}


# ---- what of a tree is read

def kept_file(path: Column, ignored: list[str]) -> Column:
    """Supported source below no ignored folder that is no test."""
    return language_of(path).isNotNull() & ~has_component(path, ignored) & ~is_test_file(path)


def kept_evidence(path: Column, ignored: list[str]) -> Column:
    """Supported tests below no ignored folder."""
    return language_of(path).isNotNull() & ~has_component(path, ignored) & is_test_file(path)


def context_files(files: DataFrame, ignored: list[str]) -> DataFrame:
    """Production files and tests of ``files`` (file_path, ...), each path once, with ``is_evidence``."""
    path = F.col("file_path")
    known = files.where(kept_file(path, ignored)).withColumn("is_evidence", F.lit(False))
    tests = files.where(kept_evidence(path, ignored)).withColumn("is_evidence", F.lit(True))
    return known.unionByName(tests).dropDuplicates(["file_path"])


def gitignored(path: Column, rules: list[str]) -> Column:
    """Whether a path is left out by the rules of an ignore file, of which the last that fits decides."""
    import re

    def pattern(rule: str) -> str:
        anchored = "/" in rule.rstrip("/")
        body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return ("^" if anchored else "(?:^|/)") + body + ("/" if rule.endswith("/") else "(?:/|$)")

    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        wanted = not rule.startswith("!")
        out = F.when(path.rlike(pattern(rule.lstrip("!"))), F.lit(wanted)).otherwise(out)
    return out


def captured_records(captured: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Records of a capture whose fields are ended by NUL: every ``len(fields)`` of them are one row, with its place."""
    n = len(fields)
    parts = F.split(F.regexp_replace(column, "\0$", ""), "\0")
    rows = captured.withColumn("__p", parts).where(F.col(column) != "")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("__p") - 1) / n).cast("int")))
    kept = [c for c in captured.columns if c != column]
    return rows.select(*kept, "__p", at.alias("place")).select(*kept, "place", *[F.get("__p", F.col("place") * n + k).alias(f) for k, f in enumerate(fields)])
