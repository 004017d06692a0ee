"""Text frames: repository lists with typed rejections, paged API answers, event journals, source trees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import has_component, is_test_file, language_of, repository_identity
from ..storage import written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_number, line)`` of text files, read by lines, so that a large file is many tasks.

    A file's parts keep their order in the id that grows over the scan's partitions, which hold them in the
    order of their files; a line's number follows from the sizes of the parts before it.
    """
    spark_lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    rows = written(spark_lines.withColumn("at", F.monotonically_increasing_id()), "lines")
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    # the lines of one block of a file are read by one task, one after the other
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_number"), F.regexp_replace("line", "\r$", "").alias("line"))


def repository_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``repo,metadata`` file: line number, repository, and the reason of a rejection.

    A record is cut at its first comma; blank lines are neither counted nor rejected; the header is line 1.
    """
    return repository_rows(numbered_lines(spark, path))


def repository_rows(lines: DataFrame) -> DataFrame:
    rows = lines.where((F.col("line_number") > 1) & (F.trim("line") != ""))
    repo = repository_identity(F.substring_index("line", ",", 1))
    rows = rows.withColumn("repository", F.when(F.col("line").contains(","), repo))
    first = F.row_number().over(Window.partitionBy("repository").orderBy("line_number"))
    reason = F.when(~F.col("line").contains(","), "malformed_record").when(F.col("repository").isNull(), "invalid_repository_identity").when(first > 1, "duplicate_repository_identity")
    return rows.withColumn("reason", reason).select("line_number", "repository", "reason", F.sha2("line", 256).alias("row_sha256"))


ITEM = "struct<id:bigint,full_name:string,created_at:string,fork:boolean,archived:boolean,mirror_url:string,is_template:boolean>"


def pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of paged answers ``(query, page, per_page, response)`` and, per query, whether the pages are complete."""
    parsed = raw.withColumn("r", F.from_json("response", f"total_count bigint, incomplete_results boolean, items array<{ITEM}>", {"mode": "FAILFAST"}))
    items = parsed.select("query", "page", F.explode("r.items").alias("item")).select("query", "page", "item.*").dropDuplicates(["query", "id"])
    per_query = parsed.groupBy("query").agg(
        F.max("r.total_count").alias("total"),
        F.count_distinct("r.total_count").alias("totals"),
        F.sum(F.size("r.items")).alias("found"),
        F.count_distinct("page").alias("pages"),
        F.max("page").alias("last_page"),
        F.bool_or("r.incomplete_results").alias("incomplete"),
    )
    complete = ~F.col("incomplete") & (F.col("totals") == 1) & (F.col("found") == F.col("total")) & (F.col("pages") == F.col("last_page"))
    return items, per_query.withColumn("complete", complete)


JOURNAL = "version int, scan_id string, stage string, is_manifest boolean, unit_id string, expected_units long, source_hash string, context_hash string, status string, provider string, model string, in_tok long, out_tok long, cached_in_tok long, estimated_cost_usd double, timestamp_unix_ms long, retry_on_resume boolean"


def _torn(spark: SparkSession, path: str) -> list[str]:
    """Those of the files at ``path`` that don't end with a line end, by their last byte alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(where) or []:
        for one in system.listStatus(status.getPath()):
            if one.isFile() and one.getLen():
                stream = system.open(one.getPath())
                stream.seek(one.getLen() - 1)
                if stream.read() != 10:
                    out.append(one.getPath().toString())
                stream.close()
    return out


def journal(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """Events of a JSONL journal with their line numbers. A last line without its end is a torn write and is dropped; any other broken line is an error."""
    lines = numbered_lines(spark, path)
    for file in _torn(spark, path):
        mine = F.regexp_replace("file", "^file:/+", "/") == F.lit(re.sub("^file:/+", "/", file))
        last = lines.where(mine).agg(F.max("line_number")).first()[0]
        lines = lines.where(~(mine & (F.col("line_number") == last)))
    # written before it is parsed: a later filter could be moved below a condition on parsed values
    kept = written(lines.where(F.trim("line") != ""), "journal-lines")
    return kept.select("file", F.col("line_number").alias("seq"), F.from_json("line", schema, {"mode": "FAILFAST"}).alias("e")).select("file", "seq", "e.*")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each unit; manifests are no units."""
    real = events.where(~F.coalesce(F.col("is_manifest"), F.lit(False)))
    return real.groupBy("scan_id", "unit_id").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("scan_id", "unit_id", "seq")]), "seq").alias("e"), F.max("seq").alias("seq")).select("scan_id", "unit_id", "seq", "e.*")


def reusable(wanted: DataFrame, events: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Units of ``(unit_id, stage, source_hash, context_hash)`` that an earlier event settles, and those that are left."""
    done = latest(events).where(F.col("version") == version).where(~F.coalesce(F.col("retry_on_resume"), F.lit(False)))
    keys = ["unit_id", "stage", "source_hash", "context_hash"]
    return wanted.join(done.select(*keys), keys, "left_semi"), wanted.join(done.select(*keys), keys, "left_anti")


def source_files(spark: SparkSession, root: str, ignored: list[str] = ("node_modules", "target", ".git", "dist", "build", "vendor"), rules: list[str] = ()) -> DataFrame:
    """Supported source files below a root with language, text, digest and whether they are tests; ``rules`` are those of an ignore file."""
    from .sinks import gitignored

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "")
    named = files.select(path.alias("file_path"), "content", F.sha2("content", 256).alias("source_hash"))
    kept = named.withColumn("language", language_of(F.col("file_path"))).where("language is not null").where(~has_component(F.col("file_path"), list(ignored)) & ~gitignored(F.col("file_path"), list(rules)))
    return kept.select("file_path", "language", F.decode("content", "UTF-8").alias("source"), "source_hash", is_test_file(F.col("file_path")).alias("is_test"))


def cache_misses(files: DataFrame, cache: DataFrame, contract: str) -> DataFrame:
    """Files that the content-addressed cache lacks; its key is a digest of contract, extension and content."""
    key = F.sha2(F.concat(F.lit(contract), F.char(F.lit(0)), "language", F.char(F.lit(0)), "source_hash"), 256)
    return files.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_store(parsed: DataFrame, path: str) -> None:
    """Adds parsed files with their ``cache_key`` to the cache; entries are never changed, so a file that comes twice gives equal rows."""
    parsed.dropDuplicates(["cache_key"]).write.mode("append").parquet(path)
