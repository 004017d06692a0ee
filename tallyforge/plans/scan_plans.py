"""Queries over methods, files and flags that are derived from the tables, with the rules of static signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import shape as S, text as T
from ..operators import aggregates as A, scoring, symbols
from ..operators.graph import dealt
from ..storage import fresh_path
from ..streaming import journal as J, stages as ST
from . import fixtures as X
from .registry import query, read

# Methods made from line items; the text is read by both engines, so it holds no backslash and no escape.
_SOURCES = [
    "def total(x):\n    return x + 1",
    "def walk(x):\n    if x:\n        return 1\n    elif y:\n    else if z\n    case 3\n    for i in x:\n    while i:\n    return 2",
    "switch (x) {\ncase 1:\ncase 2:\n}",
    "loop {\n  for a in b {\n  while (c) {\n}",
    "def drop(a):\n    del a\n    return None",
    "fun plain(x) {\n  val y = x\n}",
]
_NAMES = ["handle_it", "total", "processData", "process_all_the_data", "getData", "visit", "data", "walk"]


def _case(of: str, texts: list[str]) -> str:
    return f"CASE {of} " + " ".join("WHEN {} THEN '{}'".format(k, t.replace("'", "''")) for k, t in enumerate(texts)) + " END"


_METHOD_COLUMNS = [
    "CASE l_orderkey % 11 WHEN 0 THEN 'tests/t' WHEN 1 THEN 'docs/d' WHEN 2 THEN 'app/scripts/s' WHEN 3 THEN 'lib/client/c' ELSE 'lib/core/m' END || CAST(l_orderkey % 997 AS VARCHAR(20)) || CASE l_orderkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS file_path",
    _case("l_partkey % 8", _NAMES) + " AS name",
    "CAST(l_quantity * 3 AS INT) AS loc",
    "CAST(l_linenumber + l_suppkey % 3 AS INT) AS param_count",
    "CAST(l_linenumber % 8 AS INT) AS nesting_depth",
    "CAST(l_orderkey * 10 + l_linenumber AS INT) AS start_line",
    "l_returnflag = 'N' AS is_exported",
    _case("l_suppkey % 6", _SOURCES) + " AS source",
]
METHODS_SQL = f"(SELECT {', '.join(_METHOD_COLUMNS)} FROM lineitem)"


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag").selectExpr(*_METHOD_COLUMNS)
    return m.withColumn("language", T.language_of(F.col("file_path"))).withColumn("end_line", F.col("start_line") + F.col("loc") - 1)


def _kinds(methods: DataFrame) -> DataFrame:
    return S.module_kinds(methods.select("file_path", F.lit("text").alias("source")).distinct(), methods)


_SNAKE = "lower(regexp_replace(regexp_replace(name, '([^_])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
_GENERIC = f"(regexp_matches({_SNAKE}, '^(handle|process|do|manage|get|set|update)|^(data|temp|result|info|stuff|misc)$') AND len(list_filter(string_split({_SNAKE}, '_'), lambda x: x <> '')) <= 2)"
_STARTS = lambda words: "len(list_filter(string_split(source, chr(10)), lambda x: " + " OR ".join(f"starts_with(ltrim(x), '{w}')" for w in words) + "))"
_REASONS = f"""list_filter([CASE WHEN loc > 100 THEN 'function is too big (' || loc || ' LOC > 100)' END, CASE WHEN nesting_depth > 6 THEN 'control flow is tangled (nesting ' || nesting_depth || ' > 6)' END,
    CASE WHEN param_count > 6 THEN 'too many parameters (' || param_count || ' params > 6)' END, CASE WHEN {_GENERIC} THEN 'name is vague' END,
    CASE WHEN b >= 3 AND l >= 2 AND loc <= 25 THEN 'control flow is tangled (' || b || ' branches, ' || l || ' loops)' END,
    CASE WHEN b >= 3 AND NOT (l >= 2 AND loc <= 25) THEN 'branchy control flow (' || b || ' branches)' END, CASE WHEN l >= 2 AND NOT (b >= 3 AND loc <= 25) THEN 'loop-heavy control flow (' || l || ' loops)' END], lambda x: x IS NOT NULL)"""
_SURFACE = "(starts_with(file_path, 'tests/') OR starts_with(file_path, 'docs/') OR starts_with(file_path, 'app/scripts/') OR (n >= 3 AND helpers = n))"
_SCORED = f"""WITH m AS (SELECT *, {_STARTS(T.BRANCHES)} AS b, {_STARTS(T.LOOPS)} AS l FROM {METHODS_SQL}),
  f AS (SELECT file_path, count(*) AS n, count(*) FILTER (name IN ('getData', 'walk')) AS helpers FROM m GROUP BY 1),
  s AS (SELECT m.*, f.n, f.helpers, {_REASONS} AS reasons FROM m JOIN f USING (file_path))"""


@query(
    _SCORED
    + f""", p AS (SELECT *, CASE WHEN loc <= 8 AND contains(source, 'del ') THEN list_append(reasons, 'placeholder implementation') ELSE reasons END AS every FROM s WHERE NOT {_SURFACE})
  SELECT file_path, name AS method_name, start_line, array_to_string(every, '; ') AS reasons,
    CASE WHEN regexp_matches(array_to_string(every, '; '), 'function is too big|control flow is tangled|too many parameters|placeholder implementation') THEN 'slop' ELSE 'kinda_slop' END AS tier FROM p WHERE len(every) > 0 AND every <> ['name is vague']"""
)
def method_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of methods by size, nesting, parameters, names, control flow and placeholder bodies."""
    m = S.judged(_methods(spark, sf_dir))
    return scoring.method_flags(scoring.scored_methods(m), _kinds(m)).select("file_path", "method_name", "start_line", F.array_join("reasons", "; ").alias("reasons"), "tier")


@query(
    _SCORED
    + f""", g AS (SELECT file_path, count(*) AS n, any_value(helpers) AS helpers, count(*) FILTER (len(reasons) > 0) AS smells, max(loc) AS most, min(loc) AS least FROM s GROUP BY 1),
  w AS (SELECT file_path, array_to_string(list_slice(list_transform(list_sort(list(struct_pack(a := pos, f := family))), lambda x: x.f), 1, 6), '/') AS six, count(*) AS k FROM (SELECT file_path, lower(split_part(name, '_', 1)) AS family, min(start_line) AS pos FROM m GROUP BY 1, 2) GROUP BY 1),
  r AS (SELECT file_path, list_filter([CASE WHEN n > 20 AND smells >= 2 THEN n || ' methods with ' || smells || ' slop signals - file does too much' END,
    CASE WHEN n >= 3 AND smells >= 2 AND least > 0 AND most > 10 * least AND most > 100 THEN 'functions vary widely in size (' || least || '-' || most || ' lines)' END,
    CASE WHEN contains(file_path, '/client/') AND n >= 12 AND k >= 6 THEN 'file does too much across concern families (' || six || ')' END], lambda x: x IS NOT NULL) AS reasons FROM g JOIN w USING (file_path) WHERE NOT {_SURFACE})
  SELECT file_path, array_to_string(reasons, '; ') AS reasons, CASE WHEN contains(array_to_string(reasons, '; '), 'file does too much') THEN 'slop' ELSE 'kinda_slop' END AS tier FROM r WHERE len(reasons) > 0"""
)
def file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of files: sprawl, uneven sizes, too many concerns."""
    m = S.judged(_methods(spark, sf_dir))
    return scoring.file_flags(scoring.scored_methods(m), _kinds(m)).select("file_path", F.array_join("reasons", "; ").alias("reasons"), "tier")


@query(
    _SCORED
    + f""", c AS (SELECT s.*, CAST((start_line * 7) % 5 AS BIGINT) AS refs FROM s WHERE NOT {_SURFACE} AND name NOT IN ('visit', 'getData', 'walk'))
  SELECT file_path, name AS method_name, start_line, CASE WHEN refs = 0 THEN 'orphaned export (never referenced)' ELSE 'overbuilt helper (only ' || refs || ' references)' END AS reason FROM c WHERE is_exported AND (refs = 0 OR (refs <= 2 AND loc >= 5))"""
)
def reference_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported methods with few or no references."""
    every = _methods(spark, sf_dir)
    m, keys = S.judged(every), ["file_path", "name", "start_line"]
    counts = dealt(every.select(*keys, ((F.col("start_line") * 7) % 5).cast("long").alias("refs")), every.count(), *keys).groupBy(*keys).agg(F.max("refs").alias("refs"))
    return scoring.reference_flags(m, _kinds(m), counts).select("file_path", "method_name", "start_line", F.get("reasons", F.lit(0)).alias("reason"))


_GATES = ["ref_count", "scorer", "duplication", "test_coupling", "architecture", "churn", "provenance"]
_TIERS = ["slop", "kinda_slop", "clean", "unresolved"]
_FLAG_COLUMNS = ["CASE WHEN l_linenumber % 2 = 0 THEN 'method' ELSE 'file' END AS flag_type", _case("l_partkey % 7", _GATES) + " AS gate", _case("l_suppkey % 4", _TIERS) + " AS tier", "CAST(l_orderkey AS VARCHAR(20)) AS file_path"]


@query(
    f"""WITH f AS (SELECT {', '.join(_FLAG_COLUMNS)} FROM lineitem)
  SELECT (SELECT count(DISTINCT file_path) FROM f) AS files, count(*) AS methods, count(*) AS flags, count(*) FILTER (flag_type = 'method') AS method_flags, count(*) FILTER (flag_type = 'file') AS file_flags,
  {', '.join(f"count(*) FILTER (gate = '{g}') AS gate_{g}" for g in _GATES)}, {', '.join(f"count(*) FILTER (tier = '{t}') AS tier_{t}" for t in _TIERS)} FROM f"""
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").selectExpr(*_FLAG_COLUMNS)
    return scoring.run_statistics(flags, flags.select("file_path").distinct(), flags)


@query(
    """WITH m AS (SELECT CASE WHEN l_linenumber = 7 THEN 'o' || l_orderkey ELSE 'p' || l_partkey END AS file_path, CAST(l_quantity * 3 AS INT) AS loc, l_returnflag = 'N' AS e, 'p' || CAST((l_suppkey * 3 + l_linenumber) % 50 AS VARCHAR) AS target FROM lineitem),
  o AS (SELECT file_path, count(DISTINCT target) AS outbound FROM m WHERE file_path <> target GROUP BY 1), i AS (SELECT target AS file_path, count(*) AS refs FROM m WHERE file_path <> target GROUP BY 1),
  g AS (SELECT file_path, count(*) AS n, count(*) FILTER (e) AS x, max(loc) AS hi, min(loc) FILTER (loc > 0) AS lo FROM m GROUP BY 1),
  j AS (SELECT g.*, coalesce(outbound, 0) AS outbound, coalesce(refs, 0) AS refs, hi / coalesce(lo, 1) AS spread FROM g LEFT JOIN o USING (file_path) LEFT JOIN i USING (file_path))
  SELECT file_path, CASE WHEN n < 4 AND hi > 100 THEN 'module is dominated by one oversized method (' || hi || ' LOC)' ELSE array_to_string(list_filter([
    CASE WHEN outbound >= 5 AND n >= 10 AND (x >= 4 OR n >= 10) THEN 'module has broad dependency fan-out (' || outbound || ' outbound files)' END, CASE WHEN x >= 4 AND refs >= 8 THEN 'module mixes public surface and orchestration' END,
    CASE WHEN n >= 10 AND x >= 4 AND spread >= 2.5 THEN 'sprawling helper surface' END, CASE WHEN spread >= 8 AND outbound >= 3 AND n >= 6 THEN 'uneven method sizes' END], lambda y: y IS NOT NULL), '; ') END AS reasons FROM j"""
)
def arch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against modules by fan-out, surface and sizes."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_linenumber = 7 THEN 'o' || l_orderkey ELSE 'p' || l_partkey END AS file_path", "CAST(l_quantity * 3 AS INT) AS loc", "l_returnflag = 'N' AS is_exported", "'p' || (l_suppkey * 3 + l_linenumber) % 50 AS target_file")
    return A.architecture(rows, rows).select("file_path", F.array_join("reasons", "; ").alias("reasons"))


# ---- reasons

_SAID = [
    "filename is vague 'utils'",
    "thin wrapper around one call",
    "orphaned export (never referenced)",
    "function is too big (300 LOC > 100)",
    "branchy control flow (4 branches)",
    "high churn (9 commits touched this file)",
    "near-duplicate method body (91% match with a::b)",
    "one-line delegation",
    "nothing of note",
]
_ROLES = ["library", "script", "entrypoint", "adapter"]
_REASON_COLUMNS = ["conv_id", "turn", _case("conv_id % 9", _SAID) + " AS r1", _case("(turn * 5 + conv_id) % 9", _SAID) + " AS r2", _case("turn % 4", _ROLES) + " AS role"]
_HAS = {k: "regexp_matches(lower(x), '" + "|".join(v) + "')" for k, v in T.REASON_KINDS.items()}


@query(
    f"""WITH c AS (SELECT {', '.join(_REASON_COLUMNS)} FROM conversations), k AS (SELECT conv_id, turn, role, [r1, r2] AS r FROM c),
  v AS (SELECT *, list_filter(r, lambda x: NOT {_HAS['supporting_only']}) AS plain FROM k), w AS (SELECT *, list_filter(plain, lambda x: NOT {_HAS['wrapper_noise']}) AS strong FROM v)
  SELECT conv_id, turn, len(list_filter(r, lambda x: {_HAS['strong']})) > 0 AS strong, len(list_filter(r, lambda x: {_HAS['control_flow']})) > 0 AS control, len(list_filter(r, lambda x: {_HAS['filename_vague']})) > 0 AS vague,
  array_to_string(CASE WHEN role IN ('entrypoint', 'script') OR len(strong) > 0 THEN strong ELSE plain END, '; ') AS visible FROM w"""
)
def reason_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of reasons and which of them a file's role leaves visible."""
    c = read(spark, sf_dir, "conversations").selectExpr(*_REASON_COLUMNS).withColumn("r", F.array("r1", "r2"))
    has = lambda kind: F.exists("r", lambda x: T.has_reason_kind(x, kind))
    return c.select("conv_id", "turn", has("strong").alias("strong"), has("control_flow").alias("control"), has("filename_vague").alias("vague"), F.array_join(T.visible_reasons(F.col("r"), F.col("role")), "; ").alias("visible"))


@query(
    f"""WITH c AS (SELECT {', '.join(_REASON_COLUMNS)} FROM conversations), e AS (SELECT 'f' || conv_id % 50 AS file_path, unnest([r1, r2]) AS reason, unnest([1, 2]) AS severity FROM c), w AS (SELECT file_path, reason, max(severity) AS s FROM e GROUP BY 1, 2),
  t AS (SELECT file_path, array_to_string(list_transform(list_sort(list(struct_pack(s := -s, r := reason))), lambda x: x.r)[1:3], ' | ') AS top_reasons, max(s) AS worst FROM w GROUP BY 1), n AS (SELECT 'f' || conv_id % 50 AS file_path, count(*) AS n FROM c GROUP BY 1)
  SELECT file_path, 2 * n AS n_flags, 'slop' AS verdict, top_reasons FROM t JOIN n USING (file_path)"""
)
def gravest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags per file with the three gravest reasons, by severity, then text."""
    c = read(spark, sf_dir, "conversations").selectExpr(*_REASON_COLUMNS)
    one = lambda r, s: c.select(F.concat(F.lit("f"), (F.col("conv_id") % 50).cast("string")).alias("file_path"), F.lit(s).alias("severity"), F.array(r).alias("reasons"))
    return A.rolled_up(one("r1", 1).unionByName(one("r2", 2)), "file_path", "severity", "reasons").withColumn("top_reasons", F.array_join("top_reasons", " | "))


# ---- chains, journals

_SHA = "sha256('c' || conv_id || ':' || {})"


_STAGE_ERRORS = f"""WITH c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) + CASE WHEN conv_id % 7 = 3 AND turn > 2 THEN 1 ELSE 0 END AS seq, turn, conv_id % 5 = 2 AND turn = 3 AS odd, conv_id % 4 = 1 AND turn = 1 AS terminal FROM conversations),
  d AS (SELECT *, row_number() OVER w AS r, {_SHA.format("seq")} AS sha, CASE WHEN odd THEN 'x' WHEN row_number() OVER w = 1 THEN NULL ELSE {_SHA.format("lag(seq) OVER w")} END AS previous_sha, lag(terminal) OVER w AS ended, CAST((row_number() OVER w - 1) % 11 + 1 AS BIGINT) AS place, CAST((row_number() OVER w - 2) % 11 + 1 AS BIGINT) AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  e AS (SELECT *, {_SHA.format("lag(seq) OVER w")} AS real FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id AS slot, seq, CASE WHEN place = 11 THEN 'unknown stage' WHEN r <> seq THEN 'sequence is not contiguous' WHEN (CASE WHEN r = 1 THEN NULL ELSE real END) IS DISTINCT FROM previous_sha THEN 'previous hash differs' WHEN coalesce(ended, false) THEN 'event after the end'
    WHEN r > 1 AND place <> before % 11 + 1 THEN 'stage out of order' END AS error FROM e WHERE error IS NOT NULL"""


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-linked chains of stages made of conversations, some of them broken."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations", "conv_id", "turn").withColumn("r", F.row_number().over(w))
    c = c.withColumn("seq", F.col("r") + F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") > 2), 1).otherwise(0))
    sha = lambda seq: F.sha2(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), seq.cast("string")), 256)
    stages = F.array(*[F.lit(s) for s in [*J.STAGES, "a later one"]])
    chain = c.select(
        F.col("conv_id").alias("slot"),
        "seq",
        F.get(stages, ((F.col("r") - 1) % 11).cast("int")).alias("stage"),
        sha(F.col("seq")).alias("sha"),
        F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 3), "x").otherwise(sha(F.lag("seq").over(w))).alias("previous_sha"),
        ((F.col("conv_id") % 4 == 1) & (F.col("turn") == 1)).alias("terminal"),
    )
    return chain


@query(_STAGE_ERRORS)
def stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in hash-linked chains of stages."""
    return J.stage_errors(_chains(spark, sf_dir))


@query(_STAGE_ERRORS)
def streamed_stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same breaks found by a stream that is stopped after the chains' beginnings and started again for the rest."""
    chains, paths = _chains(spark, sf_dir), {name: fresh_path(spark, name) for name in ("chain-rows", "chain-errors", "chain-checkpoint")}
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.STORE)
    try:
        for part in ("seq <= 3", "seq > 3"):
            chains.where(part).write.mode("append").parquet(paths["chain-rows"])
            found = ST.stage_errors_stream(spark.readStream.schema(chains.schema).parquet(paths["chain-rows"]))
            found.writeStream.format("parquet").option("path", paths["chain-errors"]).option("checkpointLocation", paths["chain-checkpoint"]).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return spark.read.schema(found.schema).parquet(paths["chain-errors"])


@query(
    """WITH e AS (SELECT event_type AS stage, user_id AS unit, event_id AS seq, event_id % 10 = 0 AS manifest, event_id % 13 = 0 AS retry, value FROM events),
  u AS (SELECT stage, unit, arg_max(retry, seq) AS retry, sum(value) AS spent FROM e WHERE NOT manifest GROUP BY 1, 2), x AS (SELECT stage, max(CASE WHEN manifest THEN seq % 1000 END) AS expected FROM e GROUP BY 1)
  SELECT stage, any_value(expected) AS expected, count(*) FILTER (NOT retry) AS settled, count(*) FILTER (retry) AS retryable, round(sum(spent), 3) AS spent FROM x JOIN u USING (stage) GROUP BY 1"""
)
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected, settled and retryable units of each stage."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("stage"), F.col("user_id").alias("unit_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 10 == 0).alias("is_manifest"), F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 1000).alias("expected_units"), (F.col("event_id") % 13 == 0).alias("retry_on_resume"), F.col("value").alias("estimated_cost_usd"))
    return J.progress(rows).withColumn("spent", F.round("spent", 3))


# ---- predicates on literal methods and files, with rows that follow from the rules by hand

_SHAPES = ["wrapper", "delegation", "stub", "dunder", "helper", "placeholder", "comparable"]


@query(X.values("name string, wrapper boolean, delegation boolean, stub boolean, dunder boolean, helper boolean, placeholder boolean, comparable boolean", X.METHOD_SHAPES))
def method_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of literal methods: wrappers, delegations, stubs, helpers, placeholders, and what is compared for duplicates."""
    m = X.table(spark, "name string, language string, loc int, source string", X.SHAPED)
    name, source, loc = F.col("name"), F.col("source"), F.col("loc")
    found = [S.thin_wrapper(source, loc), S.thin_delegation(source, loc), S.protocol_stub(source), S.language_protocol(name, F.col("language")), S.utility_name(name), S.placeholder_stub(source, loc), S.comparable(name, source, loc, F.lit("library"))]
    return m.select("name", *[c.alias(n) for c, n in zip(found, _SHAPES, strict=True)])


@query(X.values("file_path string, kinds string, intentional_surface boolean, test_only boolean", X.MODULE_KINDS))
def module_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of literal modules."""
    files, methods = X.modules(spark)
    kinds = S.module_kinds(files, methods)
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in S.MODULE_KINDS])), ",")
    return kinds.select("file_path", named.alias("kinds"), "intentional_surface", S.test_only_file(F.col("source")).alias("test_only"))


@query(X.values("file_path string, marker string, shell boolean", X.MARKERS))
def comment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of generated code in comments only, and files that only pretend to work."""
    files = X.table(spark, "file_path string, source string", X.COMMENTED)
    return files.select("file_path", T.first_marker(S.comments(F.col("source"))).alias("marker"), S.placeholder_shell(F.col("source"), F.lit("library")).alias("shell"))


@query(X.values("gate string, file_path string, method_name string, reason string, tier string", X.COPIES))
def copied_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied and near-copied methods, and tests that repeat what they test."""
    files, methods = X.copied(spark)
    kinds = S.module_kinds(files, methods)
    rows = scoring.prepared(methods, kinds)
    found = scoring.union_flags(scoring.duplicate_flags(rows), scoring.mirror_flags(rows), scoring.provenance_flags(kinds))
    return found.select("gate", "file_path", "method_name", F.get("reasons", F.lit(0)).alias("reason"), "tier")


@query(X.values("file_path string, verdict string, top_reasons string, flagged string, advice string", X.VERDICTS))
def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of files from signals and reviews."""
    files = X.table(spark, "file_path string, role string", X.VERDICT_FILES)
    signals = X.table(spark, "file_path string, method_name string, severity int, reason string", X.VERDICT_SIGNALS)
    reviews = X.table(spark, "file_path string, complete_clean boolean", X.VERDICT_REVIEWS)
    found = scoring.file_verdicts(files, signals, reviews)
    return found.select("file_path", "verdict", F.array_join("top_reasons", " | ").alias("top_reasons"), F.array_join("flagged_methods", ",").alias("flagged"), "advice")


@query(X.values("unit_id string, tier string, pattern string, change_scope string, rule string", X.ENFORCED))
def enforced_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews after the rules on dead code, boundaries and exported contracts."""
    rows = X.table(spark, "unit_id string, tier string, pattern string, change_scope string, is_exported boolean, refs int, private_unused boolean, boundary array<string>", X.REVIEWED)
    return scoring.enforced_reviews(rows).select("unit_id", "tier", "pattern", "change_scope", "rule")


@query(X.values("file_path string, tier string, cleared boolean", X.NORMALISED))
def normalised_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File reviews with claims that the file's shape refutes set to clean."""
    files, methods = X.modules(spark)
    reviews = X.table(spark, "file_path string, tier string, reason string, evidence string", X.FILE_REVIEWS)
    return scoring.normalised_reviews(reviews, S.module_kinds(files, methods)).select("file_path", "tier", "cleared")


@query(X.values("flag_type string, file_path string, method_name string, signals string", X.SIGNAL_MAPS))
def signal_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reasons by file and by method name."""
    flags = X.table(spark, "seq int, flag_type string, file_path string, method_name string, tier string, reasons array<string>", X.SIGNAL_FLAGS)
    return scoring.signal_maps(flags).withColumn("signals", F.array_join("signals", " | "))


@query(
    X.values("file_path string, code string", X.MASKED),
)
def masked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose strings and comments are blank."""
    from ..sources import extract

    return extract.masked_files(X.table(spark, "file_path string, language string, source string", X.UNMASKED)).withColumn("code", F.regexp_replace("code", " +", " "))


# ---- symbols

@query(X.values("file_path string, name string, owner string, start_line int, end_line int, param_count int, is_exported boolean", X.METHODS))
def extracted_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of small repositories in six languages."""
    from ..sources import extract

    return extract.methods(X.repository(spark)).select("file_path", "name", "owner", "start_line", "end_line", "param_count", "is_exported")


@query(X.values("file_path string, line int, name string, target string, rule_no int", X.RESOLVED))
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of small repositories in six languages with what they mean."""
    from ..sources import extract

    files = X.repository(spark)
    found = symbols.resolve_calls(extract.symbols(files), files, "example.com/m", [("@lib/*", "ts/lib/*")])
    return found.where("target is not null").select("file_path", "line", "name", "target", "rule_no")


@query(X.values("target string, refs string", X.REFERENCES))
def call_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each definition, sorted."""
    from ..sources import extract

    files = X.repository(spark)
    found = symbols.resolve_calls(extract.symbols(files), files, "example.com/m", [("@lib/*", "ts/lib/*")])
    refs = symbols.references(found, extract.methods(files))
    return symbols.sorted_references(refs).withColumn("refs", F.array_join("refs", ","))


@query(X.values("file_path string, owner string, member string, target_file string, target_owner string", X.INHERITED))
def inherited_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that Python classes have from their bases."""
    from ..sources import extract

    files = X.table(spark, "file_path string, language string, source string", X.CLASSES)
    s = extract.symbols(files)
    wanted = X.table(spark, "file_path string, owner string, member string", X.MEMBERS)
    return symbols.inherited_methods(s, symbols.import_targets(s, files), wanted)


@query(X.values("ref_id int, file_path string, name string, start_line int", X.ALTERNATIVES))
def build_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions among which a build chooses."""
    targets = X.table(spark, "ref_id int, file_path string, name string, start_line int", X.TARGETS)
    defs = X.table(spark, "file_path string, name string, owner string, kind string, start_line int, conditional boolean", X.CONDITIONAL)
    return symbols.alternatives(targets, defs)


@query(X.values("ref_id int, target_file string, target_name string, target_line int", X.REF_TARGETS))
def reference_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by id, else by name."""
    refs = X.table(spark, "ref_id int, target_file string, target_id int, target_name string", X.REF_ROWS)
    defs = X.table(spark, "file_path string, def_id int, name string, start_line int", X.REF_DEFS)
    return symbols.reference_targets(refs, defs)


@query(X.values("name string, start_line int, parameters string, unused string, equal_branches string", X.PROVEN))
def python_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Python sources prove about their functions."""
    from ..sources import extract

    files = X.table(spark, "file_path string, language string, source string", X.PROOF_FILES)
    return extract.proofs(files).select("name", "start_line", F.array_join("parameters", ",").alias("parameters"), F.array_join("unused", ",").alias("unused"), F.array_join(F.transform("equal_branches", lambda x: x.cast("string")), ",").alias("equal_branches"))


@query(X.values("file_path string, start_line int, end_line int", X.TEST_SPANS))
def rust_test_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test code of Rust files."""
    from ..sources import extract

    return extract.test_spans(X.table(spark, "file_path string, language string, source string", X.RUST_TESTS))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^A-Za-z_$]+', ' ', 'g'), '[A-Za-z_$]+'))), ' ') AS words FROM documents")
def identifier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct identifiers of all texts; digits and letters beyond ASCII part words here."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.regexp_replace("text", "[^A-Za-z_$]+", " ").alias("text"))
    return d.select("doc_id", F.array_join(symbols.identifiers(F.col("text")), " ").alias("words"))
