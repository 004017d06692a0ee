"""Answers of reviewers as ledgers: field checks, one decision for every known case, proofs, synthesized cases, single reviews.

Answers are JSON texts. An item that breaks a rule has an ``error``, which names the first rule that it breaks; a ledger is
accepted only if none of its items has one and no known case is left out. Nothing is ever repaired or dropped here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fields of each kind of answer and their types.
_SEMANTIC = {f: "string" for f in ["tier", "pattern", "intent", "reason", "necessity_check", "contract_status", "contract_impact", "dependency_impact", "simplification", "change_scope", "behavior_status"]} | {"missing_evidence": "array", "evidence": "array"}
SCHEMAS: dict[str, dict[str, str]] = {
    "method_review": {"smelly": "boolean", "tier": "string", "evidence": "string", "reason": "string"},
    "method_intent": {"intent": "string", "contract_status": "string", "necessity_check": "string", "missing_evidence": "array"},
    "semantic_review": _SEMANTIC,
    "scoped_tier": {"tier": "string", "reason": "string"},
    "batch": {"reviews": "array"},
    "synthesis": {"cases": "array"},
    "adjudication": {"decisions": "array"},
    "proof": {"proofs": "array"},
    "file_review": {"smelly": "boolean", "tier": "string", "evidence": "string", "cohesive": "boolean", "name_accurate": "boolean", "reason": "string"},
    "role": {"role": "string", "reason": "string"},
}
# Patterns of findings.
PATTERNS = "residual_machinery duplicated_semantics parallel_reinvention ceremonial_logic needless_indirection speculative_defense band_aid_control_flow contract_fog test_mirroring test_subversion fictional_integration abandoned_compatibility responsibility_fragmentation misleading_completion unnecessary_state_complexity other".split()
TIERS = ["slop", "kinda_slop", "clean", "unresolved"]


def json_kind(value: Column) -> Column:
    """``string``, ``boolean``, ``number``, ``array``, ``object`` or ``null`` of a variant; null where there is none."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise(F.when(kind.isNotNull(), "number"))


def schema_errors(answers: DataFrame, payload: str = "payload", schema: str = "schema") -> DataFrame:
    """Adds ``missing`` and ``wrong_type``, the sorted fields that an answer of its ``schema`` lacks or has with another type, and ``error``."""
    v = F.try_parse_json(payload)
    df = answers.withColumn("__v", v)
    kinds = {f: json_kind(F.try_variant_get("__v", f"$.{f}", "variant")) for s in SCHEMAS.values() for f in s}
    df = df.withColumn("__kinds", F.struct(*[k.alias(f) for f, k in kinds.items()]))
    need = lambda s: [(f, t) for f, t in SCHEMAS[s].items()]
    none = F.array().cast("array<string>")

    def fields(test) -> Column:
        out = none
        for name in SCHEMAS:
            found = F.array_sort(F.array_compact(F.array(*[F.when(test(F.col(f"__kinds.{f}"), t), F.lit(f)) for f, t in need(name)])))
            out = F.when(F.col(schema) == name, found).otherwise(out)
        return out

    df = df.withColumn("missing", fields(lambda k, t: k.isNull())).withColumn("wrong_type", fields(lambda k, t: k.isNotNull() & (k != t)))
    is_object = json_kind(F.col("__v")) == "object"
    error = (
        F.when(~F.coalesce(is_object, F.lit(False)), "not an object")
        .when(~F.col(schema).isin(*SCHEMAS), "unknown schema")
        .when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", ")))
        .when(F.size("wrong_type") > 0, F.concat(F.lit("wrong type of "), F.array_join("wrong_type", ", ")))
    )
    blank = ~F.coalesce(is_object, F.lit(False))
    return df.withColumn("error", error).withColumn("missing", F.when(blank, none).otherwise(F.col("missing"))).withColumn("wrong_type", F.when(blank, none).otherwise(F.col("wrong_type"))).drop("__v", "__kinds")


def content_of(body: Column) -> Column:
    """The text of a provider's answer: of a chat choice, of content blocks, or of an output list; null where there is none."""
    v = F.try_parse_json(body)
    plain = F.try_variant_get(v, "$.choices[0].message.content", "string")
    pieces = lambda path: F.array_join(F.filter(F.transform(F.try_variant_get(v, path, "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string")), lambda t: t.isNotNull()), "")
    found = F.coalesce(plain, F.nullif(pieces("$.content"), F.lit("")), F.nullif(pieces("$.output[0].content"), F.lit("")), F.try_variant_get(v, "$.output_text", "string"))
    return F.nullif(F.trim(found), F.lit(""))


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _first_error(*rules: tuple[Column, str]) -> Column:
    return reduce(lambda out, rule: out.when(rule[0], rule[1]), rules[1:], F.when(*rules[0]))


def _items(answers: DataFrame, root: str, fields: str) -> DataFrame:
    """One row for each entry of an answer's array: (answer_id, item, its fields)."""
    parsed = answers.select("answer_id", F.from_json("payload", f"{root} array<struct<{fields}>>").alias("p"))
    return parsed.select("answer_id", F.posexplode(f"p.{root}").alias("item", "e")).select("answer_id", "item", "e.*")


def _with_known(items: DataFrame, known: DataFrame) -> DataFrame:
    """Marks entries whose case the answer has to decide, and entries that repeat one; ``known`` is (answer_id, case_id)."""
    marked = items.withColumn("case_id", _filled("case_id")).join(known.withColumn("known", F.lit(True)), ["answer_id", "case_id"], "left")
    again = F.row_number().over(Window.partitionBy("answer_id", "case_id").orderBy("item")) > 1
    return marked.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("again", again & F.col("case_id").isNotNull())


def _left_out(items: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    gone = known.join(items.select("answer_id", "case_id"), ["answer_id", "case_id"], "left_anti")
    return gone.select("answer_id", F.lit(None).cast("int").alias("item"), "case_id", *[F.lit(None).cast("string").alias(c) for c in columns], F.lit("omitted").alias("error"))


def adjudications(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Decisions of ``answers`` (answer_id, payload) on the cases of ``known`` (answer_id, case_id): (answer_id, item, case_id, decision, reason, merge_into, error)."""
    items = _with_known(_items(answers, "decisions", "case_id:string,decision:string,reason:string,merge_into_case_id:string"), known)
    items = items.withColumns({"decision": _filled("decision"), "reason": _filled("reason"), "merge_into": _filled("merge_into_case_id")})
    target = known.select("answer_id", F.col("case_id").alias("merge_into"), F.lit(True).alias("target_known"))
    items = items.join(target, ["answer_id", "merge_into"], "left")
    merges = F.col("decision") == "merge"
    error = _first_error(
        (F.col("case_id").isNull(), "missing case_id"),
        (~F.col("known"), "unknown case"),
        (F.col("again"), "repeated case"),
        (F.col("decision").isNull(), "missing decision"),
        (~F.col("decision").isin("keep", "discard", "unresolved", "merge"), "invalid decision"),
        (F.col("reason").isNull(), "missing reason"),
        (merges & F.col("merge_into").isNull(), "merge without target"),
        (merges & (F.col("merge_into") == F.col("case_id")), "merge into itself"),
        (merges & F.col("target_known").isNull(), "unknown merge target"),
        (~merges & F.col("merge_into").isNotNull(), "target without merge"),
    )
    out = items.select("answer_id", "item", "case_id", "decision", "reason", "merge_into", error.alias("error"))
    return out.unionByName(_left_out(items, known, ["decision", "reason", "merge_into"]))


def proofs(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Proofs of ``answers`` on the cases of ``known``: (answer_id, item, case_id, decision, reason, edits, error); edits are counted."""
    items = _with_known(_items(answers, "proofs", "case_id:string,decision:string,reason:string,edits:array<struct<file_path:string,start_line:bigint,end_line:bigint,replacement:string>>"), known)
    items = items.withColumns({"decision": _filled("decision"), "reason": _filled("reason"), "n": F.coalesce(F.size("edits"), F.lit(-1))})
    bad_edit = F.exists(F.coalesce("edits", F.array()), lambda e: F.coalesce(F.trim(e["file_path"]) == "", F.lit(True)) | F.coalesce(e["start_line"] < 1, F.lit(True)) | F.coalesce(e["end_line"] < e["start_line"], F.lit(True)) | e["replacement"].isNull())
    error = _first_error(
        (F.col("case_id").isNull(), "missing case_id"),
        (~F.col("known"), "unknown case"),
        (F.col("again"), "repeated case"),
        (F.col("decision").isNull(), "missing decision"),
        (~F.col("decision").isin("validated", "unresolved"), "invalid decision"),
        (F.col("reason").isNull(), "missing reason"),
        (F.col("n") < 0, "missing edits"),
        (bad_edit, "invalid edit"),
        ((F.col("decision") == "validated") & (F.col("n") == 0), "validated without edits"),
        ((F.col("decision") == "unresolved") & (F.col("n") > 0), "unresolved with edits"),
    )
    out = items.select("answer_id", "item", "case_id", "decision", "reason", F.when(F.col("n") >= 0, F.col("n").cast("string")).alias("edits"), error.alias("error"))
    return out.unionByName(_left_out(items, known, ["decision", "reason", "edits"]))


def synthesized(answers: DataFrame, units: DataFrame) -> DataFrame:
    """Cases over several units: (answer_id, item, case_id, tier, affected_units, error); ``units`` is (unit_id, tier, source)."""
    fields = "tier:string,pattern:string,mechanism:string,intent:string,contract_boundary:string,counterfactual:string,unresolved_assumptions:array<string>,affected_units:array<string>,evidence:array<struct<unit_id:string,quote:string>>"
    items = _items(answers, "cases", fields).withColumn("affected_units", F.array_sort(F.array_distinct("affected_units")))
    items = items.withColumn("case_id", F.concat_ws(":", F.lit("synthesis"), "pattern", F.array_join("affected_units", "|")))
    named = items.select("answer_id", "item", F.explode("affected_units").alias("unit_id")).join(units.select("unit_id", F.col("tier").alias("unit_tier")), "unit_id", "left")
    state = named.groupBy("answer_id", "item").agg(F.count_if(F.col("unit_tier").isNull()).alias("n_unknown"), F.count_if(F.col("unit_tier") == "unresolved").alias("n_open"))
    quoted = items.select("answer_id", "item", "affected_units", F.explode("evidence").alias("q")).select("answer_id", "item", "affected_units", "q.*").join(units.select("unit_id", "source"), "unit_id", "left")
    held = F.col("source").contains(F.trim(F.col("quote"))) & (F.trim(F.col("quote")) != "") & F.array_contains("affected_units", F.col("unit_id"))
    proof = quoted.groupBy("answer_id", "item").agg(F.count_if(~F.coalesce(held, F.lit(False))).alias("n_bad"))
    again = F.row_number().over(Window.partitionBy("answer_id", "case_id").orderBy("item")) > 1
    items = items.join(state, ["answer_id", "item"], "left").join(proof, ["answer_id", "item"], "left").withColumn("again", again)
    blank = lambda c: _filled(c).isNull()
    error = _first_error(
        (~F.coalesce(F.col("tier").isin("slop", "kinda_slop"), F.lit(False)), "tier is no finding"),
        (~F.coalesce(F.col("pattern").isin(*PATTERNS), F.lit(False)), "unknown pattern"),
        (blank("mechanism") | blank("intent") | blank("contract_boundary") | blank("counterfactual"), "missing text"),
        (F.col("unresolved_assumptions").isNull(), "missing assumptions"),
        (F.size("unresolved_assumptions") > 0, "open assumptions"),
        (F.coalesce(F.size("affected_units"), F.lit(0)) < 2, "fewer than two units"),
        (F.col("n_unknown") > 0, "unknown unit"),
        (F.col("n_open") > 0, "unresolved unit"),
        (F.coalesce(F.size("evidence"), F.lit(0)) < 1, "missing evidence"),
        (F.col("n_bad") > 0, "evidence is not in its unit"),
        (F.col("again"), "repeated case"),
    )
    return items.select("answer_id", "item", "case_id", "tier", F.array_join("affected_units", "|").alias("affected_units"), error.alias("error"))


REVIEW = "tier string, pattern string, intent string, reason string, necessity_check string, contract_status string, contract_impact string, dependency_impact string, simplification string, change_scope string, behavior_status string, missing_evidence array<string>, evidence array<struct<start_line:bigint,end_line:bigint,quote:string>>"


def semantic_reviews(answers: DataFrame) -> DataFrame:
    """Single reviews of ``answers`` (answer_id, payload): (answer_id, tier, pattern, behavior_status, n_evidence, error) by the contracts of each tier."""
    r = answers.select("answer_id", F.from_json("payload", REVIEW).alias("r")).select("answer_id", "r.*")
    texts = ["pattern", "intent", "necessity_check", "contract_status", "contract_impact", "dependency_impact", "change_scope", "behavior_status"]
    r = r.withColumns({c: F.coalesce(F.trim(c), F.lit("")) for c in [*texts, "reason", "simplification"]})
    clean, unresolved, finding = F.col("tier") == "clean", F.col("tier") == "unresolved", F.col("tier").isin("slop", "kinda_slop")
    behavior = F.when(clean & (F.col("behavior_status") == "known"), "preserved").otherwise(F.col("behavior_status"))
    r = r.withColumn("behavior_status", behavior)
    n_missing, n_evidence = F.size("missing_evidence"), F.coalesce(F.size("evidence"), F.lit(0))
    uncertain = F.lower(F.concat_ws(" ", "necessity_check", "contract_impact", "dependency_impact")).rlike("cannot be (determined|verified)|not (provided|visible|available)|insufficient evidence|unknown whether")
    bad_span = F.exists(F.coalesce("evidence", F.array()), lambda e: F.coalesce(e["start_line"] < 1, F.lit(True)) | F.coalesce(e["end_line"] < e["start_line"], F.lit(True)) | F.coalesce(F.trim(e["quote"]) == "", F.lit(True)))
    error = _first_error(
        (F.col("tier").isNull(), "missing tier"),
        (~F.col("tier").isin(*TIERS), "invalid tier"),
        (reduce(lambda a, b: a | b, [F.col(c) == "" for c in texts]), "missing text"),
        (~F.col("pattern").isin("none", *PATTERNS), "unknown pattern"),
        (~F.col("behavior_status").isin("preserved", "unknown"), "invalid behavior"),
        (~F.col("contract_status").isin("required", "unnecessary", "unknown"), "invalid contract"),
        (F.col("missing_evidence").isNull() | F.exists(F.coalesce("missing_evidence", F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), "invalid missing_evidence"),
        (finding != (F.col("pattern") != "none"), "pattern does not suit the tier"),
        (clean & ((F.col("contract_status") != "required") | (F.col("behavior_status") != "preserved") | (F.col("change_scope") != "none") | (F.col("simplification") != "none") | (n_missing > 0) | uncertain), "clean without proof"),
        (unresolved & ((n_missing == 0) | (F.col("contract_status") != "unknown") | (F.col("behavior_status") != "unknown") | (F.col("simplification") != "none") | (F.col("change_scope") != "none") | (F.col("reason") == "")), "unresolved without cause"),
        (finding & ~F.col("change_scope").isin("local", "signature", "whole_method"), "invalid scope"),
        (finding & ((F.col("contract_status") != "unnecessary") | (F.col("behavior_status") != "preserved") | F.col("simplification").isin("", "none") | (n_missing > 0) | (F.col("reason") == "") | uncertain), "finding without proof"),
        (finding & (n_evidence == 0), "finding without evidence"),
        (bad_span, "invalid evidence"),
    )
    return r.select("answer_id", "tier", "pattern", "behavior_status", n_evidence.alias("n_evidence"), error.alias("error"))


def accepted(ledger: DataFrame) -> DataFrame:
    """Each answer with its verdict: accepted where no entry has an error, else its first error."""
    first = F.min_by("error", F.struct(F.coalesce("item", F.lit((1 << 31) - 1)), "error"))
    bad = ledger.where("error is not null").groupBy("answer_id").agg(first.alias("error"), F.count("*").alias("n_errors"))
    return ledger.select("answer_id").distinct().join(bad, "answer_id", "left").select("answer_id", F.col("error").isNull().alias("accepted"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "error")


def quote_location(source: Column, first_line: Column, start: Column, end: Column, quote: Column) -> Column:
    """Where a quote stands in a method's source: struct (start, end, how).

    It is exact where the declared lines hold it, whatever their white space; else the only place of the text
    itself, or the only place without regard to white space; else ``ambiguous`` or ``absent`` without lines.
    """
    from ..functions.text import lines, line_window

    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    own = F.trim(quote)
    last = first_line + F.size(lines(source)) - 1
    span = line_window(source, start - first_line + 1, end - first_line + 1)
    exact = (start >= first_line) & (end >= start) & (end <= last) & (own != "") & (F.contains(span, own) | F.contains(bare(span), bare(own)))
    ends = lambda text: F.size(F.split(text, "\n")) - 1
    n = F.size(F.split(source, F.concat(F.lit(r"\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)) - 1
    before = F.split_part(source, quote, F.lit(1))
    # without white space: the line of each character that is left, as the lengths of the lines before it
    kept = F.transform(lines(source), bare)
    total = F.transform(F.sequence(F.lit(1), F.size(kept)), lambda k: F.length(F.array_join(F.slice(kept, 1, k), "")))
    joined, needle = F.array_join(kept, ""), bare(quote)
    at = F.instr(joined, needle)
    again = F.instr(F.substr(joined, at + 1), needle)
    line_of = lambda place: first_line + F.size(F.filter(total, lambda t: t < place))
    found = lambda a, b, how: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(how).alias("how"))
    nowhere = lambda how: found(F.lit(None), F.lit(None), how)
    return (
        F.when(exact, found(start, end, "declared"))
        .when((own != "") & (n == 1), found(first_line + ends(before), first_line + ends(before) + ends(quote), "unique"))
        .when((own != "") & (n > 1), nowhere("ambiguous"))
        .when((needle != "") & (at > 0) & (again == 0), found(line_of(at), line_of(at + F.length(needle) - 1), "unique without spaces"))
        .when((needle != "") & (at > 0), nowhere("ambiguous"))
        .otherwise(nowhere("absent"))
    )
