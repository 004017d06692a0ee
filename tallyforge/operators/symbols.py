"""Resolution of calls to definitions in six languages, and what follows from it: references, callers, alternatives, counts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import lexical_path, line_window
from ..storage import written
from .joins import cascade, enclosing_interval

SCRIPTS = ["ts", "js", "tsx", "jsx", "mjs", "cjs"]


def parent(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def python_candidates() -> Column:
    """Files that an import's module may be: relative to its folder by dots, else below the root and below src."""
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    inner = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.split("file_path", "/")
    package = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    root = F.when(dots > 0, package).otherwise(F.lit(""))
    whole = F.ltrim(F.concat(root, F.when((root != "") & (inner != ""), "/").otherwise(""), inner), F.lit("/"))
    joined = F.concat(whole, F.when(whole != "", "/").otherwise(""))
    return F.array(F.concat(whole, F.lit(".py")), F.concat(joined, "imported", F.lit(".py")), F.concat(joined, F.lit("__init__.py")), F.concat(F.lit("src/"), whole, F.lit(".py")), F.concat(F.lit("src/"), joined, F.lit("__init__.py")))


def script_candidates(path: Column) -> Column:
    """Files that a script's path may be: itself, with an extension, with another one, an index in the folder."""
    bare = F.regexp_replace(path, rf"\.({'|'.join(SCRIPTS)})$", "")
    with_ = lambda base, ends: [F.concat(base, F.lit(e)) for e in ends]
    return F.array(path, *with_(path, [f".{e}" for e in SCRIPTS]), *with_(bare, [f".{e}" for e in SCRIPTS]), *with_(path, [f"/index.{e}" for e in SCRIPTS[:4]]))


def aliased(module: Column, aliases: list[tuple[str, str]]) -> Column:
    """A module's path by the first alias ``(pattern, target)`` that fits, null where none does; a star stands for the same text on both sides."""
    out = F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        if "*" in pattern:
            head, tail = pattern.split("*", 1)
            held = F.regexp_extract(module, f"^{re.escape(head)}(.*){re.escape(tail)}$", 1)
            fits = module.rlike(f"^{re.escape(head)}.*{re.escape(tail)}$")
            new = F.concat(*[x for k, piece in enumerate(target.split("*", 1)) for x in ([held] if k else []) + [F.lit(piece)]])
        else:
            fits, new = module == pattern, F.lit(target)
        out = F.when(fits, new).otherwise(out)
    return out


def plain_json(text: str) -> dict:
    """Settings in JSON with comments and last commas."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def path_aliases(settings: str, base: str = "") -> list[tuple[str, str]]:
    """Aliases of a compiler's settings file, longest pattern first, with targets below its base folder."""
    options = plain_json(settings).get("compilerOptions", {})
    root = "/".join(x for x in (base.strip("/"), options.get("baseUrl", ".").strip("./")) if x)
    found = [(p, f"{root}/{t[0].removeprefix('./')}".lstrip("/")) for p, t in options.get("paths", {}).items() if t]
    return sorted(found, key=lambda x: (-len(x[0].split("*")[0]), x[0]))


def rust_module(path: Column) -> Column:
    """The path of modules from the crate's root by which a Rust file goes, slashes between them."""
    return F.regexp_replace(F.regexp_replace(path, r"^(?:.*/)?src/", ""), r"(^|/)(?:main|lib|mod)\.rs$|\.rs$", "")


def import_targets(symbols: DataFrame, files: DataFrame, go_module: str = "", aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Imports with the file they mean, the first candidate that exists: (file_path, language, local, imported, target_file).

    A Go import means a folder, whose files are all named; a Kotlin import means the files of its package.
    """
    known = files.select(F.col("file_path").alias("candidate"))
    imports = symbols.where("kind = 'import'").select("file_path", "language", F.col("name").alias("local"), "module", "imported", "line")
    keys = ["file_path", "language", "local", "module", "imported", "line"]
    folder = parent(F.col("file_path"))
    relative = F.col("module").startswith(".")
    script = F.when(relative, lexical_path(F.concat_ws("/", folder, "module"))).otherwise(aliased(F.col("module"), list(aliases)))
    # crate, self and super lead from a Rust file's place in the tree of modules
    own = rust_module(F.col("file_path"))
    module = F.translate(F.replace("module", F.lit("::"), F.lit("/")), " ", "")
    ups = F.size(F.filter(F.split(module, "/"), lambda x: x == "super"))
    above = F.array_join(F.slice(F.split(own, "/"), 1, F.greatest(F.size(F.split(own, "/")) - ups, F.lit(0))), "/")
    tail = F.regexp_replace(module, r"^(?:crate|self|super)(?:/(?:super))*/?", "")
    led = F.when(module.rlike("^crate(/|$)"), tail).when(module.rlike("^self(/|$)"), F.concat_ws("/", own, tail)).when(module.rlike("^super(/|$)"), F.concat_ws("/", above, tail)).otherwise(module)
    rust = F.regexp_replace(F.regexp_replace(led, "/+", "/"), "^/|/$", "")
    source_root = F.regexp_extract("file_path", r"^((?:.*/)?src/|)", 1)
    in_tree = lambda p: [F.concat(source_root, p, F.lit(".rs")), F.concat(source_root, p, F.lit("/mod.rs"))]
    rust_files = F.array(*in_tree(F.concat_ws("/", F.nullif(rust, F.lit("")), "imported")), *in_tree(rust), F.concat(source_root, F.lit("lib.rs")), F.concat(source_root, F.lit("main.rs")))
    options = F.when(F.col("language") == "python", python_candidates()).when(F.col("language").isin("javascript", "typescript"), script_candidates(script)).when(F.col("language") == "rust", rust_files)
    each = imports.where(options.isNotNull()).select(*keys, F.posexplode(options).alias("k", "candidate")).where("candidate is not null and candidate <> ''")
    placed = each.join(known, "candidate").groupBy(*keys).agg(F.min_by("candidate", "k").alias("target_file"))
    inside = F.regexp_replace("module", "^" + re.escape(go_module) + "/?", "") if go_module else F.col("module")
    go = imports.where("language = 'go'").withColumn("folder", inside)
    in_folder = files.where("language = 'go'").select(F.col("file_path").alias("target_file"), parent(F.col("file_path")).alias("folder"))
    go = go.join(in_folder, "folder").select(*keys, "target_file")
    packages = symbols.where("kind = 'package' and language = 'kotlin'").select("module", F.col("file_path").alias("target_file")).distinct()
    kotlin = imports.where("language = 'kotlin'").join(packages, "module").select(*keys, "target_file")
    return placed.select(*keys, "target_file").unionByName(go).unionByName(kotlin).select("file_path", "language", "local", "imported", "target_file").distinct()


def resolve_calls(symbols: DataFrame, files: DataFrame, go_module: str = "", aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Calls with their target ``file::name`` by the first rule that holds.

    The rules in their order: a definition of the file itself, also through ``self`` and ``this``; an imported name; a member of an
    imported module; another file of a Go folder or Kotlin package; a Rust path; the only definition of that name in the language.
    """
    calls = symbols.where("kind = 'call'").select(F.concat_ws(":", "file_path", "line", F.coalesce("owner", F.lit("")), "name").alias("call_id"), "file_path", "language", "name", "line", "owner", "is_member").distinct()
    calls = written(calls, "calls")
    defs = written(symbols.where("kind in ('function', 'class')").select("file_path", "language", "name", F.col("owner").alias("def_owner")).distinct(), "definitions")
    imports = written(import_targets(symbols, files, go_module, aliases), "imports")
    target = lambda file, name: F.concat_ws("::", file, name)
    free, plain = F.col("is_member") == F.lit(False), defs.select("file_path", "name").distinct()
    itself = F.coalesce(F.col("owner").isin("self", "this", "cls", "Self"), F.lit(False))
    same = calls.where(free | itself).join(plain, ["file_path", "name"]).select("call_id", target("file_path", "name").alias("target"))
    wanted = plain.select(F.col("file_path").alias("target_file"), F.col("name").alias("target_name"))
    from_ = imports.select(F.col("file_path").alias("from_file"), "local", "imported", "target_file")
    named = calls.where(free).join(from_, (F.col("file_path") == F.col("from_file")) & ((F.col("name") == F.col("local")) | (F.col("local") == "*")))
    named = named.withColumn("target_name", F.when(F.col("imported").isin("*", "default") | F.col("imported").isNull(), F.col("name")).otherwise(F.col("imported"))).join(wanted, ["target_file", "target_name"]).select("call_id", target("target_file", "target_name").alias("target"))
    through = calls.where(~free).join(from_, (F.col("file_path") == F.col("from_file")) & (F.regexp_extract("owner", r"([\w$]+)$", 1) == F.col("local"))).withColumn("target_name", F.col("name")).join(wanted, ["target_file", "target_name"]).select("call_id", target("target_file", "target_name").alias("target"))
    package = symbols.where("kind = 'package'").select("file_path", "module", "language").distinct()
    group = package.select("file_path", F.when(F.col("language") == "go", F.concat(parent(F.col("file_path")), F.lit(":"), "module")).otherwise(F.col("module")).alias("group"))
    members = group.join(plain, "file_path").select("group", "name", F.col("file_path").alias("target_file"))
    near = calls.where(free & F.col("language").isin("go", "kotlin")).join(group, "file_path").join(members, ["group", "name"]).select("call_id", target("target_file", "name").alias("target"))
    trees = files.where("language = 'rust'").select(F.col("file_path").alias("target_file"), rust_module(F.col("file_path")).alias("tree"))
    placed = symbols.where("kind = 'module'").select(lexical_path(F.concat_ws("/", F.nullif(parent(F.col("file_path")), F.lit("")), "module")).alias("target_file"), F.concat_ws("/", F.nullif(rust_module(F.col("file_path")), F.lit("")), "name").alias("tree")).where(F.col("target_file").endswith(".rs"))
    trees = trees.unionByName(placed).distinct()
    path = F.regexp_replace(F.replace("owner", F.lit("::"), F.lit("/")), "^(?:crate|self|super)/", "")
    qualified = calls.where((F.col("language") == "rust") & F.col("owner").contains("::")).withColumn("tree", path).join(trees, "tree").withColumn("target_name", F.col("name")).join(wanted, ["target_file", "target_name"]).select("call_id", target("target_file", "target_name").alias("target"))
    unique = defs.groupBy("language", "name").agg(F.count_distinct("file_path").alias("n"), F.min("file_path").alias("f")).where("n = 1")
    only = calls.join(unique, ["language", "name"]).select("call_id", target("f", "name").alias("target"))
    return cascade(calls, "call_id", [same, named, through, near, qualified, only])


def inherited_methods(symbols: DataFrame, imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members that a class has from its bases: (file_path, owner, member, target_file, target_owner), the first in the order of a depth-first walk over the bases.

    ``wanted`` is (file_path, owner, member). A class is entered once on each way, so cycles end; the walk goes on while a way is open.
    """
    bases = symbols.where("kind = 'base'").select("file_path", F.col("name").alias("cls"), F.col("imported").alias("base"), F.col("owner").cast("int").alias("place"))
    from_ = imports.select("file_path", F.col("local").alias("base"), "imported", "target_file")
    up = bases.join(from_, ["file_path", "base"], "left").select("file_path", "cls", "place", F.coalesce("target_file", "file_path").alias("to_file"), F.coalesce("imported", "base").alias("to_cls"))
    up = written(up, "bases")
    members = symbols.where("kind = 'function' and owner is not null").select(F.col("file_path").alias("to_file"), F.col("owner").alias("to_cls"), F.col("name").alias("member")).distinct()
    node = lambda f, c: F.concat_ws("::", f, c)
    front = wanted.select("file_path", "owner", "member", F.col("file_path").alias("at_file"), F.col("owner").alias("at_cls"), F.array().cast("array<int>").alias("way"), F.array(node("file_path", "owner")).alias("seen"))
    hits = None
    while True:
        step = front.join(up, (F.col("at_file") == up["file_path"]) & (F.col("at_cls") == F.col("cls"))).where(~F.array_contains("seen", node("to_file", "to_cls")))
        step = step.select(front["file_path"], "owner", "member", "to_file", "to_cls", F.array_append("way", F.col("place")).alias("way"), F.array_append("seen", node("to_file", "to_cls")).alias("seen"))
        step = written(step, "bases-step")
        if not step.take(1):
            break
        found = step.join(members, ["to_file", "to_cls", "member"]).select("file_path", "owner", "member", "to_file", "to_cls", "way")
        hits = found if hits is None else hits.unionByName(found)
        front = step.select("file_path", "owner", "member", F.col("to_file").alias("at_file"), F.col("to_cls").alias("at_cls"), "way", "seen")
    if hits is None:
        return wanted.limit(0).select("file_path", "owner", "member", F.col("file_path").alias("target_file"), F.col("owner").alias("target_owner"))
    best = hits.groupBy("file_path", "owner", "member").agg(F.min_by(F.struct("to_file", "to_cls"), "way").alias("b"))
    return best.select("file_path", "owner", "member", F.col("b.to_file").alias("target_file"), F.col("b.to_cls").alias("target_owner"))


def reference_targets(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References with the definition they mean: by its id in its file, else by its name there: (ref_id, target_file, target_name, target_line).

    ``references`` is (ref_id, target_file, target_id or null, target_name), ``definitions`` is (file_path, def_id, name, start_line).
    """
    by_id = definitions.select(F.col("file_path").alias("target_file"), F.col("def_id").alias("target_id"), F.struct("name", "start_line").alias("i"))
    by_name = definitions.groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("target_name")).agg(F.min_by(F.struct("name", "start_line"), "def_id").alias("n"))
    both = references.join(by_id, ["target_file", "target_id"], "left").join(by_name, ["target_file", "target_name"], "left")
    hit = F.coalesce("i", "n")
    return both.select("ref_id", F.when(hit.isNotNull(), F.col("target_file")).alias("target_file"), hit["name"].alias("target_name"), hit["start_line"].alias("target_line"))


def alternatives(targets: DataFrame, definitions: DataFrame) -> DataFrame:
    """Targets with all definitions that a build may choose in their place: (ref_id, file_path, name, start_line).

    ``definitions`` is (file_path, name, owner, kind, start_line, conditional): in Rust those of the same file that are under
    a condition, in Go those of the same folder in files with a build tag. Fewer than two leave the target as it is.
    """
    group = F.when(F.col("file_path").endswith(".rs"), F.col("file_path")).when(F.col("file_path").endswith(".go"), parent(F.col("file_path")))
    d = definitions.withColumn("group", group).withColumn("owner", F.coalesce("owner", F.lit("")))
    own = targets.join(d, ["file_path", "name", "start_line"]).select("ref_id", "group", "name", "owner", "kind").where("group is not null")
    options = d.where("conditional").select("group", "name", "owner", "kind", "file_path", "start_line")
    found = own.join(options, ["group", "name", "owner", "kind"]).withColumn("n", F.count("*").over(Window.partitionBy("ref_id"))).where("n > 1").select("ref_id", "file_path", "name", "start_line")
    rest = targets.join(found.select("ref_id").distinct(), "ref_id", "left_anti").select("ref_id", "file_path", "name", "start_line")
    return found.unionByName(rest)


def references(resolved: DataFrame, methods: DataFrame) -> DataFrame:
    """Each resolved call with the innermost method around it, one for a caller's file and line; calls on a definition's own first line are none."""
    spans = methods.select("file_path", F.col("name").alias("caller"), "start_line", "end_line")
    hits = enclosing_interval(resolved.where("target is not null").withColumnRenamed("call_id", "point_id"), spans, ["file_path"], "line", "start_line", "end_line", ["caller"])
    m = methods.select(F.concat_ws("::", "file_path", "name").alias("target"), F.col("file_path").alias("own_file"), F.col("start_line").alias("own_line")).distinct()
    own = hits.join(m, "target", "left").where((F.col("own_file") == F.col("file_path")) & (F.col("own_line") == F.col("line"))).select("point_id")
    kept = hits.join(own, "point_id", "left_anti")
    return kept.withColumn("lower_file", F.lower("file_path")).dropDuplicates(["target", "lower_file", "line"]).drop("lower_file")


def sorted_references(refs: DataFrame) -> DataFrame:
    """References of each target in the order of their files without regard to case, then lines: (target, refs)."""
    entry = F.struct(F.lower("file_path").alias("key"), "line", "file_path")
    return refs.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["file_path"], x["line"].cast("string"))).alias("refs"))


def caller_context(refs: DataFrame, files: DataFrame, methods: DataFrame) -> DataFrame:
    """The lines around each call, one for a target's file and line: (target, file_path, line, caller, context).

    Inside a method these are the three lines before the call and the six after it, as far as the method goes; outside one, four and five.
    """
    one = refs.groupBy("target", "file_path", "line").agg(F.min("caller").alias("caller"))
    spans = methods.groupBy("file_path", F.col("name").alias("caller")).agg(F.min("start_line").alias("start"), F.max("end_line").alias("end"))
    both = one.join(spans, ["file_path", "caller"], "left").join(files.select("file_path", "source"), "file_path")
    line = F.col("line")
    first = F.when(F.col("start").isNotNull(), F.greatest(line - 3, F.col("start"))).otherwise(F.greatest(line - 4, F.lit(1)))
    last = F.when(F.col("end").isNotNull(), F.least(line + 6, F.col("end"))).otherwise(line + 5)
    return both.select("target", "file_path", "line", "caller", line_window(F.col("source"), first, last).alias("context"))


def reference_counts(refs: DataFrame, methods: DataFrame) -> DataFrame:
    """How many places refer to each method: (file_path, name, start_line, refs)."""
    n = refs.groupBy("target").agg(F.count("*").alias("refs"))
    m = methods.select("file_path", "name", "start_line").withColumn("target", F.concat_ws("::", "file_path", "name"))
    return m.join(n, "target", "left").select("file_path", "name", "start_line", F.coalesce("refs", F.lit(0)).alias("refs"))


def names_identifier(source: Column, name: str) -> Column:
    """Whether a text holds a name as a whole identifier."""
    return source.rlike(rf"(?<![\w$]){re.escape(name)}(?![\w$])")


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a text, sorted; a name occurs as a whole word exactly if it is one of them."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w$])[A-Za-z_$][\w$]*"), F.lit(0))))

