"""Text and path functions as columns: lines, paths, names, tokens, shingles, markers, credentials."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def lines(source: Column) -> Column:
    """Lines without their ends; one CR before an end goes too, and a final line end opens no line."""
    split = F.split(source, "\n")
    cut = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))).otherwise(split)
    return F.transform(cut, lambda x: F.regexp_replace(x, "\r$", ""))


def normal_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def lexical_path(path: Column) -> Column:
    """Drops empty and ``.`` parts and lets ``..`` take back the part before it; leading ``..`` stay in relative paths."""
    clean = F.translate(path, "\\", "/")
    rooted = clean.startswith("/")
    parts = F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        back = (part == "..") & (F.size(done) > 0) & (last != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((part == "..") & rooted, done).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".\.([^.]*)$", 1)


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def any_of(column: Column, needles: list[str]) -> Column:
    """True if the text holds one of the needles."""
    return reduce(lambda a, b: a | b, [column.contains(n) for n in needles])


# Path parts and names by which files take their role, in the order of the tests.
ROLE_PATTERNS = {
    "example": r"/examples?/|^examples(/|$)",
    "fixture": r"/(fixtures|gold_fixtures|fixture)/|^(fixtures|gold_fixtures)(/|$)",
    "script": r"/scripts?/|^scripts(/|$)",
    "test": r"/(tests|commontest|androidtest|iostest|jvmtest)/|^tests(/|$)|(_test\.rs|\.test\.ts|\.test\.js|\.spec\.ts|\.spec\.js|_spec\.rs)$",
    "docs": r"/docs?/|^docs(/|$)",
    "generated": r"/(generated|gen)/|^generated(/|$)|\.generated\.[^/]*$|(^|/)generated(\.[^/]*)?$|\.pyi$",
    "entrypoint": r"(^|/)([^/]*_)?cli\.(rs|py|ts|js|go)$|(^|/)main\.(rs|py|ts|tsx|jsx|js|go)$|/__main__\.(py|rs|ts|tsx|jsx|js)$|(^|/)workers?/src/(.*/)?index\.(ts|js)$|(supabase|netlify|vercel)/functions/(.*/)?index\.(ts|tsx|js|jsx|py|rs|go|kt)$",
    "adapter": r"/(adapters?|integrations?|bridges?|gateways?|clients?|transport|http|api|grpc|rpc|connectors?)/|\.config\.(js|jsx|ts|tsx)$|(adapter|bridge|gateway|client|transport|integration|http|api|grpc|rpc|connector)[^/]*$",
    "library": "/",
}
ROLE_LABELS = {"entrypoint": "cli_entrypoint", "script": "cli_entrypoint", "example": "example", "fixture": "example", "test": "test", "docs": "docs", "generated": "generated", "adapter": "adapter_integration", "library": "core_library", "mixed": "mixed"}


def role(path: Column) -> Column:
    """Role of a file by its path; the first test that holds decides, ``mixed`` if none does."""
    p, out = normal_path(path), None
    for kind, pattern in ROLE_PATTERNS.items():
        out = F.when(p.rlike(pattern), kind) if out is None else out.when(p.rlike(pattern), kind)
    return out.otherwise("mixed")


def role_label(of: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair])[of]


def is_test_file(path: Column) -> Column:
    """The walker's test rule: by name, or any path part that starts with ``test``."""
    p = normal_path(path)
    name = file_name(p)
    return name.startswith("test_") | name.contains("_test.") | name.contains(".test.") | name.contains(".spec.") | F.exists(F.split(p, "/"), lambda x: x.startswith("test"))


def has_component(path: Column, ignored: list[str]) -> Column:
    return F.arrays_overlap(F.split(normal_path(path), "/"), F.array(*[F.lit(i.lower()) for i in ignored]))


# Languages by file extension.
LANGUAGE_BY_EXTENSION = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "kt": "kotlin", "kts": "kotlin", "py": "python", "go": "go", "rs": "rust"}


def language_of(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])[F.lower(file_extension(path))]


def safe_relative(path: Column) -> Column:
    """No absolute path, drive prefix, empty path or ``..`` part."""
    return ~path.rlike(r"^$|^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def repository_identity(url: Column) -> Column:
    """``owner/name`` in lower case from a repository address, null for anything else."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^(https?://)?(www\.)?github\.com/|/+$|\.git/*$", "")
    return F.when(bare.rlike(r"^[a-z0-9][a-z0-9_.-]*/[a-z0-9_.-]+$"), bare)


def revision(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^[0-9a-f]{40}$"), low)


def snake_case(name: Column) -> Column:
    """Camel case to snake case, in lower case."""
    split = F.regexp_replace(name, r"(?<=[^_])(?=\p{Lu}\p{Ll})", "_")
    split = F.regexp_replace(split, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", "_")
    return F.lower(split)


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(name, "[^A-Za-z0-9]"), lambda x: x != "")


def matches_name(name: Column, patterns: list[str]) -> Column:
    """``*`` at a pattern's end or start stands for any text."""

    def one(p: str) -> Column:
        return name.startswith(p[:-1]) if p.endswith("*") else name.endswith(p[1:]) if p.startswith("*") else name == p

    return reduce(lambda a, b: a | b, [one(p) for p in patterns]) if patterns else F.lit(False)


def is_generic_name(name: Column, generic: list[str], allowed: list[str] = ()) -> Column:
    return bound(snake_case(name), lambda snake: ~matches_name(snake, list(allowed)) & matches_name(snake, generic) & (F.size(name_tokens(snake)) <= 2))


#: Fixed value: the tokens of source code in the order in which they are tried.
TOKEN = (
    r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|#[^\n]*"
    r"|\"(?:\\.|[^\"\\])*(?:\"|\\?\z)|'(?:\\.|[^'\\])*(?:'|\\?\z)|`(?:\\.|[^`\\])*(?:`|\\?\z)"
    r"|[0-9][0-9A-Za-z._]*|[\p{L}_][\p{L}\p{N}_]*"
    r"|=>|==|!=|<=|>=|&&|\|\||::|->|\+=|-=|\*=|/=|\?\?|\?\.|\S"
)


def code_tokens(source: Column) -> Column:
    """Tokens with comments dropped and strings, numbers and words replaced by their class."""
    found = F.filter(F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0)), lambda t: ~(t.startswith("//") | t.startswith("/*") | t.startswith("#")))

    def kind(t: Column) -> Column:
        c = F.substring(t, 1, 1)
        word = c.between("a", "z") | c.between("A", "Z") | (c == "_") | ((F.ascii(c) > 127) & c.rlike(r"^\p{L}"))
        return F.when(word, "ID").when(c.isin('"', "'", "`"), "STR").when(c.between("0", "9"), "NUM").otherwise(t)

    return F.transform(found, kind)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a filter's condition takes the expression in."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens; a shorter text is one shingle, an empty one has none."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))))

    return bound(tokens, runs)


# Line starts that count as branches and loops.
BRANCHES = ["if ", "if(", "elif ", "else if ", "match ", "switch ", "case ", "when "]
LOOPS = ["for ", "for(", "while ", "while(", "loop ", "do "]


def filled_lines(source: Column) -> Column:
    """The number of lines that hold more than spaces."""
    return F.size(F.filter(lines(source), lambda x: F.trim(x) != ""))


def count_line_starts(source: Column, starts: list[str]) -> Column:
    """Lines that begin, after spaces, with one of the texts; one pass over the source."""
    return F.regexp_count(source, F.lit(r"(?:^|\n) *+(?:" + "|".join(re.escape(s).replace(r"\ ", " ") for s in starts) + ")"))


# Marks of generated or copied code, in order.
PROVENANCE = ["generated by", "auto-generated", "autogenerated", "do not edit", "copied from", "machine generated", "generated automatically", "ai-generated"]


def first_marker(text: Column, markers: list[str] = PROVENANCE) -> Column:
    low = F.lower(text)
    return F.get(F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m)), F.lit(0))


# Token prefixes with their kind and least number of further characters.
SECRET_PREFIXES = [("ghp_", "GitHub token", 20), ("gho_", "GitHub OAuth token", 20), ("github_pat_", "GitHub fine-grained token", 20), ("xoxb-", "Slack bot token", 20), ("xoxp-", "Slack user token", 20), ("AIza", "Google API key", 35), ("AKIA", "AWS access key", 16)]
SECRET_NAMES = "api_key|apikey|secret|password|access_token|auth_token"


def secret_kind(line: Column) -> Column:
    """Kind of credential that a line shows, else null; values are never returned."""
    trimmed = F.trim(line)
    out = F.when(trimmed.contains("-----BEGIN ") & trimmed.contains(" PRIVATE KEY-----"), "private key")
    for prefix, kind, least in SECRET_PREFIXES:
        out = out.when(line.rlike(f"(^|[^A-Za-z0-9_-]){prefix}[A-Za-z0-9_-]{{{least},}}"), kind)
    value = F.trim(F.coalesce(F.get(F.split(trimmed, "[=:]"), F.lit(1)), F.lit("")))
    from_environment = F.lower(value).contains("environ") | F.lower(value).contains("process.env") | value.contains("$")
    named = F.lower(trimmed).rlike(SECRET_NAMES) & trimmed.rlike("[=:]") & trimmed.rlike("[\"']")
    long_enough = F.octet_length(F.btrim(value, F.lit("\"',;"))) >= 20
    return out.when(named & ~from_environment & long_enough, "credential-like assignment")


def may_hold_secret(text: Column) -> Column:
    """A quick necessary test: a mark of a key, a token prefix or a credential's name."""
    return text.rlike("PRIVATE KEY-----|" + "|".join(p for p, _, _ in SECRET_PREFIXES) + f"|(?i:{SECRET_NAMES})")


def require_no_secrets(found: DataFrame, most: int = 8) -> None:
    """Raises with the places of credentials ``(file_path, line_no, kind)``, never their values."""
    bad = found.orderBy("file_path", "line_no").limit(most).collect()
    if bad:
        raise ValueError("credentials: " + "; ".join(f"{r['file_path']}:{r['line_no']} {r['kind']}" for r in bad))


# Words by which a reason has its kind.
REASON_KINDS = {
    "supporting_only": ["orphaned export", "overbuilt helper", "copy-pasted method body", "duplicate method body", "test mirrors production implementation", "architecture sprawl", "high churn", "generated-style marker present"],
    "wrapper_noise": ["trivial delegation wrapper", "thin wrapper", "trivial wrapper", "tiny wrapper", "unnecessary indirection", "pass-through", "delegation wrapper", "wrapper adds no logic", "delegates entirely", "one-line delegation"],
    "filename_vague": ["filename is vague", "vague filename", "filename suggests"],
    "control_flow": ["branchy control flow", "loop-heavy control flow", "control flow is tangled", "tangled control flow", "excessive branching", "too many branches"],
    "strong": ["function is too big", "function is too large", "sprawling function", "too much code", "bloated function", "too many parameters", "argument pile-up", "file does too much", "module does too much", "module mixes", "responsibility sprawl", "too many responsibilities", "unrelated responsibilities", "dumping ground", "hides intent", "hidden intent", "unnecessary abstraction", "low-value abstraction", "generic plumbing", "excessive nesting", "repeated logic", "fallback chain", "unnecessary fallback", "comments restate", "restates the code"],
}


def has_reason_kind(reason: Column, kind: str) -> Column:
    low = F.lower(reason)
    found = any_of(low, REASON_KINDS[kind])
    return found | (low.contains("filename") & low.contains("vague")) if kind == "filename_vague" else found


def visible_reasons(reasons: Column, file_role: Column) -> Column:
    """Reasons without supporting-only ones, and without wrapper noise where the role or a stronger reason makes it noise."""
    rest = F.filter(reasons, lambda r: ~has_reason_kind(r, "supporting_only"))
    strong = F.filter(rest, lambda r: ~has_reason_kind(r, "wrapper_noise"))
    return F.when(file_role.isin("entrypoint", "script") | (F.size(strong) > 0), strong).otherwise(rest)


def truncated(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes of UTF-8, with an ellipsis where something was cut."""

    def cut(raw: Column) -> Column:
        head = F.substring(raw, 1, most)
        following = F.substring(raw, most + 1, 1)
        # where the cut falls inside a character, its bytes go: a lead byte and what stands after it
        whole = F.when(F.hex(following).rlike("^[89AB]"), F.regexp_replace(F.hex(head), "[C-F][0-9A-F](?:[89AB][0-9A-F]){0,3}$", "")).otherwise(F.hex(head))
        return F.concat(F.decode(F.unhex(whole), "UTF-8"), F.lit("…"))

    return F.when(F.octet_length(text) > most, bound(F.encode(text, "UTF-8"), cut)).otherwise(text)


def numbered(source: Column, first: int = 1) -> Column:
    return F.transform(lines(source), lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x))


def line_window(source: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1, joined."""
    return F.array_join(F.slice(lines(source), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def evidence_valid(source: Column, start: Column, end: Column, quote: Column) -> Column:
    """A quote of lines start to end: not blank, as many lines as the span, and found in it."""
    clean = F.replace(quote, F.lit("\r\n"), F.lit("\n"))
    spans = (start >= 1) & (end >= start) & (F.trim(clean) != "") & (F.size(F.split(clean, "\n")) == end - start + 1)
    return F.coalesce(spans & F.contains(line_window(source, start, end), clean), F.lit(False))


def duration(seconds: Column) -> Column:
    """``1h 02m``, ``3m 04s`` or ``5s``."""
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor((s % 3600) / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def redacted_endpoint(url: Column) -> Column:
    """An address without user, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-z]+://)[^/@]*@", "$1")


def pattern_suits(tier: Column, pattern: Column) -> Column:
    """A finding has a pattern, and nothing else has one."""
    return tier.isin("slop", "kinda_slop") == (pattern != "none")


def same_paths(a: Column, b: Column) -> Column:
    """Whether two lists hold the same paths, in whatever order."""
    return F.array_sort(a) == F.array_sort(b)


def line_starts(source: Column) -> Column:
    """Byte offsets at which lines begin, and last the end of a line after the text."""

    def step(s: Column, line: Column) -> Column:
        return F.array_append(s, F.element_at(s, -1) + F.octet_length(line) + 1)

    return F.aggregate(F.split(source, "\n"), F.array(F.lit(0).cast("long")), step)
