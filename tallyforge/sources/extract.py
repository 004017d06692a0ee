"""Methods and symbols of source files: Python by its own parser, brace languages by a lexical scan."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

METHODS = "file_path string, language string, name string, owner string, start_line int, end_line int, loc int, param_count int, nesting_depth int, is_exported boolean, source string"
SYMBOLS = "file_path string, language string, kind string, name string, line int, end_line int, module string, imported string, owner string, is_member boolean"

# ---- masking: strings and comments as spaces, so that only code is matched; lines and columns stay

_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
# What opens a comment or string in each language.
MASKED = {
    "python": re.compile(r"#[^\n]*|(?i:[rbuf]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _STRINGS + ")", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`?|" + _STRINGS, re.S),
    "javascript": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*`?|" + _STRINGS, re.S),
    # a tick before a name and no tick after it is a lifetime
    "rust": re.compile(r"//[^\n]*|/\*|b?r(?P<hash>#*)\".*?(?:\"(?P=hash)|\Z)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]+?|[^'\\\n])'", re.S),
    "kotlin": re.compile(r"//[^\n]*|/\*|\"\"\".*?(?:\"\"\"+|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'", re.S),
}
MASKED["typescript"] = MASKED["javascript"]
#: Languages whose block comments nest.
NESTED = {"rust", "kotlin"}


def masked(source: str, language: str) -> str:
    out, at, pattern = [], 0, MASKED[language]
    while found := pattern.search(source, at):
        out.append(source[at : found.start()])
        end = found.end()
        if language in NESTED and found[0] == "/*":
            depth = 1
            while depth and (mark := re.compile(r"/\*|\*/").search(source, end)):
                depth, end = depth + (1 if mark[0] == "/*" else -1), mark.end()
            end = len(source) if depth else end
        elif end == found.start():
            end += 1
        out.append(re.sub(r"[^\n]", " ", source[found.start() : end]))
        at = end
    return "".join(out) + source[at:]


def closing(code: str, at: int, pair: str) -> int:
    """The place after the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == pair[0]) - (code[k] == pair[1])
        if not depth:
            return k + 1
    return len(code)


def block_end(lines: list[str], start: int, language: str = "javascript") -> int:
    """The line on which the block that opens at or after ``start`` closes; strings and comments hold no braces."""
    code = masked("\n".join(lines[start:]), language)
    opens = code.find("{")
    return start if opens < 0 else start + code[: closing(code, opens, "{}") - 1].count("\n")


# How the brace languages declare functions and what holds functions.
DECLARATIONS = {
    "go": r"^[ \t]*func[ \t]+(?:\((?P<recv>[^)]*)\)[ \t]*)?(?P<name>\w+)",
    "rust": r"^[ \t]*(?P<export>pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|async|const|unsafe|extern)[ \t]+)*fn[ \t]+(?P<name>\w+)",
    "kotlin": r"^[ \t]*(?P<mods>(?:[\w@]+[ \t]+)*)fun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w<>?]+\.)*(?P<name>\w+)",
    "javascript": r"^[ \t]*(?P<export>export[ \t]+(?:default[ \t]+)?)?(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)|(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?=(?:<[^>]*>)?\([^)]*\)[^=;{]*=>)|(?:(?:static|async|get|set|public|private|protected|override)[ \t]+)*(?P<member>[\w$]+)[ \t]*(?:<[^>]*>)?(?=\([^)]*\)[^;{=]*\{))",
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
HOLDERS = {
    "go": r"^[ \t]*type[ \t]+(?P<name>\w+)[ \t]+(?:struct|interface)",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:impl(?:<[^>]*>)?[ \t]+(?:[\w:<>, ]+[ \t]+for[ \t]+)?(?P<impl>\w+)|(?:struct|enum|trait)[ \t]+(?P<name>\w+))",
    "kotlin": r"^[ \t]*(?:\w+[ \t]+)*(?:class|interface|object)[ \t]+(?P<name>\w+)",
    "javascript": r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:class|interface)[ \t]+(?P<name>[\w$]+)",
}
HOLDERS["typescript"] = HOLDERS["javascript"]
_COMMON = "if for while switch return else".split()
KEYWORDS = {
    "go": frozenset([*_COMMON, *"func go defer select range make new len cap append panic".split()]),
    "rust": frozenset([*_COMMON, *"match loop fn".split()]),
    "kotlin": frozenset([*_COMMON, *"when fun do try catch constructor init".split()]),
    "javascript": frozenset([*_COMMON, *"catch do function typeof new super constructor import await".split()]),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]


def _method(path, language, name, owner, lines, start, end, params, exported) -> tuple:
    return (path, language, name, owner, start + 1, end + 1, end - start + 1, params, 0, exported, "\n".join(lines[start : end + 1]))


def python_methods(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.split("\n")
    listed = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            listed = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}
    out, stack = [], [(tree, None)]
    while stack:
        node, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                exported = (child.name in listed if listed is not None else not child.name.startswith("_")) if node is tree else not child.name.startswith("_")
                out.append(_method(path, "python", child.name, owner, lines, child.lineno - 1, child.end_lineno - 1, n, exported))
            stack.append((child, child.name if isinstance(child, ast.ClassDef) else owner))
    return sorted(out, key=lambda m: (m[4], m[2]))


def _holders(code: str, language: str) -> list[tuple[int, int, str, int]]:
    """Types with a body: start, end, name, and the place of their declaration."""
    out = []
    for found in re.finditer(HOLDERS[language], code, re.M):
        name = found.groupdict().get("impl") or found["name"]
        stop = re.compile(r"[{;]|\n[ \t]*\n").search(code, found.end())
        end = closing(code, stop.start(), "{}") if stop and stop[0] == "{" else found.end()
        out.append((found.start(), end, name, found.start()))
    return out


def _functions(code: str, language: str) -> list[tuple[int, int, str, str | None, int, bool]]:
    """Functions of masked code: start, end, name, owner, number of parameters, whether they are exported."""
    held, out = _holders(code, language), []
    for found in re.finditer(DECLARATIONS[language], code, re.M):
        g = found.groupdict()
        name = g.get("name") or g.get("arrow") or g.get("member")
        opens = code.find("(", found.end())
        if name in KEYWORDS[language] or opens < 0:
            continue
        start = found.start() + len(found[0]) - len(found[0].lstrip())
        around = [h for h in held if h[0] < start < h[1]]
        owner = max(around)[2] if around else None
        if g.get("member") and not owner:
            continue  # a call that is followed by a block, not a method
        if g.get("recv"):
            owner = re.sub(r"\[.*", "", g["recv"]).split()[-1].lstrip("*")
        shut = closing(code, opens, "()")
        inner = re.sub(r"\([^()]*\)|<[^<>]*>|\{[^{}]*\}|\[[^\[\]]*\]", "", code[opens + 1 : shut - 1])
        params = len([p for p in inner.split(",") if p.strip() and not re.fullmatch(r"&?\s*(?:mut\s+)?self(?:\s*:.*)?", p.strip())]) if language == "rust" else len([p for p in inner.split(",") if p.strip()])
        body = re.compile(r"[{;=\n]").search(code, shut)
        while body and body[0] == "\n" and re.match(r"\s*(?:[{:]|where|->|throws)", code[body.start() :]):
            body = re.compile(r"[{;=\n]").search(code, body.end() + len(re.match(r"\s*", code[body.end() :])[0]))
        if g.get("arrow"):
            arrow = code.find("=>", shut)
            body = re.compile(r"[{;\n]").search(code, arrow)
        if body and body[0] == "=" and language != "kotlin":
            body = re.compile(r"[{;\n]").search(code, body.end())
        end = closing(code, body.start(), "{}") if body and body[0] == "{" else (code.find("\n", shut) if code.find("\n", shut) >= 0 else len(code))
        exported = name[0].isupper() if language == "go" else "private" not in g["mods"] if language == "kotlin" else bool(g.get("export"))
        if g.get("member"):
            exported = not found[0].strip().startswith("private")
        out.append((start, end, name, owner, params, exported))
    return out


def brace_methods(path: str, language: str, source: str) -> list[tuple]:
    code, lines = masked(source, language), source.split("\n")
    out = []
    for start, end, name, owner, params, exported in _functions(code, language):
        first, last = code[:start].count("\n"), code[: max(end - 1, start)].count("\n")
        out.append(_method(path, language, name, owner, lines, first, last, params, exported))
    return out


def _rust_uses(text: str, prefix: str = "") -> list[tuple[str, str]]:
    """Paths of a use declaration with the local name of each."""
    out, depth, part = [], 0, ""
    for c in text + ",":
        if c == "," and not depth:
            part = part.strip()
            if "{" in part:
                head, inner = part.split("{", 1)
                out += _rust_uses(inner.rsplit("}", 1)[0], prefix + head.strip())
            elif part:
                whole, _, alias = part.partition(" as ")
                whole = prefix + whole.strip()
                whole = whole.removesuffix("::self")
                out.append((whole, alias.strip() or whole.rsplit("::", 1)[-1]))
            part = ""
            continue
        depth += (c == "{") - (c == "}")
        part += c
    return out


def _imports(language: str, code: str, source: str) -> list[tuple[int, str, str, str | None, str]]:
    """Place, local name, module, imported name (null for a module itself) and kind, import or export."""
    out = []
    if language == "go":
        for block in re.finditer(r"^import[ \t]*(\((?P<many>[^)]*)\)|[^\n]+)", code, re.M):
            for one in re.finditer(r"(?:(?P<alias>[\w.]+)[ \t]+)?\"(?P<module>[^\"\n]+)\"", source[block.start() : block.end()]):
                local = one["alias"] if one["alias"] not in (None, "import") else one["module"].rsplit("/", 1)[-1]
                out.append((block.start() + one.start(), local, one["module"], None, "import"))
        out += [(p.start(), p[1], p[1], None, "package") for p in re.finditer(r"^package[ \t]+(\w+)", code, re.M)]
    elif language == "kotlin":
        for one in re.finditer(r"^import[ \t]+([\w.]+)(\.\*)?(?:[ \t]+as[ \t]+(\w+))?", code, re.M):
            module, _, name = one[1].rpartition(".")
            out.append((one.start(), "*", one[1], "*", "import") if one[2] else (one.start(), one[3] or name, module, name, "import"))
        out += [(p.start(), p[1].rsplit(".", 1)[-1], p[1], None, "package") for p in re.finditer(r"^package[ \t]+([\w.]+)", code, re.M)]
    elif language == "rust":
        for one in re.finditer(r"^[ \t]*(pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", code, re.M):
            for whole, local in _rust_uses(re.sub(r"\s+", " ", one[2])):
                module, _, name = whole.rpartition("::")
                out.append((one.start(), local, module, name, "export" if one[1] else "import"))
        for one in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;", code, re.M):
            before = source[: one.start()].rstrip().rsplit("\n", 1)[-1]
            placed = re.search(r"#\[path[ \t]*=[ \t]*\"([^\"]+)\"\]", before)
            out.append((one.start(), one[1], placed[1] if placed else one[1], None, "module"))
    else:
        for one in re.finditer(r"^[ \t]*import[ \t]+(?P<what>[^;\"'`]*?)[ \t\n]*from(?=\s)|^[ \t]*export[ \t]+(?P<names>\*|\{[^}]*\})[ \t\n]*from(?=\s)", code, re.M):
            quoted = re.compile(r"[\"']([^\"'\n]+)[\"']").search(source, one.end())
            if not quoted:
                continue
            module, what = quoted[1], one["what"] or one["names"]
            kind = "import" if one["what"] is not None else "export"
            inner = re.search(r"\{([^}]*)\}", what)
            for part in inner[1].split(",") if inner else []:
                name, _, alias = re.sub(r"^type[ \t]+", "", part.strip()).partition(" as ")
                if name.strip():
                    out.append((one.start(), alias.strip() or name.strip(), module, name.strip(), kind))
            rest = re.sub(r"\{[^}]*\}", "", what)
            for part in rest.split(","):
                part = re.sub(r"^type[ \t]+", "", part.strip())
                if part.startswith("*"):
                    out.append((one.start(), part.partition(" as ")[2].strip() or "*", module, None if " as " in part else "*", kind))
                elif part:
                    out.append((one.start(), part, module, "default", kind))
        for one in re.finditer(r"(?:const|let|var)[ \t]+(\{[^}]*\}|[\w$]+)[ \t]*=[ \t]*require\(", code):
            quoted = re.compile(r"[\"']([^\"'\n]+)[\"']").search(source, one.end())
            names = re.findall(r"[\w$]+", one[1])
            if quoted:
                out += [(one.start(), n, quoted[1], n if one[1].startswith("{") else None, "import") for n in names]
    return out


CALL = re.compile(r"(?:(?P<owner>[\w$]+(?:(?:\.|::)[\w$]+)*)(?P<sep>\?\.|\.|::))?(?P<name>[\w$]+)[ \t]*(?:::<[^>()]*>)?\(")


def brace_symbols(path: str, language: str, source: str) -> list[tuple]:
    """Definitions, imports, exports, modules and calls of a brace language's file as tagged rows."""
    code = masked(source, language)
    line = lambda at: code[:at].count("\n") + 1
    out, declared = [], set()
    for start, end, name, owner, _, _ in _functions(code, language):
        declared.add(line(start))
        out.append((path, language, "function", name, line(start), line(max(end - 1, start)), None, None, owner, owner is not None))
    for start, end, name, at in _holders(code, language):
        out.append((path, language, "class", name, line(at + len(code[at:]) - len(code[at:].lstrip())), line(max(end - 1, start)), None, None, None, False))
    for at, local, module, imported, kind in _imports(language, code, source):
        out.append((path, language, kind, local, line(at), line(at), module, imported, None, False))
    for found in CALL.finditer(code):
        before = code[max(found.start() - 9, 0) : found.start()]
        if found["name"] in KEYWORDS[language] or found["name"].isdigit() or re.search(r"\b(?:func|fn|fun|function|class|new)[ \t]+$", before):
            continue
        if not found["owner"] and line(found.start()) in declared and any(s[3] == found["name"] and s[4] == line(found.start()) for s in out):
            continue
        out.append((path, language, "call", found["name"], line(found.start()), line(found.start()), None, None, found["owner"], found["owner"] is not None))
    return sorted(set(out), key=lambda r: (r[4], r[2], r[3], str(r[8])))


def python_symbols(path: str, source: str) -> list[tuple]:
    """Definitions, imports and calls of a Python file as tagged rows."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    owners = {f: c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append((path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, None, None, owners.get(node), node in owners))
            if isinstance(node, ast.ClassDef):
                out += [(path, "base", node.name, node.lineno, node.lineno, None, ast.unparse(b), str(k), False) for k, b in enumerate(node.bases)]
        elif isinstance(node, ast.Import):
            out += [(path, "import", (a.asname or a.name).split(".")[0], node.lineno, node.lineno, a.name, None, None, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out += [(path, "import", a.asname or a.name, node.lineno, node.lineno, module, a.name, None, False) for a in node.names]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            out.append((path, "call", node.func.id, node.lineno, node.lineno, None, None, None, False))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            base = node.func.value
            out.append((path, "call", node.func.attr, node.lineno, node.lineno, None, None, base.id if isinstance(base, ast.Name) else None, True))
    return sorted(((r[0], "python", *r[1:]) for r in out), key=lambda r: (r[4], r[2], r[3]))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")])


def methods(files: DataFrame) -> DataFrame:
    """One row per method of ``(file_path, language, source)``."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [m for p, l, s in zip(part.file_path, part.language, part.source, strict=True) for m in (python_methods(p, s) if l == "python" else brace_methods(p, l, s))]
            yield _frame(rows, METHODS)

    return files.select("file_path", "language", "source").mapInPandas(run, METHODS)


def symbols(files: DataFrame) -> DataFrame:
    """Definitions, bases, imports, exports, packages and calls of ``(file_path, language, source)``, tagged by kind."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _frame([r for p, l, s in zip(part.file_path, part.language, part.source, strict=True) for r in (python_symbols(p, s) if l == "python" else brace_symbols(p, l, s))], SYMBOLS)

    return files.select("file_path", "language", "source").mapInPandas(run, SYMBOLS)


# ---- test spans of Rust

def rust_test_spans(path: str, source: str) -> list[tuple]:
    """First and last lines of functions and modules that only tests compile."""
    code, out = masked(source, "rust"), []
    for mark in re.finditer(r"#\[\s*(?:test|cfg(?:_attr)?\s*\((?P<what>[^\]]*)\))\s*\]", code):
        if mark["what"] is not None and "test" not in re.split(r"\W+", mark["what"]):
            continue
        opens = re.compile(r"[{;]").search(code, mark.end())
        end = closing(code, opens.start(), "{}") if opens and opens[0] == "{" else (opens.end() if opens else len(code))
        out.append((path, code[: mark.start()].count("\n") + 1, code[: end - 1].count("\n") + 1))
    return out


def test_spans(files: DataFrame) -> DataFrame:
    """``(file_path, start_line, end_line)`` of test code in Rust files."""
    ship(files.sparkSession)
    schema = "file_path string, start_line int, end_line int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _frame([r for p, s in zip(part.file_path, part.source, strict=True) for r in rust_test_spans(p, s)], schema)

    return files.where("language = 'rust'").select("file_path", "source").mapInPandas(run, schema)


# ---- proofs about Python methods

PROOFS = "file_path string, name string, start_line int, parameters array<string>, unused array<string>, equal_branches array<int>"


def python_proofs(path: str, source: str) -> list[tuple]:
    """For each function its parameters, those that its body never reads, and lines of conditions whose two branches are alike."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        a = f.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        body = [n for statement in f.body for n in ast.walk(statement)]
        read = {n.id for n in body if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
        alike = lambda x, y: [ast.dump(s) for s in x] == [ast.dump(s) for s in y]
        equal = [n.lineno for n in body if isinstance(n, ast.If) and n.orelse and alike(n.body, n.orelse)]
        out.append((path, f.name, f.lineno, names, [n for n in names if n not in read and n not in ("self", "cls")], sorted(equal)))
    return sorted(out, key=lambda r: r[2])


def proofs(files: DataFrame) -> DataFrame:
    """What can be proven about Python functions from their source alone; see ``PROOFS``."""
    ship(files.sparkSession)
    names = ["file_path", "name", "start_line", "parameters", "unused", "equal_branches"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([r for p, s in zip(part.file_path, part.source, strict=True) for r in python_proofs(p, s)], columns=names)

    return files.where("language = 'python'").select("file_path", "source").mapInPandas(run, PROOFS)


def masked_files(files: DataFrame) -> DataFrame:
    """``(file_path, code)``: sources in which strings and comments are spaces; lines and columns stay."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, masked(s, l)) for p, l, s in zip(part.file_path, part.language, part.source, strict=True)], columns=["file_path", "code"])

    return files.select("file_path", "language", "source").mapInPandas(run, "file_path string, code string")
