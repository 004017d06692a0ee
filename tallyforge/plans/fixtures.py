"""Literal inputs of queries for which the tables have no material, and the rows that follow from the rules by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(schema: str, rows: list[tuple]) -> str:
    """SQL that gives literal rows."""
    columns = [c.strip().split(" ") for c in schema.split(", ")]

    def one(value, kind: str) -> str:
        text = "NULL" if value is None else "'{}'".format(value.replace("'", "''")) if isinstance(value, str) else str(value)
        return f"CAST({text} AS {_KINDS[kind]})"

    listed = ", ".join("(" + ", ".join(one(v, k) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) AS t({', '.join(n for n, _ in columns)})"


# ---- shapes of methods: name, language, lines, source

SHAPED = [
    ("open_all", "python", 4, "def open_all():\n    from lib import _open\n    x = 1\n    return _open"),
    ("fetch", "python", 2, "# calls on\nreturn client.fetch(url)"),
    ("area", "kotlin", 1, "fun area(r: Int = default(r)): Int = square(r)"),
    ("width", "kotlin", 1, "fun width(r: Int = square(r))"),
    ("close", "python", 2, "def close(self):\n    pass"),
    ("load", "python", 5, 'def load(self):\n    """Reads.\n    More.\n    """\n    raise NotImplementedError()'),
    ("guard", "python", 4, "def guard(v):\n    if v is None:\n        pass\n    return v + 1"),
    ("at_once", "python", 1, "def at_once(self) -> int: ..."),
    ("__iter__", "python", 2, "def __iter__(self):\n    return self"),
    ("getName", "typescript", 5, "getName() {\n  const a = 1\n  const b = 2\n  return a + b\n}"),
    ("getter", "typescript", 5, "getter() {\n  const a = 1\n  const b = 2\n  return a + b\n}"),
    ("discard", "python", 3, "def discard(a):\n    del a\n    return None"),
    ("fold", "python", 5, "def fold(xs):\n    out = 0\n    for x in xs:\n        out += x\n    return out"),
]
# name, wrapper, delegation, stub, dunder, helper, placeholder, comparable
METHOD_SHAPES = [
    ("open_all", True, False, False, False, False, False, False),
    ("fetch", False, True, False, False, False, False, False),
    ("area", False, True, False, False, False, False, False),
    ("width", False, True, False, False, False, False, False),
    ("close", False, False, True, False, False, False, False),
    ("load", False, False, True, False, False, False, False),
    ("guard", False, False, False, False, False, False, True),
    ("at_once", False, False, True, False, False, False, False),
    ("__iter__", False, False, False, True, False, False, False),
    ("getName", False, False, False, False, True, False, False),
    ("getter", False, False, False, False, False, False, True),
    ("discard", False, False, False, False, False, True, False),
    ("fold", False, False, False, False, False, False, True),
]

# ---- kinds of modules

_PLAIN = "def f(x):\n    y = x\n    z = y\n    return z + 1"
MODULE_FILES = [
    ("pkg/lib/mod.rs", "rust", "//! doc\npub mod a;\npub use a::B;\n#[cfg(x)]\nuse c::d;"),
    ("pkg/names.py", "python", "from .a import b\n__all__ = ['b']"),
    ("pkg/shim.js", "javascript", "// compatibility shim\nimport 'new'"),
    ("web/src/lib/cache-flags.ts", "typescript", "const a = 1"),
    ("web/src/data/list.ts", "typescript", "export const rows: Record<string, number> = {}"),
    ("web/contracts/order.ts", "typescript", "export interface Order { id: string }"),
    ("web/contracts/run.ts", "typescript", "export interface Order {}\nfunction run() {}"),
    ("pkg/utils/helpers.py", "python", "x = 1"),
    ("pkg/store_protocols.py", "python", "x = 1"),
    ("web/src/components/card.tsx", "typescript", "export const Card = () => {\n  return <b>x</b>\n}"),
    ("web/src/hooks/useIsMounted.ts", "typescript", "x"),
    ("app/Models.kt", "kotlin", "data class M(val a: () -> Unit = {}, val b: Int)\nval c: (Int) -> Unit"),
    ("pkg/config.py", "python", "x = 1"),
    ("pkg/edge_detector.py", "python", "x = 1"),
    ("pkg/relay.py", "python", "x = 1"),
    ("pkg/plain.py", "python", "x = 1"),
    ("src/only.rs", "rust", "\n#![cfg(test)]\nfn x() {}"),
    ("tests/t.py", "python", "x = 1"),
]
# file, name, source, lines
MODULE_METHODS = [
    *[("web/src/data/list.ts", n, _PLAIN, 4) for n in ("one", "two", "three")],
    *[("pkg/utils/helpers.py", n, _PLAIN, 4) for n in ("one", "two", "three")],
    ("pkg/store_protocols.py", "one", _PLAIN, 4),
    ("web/src/components/card.tsx", "Card", "x", 3),
    ("pkg/config.py", "load_all", _PLAIN, 4),
    ("pkg/config.py", "other", _PLAIN, 4),
    ("pkg/edge_detector.py", "detect_edges", _PLAIN, 4),
    ("pkg/relay.py", "go", "return target(x)", 1),
    ("pkg/plain.py", "plain", _PLAIN, 4),
    ("web/contracts/run.ts", "run", _PLAIN, 4),
    ("src/only.rs", "x", "fn x() {}", 1),
    ("tests/t.py", "one", _PLAIN, 4),
]
MODULE_KINDS = [
    ("pkg/lib/mod.rs", "pure_reexport,barrel", True, False),
    ("pkg/names.py", "pure_reexport", False, False),
    ("pkg/shim.js", "compatibility_shim", True, False),
    ("web/src/lib/cache-flags.ts", "support_boundary", True, False),
    ("web/src/data/list.ts", "data_catalog", True, False),
    ("web/contracts/order.ts", "contract_types", True, False),
    ("web/contracts/run.ts", "", False, False),
    ("pkg/utils/helpers.py", "utility_surface", True, False),
    ("pkg/store_protocols.py", "protocol_surface", True, False),
    ("web/src/components/card.tsx", "presentation_surface", True, False),
    ("web/src/hooks/useIsMounted.ts", "hydration_hook", True, False),
    ("app/Models.kt", "callback_contract", True, False),
    ("pkg/config.py", "config_validation", True, False),
    ("pkg/edge_detector.py", "detector_facade", False, False),
    ("pkg/relay.py", "wrapper_only", False, False),
    ("pkg/plain.py", "", False, False),
    ("src/only.rs", "", False, True),
    ("tests/t.py", "", True, False),
]


def modules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = table(spark, "file_path string, language string, source string", MODULE_FILES).drop("language")
    methods = table(spark, "file_path string, name string, source string, loc int", MODULE_METHODS)
    return files, methods


FILE_REVIEWS = [
    ("pkg/shim.js", "slop", "it is old", "x"),
    ("pkg/utils/helpers.py", "kinda_slop", "The filename is vague", ""),
    ("pkg/utils/helpers.py", "slop", "It swallows errors", "except: pass"),
    ("pkg/plain.py", "kinda_slop", "the module mixes concerns", ""),
    ("web/src/data/list.ts", "clean", "fine", ""),
    ("unknown.py", "slop", "vague", ""),
]
NORMALISED = [
    ("pkg/shim.js", "clean", True),
    ("pkg/utils/helpers.py", "clean", True),
    ("pkg/utils/helpers.py", "slop", False),
    ("pkg/plain.py", "clean", True),
    ("web/src/data/list.ts", "clean", False),
    ("unknown.py", "slop", False),
]

COMMENTED = [
    ("a.py", "# Generated by a tool\nx = 1"),
    ("b.js", "/* first\n second: do not edit\n*/\nlet a = 1"),
    ("c.js", "let a = 'do not edit'\nlet b = 2 // copied from c"),
    ("d.js", "/* closed */ let a = 1\nlet s = 'autogenerated'"),
    ("e.py", "def run():\n    results['findings'] = []\n    return results"),
    ("f.rs", "// TODO: implement\nlet _findings = vec![];"),
    ("g.rs", "// TODO: implement\nlet found = vec![];"),
]
MARKERS = [
    ("a.py", "generated by", False),
    ("b.js", "do not edit", False),
    ("c.js", None, False),
    ("d.js", None, False),
    ("e.py", None, True),
    ("f.rs", None, True),
    ("g.rs", None, False),
]

# ---- copies: the same body, one with another constant, one that differs in one token of many, and a test of it

_BODY = "def {}(rows, size):\n    kept = []\n    for row in rows:\n        if row.size > size and row.name != 'x':\n            kept.append(row.name + ':' + row.kind)\n        elif row.kind:\n            kept.append(row.kind)\n    kept.sort()\n    total = len(kept) * {}\n    print(total, kept)\n    return kept[0], total"
COPIED = [
    ("pkg/a.py", "python", "# do not edit\n" + _BODY.format("collate", 1), [("collate", _BODY.format("collate", 1), 10, 2)]),
    ("pkg/b.py", "python", _BODY.format("join_up", 22), [("join_up", _BODY.format("join_up", 22), 10, 1), ("single", "def single(x):\n    a = x\n    b = a\n    return b + 1", 4, 20)]),
    ("pkg/c.py", "python", _BODY.format("near_it", 3) + "\n    # end", [("near_it", _BODY.format("near_it", 3) + " - 1", 10, 1)]),
    ("pkg/d.ts", "typescript", "", [("collate", _BODY.format("collate", 1), 10, 1)]),
    ("tests/test_a.py", "python", "", [("check", _BODY.format("check", 1), 10, 1)]),
]


def copied(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = table(spark, "file_path string, source string", [(f, s) for f, _, s, _ in COPIED])
    rows = [(f, language, n, s, loc, at) for f, language, _, ms in COPIED for n, s, loc, at in ms]
    return files, table(spark, "file_path string, language string, name string, source string, loc int, start_line int", rows)


# the near copy has two tokens more: it shares 72 of 74 shingles; ties go to the last earlier row
COPIES = [
    ("duplication", "pkg/b.py", "join_up", "copy-pasted method body (matches pkg/a.py::collate)", "kinda_slop"),
    ("duplication", "pkg/c.py", "near_it", "near-duplicate method body (97% match with pkg/b.py::join_up)", "kinda_slop"),
    ("test_coupling", "tests/test_a.py", "check", "test mirrors production implementation (100% match with pkg/b.py::join_up)", "kinda_slop"),
    ("provenance", "pkg/a.py", None, "generated-style marker present ('do not edit')", "kinda_slop"),
]

# ---- verdicts of files

VERDICT_FILES = [("a", "library"), ("b", "library"), ("c", "library"), ("d", "library"), ("e", "script"), ("f", "library"), ("g", "library"), ("h", "library"), ("i", "library")]
VERDICT_SIGNALS = [
    ("a", "m", 2, "function is too big (300 LOC > 100)"),
    ("a", None, 1, "odd layout"),
    ("b", "m", 1, "needless indirection"),
    ("c", None, 1, "filename is vague 'utils'"),
    ("d", None, 1, "one"),
    ("d", None, 1, "two"),
    ("d", None, 1, "three"),
    ("e", None, 1, "thin wrapper"),
    ("f", "m", 3, "no source"),
    ("f", "n", 1, "needless indirection"),
    ("g", "m", 2, "function is too big (300 LOC > 100)"),
    ("h", "m", 1, "orphaned export (never referenced)"),
    ("x", "m", 2, "not a known file"),
]
VERDICT_REVIEWS = [("g", True), ("a", False)]
_SIMPLE = "simplify the flagged method and keep its intent direct"
VERDICTS = [
    ("a", "slop", "m: function is too big (300 LOC > 100)", "m", _SIMPLE),
    ("b", "kinda_slop", "m: needless indirection", "m", "simplify the flagged method and remove the unnecessary machinery"),
    ("c", "clean", "filename is vague 'utils'", "", ""),
    ("d", "slop", "one; three; two", "", "trim the largest offender and keep the file focused"),
    ("e", "clean", "", "", ""),
    ("f", "unresolved", "m: unresolved review: no source | n: needless indirection", "m,n", "simplify the flagged method and remove the unnecessary machinery"),
    ("g", "clean", "", "", ""),
    ("h", "clean", "", "", ""),
    ("i", "clean", "", "", ""),
]

# unit, tier, pattern, scope, exported, references, private and unused, open boundary requirements
REVIEWED = [
    ("a", "slop", "residual_machinery", "whole_method", False, 2, False, []),
    ("b", "slop", "residual_machinery", "whole_method", False, 0, True, []),
    ("c", "kinda_slop", "ceremonial_logic", "signature", True, 0, False, None),
    ("d", "kinda_slop", "ceremonial_logic", "local", True, 0, False, []),
    ("e", "clean", "none", "none", True, 1, False, ["schema of the remote side"]),
    ("f", "unresolved", "none", "none", True, 1, False, ["schema of the remote side"]),
    ("g", "slop", "residual_machinery", "whole_method", True, 0, False, []),
]
ENFORCED = [
    ("a", "clean", "none", "none", "dead_code"),
    ("b", "slop", "residual_machinery", "whole_method", None),
    ("c", "unresolved", "none", "none", "exported_contract"),
    ("d", "kinda_slop", "ceremonial_logic", "local", None),
    ("e", "unresolved", "none", "none", "boundary"),
    ("f", "unresolved", "none", "none", None),
    ("g", "clean", "none", "none", "dead_code"),
]

SIGNAL_FLAGS = [
    (1, "method", "a.py", "m", "slop", ["big", "vague"]),
    (2, "method", "a.py", "m", "kinda_slop", ["vague"]),
    (3, "method", "a.py", "m", "slop", ["vague", "big"]),
    (4, "file", "a.py", None, "kinda_slop", ["odd"]),
]
SIGNAL_MAPS = [("method", "a.py", "m", "[Slop] big | [Slop] vague | [Kinda Slop] vague"), ("file", "a.py", None, "[Kinda Slop] odd")]

# ---- small repositories in six languages

REPOSITORY = [
    ("py/pkg/__init__.py", "python", ""),
    ("py/pkg/helpers.py", "python", "def clean(values):\n    return [v.strip() for v in values]\n"),
    ("py/pkg/main.py", "python", "from .helpers import clean as tidy\nfrom . import helpers\n\ndef run():\n    tidy([])\n    helpers.clean([])\n    return _own()\n\ndef _own():\n    return 1\n"),
    ("js/helpers.js", "javascript", "export function trimIt(value) {\n  return value.trim() // trimIt(\n}\n"),
    ("js/main.js", "javascript", 'import { trimIt as t } from "./helpers.js";\nimport * as h from "./helpers";\n\nconst go = (x) => {\n  return t(x) + h.trimIt("trimIt(x)");\n};\n'),
    ("ts/lib/num.ts", "typescript", "export class Num {\n  private twice(n: number): number {\n    return this.once(n) * 2;\n  }\n  once(n: number) {\n    return n;\n  }\n}\nexport const half = (n: number): number => {\n  return n / 2;\n};\n"),
    ("ts/app.ts", "typescript", 'import { half } from "@lib/num";\n\nexport function use(): number {\n  return half(4);\n}\n'),
    ("go/main.go", "go", 'package main\n\nimport (\n\t"example.com/m/go/text"\n)\n\nfunc main() {\n\ttext.Upper("x")\n\tlocal()\n}\n'),
    ("go/more.go", "go", "package main\n\nfunc local() {\n\ts := `func no() {`\n\t_ = s\n}\n"),
    ("go/text/up.go", "go", "package text\n\ntype T struct{}\n\nfunc Upper(s string) string {\n\treturn s\n}\n\nfunc (t *T) Low(a, b string) string {\n\treturn a\n}\n"),
    ("rs/src/main.rs", "rust", "mod math;\n\nuse crate::math::{add as plus, sub};\n\nfn main() {\n    plus(1, 2);\n    sub(1, 2);\n    crate::math::mul(1, 2);\n}\n"),
    ("rs/src/math.rs", "rust", "pub fn add<'a>(x: i32, y: i32) -> i32 { x + y }\npub fn sub(x: i32, y: i32) -> i32 {\n    /* { /* nested */ } */\n    x - y\n}\npub fn mul(x: i32, y: i32) -> i32 {\n    x * y\n}\n"),
    ("kt/a/Main.kt", "kotlin", "package demo.app\n\nimport demo.lib.twice as two\n\nfun main() {\n    two(1)\n    near(2)\n}\n"),
    ("kt/a/Near.kt", "kotlin", "package demo.app\n\nfun near(x: Int): Int {\n    return x\n}\n"),
    ("kt/b/Lib.kt", "kotlin", "package demo.lib\n\nclass Box {\n    private fun inner(): Int {\n        return 1\n    }\n}\n\nfun twice(x: Int): Int {\n    return x * 2\n}\n"),
]


def repository(spark: SparkSession) -> DataFrame:
    return table(spark, "file_path string, language string, source string", REPOSITORY)


METHODS = [
    ("py/pkg/helpers.py", "clean", None, 1, 2, 1, True),
    ("py/pkg/main.py", "run", None, 4, 7, 0, True),
    ("py/pkg/main.py", "_own", None, 9, 10, 0, False),
    ("js/helpers.js", "trimIt", None, 1, 3, 1, True),
    ("js/main.js", "go", None, 4, 6, 1, False),
    ("ts/lib/num.ts", "twice", "Num", 2, 4, 1, False),
    ("ts/lib/num.ts", "once", "Num", 5, 7, 1, True),
    ("ts/lib/num.ts", "half", None, 9, 11, 1, True),
    ("ts/app.ts", "use", None, 3, 5, 0, True),
    ("go/main.go", "main", None, 7, 10, 0, False),
    ("go/more.go", "local", None, 3, 6, 0, False),
    ("go/text/up.go", "Upper", None, 5, 7, 1, True),
    ("go/text/up.go", "Low", "T", 9, 11, 2, True),
    ("rs/src/main.rs", "main", None, 5, 9, 0, False),
    ("rs/src/math.rs", "add", None, 1, 1, 2, True),
    ("rs/src/math.rs", "sub", None, 2, 5, 2, True),
    ("rs/src/math.rs", "mul", None, 6, 8, 2, True),
    ("kt/a/Main.kt", "main", None, 5, 8, 0, True),
    ("kt/a/Near.kt", "near", None, 3, 5, 1, True),
    ("kt/b/Lib.kt", "inner", "Box", 4, 6, 0, False),
    ("kt/b/Lib.kt", "twice", None, 9, 11, 1, True),
]
# rules: 1 the file itself, 2 an imported name, 3 a member of an import, 4 the package, 5 a path, 6 the only one of its name
RESOLVED = [
    ("py/pkg/main.py", 5, "tidy", "py/pkg/helpers.py::clean", 2),
    ("py/pkg/main.py", 6, "clean", "py/pkg/helpers.py::clean", 3),
    ("py/pkg/main.py", 7, "_own", "py/pkg/main.py::_own", 1),
    ("js/main.js", 5, "t", "js/helpers.js::trimIt", 2),
    ("js/main.js", 5, "trimIt", "js/helpers.js::trimIt", 3),
    ("ts/lib/num.ts", 3, "once", "ts/lib/num.ts::once", 1),
    ("ts/app.ts", 4, "half", "ts/lib/num.ts::half", 2),
    ("go/main.go", 8, "Upper", "go/text/up.go::Upper", 3),
    ("go/main.go", 9, "local", "go/more.go::local", 4),
    ("rs/src/main.rs", 6, "plus", "rs/src/math.rs::add", 2),
    ("rs/src/main.rs", 7, "sub", "rs/src/math.rs::sub", 2),
    ("rs/src/main.rs", 8, "mul", "rs/src/math.rs::mul", 5),
    ("kt/a/Main.kt", 6, "two", "kt/b/Lib.kt::twice", 2),
    ("kt/a/Main.kt", 7, "near", "kt/a/Near.kt::near", 4),
]
REFERENCES = [
    ("py/pkg/helpers.py::clean", "py/pkg/main.py:5,py/pkg/main.py:6"),
    ("py/pkg/main.py::_own", "py/pkg/main.py:7"),
    ("js/helpers.js::trimIt", "js/main.js:5"),
    ("ts/lib/num.ts::once", "ts/lib/num.ts:3"),
    ("ts/lib/num.ts::half", "ts/app.ts:4"),
    ("go/text/up.go::Upper", "go/main.go:8"),
    ("go/more.go::local", "go/main.go:9"),
    ("rs/src/math.rs::add", "rs/src/main.rs:6"),
    ("rs/src/math.rs::sub", "rs/src/main.rs:7"),
    ("rs/src/math.rs::mul", "rs/src/main.rs:8"),
    ("kt/b/Lib.kt::twice", "kt/a/Main.kt:6"),
    ("kt/a/Near.kt::near", "kt/a/Main.kt:7"),
]

CLASSES = [
    ("base.py", "python", "class Root:\n    def name(self):\n        return 1\n\nclass Left(Root):\n    pass\n\nclass Loop(Loop):\n    pass\n"),
    ("use.py", "python", "from base import Left as L, Root\n\nclass Side:\n    def name(self):\n        return 2\n    def other(self):\n        return 3\n\nclass Own(L, Side):\n    pass\n\nclass Alone(Unknown):\n    pass\n"),
]
MEMBERS = [("use.py", "Own", "name"), ("use.py", "Own", "other"), ("use.py", "Own", "missing"), ("use.py", "Alone", "name"), ("base.py", "Loop", "name"), ("base.py", "Left", "name")]
INHERITED = [("use.py", "Own", "name", "base.py", "Root"), ("use.py", "Own", "other", "use.py", "Side"), ("base.py", "Left", "name", "base.py", "Root")]

TARGETS = [(1, "src/a.rs", "open", 3), (2, "src/a.rs", "shut", 20), (3, "net/dial_linux.go", "Dial", 5), (4, "net/one.go", "One", 1), (5, "a.py", "open", 1)]
CONDITIONAL = [
    ("src/a.rs", "open", None, "function", 3, True),
    ("src/a.rs", "open", None, "function", 9, True),
    ("src/a.rs", "open", "File", "function", 15, True),
    ("src/a.rs", "shut", None, "function", 20, True),
    ("src/a.rs", "shut", None, "function", 25, False),
    ("net/dial_linux.go", "Dial", None, "function", 5, True),
    ("net/dial_other.go", "Dial", None, "function", 7, True),
    ("web/dial.go", "Dial", None, "function", 7, True),
    ("net/one.go", "One", None, "function", 1, False),
    ("a.py", "open", None, "function", 1, True),
]
ALTERNATIVES = [(1, "src/a.rs", "open", 3), (1, "src/a.rs", "open", 9), (2, "src/a.rs", "shut", 20), (3, "net/dial_linux.go", "Dial", 5), (3, "net/dial_other.go", "Dial", 7), (4, "net/one.go", "One", 1), (5, "a.py", "open", 1)]

REF_ROWS = [(1, "a", 2, "x"), (2, "a", None, "x"), (3, "a", 9, "y"), (4, "b", 1, "x"), (5, "a", 9, "z")]
REF_DEFS = [("a", 1, "x", 10), ("a", 2, "x", 20), ("a", 3, "y", 30)]
REF_TARGETS = [(1, "a", "x", 20), (2, "a", "x", 10), (3, "a", "y", 30), (4, None, None, None), (5, None, None, None)]

PROOF_FILES = [
    ("a.py", "python", "def f(a, b=1, *c, d, **e):\n    if a:\n        return d\n    else:\n        return d\n\nclass K:\n    def g(self, x):\n        x = 2\n        if x:\n            return 1\n        else:\n            return 2\n"),
    ("bad.py", "python", "def ("),
]
PROVEN = [("f", 1, "a,b,c,d,e", "b,c,e", "2"), ("g", 8, "self,x", "", "")]

RUST_TESTS = [("a.rs", "rust", "fn a() {}\n#[test]\nfn b() {\n    // }\n}\n#[cfg(feature = \"x\")]\nfn c() {}\n#[cfg(test)]\nmod tests {\n    fn d() {}\n}\n#[cfg(all(unix, test))]\nfn e();\n")]
TEST_SPANS = [("a.rs", 2, 5), ("a.rs", 8, 11), ("a.rs", 12, 13)]

UNMASKED = [
    ("a.py", "python", "x = 'a#b' + r\"c\" # d\ny = \"\"\"e\n'f\"\"\"\nz"),
    ("b.rs", "rust", "let a: &'x str = \"b{\"; /* c /* d */ e */ let f = '}'; let g = r#\"h\"i\"#; // j"),
    ("c.kt", "kotlin", "val a = \"\"\"b\"c\"\"\" + 'd' /* /* */ */ + e"),
    ("d.go", "go", "a := `b\n{` // c\nd := '\\''"),
    ("e.ts", "typescript", "const a = `b${c}` + 'd\\'e' /* f"),
]
# runs of spaces as one
MASKED = [
    ("a.py", "x = + \ny = \n \nz"),
    ("b.rs", "let a: &'x str = ; let f = ; let g = ; "),
    ("c.kt", "val a = + + e"),
    ("d.go", "a := \n \nd := "),
    ("e.ts", "const a = + "),
]
