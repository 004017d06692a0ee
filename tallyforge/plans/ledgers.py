"""Literal answers, selections, graphs and shards of the queries over releases, and the rows that follow from the rules by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .fixtures import table


def answers(spark: SparkSession, rows: list[tuple[int, dict]]) -> DataFrame:
    return table(spark, "answer_id int, payload string", [(k, json.dumps(p)) for k, p in rows])


def _decision(case_id, decision="keep", reason="r", target=None):
    return {"case_id": case_id, "decision": decision, "reason": reason, **({"merge_into_case_id": target} if target else {})}


CASES = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (2, "e"), (2, "f"), (2, "g")]
ADJUDICATIONS = [
    (1, {"decisions": [_decision(" a "), _decision("b", "discard"), _decision("c", "merge", target="a")]}),
    (
        2,
        {
            "decisions": [
                _decision(" "),
                _decision("x"),
                _decision("a"),
                _decision("a"),
                _decision("b", None),
                _decision("c", "maybe"),
                _decision("d", reason=""),
                _decision("e", "merge"),
                _decision("f", "merge", target="f"),
                _decision("g", "merge", target="zz"),
            ]
        },
    ),
    (3, {"decisions": []}),
]
CASES.append((3, "a"))
ADJUDICATED = [
    (1, 0, "a", "keep", None, None),
    (1, 1, "b", "discard", None, None),
    (1, 2, "c", "merge", "a", None),
    (2, 0, None, "keep", None, "missing case_id"),
    (2, 1, "x", "keep", None, "unknown case"),
    (2, 2, "a", "keep", None, None),
    (2, 3, "a", "keep", None, "repeated case"),
    (2, 4, "b", None, None, "missing decision"),
    (2, 5, "c", "maybe", None, "invalid decision"),
    (2, 6, "d", "keep", None, "missing reason"),
    (2, 7, "e", "merge", None, "merge without target"),
    (2, 8, "f", "merge", "f", "merge into itself"),
    (2, 9, "g", "merge", "zz", "unknown merge target"),
    (3, None, "a", None, None, "omitted"),
]
ACCEPTED = [(1, True, 0, None), (2, False, 9, "missing case_id"), (3, False, 1, "omitted")]

_EDIT = {"file_path": "a.py", "start_line": 2, "end_line": 3, "replacement": ""}
PROOF_CASES = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (2, "e")]
PROOFS = [
    (1, {"proofs": [{"case_id": "a", "decision": "validated", "reason": "r", "edits": [_EDIT]}, {"case_id": "b", "decision": "unresolved", "reason": "r", "edits": []}]}),
    (
        2,
        {
            "proofs": [
                {"case_id": "a", "decision": "validated", "reason": "r", "edits": []},
                {"case_id": "b", "decision": "unresolved", "reason": "r", "edits": [_EDIT]},
                {"case_id": "c", "decision": "validated", "reason": "r", "edits": [_EDIT | {"end_line": 1}]},
                {"case_id": "d", "decision": "validated", "reason": "r"},
            ]
        },
    ),
]
PROVEN = [
    (1, 0, "a", "1", None),
    (1, 1, "b", "0", None),
    (2, 0, "a", "0", "validated without edits"),
    (2, 1, "b", "1", "unresolved with edits"),
    (2, 2, "c", "1", "invalid edit"),
    (2, 3, "d", None, "missing edits"),
    (2, None, "e", None, "omitted"),
]

UNITS = [("u1", "clean", "def a():\n    return 1"), ("u2", "slop", "def b():\n    return 1"), ("u3", "unresolved", "x")]
_CASE = {"tier": "slop", "pattern": "duplicated_semantics", "mechanism": "m", "intent": "i", "contract_boundary": "c", "counterfactual": "f", "unresolved_assumptions": [], "affected_units": ["u2", "u1", "u2"], "evidence": [{"unit_id": "u1", "quote": "return 1"}]}
SYNTHESIS = [
    (
        1,
        {
            "cases": [
                _CASE,
                _CASE,
                _CASE | {"tier": "clean"},
                _CASE | {"pattern": "none"},
                _CASE | {"mechanism": " "},
                _CASE | {"unresolved_assumptions": ["x"]},
                _CASE | {"affected_units": ["u1", "u1"]},
                _CASE | {"affected_units": ["u1", "u9"]},
                _CASE | {"affected_units": ["u1", "u3"]},
                _CASE | {"pattern": "other", "evidence": []},
                _CASE | {"pattern": "other", "evidence": [{"unit_id": "u1", "quote": "return 2"}]},
            ]
        },
    )
]
_ID = "synthesis:duplicated_semantics:u1|u2"
SYNTHESIZED = [
    (1, 0, _ID, None),
    (1, 1, _ID, "repeated case"),
    (1, 2, _ID, "tier is no finding"),
    (1, 3, "synthesis:none:u1|u2", "unknown pattern"),
    (1, 4, _ID, "missing text"),
    (1, 5, _ID, "open assumptions"),
    (1, 6, "synthesis:duplicated_semantics:u1", "fewer than two units"),
    (1, 7, "synthesis:duplicated_semantics:u1|u9", "unknown unit"),
    (1, 8, "synthesis:duplicated_semantics:u1|u3", "unresolved unit"),
    (1, 9, "synthesis:other:u1|u2", "missing evidence"),
    (1, 10, "synthesis:other:u1|u2", "evidence is not in its unit"),
]

_CLEAN = {"tier": "clean", "pattern": "none", "intent": "i", "reason": "", "necessity_check": "n", "contract_status": "required", "contract_impact": "none", "dependency_impact": "none", "simplification": "none", "change_scope": "none", "behavior_status": "known", "missing_evidence": [], "evidence": []}
_SLOP = _CLEAN | {"tier": "slop", "pattern": "contract_fog", "reason": "r", "contract_status": "unnecessary", "simplification": "drop it", "change_scope": "local", "behavior_status": "preserved", "evidence": [{"start_line": 1, "end_line": 1, "quote": "x"}]}
_OPEN = _CLEAN | {"tier": "unresolved", "reason": "r", "contract_status": "unknown", "behavior_status": "unknown", "missing_evidence": ["m"]}
REVIEWS = list(
    enumerate(
        [
            _CLEAN,
            _SLOP,
            _OPEN,
            {"pattern": "none"},
            _CLEAN | {"tier": "bad"},
            _CLEAN | {"intent": " "},
            _CLEAN | {"pattern": "odd"},
            _SLOP | {"behavior_status": "known"},
            _CLEAN | {"contract_status": "maybe"},
            _CLEAN | {"missing_evidence": [""]},
            _CLEAN | {"pattern": "other"},
            _CLEAN | {"simplification": "drop"},
            _CLEAN | {"contract_impact": "cannot be verified here"},
            _OPEN | {"missing_evidence": []},
            _SLOP | {"change_scope": "none"},
            _SLOP | {"contract_status": "required"},
            _SLOP | {"evidence": []},
            _SLOP | {"evidence": [{"start_line": 2, "end_line": 1, "quote": "x"}]},
        ]
    )
)
REVIEWED = [
    (0, "clean", "preserved", None),
    (1, "slop", "preserved", None),
    (2, "unresolved", "unknown", None),
    (3, None, "", "missing tier"),
    (4, "bad", "known", "invalid tier"),
    (5, "clean", "preserved", "missing text"),
    (6, "clean", "preserved", "unknown pattern"),
    (7, "slop", "known", "invalid behavior"),
    (8, "clean", "preserved", "invalid contract"),
    (9, "clean", "preserved", "invalid missing_evidence"),
    (10, "clean", "preserved", "pattern does not suit the tier"),
    (11, "clean", "preserved", "clean without proof"),
    (12, "clean", "preserved", "clean without proof"),
    (13, "unresolved", "unknown", "unresolved without cause"),
    (14, "slop", "preserved", "invalid scope"),
    (15, "slop", "preserved", "finding without proof"),
    (16, "slop", "preserved", "finding without evidence"),
    (17, "slop", "preserved", "invalid evidence"),
]

BODIES = [
    (1, json.dumps({"choices": [{"message": {"content": '```json\n{"tier": "clean"}\n```'}}]}), "HTTP 429 slow down"),
    (2, json.dumps({"content": [{"type": "text", "text": "So: "}, {"type": "text", "text": '{"role": "x",'}]}), "HTTP 401 no"),
    (3, json.dumps({"output": [{"content": [{"text": '{"n": {"verdict": "v"}} tail'}]}]}), "No JSON object found"),
    (4, json.dumps({"output_text": " "}), "HTTP 503"),
    (5, "not json", "Connection reset"),
]
CONTENTS = [
    (1, '```json\n{"tier": "clean"}\n```', '{"tier":"clean"}', "wait_and_retry"),
    (2, 'So: {"role": "x",', '{"role":"x"}', "fatal"),
    (3, '{"n": {"verdict": "v"}} tail', '{"verdict":"v"}', "retry_same_prompt"),
    (4, None, None, "wait_and_retry"),
    (5, None, None, "wait_and_retry"),
]

_CODE = "def f(x):\n    y = x + 1\n    if y:\n        y = x + 1\n    return [ y,\n        2 ]"
QUOTES = [
    (1, _CODE, 10, 11, 11, "y = x + 1"),
    (2, _CODE, 10, 10, 10, "return [ y"),
    (3, _CODE, 10, 10, 10, "y = x + 1"),
    (4, _CODE, 10, 10, 10, "return [y, 2]"),
    (5, _CODE, 10, 10, 10, "absent"),
    (6, _CODE, 10, 14, 15, "return [y,2]"),
    (7, _CODE, 10, 10, 99, "if y"),
    (8, _CODE, 10, 10, 10, " "),
    (9, _CODE, 10, 10, 10, "y=x+1"),
]
LOCATED = [(1, 11, 11, "declared"), (2, 14, 14, "unique"), (3, None, None, "ambiguous"), (4, 14, 15, "unique without spaces"), (5, None, None, "absent"), (6, 14, 15, "declared"), (7, 12, 12, "unique"), (8, None, None, "absent"), (9, None, None, "ambiguous")]

ARTIFACTS = [("x1", "a/b", "r1"), ("x2", "a/b", "r2"), ("x3", "a/b", "r2"), ("x4", "q/q", "r9")]
GROUPS = [("a/b", "r1"), ("a/b", "r2"), ("c/d", "r3"), ("c/d", "r3")]
GROUPED = [("a/b", "r1", "x1", "assigned"), ("a/b", "r2", None, "duplicate"), ("c/d", "r3", None, "missing"), ("q/q", "r9", None, "unknown")]

LICENSES = [
    ("LICENSE", "license", 10000),
    ("Unlicence.TXT", "license_preferred_extension", 9500),
    ("COPYING", "copying", 9000),
    ("copying.md", "copying_preferred_extension", 8500),
    ("license.rst", "license_other_extension", 8000),
    ("license.spdx", None, None),
    ("COPYING.v2.1", "copying_any_extension", 7500),
    ("LICENSE-MIT", "license_descriptor", 7000),
    ("LICENSE-MIT.go", None, None),
    ("copying_lesser.txt", "copying_descriptor", 6500),
    ("mit-license.txt", "prefixed_license", 6000),
    ("gpl_copying", "prefixed_copying", 5500),
    ("ofl.md", "ofl_preferred_extension", 5000),
    ("OFL", "ofl", 4000),
    ("copyright.html", "copyright_preferred_extension", 3000),
    ("copyright-notice", "copyright_descriptor", 2000),
    ("PATENTS", "patents", 1500),
    ("patents.txt", "patents_other_extension", 1000),
    ("src/LICENSE", None, None),
    ("LICENSES/MIT.txt", "licenses_identifier", 10000),
    ("LICENSES/LicenseRef-Own-1.md", "licenses_reference", 10000),
    ("LICENSES/a/MIT.txt", None, None),
    ("readme.md", None, None),
]

LINKED_CASES = [("a", "s1"), ("b", "s2"), ("c", "s3"), ("d", "s4"), ("e", "s4"), ("f", "s5"), ("g", "s6"), ("h", "s7")]
CASE_UNITS = [("a", "u1"), ("b", "u1"), ("b", "u2"), ("c", "u2"), ("d", "u3"), ("f", "u4"), ("g", "u5"), ("h", "u6")]
CASE_EDGES = [("u4", "u5"), ("u6", "u9")]
COMPONENTS = [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f"), ("g", "f"), ("h", "h")]

CALLS = [("b", "a"), ("d", "a"), ("c", "b"), ("a", "b"), ("e", "d"), ("f", "e"), ("b", "d"), ("a", "a")]
# above a in the order of a walk: b, then c over b; d, then b again and e over d
UPSTREAM = [("a", 1, "b", 1), ("a", 2, "c", 2), ("a", 3, "d", 1), ("a", 4, "e", 2)]
NEIGHBOURS = [("a", "a,b,d", "a,b"), ("b", "a,c", "a,d"), ("f", "", "e"), ("z", "", "")]

EDGE_METHODS = [("u1", "a", 1, 10), ("u2", "a", 3, 5), ("u3", "b", 1, 4)]
EDGE_DEFS = [("go", "u3"), ("two", "u1"), ("two", "u2"), ("in", "u2")]
EDGE_REFS = [("a", 4, "go"), ("a", 8, "go"), ("a", 9, "go"), ("a", 9, "two"), ("a", 9, "none"), ("b", 2, "in"), ("b", 9, "in")]
EDGES = [("u2", "u3", 2, 1), ("u1", "u3", 2, 1), ("u3", "u2", 2, 1)]

MERGES = [("a", "merge", "b"), ("b", "merge", "c"), ("c", "keep", None), ("d", "merge", "e"), ("e", "discard", None), ("f", "merge", "g"), ("g", "merge", "f"), ("h", "merge", "zz")]
MERGED = [("a", "c", "resolved"), ("b", "c", "resolved"), ("d", "e", "ends in a case that is discard"), ("f", None, "cycle"), ("g", None, "cycle"), ("h", "zz", "ends in a case that is unknown")]

CAPTURED = [("r1", "a1\0Add it\0b2\0Fix, again\0"), ("r2", "c3\0Only\0"), ("r3", "")]
LOGGED = [("r1", 2, "Fix, again"), ("r2", 1, "Only")]

IGNORE = ["# out", "*.min.js", "/build/", "logs/", "!logs/keep.py", "a/**/z.py"]
# path, production code, test, left out
PATHS = [
    ("src/a.py", True, False, False),
    ("src/a_test.go", False, True, False),
    ("testing/b.rs", False, True, False),
    ("node_modules/x.ts", False, False, False),
    ("Dist/x.ts", False, False, False),
    ("a.min.js", True, False, True),
    ("build/x.py", True, False, True),
    ("src/build/x.py", True, False, False),
    ("logs/x.py", True, False, True),
    ("logs/keep.py", True, False, False),
    ("a/b/c/z.py", True, False, True),
    ("a/z.py", True, False, True),
    ("readme.md", False, False, False),
]

# ---- compiler indexes


def _number(n: int) -> bytes:
    n, out = n & ((1 << 64) - 1), b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(raw)) + raw


def _occurrence(span: list[int], symbol: str, roles: int) -> bytes:
    return _field(1, b"".join(map(_number, span))) + _field(2, symbol) + _field(3, roles)


def indexes() -> list[tuple[str, bytearray]]:
    own = _field(1, "./src\\a.go") + _field(4, "go") + _field(3, _field(1, "pkg/F().") + _field(3, "Does it.") + _field(3, "Well."))
    for span, roles in (([3, 5, 6], 1), ([3, 5, 4, 2], 10), ([3, 5], 0), ([4, 5, 3, 9], 8), ([-1, 0, 1], 8), ([1, 2, 3], 128)):
        own += _field(2, _occurrence(span, "pkg/F().", roles))
    good = _field(1, _field(1, 3)) + _field(2, own) + _field(3, _field(1, "ext/G().") + _field(6, "G"))
    return [("good", bytearray(good)), ("cut", bytearray(good[:40])), ("outside", bytearray(_field(2, _field(1, "../x.go")))), ("large", bytearray(2000))]


INDEXED = [
    ("document", "src/a.go", None, None),
    ("symbol", "src/a.go", "pkg/F().", "Does it.|Well."),
    ("occurrence", "src/a.go", "pkg/F().", "3:5:3:6 definition"),
    ("occurrence", "src/a.go", "pkg/F().", "3:5:4:2 import+read"),
    ("occurrence", "src/a.go", "pkg/F().", "range must have 3 or 4 numbers "),
    ("occurrence", "src/a.go", "pkg/F().", "inverted range read"),
    ("occurrence", "src/a.go", "pkg/F().", "negative coordinate read"),
    ("occurrence", "src/a.go", "pkg/F().", "1:2:1:3"),
    ("external", None, "ext/G().", "G"),
    ("error", None, None, "broken index: a field is cut"),
    ("error", None, None, "document path '../x.go'"),
    ("error", None, None, "index of 2000 bytes is over 1000"),
]

# ---- a shard of pull requests

_OLD = "diff --git a/src/app.py b/src/app.py\n--- a/src/app.py\n+++ b/src/app.py\n@@ -1,4 +1,2 @@\n context\n-one\n-two\n-\n+three\n"
_MIXED = _OLD + "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1 +0,0 @@\n-x\n"
_GROWS = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1 +1,2 @@\n-x\n+y\n+--- z\n"
_TEXT = "diff --git a/x.md b/x.md\n--- a/x.md\n+++ b/x.md\n@@ -1 +0,0 @@\n-x\n"
_GONE = "diff --git a/y.rs b/y.rs\n--- a/y.rs\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y\n"


def _pull(patch, repo="own/name", commit="A" * 40, number=1, created="2026-01-01", instance="i", license_="MIT"):
    return (commit, created, instance, license_, patch, repo, number, *(["x"] * 9))


def shard_rows() -> list[tuple]:
    return [
        _pull(_OLD),
        _pull(_MIXED, number=2),
        _pull(_GROWS, number=3),
        _pull(_TEXT, number=4),
        _pull("no hunk", number=5),
        _pull(_GONE, number=6),
        _pull(_GONE, number=1),
        _pull(_OLD, number=7, instance=" "),
        _pull(_OLD, repo="bad", number=8),
        _pull(_OLD, commit="abc", number=9),
        _pull(_OLD, number=0),
        _pull(_OLD, number=10, created=""),
        _pull(_OLD, number=11, license_=None),
        _pull(_OLD.replace("b/src/app.py\n@@", "b/../app.py\n@@"), number=12),
    ]


FRAMED = [
    (0, "python", 1, 2, None, True),
    (1, "go", 1, 3, "multiple_supported_languages", True),
    (2, "go", 2, 1, "no_net_supported_language_reduction", True),
    (3, None, 0, 0, "no_supported_language", True),
    (4, None, 0, 0, "malformed_patch", True),
    (5, "rust", 0, 2, None, True),
    (6, "rust", 0, 2, "duplicate_pull_request", True),
    (7, "python", 1, 2, "empty_instance_id", True),
    (8, "python", 1, 2, "invalid_repository", False),
    (9, "python", 1, 2, "invalid_base_revision", False),
    (10, "python", 1, 2, "invalid_pull_number", True),
    (11, "python", 1, 2, "empty_created_at", True),
    (12, "python", 1, 2, "empty_license", True),
    (13, "python", 1, 2, "malformed_patch", True),
]
HUNKED = [(1, "--- a\n+++ b\n@@ -1,4 +2 @@ def x\n-a\n@@ -10 +11,0 @@\n@@ broken @@"), (2, "nothing")]
HUNKS = [(1, 2, 1, 4, 2, 1), (1, 4, 10, 1, 11, 0)]
