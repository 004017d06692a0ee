"""Operators on literal rows."""

import json
import random
from functools import reduce
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import hashing, json_text, shape, text
from tallyforge.functions import text as T
from tallyforge.operators import aggregates, graph, joins, ranking, release, scoring, similarity, symbols
from tallyforge.sources import extract, frames, patches, sinks
from tallyforge.streaming import journal as streams


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_lines_and_paths(spark):
    assert one(spark, "a\r\nb\n", text.lines) == ["a", "b"] and one(spark, "", text.lines) == []
    assert one(spark, "a/./b/../c//d", text.lexical_path) == "a/c/d" and one(spark, "../a/..", text.lexical_path) == ".." and one(spark, "/../x", text.lexical_path) == "/x"
    assert one(spark, "HTTPServerName2Go", text.snake_case) == "http_server_name2_go"
    roles = {"examples/a.py": "example", "x/tests/a.py": "test", "src/main.rs": "entrypoint", "a/http_util.py": "adapter", "src/lib.rs": "library", "readme": "mixed", "docs/a.md": "docs", "x/gen/a.go": "generated", "a/vite.config.ts": "adapter"}
    for path, want in roles.items():
        assert one(spark, path, text.role) == want, path
    assert one(spark, "https://github.com/Own/Name.git", text.repository_identity) == "own/name" and one(spark, "https://x.org/a/b", text.repository_identity) is None
    assert one(spark, "a/../b", text.safe_relative) is False and one(spark, "a/b", text.safe_relative) is True


def test_tokens_and_secrets(spark):
    assert one(spark, 'x = foo("a\\"b", 12) // c\n/* d */ y != `z`', text.code_tokens) == ["ID", "=", "ID", "(", "STR", ",", "NUM", ")", "ID", "!=", "STR"]
    assert one(spark, "a b c d e f", lambda c: text.shingles(F.split(c, " "))) == ["a b c d e", "b c d e f"]
    kinds = {"ghp_" + "a" * 20: "GitHub token", "password = 'abcdefghijklmnopqrstu'": "credential-like assignment", "password = os.environ['x']": None, "-----BEGIN RSA PRIVATE KEY-----": "private key", "xghp_" + "a" * 20: None}
    for line, want in kinds.items():
        assert one(spark, line, text.secret_kind) == want, line


def test_evidence(spark):
    df = spark.createDataFrame([("a\nb\nc", 1, 2, "a\nb"), ("a\nb\nc", 1, 2, "a"), ("a\nb\nc", 2, 2, "c"), ("a", 0, 1, "a")], "s string, b int, e int, q string")
    assert [r[0] for r in df.select(text.evidence_valid(F.col("s"), F.col("b"), F.col("e"), F.col("q"))).collect()] == [True, False, False, False]


PATCHES = {
    "reduce": ("diff --git a/src/app.py b/src/app.py\n--- a/src/app.py\n+++ b/src/app.py\n@@ -1,3 +1,1 @@\n-a\n-b\n-c\n+d\n", "python", 1, 3, None),
    "mixed": ("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\ndiff --git a/y.go b/y.go\n--- a/y.go\n+++ b/y.go\n@@ -1 +1 @@\n-b\n", "go", 0, 2, "multiple_supported_languages"),
    "grow": ("--- a/x.rs\n+++ b/x.rs\n@@ -1 +1,2 @@\n-a\n+b\n+c\n", "rust", 2, 1, "no_net_supported_language_reduction"),
    "outside": ("--- a/../x.rs\n+++ b/x.rs\n@@ -1 +1 @@\n-a\n", "rust", 0, 1, "malformed_patch"),
    "no_hunk": ("--- a/x.rs\n+++ b/x.rs\n", None, 0, 0, "malformed_patch"),
    "prose": ("--- a/x.md\n+++ b/x.md\n@@ -1 +1 @@\n-a\n", None, 0, 0, "no_supported_language"),
    "removed": ("--- a/x.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n--- b\n", "python", 0, 2, None),
}


def test_patches(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in PATCHES.items()], "id string, patch string")
    found = {r["id"]: r for r in patches.patch_facts(df, "id").collect()}
    for k, (_, language, added, deleted, reason) in PATCHES.items():
        assert (found[k]["language"], found[k]["added"], found[k]["deleted"], found[k]["patch_reason"]) == (language, added, deleted, reason), k
    ranges = patches.hunk_ranges(df.where("id = 'reduce'"), "id").first()
    assert tuple(ranges)[2:] == (1, 3, 1, 1)


def test_pr_frame(spark, tmp_path):
    good = PATCHES["reduce"][0]
    rows = [(k, "2024", f"i{k}", "MIT", good, "Own/Repo", pull) for k, pull in (("a" * 40, 1), ("b" * 40, 1), ("c" * 40, 0))]
    df = spark.createDataFrame(rows, "base_commit string, created_at string, instance_id string, license string, patch string, repo string, pull_number long")
    for c in patches.OTHERS:
        df = df.withColumn(c, F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = patches.read_shards(spark, [str(tmp_path / "s")])
    f = {r["shard_row"]: r["reason"] for r in patches.frame(got, "c", "s").collect()}
    assert f == {0: None, 1: "duplicate_pull_request", 2: "invalid_pull_number"} or list(f.values()).count(None) == 1
    assert patches.payload(spark, [str(tmp_path / "s")], got.where("shard_row = 1"), ["test_patch"]).count() == 1
    df.drop("meta").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        patches.read_shards(spark, [str(tmp_path / "t")])


def test_repository_list(spark, tmp_path):
    (tmp_path / "f.csv").write_text("repo,metadata\nhttps://github.com/A/b,1,2\n\nnone\nhttps://github.com/a/B,x\nfoo,1\n")
    got = [(r["line_number"], r["repository"], r["reason"]) for r in frames.repository_list(spark, str(tmp_path / "f.csv")).orderBy("line_number").collect()]
    assert got == [(2, "a/b", None), (4, None, "malformed_record"), (5, "a/b", "duplicate_repository_identity"), (6, None, "invalid_repository_identity")]


def test_pages(spark):
    item = lambda k: {"id": k, "full_name": f"a/{k}", "fork": False}
    page = lambda total, *ids: json.dumps({"total_count": total, "incomplete_results": False, "items": [item(k) for k in ids]})
    raw = spark.createDataFrame([("q", 1, 2, page(3, 1, 2)), ("q", 2, 2, page(3, 3)), ("r", 1, 2, page(5, 9))], "query string, page int, per_page int, response string")
    items, complete = frames.pages(raw)
    assert items.count() == 4 and {r["query"]: r["complete"] for r in complete.collect()} == {"q": True, "r": False}


def test_journal(spark, tmp_path):
    event = lambda unit, status, **more: json.dumps({"version": 1, "scan_id": "s", "stage": "method", "unit_id": unit, "status": status, "source_hash": "h", "context_hash": "c"} | more)
    path = tmp_path / "j.jsonl"
    path.write_text("\n".join([event("u1", "retry", retry_on_resume=True), event("u1", "done"), event("u2", "bad", retry_on_resume=True)]) + '\n{"version": 1, "sc')
    events = frames.journal(spark, str(path))
    assert {r["unit_id"]: r["status"] for r in frames.latest(events).collect()} == {"u1": "done", "u2": "bad"}
    wanted = spark.createDataFrame([(u, "method", "h", "c") for u in ("u1", "u2", "u3")], "unit_id string, stage string, source_hash string, context_hash string")
    done, left = frames.reusable(wanted, events, 1)
    assert [r[0] for r in done.collect()] == ["u1"] and sorted(r[0] for r in left.collect()) == ["u2", "u3"]
    path.write_text("not json\n" + event("u1", "done") + "\n")
    with pytest.raises(Exception):
        frames.journal(spark, str(path)).collect()


def test_salvage():
    assert json_text.salvage('Sure! ```json\n{"tier": "clean"}\n``` bye') == '{"tier":"clean"}'
    assert json_text.salvage('[{"x": 1}, {"tier": "a"}]') == '{"x":1}'
    assert json_text.salvage('{"tier": "a\nb", "reason": "c:\\d"}') == '{"tier":"a\\nb","reason":"c:\\\\d"}'
    assert json_text.salvage('{"tier": "slop", "evidence": ["a", "b') == '{"tier":"slop","evidence":["a","b"]}'
    assert json_text.salvage("none") is None and json_text.salvage(None) is None
    assert json_text.salvage('{"data": {"verdict": 1}}') == '{"verdict":1}'


def test_retry(spark):
    want = {"HTTP 401: no": "fatal", "HTTP 503: busy": "wait_and_retry", "No JSON object found": "retry_same_prompt", "reset": "wait_and_retry"}
    for error, kind in want.items():
        assert one(spark, error, json_text.retry_class) == kind


FILES = [
    ("pkg/a.py", "python", "from .b import helper\nimport pkg.c as c\n\ndef run(x, *, y=1):\n    helper(x)\n    return c.other(y)\n\nclass K:\n    def _m(self):\n        run(1)\n"),
    ("pkg/b.py", "python", "def helper(x):\n    return x\n\ndef lonely():\n    return 1\n"),
    ("pkg/c.py", "python", "def other(y):\n    return y\n"),
    ("x.go", "go", 'package x\nfunc (s *S) Do(a int, b int) {\n  if true { f("}") } // }\n}\nfunc low() {}\n'),
    ("y.rs", "rust", "pub fn a(x: u8) -> u8 {\n  x\n}\nfn b() {}\n"),
    ("z.ts", "typescript", "export function f(a) {\n  return a\n}\nconst g = (x) => {\n  return x\n}\n"),
    ("k.kt", "kotlin", "private fun p(a: Int) {\n}\nfun q() {}\n"),
]


def test_extraction_and_references(spark):
    files = spark.createDataFrame(FILES, "file_path string, language string, source string")
    m = extract.methods(files)
    got = {(r["file_path"], r["name"]): r for r in m.collect()}
    assert got["pkg/a.py", "run"]["param_count"] == 2 and got["pkg/a.py", "_m"]["owner"] == "K" and not got["pkg/a.py", "_m"]["is_exported"]
    assert got["x.go", "Do"]["owner"] == "S" and got["x.go", "Do"]["end_line"] == 4 and got["x.go", "Do"]["is_exported"] and not got["x.go", "low"]["is_exported"]
    assert got["y.rs", "a"]["is_exported"] and got["y.rs", "a"]["loc"] == 3 and not got["y.rs", "b"]["is_exported"]
    assert got["z.ts", "f"]["is_exported"] and got["z.ts", "g"]["end_line"] == 6 and not got["k.kt", "p"]["is_exported"]
    resolved = symbols.resolve_calls(extract.symbols(files), files)
    by_name = {r["name"]: (r["rule_no"], r["target"]) for r in resolved.collect()}
    assert by_name["helper"] == (2, "pkg/b.py::helper") and by_name["other"] == (3, "pkg/c.py::other") and by_name["run"] == (1, "pkg/a.py::run")
    refs = symbols.references(resolved, m)
    assert {(r["target"], r["caller"]) for r in refs.collect()} == {("pkg/b.py::helper", "run"), ("pkg/c.py::other", "run"), ("pkg/a.py::run", "_m")}
    python = m.where("language = 'python'")
    flags = {r["method_name"]: r["reasons"] for r in scoring.reference_flags(python, shape.module_kinds(files, python), symbols.reference_counts(refs, python)).collect()}
    assert flags == {"lonely": ["orphaned export (never referenced)"]}


def test_components_and_chains(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4), (7, 1)], "n int, t int")
    chains = {x["n"]: (x["end"], x["status"]) for x in graph.resolve_chain(links, "n", "t").collect()}
    assert chains == {1: (3, "resolved"), 2: (3, "resolved"), 7: (3, "resolved"), 4: (None, "cycle"), 5: (None, "cycle"), 6: (None, "cycle")}
    exports = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", "z"), ("d", "q", "d", "q")], "file string, name string, to_file string, to_name string")
    ends = {x["file"]: (x["end_file"], x["end_name"]) for x in graph.follow_exports(exports, exports.select("file", "name")).collect()}
    assert ends == {"a": ("c", "z"), "b": ("c", "z"), "d": ("d", "q")}


def test_greedy_slots(spark):
    r = random.Random(6)
    rows = [(k, f"r{r.randrange(25)}", r.choice("abc"), r.random()) for k in range(300)]
    got = ranking.greedy_slots(spark.createDataFrame(rows, "id int, repo string, lang string, rank double"), "repo", "lang", "rank", 5).collect()
    taken, filled, want = set(), {}, set()
    for k, repo, lang, _ in sorted(rows, key=lambda x: x[3]):
        if repo not in taken and filled.get(lang, 0) < 5:
            taken.add(repo)
            filled[lang] = filled.get(lang, 0) + 1
            want.add((k, filled[lang]))
    assert {(x["id"], x["slot"]) for x in got} == want


def test_overlaps_of_any_length(spark):
    r = random.Random(12)

    def some(n):
        starts = [r.randrange(-5000, 5000) for _ in range(n)]
        return [(r.choice(["hot"] * 5 + ["a", None]), k, None if k == 0 else s, s + r.choice([-1, 0, 1, 7, 64, 100_000])) for k, s in enumerate(starts)]

    a, b = some(150), some(170)
    left, right = spark.createDataFrame(a, "g string, i int, s long, e long"), spark.createDataFrame(b, "g string, j int, x long, y long")
    want = sorted((i, j) for g, i, s, e in a for h, j, x, y in b if g and g == h and None not in (s, x) and s <= e and x <= y and s <= y and x <= e)
    got = joins.overlapping(left, right, ["g"], ("s", "e"), ("x", "y"))
    assert got.columns == ["g", "i", "s", "e", "j", "x", "y"]
    assert sorted((v["i"], v["j"]) for v in got.collect()) == want
    assert joins.overlapping(left.limit(0), right, ["g"], ("s", "e"), ("x", "y")).collect() == []
    points = spark.createDataFrame([(k, g, s) for g, k, s, _ in a], "point_id int, g string, at long")
    plain = joins.enclosing_interval(points, right, ["g"], "at", "x", "y", ["j"])
    for width in (1, 100):
        placed = joins.enclosing_interval(points, right, ["g"], "at", "x", "y", ["j"], bin_width=width)
        assert placed.columns == plain.columns
        assert sorted(placed.collect(), key=repr) == sorted(plain.collect(), key=repr) and placed.count() == len(a)


def test_chain_ends(spark):
    r = random.Random(8)
    links = {k: r.randrange(130) for k in range(110)}  # ways into cycles of any length, and ends from 110 on
    links |= {k: k + 1 for k in range(1000, 1400)} | {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2003}
    rows = [*links.items(), (5, links[5] + 50), (7, None), (None, 3)]
    got = {x["n"]: (x["end"], x["hops"], x["status"]) for x in graph.chain_ends(spark.createDataFrame(rows, "n int, t int"), "n", "t").collect()}
    assert set(got) == set(links)
    for k in links:
        at, seen = k, {k}
        while at in links and links[at] not in seen:
            at = links[at]
            seen.add(at)
        assert got[k] == (at, len(seen) - 1, "cycle" if at in links else "resolved")
    assert graph.chain_ends(spark.createDataFrame([], "n int, t int"), "n", "t").collect() == []
    resolved = {x["n"]: x["end"] for x in graph.resolve_chain(spark.createDataFrame([x for x in links.items() if x[0] >= 1396], "n int, t int"), "n", "t").collect()}
    assert resolved[1396] == 1400 and resolved[2000] is None and resolved[2003] is None


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 100_000, []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or kept(df, name))
    links = spark.range(n).select(F.col("id").alias("n"), (F.col("id") + 1).alias("t"))
    assert graph.chain_ends(links, "n", "t").where(F.col("end") == n).agg(F.count("*"), F.max("hops")).first() == (n, n)
    assert len(tables) <= 24  # the links, the first pointers, a table a round, and the ended rows kept twice


def _greedy(rows, slots):
    taken, filled, want = set(), {}, set()
    for k, repo, lang, _ in sorted(rows, key=lambda x: x[3]):
        if repo not in taken and filled.get(lang, 0) < slots:
            taken.add(repo)
            filled[lang] = filled.get(lang, 0) + 1
            want.add((k, filled[lang]))
    return want


def test_greedy_slot_rounds(spark):
    schema = "id int, repo string, lang string, rank double"
    for seed, repos, langs, slots in [(1, 60, "abcde", 4), (2, 4, "abc", 3), (3, 200, "ab", 1)]:
        r = random.Random(seed)
        rows = [(k, r.choice([None, *(f"r{i}" for i in range(repos))]), r.choice([None, *langs]), r.random()) for k in range(500)]
        got, rounds = ranking.greedy_slot_rounds(spark.createDataFrame(rows, schema), "repo", "lang", "rank", slots)
        assert {(x["id"], x["slot"]) for x in got.collect()} == _greedy(rows, slots)
        assert rounds <= 6
    # every repository waits for the one before it: with one slot a language, each round settles one more
    chain = [(2 * k + j, f"r{k + j}", f"l{k}", 2.0 * k + j) for k in range(5) for j in (0, 1)]
    got, rounds = ranking.greedy_slot_rounds(spark.createDataFrame(chain, schema), "repo", "lang", "rank", 1)
    assert {(x["id"], x["slot"]) for x in got.collect()} == _greedy(chain, 1)
    assert rounds <= 6
    empty, rounds = ranking.greedy_slot_rounds(spark.createDataFrame([], schema + ", taken int, place int"), "repo", "lang", "rank", 2)
    assert empty.collect() == [] and rounds == 0
    clash = spark.createDataFrame([(1, "r", "a", 0.5, 7, 8)], schema + ", taken int, place int")
    assert [tuple(x) for x in ranking.greedy_slots(clash, "repo", "lang", "rank", 2).collect()] == [(1, "r", "a", 0.5, 7, 8, 1)]


def test_batches_of_parts(spark):
    r = random.Random(4)
    groups = {"hot": 300, None: 60, "whole": 16, "one": 1, "short": 17}
    rows = [(g, k, r.choice([0, 1, 2, 3, 5, 9, 30, None]), "x") for g, n in groups.items() for k in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, k int, chars int, part string")
    for most, budget, part_rows in [(3, 10, 16), (8, 12, 8), (5, 1000, 16), (4, 0, 64), (3, 10, 4096)]:
        got = {(x["file"], x["k"]): (x["batch"], x["part"]) for x in ranking.greedy_batches(df, "file", ["k"], "chars", most, budget, part_rows).collect()}
        assert len(got) == len(rows)
        for g in groups:
            batch, n, used = 1, 0, 0
            for _, k, chars, _ in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
                if n and (n == most or used + (chars or 0) > budget):
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + (chars or 0)
                assert got[g, k] == (batch, "x"), (most, budget, part_rows, g, k)
    assert ranking.greedy_batches(df.limit(0), "file", ["k"], "chars", 3, 10).collect() == []


def test_batches(spark):
    rows = [("f", 1, 5), ("f", 2, 6), ("f", 3, 1), ("f", 4, 1), ("f", 5, 1), ("f", 6, 30), ("g", 1, 1)]
    got = ranking.greedy_batches(spark.createDataFrame(rows, "file string, k int, chars int"), "file", ["k"], "chars", 3, 10).collect()
    assert sorted((r["file"], r["k"], r["batch"]) for r in got) == [("f", 1, 1), ("f", 2, 2), ("f", 3, 2), ("f", 4, 2), ("f", 5, 3), ("f", 6, 4), ("g", 1, 1)]


def test_jaccard(spark):
    r = random.Random(9)
    sets = [(k, sorted({r.randrange(40) for _ in range(r.randint(0, 12))})) for k in range(120)]
    sets += [(200 + k, sorted(set(s) ^ {r.randrange(40)})) for k, s in sets[:60]]
    got = {(x["later"], x["earlier"]) for x in similarity.jaccard_pairs(spark.createDataFrame(sets, "id int, s array<int>"), "id", "s", 0.8).collect()}
    first: dict = {}
    for k, s in sets:
        first.setdefault(tuple(s), k)
    nodes = [(k, set(s)) for s, k in first.items() if s]
    want = {(max(a, b), min(a, b)) for i, (a, x) in enumerate(nodes) for b, y in nodes[:i] if len(x & y) >= 0.8 * len(x | y)}
    assert got == want


def test_votes_gates_costs(spark):
    votes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "u string, v string")
    assert {r["u"]: (r["verdict"], r["tie"]) for r in aggregates.majority(votes, "u", "v").collect()} == {"a": ("x", False), "b": ("unresolved", True)}
    cases = spark.createDataFrame([("p", "slop", "slop"), ("p", "kinda_slop", "slop"), ("p", "clean", "clean")], "lang string, expected_tier string, predicted_tier string")
    total = aggregates.metrics(cases, ["lang"]).where("lang is null").first()
    assert (total["slop_tp"], total["finding_tp"], total["false_positives"], total["slop_precision"], total["finding_recall"]) == (1, 2, 0, 0.5, 1.0)
    cost = spark.range(1).select(aggregates.token_cost(F.lit(1000000), F.lit(2000000), F.lit(1000000))).first()[0]
    assert cost == pytest.approx(0.0028 + 0.28)


def test_joins(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 5)], "point_id int, file string, line int")
    spans = spark.createDataFrame([("f", "outer", 1, 20), ("f", "inner", 4, 8), ("f", "late", 5, 9)], "file string, name string, a int, b int")
    for width in (None, 4):
        got = {r["point_id"]: r["name"] for r in joins.enclosing_interval(points, spans, ["file"], "line", "a", "b", bin_width=width).collect()}
        assert got == {1: "late", 2: None, 3: None}
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "a int, b int")
    assert [tuple(r) for r in joins.not_reciprocal(edges, "a", "b").collect()] == [(3, 1)]
    status = joins.ledger(edges.select("a"), edges.select(F.col("b").alias("a")), "a")
    with pytest.raises(ValueError, match="3: missing"):
        joins.require_complete(status, "a")


def test_hashes(spark):
    row = spark.sql("select 'a' a, cast(null as string) b").select(hashing.canonical_json(F.col("a"), F.col("b")).alias("j")).first()
    assert row["j"] == '{"a":"a","b":null}'
    both = [spark.createDataFrame([(x,) for x in order], "h string").agg(hashing.set_commitment(F.col("h"))).first()[0] for order in ("ab", "ba")]
    assert both[0] == both[1]


def test_streams(spark, tmp_path):
    schema = "user string, seq long, ts timestamp, kind string"
    rows = [("u", k, f"2024-01-01 00:{k:02d}:00", "a" if k % 2 else "b") for k in range(20)]
    df = spark.createDataFrame(rows, "user string, seq long, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest = streams.LatestTable("kind", "seq", str(tmp_path / "latest"))

    def run(table):
        table.attach(stream).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
        return {r["kind"]: r["seq"] for r in table.table(spark).collect()}

    assert run(latest) == {"a": 19, "b": 18}
    # a new object on the same checkpoint goes on with all keys
    spark.createDataFrame([("u", 30, "c")], "user string, seq long, kind string").withColumn("ts", F.lit(None).cast("timestamp")).select("user", "seq", "ts", "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run(streams.LatestTable("kind", "seq", str(tmp_path / "latest"))) == {"a": 19, "b": 18, "c": 30}
    latest.merge(spark.createDataFrame([("u", 30, None, "c")], schema), max(int(x.name) for x in (tmp_path / "latest").iterdir()))  # a batch that comes again
    assert {r["kind"]: r["seq"] for r in latest.table(spark).collect()} == {"a": 19, "b": 18, "c": 30}
    stream = stream.where("ts is not null")
    q = streams.windowed_counts(stream, "ts", "kind", "5 minutes", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in streams.windowed_counts(df, "ts", "kind", "5 minutes", "1 hour").collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want and len(want) == 8


def test_stage_chain(spark):
    rows = [(1, 1, "payload", "a", None, False), (1, 2, "materialization", "b", "a", False), (2, 1, "payload", "c", None, True), (2, 2, "materialization", "d", "c", False), (3, 1, "payload", "e", "x", False)]
    df = spark.createDataFrame(rows, "slot int, seq int, stage string, sha string, previous_sha string, terminal boolean")
    assert {(r["slot"], r["error"]) for r in streams.stage_errors(df).collect()} == {(2, "event after the end"), (3, "previous hash differs")}


def test_tree_commitment(spark):
    import hashlib

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    digests = [sha(str(k)) for k in range(300)]
    df = spark.createDataFrame([(d,) for d in digests], "h string")
    level = {d: d for d in digests}
    for length in (4, 2, 0):
        groups = {}
        for prefix, line in level.items():
            groups.setdefault(prefix[:length], []).append(line)
        level = {prefix: f"{prefix}:{sha(chr(10).join(sorted(lines)))}" for prefix, lines in groups.items()}
    want = level[""][1:]
    for some in (df, df.repartition(7), df.orderBy("h")):
        assert tuple(hashing.tree_commitment(some, "h").first()) == (300, want)
    assert hashing.tree_commitment(df.where("h <> ''").limit(299), "h").first()[1] != want
    assert tuple(hashing.tree_commitment(df.limit(0), "h").first()) == (0, sha(""))


def test_admitted_units(spark):
    rows = [("s", k, None if k == 3 else k) for k in range(50)] + [("t", 1, 5)]
    got = release.admitted_units(spark.createDataFrame(rows, "scan string, k int, cents long"), ["scan"], ["k"], "cents", 20).collect()
    want = {("s", k): sum(x for x in range(k) if x != 3) for k in range(50)} | {("t", 1): 0}
    assert {(r["scan"], r["k"]): (r["units_before"], r["admitted"]) for r in got} == {key: (n, n < 20) for key, n in want.items()}


def test_entry_stands_alone():
    import __spark_entry__

    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and "near_duplicates" in q


def test_ranks_over_many_partitions(spark):
    n = 1_000_000  # enough rows for several parts of the sort
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 1000003).alias("k"), F.lit("x").alias("part"), F.lit(1).alias("at"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, coalesced in (("64", "true"), ("64", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        ranked = ranking.with_rank(rows, F.sha2(F.col("k").cast("string"), 256), "id")
        # the digests in rank order rise, and ranks are 1 to n, each once
        r = ranked.agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("d"), F.count_distinct("id").alias("ids")).first()
        assert tuple(r) == (n, 1, n, n, n) and ranked.columns == ["id", "k", "part", "at", "digest", "rank"]
        some = ranked.where("rank <= 2000 or rank > 998000").select("rank", "digest").orderBy("rank").collect()
        assert [x["digest"] for x in some] == sorted(x["digest"] for x in some)
        exact = rows.select("id", F.sha2(F.col("k").cast("string"), 256).alias("digest")).orderBy("digest", "id").limit(50).collect()
        assert [x["id"] for x in exact] == [x["id"] for x in ranked.where("rank <= 50").orderBy("rank").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError, match="population has 3"):
        ranking.hash_rank(spark.range(3), "c", "s", ["id"], 10)


def test_long_paths_are_followed(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.reachable(path, "a", "b", spark.range(1).select(F.col("id").alias("root"))).collect()
    assert sorted((r["node"], r["depth"]) for r in found) == [(k, k) for k in range(61)]
    assert graph.reachable(path, "a", "b", spark.range(1).select(F.col("id").alias("root")), 3).count() == 4
    hops = [(f"f{k}", "x", f"f{k + 1}", "x") for k in range(24)]
    exports = spark.createDataFrame(hops, "file string, name string, to_file string, to_name string")
    ends = graph.follow_exports(exports, exports.limit(1).select("file", "name")).collect()
    assert [(r["end_file"], r["hops"]) for r in ends] == [("f24", 24)]
    with pytest.raises(ValueError, match="disputed"):
        graph.agreed_reach(path, spark.createDataFrame([(40,)], "node long"), spark.range(1).select(F.col("id").alias("root"))).collect()


def test_deep_answers_have_no_result():
    assert json_text.salvage("{" * 100_000) is None


def test_journal_of_many_parts(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text("".join(json.dumps({"k": k}) + "\n" for k in range(20_000)) + '{"k"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    found = frames.journal(spark, str(path), "k long").select("seq", "k").collect()
    listed = frames.numbered_lines(spark, str(path)).agg(F.count("*"), F.max("line_number")).first()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["seq"], r["k"]) for r in found) == [(k + 1, k) for k in range(20_000)]
    assert tuple(listed) == (20_001, 20_001)


def test_truncation_in_bytes(spark):
    for text in ["short", "a" * 30, "é" * 12, "日本語のテキストです", "x" + "🙂" * 6, "ab" + "é" * 9]:
        got = spark.createDataFrame([(text,)], "t string").select(T.truncated(F.col("t"), 20)).first()[0]
        raw = text.encode()
        want = text if len(raw) <= 20 else raw[:20].decode(errors="ignore") + "…"
        assert got == want


def test_earlier_matches(spark):
    r = random.Random(9)
    pool = [[r.randrange(60) for _ in range(r.randint(1, 14))] for _ in range(25)]
    sets = []
    for k in range(120):
        own = set(r.choice(pool))
        if r.random() < 0.4:
            own ^= {r.randrange(60)}
        sets.append((k, sorted(own), r.choice("ab")))
    df = spark.createDataFrame(sets, "id int, s array<int>, g string")
    want = {}
    for i, a, g in sets:
        best = max(((len(set(a) & set(b)) / len(set(a) | set(b)), j) for j, b, h in sets if j < i and h == g and a and b), default=(0, None))
        if best[0] >= 0.8:
            want[i] = (best[1], round(best[0], 9))
    got = {x["later"]: (x["earlier"], round(x["similarity"], 9)) for x in similarity.earlier_matches(df, "id", "s", 0.8, "g").collect()}
    assert got == want and want


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = spark.createDataFrame([(10, "a/b", "2026"), (2, "c/d", "2025")], "id long, full_name string, created_at string")
    sinks.repository_csv(df, f"{at}/csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == "repo,metadata\nhttps://github.com/c/d,2025\nhttps://github.com/a/b,2026\n"
    with pytest.raises(Exception):
        sinks.repository_csv(df, f"{at}/csv")
    sinks.create_json(df, f"{at}/json")
    with pytest.raises(Exception):
        sinks.create_json(df, f"{at}/json")
    files = {r["file_path"]: r["n_bytes"] for r in sinks.inventory(spark, f"{at}/csv").collect() if "part-" in r["file_path"]}
    assert sum(files.values()) == len(text.encode()) and all("/" not in p for p in files)
    sealed = sinks.sealed(df.withColumn("seal", F.lit("")), ["id", "full_name", "seal"], "seal")
    assert sinks.seal_errors(sealed, ["id", "full_name", "seal"], "seal").count() == 0
    assert sinks.seal_errors(sealed.withColumn("id", F.col("id") + 1), ["id", "full_name", "seal"], "seal").count() == 2
    verdicts = spark.createDataFrame([("u", "slop"), ("v", "clean")], "unit_id string, tier string")
    sources = spark.createDataFrame([("a.py", "00")], "file_path string, sha256 string")
    run = sinks.completed_run(sources, verdicts, "s", "c")
    assert sinks.verify_run(run, sources, verdicts) == [] and sinks.verify_run(run, sources, verdicts.limit(1)) != []
    shown = spark.createDataFrame([("b.py", "kinda_slop", ["x"]), ("a.py", "slop", ["y", "z"]), ("c.py", "clean", [])], "file_path string, verdict string, top_reasons array<string>")
    report = sinks.markdown(shown)
    assert report == "# Report\n\n## a.py: slop\n- y\n- z\n\n## b.py: kinda_slop\n- x\n\nslop 1, kinda_slop 1, unresolved 0, clean 1\n"
    sinks.write_atomically(report, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == report and len(list(tmp_path.glob("r.md*"))) == 1


def test_places_and_settings(tmp_path):
    deep = tmp_path / "repo" / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "repo" / "go.mod").write_text("module x")
    (tmp_path / "repo" / "own.toml").write_text("limit = 3\n")
    assert sinks.repository_root(str(deep)) == str(tmp_path / "repo")
    assert sinks.settings(str(deep), "own.toml") == {"limit": 3} and sinks.settings(str(deep), "other.toml") == {}
    (deep / "own.toml").write_text("limit =")
    with pytest.raises(ValueError):
        sinks.settings(str(deep), "own.toml")


def test_aliases(spark):
    settings = '{// paths\n"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./*"], "@/lib/*": ["lib/*"], "one": ["lib/one.ts"],}, /* end */},}'
    aliases = symbols.path_aliases(settings, "web")
    assert aliases == [("@/lib/*", "web/src/lib/*"), ("one", "web/src/lib/one.ts"), ("@/*", "web/src/*")]
    rows = spark.createDataFrame([("@/lib/a",), ("@/b",), ("one",), ("other",)], "m string")
    assert [r[0] for r in rows.select(symbols.aliased(F.col("m"), aliases)).collect()] == ["web/src/lib/a", "web/src/b", "web/src/lib/one.ts", None]
    text = spark.createDataFrame([("a.name + $name",), ("my_name names",), ("(name)",)], "t string")
    assert [r[0] for r in text.select(symbols.names_identifier(F.col("t"), "name")).collect()] == [True, False, True]


def test_gates_raise(spark):
    bad = spark.createDataFrame([("b.py", 3, "private key"), ("a.py", 9, "AWS access key")], "file_path string, line_no int, kind string")
    with pytest.raises(ValueError, match="a.py:9 AWS access key; b.py:3 private key"):
        T.require_no_secrets(bad)
    T.require_no_secrets(bad.limit(0))
    status = spark.createDataFrame([(1, "matched"), (2, "missing")], "k int, status string")
    with pytest.raises(ValueError, match="2: missing"):
        joins.require_complete(status, "k")
    one = spark.createDataFrame([("A/b", "R1", "Go")], "repository string, revision string, language string")
    with pytest.raises(ValueError, match="selected twice"):
        release.composite([one, one], {"go": 2})
    with pytest.raises(ValueError, match="go: 1 of 2"):
        release.composite([one], {"go": 2})
    prior = spark.createDataFrame([(1, "a", "ok"), (2, "b", "no")], "rank int, repo string, assessment string")
    longer = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "rank int, repo string")
    with pytest.raises(ValueError, match="inherited rank 2 changed"):
        release.continued(prior, longer, ["repo"])


def test_context_windows(spark):
    source = "\n".join(f"line {k}" for k in range(1, 31))
    files = spark.createDataFrame([("a.py", source)], "file_path string, source string")
    methods = spark.createDataFrame([("a.py", "m", 9, 14)], "file_path string, name string, start_line int, end_line int")
    refs = spark.createDataFrame([("t", "a.py", 10, "m"), ("t", "a.py", 2, None), ("t", "a.py", 29, None)], "target string, file_path string, line int, caller string")
    got = {r["line"]: r["context"].split("\n") for r in symbols.caller_context(refs, files, methods).collect()}
    lines = lambda a, b: [f"line {k}" for k in range(a, b + 1)]
    assert got == {10: lines(9, 14), 2: lines(1, 7), 29: lines(25, 30)}


def test_interval_joins_are_not_broadcast(spark):
    # rows by level are many times what the tables' sizes tell, and a driver that broadcasts them runs out of memory
    left = spark.createDataFrame([("k", 4 * n, 4 * n + n % 37) for n in range(400)], "g string, s long, e long")
    right = spark.createDataFrame([("k", 3 * n, 3 * n + n % 5) for n in range(400)], "g string, x long, y long")
    got = joins.overlapping(left, right, ["g"], ("s", "e"), ("x", "y"))
    wide = joins.overlapping(left, right, ["g"], ("s", "e"), ("x", "y"), 64)
    points = right.select(F.col("x").alias("point_id"), "g", F.col("x").alias("at"))
    inner = joins.enclosing_interval(points, left, ["g"], "at", "s", "e", bin_width=4)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (got, wide, inner)]
    assert all("__level" in p for p in plans)
    assert not any("BroadcastHashJoin [g" in p for p in plans)
    assert sorted(got.collect()) == sorted(wide.collect()) and got.count() > 400


def test_overlap_summary_needs_no_pairs(spark):
    r = random.Random(13)

    def some(n):
        starts = [r.randrange(-3000, 3000) for _ in range(n)]
        return [(r.choice(["hot"] * 5 + ["a", None]), k, None if k == 0 else s, s + r.choice([-1, 0, 1, 2, 7, 64, 1000, 100_000])) for k, s in enumerate(starts)]

    a, b = some(150), some(170)
    left, right = spark.createDataFrame(a, "g string, i int, s long, e long"), spark.createDataFrame(b, "g string, j int, x long, y long")
    want = {}
    for g, i, s, e in a:
        met = [j for h, j, x, y in b if g and g == h and None not in (s, x) and s <= e and x <= y and s <= y and x <= e]
        if met:
            want[i] = (len(met), min(met), max(met))
    got = joins.overlap_summary(left, right, ["g"], ("s", "e"), ("x", "y"), "j")
    assert got.columns == ["g", "i", "s", "e", "overlaps", "least", "most"]
    assert {v["i"]: (v["overlaps"], v["least"], v["most"]) for v in got.collect()} == want and got.count() == len(want)
    assert joins.overlap_summary(left.limit(0), right, ["g"], ("s", "e"), ("x", "y"), "j").collect() == []
    assert joins.overlap_summary(left, right.limit(0), ["g"], ("s", "e"), ("x", "y"), "j").collect() == []
    # 10^10 pairs, which no job could give
    many = spark.range(100_000)
    wide = joins.overlap_summary(many.selectExpr("'k' as g", "id as s", "id + 200000 as e"), many.selectExpr("'k' as g", "id", "id as x", "id + 200000 as y"), ["g"], ("s", "e"), ("x", "y"), "id")
    assert wide.selectExpr("sum(overlaps)", "min(least)", "min(most)").first()[:] == (10**10, 0, 99_999)


def test_loops_over_joins_are_bounded(spark, monkeypatch):
    # parts by rows, and nothing broadcast: what the loops write is many times its size in files
    monkeypatch.setattr(graph, "ROWS", 50)
    plans, write = [], graph.written_at
    monkeypatch.setattr(graph, "written_at", lambda df, at: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, at))
    monkeypatch.setattr(graph, "written", lambda df, name: graph.written_at(df, graph.fresh_path(spark, name)))
    edges = spark.createDataFrame([(k, k + 1) for k in range(600) if k % 7 != 6], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert found == {k: k - k % 7 for k in range(601)}
    ends = graph.chain_ends(edges, "a", "b").collect()
    assert len(ends) == edges.count() and all(r["end"] == r["a"] - r["a"] % 7 + 6 or r["a"] >= 595 for r in ends)
    cases = spark.createDataFrame([(k, str(k)) for k in range(300)], "case_id long, semantics string")
    units = spark.createDataFrame([(k, k // 3) for k in range(300)], "case_id long, unit_id long")
    linked = graph.case_components(cases, units, spark.createDataFrame([(0, 1)], "caller long, callee long")).collect()
    assert {r["case_id"]: r["component"] for r in linked} == {k: 0 if k < 6 else k - k % 3 for k in range(300)}
    assert plans and not any("BroadcastHashJoin [u" in p or "BroadcastHashJoin [t" in p for p in plans)
    assert any("REPARTITION_BY_NUM" in p for p in plans)


def test_line_starts_and_delegations_in_one_pass(spark):
    r = random.Random(14)
    bits = ["if ", "if(", "for x", "while (", " ", "  ", "\t", "\n", "\n\n", "\r\n", "return ", "return run(x);", "return a::b ", "fun f() = g(x)", "# note", '"""', "{", "x = y(1)", "do ", "\x0b"]
    sources = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(sources)], "k int, source string")
    starts = T.BRANCHES + T.LOOPS
    got = {v["k"]: (v["n"], v["d"]) for v in rows.select("k", T.count_line_starts(F.col("source"), starts).alias("n"), shape.thin_delegation(F.col("source"), F.lit(3)).alias("d")).collect()}
    calls = lambda e: (lambda b: b != "" and ("(" in b or "::" in b) and not any(x in b.lower() for x in shape.NO_CALL))(re.sub(";+$", "", e.strip(" ")))

    def delegates(text):
        held = [x for x in (re.sub(r"^[ \t\x0b\r\f]+|[ \t\x0b\r\f]+$", "", y) for y in text.strip(" ").split("\n")) if x and not x.startswith(("#", '"""', "'''"))]
        if text.strip(" ") == "":
            return False
        if len(held) == 1:
            one = held[0]
            return calls(one[7:]) if one.startswith("return ") else bool(re.search(r"^.*fun .*=[^=]*\)[^=)]*$", one)) and calls(one.split("=")[-1])
        last = [x for x in held if x.startswith("return ")]
        return bool(last) and calls(last[-1][7:]) or ("fun " in text.lower() and "=" in text and calls(text.strip(" ").split("=")[-1].replace("\n", "")))

    for k, t in enumerate(sources[:-1]):
        assert got[k] == (sum(x.lstrip(" ").startswith(tuple(starts)) for x in t.split("\n")), delegates(t)), repr(t)
    assert got[len(sources) - 1][0] is None
    # the lines are not taken apart one by one
    plan = rows.select(T.count_line_starts(F.col("source"), starts))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_shingle_sets(spark):
    import oracle

    from tallyforge.plans import text_plans

    odd = [None, "", " 12 !", "one", "One TWO", "a b c d e", "a b c d e f a b c d e f", "ÄÖ À÷ÿ é, İstanbul Kelvin ß ŸES Σας x", "x😀y z".encode("utf-16", "surrogatepass").decode("utf-16"), "w " * 3000, "l'été\tdéjà-vu\nlà où ça va bien sûr"]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["s"] for r in similarity.shingle_sets(df, "text").collect()}
    hashed = F.array_distinct(F.transform(T.shingles(text_plans._words()), lambda s: F.xxhash64(s)))
    want = {r["doc_id"]: sorted(r["s"]) for r in df.where("text is not null").select("doc_id", hashed.alias("s")).collect()} | {0: []}  # SQL gives no shingle of a null text
    assert got == want and similarity.shingle_sets(df, "text").columns == ["doc_id", "lang", "s"]
    plan = text_plans._sets(spark, f"{oracle.DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "lambda" not in plan  # functions over single shingles took half of near_duplicates' time


def test_sources_are_judged_once(spark):
    sources = [None, "", "def f(x):\n    ...", "def g(a):\n    del a\n    return None", "from x import y\nreturn _y", "return f(x)", "if a:\nfor b in c:\nwhile d:", "fun f(x) = g(x)"]
    names = ["get_a", "run_b", "load_c", None, "x_report", "getData"]
    of = [(f"lib/core/m{k % 7}.py", names[k % 6], "python", 3 * (k % 20), k % 9, k % 8, k, k + 3, k % 3 > 0, sources[k % 8]) for k in range(480)]
    methods = spark.createDataFrame(of, "file_path string, name string, language string, loc int, param_count int, nesting_depth int, start_line int, end_line int, is_exported boolean, source string")
    judged = shape.judged(methods)
    source, name, loc = F.col("source"), F.col("name"), F.col("loc")
    pairs = [
        (shape.thin_wrapper(source, loc), F.col("__wraps") & (loc <= shape.WRAPPER_LOC)),
        (shape.thin_delegation(source, loc), F.col("__delegates") & (loc <= shape.DELEGATION_LOC)),
        (shape.placeholder_stub(source, loc), F.col("__discards") & (loc <= shape.STUB_LOC)),
        (shape.protocol_stub(source), F.col("__stub")),
        (T.count_line_starts(source, T.BRANCHES), F.col("__branches")),
        (T.count_line_starts(source, T.LOOPS), F.col("__loops")),
        (shape.utility_name(name), F.col("__utility")),
    ]
    assert judged.count() == 480
    assert judged.where(~reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])).count() == 0
    other = shape.once_each(methods, {"start_line": {"odd": F.col("start_line") % 2 == 1}})  # values that do not repeat are judged in place
    assert other.where("odd").count() == 240 and "Join" not in other._jdf.queryExecution().optimizedPlan().toString()
    # neither the rules of sources nor those of a file's path are tried for each method
    kinds = shape.module_kinds(methods.select("file_path", F.lit("text").alias("source")).distinct(), judged)
    counts = methods.select("file_path", "name", "start_line", F.lit(0).cast("long").alias("refs"))
    for found in (scoring.method_flags(scoring.scored_methods(judged), kinds), scoring.reference_flags(judged, kinds, counts)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "fixtures" not in plan and "notimplemented" not in plan and "switch" not in plan
        assert found.count() > 0


def test_only_likely_pairs_ship_their_sets(spark, monkeypatch):
    r, stored = random.Random(9), []
    passage = list(range(20))  # in every set, so its items are frequent
    sets = []
    for k in range(60):
        own = [r.randrange(1 << 62) for _ in range(80)]
        sets.append(passage + own)
        sets += [passage + own[:-3] + [r.randrange(1 << 62) for _ in range(3)]] * (k % 4 == 0) + [list(own + passage)] * (k % 6 == 0)
    sets += [[], [5], [5], passage, passage[:-2], passage[:-5]]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id long, items array<long>").repartition(3)
    keep = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: stored.append((name, keep(df, name))) or stored[-1][1])
    unlike = [set(s) for s in sets]
    first = {}
    for k, s in enumerate(unlike):
        first.setdefault(frozenset(s), k)
    nodes = [k for s, k in first.items() if s]
    share = lambda a, b: len(unlike[a] & unlike[b]) / len(unlike[a] | unlike[b])
    want = {(a, b): share(a, b) for a in nodes for b in nodes if b < a and share(a, b) >= 0.8}
    for least in (64, 1):  # once with the passage among the frequent items only, once with all that two sets share
        monkeypatch.setattr(similarity, "FREQUENT_LEAST", least, raising=False)
        stored.clear()
        got = {(x["later"], x["earlier"]): x["similarity"] for x in similarity.jaccard_pairs(df, "id", "items", 0.8).collect()}
        assert got == want and len(want) >= 17
        assert sum("items" in t.columns for _, t in stored) == 1  # whole sets are stored once
        assert dict(stored)["candidates"].count() == len(want)  # a shared passage brings no sets together
    monkeypatch.setattr(similarity, "SENT_IDS", 0)
    assert {(x["later"], x["earlier"]): x["similarity"] for x in similarity.jaccard_pairs(df, "id", "items", 0.8).collect()} == want
