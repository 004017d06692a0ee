"""op11 to op13 beside their SQL, brute force, and small tables of odd rows."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict

import oracle
import pytest

from tallyforge.llm import divergence, jaccard_join, prefix_trie, sketches

SF = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("module, name", [(prefix_trie, "op11_prefix_trie"), (divergence, "op12_divergence")])
def test_beside_sql(spark, con, module, name):
    assert oracle.compare(getattr(module, name)(spark, SF), con, module.ORACLE) == ""


def trie_by_hand(rows):
    talks = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            talks[conv_id].append(((turn is not None, turn or 0, said), role, text))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in talks.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = set()

    def below(path):
        leaves, saved = (0, 0) if kids[path] else (1, 0)
        if path:
            saved += (len(members[path]) - 1) * len(path[-1][1].encode().split())
        for kid in kids[path]:
            a, b = below(kid)
            leaves, saved = leaves + a, saved + b
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out.add((min(members[path]), len(path), parent, len(members[path]), len(kids[path]), leaves, saved, digest))
        return leaves, saved

    if members:
        sys.setrecursionlimit(10_000)
        below(())
    return out


def test_trie_of_odd_rows(spark):
    draw = random.Random(11)
    rows = [(c, draw.choice([None, *range(4)]), draw.choice(["user", "", None]), draw.choice(["a b", "a  b c", "", None])) for c in range(-45, 60) for _ in range(draw.randrange(4))]
    rows += [(40, 7, "user", "same words"), (40, 7, "user", "same words"), (None, 1, "user", "x")]
    rows += [(100, k, "user", f"w{k % 3}") for k in range(300)] + [(c, k, "user", "x y") for c in (105, 110, 111) for k in range(60)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, at int, depth string")
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df)))
    assert {tuple(r) for r in got.collect()} == trie_by_hand(rows)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df.limit(0)))).collect() == []


def test_ends_in_many_strings(spark):
    ids = [*range(0, 30_000, 7)]
    df = spark.createDataFrame([(1, 2, 3, c) for c in ids] + [(1, 2, 4, 5)], "depth long, ka long, kb long, conv_id long")
    got = {r["kb"]: r["ends_sha256"] for r in prefix_trie.ends_hashes(df).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"5").hexdigest()}


def test_divergence_of_odd_rows(spark, tmp_path):
    draw = random.Random(12)
    words = ["The", "thé", "ǅx", "a1b", "ÄRGER", "zz-zz", "ß", "İ", "日本"]
    rows = [(k if k % 5 else None, " ".join(draw.choices(words, k=draw.randrange(40))) if k % 11 else None, draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None])) for k in range(160)]
    rows += [(900, "rare words only here", "xx", "a"), (901, "", "xx", "b"), (902, "long " * 30_000, "en", "a")]
    df = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    con = oracle.duck(SF)
    df.write.parquet(str(tmp_path / "documents"))
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert oracle.compare(divergence.divergence(df), con, divergence.ORACLE) == ""
    assert divergence.divergence(df.limit(0)).collect() == []


def test_sketch_is_never_too_low(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    keys, counts = draw.integers(0, 1 << 63, 5000, dtype="u8"), draw.integers(1, 30, 5000)
    c = sketches.Counters(1 << 10)
    c.add(keys, counts)
    c.add(np.repeat(keys[:100], 3))
    counts[:100] += 3
    low = np.min([row[at] for row, at in zip(c.cells, sketches.cells_of(keys, 1 << 10), strict=True)], axis=0)
    assert (low >= counts).all() and c.n == counts.sum()


def joined_by_hand(rows, over, under, size):
    sets = []
    for doc_id, text in rows:
        own = text.encode().lower().split() if text else []
        sets.append((doc_id, frozenset([tuple(own)] if 0 < len(own) < size else zip(*(own[k:] for k in range(size)), strict=False))))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and under * len(a & b) >= over * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    name = {g: min((d for (d, _), h in zip(sets, group, strict=True) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, len(s), name[g] if s else d) for (d, s), g in zip(sets, group, strict=True)), key=repr)


@pytest.mark.parametrize("limit, long, rare, few", [(jaccard_join.Limit(90, 100, 3), 512, 64, 64), (jaccard_join.Limit(90, 100, 3), 40, 4, 8), (jaccard_join.Limit(4, 5, 5), 60, 3, 4)])
def test_join_by_brute_force(spark, monkeypatch, limit, long, rare, few):
    draw = random.Random(limit.over + long)
    base = [[f"w{draw.randrange(4000)}" for _ in range(n)] for n in (40, 90, 130, 9, 10, 20)]
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(240):
        words = list(draw.choice(base)) if k % 4 else [f"u{draw.randrange(10**6)}" for _ in range(draw.randrange(60))] + passage
        for _ in range(draw.randrange(4)):
            if words:
                words[draw.randrange(len(words))] = f"x{draw.randrange(3)}"
        rows.append((k, " ".join(words).upper() if k % 3 else "\t ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[1][1]), (503, "one"), (504, "ONE"), (505, "one two"), (1, rows[2][1]), (506, "ÄB äb c"), (507, "äb äb c"), (508, "a b " * 20_000)]
    for name, value in (("LONG", long), ("RARE", rare), ("FEW", few), ("FULL", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = jaccard_join.similar_documents(df, limit).select("doc_id", "n", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == joined_by_hand(rows, *limit)
    assert jaccard_join.similar_documents(df.limit(0), limit).collect() == []


@pytest.mark.parametrize("limit, long", [(jaccard_join.Limit(90, 100, 3), 512), (jaccard_join.Limit(90, 100, 3), 60), (jaccard_join.Limit(4, 5, 5), 50)])
def test_similar_sets_share_a_key(monkeypatch, limit, long):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "LONG", long)
    draw = np.random.default_rng(long)
    found = 0
    for share in (0.0, 0.3, 0.9, 1.0):
        for _ in range(150):
            n = int(draw.integers(5, 140))
            a = np.unique(draw.integers(0, 1 << 63, n, dtype="u8") << np.uint64(1))
            drop, more = draw.integers(0, 1 + n // 8, 2)
            b = np.unique(np.r_[draw.permutation(a)[int(drop) :], draw.integers(0, 1 << 63, int(more), dtype="u8")])
            if not limit.similar(a, b):
                continue
            found += 1
            late = lambda s: (s >> np.uint64(7)) % np.uint64(100) < np.uint64(int(100 * share))
            both = [set(zip(*(x.tolist() for x in jaccard_join.keys(s, late(s), limit)), strict=True)) for s in (a, b)]
            shared = {k for k, _ in both[0] & both[1]}
            if len(a) == len(b) and (a == b).all():
                continue
            assert shared - {jaccard_join.LONG_KEY} or jaccard_join.LONG_KEY in shared and max(len(a), len(b)) > long
            assert limit.differ(len(a), len(b)) >= np.bitwise_count(jaccard_join.parities(a, 64) ^ jaccard_join.parities(b, 64)).sum()
    assert found > 100


def test_combinations_grow_with_the_set():
    import numpy as np

    limit = jaccard_join.Limit(90, 100, 3)
    draw = np.random.default_rng(5)
    for n in (60, 200, 460, 2000):
        items = np.unique(draw.integers(0, 1 << 63, n, dtype="u8"))
        for late in (np.ones(n, bool), (items >> np.uint64(30)).astype("i1") % 2 + 1):  # nothing is rare, as in a full sketch
            kinds, cells = jaccard_join.keys(items, late, limit)
            assert len(set(cells.tolist())) == len(cells) < 0.6 * n
            assert set(kinds.tolist()) == {jaccard_join.TWO_KEY}  # no cell under a single frequent item, which many sets share
