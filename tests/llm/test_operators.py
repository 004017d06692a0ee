"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tallyforge.llm import bpe, html_text, language_id, packing, quality, quality_rules, simhash, substring_dedup, token_files, tokens, topk_search
from tallyforge.llm.common import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, one long, print string"


def corpus() -> list[tuple]:
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioustnr") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["the", "of", "and", "to", "in"] * 20
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = say(60)
    texts = [say(r.randint(1, 90)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[3] + " ", say(20) + "\n" + passage + "\n" + say(15), passage, say(9) + "\t" + passage, passage + " end"]
    texts += [None, "", " \n\t ", "one", "Two words", "word " * 500, "x" * 5000, say(12), "ÉTÉ naïve 日本 <|endoftext|> don't 's \x1c \xa0 İ", say(3000), "THE A1! " * 40]
    rows = [(k, t, "en" if k % 5 else None, "s", len(t or ""), "c", k, "p") for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, passage, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is None, row[0] or 0, repr(row))


def words(text):
    return [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text or "")]


def library():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def encoded(text):
    return library_cache.encode(text or "", add_special_tokens=False).ids


library_cache = library()


def test_substring_dedup(docs, none):
    found = substring_dedup.remove_repeats(docs, outputs=("n_words", "n_removed", "kept_sha256", "removed_spans")).collect()
    first: dict = {}
    for row in corpus():
        w = words(row[1])
        for i in range(len(w) - 12):
            if row[0] is not None:
                first[tuple(w[i : i + 13])] = min(row[0], first.get(tuple(w[i : i + 13]), row[0]))
    want = []
    for row in corpus():
        w = words(row[1])
        covered = [False] * len(w)
        for i in range(len(w) - 12):
            if row[0] is not None and first[tuple(w[i : i + 13])] < row[0]:
                covered[i : i + 13] = [True] * 13
        want.append((row[0], len(w), sum(covered), hashlib.sha256(b" ".join(x for x, c in zip(w, covered) if not c)).hexdigest()))
    assert sorted((tuple(r[:4]) for r in found), key=key) == sorted(want, key=key)
    assert all(sum(s["end"] - s["start"] for s in r["removed_spans"]) == r["n_removed"] for r in found)
    assert sum(r["n_removed"] for r in found) > 200
    assert substring_dedup.remove_repeats(none).count() == 0
    kept = substring_dedup.keep_unrepeated(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert by_id[31]["text"] == "" and by_id[0]["text"] == corpus()[0][1] and by_id[31]["copies"] == "c"


def test_bpe(docs, none):
    found = bpe.encode_decode(docs).collect()
    for r in found:
        text = {k[0]: k[1] for k in corpus()}[r["doc_id"]]
        ids = encoded(text)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library_cache.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert len(found) == len(corpus()) and bpe.encode_decode(none).count() == 0


def test_speculation_and_small_maps():
    r = random.Random(3)
    path = tokens.default_tokenizer()
    coder = bpe.SpeculativeCoder(path, slots=64)
    own = tokens.WordIds(path, coder, max_words=50)
    for _ in range(300):
        text = "".join(r.choice("abcdeilnorst'é!#. \n9") for _ in range(r.randint(0, 120)))
        assert np.frombuffer(own.batch([text])[0], "<u4").tolist() == encoded(text)
    assert coder.merged > 0 and len(own.words) <= 50
    long = "ab" * 300
    assert coder.ids([long])[0] == encoded(long)


def test_packing(docs, none):
    found = packing.pack(docs).collect()
    by_id = {k[0]: np.array([*encoded(k[1]), 1], "<u4") for k in corpus()}
    per_doc, per_sequence = {}, {}
    for r in found:
        assert zlib.crc32(by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(by_id[r["doc_id"]]) and r["length"] > 0
        per_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        per_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, pieces in per_doc.items():
        times = 2 if doc == 4 else 1
        assert sum(n for _, n in pieces) == times * len(by_id[doc])
    for pieces in per_sequence.values():
        pieces.sort()
        ends = np.cumsum([n for _, n in pieces])
        assert [o for o, _ in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(none).count() == 0


def test_packing_limits():
    r = random.Random(5)
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=40)
    packer, rows = packing.Packer(limits, pool=8), []
    sizes = [(k, r.randint(1, 150)) for k in range(200)]
    loss = {k: r.randint(0, n) for k, n in sizes}
    for k, n in sizes:
        rows += packer.take(k, bytes(4 * n), loss[k])
    rows += packer.finish()
    places = {k: [False] * n for k, n in sizes}
    sequences: dict = {}
    for doc, start, length, _, n, seq, offset in rows:
        assert not any(places[doc][start : start + length])
        places[doc][start : start + length] = [True] * length
        first_loss = n - loss[doc]
        sequences.setdefault(seq, []).append((offset, length, max(0, start + length - max(start, first_loss))))
    assert all(all(p) for p in places.values())
    for pieces in sequences.values():
        assert sum(p[1] for p in pieces) <= 64 and len(pieces) <= 3 and sum(p[2] for p in pieces) <= 40


def test_token_files(spark, docs, none):
    at = fresh_path(spark, "files")
    manifest = token_files.write_token_files(docs, at)
    found = token_files.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    want = sorted(((k[0] is not None, k[0] or 0, k[1] or ""), [*encoded(k[1]), 2]) for k in corpus())
    assert [r["ids"] for r in found] == [ids for _, ids in want]
    assert [r["start"] for r in found] == np.r_[0, np.cumsum([len(i) for _, i in want])[:-1]].tolist()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)
    shard = manifest.orderBy("shard").first()["path"]
    own = token_files.Shard(shard)
    doc = int(own.index["doc_id"][-1])
    assert own.document(doc).tolist() == [*encoded({k[0]: k[1] for k in corpus()}[doc]), 2] and own.document(10**9) is None
    assert token_files.read_token_files(token_files.write_token_files(none, fresh_path(spark, "files"))).count() == 0


def fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def closed(values: list[int], most: int) -> list[int]:
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if label[j] < label[i] and (x ^ y).bit_count() <= most:
                    label[i], changed = label[j], True
    return label


def test_simhash(docs, none):
    found = sorted(simhash.near_duplicates(docs).collect(), key=key)
    rows = sorted(((k[0], k[1]) for k in corpus()), key=key)
    prints = [fingerprint(t) for _, t in rows]
    assert sorted(((r["doc_id"], r["print"] % (1 << 64)) for r in found), key=key) == sorted(zip([d for d, _ in rows], prints), key=key)
    label = closed(prints, 3)
    least: dict = {}
    for (doc, _), g in zip(rows, label):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=key) == sorted(((d, least.get(g)) for (d, _), g in zip(rows, label)), key=key)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {30, 31} & {r["doc_id"] for r in kept.collect()} == set()


def test_simhash_links_on_planted_fingerprints(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(300)]
    values = set(base)
    for x in base[:120]:
        for _ in range(3):
            y = x
            for b in r.sample(range(64), r.randint(1, 5)):
                y ^= 1 << b
            values.add(y)
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "print long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    at = {v: k for k, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        parent[root(at[a])] = root(at[b])
    label = closed(values, 3)
    assert len({(root(k), label[k]) for k in range(len(values))}) == len(set(label)) == len({root(k) for k in range(len(values))})


def test_five_word_near_copies(spark, none):
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts, passage = [], say(60)
    for k in range(30):
        base = say(r.randint(60, 400)) + passage * (k % 3 == 0)
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 6):
            copy = list(base)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = "edited"
            texts.append(" ".join(copy).upper() if edits == 2 else " ".join(copy))
    hub = say(300)  # a large group of near copies, each with its own edits
    texts += [" ".join(hub[:k] + ["own"] + hub[k + 1 :]) for k in range(5, 290, 5)]
    texts += [t for _, t, *_ in corpus()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    grams = lambda t: {tuple(w[k : k + 5]) for w in [words((t or "").lower())] for k in range(max(len(w) - 4, 1)) if w}
    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    wanted = {k: find(k) for k in range(len(sets))}
    bits = [simhash.fingerprint(t, 5) for t in texts]
    assert sum((bits[k] ^ bits[wanted[k]]).bit_count() > 3 for k in wanted) > 30  # three bits do not find these
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5).collect()} == wanted
    assert simhash.near_duplicates(none, 5).count() == 0


def test_quality_rules(docs, none):
    found = quality_rules.judge(docs).collect()
    text_of = {k[0]: k[1] for k in corpus()}
    for r in found:
        text = text_of[r["doc_id"]] or ""
        w = WORD.findall(text)
        at: dict = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert len(found) == len(corpus()) and quality_rules.judge(none).count() == 0
    kept = quality_rules.keep_by_rules(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)


def test_quality_rules_distance(spark):
    good = "the old house of the town and the sea is for all that want to see it in the morning or the evening "
    rows = [(k, good * (3 + k), "en") for k in range(5)] + [(9, "".join(f"ZQ{k}X### YY{k}!! " for k in range(80)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(df.where("doc_id < 9"))
    found = {r["doc_id"]: r for r in quality_rules.judged(quality_rules.measured(df, refs)).collect()}
    assert not found[9]["kept"] and not found[9]["base_failed"] and found[0]["word_distance"] < 0.05
    name, chars, common = refs[0]
    p = np.array([good.split().count(w) for w in quality_rules.COMMON], float)
    p = np.r_[p, len(good.split()) - p.sum()] / len(good.split())
    assert name == "en" and np.allclose(p, common)
    other = np.r_[np.zeros(len(quality_rules.COMMON)), 1.0]
    mid = (p + other) / 2
    kl = lambda a: sum(x * np.log2(x / m) for x, m in zip(a, mid) if x > 0)
    assert found[9]["word_distance"] == pytest.approx(np.sqrt((kl(p) + kl(other)) / 2), abs=1e-9)


def test_every_language_has_a_reference(spark):
    r = random.Random(5)
    small = " ".join(r.choice(["kala", "suo", "mies", "vesi", "puu", "talo"]) + str(k) for k in range(2000))
    other = lambda: " ".join(r.choice(["the", "of", "and", f"w{r.randrange(10**6)}x"]) for _ in range(3000))
    rows = [(k, other(), f"l{k:02}") for k in range(quality_rules.INLINE + 8)] + [(100, small, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(df)
    assert len(refs) == quality_rules.INLINE + 9
    found = {x["doc_id"]: x for x in quality_rules.judge(df).collect()}
    assert found[100]["kept"] and found[100]["class_distance"] < 1e-6 and found[100]["word_distance"] < 1e-6
    assert all(x["kept"] != x["base_failed"] for x in found.values())


def test_every_language_has_a_profile(spark):
    r = random.Random(9)
    rows, k = [], 0
    for lang in range(70):
        own = [chr(0x4E00 + 20 * lang + j) for j in range(20)]
        for _ in range(3 if lang else 1):  # the first has the fewest documents
            rows.append((k, " ".join("".join(r.choices(own, k=4)) for _ in range(30)), f"x{lang:02}"))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(df, language_id.train(df)).collect()}
    assert found == {d: lang for d, _, lang in rows}


def test_language(spark, docs, none):
    r = random.Random(2)
    makers = {"aa": "the of and shing tion ".split(), "bb": "der und schen keit ung ".split(), "cc": "les eaux tion que ment ".split()}
    rows = []
    for k in range(240):
        name = r.choice(sorted(makers))
        rows.append((k, " ".join(r.choice(makers[name]) + r.choice(makers[name]) for _ in range(30)), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.train(df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    found = {x["doc_id"]: x for x in language_id.identify(df, profiles).collect()}
    assert all(found[k]["lang_pred"] == name for k, _, name in rows) and any(x["held_out"] for x in found.values())
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 for x in found.values())
    edge = {x["doc_id"]: x for x in language_id.identify(docs, profiles).collect()}
    assert all(edge[k[0]]["lang_pred"] == "und" for k in corpus() if not any(c.isalpha() for c in k[1] or ""))
    nothing = language_id.train(none)
    assert {x["lang_pred"] for x in language_id.identify(docs, nothing).collect()} == {"und"}


def test_quality_classifier(spark, docs, none):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        good = r.random() < 0.7
        text = " ".join(r.choice(["sea", "town", "light", "the", "of", "and", "river"]) + ("" if good else r.choice(["###", "$$$", "!!"])) for _ in range(60))
        rows.append((k, text))
        labels.append((k, int(good)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (7, 1 - labels[7][1]), (8, None)], "doc_id long, quality int")
    model = quality.train(df, lab)
    found = {x["doc_id"]: x for x in quality.score_documents(df, model).collect()}
    held = [k for k in found if found[k]["held_out"]]
    assert held and all(found[k]["predicted"] == labels[k][1] for k in held)
    edge = quality.score_documents(docs, model).collect()
    assert len(edge) == len(corpus()) and all(0 <= x["score"] <= 1 for x in edge)
    constant = quality.train(none, lab.where("quality = 1"))
    assert {x["score"] for x in quality.score_documents(docs, constant).collect()} == {1.0}
    assert quality.keep_good(df, lab).columns == ["doc_id", "text"]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(0, 0.2, 16).tolist()) for k in range(600)]
    vectors[100] = (100, vectors[101][1])
    vectors += [(1000, None), (1050, [0.1, None] * 8), (1100, [float("nan")] * 16), (1101, [float("inf")] + [0.0] * 15), (1150, [0.5, 0.5]), (1151, [0.5, 0.25]), (1152, []), (None, [0.0] * 16), (5, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = topk_search.top_k(df, df.where("vec_id % 50 = 0"))
    usable = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in vectors if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-int(a @ b), k) for k, b in usable if k != q and len(a) == len(b))[:5]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def _brute(values, ids, query, own, k):
    scores = values @ query
    order = [x for x in np.lexsort((ids, -scores)).tolist() if ids[x] != own][:k]
    return [(int(scores[x]), int(ids[x])) for x in order]


@pytest.mark.parametrize("kind", ["dense", "peaked", "large", "ties"])
def test_lists_are_read_with_bounds(kind):
    r = np.random.default_rng(2)
    n, dims, k = 700, 12, 5
    values = np.floor(256 * r.normal(0, 0.2, (n, dims))).astype("i8")
    if kind == "peaked":  # few large components: reading stops early
        values = np.where(r.random((n, dims)) < 0.1, 5000, values // 64)
    if kind == "large":  # sums are not exact in doubles
        values = values * 3_000_000 + r.integers(0, 1000, (n, dims))
    if kind == "ties":
        values = np.sign(values)
    ids = r.permutation(n)
    block = topk_search.Block(ids, values)
    for j, (places, scores) in enumerate(block.best(values[:40], ids[:40], k, np.full(40, -np.inf))):
        found = sorted(zip((-scores).tolist(), ids[places].tolist(), strict=True))[:k]
        assert [(-s, i) for s, i in found] == _brute(values, ids, values[j], ids[j], k)
    whole = 40 * n * dims
    assert 0 < block.read <= whole and block.resolved <= whole
    if kind == "peaked":
        assert block.read + block.resolved < whole  # some lists were not read to their ends


def test_top_k_rounds_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    vectors = [(k, r.normal(0, 0.2, 8).tolist(), "x") for k in range(500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string").repartition(2)
    once = sorted(map(tuple, topk_search.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    monkeypatch.setattr(topk_search, "ROUND", 3)
    assert sorted(map(tuple, topk_search.top_k(df, df.where("vec_id % 50 = 0")).collect())) == once
    values = np.floor(256 * np.array([v for _, v, _ in vectors])).astype("i8")
    ids = np.arange(500)
    best = topk_search.Best(ids[::50], values[::50], 5)
    reads = 0
    for a in range(0, 500, 64):  # several blocks in one task
        block = topk_search.Block(ids[a : a + 64], values[a : a + 64])
        best.add(block)
        reads += block.read
    assert reads > 0
    want = [(q, n + 1, i, s) for q in ids[::50].tolist() for n, (s, i) in enumerate(_brute(values, ids, values[q], q, 5))]
    got = [(q, n + 1, int(i), int(s)) for q, (scores, found) in zip(ids[::50].tolist(), best.found, strict=True) for n, (s, i) in enumerate(zip(scores, found, strict=True))]
    assert got == want == once


def test_top_k_own_rows_in_later_blocks():
    r = np.random.default_rng(3)
    centres = np.where(r.random((40, 32)) < 0.15, r.random((40, 32)), 0.0)
    n = 3 * topk_search.BLOCK
    near = np.repeat(np.arange(40), -(-n // 40))[:n]  # similar vectors lie near each other
    values = np.floor(256 * np.maximum(centres[near] + np.where(centres[near] > 0, r.normal(0, 0.05, (n, 32)), 0.0), 0)).astype("i8")
    ids = np.arange(n)
    asked = np.r_[ids[::97], ids[-200:]]
    best = topk_search.Best(asked, values[asked], 5)
    for a in range(0, n, topk_search.BLOCK):
        best.add(topk_search.Block(ids[a : a + topk_search.BLOCK], values[a : a + topk_search.BLOCK]))
    for q, (scores, found) in zip(asked.tolist(), best.found, strict=True):
        all_scores = values @ values[q]
        order = [x for x in np.lexsort((ids, -all_scores)).tolist() if x != q][:5]
        assert (found.tolist(), scores.tolist()) == (order, all_scores[order].tolist()), q
    # one block, k = 1: the query's own row is by far the best and its upper bound must not cut the best of the others
    sparse = np.zeros((1000, 8), "i8")
    sparse[7], sparse[8] = 1000, 10
    assert 8 in topk_search.Block(np.arange(1000), sparse).best(np.full((1, 8), 1000), np.array([7]), 1, np.array([1.0]))[0][0].tolist()


def test_html():
    text = html_text.page_text
    assert text(None) is None and text("") == "" and text("<p hidden>x</p><script>y</script>") == ""
    assert text("<p>a<p>b &amp; c<br>d") == "a\n\nb & c\nd"
    assert text("<ul><li>x<li>y<ol><li>1st<li>2nd</ol></ul>") == "- x\n- y\n  1. 1st\n  2. 2nd"
    assert text("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>z<td>22</table>") == "name       n\nlong name  1\nz          22"
    assert text("<pre>a\n  b</pre>") == "a\n  b" and text("<div style='display:none'>x</div>y") == "y"
    assert text("<title>t</title><body>x</p></div>y <b>z</i> w</b>") == "x\n\ny z w" or text("<title>t</title><body>x</div>y") == "xy"
    assert text("<div>" * 5000 + "deep") == "deep" and text("a < b") == "a < b"
    paragraphs = [" ".join(random.Random(k).choice(["é<", "b&", "c>", '"d"']) for _ in range(20)) for k in range(30)]
    import html as h

    assert text("".join(f"<p>{h.escape(p)}" for p in paragraphs)) == "\n\n".join(paragraphs)


def _tree(r, depth):
    """A random well-formed page part with the words that it shows, and a marker for what it hides."""
    out, shown = [], []
    for _ in range(r.randint(1, 4)):
        word = "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
        kind = r.choice(["text", "div", "b", "section", "hidden", "none", "script", "comment", "ul", "details", "svg", "table"])
        inner, words = _tree(r, depth - 1) if depth else (word, [word])
        if kind == "text":
            out.append(f" {word} ")
            shown.append(word)
        elif kind in ("div", "section", "b"):
            out.append(f"<{kind.upper() if r.random() < 0.3 else kind} class='x>y'>{inner}</{kind}>")
            out.append(" ")
            shown += words
        elif kind == "hidden":
            out.append(f"<div hidden>{inner}</div>")
        elif kind == "none":
            out.append(f'<span style="color:red; Display: NONE">{inner}</span> ')
        elif kind == "script":
            out.append(f"<script>if (a<b) '{word}' </scrip </SCRIPT >")
        elif kind == "comment":
            out.append(f"<!-- {word} <b> -->")
        elif kind == "ul":
            out.append(f"<ul><li> {inner} </ul>")
            shown += ["-", *words]
        elif kind == "details":
            out.append(f"<details><summary>{word}</summary>{inner}</details>")
            shown.append(word)
        elif kind == "svg":
            out.append(f" <svg><desc>no</desc><text>{word}</text></svg> ")
            shown.append(word)
        elif kind == "table":
            out.append(f"<table><tr><td>{word}<td>z{word}</table>")
            shown += [word, f"z{word}"]
    return "".join(out), shown


def test_html_generated_pages():
    r = random.Random(11)
    for _ in range(300):
        page, shown = _tree(r, r.randint(0, 4))
        deep = r.choice([0, 0, 250])
        text = html_text.page_text("<div>" * deep + page + "</div>" * deep)
        assert [w for w in text.split() if w != "-"] == [w for w in shown if w != "-"], page  # an item that begins with a list shows one bullet


def test_html_former_limits():
    text = html_text.page_text
    assert text("<div>" * 205 + "<script>var x=1</script><p hidden>h</p>v") == "v"
    assert text("\u0130 <SCRIPT>var x</SCRIPT>visible text") == "\u0130 visible text"
    assert text("<math><mi>x</mi><annotation>no</annotation></math><input value=abc><input type=hidden value=no>").split() == ["x", "abc"]
    assert text("<script>a</\u017fcript></script>b") == "b"  # letters of ASCII alone match without case
    assert text("<ul><li>" * 5000 + "x").endswith("- x")


def test_html_query(spark):
    df = spark.createDataFrame([(1, "u", "<p>x"), (2, "u", None), (2, "u", None)], "page_id long, url string, html string")
    assert sorted(((r["page_id"], r["text"]) for r in html_text.extract(df).collect()), key=repr) == [(1, "x"), (2, None), (2, None)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_words_of_equal_polynomials_stay(spark):
    order = "a"
    while len(order) < 1024:
        order += order.translate(str.maketrans("ab", "ba"))
    swapped, tail = order.translate(str.maketrans("ab", "ba")), " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{order} {tail}"), (2, f"{swapped} {tail}"), (3, f"{swapped} {tail} end")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_dealt_join_is_a_join(spark, monkeypatch):
    from tallyforge.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k, "x") for k in range(400)] + [(None, 1, "x"), (99, 1, "x")], "key long, doc_id long, deal string")
    keys = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "key long, value string").join(rows.groupBy("key").count().withColumnRenamed("count", "n"), "key")
    got = common.dealt_join(rows, keys, ["key"], "doc_id")
    assert got.columns == ["key", "doc_id", "deal", "value"]
    assert sorted(map(tuple, got.collect())) == sorted((r["key"], r["doc_id"], "x", f"v{r['key']}") for r in rows.collect() if r["key"] is not None and r["key"] < 7)


def test_unusual_words_are_coded_by_the_coder(monkeypatch):
    r = random.Random(4)
    path = tokens.default_tokenizer()
    coder = bpe.SpeculativeCoder(path)
    own = tokens.WordIds(path, coder)
    asked = []
    whole = own.whole
    monkeypatch.setattr(own, "whole", lambda word: asked.append(word) or whole(word))
    marks = "ab'sÉé—“”€日本語Σς́ͅ ẞİK \x85\x1cﬁ한글🙂é9٣½ \n\t"
    for _ in range(400):
        text = "".join(r.choice(marks) for _ in range(r.randint(1, 60)))
        assert np.frombuffer(own.batch([text])[0], "<u4").tolist() == encoded(text), repr(text)
    assert not asked  # only words with a special token go to the library
    text = "a — b <|endoftext|>c x<|startoftext|>́ “d”"
    assert np.frombuffer(own.batch([text])[0], "<u4").tolist() == encoded(text)
    assert asked and all("<|" in w for w in asked)


def test_simhash_full_cells(spark, monkeypatch):
    r = np.random.default_rng(8)
    centre = int(r.integers(0, 1 << 63))
    prints = {centre}
    while len(prints) < 700:  # a ball in which all cells are full
        prints.add(centre ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 7), replace=False)))
    prints |= {int(x) for x in r.integers(0, 1 << 63, 100)}
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "FULL", 16)
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints], "print long")
    found = {tuple(row) for row in simhash.near_links(df).collect()}
    u = np.array(prints, "u8")
    at = {int(x): k for k, x in enumerate(u.view("i8").tolist())}

    def roots(links):
        top = list(range(len(prints)))

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in links:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(prints))]

    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    assert all(near[at[a], at[b]] for a, b in found)
    assert roots([(at[a], at[b]) for a, b in found]) == roots(zip(*np.nonzero(np.triu(near, 1)), strict=True))


def test_language_distance_and_hot_language(spark, monkeypatch):
    r = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "fghij"}
    say = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 25)))
    rows = [(k, say(alphabets[lang]), lang) for k in range(240) for lang in [r.choice(["aa", "aa", "aa", "bb", "cc"])]]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "x", None)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 10)
    monkeypatch.setattr(language_id, "HOT_PART", 4)
    monkeypatch.setattr(language_id, "MARGIN", 3)
    profiles = language_id.train(df)

    def grams(text):
        counts = {}
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"\0{word}\0"
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    if g.strip("\0") and not (n == 3 and g[1] == "\0"):
                        counts[g] = counts.get(g, 0) + 1
        return counts

    # the rank lists by the operator's own hashes, the distances by the definition
    for _, text, _ in rows:
        own = language_id.ranked(*language_id.ngrams(text)).tolist()
        hashes, counts = language_id.ngrams(text)
        assert sorted(counts.tolist()) == sorted(grams(text).values())
        name, score = profiles.predict(text)
        if not own:
            assert (name, score) == ("und", 0.0)
            continue
        sums = []
        for k in range(3):
            held = dict(zip(profiles.grams[profiles.langs == k].tolist(), profiles.ranks[profiles.langs == k].tolist(), strict=True))
            sums.append(sum(abs(place - held[g]) if g in held else profiles.size for place, g in enumerate(own)))
        best = sums.index(min(sums))
        least, second = sorted(sums)[:2]
        assert name == profiles.names[best] and abs(score - second / (least + second)) < 1e-12
    right = sum(profiles.predict(t)[0] == lang for _, t, lang in rows if t)
    assert right > 0.9 * len(rows)


def test_quality_verdicts(docs):
    import regex

    classes = [p.replace(r"[\p{L}&&[^\p{Lu}]]+", r"[\p{L}--\p{Lu}]+") for p in quality_rules.CLASSES]

    def histograms(text):
        w = WORD.findall(text or "")
        left, sizes = "".join(w), [len("".join(w))]
        for p in classes:
            left = regex.sub("(?V1)" + p, "", left)
            sizes.append(len(left))
        common = np.array([sum(x.lower() == c for x in w) for c in quality_rules.COMMON], float)
        return len(w), np.r_[-np.diff(sizes), sizes[-1]].astype(float), np.r_[common, len(w) - common.sum()]

    def distance(p, q):
        mid = (p + q) / 2
        kl = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / mid[a > 0])))
        return np.sqrt(max((kl(p) + kl(q)) / 2, 0))

    rows = {r[0]: r for r in corpus()}
    sums = {}
    for _, text, lang, *_ in corpus():
        if lang:
            n, chars, words_ = histograms(text)
            a, b = sums.setdefault(lang, [0.0, 0.0])
            sums[lang] = [a + chars, b + words_]
    refs = {k: (a / max(a.sum(), 1), b / max(b.sum(), 1)) for k, (a, b) in sums.items() if b.sum()}
    for r in quality_rules.judge(docs).collect():
        n, chars, words_ = histograms(rows[r["doc_id"]][1])
        most = 0.24 + 0.5 / np.sqrt(max(n, 1)), 0.25 + 1 / np.sqrt(max(n, 1))
        each = [(distance(chars / max(chars.sum(), 1), a), distance(words_ / max(n, 1), b)) for a, b in refs.values()]
        c, w = min(each, key=lambda x: max(x[0] / most[0], x[1] / most[1]))
        if n:
            assert (r["class_distance"], r["word_distance"]) == (pytest.approx(c, abs=1e-9), pytest.approx(w, abs=1e-9))
        short = n < quality_rules.MIN_WORDS or chars.sum() < quality_rules.MIN_CHARS
        assert r["kept"] == (not r["base_failed"] and (short or (c <= most[0] and w <= most[1])))


def test_repeated_ids_and_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    found = quality.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in found if r["quality"] == 1], [r["score"] for r in found if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    # of different texts with one id the least trains, in whatever order they come
    some = docs.join(labels, "doc_id").select(docs["doc_id"], "text").limit(200).cache()
    twice = some.unionByName(some.selectExpr("doc_id", "concat('zz ', text) AS text"))
    a, b = quality.train(twice, labels), quality.train(twice.repartition(3).orderBy("text", ascending=False), labels)
    assert np.array_equal(a.w1, b.w1) and a.temperature == b.temperature
    langs = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in langs]) > 0.98
    clash = spark.createDataFrame([(5, "the cat and the dog", "en"), (5, "la casa de la playa", "es"), (None, "x", "en")], "doc_id long, text string, lang string")
    assert sorted(r["lang_pred"] for r in language_id.identify(clash, language_id.train(clash)).collect()) == ["en", "en", "es"]


def test_words_are_learnt_as_the_library_codes_them():
    path = tokens.default_tokenizer()
    library, calls = tokens.load(path), []

    class Coder(tokens.LibraryCoder):
        def ids(self, pieces):
            calls.append(len(pieces))
            return super().ids(pieces)

    own = tokens.WordIds(path, Coder(path))
    own._pieces = lambda word: pytest.fail(f"{word} was cut by the path of unusual characters")  # plain words of a usual text need no search of their own
    wanted = lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for k in [c for c in range(0x21, 0x250) if not tokens.UNUSUAL.search(chr(c)) and not chr(c).isspace()]:
        for word in (f"a{chr(k)}b1", f"x-{chr(k)}y'S", f"{chr(k)}Z", f"{chr(k)}"):  # lower case may lie beyond U+024F
            assert own.batch([word])[0] == wanted(word), word
    assert own.batch(["Ab ab AB", None, "ab"]) == [wanted("Ab ab AB"), b"", wanted("ab")] and calls[-1] <= 1
    for special in own.special[:3]:
        assert tokens.WordIds(path).batch([f"Ab x{special}y {special}"])[0] == wanted(f"Ab x{special}y {special}")
