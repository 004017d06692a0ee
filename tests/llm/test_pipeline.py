"""The pipeline's stages on the smallest tables, each against what its operator says alone."""

import zlib

import corpus_pipeline
from tallyforge.llm import jaccard_join, quality, quality_rules, simhash, substring_dedup, tokens
from tallyforge.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = {0: docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        kept[k] = stored(stage(spark, kept[k - 1], SF), name)
        assert kept[k].columns == docs.columns
    ids = {k: {r["doc_id"] for r in d.select("doc_id").collect()} for k, d in kept.items()}
    model = quality.train(docs, table(spark, SF, "labels"))
    assert ids[1] == {r["doc_id"] for r in quality.score_documents(docs, model).where("predicted = 1").collect()}
    assert ids[2] == {r["doc_id"] for r in quality_rules.judge(kept[1]).collect() if r["kept"]}
    assert ids[3] == {r["component_id"] for r in simhash.near_duplicates(kept[2], 5).collect()}
    assert ids[4] == ids[3]
    cut = {r["doc_id"]: r for r in substring_dedup.remove_repeats(kept[3]).collect()}
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    assert all(texts[k] == cut[k]["kept_text"] for k in texts)
    pieces = corpus_pipeline.packed(spark, kept[4], SF).collect()
    coder = tokens.WordIds(tokens.default_tokenizer())
    whole = {k: coder.batch([t])[0] + b"\x01\0\0\0" for k, t in texts.items()}
    assert {r["doc_id"] for r in pieces} == ids[4]
    assert sum(r["length"] for r in pieces) == sum(len(w) // 4 for w in whole.values())
    assert all(zlib.crc32(whole[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in pieces)


def _written(spark, at, documents, schema, labels):
    spark.createDataFrame(documents, schema).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
    pieces = sorted(corpus_pipeline.run(spark, at).collect(), key=lambda r: (r["doc_id"], r["start"]))
    for before, after in zip(pieces, pieces[1:]):
        assert after["start"] == (before["start"] + before["length"] if before["doc_id"] == after["doc_id"] else 0)
    return sorted({(r["doc_id"], r["doc_tokens"]) for r in pieces})


def test_pipeline_cases(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = table(spark, SF, "documents").where("doc_id < 80").collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in source]
    labels = [tuple(r) for r in table(spark, SF, "labels").collect()]
    plain = _written(spark, f"file://{tmp_path}/a", rows, schema, labels)
    kept = {r[0] for r in plain}
    assert kept
    one = next(r for r in rows if r[0] in kept)
    extra = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n\t", None, "s", 3), one, one, (None, None, None, None, None)]
    wide = schema + ", print string, copies string, n long, words string, `mark` string, component_id string"
    widened = [(*r, "p", "c", 1, None, "m", "x") for r in [*rows, *extra]]
    found = _written(spark, f"file://{tmp_path}/b", widened, wide, [*labels, (None, 1, 0), (9001, None, None), labels[0]])
    # rows that repeat id and text are one document; null and empty texts go; further columns change nothing
    assert found == plain
    assert _written(spark, f"file://{tmp_path}/c", [], schema, labels) == []
    long = " ".join(f"{w} {k}" for k, w in enumerate(one[1].split() * 200))
    pieces = _written(spark, f"file://{tmp_path}/d", [*rows[:30], (9100, long, "en", "s", 1), (9101, long, "en", "s", 1)], schema, [])
    assert 9101 not in {r[0] for r in pieces}  # without labels all pass the classifier; copies are one document


def test_near_duplicates_go_by_fingerprints(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a join of sets replaces the fingerprints")

    for module in (jaccard_join, simhash):
        monkeypatch.setattr(module, "similar_documents", refused, raising=False)
    docs = table(spark, SF, "documents")
    bits = {r["doc_id"]: simhash.fingerprint(r["text"], 5) for r in docs.select("doc_id", "text").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert 0 < len(kept) < len(bits)
    near = lambda k: any(j < k and (bits[j] ^ bits[k]).bit_count() <= simhash.MOST for j in bits)
    assert all(not near(k) for k in kept) and all(any((bits[j] ^ bits[k]).bit_count() <= simhash.MOST for j in bits if j != k) for k in bits if k not in kept)
