"""How far the sources of a language differ in their words, by counts that a sketch keeps small.

A count-min sketch of document frequencies, added up over all tasks, tells which terms can't be in ``LEAST`` documents
of their language: it is never too low. A second reading counts only the others, exactly, in each task before
anything is shuffled; exact document frequencies then decide. Sources of a language are compared over pairs of
counts that both have. For terms that only one of two sources has, the value depends on its count alone, so each source's
counts are grouped by value first; what neither has is a product. So no pair of sources meets all terms.

Defined cases: null text, language and source are empty; every row is a document, whatever its id; a group without
terms is compared like any other; a language without kept terms has pairs of value 0 and no terms; ties go by the item's
UTF-8 bytes; no documents, no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import BATCH_ROWS, small_batches, stored, table
from .sketches import Counters, Often, often

#: A term is kept in a language that has it in so many documents.
LEAST = 10
#: Terms that are listed for each source.
TOP = 10
#: Counters in a row of the sketch.
WIDTH = 1 << 20
#: Distinct terms that a task holds before it hands them on.
HELD = 1 << 19
SCALE = 1_000_000_000
#: Bytes that end a term become spaces, A-Z become a-z; what is no ASCII stays.
FOLDED = bytes(c | 0x20 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all beyond ASCII, in lower case; UTF-8 keeps the two apart."""
    return text.translate(FOLDED).split()


def _hashes(lang: bytes, found: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang) & 0xFFFFFFFF
    return np.fromiter((xxh64_intdigest(t, seed) for t in found), "u8", len(found))


def _columns(batch: pa.RecordBatch) -> zip:
    return zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in range(batch.num_columns)), strict=True)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters, held, n = Counters(WIDTH), {}, 0

    def emptied() -> None:
        for lang, found in held.items():
            counters.add(_hashes(lang, list(found)), np.fromiter(found.values(), "i8", len(found)))
        held.clear()

    for batch in batches:
        for lang, text in _columns(batch):
            own = held.setdefault(lang, Counter())
            n -= len(own)
            own.update(set(terms(text)))
            n += len(own)
            if n > HELD:
                emptied()
                n = 0
    emptied()
    yield from counters.blocks()


def _counted(possible):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell: Often = possible.value
        known: dict[bytes, dict[bytes, bool]] = {}
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        n = 0

        def told(lang: bytes, found: Counter) -> list[bytes]:
            own = known.setdefault(lang, {})
            if new := [t for t in found if t not in own]:
                own.update(zip(new, tell(_hashes(lang, new)).tolist(), strict=True))
            return [t for t in found if own[t]]

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (words, docs) in held.items():
                left = told(lang, words)
                if sum(map(len, known.values())) > HELD:
                    known.clear()
                if left:
                    columns = [pa.array(left, pa.binary()).cast(pa.string()), pa.array([words[t] for t in left], pa.int64()), pa.array([docs[t] for t in left], pa.int64())]
                    names = [pa.repeat(pa.scalar(x.decode(), pa.string()), len(left)) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, *columns], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in _columns(batch):
                if (both := held.get((lang, source))) is None:
                    both = held[lang, source] = (Counter(), Counter())
                found = terms(text)
                n -= len(both[0])
                both[0].update(found)
                both[1].update(set(found))
                n += len(both[0])
                if n > HELD:
                    yield from rows()
                    n = 0
        yield from rows()

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of all terms that may be in ``LEAST`` documents of their language."""
    spark = docs.sparkSession
    small_batches(spark)
    possible = often(docs.select("lang", "text"), _document_counts, WIDTH, lambda n: LEAST)
    counted = docs.select("lang", "source", "text").mapInArrow(_counted(spark.sparkContext.broadcast(possible)), "lang string, source string, term string, n long, docs long")
    return stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def smoothed(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)), exact for any counts; null where nothing is kept."""
    whole = F.lit(SCALE).cast("decimal(12,0)") * (count + 2).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", whole, (total + 2 * kept).cast("decimal(20,0)")) + 1)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); both are 10**9 + 1 at most."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by distance, and the terms that tell a source from its language."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(docs)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST)
    kept = stored(kept.select("lang", "term", "lang_n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "n_terms", "kept", "lang_total"])
    groups = stored(groups.withColumn("none", smoothed(F.lit(0), F.col("total"), F.col("kept"))), "groups")

    scaled = own.join(groups, ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("kept")))
    scaled = stored(scaled.withColumn("q", smoothed(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).select("lang", "source", "term", "p", "q", "none"), "scaled")

    # what both have, less what the sums over either one's counts say of the same terms
    other = scaled.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("op"), F.col("none").alias("onone"))
    p, op, none, onone = (F.col(c) for c in ("p", "op", "none", "onone"))
    both = distance(p, op) - distance(p, onone) - distance(none, op) + distance(none, onone)
    shared = scaled.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(both).alias("value"))
    # what one has: once for each value of its counts
    values = stored(scaled.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("times")), "count-values")
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("onone"))
    alone = F.sum((distance(p, onone) - distance(none, onone)) * F.col("times")).alias("value")
    one = values.join(others, "lang").where("source <> item").groupBy("lang", "source", "item").agg(alone)
    # what neither has
    rest = groups.select("lang", "source", "none", "kept").join(others, "lang").where("source < item")
    rest = rest.select("lang", "source", "item", F.coalesce(F.col("kept") * distance(none, onone), F.lit(0)).alias("value"))
    once = shared.unionByName(rest)
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = once.unionByName(turned(once)).unionByName(one).unionByName(turned(one)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    listed = scaled.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(p, F.col("q")).alias("value"))
    listed = listed.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP)
    return pairs.unionByName(listed)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and telling terms of every source of every language."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
scaled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM scaled a JOIN scaled b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM scaled WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""
