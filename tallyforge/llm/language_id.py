"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A language's profile is the ``PROFILE`` most frequent 1- to 3-grams of letters in a bounded sample
of its training documents, ``PER_LANGUAGE`` for each language, those with the
smallest hash of their id; every language has a profile. A document's own most frequent n-grams are ranked in the same way,
over its whole text; each adds how far its rank lies from the profile's rank, or ``PROFILE`` where
the profile lacks it. The language with the least sum is predicted. The score is
``second / (best + second)`` of the two least sums, between 0.5 and 1; with one language known it
is 1 minus the sum's share of its maximum.

Defined cases: a null text, a text without letters, or no profile at all gives ``und`` with score 0.
Equal distances go to the first language by name, equal counts of n-grams to the lower n-gram hash.
Rows that repeat give equal rows; other columns are ignored. ``held_out`` is null for a null id, which
never trains; texts that share an id all train where that id is in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import crc_mod5, small_batches, table, texts

PROFILE = 300
PER_LANGUAGE = 400
#: Languages of more than this part of all rows are hot; there can be no more of them.
HOT_PART = 1024
MARGIN = 4
UNDETERMINED = "und"
U8 = np.uint64
MULTIPLIERS = [U8(0x9E3779B97F4A7C15), U8(0xC2B2AE3D27D4EB4F), U8(0x165667B19E3779F9)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct 1- to 3-grams of a text's letters, with their counts; word ends count as a letter."""
    none = np.zeros(0, "u8"), np.zeros(0, "i8")
    if not text:
        return none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return none
    codes = np.r_[0, np.where(letter, codes, 0), 0].astype("u8")
    kept = codes != 0
    codes = codes[kept | np.r_[True, kept[:-1]]]  # one zero between words
    one = codes[codes != 0] * MULTIPLIERS[0]
    two = codes[:-1] * MULTIPLIERS[1] + codes[1:] * MULTIPLIERS[0]
    three = (codes[:-2] * MULTIPLIERS[2] + codes[1:-1] * MULTIPLIERS[1] + codes[2:] * MULTIPLIERS[0])[codes[1:-1] != 0]
    hashes = np.concatenate([one, two + U8(1 << 62), three + U8(1 << 63)])
    hashes.sort()
    begins = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[begins], np.diff(np.r_[begins, len(hashes)])


def ranked(hashes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    return hashes[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    def __init__(self, by_language: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(by_language), size
        # entries (gram, language, rank) sorted by gram: memory follows the profiles, not grams times languages
        grams = np.array([g for n in self.names for g in by_language[n]], "u8")
        langs = np.repeat(np.arange(len(self.names)), [len(by_language[n]) for n in self.names])
        ranks = np.concatenate([np.zeros(0, "i8"), *[np.arange(len(by_language[n])) for n in self.names]])
        order = np.argsort(grams, kind="stable")
        self.grams, self.langs, self.ranks = grams[order], langs[order], ranks[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        begins, ends = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        sizes = ends - begins
        at = np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        places = np.repeat(np.arange(len(own)), sizes)
        gains = self.size - np.abs(self.ranks[at] - places)
        sums = self.size * len(own) - np.bincount(self.langs[at], gains, len(self.names)).astype("i8")
        best = int(np.argmin(sums))
        if len(self.names) == 1:
            return self.names[0], 1 - float(sums[0]) / (self.size * len(own))
        least, second = np.sort(sums)[:2].tolist()
        return self.names[best], second / (least + second) if least + second else 0.5


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            hashes, counts = ngrams(text)
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hashes)), pa.array(hashes.view("i8")), pa.array(counts.astype("i8"))], ["lang", "gram", "n"])


def train(docs: DataFrame) -> Profiles:
    """Profiles from documents with a language; ``docs`` holds training documents only."""
    small_batches(docs.sparkSession)
    named = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    order = F.xxhash64("doc_id")
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).cache()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # a hot language, one of at most HOT_PART, is cut by its hash to some MARGIN times the rows wanted before a task gets its rest
    hot = sizes.where(F.col("n") > max(total // HOT_PART, MARGIN * PER_LANGUAGE))
    bound = (F.lit(float(2**64)) * (MARGIN * PER_LANGUAGE) / F.col("n") - F.lit(float(2**63))).cast("long")
    bounds = F.broadcast(hot.select("lang", bound.alias("bound")))
    few = named.select("doc_id", "lang").join(bounds, "lang", "left").where(F.col("bound").isNull() | (order <= F.col("bound"))).drop("bound")
    best = Window.partitionBy("lang").orderBy(order, "doc_id")
    chosen = few.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PER_LANGUAGE).drop("k")
    keys = chosen.select("doc_id", "lang").distinct()  # at most PER_LANGUAGE a language
    sample = named.join(F.broadcast(keys), ["doc_id", "lang"]).select("lang", "text")
    counts = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the same order as in ranked(): by count, then by the unsigned hash
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PROFILE).orderBy("lang", "k").collect()
    sizes.unpersist()
    by_language: dict[str, list[int]] = {}
    for row in top:
        by_language.setdefault(row["lang"], []).append(row["gram"] % (1 << 64))
    return Profiles(by_language)


def _predict(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiles.value
        for batch in batches:
            names, scores = zip(*(own.predict(t) for t in texts(batch)), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document; held out are ids whose crc32 is divisible by 5."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE ranks a language
    items = docs.select("doc_id", "text", (crc_mod5("doc_id") == 0).alias("held_out"))
    kind = items.schema["doc_id"].dataType.simpleString()
    return items.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(crc_mod5("doc_id") != 0)))
