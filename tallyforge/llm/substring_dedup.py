"""Removal of word windows that already stand in a document with a smaller id.

Every window of ``WINDOW`` words has a Rabin-Karp hash of 96 bits: 64 over one and 32 over the
other half of its words' 128-bit hashes. A window counts as repeated only where all 96 bits agree,
from the count to the removal; a whole text only where 128 bits do. Shipping one row per window would move several times the corpus, so windows are thinned exactly first:

1.  Each text names anchors: of the ten 4-word grams inside a window, the one with the least hash.
    Equal windows have equal anchors, and neighbouring windows mostly share theirs, so there is
    about one anchor for five words. Spark counts anchors over distinct texts (copies of a whole
    text are one text, told by a hash of 128 bits): an anchor that one text alone has cannot
    belong to a repeated window.
2.  The first document of each text ships the hashes of only those windows whose anchor repeats.
    Spark takes the smallest document of each window hash; windows of later documents go back
    to their documents.
3.  Each document merges its repeated windows into maximal intervals and removes their words.
    Later copies of a whole text lose all words, if they have a window at all.

Counts come from pre-aggregated groups; joins on hashes deal the rows of a hot hash over many tasks
(``common.dealt_join``). No group is gathered in one task except the windows of one document.

Defined cases: a null text has no words; texts shorter than a window lose nothing; windows that
repeat only inside one document stay; rows that repeat an id count as one document
and never remove each other's words; documents with a null id keep all
words and remove none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dealt_join, free_disk, free_name, fresh_path, remove_path, small_batches, stored, stored_at, table, texts

WINDOW = 13
GRAM = 4
U8 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


class Hashed:
    """A text's words with their hashes, window hashes and anchors."""

    def __init__(self, text: str | None):
        from xxhash import xxh3_128_digest

        self.words = text.encode("utf-8", "surrogatepass").split() if text else []
        halves = np.frombuffer(b"".join(map(xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)
        self.word, self.other = halves[:, 0], halves[:, 1]

    @staticmethod
    def _rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
        """Rabin-Karp hashes of all runs of ``width`` words."""
        n = len(hashes) - width + 1
        if n < 1:
            return np.zeros(0, "u8")
        out = np.zeros(n, "u8")
        for k in range(width):
            out = out * U8(base) + hashes[k : k + n]
        return _mix(out)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and another 32 bits of each window's hash, as signed values."""
        return self._rolled(self.word, width, 0xD1342543DE82EF95).view("i8"), (self._rolled(self.other, width, 0xAF251AF3B0F025B5) >> U8(32)).astype("u4").view("i4")

    def anchors(self, width: int) -> np.ndarray:
        """For each window its anchor's hash, as a signed value."""
        gram = min(GRAM, width)
        grams = self._rolled(self.word, gram, 0xDA942042E4DD58B5)
        n = len(grams) - (width - gram)
        return np.lib.stride_tricks.sliding_window_view(grams, width - gram + 1).min(axis=1).view("i8") if n > 0 else np.zeros(0, "i8")

    def digest(self) -> tuple[int, int]:
        raw = np.frombuffer(hashlib.blake2b(b" ".join(self.words), digest_size=16).digest(), "<i8")
        return int(raw[0]), int(raw[1])


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ones, twos, anchors, owners = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                own = Hashed(text)
                if doc_id is None or len(own.words) < width:
                    continue
                one, two = own.digest()
                ids.append(doc_id)
                ones.append(one)
                twos.append(two)
                anchors.append(np.unique(own.anchors(width)))
                owners.append(np.full(len(anchors[-1]), one))
            if not ids:
                continue
            n, m = len(ids), sum(map(len, anchors))
            empty = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(ids, pa.int64()), empty(m)]),
                    pa.concat_arrays([pa.array(ones, pa.int64()), pa.array(np.concatenate(owners))]),
                    pa.concat_arrays([pa.array(twos, pa.int64()), empty(m)]),
                    pa.concat_arrays([empty(n), pa.array(np.concatenate(anchors))]),
                ],
                ["doc_id", "one", "two", "anchor"],
            )

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for doc_id, text, anchors in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2), strict=True):
                own = Hashed(text)
                first, second = own.windows(width)
                keep = np.isin(own.anchors(width), anchors.values.to_numpy())
                pairs = np.unique(np.rec.fromarrays([first[keep], second[keep]], names="h1,h2")) if len(np.unique(first[keep])) < keep.sum() else np.rec.fromarrays([first[keep], second[keep]], names="h1,h2")
                out.append((pairs["h1"], pairs["h2"], np.full(len(pairs), doc_id)))
            first, second, doc = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(doc)], ["h1", "h2", "doc_id"])

    return run


def _member(windows: Sequence[np.ndarray], removed: Sequence[np.ndarray]) -> np.ndarray:
    """Which windows agree with a removed one in both parts of their hashes."""
    hit = np.isin(windows[0], removed[0])
    pairs = set(zip(*(x.tolist() for x in removed), strict=True))
    places = np.flatnonzero(hit)
    hit[places] = [pair in pairs for pair in zip(*(x[places].tolist() for x in windows), strict=True)]
    return hit


def spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals ``[start, end)`` of the true places."""
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype("i1")))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


KINDS = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string", "removed_spans": "array<struct<start:long,end:long>>"}


def _kept_rows(width: int, wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in wanted}
            for text, copies, removed in zip(texts(batch), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = Hashed(text) if copies or removed.is_valid else None
                words = own.words if own else text.encode("utf-8", "surrogatepass").split() if text else []
                covered = np.zeros(len(words), bool)
                if copies and len(words) >= width and own.digest() in {(c["one"], c["two"]) for c in copies}:
                    covered[:] = True
                elif removed.is_valid:
                    hit = _member(own.windows(width), [removed.values.field(k).to_numpy() for k in range(2)]).astype("i4")
                    steps = np.zeros(len(words) + 1, "i4")
                    steps[: len(hit)] += hit
                    steps[width : width + len(hit)] -= hit
                    covered = np.cumsum(steps)[:-1] > 0
                n = int(covered.sum())
                kept = b" ".join(compress(words, (~covered).tolist())) if n else b" ".join(words)
                for name, value in (("n_words", len(words)), ("n_removed", n)):
                    if name in out:
                        out[name].append(value)
                if "kept_sha256" in out:
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if "kept_text" in out:
                    out["kept_text"].append(kept.decode("utf-8", "surrogatepass") if n else text)
                if "removed_spans" in out:
                    out["removed_spans"].append([{"start": a, "end": b} for a, b in spans(covered)])
            own_types = {"n_words": pa.int64(), "n_removed": pa.int64(), "removed_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
            columns = [batch.column(0), *[pa.array(v, own_types.get(k, pa.string())) for k, v in out.items()]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *out])

    return run


def removals(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, copies, removed)``: documents that lose words, with the hashes of texts that they copy whole and of their repeated windows."""
    small_batches(docs.sparkSession)
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    rows_at, windows_at = fresh_path(spark, "anchors"), fresh_path(spark, "windows")
    rows = stored_at(items.mapInArrow(_anchor_rows(width), "doc_id long, one long, two long, anchor long"), rows_at)
    wholes = rows.where("doc_id is not null").select("doc_id", "one", "two")
    firsts = stored(wholes.groupBy("one", "two").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "firsts")
    repeats = dealt_join(wholes, firsts.where("n > 1"), ["one", "two"], "doc_id")
    copies = stored(repeats.where("doc_id > first_id").select("doc_id", "one", "two").distinct(), "copies")

    anchors = rows.where("anchor is not null").select("anchor", "one")
    repeated = anchors.groupBy("anchor").agg(F.min("one").alias("a"), F.max("one").alias("b"), F.count("*").alias("n")).where("a <> b").select("anchor", "n")
    mine = dealt_join(anchors, stored(repeated, "repeated-anchors"), ["anchor"], "one").groupBy("one").agg(F.collect_set("anchor").alias("anchors"))
    marked = stored(mine.join(firsts.select("one", "first_id"), "one").select(F.col("first_id").alias("doc_id"), "anchors"), "marked")
    remove_path(spark, rows_at)  # what follows reads the stored results only
    free_disk(spark)

    chosen = items.join(marked, "doc_id").select("doc_id", "text", "anchors")
    windows = stored_at(chosen.mapInArrow(_window_rows(width), "h1 long, h2 int, doc_id long"), windows_at)
    free_disk(spark)
    owners = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("owner < last").select("h1", "h2", "owner", "n")
    found = dealt_join(windows, stored(owners, "owners"), ["h1", "h2"], "doc_id")
    later = found.where("doc_id > owner").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("removed"))
    whole = copies.groupBy("doc_id").agg(F.collect_set(F.struct("one", "two")).alias("copies"))
    out = stored(later.join(whole, "doc_id", "full_outer").select("doc_id", "copies", "removed"), "removals")
    remove_path(spark, windows_at)
    free_disk(spark)
    return out


def remove_repeats(docs: DataFrame, width: int = WINDOW, outputs: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """doc_id of every document and the asked-for outputs: counts, kept text, its digest, removed intervals of words."""
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = items.join(removals(docs, width), "doc_id", "left").select("doc_id", "text", "copies", "removed")
    return joined.mapInArrow(_kept_rows(width, tuple(outputs)), ", ".join(["doc_id long", *[f"{o} {KINDS[o]}" for o in outputs]]))


def _rewrite(width: int):
    """Rows with ``copies`` and ``removed`` as their last two columns, which go; text and n_chars follow the removals."""
    kept = _kept_rows(width, ("n_removed", "kept_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names
            places = [at.index("doc_id"), at.index("text"), len(at) - 2, len(at) - 1]
            need = pa.RecordBatch.from_arrays([batch.column(k) for k in places], ["doc_id", "text", "copies", "removed"])
            out = next(kept(iter([need])))
            columns = {n: batch.column(k) for k, n in enumerate(at[:-2])} | {"text": out.column(2)}
            if "n_chars" in columns:
                lost = out.column(1).to_pylist()
                sizes = zip(columns["n_chars"].to_pylist(), out.column(2).to_pylist(), lost, strict=True)
                columns["n_chars"] = pa.array([len(t) if n else old for old, t, n in sizes], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def keep_unrepeated(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with their texts after the removals; texts that lose nothing stay as they are."""
    found = removals(docs, width)
    copies, removed = free_name(docs, "copies"), free_name(docs, "removed")
    found = found.select("doc_id", F.col("copies").alias(copies), F.col("removed").alias(removed))
    joined = docs.join(found, "doc_id", "left").select(*docs.columns, copies, removed)
    return joined.mapInArrow(_rewrite(width), docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words and removed words of every document, and a digest of what stays."""
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))
