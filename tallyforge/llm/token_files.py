"""Token ids in binary shard files with one shared zstandard dictionary.

``write_token_files`` encodes every text, appends an end id, orders documents by id over range
partitions and lets each task write one shard. A shard is

    magic | one zstandard frame per document | index | footer

The index holds each document's id, frame offset, frame size and number of ids, so one short
document is read by its shard's footer and index (25 bytes a document) and then its frame alone. The footer holds the
SHA-256 of the dictionary, which lies beside the shards; a reader refuses another dictionary.
Ids are serialized in 2 bytes where the vocabulary allows, else in 4.

The dictionary is trained on ``DICTIONARY_DOCS`` documents, those with the smallest hash of
their id; it affects sizes only. Each shard is written under a passing name and then moved; object
stores, which show a file only once it is whole, get it under its own name at once. So a task that
runs again after a lost executor leaves the same file.

Nulls and ties: a null text is the empty text (its document is the end id alone); documents with
a null id come first; rows that repeat an id follow each other in the order of their texts. An
empty table gives no shard. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import fresh_path, small_batches, stored, table, texts
from .tokens import WordIds, default_tokenizer, load

MAGIC = b"TALLYIDS1\n"
FOOTER = "<QQI32s10s"
FOOTER_BYTES = struct.calcsize(FOOTER)
ENTRY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4")])
DICTIONARY_DOCS = 200
DICTIONARY_BYTES = 32 * 1024
LEVEL = 3


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))  # Hadoop's names of the scheme


def _width(tokenizer: str, end_id: int) -> int:
    return 2 if max(load(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4


def _serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample; empty if there is too little to train on."""
    import zstandard

    keys = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS)
    chosen = [r[0] for r in keys.collect()]
    if not chosen:
        return b""
    coder, width = WordIds(tokenizer), _width(tokenizer, end_id)
    found = [r[0] for r in docs.where(F.col("doc_id").isin(chosen)).select("text").limit(2 * DICTIONARY_DOCS).collect()]
    samples = [_serialized(i + struct.pack("<I", end_id), width) for i in coder.batch(found)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _write_shards(out_dir: str, tokenizer: str, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, width, end = WordIds(tokenizer), _width(tokenizer, end_id), struct.pack("<I", end_id)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if trained:
            trained.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(dict_data=trained) if trained else zstandard.ZstdCompressor(level=LEVEL)
        part, out, entries, at, total = TaskContext.get().partitionId(), None, [], len(MAGIC), 0
        name = f"shard-{part:06d}.tids"
        fs, root = _open(out_dir)
        whole_at_once = fs.type_name in ("s3", "gcs", "abfs")
        passing = f"{root}/{name}" if whole_at_once else f"{root}/.{name}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows and out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(passing)
                out.write(MAGIC)
            own = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.batch(texts(batch)), strict=True):
                ids += end
                frame = packer.compress(_serialized(ids, width))
                out.write(frame)
                own.append((doc_id is None, doc_id or 0, at, len(frame), len(ids) // 4))
                at, total = at + len(frame), total + len(ids) // 4
            entries.append(np.array(own, ENTRY))
        if out is None:
            return
        index = np.concatenate(entries)
        out.write(index.tobytes())
        out.write(struct.pack(FOOTER, at, len(index), width, hashlib.sha256(dictionary).digest(), MAGIC))
        out.close()
        if not whole_at_once:
            fs.move(passing, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [part], "path": [f"{out_dir}/{name}"], "n_docs": [len(index)], "n_ids": [total]})

    return run


MANIFEST = "shard long, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the shards and returns the manifest: a row per shard with ``first_id``, the ids of all shards before it."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    fs, root = _open(out_dir)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as f:
        f.write(dictionary)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(_write_shards(out_dir, tokenizer, end_id, dictionary), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """One shard file for reading; ``ids(k)`` reads only document k's frame."""

    def __init__(self, path: str):
        import zstandard

        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - FOOTER_BYTES)
        at, n, self.width, digest, magic = struct.unpack(FOOTER, self.file.read(FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        with fs.open_input_file(f"{name.rpartition('/')[0]}/dictionary-{digest.hex()}") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary is not the one that the shard was written with")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def frame(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(raw), f"<u{self.width}").astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        entry = self.index[k]
        self.file.seek(int(entry["at"]))
        return self.frame(self.file.read(int(entry["size"])))

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document by its id; documents lie in ascending order."""
        own = self.index[self.index["null"] == 0]
        k = int(np.searchsorted(own["doc_id"], doc_id))
        return self.ids(k + len(self.index) - len(own)) if k < len(own) and own["doc_id"][k] == doc_id else None

    def all(self, rows: int = 2048) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Index entries and ids, some documents at a time, read in order."""
        for k in range(0, len(self.index), rows):
            own = self.index[k : k + rows]
            begin = int(own["at"][0])
            self.file.seek(begin)
            raw = self.file.read(int(own["at"][-1]) + int(own["size"][-1]) - begin)
            yield own, [self.frame(raw[a - begin : a - begin + s]) for a, s in zip(own["at"].tolist(), own["size"].tolist(), strict=True)]


def _read_shards(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = first
                for own, ids in Shard(path).all():
                    n = own["n"].astype("i8")
                    start = at + np.cumsum(n) - n
                    at += int(n.sum())
                    columns = [
                        pa.array(own["doc_id"].astype("i8"), mask=own["null"].astype(bool)),
                        pa.array(start),
                        pa.array(n),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([i.astype("i4") for i in ids], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document from the shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    spark = manifest.sparkSession
    small_batches(spark)
    spread = manifest.select("path", "first_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(_read_shards(with_ids), schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the shards, read back from them."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "token-files"))
    return read_token_files(manifest)
