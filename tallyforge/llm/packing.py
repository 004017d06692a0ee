"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs its own documents: what a document fills alone becomes sequences of its own, the
rest goes to a bounded pool. A sequence takes, again and again, the piece of the pool that fits
and whose demand vector has the largest dot product with what is left of the sequence, both in
shares of the limits. When nothing fits whole, the best piece is cut to fill the sequence, so only
a task's last sequence could stay unfilled; that one is cut into lengths that are powers of two,
which need no padding. There is no shuffle, and memory is the pool and one Arrow batch.

Loss-bearing tokens are the last ones of an example (the answer follows the prompt); without a
loss column every token bears loss. A task's sequences are numbered from its partition's number
times 2**33, so a task that runs again gives the same numbers.

Nulls and ties: a null text is the empty text (only the end id), a null loss count means all
tokens, loss counts are held between 0 and the number of tokens; rows that repeat are packed as
often as they occur; an empty table gives no rows. Equal dot products go to the piece that came first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table, texts
from .tokens import WordIds, default_tokenizer

#: Pieces in a task's pool.
POOL = 512


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 1024
    loss_tokens: int = 2048


class Packer:
    """Packs pieces of one task; ``take`` yields finished rows as they come."""

    def __init__(self, limits: Limits, first_sequence: int = 0, pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("every limit must be 1 at least")
        self.limits, self.next, self.size = limits, first_sequence, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], "f8")
        self.need = np.zeros((pool, 3))
        self.open = np.zeros(pool, bool)
        self.items: list[tuple | None] = [None] * pool
        self.age = np.zeros(pool, "i8")
        self.clock = self.waiting = 0

    # An item is (doc, ids, start, end, first loss-bearing place, number of the document's ids).
    def _loss(self, item: tuple, begin: int, end: int) -> int:
        return max(0, end - max(begin, item[4]))

    def _cut(self, item: tuple, tokens: int, loss: int) -> int:
        """The end of the longest piece from the item's start within this room."""
        return min(item[3], item[2] + tokens, max(item[2], item[4]) + loss)

    def _piece(self, item: tuple, end: int, offset: int) -> tuple:
        return (item[0], item[2], end - item[2], zlib.crc32(item[1][4 * item[2] : 4 * end]), item[5], self.next, offset)

    def _put(self, slot: int, item: tuple) -> None:
        self.items[slot] = item
        self.need[slot] = (item[3] - item[2], 1, self._loss(item, item[2], item[3]))
        self.age[slot] = self.clock
        self.clock += 1
        self.open[slot] = True

    def take(self, doc: object, ids: bytes, loss: int | None) -> Iterator[tuple]:
        n = len(ids) // 4
        loss = n if loss is None else min(max(loss, 0), n)
        item = (doc, ids, 0, n, n - loss, n)
        while item[3] - item[2] >= self.limits.tokens or self._loss(item, item[2], n) > self.limits.loss_tokens:
            end = self._cut(item, self.limits.tokens, self.limits.loss_tokens)
            if end - item[2] < self.limits.tokens and end < n:
                break  # the loss limit cuts it; the pool fills what is left of the sequence
            yield self._piece(item, end, 0)
            self.next += 1
            item = (*item[:2], end, *item[3:])
        if item[2] < n:
            while self.waiting == self.size:
                yield from self._sequence()
            self._put(int(np.argmin(self.open)), item)
            self.waiting += 1

    def _sequence(self) -> Iterator[tuple]:
        left, offset, rows = self.cap.copy(), 0, []
        while self.waiting and left[0] >= 1 and left[1] >= 1:
            fits = self.open & (self.need <= left).all(axis=1)
            whole = bool(fits.any())
            score = np.where(fits if whole else self.open, (self.need / self.cap) @ (left / self.cap), -1.0)
            best = np.flatnonzero(score == score.max())
            slot = int(best[np.argmin(self.age[best])])
            item = self.items[slot]
            end = item[3] if whole else self._cut(item, int(left[0]), int(left[2]))
            if end == item[2]:  # no room for its loss-bearing tokens; some other piece may begin without loss
                ends = [(self._cut(self.items[k], int(left[0]), int(left[2])) - self.items[k][2], -self.age[k], k) for k in np.flatnonzero(self.open)]
                grown, _, slot = max(ends)
                if grown < 1:
                    break
                slot, item = int(slot), self.items[int(slot)]
                end = item[2] + grown
            rows.append((item, end, offset))
            left -= (end - item[2], 1, self._loss(item, item[2], end))
            offset += end - item[2]
            if end == item[3]:
                self.items[slot], self.open[slot] = None, False
                self.waiting -= 1
            else:
                self._put(slot, (*item[:2], end, *item[3:]))
        if offset == self.limits.tokens or self.waiting:
            yield from (self._piece(*row) for row in rows)
            self.next += 1
        else:
            yield from self._powers(rows, offset)

    def _powers(self, rows: list[tuple], length: int) -> Iterator[tuple]:
        """The task's last pieces in sequences whose lengths are powers of two."""
        room, offset = 1 << (length.bit_length() - 1), 0
        for item, end, _ in rows:
            while item[2] < end:
                step = min(end - item[2], room - offset)
                yield self._piece(item, item[2] + step, offset)
                item, offset, length = (*item[:2], item[2] + step, *item[3:]), offset + step, length - step
                if offset == room:
                    self.next, offset, room = self.next + 1, 0, 1 << (length.bit_length() - 1) if length else 0

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._sequence()


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(tokenizer: str, end_id: int, limits: Limits, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds(tokenizer), struct.pack("<I", end_id)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

        for batch in batches:
            rows = []
            for doc, ids, loss in zip(batch.column(0).to_pylist(), coder.batch(texts(batch)), batch.column(2).to_pylist(), strict=True):
                rows += packer.take(doc, ids + end, loss)
            if rows:
                yield made(rows)
        if rows := list(packer.finish()):
            yield made(rows)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, limits: Limits = Limits(), loss_column: str | None = None) -> DataFrame:
    """Pieces of every document with their sequence and offset; see the module's text."""
    small_batches(docs.sparkSession)
    loss = F.col(loss_column).cast("long") if loss_column else F.lit(None).cast("long")
    items = docs.select("doc_id", "text", loss.alias("loss"))
    kind = items.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return items.mapInArrow(_pack(tokenizer or default_tokenizer(), end_id, limits, id_type), schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
