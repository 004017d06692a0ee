"""Documents whose sets of word shingles have a Jaccard similarity over a limit, by prefixes of token combinations.

Each text is the set of its shingles' 64-bit hashes; equal sets are one node, told by 128 bits. A count-min sketch over
all documents puts each shingle on a level: rare, which certainly stands in few documents, frequent, or very frequent. All sets
are sorted in one order, rare shingles first, very frequent ones last. Two similar sets share at least ``need`` items, so the
first one that they share lies in the first ``n - need + 1`` items of both, and the first ``k + 1`` lie in the first
``n - need + k + 1``. If the first one is rare, both sets are found under it. Otherwise everything they share is frequent; hashes put
items in ``k`` classes, so two of the first ``k + 1`` lie in one class, and both sets are found under the combination of these. With about as many
classes as a similar set may lack items, a set has some twice as many combinations as it may lack items, where all pairs of a
prefix would grow with its square. Classes are a power of two by the smaller of both sizes, so a set near a border enters
under two. No pair is lost, however the sketch draws the lines; a sketch too full to tell rare items only makes more combinations.

A cell of few sets gives a spanning forest of the pairs that pass a test by sizes and bitmaps of parities, whose differing
bits are never more than the differing items. Wider bitmaps, of two bits an item, are held against each other once for each
pair; what is left is tested on the sets. Where a pair fails, its cells give their other pairs. A cell of many sets is
compared in blocks of ``FULL``: bitmaps mark the sets with a likely partner, only these are brought there, and a spanning forest of
their links is given, so a large group gives no pairs. Each set enters one such cell first; cells whose sets are in
one component by then are done. All links are tested on the sets, by 48 bits of each item.

Defined cases: texts without words are linked with nothing, not even with each other; a text with fewer words than a
shingle is one shingle; documents with a null id take part but never name a component that holds another id; rows that
repeat an id are all returned; other columns are ignored, whatever their names; no documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from .common import free_disk, fresh_path, remove_path, small_batches, stored, stored_at, table, texts
from .sketches import Counters, Often, often_at

SEED = 42
#: Counters in a row of the sketch; a shingle is rare if it is counted fewer times than ``RARE``, and very frequent from as many on beside what a counter holds of others.
WIDTH = 1 << 21
RARE = 64
#: Classes that a prefix of frequent items is cut into at most, which only very long sets reach.
LONG = 512
#: Sets of a cell that are compared in pairs of rows, and sets of one block of a larger cell.
FEW = 64
FULL = 1024
#: Bytes of a bitmap of parities that goes into cells, for sets of at most ``SMALL`` items and for larger ones.
MAP = 64
SMALL = 1024
LARGE_MAP = 256
#: Bytes of an item in a set that is compared.
ITEM = 6
RARE_KEY, TWO_KEY = 0, 1
#: Of cells under single frequent items, which no set enters any more.
LONG_KEY = 2


class Limit(NamedTuple):
    """``over / under``, the least similarity, and the words of a shingle."""

    over: int
    under: int
    shingle: int

    def need(self, n: int) -> int:
        return -(-self.over * n // self.under)

    def sized(self, n, m):
        """Whether sets of so many items can be similar."""
        return (self.under * np.minimum(n, m)) >= (self.over * np.maximum(n, m))

    def differ(self, n, m):
        """The most items in which similar sets of so many items differ."""
        return (self.under - self.over) * (n + m) // (self.under + self.over)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.under * both >= self.over * (len(a) + len(b) - both)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower changes A-Z only
    grams = [tuple(own)] if 0 < len(own) < shingle else zip(*(own[k:] for k in range(shingle)), strict=False)
    return np.unique(np.fromiter(map(xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), "u8"))


def parities(items: np.ndarray, size: int) -> np.ndarray:
    """For each of 8 ``size`` bits whether an odd number of items fall on it."""
    odd = np.bincount(((items >> np.uint64(20)) % np.uint64(8 * size)).astype("i8"), minlength=8 * size) & 1
    return np.packbits(odd.astype("u1"))


def packed(items: np.ndarray) -> bytes:
    return np.ascontiguousarray(items.astype("<u8").view("u1").reshape(-1, 8)[:, :ITEM]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """Items by their low bytes, sorted."""
    out = np.zeros((len(blob) // ITEM, 8), "u1")
    out[:, :ITEM] = np.frombuffer(blob, "u1").reshape(-1, ITEM)
    return np.sort(out.view("<u8").ravel())


def classes(n: int, limit: Limit) -> int:
    """Classes that the prefix of a set of ``n`` items is cut into: a power of two, no more than items that a similar set may lack."""
    most = max(1, min(n - limit.need(n), limit.need(n) - 1, LONG))
    return 1 << (most.bit_length() - 1)


def combined(order: np.ndarray, n_classes: int) -> np.ndarray:
    """A key for each two items of one class, which come in the order that all sets have."""
    kind = (order >> np.uint64(20)) & np.uint64(n_classes - 1)
    at = np.argsort(kind, kind="stable")
    order, kind, out = order[at], kind[at], []
    for step in range(1, len(order)):
        same = kind[step:] == kind[:-step]
        if not same.any():
            break
        one, two = order[:-step][same], order[step:][same]
        with np.errstate(over="ignore"):
            out.append((one * np.uint64(0x9E3779B97F4A7C15)) ^ (two + (one >> np.uint64(29))))
    return np.concatenate([np.zeros(0, "u8"), *out])


def keys(items: np.ndarray, late: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and keys of all cells that a set enters; ``late`` is 0 for rare items and greater for more frequent ones."""
    n = len(items)
    if limit.under * n < limit.over * (n + 1):  # no other set is similar to one so small
        return np.zeros(0, "i1"), np.zeros(0, "i8")
    lacking = n - limit.need(n)
    order = items[np.lexsort((items, late))]
    n_rare = n - int(np.count_nonzero(late))
    rare, two = order[: min(lacking + 1, n_rare)], []
    if n_rare <= lacking:  # else a similar set has one of the rare items
        k = classes(limit.need(n), limit)  # of the smallest similar set
        while k <= classes(n, limit):
            two.append(combined(order[n_rare : lacking + k + 1], k))
            k *= 2
    two = np.unique(np.concatenate([np.zeros(0, "u8"), *two]))
    return np.r_[np.full(len(rare), RARE_KEY, "i1"), np.full(len(two), TWO_KEY, "i1")], np.r_[rare, two].view("i8")


def _counted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(WIDTH)
        for batch in batches:
            counters.add(np.concatenate([np.zeros(0, "u8"), *(shingle_set(t, shingle) for t in texts(batch))]))
        yield from counters.blocks()

    return run


def _nodes(limit: Limit, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        tell: list[Often] = frequent.value
        for batch in batches:
            sets = [shingle_set(t, limit.shingle) for t in texts(batch)]
            every = np.concatenate([np.zeros(0, "u8"), *sets])
            late = np.split(sum(t(every).astype("i1") for t in tell), np.cumsum([len(s) for s in sets])[:-1])
            found = [keys(s, f, limit) for s, f in zip(sets, late, strict=True)]
            columns = [batch.column(0), batch.column(2), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            columns += [pa.array([k for k, _ in found], pa.list_(pa.int8())), pa.array([k for _, k in found], pa.list_(pa.int64())), pa.array([parities(s, MAP if len(s) <= SMALL else LARGE_MAP).tobytes() for s in sets], pa.binary()), pa.array([wide_map(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "kinds", "cells", "map", "wide"])

    return run


def _items(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingle_set(t, shingle) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([packed(s) for s in sets], pa.binary())], ["node", "items"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of equal first ``keys`` columns, which come one after the other, as lists of columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield list(zip(*held, strict=True))
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield list(zip(*held, strict=True))


def _links_of(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _few(limit: Limit, spanning: bool):
    """Pairs ``(u, v, kind, cell)`` of cells of few sets that pass the tests of sizes and bitmaps: all, or a spanning forest of them."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("kind", pa.int8()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, schema, strict=True)], schema=schema)

        for kinds, cells, nodes, sizes, maps in _runs(batches, 2):
            n, label = np.array(sizes), np.arange(len(sizes))
            bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, "u8").reshape(-1, MAP // 8), axis=0) for m in maps])
            large = n > SMALL
            wide = np.zeros((len(n), LARGE_MAP // 8), "u8")
            for k in np.flatnonzero(large).tolist():
                wide[k] = np.frombuffer(maps[k], "u8")
            for i in range(len(n) - 1):
                j = i + 1 + np.flatnonzero(limit.sized(n[i], n[i + 1 :]))
                if len(j):
                    j = j[np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype="i4") <= limit.differ(n[i], n[j])]
                if len(j) and large[i]:
                    j = j[~large[j] | (np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype="i4") <= limit.differ(n[i], n[j]))]
                for k in j.tolist():
                    if not spanning or label[k] != label[i]:
                        label[label == label[k]] = label[i]
                        out.append((nodes[i], nodes[k], kinds[0], cells[0]))  # nodes come in order
            if len(out) > 1 << 14:
                yield given()
                out = []
        yield given()

    return run


def forest(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, across: bool, limit: Limit) -> list[tuple[int, int]]:
    """Links of a spanning forest of similar sets of unlike ``label``, which it changes; with ``across`` only of pairs of which one is ``left``."""
    n = np.array([len(s) for s in sets])
    maps = np.stack([parities(s, LARGE_MAP) for s in sets]).view("u8")
    out = []
    for i in range(len(sets) - 1):
        near = limit.sized(n[i], n[i + 1 :]) & (label[i + 1 :] != label[i])
        if across:
            near &= left[i + 1 :] != left[i]
        j = i + 1 + np.flatnonzero(near)
        j = j[np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype="i4") <= limit.differ(n[i], n[j])]
        for k in j.tolist():
            if label[k] != label[i] and limit.similar(sets[i], sets[k]):
                label[label == label[k]] = label[i]
                out.append((i, k))
    return out


def likely_rows(maps: list[bytes], n: np.ndarray, root: np.ndarray, left: np.ndarray, across: bool, limit: Limit) -> np.ndarray:
    """Which sets have a partner of unlike ``root`` whose bitmap differs in no more bits than similar sets may in items; ``across`` as in ``forest``."""
    out, widths = np.zeros(len(n), bool), np.array([len(m) for m in maps])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        at = np.r_[own, np.flatnonzero(widths > width)]  # wider bitmaps are folded
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(maps[k], "u8").reshape(-1, width // 8), axis=0) for k in at.tolist()])
        for i, k in enumerate(own.tolist()):
            near = limit.sized(n[k], n[at[i + 1 :]]) & (root[at[i + 1 :]] != root[k])
            if across:
                near &= left[at[i + 1 :]] != left[k]
            j = i + 1 + np.flatnonzero(near)
            j = j[np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype="i4") <= limit.differ(n[k], n[at[j]])]
            if len(j):
                out[k] = True
                out[at[j]] = True
    return out


def _marked(limit: Limit):
    """Those rows of blocks of cells of many sets that have a likely partner there."""
    schema = pa.schema([("kind", pa.int8()), ("cell", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("node", pa.binary()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, sizes, maps in _runs(batches, 4):
            _, _, low, high, block, _, roots = columns
            at = {root: k for k, root in enumerate(roots)}
            root = np.array([at[r] for r in roots])
            mark = pa.array(likely_rows(maps, np.array(sizes), root, np.array(block) == low[0], low[0] != high[0], limit))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type).filter(mark) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _many(limit: Limit):
    """Links of blocks of cells of many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, low, high, block, nodes, roots, items in _runs(batches, 4):
            sets, at = [unpacked(x) for x in items], {root: k for k, root in enumerate(roots)}
            label = np.array([at[root] for root in roots])
            found = forest(sets, label, np.array(block) == low[0], low[0] != high[0], limit)
            yield _links_of([(nodes[i], nodes[k]) for i, k in found])

    return run


def wide_map(items: np.ndarray) -> bytes:
    """Parities in a power of two of bytes, some two bits an item."""
    return parities(items, max(MAP, 1 << max(len(items) // 4 - 1, 0).bit_length())).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded, which leaves the parities of items modulo the smaller size."""
    x, y = (np.frombuffer(m, "u1") for m in (a, b))
    small = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(m.reshape(-1, small), axis=0) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _likely(limit: Limit):
    """Pairs whose wide bitmaps differ in no more bits than similar sets may in items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            near = pa.array([differing(a, b) <= limit.differ(n, m) for a, b, n, m in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["u", "v"])

    return run


def _tested(limit: Limit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([unpacked(x) for x in batch.column(k).to_pylist()] for k in (2, 3))
            near = pa.array([limit.similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["u", "v"])

    return run


def linked_nodes(distinct: DataFrame, items: DataFrame, limit: Limit) -> DataFrame:
    """``(node, component)`` of all nodes of ``distinct`` (node, text_key, n, kinds, cells, map, wide) that are similar to another."""
    spark = distinct.sparkSession
    postings = distinct.select("node", F.explode(F.arrays_zip("kinds", "cells")).alias("x")).select(F.col("x.kinds").alias("kind"), F.col("x.cells").alias("cell"), "node")
    sizes = stored(postings.groupBy("kind", "cell").agg(F.count("*").alias("size")).where("size > 1"), "cells")
    placed = stored(postings.join(sizes, ["kind", "cell"]), "postings")
    free_disk(spark)

    few = placed.where(F.col("size") <= FEW).join(distinct.select("node", "n", "map"), "node").select("kind", "cell", "node", "n", "map")
    near = lambda rows, spanning: rows.repartition("kind", "cell").sortWithinPartitions("kind", "cell", "node").mapInArrow(_few(limit, spanning), "u binary, v binary, kind byte, cell long")
    pairs = stored(near(few, True), "candidates")
    free_disk(spark)

    blocks = F.ceil(F.col("size") / FULL).cast("int")
    many = placed.where(F.col("size") > FEW).select("kind", "cell", "size", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.sequence(F.lit(0), blocks - 1).alias("others"))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(many.select("node")).distinct()
    wanted = stored(distinct.join(wanted, "node").select("text_key").distinct(), "wanted-texts")
    once = items.join(wanted, "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    sets = stored(once.select("text").mapInArrow(_items(limit.shingle), "node binary, items binary"), "sets")
    free_disk(spark)

    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("items").alias(name))
    wide = lambda c: distinct.select(F.col("node").alias(c), F.col("wide").alias(f"{c}_map"), F.col("n").alias(f"{c}_n"))
    likely = lambda some: stored(some.join(wide("u"), "u").join(wide("v"), "v").select("u", "v", "u_map", "v_map", "u_n", "v_n").mapInArrow(_likely(limit), "u binary, v binary"), "likely-pairs")
    tested = lambda some: likely(some).join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_tested(limit), "u binary, v binary")
    # one partner of each set comes first; then only pairs that this has not brought together
    every = pairs.select("u", "v").distinct()
    one = stored(every.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "first-partners")
    first = stored(tested(one), "links")
    free_disk(spark)
    # a set's linked first partner tells what is together well enough to leave pairs out
    hub = first.select(F.col("v").alias("node"), F.col("u").alias("root"))
    root = lambda c: hub.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = lambda some: some.join(root("u").hint("merge"), "u", "left").join(root("v").hint("merge"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    left = stored(apart(every.join(one, ["u", "v"], "left_anti")), "other-partners")
    second = stored(tested(left), "links")
    free_disk(spark)
    # a pair that failed may have stood for others of its cell
    failed = one.unionByName(left).join(first.unionByName(second), ["u", "v"], "left_anti")
    cells = stored(pairs.join(failed, ["u", "v"], "left_semi").select("kind", "cell").distinct(), "failed-cells")
    others = near(few.join(cells, ["kind", "cell"], "left_semi"), False).select("u", "v").distinct().join(pairs.select("u", "v"), ["u", "v"], "left_anti")
    fourth = stored(tested(apart(others)), "links")
    free_disk(spark)
    linked = first.unionByName(second).unionByName(fourth)
    if not many.take(1):
        return components(linked, "u", "v")
    # of its large cells a set enters the least one first; then only cells count in which this has left sets apart
    work = ["kind", "cell", "low", "high"]
    in_order = lambda rows: rows.repartition(*work).sortWithinPartitions(*work)

    def within(roots: DataFrame, own: bool) -> DataFrame:
        """Links of large cells between sets of unlike ``root``; with ``own`` each set enters one cell only."""
        rooted = stored(many.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "large-cells")
        mixed = rooted.groupBy("kind", "cell").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("kind", "cell")
        open_cells = rooted.join(mixed.hint("merge"), ["kind", "cell"], "left_semi")
        if own:
            least = open_cells.groupBy("node").agg(F.min(F.struct("size", "kind", "cell")).alias("x")).select("node", "x.kind", "x.cell")
            open_cells = open_cells.join(least.hint("merge"), ["node", "kind", "cell"], "left_semi")
        # files of these tables say little of their size, as nodes and cells repeat, so none is broadcast; each pair of blocks is one piece of work: a set's bitmap goes to as many as its cell has blocks, the set only where it has a likely partner
        spread = open_cells.join(distinct.select("node", "n", "wide").hint("merge"), "node").select("kind", "cell", F.explode("others").alias("other"), "block", "node", "root", "n", "wide")
        spread = spread.select("kind", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "n", "wide")
        marked = stored(in_order(spread).mapInArrow(_marked(limit), "kind byte, cell long, low int, high int, block int, node binary, root binary"), "marked")
        free_disk(spark)
        return stored(in_order(marked.join(sets.hint("merge"), "node").select(*marked.columns, "items")).mapInArrow(_many(limit), "u binary, v binary"), "links")

    linked = linked.unionByName(within(hub, True))
    free_disk(spark)
    roots = stored(components(linked, "u", "v"), "roots")
    more = within(roots.select("node", F.col("component").alias("root")), False)
    free_disk(spark)
    if not more.take(1):
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "u", "v")


def similar_documents(docs: DataFrame, limit: Limit) -> DataFrame:
    """``(doc_id, node, n, component_id)`` of every document; ``node`` tells sets apart, ``n`` is a set's size."""
    spark = docs.sparkSession
    small_batches(spark)
    items = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    frequent = often_at(items.select("text"), _counted(limit.shingle), WIDTH, lambda n: RARE, lambda n: min(RARE + 2 * n // WIDTH, 65535))
    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, node binary, n int, kinds array<byte>, cells array<long>, map binary, wide binary"
    at = fresh_path(spark, "shingle-nodes")
    every = stored_at(items.mapInArrow(_nodes(limit, spark.sparkContext.broadcast(frequent)), schema), at)
    firsts = [F.first(c).alias(c) for c in ("n", "kinds", "cells", "map", "wide")]
    distinct = every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), *firsts)
    distinct = stored(distinct, "distinct-nodes")
    every = stored(every.select("doc_id", "node", "n"), "documents-nodes")
    remove_path(spark, at)
    free_disk(spark)
    roots = linked_nodes(distinct, items, limit)
    rooted = stored(distinct.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    joined = every.select("doc_id", "node", "n").join(named, "node", "left")
    return joined.select("doc_id", "node", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of a similarity of 0.9 over three-word shingles."""
    found = similar_documents(table(spark, sf_dir, "documents"), Limit(90, 100, 3))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
