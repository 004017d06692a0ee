"""Exact top-k inner products without random access.

Vectors are quantised to integers. Each task turns its candidates into blocks; a block has one
sorted list per dimension. All lists are read in step from both ends, as a query wants the high end
where its component is positive and the low end where it is negative. After each step there are
bounds for every candidate and query: the lower one from what has been read of the candidate and
the far end of each list in which it has not been met yet, the upper one with the lists' frontiers
in place of the far ends. The threshold is the k-th best score of earlier blocks or the k-th largest
lower bound, whichever is higher. A query stops once nobody outside the read parts can reach it and
few candidates still can; their scores are then resolved by reading on, past everybody else, to the
ends of the lists. No score is ever looked up by id. Steps are matrix products over the parts of the
lists that are new, for many queries at once. The k-th best score goes from block to block of a
task; the tasks' best are merged by Spark.

Queries are collected and broadcast in rounds of at most ``ROUND`` vectors and ``ROUND_BYTES``
bytes, in the order of their ids; with more than one round, each round's answers are written to
the shared folder before the next begins, so the driver never holds more than one. Every pair of a
query and a candidate's block is work: the searches are exact for any data. Sums are kept in
doubles where they are exact in them; otherwise bounds get a margin and scores are resolved in
integers. Scores have to fit a long.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part, and
neither do rows with a null id or empty vectors; only vectors of one length are compared; rows that
repeat an id are all candidates, but never for a query with that id; an id that repeats as a query
is answered once, from its least vector. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..shipping import ship
from .common import fresh_path, stored, table

K = 5
SCALE = 256.0
BLOCK = 4096
ROUND = 1 << 15
ROUND_BYTES = 64 << 20
#: Queries whose bounds are kept at once.
TOGETHER = 128
#: Parts of the lists after whose reading the bounds are brought up to date; the last is their end.
DEPTHS = (8, 2, 1)
#: A query stops where no more than this part of a block can still be among its best.
FEW = 16


class Block:
    """Quantised candidates of one length as a sorted list per dimension: each entry's place in its list, from the low end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        n = len(ids)
        self.ids, self.n = ids, n
        order = np.argsort(values, axis=0, kind="stable")
        self.place = np.empty(values.shape, "i4")
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype="i4")[:, None], values.shape), axis=0)
        self.lists = np.take_along_axis(values, order, axis=0)
        self.low, self.high = self.lists[0], self.lists[-1]
        # an entry counts from the far end of the list that it is read in
        self.above, self.below = values - self.low, values - self.high
        self.largest = float(np.abs(values).max(initial=0))
        self.depths = sorted({max(1, n // p) for p in DEPTHS})
        #: Entries that dense steps and resolving steps read, of all queries.
        self.read, self.resolved = 0, 0

    def steps(self) -> list[tuple]:
        """For each depth how much of the lists is new, what that is from the high and from the low end, and which entries have been read, as factors of products."""
        out, since = [], 0
        for depth in self.depths:
            high, low = self.place >= self.n - depth, self.place < depth
            new_high, new_low = high & (self.place < self.n - since), low & (self.place >= since)
            out.append((depth, depth - since, self.above * new_high.astype("f8"), self.below * new_low.astype("f8"), high.astype("f8"), low.astype("f8")))
            since = depth
        return out

    def best(self, queries: np.ndarray, owns: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query places and scores of at least all candidates that are among its k best and score ``least`` or more; rows with the query's own id are left out."""
        out, steps = [], self.steps()
        for a in range(0, len(queries), TOGETHER):
            part = slice(a, a + TOGETHER)
            out += self._together(steps, queries[part], owns[part], k, least[part].astype("f8"))
        return out

    def _together(self, steps, queries, owns, k, least) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m = self.n, len(queries)
        largest = self.largest * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        margin = 0.0 if largest < 2**51 else 4 * largest * queries.shape[1] * 2.0**-50
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        p, q = plus.astype("f8"), minus.astype("f8")
        mine = [np.flatnonzero(self.ids == own) for own in owns.tolist()]
        base = p @ self.low + q @ self.high
        lower = np.repeat(base[:, None], n, axis=1)
        open_ = np.arange(m)  # queries whose bounds are still dense, one row of ``lower`` each
        pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, "i8"), np.zeros(0))] * m
        for depth, new, up, down, high, low in steps:
            for j in np.setdiff1d(np.arange(m), open_).tolist():  # resolving: only the living entries of the new parts count
                at, scores = pairs[j]
                pairs[j] = at, scores + up[at] @ p[j] + down[at] @ q[j]
                self.resolved += int(np.count_nonzero(up[at]) + np.count_nonzero(down[at]))
            if not len(open_):
                continue
            own_p, own_q = p[open_], q[open_]
            lower += own_p @ up.T
            lower += own_q @ down.T
            self.read += new * up.shape[1] * len(open_)
            # what each list may still add to a candidate that it has not shown yet
            room_p, room_q = own_p * (self.lists[n - depth] - self.low), own_q * (self.lists[depth - 1] - self.high)
            left = (room_p + room_q).sum(axis=1)
            rivals = lower.copy()  # the own rows must not stand for one of the k
            for x, j in enumerate(open_.tolist()):
                rivals[x, mine[j]] = -np.inf
            if n >= k:
                least[open_] = np.maximum(least[open_], np.partition(rivals, n - k, axis=1)[:, n - k] - margin)
            bar = (least[open_] - margin)[:, None]
            if depth < n:
                rivals += left[:, None] - room_p @ high.T
                rivals -= room_q @ low.T  # now the upper bounds
            alive = rivals >= np.maximum(bar, -1e300)
            outside = base[open_] + left  # the upper bound of whom no list has shown
            stops = (depth == n) | ((outside < bar[:, 0]) & (np.count_nonzero(alive, axis=1) <= max(2 * k, n // FEW)))
            for x in np.flatnonzero(stops).tolist():
                at = np.flatnonzero(alive[x])
                pairs[open_[x]] = at, lower[x, at]
            if stops.any():
                lower, open_ = lower[~stops], open_[~stops]
        if margin:  # sums of doubles are not exact: the living are summed once more in integers
            return [(at, self.low @ plus[j] + self.high @ minus[j] + self.above[at] @ plus[j] + self.below[at] @ minus[j]) for j, (at, _) in enumerate(pairs)]
        return [(at, np.rint(scores).astype("i8")) for at, scores in pairs]


class Best:
    """The k best scores of each query so far, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, "i8"), np.zeros(0, "i8")) for _ in query_ids]

    def add(self, block: Block) -> None:
        least = np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.found])
        for j, (at, new) in enumerate(block.best(self.queries, self.query_ids, self.k, least)):
            if len(at):
                scores, ids = self.found[j]
                scores, ids = np.r_[scores, new], np.r_[ids, block.ids[at]]
                order = np.lexsort((ids, -scores))[: self.k]
                self.found[j] = scores[order], ids[order]


def _quantised(vectors: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of usable vectors and, by length, their rows and integers."""
    rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    flat, offsets = vectors.values, vectors.offsets.to_numpy()
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    bad = np.r_[0, np.cumsum(~np.isfinite(numbers))]
    begins, ends = offsets[:-1][rows], offsets[1:][rows]
    usable = (bad[ends] == bad[begins]) & (ends > begins)
    rows, begins, ends = rows[usable], begins[usable], ends[usable]
    out = {}
    for size in np.unique(ends - begins).tolist():
        own = np.flatnonzero(ends - begins == size)
        places = begins[own][:, None] + np.arange(size)
        out[size] = rows[own], np.floor(SCALE * numbers[places]).astype("i8")
    return rows, out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for size, (rows, values) in _quantised(batch.column(1))[1].items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(rows)), pa.array(ids[rows]), pa.array([v.tobytes() for v in values], pa.binary())], ["size", "vec_id", "vector"])


def _search(queries, k: int):
    """queries: by vector length, ids and integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(ids, values, k) for size, (ids, values) in queries.value.items()}
        waiting: dict[int, list] = {size: [] for size in best}

        def flush(size: int) -> None:
            ids, values = (np.concatenate(x) for x in zip(*waiting[size], strict=True))
            waiting[size] = []
            for a in range(0, len(ids), BLOCK):
                best[size].add(Block(ids[a : a + BLOCK], values[a : a + BLOCK]))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for size, (rows, values) in _quantised(batch.column(1))[1].items():
                if size in best:
                    waiting[size].append((ids[rows], values))
                    if sum(len(x[0]) for x in waiting[size]) >= BLOCK:
                        flush(size)
        for size in best:
            if waiting[size]:
                flush(size)
            for own, (scores, ids) in zip(best[size].query_ids.tolist(), best[size].found, strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best of all ``vectors`` but its own, of ``(vec_id, embedding)``."""
    spark = vectors.sparkSession
    ship(spark)
    pick = lambda df: df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    candidates = pick(vectors)
    packed = pick(queries).mapInArrow(_pack, "size long, vec_id long, vector binary").groupBy("vec_id").agg(F.min_by(F.struct("size", "vector"), F.struct("size", "vector")).alias("q"))
    packed = stored(packed.select("vec_id", "q.size", "q.vector"), "queries")
    n, longest = packed.agg(F.count("*"), F.max("size")).first()
    most = max(1, min(ROUND, ROUND_BYTES // (8 * (longest or 1))))
    schema, answers, after = "query_id long, vec_id long, score long", f"{fresh_path(spark, 'answers')}", None
    found = spark.createDataFrame([], schema)
    while n:
        own = packed if after is None else packed.where(F.col("vec_id") > after)
        rows = own.orderBy("vec_id").limit(most).collect()  # at most ROUND_BYTES
        if not rows:
            break
        by_size: dict[int, list] = {}
        for row in rows:
            by_size.setdefault(row["size"], []).append((row["vec_id"], np.frombuffer(bytes(row["vector"]), "<i8")))
        held = spark.sparkContext.broadcast({size: (np.array([i for i, _ in part]), np.stack([v for _, v in part])) for size, part in by_size.items()})
        found = candidates.mapInArrow(_search(held, k), schema)
        after = rows[-1]["vec_id"]
        if n <= most:
            break
        found.write.mode("append").parquet(answers)
        held.destroy()
        found = spark.read.schema(schema).parquet(answers)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS BIGINT[]) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""
