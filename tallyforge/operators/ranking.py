"""Seeded ranking, prefixes, quotas, slots and greedy selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.hashing import rank_digest
from ..shipping import ship
from ..storage import fresh_path, removed, written, written_at
from .scans import free_names, running


def with_rank(df: DataFrame, digest: Column, *ties: str) -> DataFrame:
    """Adds ``digest`` and the 1-based ``rank`` in its order, over all rows, without a single-task window.

    Rows are range-partitioned, sorted and written once with their partition and their place in it, as a second evaluation
    could cut the ranges elsewhere; each partition's numbers start after the sizes of those before it.
    """
    digested = df.withColumn("digest", digest)
    part, at, before = (_free(digested, x) for x in ("part", "at", "before"))
    ordered = digested.repartitionByRange("digest", *ties).sortWithinPartitions("digest", *ties)
    # the partition's number stands in the upper bits of the increasing id, the place in it in the lower 33
    numbered = written(ordered.withColumn(at, F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn(part, F.shiftright(at, 33))
    sizes = numbered.groupBy(part).agg(F.count("*").alias("n"))  # one row a partition
    starts = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(starts), part).select(*df.columns, "digest", (F.col(before) + place + 1).alias("rank"))


def _free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem = "_" + stem
    return stem


def hash_rank(df: DataFrame, contract: str, seed: str, keys: list[str], k: int | None = None, separator: str = "\0") -> DataFrame:
    """Ranks rows by a seeded digest of their keys; with k only the best k, with an error if there are fewer."""
    digest = rank_digest(contract, seed, *[F.col(c) for c in keys], separator=separator)
    if k is None:
        return with_rank(df, digest, *keys)
    best = written(df.withColumn("digest", digest).orderBy("digest", *keys).limit(k), "best")
    if (n := best.count()) < k:
        raise ValueError(f"{k} rows are wanted and the population has {n}")
    return best.withColumn("rank", F.row_number().over(Window.orderBy("digest", *keys)).cast("long"))


def quota_fill(ranked: DataFrame, by: str, rank: str, quota: int, eligible: Column | None = None) -> DataFrame:
    """Takes each group's first rows in rank order up to the quota; stateless exclusions come before it.

    Each group's last rank within the quota is found by a bounded top-k, which tasks cut down before they
    shuffle; the rows themselves are only compared with it. Ranks have to be unique.
    """
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    first = F.row_number().over(Window.partitionBy(by).orderBy(rank))
    last = ranked.where(ok).select(by, rank).withColumn("k", first).where(F.col("k") <= quota).groupBy(by).agg(F.max(rank).alias("__last"))
    outcome = F.when(~ok, "excluded").when(F.col(rank) <= F.col("__last"), "selected").otherwise("quota_filled")
    back = last.withColumnRenamed(by, "__by")
    return ranked.join(back, F.col(by).eqNullSafe(F.col("__by")), "left").withColumn("outcome", outcome).select(*ranked.columns, "outcome")


def category_slots(df: DataFrame, by: str, digest: str, categories: list, k: int) -> DataFrame:
    """k slots for every category, with the rows of least digest; slots without a row stay unfilled."""
    spark = df.sparkSession
    kind = df.schema[by].dataType.simpleString()
    slots = spark.createDataFrame([(c,) for c in categories], f"{by} {kind}").select(by, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    placed = df.withColumn("slot", F.row_number().over(Window.partitionBy(by).orderBy(digest))).where(F.col("slot") <= k)
    return slots.join(placed, [by, "slot"], "left").withColumn("filled", F.col(digest).isNotNull())


def greedy_slots_single(ranked: DataFrame, repository: str, language: str, rank: str, slots: int) -> DataFrame:
    """Greedy selection where each repository has one language: its best row, then each language's first ``slots``."""
    best = ranked.withColumn("__own", F.row_number().over(Window.partitionBy(repository).orderBy(rank))).where("__own = 1").drop("__own")
    return best.withColumn("slot", F.row_number().over(Window.partitionBy(language).orderBy(rank))).where(F.col("slot") <= slots)


def greedy_slots(ranked: DataFrame, repository: str, language: str, rank: str, slots: int) -> DataFrame:
    """Greedy selection in rank order, with ``slot``: one row a repository, at most ``slots`` a language. Ranks are unique; nulls are one repository or one language."""
    return greedy_slot_rounds(ranked, repository, language, rank, slots)[0]


def greedy_slot_rounds(ranked: DataFrame, repository: str, language: str, rank: str, slots: int) -> tuple[DataFrame, int]:
    """``greedy_slots`` and the number of rounds that it took.

    A row can be taken only if it is its repository's best row in its language, so each pair of repository and
    language keeps one; as every row taken uses up one repository, only the first ``slots x languages`` rows of a
    language can matter. A round takes every open row that nothing before it can keep out: the first of its
    repository that is left, with fewer rows than ``slots`` left before it in its language. Rows of repositories
    that are taken, and open rows behind ``slots`` taken ones, go. The best open row is always settled, so rounds end.
    """
    spark = ranked.sparkSession
    place, taken, full = free_names(ranked.columns, "place", "taken", "full")
    own = ranked.withColumn(place, F.row_number().over(Window.partitionBy(repository, language).orderBy(rank))).where(F.col(place) == 1)
    n = ranked.select(language).distinct().count()
    near = own.withColumn(place, F.row_number().over(Window.partitionBy(language).orderBy(rank))).where(F.col(place) <= slots * max(n, 1))
    at = fresh_path(spark, "slots")
    state, rounds = written_at(near.drop(place).withColumn(taken, F.lit(False)), at), 0
    in_repository, in_language = Window.partitionBy(repository).orderBy(rank), Window.partitionBy(language).orderBy(rank)
    before = in_language.rowsBetween(Window.unboundedPreceding, -1)
    while state.where(~F.col(taken)).take(1):
        # a repository's taken row is its first one left, as the rows before it went when it was taken
        first = state.withColumn(place, F.row_number().over(in_repository)).withColumn(full, F.first(taken).over(in_repository))
        sure = F.col(taken) | ((F.col(place) == 1) & (F.row_number().over(in_language) <= slots))
        settled = first.where(F.col(taken) | ~F.col(full)).withColumn(taken, sure)
        settled = settled.withColumn(full, F.coalesce(F.count_if(F.col(taken)).over(before), F.lit(0)) >= slots).where(F.col(taken) | ~F.col(full))
        new_at = fresh_path(spark, "slots")
        state = written_at(settled.drop(place, full), new_at)
        removed(spark, at)
        at, rounds = new_at, rounds + 1
    return state.drop(taken).withColumn("slot", F.row_number().over(in_language)), rounds


def slot_table(selected: DataFrame, language: str, languages: list[str], n: int) -> DataFrame:
    """All slots of all languages, with what was selected."""
    spark = selected.sparkSession
    all_slots = spark.createDataFrame([(x,) for x in languages], f"{language} string").select(language, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot"))
    return all_slots.join(selected, [language, "slot"], "left")


def seed_date(seed: str, start: str, days: int) -> Column:
    """A date that follows from a hexadecimal seed."""
    return F.date_add(F.lit(start).cast("date"), F.lit(int(seed[:8], 16) % days))


def spread_sample(df: DataFrame, by: str, order: list[str], most: int, k: int) -> DataFrame:
    """Groups of up to ``most`` rows whole; of larger ones k rows, evenly spaced from the first to the last."""
    w = Window.partitionBy(by)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    numbered = df.withColumn("__n", n).withColumn("__at", at)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (k - 1)))
    return numbered.where((F.col("__n") <= most) | F.array_contains(places, F.col("__at").cast("long"))).drop("__n", "__at")


def greedy_batches(df: DataFrame, by: str, order: list[str], size: str, most: int, budget: int, part_rows: int = 4096) -> DataFrame:
    """Adds ``batch`` from 1: each group's rows in order, cut where a batch would exceed ``most`` rows or ``budget`` of the size column.

    Sizes are whole numbers from 0, null is 0; a row larger than the budget is a batch of its own. ``order`` tells a
    group's rows apart; null groups are one group. A group is cut into parts of ``part_rows`` rows, so that it may
    hold any share of the table. Where a batch starts in a part depends on the one before alone, and only on which
    of its first ``most`` rows starts one; so each part is read once for every such entry, and the entries that
    are real are found from the first part on by pointer doubling. Groups of one part need none of that.
    """
    ship(df.sparkSession)
    spread = max(part_rows, most)
    df = df.drop("batch")
    one, at, part, entry, done = free_names([*df.columns, "batch"], "one", "at", "part", "entry", "done")
    numbered = running(df.withColumn(one, F.lit(1).cast("long")), [by], [F.col(c) for c in order], {at: one}, name="numbered").drop(one)
    parted = numbered.withColumn(part, F.floor((F.col(at) - 1) / spread)).withColumn(at, F.pmod(F.col(at) - 1, F.lit(spread)))
    if numbered.where(F.col(at) > spread).take(1):
        parts = _real_entries(parted, by, size, most, budget, spread, at, part).select(F.col("by").alias("__by"), F.col("part").alias("__part"), F.col("entry").alias(entry), F.col("done").alias(done))
        parted = parted.join(parts, F.col(by).eqNullSafe(F.col("__by")) & (F.col(part) == F.col("__part")), "left").drop("__by", "__part")
        parted = parted.withColumn(entry, F.coalesce(entry, F.lit(0).cast("long"))).withColumn(done, F.coalesce(done, F.lit(0).cast("long")))
    else:
        parted = parted.withColumn(entry, F.lit(0).cast("long")).withColumn(done, F.lit(0).cast("long"))
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    ordered = parted.repartition(by, part).sortWithinPartitions(by, part, at)
    return ordered.mapInArrow(_walked(by, size, most, budget, at, part, entry, done, len(df.columns), schema.names), schema)


def _walked(by: str, size: str, most: int, budget: int, at: str, part: str, entry: str, done: str, n_out: int, names: list[str]):
    """Numbers the batches of parts that stand in order, from each part's first batch start on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = rows = used = 0
        for table in batches:
            of = lambda c: table.column(table.schema.get_field_index(c))  # noqa: B023, E731
            sizes = pc.fill_null(of(size), 0).to_pylist()
            out = []
            for place, start, before, own in zip(of(at).to_pylist(), of(entry).to_pylist(), of(done).to_pylist(), sizes, strict=True):
                if place == 0:
                    batch, rows, used = before, 0, 0
                if place == start or (place > start and (rows == most or used + own > budget)):
                    batch, rows, used = batch + 1, 0, 0
                rows, used = rows + 1, used + own
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*table.columns[:n_out], pa.array(out, pa.int32())], names=names)

    return run


def _real_entries(parted: DataFrame, by: str, size: str, most: int, budget: int, spread: int, at: str, part: str) -> DataFrame:
    """For each part of groups of several parts the place of its first batch start and the number of batches before: (by, part, entry, done)."""
    rows = parted.select(F.col(by).alias("by"), F.col(part).alias("part"), F.col(at).alias("at"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    large = rows.where("part = 1 and at = 0").select(F.col("by").alias("__by"))
    # a group's first part is at most one part's rows, so the join has no hot key
    first = rows.where("part = 0").join(large, F.col("by").eqNullSafe(F.col("__by")), "left_semi")
    several = first.unionByName(rows.where("part > 0"))
    ahead = several.where((F.col("part") > 0) & (F.col("at") < most)).withColumns({"part": F.col("part") - 1, "at": F.col("at") + spread})
    kind = parted.schema[by].dataType.simpleString()

    def jumps(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        total = np.r_[0, np.cumsum(frame["size"].to_numpy())]
        n, own = len(frame), min(spread, len(frame))
        start = np.arange(own)
        fits = np.searchsorted(total, total[:own] + budget, "right") - 1  # rows before the first one too many
        after = np.maximum(start + 1, np.minimum(np.minimum(start + most, fits), n))
        leave, count = np.zeros(own, "i8"), np.ones(own, "i8")
        for k in range(own - 1, -1, -1):
            if after[k] < own:
                leave[k], count[k] = leave[after[k]], count[after[k]] + 1
            else:
                leave[k] = after[k]
        n_entries = min(most, own)
        return pd.DataFrame({"by": [key[0]] * n_entries, "part": key[1], "entry": start[:n_entries], "to_part": key[1] + 1, "to_entry": leave[:n_entries] - spread, "n": count[:n_entries]})

    step = several.unionByName(ahead).groupBy("by", "part").applyInPandas(jumps, f"by {kind}, part long, entry long, to_part long, to_entry long, n long")
    step = written(step.where("to_entry >= 0"), "jumps")
    found = written(large.select(F.col("__by").alias("by"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("done")), "entries")
    while True:
        # what is found covers the first 2**k parts, and a step leads 2**k parts on
        there = step.alias("s").join(found.alias("f"), F.expr("s.by <=> f.by and s.part = f.part and s.entry = f.entry"))
        more = written(there.selectExpr("s.by", "s.to_part as part", "s.to_entry as entry", "f.done + s.n as done"), "entries")
        if not more.take(1):
            return found
        found = written(found.unionByName(more), "entries")
        twice = step.alias("a").join(step.alias("b"), F.expr("a.by <=> b.by and a.to_part = b.part and a.to_entry = b.entry"))
        step = written(twice.selectExpr("a.by", "a.part", "a.entry", "b.to_part", "b.to_entry", "a.n + b.n as n"), "jumps")
