"""Joins beyond equality of keys: intervals, unique matches, rule cascades, ledgers, deltas, division."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written


def enclosing_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, order: list[str] | None = None, bin_width: int | None = None) -> DataFrame:
    """Each point with the innermost interval of its key around it; the shortest wins, then the latest start.

    ``points`` must have a unique ``point_id``. With ``bin_width`` places are a further key, as in
    ``overlapping``, so that keys with many intervals spread over tasks; no bin is narrower, and longer intervals have wider ones.
    """
    columns = points.columns
    if bin_width:
        place = _places([points.schema[at], intervals.schema[start], intervals.schema[end]])
        intervals, levels = _keyed_intervals(intervals.where(F.col(start) <= F.col(end)), place(start), place(end), bin_width)
        points, keys = _keyed_points(points, place(at), levels), [*keys, *_PLACE]
    if _is_time(intervals, start):
        span, latest = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)), -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(start))
    else:
        span, latest = F.col(end) - F.col(start), -F.col(start)
    picked = [c for c in intervals.columns if c not in keys]
    joined = points.join(intervals.hint("merge") if bin_width else intervals, keys).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = joined.groupBy("point_id").agg(F.min_by(F.struct(*picked), F.struct(span, latest, *[F.col(c) for c in order or []])).alias("__best"))
    every = points.where("__first").drop(*_PLACE, "__first") if bin_width else points
    return every.join(best, "point_id", "left").select(*columns, *[F.col(f"__best.{c}").alias(c) for c in picked])


def _is_time(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName().startswith("timestamp")


_PLACE = ["__level", "__bin"]


def _places(fields: list) -> Callable[[str], Column]:
    """A whole number for a value of a column, in the order of the values; all columns are brought to one kind."""
    kinds = {f.dataType.typeName() for f in fields}
    if "timestamp" in kinds:
        return lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    if "timestamp_ntz" in kinds:
        return lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    if kinds == {"date"}:
        return lambda c: F.unix_date(c).cast("long")
    return lambda c: F.floor(c).cast("long")


def _keyed_intervals(intervals: DataFrame, start: Column, end: Column, least: int = 1) -> tuple[DataFrame, list[int]]:
    """Intervals by level and bin, and the levels that occur, 64 at most.

    An interval's level is the first whose bins are wider than it and ``least`` wide or more, so it lies in one bin or two, however long it is.
    """
    placed = intervals.withColumns({"__start": start, "__end": end})
    width = F.col("__end") - F.col("__start")
    placed = placed.withColumn("__level", F.greatest(F.when(width == 0, 0).otherwise(F.length(F.bin(width))), F.lit((least - 1).bit_length())))
    levels = sorted(r[0] for r in placed.select("__level").distinct().collect())
    bins = F.array_distinct(F.array(F.expr("shiftright(__start, __level)"), F.expr("shiftright(__end, __level)")))
    return placed.withColumn("__bin", F.explode(bins)).drop("__start", "__end"), levels


def _keyed_points(points: DataFrame, at: Column, levels: list[int]) -> DataFrame:
    """Each point once for every level, with its bin there; ``__first`` marks one of these rows."""
    every = F.explode(F.array(*[F.lit(k) for k in levels or [0]]))
    placed = points.withColumn("__at", at).withColumn("__level", every)
    return placed.withColumn("__bin", F.expr("shiftright(__at, __level)")).withColumn("__first", F.col("__level") == (levels or [0])[0]).drop("__at")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bin_width: int = 1) -> DataFrame:
    """Pairs of one key whose closed intervals overlap; empty intervals (start after end) and null bounds take no part.

    Two intervals overlap where the right one starts in the left one, or else the left one in the right one after its
    start, so every pair is found once, as a start within an interval. Intervals are keyed by the bins of a level that
    suits their length and starts by their bins on all levels that occur: a key's rows spread over tasks, and no
    interval is cut into more than two. No bin is narrower than ``bin_width`` (microseconds, days or units): where a
    key has few intervals within that, fewer levels occur and a start has fewer rows. Rows by level are many more than
    the table's size tells, so neither side is broadcast. Columns beyond the keys have different names on both sides.
    """
    left, right = left.where(F.col(a[0]) <= F.col(a[1])), right.where(F.col(b[0]) <= F.col(b[1]))
    place = _places([left.schema[a[0]], left.schema[a[1]], right.schema[b[0]], right.schema[b[1]]])
    by = [*keys, *_PLACE]

    def pairs(l: DataFrame, r: DataFrame, test: Column) -> DataFrame:  # noqa: E741
        return l.join(r.hint("merge"), by).where(test).drop(*_PLACE, "__first")

    held, levels = _keyed_intervals(left, place(a[0]), place(a[1]), bin_width)
    first = pairs(held, _keyed_points(right, place(b[0]), levels), (F.col(a[0]) <= F.col(b[0])) & (F.col(b[0]) <= F.col(a[1])))
    held, levels = _keyed_intervals(right, place(b[0]), place(b[1]), bin_width)
    return first.unionAll(pairs(_keyed_points(left, place(a[0]), levels), held, (F.col(b[0]) < F.col(a[0])) & (F.col(a[0]) <= F.col(b[1]))))


def _nodes(low: str, high: str) -> Column:
    """The blocks ``(__level, __bin)`` of powers of two, two a level at most, that make up the whole numbers from ``low`` to below ``high``."""
    # on every level what is left begins at the next whole block and ends at the last one; an odd block at an end stands for itself
    first, last = f"shiftright({low} + shiftleft(1L, k) - 1, k)", f"shiftright({high}, k)"
    block = lambda odd, at: f"if({first} < {last} and ({odd} & 1) = 1, named_struct('__level', k, '__bin', {at}), null)"
    each = f"transform(sequence(0, length(bin({high} - {low}))), k -> array({block(first, first)}, {block(last, last + ' - 1')}))"
    return F.expr(f"filter(flatten({each}), x -> x is not null)")


def overlap_summary(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], value: str) -> DataFrame:
    """Rows of ``left`` with how many intervals of ``right`` overlap theirs, and the least and greatest ``value`` of these: ``(overlaps, least, most)``.

    As ``overlapping`` finds them, but without any pair: right starts are summed up in blocks of powers of two on all levels, and a left
    interval reads the blocks that make it up; right intervals, after their starts, are summed up in the blocks that make them up, and a
    left start reads the blocks around it. The work is rows times the logarithm of the longest interval, and equal intervals are one
    row until the end. Bounds must be whole numbers, dates or timestamps. Rows without an overlap are left out.
    """
    left, right = left.where(F.col(a[0]) <= F.col(a[1])), right.where(F.col(b[0]) <= F.col(b[1]))
    fields = [left.schema[a[0]], left.schema[a[1]], right.schema[b[0]], right.schema[b[1]]]
    if any(f.dataType.typeName() in ("float", "double", "decimal") for f in fields):
        raise ValueError("bounds must be whole numbers, dates or timestamps")
    place, by = _places(fields), [*keys, *_PLACE]
    sums = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")]
    wanted = written(left.select(*keys, place(a[0]).alias("__low"), place(a[1]).alias("__high")).distinct(), "intervals")
    held = right.select(*keys, place(b[0]).alias("__start"), place(b[1]).alias("__end"), F.col(value).alias("value"))
    held = written(held.groupBy(*keys, "__start", "__end").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")), "intervals")
    blocks = lambda df, low, high: df.withColumn("__x", F.explode(_nodes(low, high))).select("*", "__x.*").drop("__x")
    width = lambda df, low, high: range((df.agg(F.max(F.col(high) - F.col(low))).first()[0] or 0).bit_length() + 1)

    starts = _keyed_points(held, F.col("__start"), list(width(wanted, "__low", "__high"))).groupBy(*by).agg(*sums)
    inside = blocks(wanted.withColumn("__to", F.col("__high") + 1), "__low", "__to").join(starts.hint("merge"), by)
    around = blocks(held.withColumns({"__from": F.col("__start") + 1, "__to": F.col("__end") + 1}).where("__from < __to"), "__from", "__to").groupBy(*by).agg(*sums)
    before = _keyed_points(wanted, F.col("__low"), list(width(held, "__start", "__end"))).join(around.hint("merge"), by)
    own = [*keys, "__low", "__high"]
    total = inside.select(*own, "n", "least", "most").unionAll(before.select(*own, "n", "least", "most")).groupBy(*own).agg(*sums)
    placed = left.withColumns({"__low": place(a[0]), "__high": place(a[1])})
    return placed.join(total, own).select(*left.columns, F.col("n").alias("overlaps"), "least", "most")


def unique_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``status`` (resolved, missing, ambiguous), the number of candidates, and the value where there is exactly one."""
    found = right.groupBy(key).agg(F.count("*").alias("candidates"), F.min(value).alias("__one"))
    n = F.coalesce("candidates", F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous")
    return left.join(found, key, "left").select(*left.columns, status.alias("status"), n.alias("candidates"), F.when(n == 1, F.col("__one")).alias("resolved"))


def cascade(base: DataFrame, key: str, rules: list[DataFrame]) -> DataFrame:
    """``base`` with the target of the first rule that has one; each rule is ``(key, target)`` and may name several, of which the least counts."""
    hits = reduce(DataFrame.unionByName, [r.select(key, "target", F.lit(n).alias("rule_no")) for n, r in enumerate(rules, 1)])
    best = hits.where("target is not null").groupBy(key).agg(F.min(F.struct("rule_no", "target")).alias("__hit"))
    return base.join(best, key, "left").select(*base.columns, F.col("__hit.rule_no").alias("rule_no"), F.col("__hit.target").alias("target"))


def not_reciprocal(edges: DataFrame, a: str, b: str, same: list[str] = ()) -> DataFrame:
    """Edges whose reverse is missing or differs in the attributes ``same``."""
    back = edges.select(F.col(a).alias("__b"), F.col(b).alias("__a"), *[F.col(c).alias(f"__{c}") for c in same])
    agree = reduce(lambda x, y: x & y, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in same], F.lit(True))
    return edges.join(back, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")) & agree, "left_anti")


def ledger(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every key with its status: matched, missing, unknown or duplicate."""
    e = expected.groupBy(key).agg(F.count("*").alias("n_expected"))
    f = found.groupBy(key).agg(F.count("*").alias("n_found"))
    n_e, n_f = F.coalesce("n_expected", F.lit(0)), F.coalesce("n_found", F.lit(0))
    status = F.when(n_e == 0, "unknown").when(n_f == 0, "missing").when((n_e > 1) | (n_f > 1), "duplicate").otherwise("matched")
    return e.join(f, key, "full_outer").select(key, n_e.alias("n_expected"), n_f.alias("n_found"), status.alias("status"))


def require_complete(status: DataFrame, key: str, most: int = 8) -> None:
    """Raises with the first failures if the ledger is not one to one."""
    bad = status.where("status <> 'matched'").orderBy(key).limit(most).collect()
    if bad:
        raise ValueError("; ".join(f"{r[key]}: {r['status']}" for r in bad))


def delta(before: DataFrame, after: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Keys that were removed, added or changed between two snapshots."""
    b = before.select(key, F.col(fingerprint).alias("before"))
    a = after.select(key, F.col(fingerprint).alias("after"))
    change = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "changed")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change is not null")


def covers_all(pairs: DataFrame, owner: str, item: str, items: DataFrame) -> DataFrame:
    """Owners that have every item (relational division)."""
    n = items.select(item).distinct().count()
    return pairs.select(owner, item).distinct().join(items.select(item).distinct(), item, "left_semi").groupBy(owner).agg(F.count("*").alias("n_items")).where(F.col("n_items") == n)


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def union_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All of ``left``, and of ``right`` the keys that it lacks."""
    return left.unionByName(right.join(left.select(key), key, "left_anti").select(*left.columns))
