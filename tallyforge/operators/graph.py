"""Graphs: components, chains, reach and paths, as loops over joins whose steps are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import fresh_path, removed, written, written_at


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


#: Rows of a task where tables are dealt by key. Narrow rows shrink so much when they are shuffled that parts joined by their bytes would hold many more.
ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has so many rows, by ``keys`` in as many parts as they need; a small table stays as it is."""
    return df.repartition(-(-rows // ROWS), *keys) if rows > ROWS else df


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of an undirected graph, named by its least node; null ends take no part.

    Alternating star contraction: a round points every node's larger neighbours, then its smaller
    ones, at the least node around it; stars are left when a round changes nothing, after a number
    of rounds that grows with the logarithm of the longest path. A round's table replaces the one before.
    """
    spark = edges.sparkSession
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    at = fresh_path(spark, "edges")
    every = written(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "all-edges")
    pairs = written_at(dealt(every, every.count(), "u", "v").distinct(), at)
    alone = pairs.where("u = v").select("u")  # a loop names its node
    stars_at, stars = at, pairs.where("u <> v")
    before = _state(stars)
    while before[0]:
        ways = dealt(_both_ways(stars), 2 * before[0], "u")
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large_at, small_at = fresh_path(spark, "large-star"), fresh_path(spark, "small-star")
        large = written_at(dealt(ways.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), before[0], "u").distinct(), large_at)
        large = dealt(large, before[0], "u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = written_at(dealt(small.select("e.u", "e.v").where("u <> v"), 2 * before[0], "u").distinct(), small_at)
        removed(spark, large_at)
        if stars_at != at:
            removed(spark, stars_at)
        stars_at, after = small_at, _state(stars)
        if after == before:
            break
        before = after
    roots = stars.select("v").distinct()
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
    lone = alone.withColumnRenamed("u", "node").join(out.hint("merge"), "node", "left_anti")
    return out.unionByName(lone.select("node", F.col("node").alias("component")))


def _doubled(links: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """Ends of chains of ``(n, t)``, one link a node: ``(n, t, d)``, d links on, of nodes whose chain ends, and of those left after ``most_rounds`` (or None).

    Each round joins what has not ended with all pointers, so that a pointer leads twice as far as before. Ended rows
    are written once and not read by later joins' left side. Names shrink so much in files that a table's size says little, so none is broadcast.
    """
    spark = links.sparkSession
    pointers = written(links.select("n", "t", F.lit(1).cast("long").alias("d")), "chain")
    going, ended = pointers, None
    for k in range(most_rounds):
        ahead = pointers.select(F.col("n").alias("t"), F.col("t").alias("t2"), F.col("d").alias("d2"))
        step = written(going.join(ahead.hint("merge"), "t", "left"), "chain")
        over = step.where("t2 is null").select("n", "t", "d")
        ended = over if ended is None else ended.unionByName(over)
        going = step.where("t2 is not null").select("n", F.col("t2").alias("t"), (F.col("d") + F.col("d2")).alias("d"))
        if not going.take(1):
            return ended, None
        if k % 8 == 7:
            ended = written(ended, "chain")  # keeps the plan short
        pointers = ended.unionByName(going)
    return spark.createDataFrame([], pointers.schema) if ended is None else ended, going


def chain_ends(links: DataFrame, node: str, target: str) -> DataFrame:
    """End of every node's chain of targets, by pointer doubling: ``(node, end, hops, status)``.

    Of several links of one node the one with the least target counts; links with a null end take no part. Status
    is ``resolved``, or ``cycle`` where the chain runs into a cycle: its end is then the last node before one comes again.
    A chain of n links takes about log2(n) rounds. Nodes that still go on after as many links as there are lead into a cycle, and
    what they point at then are exactly the nodes of the cycles; the ways into these are chains of their own.
    """
    one = written(links.select(F.col(node).alias("n"), F.col(target).alias("t")).where("n is not null and t is not null").groupBy("n").agg(F.min("t").alias("t")), "links")
    total = one.count()
    ended, going = _doubled(one, max(total, 1).bit_length() + 1)
    found = ended.select("n", F.col("t").alias("end"), F.col("d").alias("hops"), F.lit("resolved").alias("status"))
    if going is not None:
        on = written(going.select(F.col("t").alias("c")).distinct(), "cycle")
        ring = written(one.join(on.hint("merge"), one["n"] == on["c"]).select("n", "t"), "ring")  # one link a node of a cycle
        named = written(components(ring, "n", "t"), "rings")
        sizes = named.groupBy("component").agg(F.count("*").alias("size"))
        last = ring.select(F.col("t").alias("c"), F.col("n").alias("end")).join(named.hint("merge"), F.col("c") == F.col("node")).join(sizes.hint("merge"), "component").select("c", "end", (F.col("size") - 1).alias("around"))
        into = one.join(going.select("n").hint("merge"), "n", "left_semi").join(on.hint("merge"), F.col("n") == F.col("c"), "left_anti")
        ways = _doubled(into, max(total, 1).bit_length() + 1)[0]
        enter = ways.select("n", F.col("t").alias("c"), "d").unionByName(on.select(F.col("c").alias("n"), "c", F.lit(0).cast("long").alias("d")))
        found = found.unionByName(enter.join(last.hint("merge"), "c").select("n", "end", (F.col("d") + F.col("around")).alias("hops"), F.lit("cycle").alias("status")))
    return found.select(F.col("n").alias(node), "end", "hops", "status")


def resolve_chain(links: DataFrame, node: str, target: str) -> DataFrame:
    """End of each node's chain of targets: (node, end, status), status resolved or cycle; a chain into a cycle has no end."""
    return chain_ends(links, node, target).select(node, F.when(F.col("status") == "resolved", F.col("end")).alias("end"), "status")


def merge_targets(decisions: DataFrame) -> DataFrame:
    """Where each merged case of ``(case_id, decision, merge_into)`` ends: (case_id, end, status).

    Status is resolved where the chain's end is kept, cycle where it has none, and otherwise says how the end was decided.
    """
    ends = resolve_chain(decisions.where("decision = 'merge'").select("case_id", "merge_into"), "case_id", "merge_into")
    said = decisions.select(F.col("case_id").alias("end"), F.col("decision").alias("__end"))
    bad = F.concat(F.lit("ends in a case that is "), F.coalesce("__end", F.lit("unknown")))
    return ends.join(said, "end", "left").select("case_id", "end", F.when(F.col("status") == "cycle", "cycle").when(F.col("__end") == "keep", "resolved").otherwise(bad).alias("status"))


def reachable(edges: DataFrame, a: str, b: str, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Nodes that the roots reach with the least number of steps; all of them, or those within ``most_depth`` steps."""
    root = roots.columns[0]
    seen = written(roots.select(F.col(root).alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    front, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = edges.join(front.select(F.col("node").alias(a)), a).select(F.col(b).alias("node")).where("node is not null").distinct().join(seen.select("node"), "node", "left_anti")
        front = written(step.select("node", F.lit(depth).alias("depth")), "front")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if depth % 32 == 0:
            seen = written(seen, "reach")  # keeps the plan short
    return seen


def agreed_reach(agreed: DataFrame, disputed: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that the roots reach over agreed relationships ``(a, b)`` in both directions; an error if one of them is ``disputed``."""
    ways = agreed.select("a", "b").unionByName(agreed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = reachable(ways, "a", "b", roots)
    touched = found.join(disputed.select(F.col(disputed.columns[0]).alias("node")), "node", "left_semi").orderBy("node").limit(1).collect()
    if touched:
        raise ValueError(f"related to a disputed method: {touched[0]['node']}")
    return found


def follow_exports(exports: DataFrame, start: DataFrame) -> DataFrame:
    """Follows re-exports ``(file, name) -> (to_file, to_name)`` to their end: (file, name, end_file, end_name, hops, status).

    A pair that is not exported on is its own end. Status is ``cycle`` where pairs come again; the end is then the
    last one before that. Of several exports of a pair the least target counts; pairs with a null part take no part.
    """
    pair = lambda f, n: F.when(F.col(f).isNotNull() & F.col(n).isNotNull(), F.struct(F.col(f).alias("file"), F.col(n).alias("name")))
    ends = chain_ends(exports.select(pair("file", "name").alias("pair"), pair("to_file", "to_name").alias("to")), "pair", "to")
    wanted = start.select("file", "name").where("file is not null and name is not null").withColumn("pair", pair("file", "name"))
    found = wanted.join(ends.hint("merge"), "pair", "left")
    return found.select("file", "name", F.coalesce("end.file", "file").alias("end_file"), F.coalesce("end.name", "name").alias("end_name"), F.coalesce("hops", F.lit(0)).cast("int").alias("hops"), F.coalesce("status", F.lit("resolved")).alias("status"))


def call_edges(references: DataFrame, definitions: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(caller, callee)`` from references ``(file_path, line, name)`` whose name has exactly one definition ``(name, unit_id)``, and counts.

    The caller is the shortest method ``(unit_id, file_path, start_line, end_line)`` around the line, the first
    of equal ones; counts say how many references had no or several definitions and how many lie in no method.
    """
    from .joins import enclosing_interval

    one = definitions.groupBy("name").agg(F.count("*").alias("n"), F.min("unit_id").alias("callee"))
    refs = references.withColumn("point_id", F.xxhash64("file_path", "line", "name")).dropDuplicates(["file_path", "line", "name"])
    spans = methods.select("file_path", F.col("unit_id").alias("caller"), "start_line", "end_line")
    placed = enclosing_interval(refs, spans, ["file_path"], "line", "start_line", "end_line", ["caller"]).join(one, "name", "left")
    placed = written(placed.select("caller", F.when(F.col("n") == 1, F.col("callee")).alias("callee"), F.coalesce("n", F.lit(0)).alias("n")), "placed")
    counts = placed.agg(F.count_if(F.col("n") != 1).alias("unresolved"), F.count_if((F.col("n") == 1) & F.col("caller").isNull()).alias("external"))
    return placed.where("caller is not null and callee is not null").select("caller", "callee").distinct(), counts


def case_components(cases: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """Cases that belong together: ``(case_id, component)``.

    ``cases`` is (case_id, semantics), ``units`` is (case_id, unit_id), ``edges`` is (caller, callee). Cases are linked
    by a shared unit, by equal semantics, or by an edge between their units; the cases of one unit, meaning
    or edge form a star around the least of them, so no rule gives all pairs.
    """
    cases, units = written(cases, "cases"), written(units, "units")
    n_cases, n_units = cases.count(), units.count()

    def star(df: DataFrame, rows: int, key: str) -> DataFrame:
        by_key = dealt(df, rows, key)
        return by_key.join(by_key.groupBy(key).agg(F.min("case_id").alias("hub")).hint("merge"), key).select(F.col("case_id").alias("u"), F.col("hub").alias("v"))

    least = dealt(units, n_units, "unit_id").groupBy("unit_id").agg(F.min("case_id").alias("case_id"))
    of = lambda c, name: least.select(F.col("unit_id").alias(c), F.col("case_id").alias(name))
    across = edges.join(of("caller", "u"), "caller").join(of("callee", "v"), "callee").select("u", "v")
    links = cases.select(F.col("case_id").alias("u"), F.col("case_id").alias("v")).unionByName(star(units, n_units, "unit_id")).unionByName(star(cases, n_cases, "semantics")).unionByName(across)
    return components(links, "u", "v").withColumnRenamed("node", "case_id")


def crossing_pairs(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Unordered pairs of units ``(a, b)``, each once, that an edge joins across chunks of ``membership`` (unit_id, chunk)."""
    of = lambda c, name: membership.select(F.col("unit_id").alias(c), F.col("chunk").alias(name))
    both = edges.join(of("caller", "c1"), "caller").join(of("callee", "c2"), "callee").where("c1 <> c2")
    return both.select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).distinct()


def upstream_callers(edges: DataFrame, roots: DataFrame, depth: int = 2, most: int = 16, most_roots: int = 8) -> DataFrame:
    """Callers above each root ``unit_id`` in the order of a depth-first walk: (root, place, unit_id, depth).

    ``most_roots`` roots, the least ones, have ``most`` callers listed at most; a caller is listed once, where the walk meets it first.
    """
    start = roots.select(F.col(roots.columns[0]).alias("root")).distinct().orderBy("root").limit(most_roots)
    up = edges.select(F.col("callee").alias("unit_id"), F.col("caller").alias("next")).distinct()
    level = start.select("root", F.col("root").alias("unit_id"), F.array(F.col("root")).alias("path"))
    levels = []
    for _ in range(depth):
        level = level.join(up, "unit_id").where(~F.array_contains("path", F.col("next"))).select("root", F.col("next").alias("unit_id"), F.array_append("path", F.col("next")).alias("path"))
        levels.append(level)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    # in the order of their paths, a caller stands before what lies above it
    first = found.groupBy("root", "unit_id").agg(F.min("path").alias("path"))
    order = Window.partitionBy("root").orderBy("path")
    return first.select("root", F.row_number().over(order).alias("place"), "unit_id", (F.size("path") - 1).alias("depth")).where(F.col("place") <= most)


def neighbours(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Every method's callers and callees, each a sorted array: (unit_id, callers, callees)."""
    into = edges.groupBy(F.col("callee").alias("unit_id")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    out = edges.groupBy(F.col("caller").alias("unit_id")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    none = F.array().cast("array<string>")
    return methods.select("unit_id").join(into, "unit_id", "left").join(out, "unit_id", "left").select("unit_id", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))
