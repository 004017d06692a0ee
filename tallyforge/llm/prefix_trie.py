"""Trie of the prefixes that conversations share, with sums over subtrees by heavy paths.

A node is a distinct sequence of first turns. It is told by its depth and by the sums, over its turns, of two
64-bit hashes of each turn's place and 128-bit print (running sums over sorted rows, see ``operators.scans``),
so a conversation may have any number of turns. Every node's largest child, the one with most members, continues
its heavy path; all others start paths of their own. A light child has half of its parent's members at most, so
above any node there are no more paths than the logarithm of the number of conversations. Nodes find the tops of
their paths by pointer doubling. Then what whole paths hold is passed up from path to path, one round for each
path above, summed for each parent before it moves on. At last one suffix sum along all paths, each sorted from its
end, gives every node what lies below it.

Defined cases: rows without ``conv_id`` take no part; rows of one conversation that are alike in ``turn`` stand in the
order of a hash of role and text; null role or text is empty; conversations without turns are members of the root
alone; no conversations, no nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scans import running, wrapped_less
from ..shipping import ship
from .common import stored, table

#: Turns at the head of a conversation that another one may lend, and how often such conversations stand.
HEADS = 4
EVERY = 20
#: Ids of one string lie between two multiples of this.
IDS = 4096
NODE = ["depth", "ka", "kb"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, print, words)``: each conversation's turns numbered from 1, with a print of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.expr(r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')").cast("long")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", said.alias("print"), words.alias("words"), F.lit(1).cast("long").alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("print"), F.monotonically_increasing_id()]
    return running(rows, ["conv_id"], order, {"at": "one"}, name="turns").select("conv_id", "at", "print", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: their turns ``(conv_id, at, print, words, last)``, and ``(conv_id, length)``.

    Conversation ``c`` takes ``h`` = crc32(c) modulo 4 turns of conversation ``c - c % 20``, then its own after the first ``h``.
    """
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    first = F.when((F.col("conv_id") == base) & (F.col("at") < HEADS), F.struct("at", "print", "words"))  # collect_list leaves nulls out
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("n"), F.array_sort(F.collect_list(first)).alias("heads"))
    lent = sizes.where(F.col("conv_id") == base).select("conv_id", "heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    every = sizes.select("conv_id", base.alias("base"), h.cast("int").alias("h"), "n").join(lent.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.when(F.col("heads").isNull(), F.array().cast(lent.schema["heads"].dataType)).otherwise(F.slice("heads", F.lit(1), F.col("h")))
    every = every.select("conv_id", "h", taken.alias("heads"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    every = stored(every.select("conv_id", "h", "heads", (F.size("heads") + F.col("own")).alias("length")), "conversations")
    head = every.select("conv_id", "length", F.explode("heads").alias("x")).select("conv_id", F.col("x.at").alias("at"), "x.print", "x.words", "length")
    moved = (F.col("at") - F.col("h") + F.size("heads")).alias("at")
    tail = turns.join(every, "conv_id").where("at > h").select("conv_id", moved, "print", "words", "length")
    rows = head.unionByName(tail).select("conv_id", "at", "print", "words", (F.col("at") == F.col("length")).alias("last"))
    return rows, every.select("conv_id", "length")


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, which come in order; no more than one batch is held."""
    node, so_far = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != node:
                if node:
                    out.append((*node, so_far.hexdigest()))
                node, so_far = key, hashlib.sha256(ids.encode())
            else:
                so_far.update(b"," + ids.encode())
        yield _hashes(out)
    if node:
        yield _hashes([(*node, so_far.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ascending ids, joined by commas: ``(depth, ka, kb, ends_sha256)``.

    SHA-256 reads in order, so one node's ids go through one task, but as strings of ``IDS`` ids at most that are never held together.
    """
    ship(ends.sparkSession)
    ids = F.array_join(F.array_sort(F.collect_list(F.col("conv_id").cast("long"))).cast("array<string>"), ",")
    runs = ends.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("run")).agg(ids.alias("ids")).select(*NODE, "ids", "run")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "run").mapInArrow(_hashed_ids, "depth long, ka long, kb long, ends_sha256 string")


def nodes_of(rows: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes with their least member, number of members and parent's key; and the nodes at which conversations end."""
    a, b = F.xxhash64("print", "at"), F.xxhash64("at", "print", F.lit("b"))
    keyed = running(rows.withColumn("a", a).withColumn("b", b), ["conv_id"], ["at"], {"ka": "a", "kb": "b"}, wraps=True, name="prefixes")
    keyed = keyed.select("conv_id", F.col("at").alias("depth"), "ka", "kb", wrapped_less(F.col("ka"), F.col("a")).alias("pa"), wrapped_less(F.col("kb"), F.col("b")).alias("pb"), "words", "last")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = every.select("conv_id", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), zero.alias("words"), (F.col("length") == 0).alias("last"))
    members = keyed.unionByName(roots)
    nodes = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("pa", "pb", "words")])
    return stored(nodes, "nodes"), members.where("last").select(*NODE, "conv_id")


def with_heavy_children(nodes: DataFrame) -> DataFrame:
    """Nodes with their number of children, their parent, and whether they are light; a node is its parent's heavy child if none has more members, or as many and a smaller id."""
    largest = F.max(F.struct("n_convs", F.bitwise_not(F.col("conv_id")).alias("negated"))).alias("largest")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"), largest)
    own = nodes.join(kids, NODE, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.bitwise_not(F.col("largest.negated")).alias("heavy"))
    own = stored(own, "nodes-with-children")
    above = own.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("next"))
    light = F.coalesce(F.col("conv_id") != F.col("next"), F.lit(True))
    return stored(own.join(above, ["depth", "pa", "pb"], "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "words", light.alias("light")), "trie")


def path_tops(trie: DataFrame) -> DataFrame:
    """``trie`` with the top of every node's heavy path, ``top_id`` and ``top_depth``, by pointer doubling; a node's least member and depth name it."""
    own = [c for c in trie.columns if c != "light"]
    done = stored(trie.where("light").select(*own, F.col("conv_id").alias("top_id"), F.col("depth").alias("top_depth")), "tops")
    going = trie.where("not light").select(*own, F.col("parent_conv_id").alias("top_id"), (F.col("depth") - 1).alias("top_depth"))
    while not going.isEmpty():
        ahead = done.withColumn("ended", F.lit(True)).unionByName(going.withColumn("ended", F.lit(False)))
        ahead = ahead.select(F.col("conv_id").alias("top_id"), F.col("depth").alias("top_depth"), F.col("top_id").alias("next_id"), F.col("top_depth").alias("next_depth"), "ended")
        step = going.join(ahead, ["top_id", "top_depth"]).select(*own, F.col("next_id").alias("top_id"), F.col("next_depth").alias("top_depth"), "ended")
        step = stored(step, "tops")
        done, going = done.unionByName(step.where("ended").drop("ended")), step.where("not ended").drop("ended")
    return done


def with_subtree_sums(trie: DataFrame, sums: list[str]) -> DataFrame:
    """``trie`` with each of its long columns ``sums`` summed over every node's subtree, the node included."""
    kept = [c for c in trie.columns if c not in (*sums, "light")]
    own = path_tops(trie)
    total, top = [F.sum(c).alias(c) for c in sums], ["top_id", "top_depth"]
    hung = own.where("conv_id = top_id and depth = top_depth and depth > 0").select(*top, "parent_conv_id", (F.col("depth") - 1).alias("parent_depth"))
    of_parent = own.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth"), F.col("top_id").alias("above_id"), F.col("top_depth").alias("above_depth"))
    paths = stored(hung.join(of_parent, ["parent_conv_id", "parent_depth"]), "paths")
    moving = stored(own.groupBy(*top).agg(*total), "path-sums")
    passed = moving
    while True:  # a round for each path that lies above another
        moving = moving.join(paths, top).groupBy(F.col("above_id").alias("top_id"), F.col("above_depth").alias("top_depth")).agg(*total)
        moving = stored(moving, "path-sums")
        if moving.isEmpty():
            break
        passed = passed.unionByName(moving)
    extra = passed.join(paths, top).groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(*[F.sum(c).alias(f"{c}_hung") for c in sums])
    whole = own.join(extra, ["conv_id", "depth"], "left").select(*kept, *top, *[(F.col(c) + F.coalesce(f"{c}_hung", F.lit(0))).alias(f"{c}_own") for c in sums])
    return running(whole, top, [F.desc("depth")], {c: f"{c}_own" for c in sums}, name="subtrees").select(*kept, *sums)


def prefix_trie(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Nodes of the trie of numbered turns ``rows`` (conv_id, at, print, words, last) and conversations ``every`` (conv_id, length)."""
    nodes, ends = nodes_of(rows, every)
    trie = with_heavy_children(nodes).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    below = with_subtree_sums(trie, ["n_leaves", "saved_tokens"])
    named = below.join(ends_hashes(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' trie."""
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


#: Unsigned crc32 of a decimal, bit by bit: a byte is mixed in, then come eight steps of one bit, marked by -1.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

ORACLE = f"""
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM said),
parts AS (
  SELECT c.conv_id, 0 AS half, s.place, s.said, s.words FROM convs c JOIN said s ON s.conv_id = c.base AND s.place <= c.h
  UNION ALL SELECT c.conv_id, 1, s.place, s.said, s.words FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.place > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, place) AS depth, said, words FROM parts),
prefixes AS (
  SELECT conv_id, depth, words, string_agg(said, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM prefixes),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, left(path, greatest(length(path) - 33, 0)) AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM sized GROUP BY depth, path),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.above = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.above),
below AS (
  SELECT a.depth, a.path, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM counted n CROSS JOIN generate_series(0, n.depth) AS g(up) JOIN nodes a ON a.depth = g.up AND a.path = left(n.path, greatest(33 * g.up - 1, 0)) GROUP BY a.depth, a.path)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN below USING (depth, path)
"""
