"""Hash commitments: text, canonical JSON, unordered sets, length-prefixed identities, seeded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def rank_digest(contract: str, seed: str, *keys: Column, separator: str = "\0") -> Column:
    """Digest by which rows of a frame are ranked."""
    joint = F.char(F.lit(0)) if separator == "\0" else F.lit(separator)
    parts = [F.lit(contract), F.lit(seed), *[k.cast("string") for k in keys]]
    glued = [parts[0]]
    for part in parts[1:]:
        glued += [joint, part]
    return F.sha2(F.concat(*glued), 256)


def canonical_json(*columns: Column) -> Column:
    """JSON of the columns in their order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def commitment(*columns: Column) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def set_commitment(digest: Column) -> Column:
    """Aggregate: a digest of a set of digests, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), "\n"), 256)


def tree_commitment(digests: DataFrame, digest: str, lengths: tuple[int, ...] = (4, 2, 0)) -> DataFrame:
    """``(n, commitment)`` of a set of hex digests, as a Merkle tree over their first digits.

    A leaf is the digest of the sorted digests that begin alike, a node that of its children's prefixes and digests, so no
    aggregate holds more than a leaf's part of the set or 256 children. ``lengths`` are the numbers of digits from the
    leaves to the root; other lengths give other commitments. An empty set's is the digest of an empty text.
    """
    level = digests.select(F.col(digest).alias("line"), F.lit(1).cast("long").alias("n"), F.col(digest).alias("prefix"))
    for length in lengths:
        whole = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)
        grouped = level.withColumn("prefix", F.substring("prefix", 1, length))
        if length:
            level = grouped.groupBy("prefix").agg(whole.alias("d"), F.sum("n").alias("n")).select(F.concat_ws(":", "prefix", "d").alias("line"), "n", "prefix")
        else:
            level = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), whole.alias("commitment"))
    return level


def identity(*parts: Column) -> Column:
    """Length-prefixed parts, so that no two lists of parts look alike."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def unit_id(*parts: Column) -> Column:
    return F.sha2(identity(*parts), 256)
