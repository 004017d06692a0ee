"""Running sums against plain loops, with groups that go over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import scans


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        draw = random.Random(parts)
        rows = [(draw.choice(["hot"] * 6 + ["a", "b", None]), k, draw.choice([None, draw.randrange(-50, 50)]), "x") for k in range(700)]
        df = spark.createDataFrame(rows, "g string, k int, v long, part string")
        got = {r["k"]: (r["total"], r["n"], r["part"]) for r in scans.running(df.withColumn("one", F.lit(1).cast("long")), ["g"], ["k"], {"total": "v", "n": "one"}).collect()}
        sums = {}
        for g, k, v, _ in rows:
            total, n = sums.get(g, (0, 0))
            sums[g] = total + (v or 0), n + 1
            assert got[k] == (*sums[g], "x")
        whole = scans.running(df, [], [F.desc("k")], {"total": "v"}).where("k = 0").first()
        assert whole["total"] == sum(v or 0 for _, _, v, _ in rows)
        assert scans.running(df.limit(0), ["g"], ["k"], {"total": "v"}).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_wrapped_sums(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(3), k, draw.randrange(-(1 << 63), 1 << 63)) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, v long")
    got = scans.running(df, ["g"], ["k"], {"total": "v"}, wraps=True).withColumn("before", scans.wrapped_less(F.col("total"), F.col("v")))
    got, sums = {r["k"]: (r["before"], r["total"]) for r in got.collect()}, {}
    for g, k, v in rows:
        before = sums.get(g, 0)
        sums[g] = scans._signed(before + v)
        assert got[k] == (before, sums[g])
