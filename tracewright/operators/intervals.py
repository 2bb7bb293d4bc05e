"""Interval operators: islands, coverage, subtraction and bounded merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], lo: str, hi: str, slack: int | Column = 1) -> DataFrame:
    """(keys, lo, hi, n): closed intervals merged where the next starts at most ``slack`` after the furthest end so far."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(lo) > reach + slack), 1).otherwise(0)
    numbered = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("_island")


def subtract(df: DataFrame, seen: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, lo, hi): what of the closed integer intervals of ``df`` no interval of ``seen`` covers, by a sweep over ends."""
    cut = [*keys, "_at"]
    a = df.select(*keys, F.explode(F.array(F.struct(F.col(lo).alias("_at"), F.lit(1).alias("_w"), F.lit(0).alias("_s")), F.struct((F.col(hi) + 1).alias("_at"), F.lit(-1).alias("_w"), F.lit(0).alias("_s")))).alias("e"))
    b = seen.select(*keys, F.explode(F.array(F.struct(F.col(lo).alias("_at"), F.lit(0).alias("_w"), F.lit(1).alias("_s")), F.struct((F.col(hi) + 1).alias("_at"), F.lit(0).alias("_w"), F.lit(-1).alias("_s")))).alias("e"))
    steps = a.union(b).select(*keys, "e.*").groupBy(*cut).agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    order = Window.partitionBy(*keys).orderBy("_at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.withColumn("_wanted", F.sum("_w").over(upto)).withColumn("_covered", F.sum("_s").over(upto)).withColumn("_next", F.lead("_at").over(order))
    free = swept.filter("_wanted > 0 AND _covered = 0").select(*keys, F.col("_at").alias(lo), (F.col("_next") - 1).alias(hi))
    return islands(free, keys, lo, hi).select(*keys, lo, hi)


def bounded_merge(df: DataFrame, keys: list[str], lo: str, hi: str, gap: int, longest: int, most: int) -> DataFrame:
    """(keys, lo, hi): intervals merged in order while the gap and the merged length stay within bounds, the first ``most`` of a key.

    The length bound makes it a fold over each key's sorted intervals, which are a document's or file's few.
    """
    kind = dict(df.dtypes)[lo]
    sites = F.array_sort(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).cast(kind).alias("hi"))))
    empty = F.array().cast(f"array<struct<lo:{kind},hi:{kind}>>")

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        fits = (F.size(done) > 0) & (x["lo"] - last["hi"] <= gap) & (F.greatest(last["hi"], x["hi"]) - last["lo"] + 1 <= longest)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    folded = df.groupBy(*keys).agg(F.aggregate(sites, empty, lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(step(done, x))).alias("m"))
    return folded.select(*keys, F.explode(F.slice("m", 1, most)).alias("r")).select(*keys, F.col("r.lo").alias(lo), F.col("r.hi").alias(hi))


def context(df: DataFrame, keys: list[str], order: str, hit: Column, around: int) -> DataFrame:
    """Rows within ``around`` rows of a hit."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-around, around)
    return df.withColumn("_near", F.max(hit.cast("int")).over(near)).filter("_near = 1").drop("_near")


def carried(df: DataFrame, keys: list[str], order: str, header: Column, name: str) -> DataFrame:
    """Each row with the last header at or before it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(upto))
