"""Change history: churn, ownership, co-change and decayed counters over (commit, author, time, file) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import half_life, half_up
from tracewright.session import checkpointed, dealt

#: Files of a commit beyond which it says nothing about pairs, commits that a pair must share, partners kept for a file.
MOST_FILES, LEAST_SHARED, PARTNERS, OWNERS = 30, 2, 5, 3


def commit_files(df: DataFrame, commit: str, author: str, ts: str, file: str) -> DataFrame:
    """Distinct (sha, author, ts, file)."""
    return df.select(F.col(commit).alias("sha"), F.col(author).alias("author"), F.col(ts).alias("ts"), F.col(file).alias("file")).distinct()


def churn(rows: DataFrame) -> DataFrame:
    """(file, churn, last_changed)."""
    # a commit's row of a file first: where rows are dealt out by commit, that takes no shuffle of its own
    once = rows.groupBy("sha", "file").agg(F.max("ts").alias("ts"))
    return once.groupBy("file").agg(F.count("sha").alias("churn"), F.max("ts").alias("last_changed"))


def owners(rows: DataFrame, top: int = OWNERS, rows_hint: int = 0) -> DataFrame:
    """(file, author, commits, place): the authors with the most commits of each file; ``rows_hint`` rows decide on the number of tasks."""
    once = dealt(rows.select("sha", "file", "author").distinct(), rows_hint, "file")
    counted = once.groupBy("file", "author").agg(F.count("sha").alias("commits"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("commits"), "author"))
    return counted.withColumn("place", place).filter(F.col("place") <= top)


def pair_counts(rows: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """(a, b, n): commits that touch both; a commit of at most ``most_files`` files gives a bounded number of pairs."""
    files = rows.select("sha", "file").distinct()
    small = files.groupBy("sha").agg(F.count("*").alias("k")).filter(F.col("k").between(2, most_files))
    left = checkpointed(files.join(small, "sha").select("sha", "file", "k"))
    # each file of a commit of k stands for (k - 1) / 2 pairs: their number is that of the tasks that count them
    held, n = left.agg(F.count("*"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0))).first()
    left = dealt(left.drop("k"), held, "sha")
    pairs = left.alias("x").join(left.alias("y"), "sha").filter("x.file < y.file").select(F.col("x.file").alias("a"), F.col("y.file").alias("b"))
    return dealt(pairs, n // 2, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def cochange(rows: DataFrame, least: int = LEAST_SHARED, partners: int = PARTNERS, most_files: int = MOST_FILES) -> DataFrame:
    """(a, b, n, strength): pairs by Jaccard of their commits, kept where among the strongest of either file."""
    changed = churn(rows).select("file", "churn")
    pairs = pair_counts(rows, most_files).filter(F.col("n") >= least)
    both = pairs.join(changed.withColumnsRenamed({"file": "a", "churn": "ca"}), "a").join(changed.withColumnsRenamed({"file": "b", "churn": "cb"}), "b")
    scored = both.select("a", "b", "n", half_up(F.col("n"), F.col("ca") + F.col("cb") - F.col("n"), 3).alias("strength"))
    ends = scored.withColumn("file", F.explode(F.array("a", "b")))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("strength"), F.desc("n"), "a", "b"))
    return ends.withColumn("place", place).filter(F.col("place") <= partners).select("a", "b", "n", "strength").distinct()


def symmetric(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every pair in both directions."""
    swapped = pairs.select(*(F.col(b if c == a else a if c == b else c).alias(c) for c in pairs.columns))
    return pairs.unionByName(swapped)


def decayed(df: DataFrame, key: str, age: Column, half: float) -> DataFrame:
    """(key, weight): events counted by 0.5 ^ (age / half), the closed form of a counter that decays between events."""
    return df.groupBy(key).agg(F.sum(half_life(age, half)).alias("weight"))


def feedback_boost(weight: Column) -> Column:
    return F.least(F.lit(0.25), 0.08 * F.log2(1 + weight))
