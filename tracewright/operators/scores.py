"""Weighted scores and the aggregates they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import clamp, log_ratio, recency_step

#: What complexity, churn, coverage gap, centrality and each open finding weigh in a risk.
W_COMPLEXITY, W_CHURN, W_COVERAGE, W_CENTRALITY, W_FINDING = 0.3, 0.25, 0.25, 0.2, 0.15
VERY_COMPLEX, COMPLEX = 20, 10


def best_edge(df: DataFrame, keys: list[str], rank: str, line: str) -> DataFrame:
    """One row a pair: the best rank, then the smallest line."""
    return df.groupBy(*keys).agg(F.min(F.struct(rank, line)).alias("m")).select(*keys, f"m.{rank}", f"m.{line}")


def file_risk(df: DataFrame, key: str, cx: str, churn: str, cov: str, tested: str, rank: str, findings: str) -> DataFrame:
    """(key, risk, reasons): complexity, churn, coverage gap, centrality and findings, weighed and clamped."""
    most = df.agg(F.greatest(F.max(churn), F.lit(1)).alias("c"), F.max(rank).alias("r"))
    c, r = most.select("c").scalar(), most.select("r").scalar()
    share = F.col(churn) / c
    gap = F.when(F.col(cov).isNotNull(), 1.0 - F.col(cov)).when(F.col(tested), 0.2).otherwise(0.6)
    total = W_COMPLEXITY * clamp((F.col(cx) - 1) / float(VERY_COMPLEX)) + W_CHURN * share + W_COVERAGE * gap + W_CENTRALITY * (F.col(rank) / r) + W_FINDING * F.col(findings)
    reasons = F.concat_ws(
        ",", F.when(F.col(cx) >= COMPLEX, "complexity"), F.when((share >= 0.5) & (F.col(churn) >= 3), "churn"), F.when(F.col(cov) < 0.5, "coverage"),
        F.when(F.col(cov).isNull() & ~F.col(tested), "untested"), F.when(F.col(findings) > 0, "findings"),
    )
    return df.select(key, F.round(clamp(total), 9).alias("risk"), reasons.alias("reasons"))


def audit_score(df: DataFrame, key: str, risk: str, rank: str, blast: str, days: str, smells: str | None, findings: str) -> DataFrame:
    """3 risk + 2 centrality + 1.5 log-scaled blast + recency + smells up to 4 + 1.5 a finding."""
    most = df.agg(F.max(rank).alias("r"), F.max(blast).alias("b"))
    score = (
        3 * F.col(risk) + 2 * F.col(rank) / most.select("r").scalar() + 1.5 * log_ratio(F.col(blast), most.select("b").scalar()) + recency_step(F.col(days))
        + (F.least(F.lit(4.0), F.col(smells)) if smells else F.lit(0.0)) + 1.5 * F.col(findings)
    )
    return df.select(key, F.round(score, 6).alias("score"))


def capped_sum(df: DataFrame, key: str, kind: str, weights: dict[str, float], other: float, cap: float) -> DataFrame:
    """(key, score): weights of kinds summed up to a cap."""
    weight = F.lit(other)
    for k, w in weights.items():
        weight = F.when(F.col(kind) == k, w).otherwise(weight)
    return df.groupBy(key).agg(F.least(F.lit(cap), F.sum(weight)).alias("score"))


def order_statistics(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """By group, the values at places floor(n * share), from 0, of the sorted values.

    Values are counted first, so that the running sums are over distinct values, not rows.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rising = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("n").over(rising)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return placed.groupBy(key).agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col(value))).alias(name) for name, share in at.items()))


def order_statistic(df: DataFrame, value: str, share: float) -> Column:
    """The value at floor(n * share) of all rows, as a scalar subquery."""
    return order_statistics(df.withColumn("all_rows", F.lit(1)), "all_rows", value, {"v": share}).select("v").scalar()


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def area_split(df: DataFrame, key: str, top: str, sub: str, share: float, containers: tuple[str, ...]) -> DataFrame:
    """(key, area): a top folder is split one level where it has two subfolders and is a container or holds enough of all files."""
    sizes = df.groupBy(top).agg(F.countDistinct(sub).alias("subs"), F.count("*").alias("n"))
    everything = df.agg(F.count("*")).scalar()
    split = (F.col("subs") >= 2) & ((F.col("n") >= share * everything) | F.col(top).isin(*containers))
    return df.join(sizes, top).select(key, F.when(split, F.concat_ws("/", top, sub)).otherwise(F.col(top)).alias("area"))


def uncalled(df: DataFrame, users: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that none of the relations names: a chain of anti joins."""
    for other, key in users:
        df = df.join(other.select(key).distinct(), key, "left_anti")
    return df
