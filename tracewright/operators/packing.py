"""Composed answers: candidates from several channels, grouped, suppressed and packed to a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands
from .selection import greedy_fit, knapsack, suppress


def blocks(hits: DataFrame, keys: list[str], line: str, score: str, pad: int = 3, gap: int = 5) -> DataFrame:
    """(keys, lo, hi, score, hits): windows around scored lines, merged, with the sum of their lines' scores."""
    spans = hits.select(*keys, F.greatest(F.col(line) - pad, F.lit(1)).alias("lo"), (F.col(line) + pad).alias("hi"))
    merged = islands(spans, keys, "lo", "hi", gap).drop("n")
    both = hits.join(merged, keys).filter((F.col(line) >= F.col("lo")) & (F.col(line) <= F.col("hi")))
    return both.groupBy(*keys, "lo", "hi").agg(F.round(F.sum(score), 6).alias("score"), F.count("*").alias("hits"))


def context_pack(target: DataFrame, callers: DataFrame, callees: DataFrame, further: DataFrame, ranks: DataFrame, cost: str, budget: int) -> DataFrame:
    """(target, node, used): neighbours weighed by their relation and half their rank and more, taken while they fit.

    Inputs are (target, node) pairs; a node counts by its best relation: caller 1.0, callee 0.85, second-order caller 0.4.
    """
    parts = [df.select("target", "node", F.lit(w).alias("w")) for df, w in ((callers, 1.0), (callees, 0.85), (further, 0.4))]
    best = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(target.select("target"), "target", "left_semi").groupBy("target", "node").agg(F.max("w").alias("w"))
    most = ranks.agg(F.max("rank")).scalar()
    scored = best.join(ranks, "node").withColumn("score", F.round(F.col("w") * (0.5 + F.col("rank") / most), 9))
    return greedy_fit(scored, ["target"], "node", cost, "score", budget)


def packet(hits: DataFrame, query: str, file: str, line: str, score: str, budget: int, chars_per_line: int = 40) -> DataFrame:
    """(query, file, lo, hi, score, cost): the best blocks of a request: grouped lines, overlaps suppressed, an exact knapsack within the budget."""
    made = blocks(hits, [query, file], line, score).select(query, file, "lo", "hi", "score")
    kept = suppress(made, query, file, "lo", "hi", "score", most=12)
    costed = kept.withColumn("cost", F.ceil((F.col("hi") - F.col("lo") + 1) * chars_per_line / 4).cast("long"))
    numbered = costed.withColumn("block", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), file, "lo")))
    chosen = knapsack(numbered, query, "block", file, "cost", "score", budget)
    return numbered.join(chosen, [query, "block"]).drop("block")


def shrink(df: DataFrame, key: str, lo: str, hi: str, focus: str, budget: int) -> DataFrame:
    """Blocks trimmed at the end farther from their focus until they are of at most ``budget`` lines: a closed form, row by row."""
    over = F.greatest(F.col(hi) - F.col(lo) + 1 - budget, F.lit(0))
    left, right = F.col(focus) - F.col(lo), F.col(hi) - F.col(focus)
    # the farther end is cut until both are as far, then both alike
    first_left = F.least(over, F.greatest(left - right, F.lit(0)))
    first_right = F.least(over, F.greatest(right - left, F.lit(0)))
    rest = over - first_left - first_right
    return df.select(key, (F.col(lo) + first_left + F.floor(rest / 2)).alias(lo), (F.col(hi) - first_right - F.ceil(rest / 2)).alias(hi))


def trim_largest(df: DataFrame, key: str, group: str, item: str, most: int) -> DataFrame:
    """(key, group, item): the last item of the largest group goes until ``most`` are left; what is kept is each group's beginning.

    Levelling groups from the top leaves min(size, level) of each, and one more of the first groups for what remains.
    """
    order = Window.partitionBy(key, group).orderBy(item)
    placed = df.withColumn("_p", F.row_number().over(order))
    rounds = Window.partitionBy(key).orderBy("_p", group)
    return placed.withColumn("_r", F.row_number().over(rounds)).filter(F.col("_r") <= most).select(key, group, item)


def flow(seeds: DataFrame, edges: DataFrame, decay: float = 0.65, hops: int = 2, most: int = 18) -> DataFrame:
    """(node, score): seeds' scores carried along edges, times ``decay`` a hop; the best of a node's."""
    out = seeds.select("node", "score")
    step = out
    for _ in range(hops):
        step = step.join(edges.withColumnsRenamed({"src": "node"}), "node").groupBy(F.col("dst").alias("node")).agg((F.max("score") * decay).alias("score"))
        out = out.unionByName(step)
    return out.groupBy("node").agg(F.round(F.max("score"), 9).alias("score")).orderBy(F.desc("score"), "node").limit(most)


def unified_diff(df: DataFrame, key: str, text: str, old: str, new: str) -> DataFrame:
    """(key, patch): the unified diff of replacing a literal in each text that has it."""
    from difflib import unified_diff as lines_diff

    def run(frames):
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                a, b = t.splitlines(keepends=True), t.replace(old, new).splitlines(keepends=True)
                out.append((k, "".join(lines_diff(a, b, f"a/{k}", f"b/{k}"))))
            yield pd.DataFrame(out, columns=[key, "patch"])

    return df.filter(F.contains(text, F.lit(old))).select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, patch string")


def hashed_vectors(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, term_slot, weight): a stand-in embedder, where no model is at hand: words hashed to slots, signs by hash."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    slot, sign = F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(size)), F.when(F.crc32(F.concat(F.lit("s"), "w").cast("binary")) % 2 == 0, 1.0).otherwise(-1.0)
    return words.groupBy(key, slot.alias("slot")).agg(F.sum(sign).alias("weight"))
