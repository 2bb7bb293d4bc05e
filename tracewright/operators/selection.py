"""Top-k and budgeted selection."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_k(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k best; Spark keeps k rows in each task and merges them."""
    return df.orderBy(F.desc(score), *ties).limit(k)


def greedy_fit(df: DataFrame, keys: list[str], item: str, cost: str, score: str, budget: int, reserved: int = 0) -> DataFrame:
    """(keys, item, used): items taken in score order while they fit; one that doesn't fit is passed over.

    A key's rows stream by in order, batch after batch, and only what is spent so far is remembered; so every item is
    tried, and no key's rows are held together.  Items without a cost are left out; costs are not negative.
    """
    able = df.filter(F.col(cost) <= budget - reserved)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), item))
    rows = able.select(*keys, item, F.col(cost).cast("long").alias("_cost"), place.alias("_place"))
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in (*keys, item)), T.StructField("used", T.LongType())])

    def run(batches):
        used = reserved
        for batch in batches:
            costs, places = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            new = np.flatnonzero(places == 1)
            taken, spent = [], []
            for start, end in zip([0, *new], [*new, costs.size], strict=True):
                if start < end and places[start] == 1:
                    used = reserved
                at = start
                while at < end:
                    fits = at + np.flatnonzero(costs[at:end] <= budget - used)
                    if not fits.size:
                        break
                    # from the first one that fits, as many as fit one after another
                    at = int(fits[0])
                    sums = used + np.cumsum(costs[at:end])
                    n = int(np.searchsorted(sums, budget, side="right"))
                    taken.append(np.arange(at, at + n))
                    spent.append(sums[:n])
                    used, at = int(sums[n - 1]), at + n + 1
            if taken:
                kept = batch.take(pa.array(np.concatenate(taken)))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-2], pa.array(np.concatenate(spent), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def knapsack(df: DataFrame, key: str, item: str, group: str, cost: str, score: str, budget: int, candidates: int = 12, most: int = 6, per_group: int = 2) -> DataFrame:
    """(key, item): the best-scoring set of at most ``most`` items and ``per_group`` of a group within a budget, exactly, over each key's best candidates.

    Equal scores go to the cheaper set, then to the one of better-placed items.  A key's work is at most 2^candidates sets.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))
    short = df.withColumn("_p", place).filter(F.col("_p") <= candidates).select(key, item, group, cost, score, "_p")
    schema = f"{key} {dict(df.dtypes)[key]}, {item} {dict(df.dtypes)[item]}"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_p").reset_index(drop=True)
        costs, scores, groups = rows[cost].tolist(), rows[score].tolist(), rows[group].tolist()
        best = ((0.0, 0, ()), ())
        for n in range(1, min(most, len(rows)) + 1):
            for chosen in combinations(range(len(rows)), n):
                spent = sum(costs[i] for i in chosen)
                if spent > budget or max(sum(groups[i] == groups[j] for i in chosen) for j in chosen) > per_group:
                    continue
                mark = (round(sum(scores[i] for i in chosen), 9), -spent, tuple(-i for i in chosen))
                if mark > best[0]:
                    best = (mark, chosen)
        return rows.loc[list(best[1]), [key, item]]

    return short.groupBy(key).applyInPandas(solve, schema)


def suppress(df: DataFrame, key: str, group: str, lo: str, hi: str, score: str, most: int = 6, per_group: int = 2) -> DataFrame:
    """(key, group, lo, hi, score): in score order, intervals that overlap a chosen one of their group are absorbed by it."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, group, lo, hi, score))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        chosen: list[list] = []
        for r in rows.sort_values([score, group, lo], ascending=[False, True, True])[[key, group, lo, hi, score]].values.tolist():
            over = next((c for c in chosen if c[1] == r[1] and c[2] <= r[3] and r[2] <= c[3]), None)
            if over:
                over[2], over[3] = min(over[2], r[2]), max(over[3], r[3])
            elif len(chosen) < most and sum(c[1] == r[1] for c in chosen) < per_group:
                chosen.append(r)
        return pd.DataFrame(chosen, columns=[key, group, lo, hi, score])

    return df.groupBy(key).applyInPandas(pick, schema)


def diverse(df: DataFrame, key: str, label: str, score: str, item: str, most: int, floor: float = 0.2) -> DataFrame:
    """(key, item, label, score): items above a share of the best, one winner of each label first, then the rest, up to ``most``."""
    best = F.max(score).over(Window.partitionBy(key))
    winner = F.row_number().over(Window.partitionBy(key, label).orderBy(F.desc(score), item))
    placed = df.withColumn("_b", best).filter(F.col(score) >= floor * F.col("_b")).withColumn("_w", F.when(winner == 1, 0).otherwise(1))
    order = F.row_number().over(Window.partitionBy(key).orderBy("_w", F.desc(score), item))
    return placed.withColumn("_o", order).filter(F.col("_o") <= most).select(key, item, label, score)


def budget_ladder(df: DataFrame, key: str, budgets: tuple[int, ...], need: Column) -> DataFrame:
    """(key, budget): the smallest budget that suffices, else the first."""
    fits = [F.when(need <= b, F.lit(b)) for b in budgets]
    return df.select(key, F.coalesce(*fits, F.lit(budgets[0])).alias("budget"))
