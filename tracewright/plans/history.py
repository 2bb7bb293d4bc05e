"""Queries over change history: orders are commits, their customers the authors, parts the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import history as H
from tracewright.session import dealt

from .registry import Tables, query

ROWS = """rows AS (SELECT DISTINCT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CHURN = f"""{ROWS}, churned AS (SELECT file, count(DISTINCT sha) AS churn, max(ts) AS last_changed FROM rows GROUP BY file)"""
PAIRS = """small AS (SELECT sha FROM rows GROUP BY sha HAVING count(*) BETWEEN 2 AND 30),
pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM rows x JOIN rows y ON x.sha = y.sha AND x.file < y.file WHERE x.sha IN (SELECT sha FROM small) GROUP BY ALL)"""
STRENGTH = "floor((2000 * n + (ca + cb - n))::DOUBLE / (2 * (ca + cb - n))) / 1000.0::DOUBLE"


def commits(t: Tables) -> DataFrame:
    n = t.lineitem.count()  # the files' footers tell
    lines = dealt(t.lineitem.select("l_orderkey", "l_partkey"), n, "l_orderkey")
    orders = dealt(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), n, "o_orderkey")
    return H.commit_files(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_orderkey", "o_custkey", "o_orderdate", "l_partkey")


@query("cochange_top", f"""WITH {CHURN}, {PAIRS},
scored AS (SELECT a, b, n, {STRENGTH} AS strength FROM (SELECT p.*, x.churn AS ca, y.churn AS cb FROM pairs p JOIN churned x ON x.file = a JOIN churned y ON y.file = b WHERE n >= 2)),
ends AS (SELECT *, a AS file FROM scored UNION ALL SELECT *, b FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY strength DESC, n DESC, a, b) AS place FROM ends)
SELECT DISTINCT a, b, n, strength FROM placed WHERE place <= 5""")
def cochange_top(t: Tables) -> DataFrame:
    return H.cochange(commits(t))


@query("jn15_pair_counts", f"WITH {ROWS}, {PAIRS} SELECT a, b, n FROM pairs")
def pair_counts(t: Tables) -> DataFrame:
    return H.pair_counts(commits(t))


@query("ag6_churn", f"WITH {CHURN} SELECT file, churn FROM churned")
def churn(t: Tables) -> DataFrame:
    return H.churn(commits(t)).select("file", "churn")


@query("ag7_owners", f"""WITH {ROWS}, c AS (SELECT file, author, count(DISTINCT sha) AS commits FROM rows GROUP BY ALL)
SELECT file, author, commits, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY commits DESC, author) AS place FROM c) WHERE place <= 3""")
def owners(t: Tables) -> DataFrame:
    return H.owners(commits(t), rows_hint=t.lineitem.count())


@query("ag8_last_changed", f"WITH {CHURN} SELECT file, epoch_us(last_changed) AS last_us FROM churned")
def last_changed(t: Tables) -> DataFrame:
    return H.churn(commits(t)).select("file", F.unix_micros(F.col("last_changed").cast("timestamp")).alias("last_us"))


@query("st11_symmetric_cochange", f"""WITH {CHURN}, {PAIRS}, p AS (SELECT a, b, n FROM pairs WHERE n >= 2) SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p""")
def symmetric_cochange(t: Tables) -> DataFrame:
    return H.symmetric(H.pair_counts(commits(t)).filter("n >= 2"))


LAST = "(SELECT max(ts) FROM events)"


@query("ag25_decayed_feedback", f"""SELECT user_id, round(sum(pow(0.5::DOUBLE, (epoch_us({LAST}) - epoch_us(ts)) / 1000000.0::DOUBLE / 2592000.0::DOUBLE)), 6) AS weight,
round(least(0.25::DOUBLE, 0.08::DOUBLE * log2(1 + sum(pow(0.5::DOUBLE, (epoch_us({LAST}) - epoch_us(ts)) / 1000000.0::DOUBLE / 2592000.0::DOUBLE)))), 6) AS boost FROM events GROUP BY user_id""")
def decayed_feedback(t: Tables) -> DataFrame:
    """Edits are events; a user's weight halves in 30 days."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    now = t.events.agg(F.max(micros)).scalar()
    weights = H.decayed(t.events, "user_id", (now - micros) / 1e6, 30 * 86400.0)
    return weights.select("user_id", F.round("weight", 6).alias("weight"), F.round(H.feedback_boost(F.col("weight")), 6).alias("boost"))
