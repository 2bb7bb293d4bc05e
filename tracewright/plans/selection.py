"""Top-k and budgeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import selection as P

from .registry import Tables, query


@query("tk1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t: Tables) -> DataFrame:
    return P.top_k(t.orders, 20, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("tk2_top_public", "SELECT p_partkey, p_retailprice FROM part WHERE p_brand != 'Brand#11' ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def top_public(t: Tables) -> DataFrame:
    return P.top_k(t.part.filter("p_brand != 'Brand#11'"), 15, "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("tk3_overfetch_rerank", """WITH f AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) SELECT p_partkey, round(p_retailprice * (1.0::DOUBLE + 0.5::DOUBLE * p_size / (SELECT max(p_size) FROM f)) * CASE WHEN p_type LIKE '%A%' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 4) AS score FROM f ORDER BY p_retailprice * (1.0::DOUBLE + 0.5::DOUBLE * p_size / (SELECT max(p_size) FROM f)) * CASE WHEN p_type LIKE '%A%' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END DESC, p_partkey LIMIT 10""")
def overfetch_rerank(t: Tables) -> DataFrame:
    """Five times as many by the first score, then the best by the second."""
    fetched = P.top_k(t.part, 50, "p_retailprice", "p_partkey")
    most = F.max("p_size").over(Window.partitionBy())  # over the 50 fetched rows
    score = F.col("p_retailprice") * (1.0 + 0.5 * F.col("p_size") / most) * F.when(F.col("p_type").contains("A"), 0.5).otherwise(1.0)
    return P.top_k(fetched.withColumn("s", score), 10, "s", "p_partkey").select("p_partkey", F.round("s", 4).alias("score"))


@query("tk4_greedy_fit", """WITH RECURSIVE c AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS cost, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS p FROM part WHERE p_size <= 200),
g AS (SELECT p_brand, p, p_partkey, cost <= 200 AS took, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used FROM c WHERE p = 1 UNION ALL SELECT c.p_brand, c.p, c.p_partkey, g.used + c.cost <= 200, CASE WHEN g.used + c.cost <= 200 THEN g.used + c.cost ELSE g.used END FROM g JOIN c ON c.p_brand = g.p_brand AND c.p = g.p + 1)
SELECT p_brand, p_partkey, used FROM g WHERE took""")
def greedy_fit(t: Tables) -> DataFrame:
    return P.greedy_fit(t.part, ["p_brand"], "p_partkey", "p_size", "p_retailprice", 200)


@query("tk5_knapsack")
def knapsack(t: Tables) -> DataFrame:
    return P.knapsack(t.part.filter("p_size > 5"), "p_brand", "p_partkey", "p_type", "p_size", "p_retailprice", 100)


@query("tk7_suppression")
def suppression(t: Tables) -> DataFrame:
    lo = (F.col("l_partkey") % 200).alias("lo")
    blocks = t.lineitem.filter("l_quantity > 47").select(F.col("l_suppkey").alias("q"), F.col("l_returnflag").alias("file"), lo, (lo + F.col("l_linenumber") * 3).alias("hi"), F.col("l_extendedprice").alias("score"))
    return P.suppress(blocks, "q", "file", "lo", "hi", "score")


@query("tk9_budget_ladder", "SELECT doc_id, CASE WHEN n_chars <= 800 THEN 800 WHEN n_chars <= 1200 THEN 1200 WHEN n_chars <= 2000 THEN 2000 ELSE 800 END AS budget FROM documents")
def budget_ladder(t: Tables) -> DataFrame:
    return P.budget_ladder(t.documents, "doc_id", (800, 1200, 2000), F.col("n_chars"))


@query("tk11_diverse_seeds", """WITH b AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM events), w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1 THEN 0 ELSE 1 END AS w FROM b WHERE value >= 0.2::DOUBLE * best)
SELECT user_id, event_id, event_type, value FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w, value DESC, event_id) <= 6""".replace("FROM b WHERE value", "FROM b WHERE value"))
def diverse_seeds(t: Tables) -> DataFrame:
    return P.diverse(t.events, "user_id", "event_type", "value", "event_id", 6)


@query("tk12_directory_diverse", "SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS d FROM part) ORDER BY CASE WHEN d = 1 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey LIMIT 40")
def directory_diverse(t: Tables) -> DataFrame:
    d = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.withColumn("d", d).orderBy(F.when(F.col("d") == 1, 0).otherwise(1), F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey")


@query("q8_container_merge", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45), b AS (SELECT l_orderkey FROM s GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 2)
SELECT 'order' AS kind, l_orderkey AS id FROM b UNION ALL SELECT 'line', l_partkey FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b)""")
def container_merge(t: Tables) -> DataFrame:
    """Two selected members of a container or more are replaced by it."""
    s = t.lineitem.filter("l_quantity > 45")
    whole = s.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n")).filter("n >= 2").select("l_orderkey")
    single = s.join(whole, "l_orderkey", "left_anti")
    return whole.select(F.lit("order").alias("kind"), F.col("l_orderkey").alias("id")).union(single.select(F.lit("line"), "l_partkey"))


@query("q10_ranked_links", "SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 ELSE 1 END, l_suppkey, l_orderkey, l_linenumber) <= 3")
def ranked_links(t: Tables) -> DataFrame:
    resolved = F.when(F.col("l_returnflag") == "N", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy(resolved, "l_suppkey", "l_orderkey", "l_linenumber"))
    return t.lineitem.withColumn("p", place).filter("p <= 3").select("l_partkey", "l_suppkey", "l_orderkey")
