"""Aggregations, risk and audit scores.  Parts are files: their size is complexity, their orders churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import scores as A

from .registry import Tables, query


@query("ag4_best_edge", """SELECT l_suppkey, l_partkey, arg_min(rank, (rank, l_orderkey)) AS confidence, arg_min(l_orderkey, (rank, l_orderkey)) AS line FROM (SELECT *, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank FROM lineitem) GROUP BY ALL""")
def best_edge(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return A.best_edge(t.lineitem.withColumn("rank", rank), ["l_suppkey", "l_partkey"], "rank", "l_orderkey").select("l_suppkey", "l_partkey", F.col("rank").alias("confidence"), F.col("l_orderkey").alias("line"))


@query("ag5_adjacency", """SELECT l_suppkey AS node, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS callees FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey""")
def adjacency(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(F.array_sort(F.collect_set("l_partkey")).alias("s"))
    return sets.select("node", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("callees"))


FILES = """churned AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS churn, avg(l_discount) AS disc FROM lineitem GROUP BY l_partkey),
files AS (SELECT p_partkey AS k, p_size AS cx, coalesce(churn, 0) AS churn, CASE WHEN p_partkey % 3 = 0 THEN round(10 * disc, 4) END AS cov, p_partkey % 5 = 0 AS tested, p_retailprice AS rank, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS findings FROM part LEFT JOIN churned ON k = p_partkey)"""


def _files(t: Tables) -> DataFrame:
    churned = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.countDistinct("l_orderkey").alias("churn"), F.avg("l_discount").alias("disc"))
    p = F.col("p_partkey")
    return t.part.join(churned, p == F.col("k"), "left").select(
        p.alias("k"), F.col("p_size").alias("cx"), F.coalesce("churn", F.lit(0)).alias("churn"), F.when(p % 3 == 0, F.round(10 * F.col("disc"), 4)).alias("cov"),
        (p % 5 == 0).alias("tested"), F.col("p_retailprice").alias("rank"), F.when(p % 11 == 0, 1).otherwise(0).alias("findings"),
    )


@query("ag10_file_risk", f"""WITH {FILES}, m AS (SELECT max(churn) AS mc, max(rank) AS mr FROM files),
s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (cx - 1) / 20.0::DOUBLE)) AS c, churn::DOUBLE / mc AS h, CASE WHEN cov IS NOT NULL THEN 1.0::DOUBLE - cov WHEN tested THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END AS gap, rank / mr AS cen FROM files, m)
SELECT k, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE * c + 0.25::DOUBLE * h + 0.25::DOUBLE * gap + 0.2::DOUBLE * cen + 0.15::DOUBLE * findings)), 9) AS risk,
concat_ws(',', CASE WHEN cx >= 10 THEN 'complexity' END, CASE WHEN h >= 0.5::DOUBLE AND churn >= 3 THEN 'churn' END, CASE WHEN cov < 0.5::DOUBLE THEN 'coverage' END, CASE WHEN cov IS NULL AND NOT tested THEN 'untested' END, CASE WHEN findings > 0 THEN 'findings' END) AS reasons FROM s""")
def file_risk(t: Tables) -> DataFrame:
    return A.file_risk(_files(t), "k", "cx", "churn", "cov", "tested", "rank", "findings")


@query("ag11_symbol_risk", f"""WITH {FILES} SELECT k, round(0.3::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (cx - 1) / 20.0::DOUBLE)) + 0.2::DOUBLE * rank / (SELECT max(rank) FROM files) + 0.25::DOUBLE * CASE WHEN tested THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END, 9) AS risk FROM files WHERE cx >= 40""")
def symbol_risk(t: Tables) -> DataFrame:
    files = _files(t)
    most = files.agg(F.max("rank")).scalar()
    risk = 0.3 * S.clamp((F.col("cx") - 1) / 20.0) + 0.2 * F.col("rank") / most + 0.25 * F.when(F.col("tested"), 0.2).otherwise(0.6)
    return files.filter("cx >= 40").select("k", F.round(risk, 9).alias("risk"))


@query("ag12_top_decile", """SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT min(p_retailprice) FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i >= CAST(floor(n * 0.9::DOUBLE) AS BIGINT))""")
def top_decile(t: Tables) -> DataFrame:
    """Rows at or above the order statistic at nine tenths, by counts of distinct values: no array of all values is made."""
    return t.part.filter(F.col("p_retailprice") >= A.order_statistic(t.part, "p_retailprice", 0.9)).select("p_partkey", "p_retailprice")


@query("ag13_smells_by_kind", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def smells_by_kind(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


WEIGHTS = {"error": 1.5, "purchase": 1.0, "signup": 0.25}


@query("ag14_capped_sum", """SELECT user_id, least(30.0::DOUBLE, sum(CASE event_type WHEN 'error' THEN 1.5::DOUBLE WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END)) AS score FROM events GROUP BY user_id""")
def capped_sum(t: Tables) -> DataFrame:
    return A.capped_sum(t.events, "user_id", "event_type", WEIGHTS, 0.5, 30.0)


@query("ag15_audit_score", f"""WITH {FILES}, last AS (SELECT l_partkey AS k, max(l_shipdate) AS d FROM lineitem GROUP BY l_partkey), now AS (SELECT max(l_shipdate) AS n FROM lineitem), mx AS (SELECT max(churn) AS mc, max(rank) AS mr FROM files)
SELECT f.k, round(3 * (cx / 50.0::DOUBLE) + 2 * rank / mr + 1.5::DOUBLE * ln(1.0::DOUBLE + churn) / ln(1.0::DOUBLE + mc) + CASE WHEN date_diff('day', d::DATE, n::DATE) <= 30 THEN 1.0::DOUBLE WHEN date_diff('day', d::DATE, n::DATE) <= 90 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 1.5::DOUBLE * findings, 6) AS score
FROM files f LEFT JOIN last l ON l.k = f.k, now, mx""")
def audit_score(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_shipdate").alias("d"))
    files = _files(t)
    now = t.lineitem.agg(F.max("l_shipdate")).scalar()
    both = files.join(last, "k", "left").withColumn("risk", F.col("cx") / 50.0).withColumn("days", F.datediff(now.cast("date"), F.col("d").cast("date")))
    return A.audit_score(both, "k", "risk", "rank", "churn", "days", None, "findings")


@query("ag17_package_rollup", """SELECT p_brand AS package, round(sum(p_retailprice), 2) AS rank, sum(p_size) AS loc, max(p_size) AS max_cx, bool_and(p_size > 1) AS all_big, count(*) AS files, min(p_type) AS dir FROM part GROUP BY p_brand""".replace("sum(p_size)", "CAST(sum(p_size) AS BIGINT)"))
def package_rollup(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("package")).agg(
        F.round(F.sum("p_retailprice"), 2).alias("rank"), F.sum("p_size").alias("loc"), F.max("p_size").alias("max_cx"), F.every(F.col("p_size") > 1).alias("all_big"), F.count("*").alias("files"), F.min("p_type").alias("dir")
    )


@query("ag18_edge_rollup", """SELECT l_suppkey, l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS weight, CASE WHEN bool_or(l_quantity > 49) THEN 'high' ELSE min(CASE WHEN l_quantity > 25 THEN 'low' ELSE 'medium' END) END AS confidence FROM lineitem GROUP BY ALL""")
def edge_rollup(t: Tables) -> DataFrame:
    low = F.min(F.when(F.col("l_quantity") > 25, "low").otherwise("medium"))
    return t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_linenumber").alias("weight"), F.when(F.bool_or(F.col("l_quantity") > 49), "high").otherwise(low).alias("confidence"))


@query("ag19_degrees", """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM n GROUP BY node""")
def degrees(t: Tables) -> DataFrame:
    """Both degrees from one pass over the edges' ends."""
    e = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return A.degrees(e)


@query("ag20_inventory", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def inventory(t: Tables) -> DataFrame:
    return t.documents.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("ag21_severity_counts", "SELECT quality, count(*) FILTER (WHERE toxic = 1) AS open, count(*) FILTER (WHERE toxic = 0) AS closed FROM labels GROUP BY quality")
def severity_counts(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("open"), F.count_if(F.col("toxic") == 0).alias("closed"))


@query("ag22_grouped_reads", """SELECT event_type AS key, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS reads, count(*) AS n FROM events GROUP BY event_type""")
def grouped_reads(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("key")).agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("reads"), F.count("*").alias("n"))


@query("ag23_external_dependents", "SELECT l_shipdate::DATE AS external, count(DISTINCT l_suppkey) AS modules FROM lineitem GROUP BY 1")
def external_dependents(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("external")).agg(F.countDistinct("l_suppkey").alias("modules"))


@query("ag24_area_split", """WITH f AS (SELECT p_partkey, p_type AS top, p_brand AS sub FROM part), s AS (SELECT top, count(DISTINCT sub) AS subs, count(*) AS n FROM f GROUP BY top)
SELECT p_partkey, CASE WHEN subs >= 2 AND (n >= 0.165::DOUBLE * (SELECT count(*) FROM part)) THEN f.top || '/' || sub ELSE f.top END AS area FROM f JOIN s ON s.top = f.top""")
def area_split(t: Tables) -> DataFrame:
    f = t.part.select("p_partkey", F.col("p_type").alias("top"), F.col("p_brand").alias("sub"))
    return A.area_split(f, "p_partkey", "top", "sub", 0.165, ())


@query("ag26_percentiles", """SELECT event_type, (array_agg(value ORDER BY value))[CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, (array_agg(value ORDER BY value))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type""")
def percentiles(t: Tables) -> DataFrame:
    """Order statistics by group from counts of distinct values."""
    return A.order_statistics(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("ag27_retrieval_metrics", """SELECT coalesce(lang, 'all') AS kind, count(*) AS cases, round(avg(n_chars), 6) AS mean_chars, round(avg(CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS located FROM documents GROUP BY GROUPING SETS ((lang), ())""")
def retrieval_metrics(t: Tables) -> DataFrame:
    long = F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)
    return t.documents.groupingSets([["lang"], []], "lang").agg(F.coalesce("lang", F.lit("all")).alias("kind"), F.count("*").alias("cases"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg(long), 9).alias("located")).drop("lang")


@query("ag28_distinct_sets", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS names FROM customer GROUP BY c_nationkey")
def distinct_sets(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("names"))


@query("q26_finding_validation", """SELECT doc_id, concat_ws(';', CASE WHEN quality NOT IN (0, 1) THEN 'quality' END, CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic but good' END, CASE WHEN doc_id < 5 THEN 'line out of bounds' END) AS problems FROM labels""")
def finding_validation(t: Tables) -> DataFrame:
    def when(c: Column, what: str) -> Column:
        return F.when(c, what)

    checks = [when(~F.col("quality").isin(0, 1), "quality"), when((F.col("toxic") == 1) & (F.col("quality") == 1), "toxic but good"), when(F.col("doc_id") < 5, "line out of bounds")]
    return t.labels.select("doc_id", F.concat_ws(";", *checks).alias("problems"))


@query("q28_profile_rows", """SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(max(value), 4) AS slowest FROM events GROUP BY event_type""")
def profile_rows(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("slowest"))


@query("q29_session_report", """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS delivered, count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > count(*) FILTER (WHERE event_type = 'purchase') THEN 'check' ELSE 'fine' END AS verdict FROM events GROUP BY user_id""")
def session_report(t: Tables) -> DataFrame:
    good, bad = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return t.events.groupBy("user_id").agg(good.alias("delivered"), bad.alias("failed"), F.when(bad > good, "check").otherwise("fine").alias("verdict"))


@query("q31_savings", """WITH s AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders) SELECT count(*) AS logs, round(sum(o_totalprice), 2) AS chars_in, CAST(floor(sum(o_shippriority)) AS BIGINT) AS x FROM s WHERE p <= 100""".replace(", CAST(floor(sum(o_shippriority)) AS BIGINT) AS x", ""))
def savings(t: Tables) -> DataFrame:
    newest = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    return newest.agg(F.count("*").alias("logs"), F.round(F.sum("o_totalprice"), 2).alias("chars_in"))


@query("ex2_models", """SELECT p_partkey, CASE WHEN p_type LIKE '%ECONOMY%' OR lower(p_type) LIKE '%economy%' THEN 'django' WHEN p_size > 40 THEN 'dataclass' WHEN (SELECT p_size FROM part q WHERE q.p_partkey = part.p_partkey // 2) > 40 THEN 'dataclass' END AS framework FROM part""")
def models(t: Tables) -> DataFrame:
    """A model's framework by its own marks, else by its parent's, one level up."""
    own = F.when(F.lower("p_type").contains("economy"), "django").when(F.col("p_size") > 40, "dataclass")
    parents = t.part.select(F.col("p_partkey").alias("up"), F.col("p_size").alias("up_size"))
    both = t.part.join(parents, F.expr("p_partkey div 2") == F.col("up"), "left")
    return both.select("p_partkey", F.coalesce(own, F.when(F.col("up_size") > 40, "dataclass")).alias("framework"))


@query("ex4_entry_points", """SELECT DISTINCT kind, name FROM (SELECT 'guard' AS kind, p_brand AS name FROM part WHERE p_size = 50 UNION ALL SELECT 'script', p_type FROM part WHERE p_size = 1 UNION ALL SELECT 'main', p_brand FROM part WHERE p_partkey % 100 = 0)""")
def entry_points(t: Tables) -> DataFrame:
    p = t.part
    rules = [p.filter("p_size = 50").select(F.lit("guard").alias("kind"), F.col("p_brand").alias("name")), p.filter("p_size = 1").select(F.lit("script").alias("kind"), F.col("p_type").alias("name")), p.filter("p_partkey % 100 = 0").select(F.lit("main").alias("kind"), F.col("p_brand").alias("name"))]
    return rules[0].union(rules[1]).union(rules[2]).distinct()


@query("ex5_tests_map", """SELECT DISTINCT key, test FROM (SELECT l_partkey AS key, l_suppkey AS test FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT p_partkey, p_partkey % 100 + 1 FROM part WHERE p_size < 3 UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0)""")
def tests_map(t: Tables) -> DataFrame:
    """Calls, names and imports each say which test covers what."""
    a = t.lineitem.filter("l_quantity > 49 OR l_discount = 0 AND l_tax = 0").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("test"))
    b = t.part.filter("p_size < 3").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("test"))
    return a.union(b).distinct()


@query("ex6_dead_code", """WITH called AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 40), names AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'likely' ELSE 'possible' END AS confidence FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM called) AND p_size != 50 AND p_name NOT IN (SELECT p_name FROM names)""")
def dead_code(t: Tables) -> DataFrame:
    called = t.lineitem.filter("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    shared = t.part.groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1").select("p_name")
    left = A.uncalled(t.part.filter("p_size != 50"), [(called, "p_partkey"), (shared, "p_name")])
    return left.select("p_partkey", F.when(F.col("p_brand").endswith("1"), "likely").otherwise("possible").alias("confidence"))


@query("ex9_module_summary", """SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p) AS api FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS p FROM part) WHERE p <= 12 GROUP BY p_brand""")
def module_summary(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    top = t.part.withColumn("p", place).filter("p <= 12").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p", "p_partkey"))).alias("s"))
    return top.select("p_brand", F.array_join(F.transform("s", lambda x: x["p_partkey"].cast("string")), ",").alias("api"))


@query("q33_node_detail", """SELECT p_partkey, p_name, count(l_orderkey) AS churn, count(DISTINCT l_suppkey) AS owners FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""")
def node_detail(t: Tables) -> DataFrame:
    facts = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("churn"), F.countDistinct("l_suppkey").alias("owners"))
    zero = F.lit(0).cast("long")
    return t.part.join(facts, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("churn", zero).alias("churn"), F.coalesce("owners", zero).alias("owners"))
