"""Set operations, diffs, drift and findings.  Snapshots are orders before and after a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import changes as C
from tracewright.operators import incremental as N

from .registry import Tables, query

OLD = "old AS (SELECT o_orderkey AS key, o_orderstatus AS digest FROM orders WHERE o_orderkey % 10 != 0)"
NEW = "new AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS digest FROM orders WHERE o_orderkey % 11 != 0)"


def _old(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 10 != 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("digest"))


def _new(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 11 != 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus")).alias("digest"))


@query("st1_snapshot_changes", f"WITH {OLD}, {NEW} SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.key = n.key WHERE o.digest IS DISTINCT FROM n.digest")
def snapshot_changes(t: Tables) -> DataFrame:
    return N.changes(_old(t), _new(t), "key", "digest")


@query("st2_multiset_difference", "SELECT l_suppkey, l_returnflag FROM (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <= 3) EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber > 3")
def multiset_difference(t: Tables) -> DataFrame:
    a = t.lineitem.filter("l_linenumber <= 3").select("l_suppkey", "l_returnflag")
    gone, _ = N.multiset_delta(a, t.lineitem.filter("l_linenumber > 3").select("l_suppkey", "l_returnflag"))
    return gone


@query("st3_symmetric_difference", f"WITH {OLD}, {NEW} SELECT count(*) AS changed FROM ((SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL (SELECT * FROM new EXCEPT ALL SELECT * FROM old))")
def symmetric_difference(t: Tables) -> DataFrame:
    gone, came = N.multiset_delta(_old(t), _new(t))
    return gone.unionAll(came).agg(F.count("*").alias("changed"))


@query("st5_corpus_union", "SELECT lang AS term FROM documents UNION SELECT role FROM conversations")
def corpus_union(t: Tables) -> DataFrame:
    return t.documents.select(F.col("lang").alias("term")).union(t.conversations.select("role")).distinct()


FACTS = """SELECT 'brand' AS kind, p_brand AS key, CAST(count(*) AS VARCHAR) AS value FROM part WHERE {0} GROUP BY p_brand UNION ALL SELECT 'type', p_type, CAST(max(p_size) AS VARCHAR) FROM part WHERE {0} GROUP BY p_type
UNION ALL SELECT 'top', CAST(p_partkey AS VARCHAR), '1' FROM (SELECT p_partkey FROM part WHERE {0} ORDER BY p_retailprice DESC, p_partkey LIMIT 20)"""


def _facts(parts: DataFrame) -> DataFrame:
    brands = parts.groupBy(F.lit("brand").alias("kind"), F.col("p_brand").alias("key")).agg(F.count("*").cast("string").alias("value"))
    types = parts.groupBy(F.lit("type").alias("kind"), F.col("p_type").alias("key")).agg(F.max("p_size").cast("string").alias("value"))
    top = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select(F.lit("top").alias("kind"), F.col("p_partkey").cast("string").alias("key"), F.lit("1").alias("value"))
    return brands.unionByName(types).unionByName(top)


@query("st6_snapshot_facts", FACTS.format("true"))
def snapshot_facts(t: Tables) -> DataFrame:
    return _facts(t.part)


@query("st7_structural_diff", f"""WITH a AS ({FACTS.format('p_partkey % 9 != 0')}), b AS ({FACTS.format('p_partkey % 7 != 0')})
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.kind = b.kind AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def structural_diff(t: Tables) -> DataFrame:
    return C.facts_diff(_facts(t.part.filter("p_partkey % 9 != 0")), _facts(t.part.filter("p_partkey % 7 != 0")))


@query("st7_renames", """WITH r AS (SELECT p_brand, p_type, p_name AS old, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) AS p FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part WHERE p_partkey % 9 = 0)), a AS (SELECT p_brand, p_type, p_name AS new, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) AS p FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part WHERE p_partkey % 7 = 0)) SELECT old, new FROM r JOIN a USING (p_brand, p_type, p)""")
def renames(t: Tables) -> DataFrame:
    cols = ["p_brand", "p_type", "p_name"]
    return C.renames(t.part.filter("p_partkey % 9 = 0").select(*cols).distinct(), t.part.filter("p_partkey % 7 = 0").select(*cols).distinct(), ["p_brand", "p_type"], "p_name")


@query("st8_drift", """WITH c AS (SELECT p_brand AS section, CASE WHEN p_size > 40 THEN 'import_edge' ELSE 'public_added' END AS kind, p_name || p_partkey AS description, CASE WHEN p_size > 40 THEN 1 ELSE 2 END AS weight FROM part WHERE p_partkey % 13 = 0),
w AS (SELECT section, CASE WHEN kind = 'import_edge' AND row_number() OVER (PARTITION BY section, kind ORDER BY description) > 5 THEN 0 ELSE weight END AS score FROM c), p AS (SELECT DISTINCT p_brand AS section, 3 AS score FROM part WHERE p_size = 1)
SELECT section, CAST(sum(score) AS BIGINT) AS score, sum(score) >= 8 AS stale FROM (SELECT * FROM w UNION ALL SELECT * FROM p) GROUP BY section""")
def drift(t: Tables) -> DataFrame:
    edge = F.col("p_size") > 40
    found = t.part.filter("p_partkey % 13 = 0").select(F.col("p_brand").alias("section"), F.when(edge, "import_edge").otherwise("public_added").alias("kind"), F.concat("p_name", "p_partkey").alias("description"), F.when(edge, 1).otherwise(2).alias("weight"))
    before = t.part.filter("p_size = 1").select(F.col("p_brand").alias("section"), F.lit(3).alias("score")).distinct()
    return C.drift(before, found)


TITLE = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2))"


@query("st9_finding_upsert", f"""WITH k AS (SELECT p_brand, p_type, p_partkey AS id, p_name AS was, CASE WHEN p_partkey % 2 = 0 THEN 'fixed' ELSE 'open' END AS status FROM part WHERE p_size <= 30), s AS (SELECT DISTINCT p_brand, p_type, p_name AS now FROM part WHERE p_size >= 20),
m AS (SELECT s.*, k.id, k.status FROM s JOIN k USING (p_brand, p_type) WHERE len(list_intersect({TITLE.format('was')}, {TITLE.format('now')}))::DOUBLE / len(list_distinct({TITLE.format('was')} || {TITLE.format('now')})) >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY s.p_brand, s.p_type, s.now ORDER BY id) = 1)
SELECT id, now AS title, CASE WHEN status = 'fixed' THEN 'open' ELSE status END AS status, CASE WHEN status = 'fixed' THEN 'reopened' ELSE 'updated' END AS result FROM m
UNION ALL SELECT CAST(NULL AS BIGINT), now, 'open', 'created' FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.p_brand = s.p_brand AND m.p_type = s.p_type AND m.now = s.now)""")
def finding_upsert(t: Tables) -> DataFrame:
    known = t.part.filter("p_size <= 30").select("p_brand", "p_type", F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "fixed").otherwise("open").alias("status"))
    return C.upsert_findings(known, t.part.filter("p_size >= 20"), ["p_brand", "p_type"], "p_name")


@query("st10_report_diff", "WITH a AS (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id % 3 != 0), b AS (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id % 4 != 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'fixed' ELSE 'persisting' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def report_diff(t: Tables) -> DataFrame:
    bad = t.labels.filter("quality = 0")
    return C.report_diff(bad.filter("doc_id % 3 != 0"), bad.filter("doc_id % 4 != 0"), "doc_id")


@query("st12_subsumption", "WITH g AS (SELECT DISTINCT p_name AS n, p_brand AS m FROM part), s AS (SELECT n, count(*) AS size FROM g GROUP BY n), k AS (SELECT x.n, y.n AS other, count(*) AS k FROM g x JOIN g y ON x.m = y.m AND x.n != y.n GROUP BY ALL) SELECT DISTINCT k.n AS p_name FROM k JOIN s ON s.n = k.n JOIN s o ON o.n = k.other WHERE k.k = s.size AND o.size > s.size")
def subsumption(t: Tables) -> DataFrame:
    return C.subsumed(t.part, "p_name", "p_brand")


@query("q6_decision_validity", "SELECT doc_id, CASE WHEN quality = 0 THEN 'inactive' WHEN toxic = 1 THEN 'unverified' WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'current' END AS state FROM labels")
def decision_validity(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", C.decision_state(F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 4 == 0).alias("state"))


@query("q7_decision_supersede", "WITH m AS (SELECT max(doc_id) + 1 AS id FROM labels) SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM labels) THEN 'superseded by ' || (SELECT id FROM m) ELSE 'accepted' END AS status FROM labels UNION ALL SELECT id, 'accepted' FROM m")
def decision_supersede(t: Tables) -> DataFrame:
    """A new decision takes the next number and supersedes the first."""
    edges = t.labels.agg(F.min("doc_id").alias("first"), (F.max("doc_id") + 1).alias("id"))
    first, new = edges.select("first").scalar(), edges.select("id").scalar()
    marked = t.labels.select("doc_id", F.when(F.col("doc_id") == first, F.concat(F.lit("superseded by "), new.cast("string"))).otherwise("accepted").alias("status"))
    return marked.unionByName(edges.select(F.col("id").alias("doc_id"), F.lit("accepted").alias("status")))


@query("q27_status_machine", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'fixed' WHEN doc_id % 6 = 1 THEN 'wontfix' ELSE 'open' END AS status, CASE WHEN doc_id % 6 = 0 THEN 'open>fixed' WHEN doc_id % 6 = 1 THEN 'open>wontfix' ELSE 'open' END AS history FROM labels")
def status_machine(t: Tables) -> DataFrame:
    base = t.labels.select("doc_id", F.lit("open").alias("status"), F.lit("open").alias("history"))
    r = F.col("doc_id") % 6
    updates = t.labels.select("doc_id", F.when(r == 0, "fixed").when(r == 1, "wontfix").when(r == 2, "nonsense").alias("status"))
    return C.with_status(base, updates, "doc_id")


@query("q24_pending_files", f"WITH {OLD}, {NEW} SELECT count(*) AS pending FROM old o FULL JOIN new n ON o.key = n.key WHERE o.digest IS DISTINCT FROM n.digest")
def pending_files(t: Tables) -> DataFrame:
    return N.changes(_old(t), _new(t), "key", "digest").agg(F.count("*").alias("pending"))


@query("q25_corpus_revision")
def corpus_revision(t: Tables) -> DataFrame:
    return N.corpus_revision(t.documents, "doc_id", "text")


@query("sm4_incremental_update", "SELECT o_orderkey AS key, o_orderstatus AS digest, length(o_orderpriority) AS parsed FROM orders WHERE o_orderkey % 11 != 0")
def incremental_update(t: Tables) -> DataFrame:
    """Parsed rows of unchanged keys are reused; the result is what parsing all anew would give."""
    def parse(df: DataFrame) -> DataFrame:
        return df.select("key", "digest", F.length("p").cast("long").alias("parsed"))

    full = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("digest"), F.col("o_orderpriority").alias("p"))
    return N.update(parse(full.filter("key % 10 != 0")), full.filter("key % 11 != 0"), ["key", "digest"], parse)


@query("sm10_freshness_gate", f"WITH {OLD}, {NEW}, c AS (SELECT count(*) AS n FROM old o FULL JOIN new n ON o.key = n.key WHERE o.digest IS DISTINCT FROM n.digest) SELECT n AS changed, n > 300 AS limited FROM c")
def freshness_gate(t: Tables) -> DataFrame:
    return N.changes(_old(t), _new(t), "key", "digest").agg(F.count("*").alias("changed")).withColumn("limited", F.col("changed") > 300)


@query("sm17_refresh_queue", "SELECT p_brand AS section, count(*) AS fan_in, CAST(sum(p_size) AS BIGINT) AS score FROM part WHERE p_size > 20 GROUP BY p_brand HAVING sum(p_size) > 100 ORDER BY fan_in DESC, score DESC, section LIMIT 10")
def refresh_queue(t: Tables) -> DataFrame:
    stale = t.part.filter("p_size > 20").groupBy(F.col("p_brand").alias("section")).agg(F.count("*").alias("fan_in"), F.sum("p_size").alias("score")).filter("score > 100")
    return stale.orderBy(F.desc("fan_in"), F.desc("score"), "section").limit(10)


@query("g20_changed_impact", "WITH changed AS (SELECT p_partkey FROM part WHERE p_size >= 45), r AS (SELECT p.p_partkey, concat_ws(',', CASE WHEN p_size = 50 THEN 'very complex' END, CASE WHEN n > 30 THEN 'many callers' END, CASE WHEN p_retailprice > 1500 THEN 'central' END) AS reasons FROM part p JOIN changed USING (p_partkey) LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL) c ON c.l_partkey = p.p_partkey) SELECT p_partkey, reasons FROM r")
def changed_impact(t: Tables) -> DataFrame:
    callers = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n"))
    both = t.part.filter("p_size >= 45").join(callers, "p_partkey", "left")
    reasons = F.concat_ws(",", F.when(F.col("p_size") == 50, "very complex"), F.when(F.col("n") > 30, "many callers"), F.when(F.col("p_retailprice") > 1500, "central"))
    return both.select("p_partkey", reasons.alias("reasons"))


@query("q3_related_history", "SELECT user_id, event_id FROM events WHERE event_type IN ('purchase', 'signup') AND user_id IN (SELECT user_id FROM events WHERE value > 90) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 2")
def related_history(t: Tables) -> DataFrame:
    touched = t.events.filter("value > 90").select("user_id")
    kept = t.events.filter("event_type IN ('purchase', 'signup')").join(touched, "user_id", "left_semi")
    return kept.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).filter("p <= 2").select("user_id", "event_id")


@query("ir29_session_recall", r"WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{4,}')) AS w FROM benchmark), s AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{4,}')) AS w FROM conversations) SELECT item_id, conv_id, count(*) AS overlap FROM s JOIN q USING (w) GROUP BY item_id, conv_id QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, conv_id DESC) <= 10")
def session_recall(t: Tables) -> DataFrame:
    """For each request the ten sessions that share most words with it."""
    def words(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("w")).distinct()

    found = words(t.conversations, "conv_id").join(words(t.benchmark, "item_id"), "w").groupBy("item_id", "conv_id").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), F.desc("conv_id")))
    return found.withColumn("p", place).filter("p <= 10").drop("p")
