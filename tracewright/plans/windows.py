"""Windows: ranks, margins, islands, coverage and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import intervals as I

from .registry import Tables, query


@query("wn1_top_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def top_per_group(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.withColumn("place", place).filter("place <= 5").select("p_brand", "p_partkey", "p_retailprice")


@query("wn2_normalised_scores", "SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 9) AS score FROM part")
def normalised_scores(t: Tables) -> DataFrame:
    """By the global maximum, as a scalar subquery: a window over all rows would gather them."""
    return t.part.select("p_partkey", F.round(F.col("p_retailprice") / t.part.agg(F.max("p_retailprice")).scalar(), 9).alias("score"))


@query("wn3_first_occurrence", """WITH v AS (SELECT user_id, event_type, min((epoch_us(ts), event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS rank FROM v""")
def first_occurrence(t: Tables) -> DataFrame:
    first = F.min(F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id"))
    v = t.events.groupBy("user_id", "event_type").agg(first.alias("first"))
    return v.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).alias("rank"))


@query("wn4_cliffs", """WITH r AS (SELECT p_brand, p_retailprice, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nxt FROM part) SELECT p_brand, coalesce(bool_or(p_retailprice >= 1.02::DOUBLE * nxt), false) AS cliff FROM r GROUP BY p_brand""")
def cliffs(t: Tables) -> DataFrame:
    nxt = F.lead("p_retailprice").over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.withColumn("nxt", nxt).groupBy("p_brand").agg(F.coalesce(F.bool_or(F.col("p_retailprice") >= 1.02 * F.col("nxt")), F.lit(False)).alias("cliff"))


@query("wn5_leader_margin", """WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS p FROM part) SELECT p_brand, round(max(CASE WHEN p = 1 THEN p_retailprice END) / max(CASE WHEN p = 2 THEN p_retailprice END), 9) AS margin FROM r WHERE p <= 2 GROUP BY p_brand""")
def leader_margin(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    top = t.part.withColumn("p", place).filter("p <= 2").groupBy("p_brand")
    return top.agg(F.round(F.max(F.when(F.col("p") == 1, F.col("p_retailprice"))) / F.max(F.when(F.col("p") == 2, F.col("p_retailprice"))), 9).alias("margin"))


HITS = "hits AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000.0::DOUBLE) AS BIGINT) - 3 AS lo, CAST(floor(epoch_us(ts) / 3600000000.0::DOUBLE) AS BIGINT) + 3 AS hi FROM events WHERE value > 60)"


def _hits(t: Tables) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return t.events.filter("value > 60").select("user_id", (hour - 3).alias("lo"), (hour + 3).alias("hi"))


def _islands_sql(slack: int) -> str:
    return f"""WITH {HITS}, r AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM r)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM n GROUP BY user_id, i"""


@query("wn6_islands_with_slack", _islands_sql(5))
def islands_with_slack(t: Tables) -> DataFrame:
    return I.islands(_hits(t), ["user_id"], "lo", "hi", 5)


@query("wn8_adjacent_ranges", _islands_sql(1))
def adjacent_ranges(t: Tables) -> DataFrame:
    return I.islands(_hits(t), ["user_id"], "lo", "hi", 1)


@query("wn7_bounded_merge", f"""WITH RECURSIVE {HITS}, o AS (SELECT user_id, lo, hi, row_number() OVER (PARTITION BY user_id ORDER BY lo, hi) AS p FROM hits),
m AS (SELECT user_id, p, lo, hi, 1 AS g FROM o WHERE p = 1 UNION ALL
 SELECT o.user_id, o.p, CASE WHEN o.lo - m.hi <= 40 AND greatest(m.hi, o.hi) - m.lo + 1 <= 120 THEN m.lo ELSE o.lo END, CASE WHEN o.lo - m.hi <= 40 AND greatest(m.hi, o.hi) - m.lo + 1 <= 120 THEN greatest(m.hi, o.hi) ELSE o.hi END,
 CASE WHEN o.lo - m.hi <= 40 AND greatest(m.hi, o.hi) - m.lo + 1 <= 120 THEN g ELSE g + 1 END FROM m JOIN o ON o.user_id = m.user_id AND o.p = m.p + 1)
SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM m WHERE g <= 3 GROUP BY user_id, g""")
def bounded_merge(t: Tables) -> DataFrame:
    return I.bounded_merge(_hits(t), ["user_id"], "lo", "hi", 40, 120, 3)


@query("wn9_interval_subtraction", f"""WITH {HITS}, seen AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000.0::DOUBLE) AS BIGINT) AS h FROM events WHERE event_type = 'view'),
w AS (SELECT DISTINCT user_id, unnest(range(lo, hi + 1)) AS h FROM hits), c AS (SELECT DISTINCT user_id, unnest(range(h - 1, h + 2)) AS h FROM seen), f AS (SELECT * FROM w EXCEPT SELECT * FROM c),
g AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS i FROM f) SELECT user_id, min(h) AS lo, max(h) AS hi FROM g GROUP BY user_id, i""")
def interval_subtraction(t: Tables) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    seen = t.events.filter("event_type = 'view'").select("user_id", (hour - 1).alias("lo"), (hour + 1).alias("hi"))
    return I.subtract(_hits(t), seen, ["user_id"], "lo", "hi")


@query("wn10_context_rows", "SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'error' AND value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM events) WHERE near = 1")
def context_rows(t: Tables) -> DataFrame:
    hit = (F.col("event_type") == "error") & (F.col("value") > 30)
    return I.context(t.events, ["user_id"], "event_id", hit, 3).select("user_id", "event_id")


@query("wn11_section_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_carry(t: Tables) -> DataFrame:
    return I.carried(t.events, ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "section").select("event_id", "section")


@query("wn12_head_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE h <= 5 OR b <= 8 OR event_type = 'error'")
def head_tail(t: Tables) -> DataFrame:
    up, down = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return t.events.withColumn("h", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).filter("h <= 5 OR b <= 8 OR event_type = 'error'").select("user_id", "event_id")


@query("wn13_relative_floor", "SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM events) WHERE value >= 0.5::DOUBLE * best")
def relative_floor(t: Tables) -> DataFrame:
    return t.events.withColumn("best", F.max("value").over(Window.partitionBy("user_id"))).filter("value >= 0.5D * best").select("user_id", "event_id")


@query("sm5_ring_log", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def ring_log(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


@query("sm6_retention", "SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id")
def retention(t: Tables) -> DataFrame:
    cutoff = t.events.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar()
    return t.events.filter(F.col("ts") >= cutoff).groupBy("user_id").agg(F.count("*").alias("n"))


@query("sm9_single_active", "SELECT date_trunc('hour', ts) AS hour, CASE WHEN count(DISTINCT user_id) = 1 THEN min(user_id) END AS active FROM events GROUP BY 1")
def single_active(t: Tables) -> DataFrame:
    """The one session active in an hour, or none."""
    from tracewright.functions.times import truncated

    hours = t.events.groupBy(truncated(t.events, "ts", "hour").alias("hour"))
    return hours.agg(F.when(F.countDistinct("user_id") == 1, F.min("user_id")).alias("active"))


@query("sm14_cleanup", "SELECT o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders) WHERE p <= 8 AND s <= 900000")
def cleanup(t: Tables) -> DataFrame:
    """The newest within a number and a total size."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    kept = t.orders.withColumn("s", F.sum("o_totalprice").over(newest)).withColumn("p", F.row_number().over(newest))
    return kept.filter("p <= 8 AND s <= 900000").select("o_orderkey")


@query("q4_last_session", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts DESC, event_id) = 1")
def last_session(t: Tables) -> DataFrame:
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(priority, F.desc("ts"), "event_id"))
    return t.events.withColumn("p", place).filter("p = 1").select("user_id", "event_id")


@query("q30_saved_log", "SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 120 OR (event_type = 'error' AND value > 80)")
def saved_log(t: Tables) -> DataFrame:
    return t.events.filter("event_id BETWEEN 100 AND 120 OR (event_type = 'error' AND value > 80)").select("event_id", "user_id")


@query("q32_activity_tail", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def activity_tail(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") > t.events.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).scalar()).select("event_id")


@query("sc7_relative_age", """WITH a AS (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 1000000 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' days ago' END AS age FROM a""")
def relative_age(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.floor((t.events.agg(F.max(micros)).scalar() - micros) / 1_000_000)
    return t.events.select("event_id", S.relative_age(seconds).alias("age"))


@query("sc8_recency", "SELECT o_orderkey, CASE WHEN d <= 30 THEN 1.0::DOUBLE WHEN d <= 90 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS recency FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate) FROM orders)::DATE) AS d FROM orders)")
def recency(t: Tables) -> DataFrame:
    now = t.orders.agg(F.max("o_orderdate").cast("date")).scalar()
    return t.orders.select("o_orderkey", S.recency_step(F.datediff(now, F.col("o_orderdate").cast("date"))).alias("recency"))


@query("sc1_camel_words", r"SELECT p_partkey, array_to_string(regexp_extract_all(replace(p_name, ' ', 'X1y'), '[A-Z]?[a-z]+|[A-Z]|[0-9]+'), '|') AS words FROM part")
def camel_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(S.camel_words(F.replace("p_name", F.lit(" "), F.lit("X1y"))), "|").alias("words"))


@query("sc3_fingerprint", "SELECT doc_id, sha256(concat_ws('|', source, lang, CAST(n_chars AS VARCHAR))) AS fingerprint FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.fingerprint(F.col("source"), F.col("lang"), F.col("n_chars")).alias("fingerprint"))


@query("sc4_title_jaccard", """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE, 9) AS jaccard FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def title_jaccard(t: Tables) -> DataFrame:
    w = t.benchmark.select("item_id", S.title_words(F.col("text")).alias("s"))
    both = w.alias("a").join(w.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return both.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(S.jaccard(F.col("a.s"), F.col("b.s")), 9).alias("jaccard"))


@query("sc5_snippets", """WITH h AS (SELECT doc_id, text, strpos(text, 'token') AS pos FROM documents WHERE contains(text, 'token')), s AS (SELECT *, CAST(greatest(1, least(pos - 30, length(text) - 59)) AS BIGINT) AS b FROM h)
SELECT doc_id, (CASE WHEN b > 1 THEN '…' ELSE '' END) || substr(text, b, 60) || (CASE WHEN b + 60 <= length(text) THEN '…' ELSE '' END) AS snippet FROM s""")
def snippets(t: Tables) -> DataFrame:
    return t.documents.filter(F.contains("text", F.lit("token"))).select("doc_id", S.snippet(F.col("text"), F.instr("text", "token"), 60).alias("snippet"))


@query("sc6_strip_hidden", r"SELECT page_id, length(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS n FROM pages")
def strip_hidden(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(S.strip_hidden(F.col("html"))).cast("long").alias("n"))


@query("sc10_log_ratio", "SELECT p_partkey, round(ln(1.0::DOUBLE + p_size) / ln(1.0::DOUBLE + (SELECT max(p_size) FROM part)), 9) AS r FROM part")
def log_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(S.log_ratio(F.col("p_size"), t.part.agg(F.max("p_size")).scalar()), 9).alias("r"))


@query("sc11_half_life", "SELECT event_id, round(pow(0.5::DOUBLE, value / 10.0::DOUBLE), 9) AS w FROM events")
def half_life(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(S.half_life(F.col("value"), 10.0), 9).alias("w"))


@query("sc12_slugs", "SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS slug FROM part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("sc15_url_segments", r"SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s != ''), '|') AS segments FROM pages")
def url_segments(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(S.url_segments(F.col("url")), "|").alias("segments"))


@query("sc17_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("sc18_iso_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def iso_times(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("tk10_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.tokens_estimate(F.col("text")).alias("tokens"))
