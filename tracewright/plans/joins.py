"""Joins: neighbours, resolution chains, lifts and set memberships.  Calls are lineitems from a supplier to a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import relations as R

from .lookups import PATH, _paths
from .registry import Tables, query


@query("jn1_inbound_neighbours", """SELECT l_orderkey, l_linenumber, s_suppkey, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7 AND l_returnflag != 'A'""")
def inbound_neighbours(t: Tables) -> DataFrame:
    calls = t.lineitem.filter("l_partkey = 7 AND l_returnflag != 'A'")
    return calls.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).orderBy(F.desc("s_acctbal"), "l_orderkey").select("l_orderkey", "l_linenumber", "s_suppkey", "s_acctbal")


@query("jn2_outbound_neighbours", """SELECT l_orderkey, l_linenumber, p_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 3""")
def outbound_neighbours(t: Tables) -> DataFrame:
    calls = t.lineitem.filter("l_suppkey = 3")
    return calls.join(t.part, F.col("l_partkey") == F.col("p_partkey")).orderBy("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "p_partkey", "p_retailprice")


@query("jn4_digest_reuse", """SELECT d.doc_id, md5(d.text) AS digest, l.quality FROM documents d JOIN labels l USING (doc_id)""")
def digest_reuse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).join(t.labels.select("doc_id", "quality"), "doc_id")


@query("jn5_resolution_chain", """WITH want AS (SELECT c_custkey AS k, c_nationkey % 40 AS name FROM customer),
r0 AS (SELECT k, s_suppkey AS target FROM want JOIN supplier ON s_suppkey = name AND s_acctbal > 5000),
r1 AS (SELECT k, n_regionkey + 1000 AS target FROM want JOIN nation ON n_nationkey = name),
r2 AS (SELECT k, CAST(-1 AS BIGINT) AS target FROM want),
u AS (SELECT *, 0 AS rule FROM r0 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2)
SELECT k, target, rule FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY rule, target) = 1""")
def resolution_chain(t: Tables) -> DataFrame:
    """The first rule that knows a name decides."""
    want = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 40).alias("name"))
    rich = want.join(t.supplier.filter("s_acctbal > 5000"), F.col("s_suppkey") == F.col("name")).select("k", F.col("s_suppkey").alias("target"))
    near = want.join(t.nation, F.col("n_nationkey") == F.col("name")).select("k", (F.col("n_regionkey") + 1000).cast("long").alias("target"))
    return R.first_rule([rich, near, want.select("k", F.lit(-1).cast("long").alias("target"))], ["k"])


@query("jn7_ancestor_method", """WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey // 2 AS ancestor, 1 AS distance FROM part WHERE p_partkey > 1 UNION ALL SELECT node, ancestor // 2, distance + 1 FROM up WHERE ancestor > 1 AND distance < 6)
SELECT node, arg_min(ancestor, distance) AS owner, min(distance) AS distance FROM up JOIN part ON p_partkey = ancestor WHERE p_size > 30 GROUP BY node""")
def ancestor_method(t: Tables) -> DataFrame:
    """The nearest ancestor that defines a member, within six steps; a part's parent is half its number."""
    tree = t.part.select(F.col("p_partkey").alias("c"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("p"))
    up = R.ancestors(tree, "c", "p", 6)
    owners = t.part.filter("p_size > 30").select(F.col("p_partkey").alias("ancestor"))
    best = up.join(owners, "ancestor").groupBy("node").agg(F.min(F.struct("distance", "ancestor")).alias("m"))
    return best.select("node", F.col("m.ancestor").alias("owner"), F.col("m.distance").alias("distance"))


@query("jn8_unique_match", """SELECT o.o_orderkey, m.s_suppkey FROM orders o JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey HAVING count(*) = 1) m ON o.o_custkey % 25 = m.s_nationkey""")
def unique_match(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("s_nationkey"))
    return R.unique_match(left, t.supplier.select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey").select("o_orderkey", "s_suppkey")


@query("jn9_ambiguous_candidates", """SELECT s_nationkey, count(*) AS n, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS candidates FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""")
def ambiguous_candidates(t: Tables) -> DataFrame:
    return R.candidates(t.supplier, "s_nationkey", "s_suppkey")


@query("jn10_longest_suffix", f"""WITH names AS (SELECT replace(path, '/', '.') AS name FROM (SELECT {PATH} AS path FROM part)), packages AS (SELECT DISTINCT array_to_string(string_split(name, '.')[2:], '.') AS package FROM names WHERE name LIKE '%mod1%' UNION SELECT DISTINCT array_to_string(string_split(name, '.')[3:], '.') FROM names WHERE name LIKE '%mod2%'),
found AS (SELECT name, package, rank() OVER (PARTITION BY name ORDER BY length(package) DESC) AS place FROM names JOIN packages ON name = package OR ends_with(name, '.' || package))
SELECT name, min(package) AS package FROM found WHERE place = 1 GROUP BY name HAVING count(*) = 1""")
def longest_suffix(t: Tables) -> DataFrame:
    names = _paths(t).select(F.translate("path", "/", ".").alias("name"))
    parts = F.split("name", r"\.")
    two = names.filter(F.col("name").contains("mod1")).select(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ".").alias("package"))
    three = names.filter(F.col("name").contains("mod2")).select(F.array_join(F.slice(parts, F.lit(3), F.size(parts)), ".").alias("package"))
    return R.longest_suffix(names, "name", two.union(three).distinct(), "package")


@query("jn11_relative_imports", f"""SELECT p_partkey, CASE WHEN level = 0 THEN 'util' ELSE array_to_string(string_split(module, '.')[1:greatest(len(string_split(module, '.')) - level, 0)] || ['util'], '.') END AS target
FROM (SELECT p_partkey, CAST(p_partkey % 3 AS INTEGER) AS level, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') AS module FROM (SELECT p_partkey, {PATH} AS path FROM part))""")
def relative_imports(t: Tables) -> DataFrame:
    module = S.module_name(F.col("path"))
    return _paths(t).select("p_partkey", S.relative_import(module, F.lit(False), (F.col("p_partkey") % 3).cast("int"), F.lit("util")).alias("target"))


@query("jn12_import_edges", f"""WITH m AS (SELECT p_partkey, p_size, string_split(path, '/')[1] AS pkg, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') AS module FROM (SELECT *, {PATH} AS path FROM part)),
wanted AS (SELECT p_partkey, module AS src, pkg || '.src.mod' || (p_partkey + p_size) AS want, pkg FROM m)
SELECT w.p_partkey, CASE WHEN e.module IS NOT NULL THEN e.module WHEN k.pkg IS NOT NULL THEN w.pkg ELSE 'external' END AS target, e.module IS NULL AS fell_back
FROM wanted w LEFT JOIN m e ON e.module = w.want LEFT JOIN (SELECT DISTINCT pkg FROM m WHERE p_size > 25) k ON k.pkg = w.pkg""")
def import_edges(t: Tables) -> DataFrame:
    """An import is a module, else its package, else external."""
    m = t.part.select("p_partkey", "p_size", F.expr(PATH).alias("path")).select("p_partkey", "p_size", F.split("path", "/")[0].alias("pkg"), S.module_name(F.col("path")).alias("module"))
    wanted = m.select("p_partkey", "pkg", F.concat("pkg", F.lit(".src.mod"), (F.col("p_partkey") + F.col("p_size")).cast("string")).alias("want"))
    exact = m.select(F.col("module").alias("want"), F.col("module").alias("found"))
    packages = m.filter("p_size > 25").select("pkg", F.col("pkg").alias("known")).distinct()
    both = wanted.join(exact, "want", "left").join(packages, "pkg", "left")
    return both.select("p_partkey", F.coalesce("found", "known", F.lit("external")).alias("target"), F.col("found").isNull().alias("fell_back"))


ROUTES = [("blog_post", "/{lang}/{id}"), ("english", "/en/{id}"), ("page", "/{lang}/{id}/"), ("german_html", "/de/{name}"), ("deep", "/api/{v}/{id}")]
ROUTE_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in ROUTES)


@query("jn13_route_match", rf"""WITH routes(handler, shape) AS (VALUES {ROUTE_VALUES}),
r AS (SELECT handler, list_transform(list_filter(string_split(shape, '/'), lambda s: s != ''), lambda s: CASE WHEN s LIKE '{{%' THEN '*' ELSE s END) AS segs FROM routes),
p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s != '') AS segs FROM pages),
m AS (SELECT page_id, handler, (SELECT count(*) FROM range(1, len(p.segs) + 1) i(i) WHERE r.segs[i.i] = p.segs[i.i]) AS score FROM p JOIN r ON len(p.segs) = len(r.segs)
  WHERE (SELECT bool_and(r.segs[i.i] = '*' OR r.segs[i.i] = p.segs[i.i]) FROM range(1, len(p.segs) + 1) i(i))),
b AS (SELECT *, rank() OVER (PARTITION BY page_id ORDER BY score DESC) AS place FROM m), c AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM b WHERE place = 1)
SELECT page_id, handler, CAST(score AS INTEGER) AS score FROM c WHERE n <= 3""")
def route_match(t: Tables) -> DataFrame:
    """Requested paths against route shapes of as many segments; the most literal shapes win, if at most three tie."""
    routes = t.spark.createDataFrame(ROUTES, "handler string, shape string").select("handler", S.url_segments(F.col("shape")).alias("route"))
    pages = t.pages.select("page_id", S.url_segments(F.col("url")).alias("path"))
    both = pages.withColumn("k", F.size("path")).join(F.broadcast(routes.withColumn("k", F.size("route"))), "k")  # the route table is a constant
    fits = F.forall(F.zip_with("path", "route", lambda a, b: (b == "*") | (a == b)), lambda x: x)
    score = F.size(F.filter(F.zip_with("path", "route", lambda a, b: a == b), lambda x: x))
    best = F.rank().over(Window.partitionBy("page_id").orderBy(F.desc("score")))
    top = both.filter(fits).withColumn("score", score).withColumn("place", best).filter("place = 1")
    return top.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).filter("n <= 3").select("page_id", "handler", "score")


@query("jn14_semi_anti", """SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'tested' ELSE 'untested' END AS state FROM part""")
def semi_anti(t: Tables) -> DataFrame:
    heavy = t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    yes = t.part.join(heavy, "p_partkey", "left_semi").select("p_partkey", F.lit("tested").alias("state"))
    return yes.unionByName(t.part.join(heavy, "p_partkey", "left_anti").select("p_partkey", F.lit("untested").alias("state")))


@query("jn16_nearest_prefix", f"""WITH p AS (SELECT p_partkey, p_brand, p_size, {PATH} AS path FROM part),
pairs AS (SELECT a.p_brand, a.path AS source, b.path AS test, (string_split(a.path, '/')[1] = string_split(b.path, '/')[1])::INT + (string_split(a.path, '/')[1] = string_split(b.path, '/')[1] AND string_split(a.path, '/')[2] = string_split(b.path, '/')[2])::INT AS shared
  FROM p a JOIN p b ON a.p_brand = b.p_brand WHERE a.p_size = 1 AND b.p_size > 45)
SELECT p_brand, source, test, CAST(shared AS INTEGER) AS shared FROM pairs QUALIFY rank() OVER (PARTITION BY p_brand, source ORDER BY shared DESC) = 1""")
def nearest_prefix(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", "p_size", F.expr(PATH).alias("path"))
    left = p.filter("p_size = 1").select("p_brand", F.col("path").alias("source"))
    right = p.filter("p_size > 45").select("p_brand", F.col("path").alias("test"))
    return R.nearest_by_prefix(left, right, "p_brand", "source", "test").select("p_brand", "source", "test", "shared")


@query("jn18_edge_lift", """SELECT CAST(sn AS BIGINT) AS src, CAST(cn AS BIGINT) AS dst, count(*) AS weight FROM (SELECT s_nationkey AS sn, c_nationkey AS cn FROM (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) e
JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey) WHERE sn != cn GROUP BY ALL""")
def edge_lift(t: Tables) -> DataFrame:
    """Supplier-customer edges between nations; own loops go."""
    edges = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).distinct()
    places = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("g")).union(t.customer.select(F.concat(F.lit("c"), "c_custkey"), F.col("c_nationkey").cast("long")))
    return R.lift(edges, places, "node", "g")


@query("q17_open_counts", """SELECT key, count(*) AS n FROM (SELECT 'o' || l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY key""")
def open_counts(t: Tables) -> DataFrame:
    """Findings counted for both keys they carry, by one unpivot."""
    both = t.lineitem.filter("l_returnflag = 'R'").select(F.explode(F.array(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"))).alias("key"))
    return both.groupBy("key").agg(F.count("*").alias("n"))


@query("q18_named_targets", """WITH n AS (SELECT s_nationkey AS name, s_suppkey AS handler, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT c_custkey, handler FROM customer JOIN n ON c_nationkey = name WHERE n <= 3""")
def named_targets(t: Tables) -> DataFrame:
    named = t.supplier.withColumn("n", F.count("*").over(Window.partitionBy("s_nationkey"))).filter("n <= 3")
    return t.customer.join(named, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", F.col("s_suppkey").alias("handler"))


@query("q23_verified_read", """SELECT d.doc_id, CASE WHEN md5(d.text) = i.digest THEN length(d.text) END AS n, md5(d.text) != i.digest AS stale FROM documents d JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE md5(text) END AS digest FROM documents) i USING (doc_id)""")
def verified_read(t: Tables) -> DataFrame:
    """A text is shown only where its digest is the indexed one."""
    digest = F.md5(F.col("text").cast("binary"))
    indexed = t.documents.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(digest).alias("digest"))
    both = t.documents.join(indexed, "doc_id")
    return both.select("doc_id", F.when(digest == F.col("digest"), F.length("text").cast("long")).alias("n"), (digest != F.col("digest")).alias("stale"))


@query("q15_untouched_callers", """WITH touched AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT l_partkey, count(DISTINCT l_orderkey) AS callers FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM touched) AND l_quantity < 5 GROUP BY l_partkey""")
def untouched_callers(t: Tables) -> DataFrame:
    touched = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.filter("l_quantity < 5").join(touched, "l_orderkey", "left_anti").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("callers"))


@query("q16_changed_files", "SELECT l_partkey AS file FROM lineitem WHERE l_quantity = 1 UNION SELECT l_partkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0 UNION SELECT p_partkey FROM part WHERE p_size = 50")
def changed_files(t: Tables) -> DataFrame:
    a = t.lineitem.filter("l_quantity = 1 OR l_discount = 0 AND l_tax = 0").select(F.col("l_partkey").alias("file"))
    return a.union(t.part.filter("p_size = 50").select("p_partkey")).distinct()


@query("q36_integrity", """SELECT n_nationkey, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n < 50 THEN 'thin' ELSE 'ok' END AS state FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey""")
def integrity(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 50, "thin").otherwise("ok")
    return t.nation.join(counts, "n_nationkey", "left").select("n_nationkey", state.alias("state"))


@query("q35_tiered_lookup", f"""WITH m AS (SELECT p_partkey, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') AS module FROM (SELECT p_partkey, {PATH} AS path FROM part)), w AS (SELECT s_suppkey, 'mod' || s_suppkey AS name FROM supplier),
u AS (SELECT s_suppkey, module, 0 AS tier FROM w JOIN m ON module = name UNION ALL SELECT s_suppkey, module, 1 FROM w JOIN m ON ends_with(module, '.' || name) UNION ALL SELECT s_suppkey, module, 2 FROM w JOIN m ON ends_with(module, '_' || name)),
b AS (SELECT *, min(tier) OVER (PARTITION BY s_suppkey) AS best FROM u)
SELECT s_suppkey, min(module) AS module, min(tier) AS tier, count(*) AS matches FROM b WHERE tier = best GROUP BY s_suppkey""")
def tiered_lookup(t: Tables) -> DataFrame:
    """Exact name, else dotted suffix, else part of a name; how many match at the best tier tells ambiguity.  Last words are the join keys."""
    m = _paths(t).select(S.module_name(F.col("path")).alias("module"))
    w = t.supplier.select("s_suppkey", F.concat(F.lit("mod"), "s_suppkey").alias("name"))
    last = F.regexp_extract("module", r"([^._]+)$", 1)
    both = w.join(m.withColumn("name", last), "name")
    tier = F.when(F.col("module") == F.col("name"), 0).when(F.col("module").endswith(F.concat(F.lit("."), F.col("name"))), 1).when(F.col("module").endswith(F.concat(F.lit("_"), F.col("name"))), 2)
    ranked = both.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("best", F.min("tier").over(Window.partitionBy("s_suppkey"))).filter("tier = best")
    return ranked.groupBy("s_suppkey").agg(F.min("module").alias("module"), F.min("tier").alias("tier"), F.count("*").alias("matches"))
