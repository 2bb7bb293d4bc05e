"""Graph queries.  Edges lead from a part to the two parts that are on an order's next line most often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import graph as G
from tracewright.session import ROWS_A_TASK, checkpointed, dealt

from .registry import Tables, query

EDGES = """nexts AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey != b.l_partkey GROUP BY ALL),
edges AS (SELECT src, dst FROM nexts QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst * 7919 % 10007, dst) <= 2)"""


def part_edges(t: Tables) -> DataFrame:
    lines, at = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"]
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    rows = lines.count()
    if rows > ROWS_A_TASK:
        # tasks of bounded rows need no sort to be joined
        lines, nxt = dealt(lines, rows, *at).hint("shuffle_hash"), dealt(nxt, rows, *at)
    pairs = lines.join(nxt, at).select(F.col("l_partkey").alias("src"), "dst").filter("src != dst")
    if rows > ROWS_A_TASK:
        # pairs of a part meet once, to be counted and to be ranked
        pairs = dealt(pairs, rows, "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), F.expr("dst * 7919 % 10007"), "dst"))
    return checkpointed(pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("p", place).filter("p <= 2").select("src", "dst"))


def _seeds(t: Tables, which: str = "p_partkey <= 3") -> DataFrame:
    return t.part.filter(which).select(F.col("p_partkey").alias("node"))


def _pagerank_sql(steps: int) -> str:
    ctes = [EDGES, "nodes AS (SELECT p_partkey AS node FROM part)", "n AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src)", "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for k in range(1, steps + 1):
        ctes.append(
            f"r{k} AS (SELECT node, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM outs)) / n + 0.85::DOUBLE * coalesce(g, 0) AS rank "
            f"FROM nodes LEFT JOIN (SELECT dst, sum(rank / o) AS g FROM edges JOIN outs USING (src) JOIN r{k - 1} ON node = src GROUP BY dst) ON dst = node, n)"
        )
    return f"WITH {', '.join(ctes)} SELECT node, round(rank, 9) AS rank FROM r{steps}"


@query("g1_pagerank", _pagerank_sql(5))
def pagerank(t: Tables) -> DataFrame:
    return G.pagerank(t.part.select("p_partkey"), part_edges(t), iterations=5, digits=9)


@query("g2_lazy_pagerank", _pagerank_sql(5))
def lazy_pagerank(t: Tables) -> DataFrame:
    """The same edges again: the old ranks are kept."""
    edges, nodes = part_edges(t), t.part.select(F.col("p_partkey").alias("node"))
    return G.lazy_ranks(G.pagerank(nodes, edges, iterations=5, digits=9), edges, nodes, edges, iterations=5, digits=9)


@query("g3_louvain")
def louvain(t: Tables) -> DataFrame:
    return G.louvain(part_edges(t).withColumn("weight", F.lit(1.0)))


REVERSE = """walk AS (SELECT p_partkey AS node, 0 AS d FROM part WHERE p_partkey <= 3 UNION SELECT e.src, d + 1 FROM walk JOIN edges e ON e.dst = walk.node WHERE d < 3)"""


@query("g4_reverse_bfs", f"WITH RECURSIVE {EDGES}, {REVERSE} SELECT node, min(d) AS distance FROM walk GROUP BY node HAVING min(d) > 0")
def reverse_bfs(t: Tables) -> DataFrame:
    return G.reverse_reached(_seeds(t), part_edges(t), 3)


@query("g5_dependents", f"WITH RECURSIVE {EDGES}, {REVERSE}, m AS (SELECT node, min(d) AS d FROM walk GROUP BY node HAVING min(d) > 0) SELECT p_brand AS file, min(d) AS distance FROM m JOIN part ON p_partkey = node GROUP BY p_brand")
def dependents(t: Tables) -> DataFrame:
    """Dependents lifted to the coarser level by least distance."""
    found = G.reverse_reached(_seeds(t), part_edges(t), 3)
    return found.join(t.part, F.col("node") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("file")).agg(F.min("distance").alias("distance"))


@query("g6_impact_levels", f"WITH RECURSIVE {EDGES}, {REVERSE}, m AS (SELECT node, min(d) AS d FROM walk GROUP BY node HAVING min(d) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY node) AS p, count(*) OVER (PARTITION BY d) AS n FROM m) SELECT d AS distance, node, greatest(n - 15, 0) AS omitted FROM r WHERE p <= 15")
def impact_levels(t: Tables) -> DataFrame:
    found = G.reverse_reached(_seeds(t), part_edges(t), 3)
    by = Window.partitionBy("distance")
    ranked = found.withColumn("p", F.row_number().over(by.orderBy("node"))).withColumn("n", F.count("*").over(by))
    return ranked.filter("p <= 15").select("distance", "node", F.greatest(F.col("n") - 15, F.lit(0)).alias("omitted"))


@query("g7_shortest_paths", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT p_partkey AS node, 0 AS d, [p_partkey] AS path FROM part WHERE p_partkey = 1 UNION ALL SELECT e.dst, d + 1, list_append(path, e.dst) FROM walk JOIN edges e ON e.src = walk.node WHERE d < 3),
m AS (SELECT node, min(d) AS d FROM walk GROUP BY node) SELECT w.node, w.d AS distance, array_to_string(min(path), '>') AS path FROM walk w JOIN m ON m.node = w.node AND m.d = w.d WHERE w.d > 0 GROUP BY ALL""")
def shortest_paths(t: Tables) -> DataFrame:
    found = G.shortest_paths(_seeds(t, "p_partkey = 1"), part_edges(t), 3)
    return found.select("node", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g9_bounded_walk")
def bounded_walk(t: Tables) -> DataFrame:
    return G.bounded_walk(_seeds(t), part_edges(t))


@query("g10_neighbourhood", f"WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT p_partkey AS node, 0 AS d FROM part WHERE p_partkey = 1 UNION SELECT u.dst, d + 1 FROM walk JOIN u ON u.src = walk.node WHERE d < 2) SELECT node, min(d) AS distance FROM walk GROUP BY node HAVING min(d) > 0")
def neighbourhood(t: Tables) -> DataFrame:
    return G.reached(_seeds(t, "p_partkey = 1"), G.both_ways(part_edges(t)), 2)


REACH = "reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b)"
STRONG = "strong AS (SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a != x.b GROUP BY x.a)"


@query("g11_strong_components", f"WITH RECURSIVE {EDGES}, {REACH}, {STRONG} SELECT node, component FROM strong")
def strong_components(t: Tables) -> DataFrame:
    return G.strong_components(part_edges(t))


@query("g12_cycle_edges", f"WITH RECURSIVE {EDGES}, {REACH}, {STRONG} SELECT src, dst FROM edges JOIN strong x ON x.node = src JOIN strong y ON y.node = dst WHERE x.component = y.component")
def cycle_edges(t: Tables) -> DataFrame:
    edges = part_edges(t)
    return G.cycle_edges(edges, G.strong_components(edges))


@query("g13_tiers")
def tiers(t: Tables) -> DataFrame:
    edges = part_edges(t)
    return G.tiers(edges, G.strong_components(edges))


@query("g14_layer_view", f"""WITH {EDGES}, l AS (SELECT a.p_brand AS src, b.p_brand AS dst, count(*) AS weight FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand != b.p_brand GROUP BY ALL),
d AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM l UNION ALL SELECT dst, 1, 0 FROM l) GROUP BY node) SELECT node, fan_in, fan_out FROM d""")
def layer_view(t: Tables) -> DataFrame:
    """The graph at its coarser level, with degrees."""
    from tracewright.operators import relations as R
    from tracewright.operators import scores as A

    return A.degrees(R.lift(part_edges(t), t.part.select("p_partkey", "p_brand"), "p_partkey", "p_brand"))


@query("g15_route_graph", """SELECT DISTINCT 'host:' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS src, 'path:' || href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""")
def route_graph(t: Tables) -> DataFrame:
    links = t.pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("h"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("p"))
    return links.select(F.concat(F.lit("host:"), "h").alias("src"), F.concat(F.lit("path:"), "p").alias("dst")).distinct()


@query("g16_thin_delegation", f"""WITH RECURSIVE {EDGES}, thin AS (SELECT p_partkey AS node FROM part WHERE p_size <= 25), f AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS p FROM edges) WHERE p <= 3),
walk AS (SELECT node, 0 AS d FROM thin UNION SELECT f.dst, d + 1 FROM walk JOIN f ON f.src = walk.node WHERE d < 3 AND walk.node IN (SELECT node FROM thin)) SELECT node, min(d) AS distance FROM walk GROUP BY node HAVING min(d) > 0""")
def thin_delegation(t: Tables) -> DataFrame:
    """Through thin wrappers only, three calls each, three hops."""
    thin = t.part.filter("p_size <= 25").select(F.col("p_partkey").alias("node"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    calls = part_edges(t).withColumn("p", place).filter("p <= 3").join(thin.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
    return G.reached(thin, calls, 3)


@query("g17_reinforcement", f"""WITH {EDGES}, s AS (SELECT p_partkey AS node, p_retailprice AS score FROM part WHERE p_partkey IN (SELECT src FROM edges) ORDER BY score DESC, node LIMIT 14), u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
g AS (SELECT src, sum(score) AS g FROM (SELECT u.src, s.score, row_number() OVER (PARTITION BY u.src ORDER BY s.score DESC, u.dst) AS p FROM u JOIN s ON s.node = u.dst) WHERE p <= 3 GROUP BY src)
SELECT node, round(score + 0.25::DOUBLE * coalesce(g, 0), 6) AS score FROM s LEFT JOIN g ON g.src = node""")
def reinforcement(t: Tables) -> DataFrame:
    edges = part_edges(t)
    blocks = t.part.join(edges.select(F.col("src").alias("p_partkey")).distinct(), "p_partkey", "left_semi").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"))
    return G.reinforce(blocks, edges).select("node", F.round("score", 6).alias("score"))


@query("g18_second_order", f"WITH {EDGES}, one AS (SELECT DISTINCT src FROM edges WHERE dst IN (SELECT p_partkey FROM part WHERE p_size = 1)) SELECT DISTINCT e.src AS node FROM edges e WHERE e.dst IN (SELECT src FROM one) AND e.src NOT IN (SELECT src FROM one)")
def second_order(t: Tables) -> DataFrame:
    edges = part_edges(t)
    changed = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("dst"))
    one = edges.join(changed, "dst", "left_semi").select("src").distinct()
    two = edges.join(one.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src").distinct()
    return two.join(one, "src", "left_anti").select(F.col("src").alias("node"))


@query("ag16_blast", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT DISTINCT dst AS seed, dst AS node, 0 AS d FROM edges UNION SELECT seed, e.src, d + 1 FROM walk JOIN edges e ON e.dst = walk.node WHERE d < 3),
m AS (SELECT seed, node, min(d) AS d FROM walk GROUP BY ALL HAVING min(d) > 0 AND seed != node), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY d, node) AS p FROM m)
SELECT seed, count(*) AS count, string_agg(CASE WHEN p <= 5 THEN CAST(node AS VARCHAR) END, ',' ORDER BY p) AS top FROM r GROUP BY seed""")
def blast(t: Tables) -> DataFrame:
    edges = part_edges(t)
    return G.blast(edges.select("dst"), edges, 3)


@query("g19_test_selection", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS d UNION SELECT e.src, d + 1 FROM walk JOIN edges e ON e.dst = walk.node WHERE d < 3), m AS (SELECT node, min(d) AS d FROM walk GROUP BY node HAVING min(d) > 0),
c AS (SELECT node, 0 AS tier, d FROM m WHERE node % 3 = 0 UNION ALL SELECT p_partkey, 1, 0 FROM part WHERE p_size = 1 AND p_partkey % 3 = 0), u AS (SELECT node, min(tier) AS tier, arg_min(d, tier) AS d FROM c GROUP BY node)
SELECT node, tier FROM u ORDER BY tier, d, node LIMIT 10""")
def test_selection(t: Tables) -> DataFrame:
    """Tests among the callers, the nearest first, then tests by name."""
    near = G.reverse_reached(t.part.filter("p_partkey = 5").select("p_partkey"), part_edges(t), 3).filter("node % 3 = 0").select("node", F.lit(0).alias("tier"), F.col("distance").alias("d"))
    named = t.part.filter("p_size = 1 AND p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), F.lit(1).alias("tier"), F.lit(0).alias("d"))
    best = near.unionByName(named).groupBy("node").agg(F.min(F.struct("tier", "d")).alias("m"))
    return best.select("node", "m.tier", "m.d").orderBy("tier", "d", "node").limit(10).select("node", "tier")


@query("q34_rings", f"WITH RECURSIVE {EDGES}, {REVERSE}, m AS (SELECT node, min(d) AS d FROM walk GROUP BY node HAVING min(d) > 0) SELECT p_type AS place, min(d) AS ring, count(*) AS nodes FROM m JOIN part ON p_partkey = node GROUP BY p_type")
def rings(t: Tables) -> DataFrame:
    found = G.reverse_reached(_seeds(t), part_edges(t), 3).join(t.part, F.col("node") == F.col("p_partkey"))
    return found.groupBy(F.col("p_type").alias("place")).agg(F.min("distance").alias("ring"), F.count("*").alias("nodes"))


@query("flt10_node_filters", f"""WITH {EDGES} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges) AND p_retailprice / (SELECT max(p_retailprice) FROM part) >= 0.5::DOUBLE AND p_type != (SELECT min(p_type) FROM part)""")
def node_filters(t: Tables) -> DataFrame:
    """Nodes that no edge leads to, of enough rank and another kind."""
    ends = part_edges(t).select(F.col("dst").alias("p_partkey")).distinct()
    most = t.part.agg(F.max("p_retailprice")).scalar()
    return t.part.join(ends, "p_partkey", "left_anti").filter((F.col("p_retailprice") / most >= 0.5) & (F.col("p_type") != t.part.agg(F.min("p_type")).scalar())).select("p_partkey")
