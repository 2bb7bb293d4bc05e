"""Steps whose cost must follow the input: the same rows as the plain way, by plans that hold no more than they need."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracewright import session
from tracewright.operators import changes, graph, history, relations, retrieval
from tracewright.plans import graphs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index_of_asked_terms_is_that_part_of_the_whole(spark):
    texts = ["The parseHTTPResponse of load_all_rows", "running runs, runner stopped 3rd", "", None, "über Straßen getXml2Json _a_b the the", "of the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([("run",), ("load_all_row",), ("load_all_rows",), ("http",), ("nothing",), ("run",)], "term string")
    postings, docs = retrieval.index(df, "doc_id", {"text": 1.0})
    some, lengths = retrieval.asked_index(df, "doc_id", "text", terms)
    assert rows(lengths) == rows(docs)
    assert rows(some) == rows(postings.join(terms.distinct(), "term", "left_semi").select("doc_id", "term", "tf")) != []
    assert some.select(F.count("*")).first()[0] < postings.count()


def test_nearest_prefixes_make_only_the_pairs_they_give(spark):
    left = spark.createDataFrame([("g", "a/b/c"), ("g", "a/x"), ("g", "z/q"), ("h", "a/b"), ("n", "a/b"), ("g", "a/b/c")], "grp string, source string")
    right = spark.createDataFrame([("g", "a/b/d"), ("g", "a/b/c"), ("g", "a/y/x"), ("g", "ab/c"), ("h", "b"), ("h", "a/c")], "grp string, test string")
    found = relations.nearest_by_prefix(left, right, "grp", "source", "test").select("grp", "source", "test", "shared")
    want = [("g", "a/b/c", "a/b/c", 3)] * 2 + [("g", "a/x", t, 1) for t in ("a/b/c", "a/b/d", "a/y/x")] + [("g", "z/q", t, 0) for t in ("a/b/c", "a/b/d", "a/y/x", "ab/c")] + [("h", "a/b", "a/c", 1)]
    assert rows(found) == sorted(want, key=repr)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_known_findings_of_one_title_are_compared_once(spark):
    known = spark.range(3000).selectExpr("'p' AS place", "3000 - id AS id", "concat('name ', id % 2) AS title", "if(id % 3 = 0, 'fixed', 'open') AS status")
    seen = spark.createDataFrame([("p", "name 0"), ("p", "other")], "place string, title string")
    found = changes.upsert_findings(known, seen, ["place"], "title")
    assert rows(found) == sorted([(1, "name 0", "open", "updated"), (None, "other", "open", "created")], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("min(struct(id")


def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 5)
    commits = spark.createDataFrame([(s, "x", 1, f) for s in range(10) for f in range(s, s + 5)], "sha long, author string, ts long, file long")
    found = history.pair_counts(commits)
    assert found.rdd.getNumPartitions() == 20  # 100 pairs
    assert sum(r.n for r in found.collect()) == 100
    assert history.owners(commits, rows_hint=50).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("most", [1_000_000, 6])
def test_strong_components_meet_in_tasks_of_bounded_edges(spark, monkeypatch, most):
    rnd = random.Random(7)
    pairs = {(k * 100 + a, k * 100 + b) for k in range(2) for a, b in ((rnd.randrange(9 + k), rnd.randrange(9 + k)) for _ in range(14))} | {(900, 901), (901, 900), (901, 902), (902, 903), (903, 902)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    want = rows(graph.strong_components(edges, rounds=50))
    monkeypatch.setattr(graph, "EDGES_A_TASK", most)
    taken = []
    walked = graph._walked
    monkeypatch.setattr(graph, "_walked", lambda e: taken.append(e.count()) or walked(e))
    assert rows(graph.strong_components(edges)) == want != []
    assert taken


def test_trimmed_edges_are_not_looked_at_for_what_hangs_together(spark, monkeypatch):
    rings = [(k * 10 + a, k * 10 + b) for k in range(6) for a, b in ((0, 1), (1, 2), (2, 0))]
    ends = [(1000 + 50 * k + i, k * 10 + i % 3) for k in range(6) for i in range(40)] + [(k * 10, 2000 + i) for k in range(6) for i in range(9)]
    edges = spark.createDataFrame(rings + ends, "src long, dst long")
    monkeypatch.setattr(graph, "EDGES_A_TASK", 10)
    asked, found = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e: asked.append(e.count()) or found(e))
    strong = graph.strong_components(edges)
    assert rows(strong) == sorted(((k * 10 + i, k * 10) for k in range(6) for i in range(3)), key=repr)
    assert asked == [18]
    assert rows(graph.cycle_edges(edges, strong)) == sorted(rings, key=repr)


def test_strong_components_are_walked_once_however_often_read(spark):
    found = graph.strong_components(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"))
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == [(1, 1), (2, 1)]


def test_part_edges_of_many_lines_are_those_of_few(spark, monkeypatch):
    rnd = random.Random(3)
    made = [(rnd.randrange(60), rnd.choice((1, 1, 2, 3, 4, None)), rnd.choice((*range(1, 9), None))) for _ in range(400)] + [(None, 1, 1), (None, 2, 2)]
    tables = SimpleNamespace(lineitem=spark.createDataFrame(made, "l_orderkey long, l_linenumber int, l_partkey long"))
    want, made_tasks, dealt = rows(graphs.part_edges(tables)), [], session.dealt
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    monkeypatch.setattr(graphs, "ROWS_A_TASK", 50)
    monkeypatch.setattr(graphs, "dealt", lambda df, n, *keys: made_tasks.append((n, keys)) or dealt(df, n, *keys))
    assert rows(graphs.part_edges(tables)) == want != []
    assert made_tasks == [(402, ("l_orderkey", "l_linenumber"))] * 2 + [(402, ("src",))]


def test_louvain_deals_components_over_tasks_and_moves_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_MOVE", 6)
    ring = [(0, 1), (1, 2), (2, 0), (10, 11), (11, 12), (12, 10), (2, 10)]
    edges = spark.createDataFrame([(a + 100 * k, b + 100 * k, 1.0) for k in range(12) for a, b in ring], "src long, dst long, weight double")
    found = graph.louvain(edges)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 72 and found.select("community").distinct().count() == 12
    dealt = []
    kept = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: dealt.append(kept(df)) or dealt[-1])
    assert rows(graph.louvain(edges)) == rows(found)
    assert dealt[-1].rdd.getNumPartitions() == 14  # 84 edges


def test_scores_are_summed_without_shuffling_hits(spark, monkeypatch):
    postings = spark.createDataFrame([(d, w, float(1 + d % 3)) for d in range(20) for w in ("a", "b", "c")[: 1 + d % 3]], "doc long, term string, tf double")
    docs = postings.groupBy("doc").agg(F.sum("tf").alias("length"))
    terms = spark.createDataFrame([(q, w) for q in range(5) for w in ("a", "c", "x")[: 1 + q % 3]], "q long, term string")
    found = retrieval.bm25_scores(postings, docs, "doc", terms, "q").withColumn("score", F.round("score", 9))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q" not in plan  # pairs of request and document stay where the document is
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    assert rows(found) == rows(retrieval.bm25_scores(postings, docs, "doc", terms, "q").withColumn("score", F.round("score", 9))) != []
