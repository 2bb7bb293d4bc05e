"""Properties of operators on small inputs."""

import random

import pytest

from tracewright.operators import changes, graph, incremental, intervals, selection


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def strong_by_hand(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    out = {}
    for n, seen in reach.items():
        ring = {m for m in seen if n in reach.get(m, ())} | ({n} if n in seen else set())
        if len(ring - {n}) > 0:
            out[n] = min(ring | {n})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_tiers(spark, seed):
    rnd = random.Random(seed)
    pairs = [(a, b) for a, b in {(rnd.randrange(25), rnd.randrange(25)) for _ in range(38)} if a != b]
    edges = edges_of(spark, pairs)
    strong = graph.strong_components(edges)
    assert {r.node: r.component for r in strong.collect()} == strong_by_hand(pairs)
    tiers = {r.node: r.tier for r in graph.tiers(edges, strong).collect()}
    comp = strong_by_hand(pairs)
    for a, b in pairs:
        same = comp.get(a, a) == comp.get(b, b)
        assert tiers[a] == tiers[b] if same else tiers[a] > tiers[b]


def test_loops_go_to_their_end_or_raise(spark):
    rings = [(a + i, a + (i + 1) % 2) for a in (0, 2, 4) for i in (0, 1)] + [(1, 2), (3, 4)]
    edges = edges_of(spark, rings)
    assert {r.node: r.component for r in graph.strong_components(edges).collect()} == strong_by_hand(rings)
    with pytest.raises(RuntimeError, match="left after 1 round"):
        graph.strong_components(edges, rounds=1)
    path = edges_of(spark, [(n, n + 1) for n in range(103)])
    none = spark.createDataFrame([], "node long, component long")
    assert {r.node: r.tier for r in graph.tiers(path, none).collect()} == {n: 103 - n for n in range(104)}
    with pytest.raises(RuntimeError, match="still rise"):
        graph.tiers(path, none, rounds=3)


def test_pagerank_sums_to_one_whatever_the_order(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(40)]
    nodes = spark.createDataFrame([(n,) for n in range(12)], "node long")
    ranks = [{r.node: r["rank"] for r in graph.pagerank(nodes, edges_of(spark, p), iterations=40).collect()} for p in (pairs, pairs[::-1])]
    assert ranks[0] == ranks[1]
    assert abs(sum(ranks[0].values()) - 1) < 1e-4


def test_louvain_splits_two_rings(spark):
    ring = [(0, 1), (1, 2), (2, 0), (10, 11), (11, 12), (12, 10), (2, 10)]
    got = {r.node: r.community for r in graph.louvain(spark.createDataFrame([(a, b, 1.0) for a, b in ring], "src long, dst long, weight double")).collect()}
    assert got[0] == got[1] == got[2] != got[10] == got[11] == got[12]


def test_components(spark):
    got = {r.node: r.component for r in graph.components(edges_of(spark, [(1, 2), (2, 3), (7, 8), (9, 8), (20, 3)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("seed", [5, 6])
def test_interval_subtraction_is_set_difference(spark, seed):
    rnd = random.Random(seed)

    def some(n):
        return [(k, lo, lo + rnd.randrange(8)) for k in "ab" for lo in (rnd.randrange(60) for _ in range(n))]

    want, seen = some(6), some(5)
    got = intervals.subtract(spark.createDataFrame(want, "k string, lo long, hi long"), spark.createDataFrame(seen, "k string, lo long, hi long"), ["k"], "lo", "hi").collect()
    points = {(k, x) for k, a, b in want for x in range(a, b + 1)} - {(k, x) for k, a, b in seen for x in range(a, b + 1)}
    assert {(r.k, x) for r in got for x in range(r.lo, r.hi + 1)} == points


def test_knapsack_beats_greedy(spark):
    rows = [("q", 1, "f", 6, 10.0), ("q", 2, "f", 5, 9.0), ("q", 3, "g", 5, 9.0)]
    df = spark.createDataFrame(rows, "q string, item long, file string, cost int, score double")
    assert {r.item for r in selection.knapsack(df, "q", "item", "file", "cost", "score", 10).collect()} == {2, 3}
    assert {r.item for r in selection.greedy_fit(df, ["q"], "item", "cost", "score", 10).collect()} == {1}


def test_greedy_fit_tries_every_item(spark):
    rnd = random.Random(7)
    rows = [(q, i, rnd.randrange(2, 40), rnd.random()) for q in range(3) for i in range(5000)] + [(3, 1, 500, 1.0), (3, 2, None, 1.0), (3, 3, 0, 0.5)]
    rows += [(4, i, 90, 1.0) for i in range(4000)] + [(4, 9999, 10, 0.1)]
    got = {}
    for r in selection.greedy_fit(spark.createDataFrame(rows, "q int, item int, cost int, score double"), ["q"], "item", "cost", "score", 100).collect():
        got.setdefault(r.q, {})[r.item] = r.used
    for q in range(5):
        used, want = 0, {}
        for _, i, c, s in sorted((r for r in rows if r[0] == q and r[2] is not None), key=lambda r: (-r[3], r[1])):
            if used + c <= 100:
                used += c
                want[i] = used
        assert got[q] == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_updates_equal_a_full_build(spark, seed):
    rnd = random.Random(seed)

    def derive(df):
        return df.selectExpr("k", "v", "v * 2 AS parsed")

    source = {k: rnd.randrange(9) for k in range(20)}
    frame = lambda s: spark.createDataFrame(list(s.items()), "k long, v long")
    state = derive(frame(source))
    for _ in range(3):
        for k in rnd.sample(range(25), 6):
            source[k] = rnd.randrange(9)
        source.pop(rnd.choice(list(source)))
        state = incremental.update(state, frame(source), ["k", "v"], derive)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, derive(frame(source)).collect()))


def test_generations(spark, tmp_path):
    incremental.publish(spark, {"t": spark.range(3)}, str(tmp_path))
    incremental.publish(spark, {"t": spark.range(5)}, str(tmp_path))
    assert incremental.current(spark, str(tmp_path), "t").count() == 5


def test_corpus_revision_ignores_order(spark):
    a = spark.range(50).selectExpr("id", "cast(id % 7 as string) AS s")
    assert incremental.corpus_revision(a, "id", "s").first() == incremental.corpus_revision(a.repartition(7, "s"), "id", "s").first()


def test_reopened_findings(spark):
    known = spark.createDataFrame([("f", 1, "missing check on user input", "fixed")], "file string, id long, title string, status string")
    seen = spark.createDataFrame([("f", "missing check of user input"), ("f", "other thing entirely")], "file string, title string")
    got = {r.title: (r.status, r.result) for r in changes.upsert_findings(known, seen, ["file"], "title").collect()}
    assert got == {"missing check of user input": ("open", "reopened"), "other thing entirely": ("open", "created")}
