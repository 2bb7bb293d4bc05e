"""Graph operators over an edge table (src, dst): loops of DataFrame jobs whose lineage is cut by checkpoints.

Frontiers, labels and ranks are tables; nothing of a graph's size comes to the driver but counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import checkpointed

#: Jobs whose plans may grow before a loop cuts their lineage.
EVERY = 4


def plain_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-10, digits: int = 6) -> DataFrame:
    """(node, rank).  Repeated edges weigh more; own loops and edges of unknown nodes don't count; dangling rank spreads evenly.

    Ranks ride along the edges: a step is one join on the source and one sum by target.
    """
    known = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    n = known.count()
    if n == 0:
        return known.withColumn("rank", F.lit(0.0))
    real = edges.filter("src != dst").join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    weighted = real.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = weighted.groupBy("src").agg(F.sum("w").alias("out"))
    links = checkpointed(weighted.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    sinks = known.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("sink", F.lit(True))
    ranks = checkpointed(known.join(sinks, "node", "left").select("node", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / n).alias("rank")))
    for k in range(iterations):
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).scalar()
        gained = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
        new = (1 - damping) / n + damping * dangling / n + damping * F.coalesce("g", F.lit(0.0))
        moved = ranks.join(gained, "node", "left").select("node", "sink", new.alias("rank"), F.abs(new - F.col("rank")).alias("delta"))
        last = k == iterations - 1
        if (k + 1) % EVERY == 0 and not last:
            moved = checkpointed(moved)
            if moved.agg(F.sum("delta")).first()[0] < tolerance:
                ranks = moved
                break
        ranks = moved.drop("delta")
    return ranks.select("node", F.round("rank", digits).alias("rank"))


def lazy_ranks(old: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Old ranks where at most max(10, 2 %) of the distinct edges changed, new nodes at the least rank; else ranks anew."""
    a, b = old_edges.select("src", "dst").distinct(), edges.select("src", "dst").distinct()
    changed = a.exceptAll(b).unionAll(b.exceptAll(a)).count()
    if changed > max(10, int(0.02 * a.count())):
        return pagerank(nodes, edges, **options)
    least = old.agg(F.min("rank")).scalar()
    return nodes.join(old, "node", "left").select("node", F.coalesce("rank", least).alias("rank"))


def reached(seeds: DataFrame, edges: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """(node, distance) of nodes within ``depth`` steps of the seeds along the edges; a cap cuts in order of distance and node."""
    seen = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("distance", F.lit(0))
    frontier, out = seen, seen
    for k in range(1, depth + 1):
        step = frontier.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(out, "node", "left_anti").withColumn("distance", F.lit(k)))
        out = out.unionByName(frontier)
        if frontier.isEmpty():
            break
    found = out.filter("distance > 0")
    return found.orderBy("distance", "node").limit(cap) if cap else found


def reverse_reached(seeds: DataFrame, edges: DataFrame, depth: int = 3, cap: int | None = None) -> DataFrame:
    """What depends on the seeds."""
    return reached(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth, cap)


def reached_from_each(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, distance) for every seed at once."""
    base = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    out = base.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance"))
    frontier = out
    for k in range(1, depth + 1):
        step = frontier.join(edges.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(out, ["seed", "node"], "left_anti").withColumn("distance", F.lit(k)))
        out = out.unionByName(frontier)
    return out.filter("distance > 0")


def blast(seeds: DataFrame, edges: DataFrame, depth: int = 3, top: int = 5) -> DataFrame:
    """(seed, count, top): how many depend on each seed, and the nearest of them."""
    found = reached_from_each(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth).filter("seed != node")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    ranked = found.withColumn("p", place)
    first = F.array_sort(F.collect_list(F.when(F.col("p") <= top, F.struct("p", F.col("node").cast("string").alias("n")))))
    return ranked.groupBy("seed").agg(F.count("*").alias("count"), F.array_join(F.transform(first, lambda x: x["n"]), ",").alias("top"))


def shortest_paths(source: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, distance, path): a shortest path from the source to each node within reach, the smallest in order of its nodes."""
    out = source.select(F.col(source.columns[0]).alias("node"), F.lit(0).alias("distance"), F.array(F.col(source.columns[0])).alias("path"))
    frontier = out
    for k in range(1, depth + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = step.join(out, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = checkpointed(new.select("node", F.lit(k).alias("distance"), "path"))
        out = out.unionByName(frontier)
        if frontier.isEmpty():
            break
    return out.filter("distance > 0")


def bounded_walk(seeds: DataFrame, edges: DataFrame, depth: int = 2, most: int = 40, neighbours: int = 12, hub: int = 50) -> DataFrame:
    """(node, distance): a walk that follows each node's first neighbours only, never beyond hubs that are no seeds."""
    degree = edges.groupBy("src").agg(F.countDistinct("dst").alias("degree"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    near = edges.select("src", "dst").distinct().withColumn("p", place).filter(F.col("p") <= neighbours).join(degree, "src").select("src", "dst", "degree")
    out = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("distance", F.lit(0))
    frontier = out
    for k in range(1, depth + 1):
        allowed = near if k == 1 else near.filter(F.col("degree") < hub)
        step = frontier.join(allowed, frontier["node"] == allowed["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(out, "node", "left_anti").withColumn("distance", F.lit(k)))
        out = out.unionByName(frontier)
    return out.filter("distance > 0").orderBy("distance", "node").limit(most)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each one is connected to, by alternating stars."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()
    before = None
    while True:
        ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = ends.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = hung.groupBy("u").agg(F.min("v").alias("m"))
        star = hung.join(lowest, "u").filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(lowest.select(F.col("m").alias("a"), F.col("u").alias("b")))
        pairs = checkpointed(star.distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


#: Edges that one task takes whole, in some seconds and some hundred MB.
EDGES_A_TASK = 1_000_000

#: Share of the edges that a round of trimming must take off for another one, before connected parts are found.
WORTH_TRIMMING = 0.1


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more, named by their smallest node.

    Edges that hang together meet in one task, by Tarjan's walk, unless there are more than ``EDGES_A_TASK`` of them; what a few
    rounds of trimming take off is not looked at for what it hangs together with.  Of larger
    parts, nodes without predecessors or successors are trimmed until none is left; then every node takes the smallest label
    that reaches it, and each label's root collects, backwards, the nodes of its own label.  Found components leave the
    graph and the rest goes round again, until nothing is left; ``rounds`` are a limit that raises, for rounds that do without walks.
    """
    left = checkpointed(edges.filter("src != dst").select("src", "dst").distinct())
    found, most = None, EDGES_A_TASK if rounds is None else 0
    for done in count():
        size = left.count()
        if size > most > 0:
            left, size = _trimmed(left, size, most, WORTH_TRIMMING)
        if size > most > 0:
            here, left = _apart(left, most)
            found = here if found is None else checkpointed(found.unionByName(here))
            size = left.count()
        if size > most:
            left, size = _trimmed(left, size, most)
        if size <= most:
            # once, however often the result is read
            last = checkpointed(_walked(left.repartition(1))) if size else None
            found = last if found is None else found.unionByName(last) if size else found
            break
        if done == rounds:
            raise RuntimeError(f"strong components: {size} edges are left after {rounds} rounds")
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        forward = _least_label(nodes, left)
        inside = left.join(forward.select(F.col("node").alias("src"), F.col("label").alias("l")), "src").join(forward.select(F.col("node").alias("dst"), "label"), "dst").filter("l = label").select("src", "dst", "label")
        # backwards from the roots, within their labels
        members = forward.filter("node = label")
        frontier = members
        while True:
            step = frontier.join(inside.select(F.col("dst").alias("node"), F.col("src").alias("up"), "label"), ["node", "label"]).select(F.col("up").alias("node"), "label").distinct()
            frontier = checkpointed(step.join(members, ["node", "label"], "left_anti"))
            if frontier.isEmpty():
                break
            members = checkpointed(members.unionByName(frontier))
        sized = members.join(members.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label").select("node", F.col("label").alias("component"))
        # one table however many rounds there are
        found = checkpointed(sized if found is None else found.unionByName(sized))
        gone = members.select("node")
        left = checkpointed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def _apart(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(strong components of the connected parts of at most so many edges, edges of the larger parts)."""
    placed = checkpointed(edges.join(components(edges).withColumnRenamed("node", "src"), "src"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = checkpointed(sizes.filter(F.col("n") > most).select("component"))
    small = placed.join(large, "component", "left_anti").select("src", "dst", "component")
    tasks = -(-small.count() * 4 // most)
    return checkpointed(_walked(small.repartition(max(1, tasks), "component"))), placed.join(large, "component", "left_semi").select("src", "dst")


def _trimmed(left: DataFrame, size: int, most: int, worth: float = 0.0) -> tuple[DataFrame, int]:
    """(edges between nodes that have predecessors and successors, their number); ends where so few are left, or a round takes off no more than that share."""
    while size > most:
        heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = checkpointed(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        before, size = size, left.count()
        if before - size <= worth * before:
            break
    return left, size


def _walked(edges: DataFrame) -> DataFrame:
    """(node, component) of the strong components of two nodes or more, each partition's edges by themselves."""
    kind = dict(edges.dtypes)["src"]

    def walk(frames):
        held = [f[["src", "dst"]] for f in frames if len(f)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            nodes, lowest = strong_of(rows["src"].to_numpy(), rows["dst"].to_numpy())
            yield pd.DataFrame({"node": nodes, "component": lowest})

    return edges.mapInPandas(walk, f"node {kind}, component {kind}")


def strong_of(src, dst):
    """(nodes, smallest node of each one's strong component) of the components of two nodes or more; Tarjan's walk, linear."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, (a, b) = len(nodes), (at[: len(src)], at[len(src) :])
    order = np.argsort(a, kind="stable")
    to, start = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    number, low, lowest, nxt, stack, seen = [0] * n, [0] * n, [-1] * n, start[:n], [], 0
    for root in range(n):
        if number[root]:
            continue
        seen += 1
        number[root] = low[root] = seen
        stack.append(root)
        path = [root]
        while path:
            v = path[-1]
            i = nxt[v]
            if i < start[v + 1]:
                nxt[v] = i + 1
                w = to[i]
                if not number[w]:
                    seen += 1
                    number[w] = low[w] = seen
                    stack.append(w)
                    path.append(w)
                elif lowest[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                k = len(stack) - 1
                while stack[k] != v:
                    k -= 1
                least = min(stack[k:])
                for x in stack[k:]:
                    lowest[x] = least
                del stack[k:]
    lowest = np.array(lowest, dtype=np.int64)
    several = np.bincount(lowest, minlength=n)[lowest] > 1 if n else np.zeros(0, bool)
    return nodes[several], nodes[lowest[several]]


def _least_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    labels = nodes.withColumn("label", F.col("node"))
    while True:
        came = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("l"))
        new = checkpointed(labels.join(came, "node", "left").select("node", F.least("label", F.coalesce("l", "label")).alias("label"), (F.col("l") < F.col("label")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        labels = new.drop("moved")


def cycle_edges(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """Edges within one component."""
    a, b = strong.withColumnsRenamed({"node": "src", "component": "ca"}), strong.withColumnsRenamed({"node": "dst", "component": "cb"})
    # the few edges that are left are made distinct where the last join has them
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst").distinct()


def tiers(edges: DataFrame, strong: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, tier): the longest path below each node, where strongly connected nodes are one; ``rounds`` are a limit that raises."""
    pairs = edges.select("src", "dst").distinct()
    names = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    names = checkpointed(names)
    folded = checkpointed(pairs.join(names.withColumnsRenamed({"node": "src", "c": "a"}), "src").join(names.withColumnsRenamed({"node": "dst", "c": "b"}), "dst").filter("a != b").select("a", "b").distinct())
    level = names.select("c").distinct().withColumn("tier", F.lit(0))
    for done in count():
        above = folded.join(level.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg((F.max("tier") + 1).alias("t"))
        new = checkpointed(level.join(above, "c", "left").select("c", F.greatest("tier", F.coalesce("t", F.lit(0))).alias("tier"), (F.col("t") > F.col("tier")).alias("moved")))
        level = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"tiers still rise after {rounds} rounds")
    return names.join(level, "c").select("node", "tier")


#: Edges of the connected components that louvain() puts together in a task, and of a larger one by itself.
EDGES_A_MOVE = 50_000


def louvain(edges: DataFrame, passes: int = 10, gain: float = 1e-9) -> DataFrame:
    """(node, community) by modularity, over (src, dst, weight); 0 is the largest community.

    Moves depend on one another only within a connected component, so components are dealt over tasks by the number of their
    edges and give what one pass over the whole graph would; the total weight alone is global.
    """
    real = edges.filter("src != dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    parts = components(real)
    sums = real.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    total, tasks = sums[0], max(1, -(-sums[1] // EDGES_A_MOVE))
    kind = dict(real.dtypes)["src"]

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, labels = moved_together(rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["weight"].to_numpy(), total, passes, gain)
        return pd.DataFrame({"node": nodes, "label": labels})

    # by a stated number of tasks, which are not put together for being small; once, though sizes and labels are both read
    placed = real.join(parts.withColumnsRenamed({"node": "src"}), "src").repartition(tasks, "component")
    labels = checkpointed(placed.groupBy("component").applyInPandas(move, f"node {kind}, label {kind}"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    numbered = sizes.withColumn("community", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "first")) - 1)
    return labels.join(numbered.select("label", "community"), "label").select("node", "community")


def moved_together(src, dst, weight, total: float, passes: int, gain: float):
    """(nodes, communities) of Louvain's moves: nodes in their order, to the community of most gain, the smallest of equal ones."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    level: list[dict] = [{} for _ in nodes]
    for i in np.lexsort((weight, b, a)).tolist():
        x, y, w = int(a[i]), int(b[i]), float(weight[i])
        level[x][y] = level[x].get(y, 0.0) + w
        level[y][x] = level[y].get(x, 0.0) + w
    # member: a node's place on the level; lead: a level's places as nodes
    member, lead, twice = np.arange(len(nodes)), np.arange(len(nodes)), 2 * total
    while True:
        home = list(range(len(level)))
        degree = [sum(near.values()) for near in level]
        weight_of = degree[:]
        around = [[(m, w) for m, w in near.items() if m != n] for n, near in enumerate(level)]
        improved = False
        for _ in range(passes):
            moved = False
            for n, near in enumerate(around):
                here, own, pull = home[n], degree[n], {}
                for m, w in near:
                    c = home[m]
                    pull[c] = pull.get(c, 0.0) + w
                weight_of[here] -= own
                best, most = here, pull.get(here, 0.0) - weight_of[here] * own / twice
                for c in sorted(pull) if len(pull) > 1 else pull:
                    worth = pull[c] - weight_of[c] * own / twice
                    if worth > most + gain:
                        best, most = c, worth
                weight_of[best] += own
                if best != here:
                    home[n] = best
                    moved = improved = True
            if not moved:
                break
        if not improved:
            break
        kept = sorted(set(home))
        place = {c: k for k, c in enumerate(kept)}
        home = [place[c] for c in home]
        member, lead = np.array(home)[member], lead[kept]
        merged: list[dict] = [{} for _ in kept]
        for n, near in enumerate(level):
            into = merged[home[n]]
            for m, w in near.items():
                c = home[m]
                into[c] = into.get(c, 0.0) + w
        level = merged
    return nodes, nodes[lead[member]]


def reinforce(blocks: DataFrame, edges: DataFrame, best: int = 14, top: int = 3, share: float = 0.25) -> DataFrame:
    """(node, score): the best nodes gain a share of their three best neighbours among them."""
    short = blocks.orderBy(F.desc("score"), "node").limit(best)
    near = both_ways(edges).join(short.select(F.col("node").alias("dst"), F.col("score").alias("s")), "dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("s"), "dst"))
    gain = near.withColumn("p", place).filter(F.col("p") <= top).groupBy(F.col("src").alias("node")).agg(F.sum("s").alias("g"))
    return short.join(gain, "node", "left").select("node", (F.col("score") + share * F.coalesce("g", F.lit(0.0))).alias("score"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
