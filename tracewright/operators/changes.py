"""Set operations, structural diffs, drift and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import jaccard, title_words


def facts_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, key, change) between two snapshots of (kind, key, value) facts."""
    a, b = old.withColumnRenamed("value", "was"), new.withColumnRenamed("value", "now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, ["kind", "key"], "full_outer").withColumn("change", change).filter("change IS NOT NULL").select("kind", "key", "change")


def renames(removed: DataFrame, added: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(old, new): removed and added names of one module and signature, paired in order."""
    order = Window.partitionBy(*keys).orderBy(name)
    a = removed.withColumn("p", F.row_number().over(order)).withColumnRenamed(name, "old")
    b = added.withColumn("p", F.row_number().over(order)).withColumnRenamed(name, "new")
    return a.join(b, [*keys, "p"]).select("old", "new")


def drift(previous: DataFrame, changes: DataFrame, threshold: int = 8, capped: str = "import_edge", cap: int = 5) -> DataFrame:
    """(section, score, stale): weights of changes added up; of one kind only the first few of an update weigh."""
    order = Window.partitionBy("section", "kind").orderBy("description")
    weighed = changes.withColumn("p", F.row_number().over(order)).withColumn("weight", F.when((F.col("kind") == capped) & (F.col("p") > cap), 0).otherwise(F.col("weight")))
    total = previous.select("section", "score").unionByName(weighed.select("section", F.col("weight").alias("score"))).groupBy("section").agg(F.sum("score").alias("score"))
    return total.withColumn("stale", F.col("score") >= threshold)


def upsert_findings(known: DataFrame, seen: DataFrame, place: list[str], title: str, least: float = 0.5) -> DataFrame:
    """(id, title, status, result): findings matched by place and similar titles are updated, fixed ones reopened, others created."""
    # of the known findings of one place and title the first alone can be chosen
    k = known.groupBy(*place, F.col(title).alias("was")).agg(F.min(F.struct("id", "status")).alias("m")).select(*place, "was", "m.id", "m.status")
    s = seen.select(*place, F.col(title).alias("now")).distinct()
    both = s.join(k, place).filter(jaccard(title_words(F.col("was")), title_words(F.col("now"))) >= least)
    best = F.row_number().over(Window.partitionBy(*place, "now").orderBy("id"))
    matched = both.withColumn("p", best).filter("p = 1").drop("p")
    reopened = F.col("status") == "fixed"
    updated = matched.select("id", F.col("now").alias("title"), F.when(reopened, "open").otherwise(F.col("status")).alias("status"), F.when(reopened, "reopened").otherwise("updated").alias("result"))
    fresh = s.join(matched.select(*place, "now"), [*place, "now"], "left_anti")
    return updated.unionByName(fresh.select(F.lit(None).cast("long").alias("id"), F.col("now").alias("title"), F.lit("open").alias("status"), F.lit("created").alias("result")))


def report_diff(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, state): new, fixed or persisting open findings."""
    a, b = before.select(key, F.lit(True).alias("a")), now.select(key, F.lit(True).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "fixed").otherwise("persisting")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def with_status(findings: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Findings after status updates; allowed are open, fixed, wontfix and false_positive."""
    good = updates.filter(F.col("status").isin("open", "fixed", "wontfix", "false_positive")).select(key, F.col("status").alias("to"))
    moved = findings.join(good, key, "left")
    history = F.when(F.col("to").isNotNull() & (F.col("to") != F.col("status")), F.concat_ws(">", "history", "to")).otherwise(F.col("history"))
    return moved.select(key, F.coalesce("to", "status").alias("status"), history.alias("history"))


def subsumed(groups: DataFrame, name: str, member: str) -> DataFrame:
    """Names whose members are all members of another name with more: found by counting shared members."""
    g = groups.select(F.col(name).alias("n"), F.col(member).alias("m")).distinct()
    sizes = g.groupBy("n").agg(F.count("*").alias("size"))
    shared = g.alias("x").join(g.alias("y"), "m").filter("x.n != y.n").groupBy(F.col("x.n").alias("n"), F.col("y.n").alias("other")).agg(F.count("*").alias("k"))
    both = shared.join(sizes, "n").join(sizes.withColumnsRenamed({"n": "other", "size": "more"}), "other")
    return both.filter((F.col("k") == F.col("size")) & (F.col("more") > F.col("size"))).select("n").distinct().withColumnRenamed("n", name)


def decision_state(active: Column, unverified: Column, stale: Column) -> Column:
    return F.when(~active, "inactive").when(unverified, "unverified").when(stale, "stale").otherwise("current")
