"""Lookups and joins over named columns.  Spark picks the physical join; each function says which side is small by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_rank(df: DataFrame, rank: str, key: str) -> DataFrame:
    """Highest rank first, then key."""
    return df.orderBy(F.desc(rank), key)


def lookup_many(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is among the keys."""
    return df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def suffix_match(column: Column, name: str, separator: str = ".") -> Column:
    return (column == name) | column.endswith(separator + name)


def prefix_match(column: Column, name: str, separator: str = ".") -> Column:
    return (column == name) | column.startswith(name + separator)


def stab(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, span_id: str, width: int = 64) -> DataFrame:
    """Each point with the innermost span that holds it: the shortest, then the later start, then the smaller id.

    Spans and points meet by equi-join on buckets of ``width`` positions, so that no range join compares all with all.
    """
    p = points.withColumn("bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    held = p.join(s, [*keys, "bucket"]).filter((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi)))
    inner = F.min(F.struct((F.col(hi) - F.col(lo)).alias("span"), (-F.col(lo)).alias("later"), F.col(span_id))).alias("m")
    return held.groupBy(*points.columns).agg(inner).select(*points.columns, F.col(f"m.{span_id}").alias(span_id))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: int = 64) -> DataFrame:
    """Pairs of closed intervals that overlap, each once."""
    x = a.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a_lo) / width), F.floor(F.col(a_hi) / width))))
    y = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(b_lo) / width), F.floor(F.col(b_hi) / width))))
    both = x.join(y, [*keys, "bucket"]).filter((F.col(a_lo) <= F.col(b_hi)) & (F.col(a_hi) >= F.col(b_lo)))
    # the first bucket that both have
    return both.filter(F.col("bucket") == F.greatest(F.floor(F.col(a_lo) / width), F.floor(F.col(b_lo) / width))).drop("bucket")


def unique_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows with the value of the only right row of their key; keys with several are left out."""
    only = right.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")
    return left.join(only, key)


def candidates(right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, all values sorted and joined by commas) of keys with more than one."""
    many = right.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), ",").alias("candidates"))
    return many.filter("n > 1")


def first_rule(rules: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first rule that answers for a key: an ordered chain of joins whose results are united and ranked once."""
    out = None
    for place, rule in enumerate(rules):
        tagged = rule.withColumn("rule", F.lit(place))
        out = tagged if out is None else out.unionByName(tagged)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("rule", *[c for c in rules[0].columns if c not in keys]))
    return out.withColumn("place", best).filter("place = 1").drop("place")


def longest_suffix(names: DataFrame, name: str, packages: DataFrame, package: str, separator: str = ".") -> DataFrame:
    """(name, package): the package that is the longest suffix of a name, where one alone is longest.

    Each name makes its suffixes, which meet the packages by equality.
    """
    parts = F.split(F.col(name), "\\" + separator)
    suffixes = names.select(name, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("from"), parts.alias("parts")).select(
        name, F.array_join(F.slice("parts", F.col("from"), F.size("parts") - F.col("from") + 1), separator).alias(package)
    )
    ends = packages.withColumn("whole", F.col(package))
    found = suffixes.join(ends.select("whole", package), package)
    longest = F.rank().over(Window.partitionBy(name).orderBy(F.desc(F.length("whole"))))
    top = found.withColumn("place", longest).filter("place = 1")
    return top.groupBy(name).agg(F.count("*").alias("n"), F.min("whole").alias(package)).filter("n = 1").drop("n")


def nearest_by_prefix(left: DataFrame, right: DataFrame, group: str, l_path: str, r_path: str) -> DataFrame:
    """Pairs of one group whose directory paths share the most leading parts, per left path: all ties are kept.

    Prefixes meet by equality: the longest one of a left path that the group's right paths have is found first, and only
    pairs that share it are made, so the work is that of the result.
    """

    def prefixes(df: DataFrame, path: str, least: int = 0) -> DataFrame:
        parts = F.split(path, "/")
        cut = F.transform(F.sequence(F.lit(least), F.size(parts)), lambda k: F.struct(k.alias("shared"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix")))
        return df.select("*", F.explode(cut).alias("c")).select(*df.columns, "c.*")

    there = prefixes(right, r_path)
    known = there.select(group, "shared", "prefix").distinct()
    deepest = prefixes(left.select(group, l_path).distinct(), l_path).join(known, [group, "shared", "prefix"], "left_semi").groupBy(group, l_path).agg(F.max(F.struct("shared", "prefix")).alias("m")).select(group, l_path, "m.*")
    return left.join(deepest, [group, l_path]).join(there, [group, "shared", "prefix"]).drop("prefix")


def lift(edges: DataFrame, places: DataFrame, node: str, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between the groups of their ends: (src, dst, weight), own loops left out."""
    a = places.select(F.col(node).alias(src), F.col(group).alias("a"))
    b = places.select(F.col(node).alias(dst), F.col(group).alias("b"))
    both = edges.join(a, src).join(b, dst).filter("a != b")
    return both.groupBy(F.col("a").alias(src), F.col("b").alias(dst)).agg(F.count("*").alias("weight"))


def ancestors(df: DataFrame, node: str, parent: str, depth: int) -> DataFrame:
    """(node, ancestor, distance) by self joins up to ``depth`` steps: inheritance without endless cycles."""
    one = df.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor IS NOT NULL")
    step, out = one.withColumn("distance", F.lit(1)), one.withColumn("distance", F.lit(1))
    up = one.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    for k in range(2, depth + 1):
        step = step.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(k).alias("distance"))
        out = out.unionByName(step)
    return out.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
