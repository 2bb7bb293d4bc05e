"""Histories, diffs and coverage as relations, from the text that tools print."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a log is printed with: records by 0x1E, fields by 0x1F, then one file a line.
LOG_FORMAT = "%x1e%H%x1f%an%x1f%ct"


def git_log(root: str, most: int = 1000) -> str:
    """The log of a repository, as ``commits`` reads it; the driver runs the one process."""
    command = ["git", "-C", root, "log", "--no-merges", "--relative", f"-n{most}", "--name-only", f"--format={LOG_FORMAT}"]
    return subprocess.run(command, capture_output=True, text=True, check=True, timeout=120).stdout


def git_head(root: str) -> str | None:
    """The commit that is checked out, or None outside a repository."""
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=30)
    return done.stdout.strip() if done.returncode == 0 else None


def commits(spark: SparkSession, text: str) -> DataFrame:
    """(sha, author, ts, file) of a printed log."""
    records = spark.createDataFrame([(r,) for r in text.split("\x1e") if r.strip()], "record string")
    head = F.split(F.substring_index("record", "\n", 1), "\x1f")
    body = F.filter(F.slice(F.split("record", r"\r?\n"), F.lit(2), F.size(F.split("record", r"\r?\n"))), lambda x: F.trim(x) != "")
    whole = records.filter(F.size(head) == 3)
    return whole.select(head[0].alias("sha"), head[1].alias("author"), head[2].cast("long").alias("ts"), F.explode(F.transform(body, lambda x: F.trim(x))).alias("file")).distinct()


#: Lines of a diff between which its file headers are carried in one task.
DIFF_BLOCK = 65_536


def diff_path(value: Column, prefix: str) -> Column:
    """The path of a ``---`` or ``+++`` line without its prefix; quoted names are unquoted; null for /dev/null and what is neither."""
    plain = F.when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)
    return F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain)))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(old_file, file, old_lo, old_hi, lo, hi) of a unified diff's (n, line) rows; an empty side has hi below lo.

    Files are those of the last ``---`` and ``+++`` lines before a hunk; the side that does not exist is null.  Headers are carried
    within blocks of lines, and from block to block.
    """
    body = F.regexp_replace(F.substring("line", F.lit(5), F.length("line")), r"\r$", "")
    header = F.when(F.col("line").startswith("--- "), F.struct(diff_path(body, "a/").alias("path")))
    named = F.when(F.col("line").startswith("+++ "), F.struct(diff_path(body, "b/").alias("path")))
    marks = lines.filter(F.col("line").rlike(r"^(--- |\+\+\+ |@@ )")).select("n", "line", F.expr(f"n div {DIFF_BLOCK}").alias("block"), header.alias("old"), named.alias("new"))
    # a removed line may begin like a header: headers come in pairs
    pair = Window.partitionBy("block").orderBy("n")
    marks = marks.withColumn("paired", F.coalesce(F.lead("line").over(pair).startswith("+++ "), F.lit(True)) & F.col("old").isNotNull() | F.coalesce(F.lag("line").over(pair).startswith("--- "), F.lit(True)) & F.col("new").isNotNull())
    marks = marks.withColumn("old", F.when(F.col("paired"), F.col("old"))).withColumn("new", F.when(F.col("paired"), F.col("new")))
    upto = pair.rowsBetween(Window.unboundedPreceding, 0)
    last = marks.groupBy("block").agg(F.max_by("old", F.when(F.col("old").isNotNull(), F.col("n"))).alias("last_old"), F.max_by("new", F.when(F.col("new").isNotNull(), F.col("n"))).alias("last_new"))
    before = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = last.select("block", F.last("last_old", ignorenulls=True).over(before).alias("last_old"), F.last("last_new", ignorenulls=True).over(before).alias("last_new"))
    known = marks.withColumn("o", F.last("old", ignorenulls=True).over(upto)).withColumn("f", F.last("new", ignorenulls=True).over(upto)).filter(F.col("line").startswith("@@ "))
    hunks = known.join(carried, "block", "left")
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

    def number(k: int, default: int):
        text = F.regexp_extract("line", pattern, k)
        return F.when(text == "", default).otherwise(text.try_cast("int"))

    old, old_n, new, new_n = number(1, 0), number(2, 1), number(3, 0), number(4, 1)
    whole = hunks.filter(F.col("line").rlike(pattern))
    return whole.select(F.coalesce("o", "last_old")["path"].alias("old_file"), F.coalesce("f", "last_new")["path"].alias("file"), old.alias("old_lo"), (old + old_n - 1).alias("old_hi"), new.alias("lo"), (new + new_n - 1).alias("hi"))


def diff_ranges(lines: DataFrame) -> DataFrame:
    """(file, lo, hi): the lines that hunks touch on either side of a file that exists there; an empty side touches its first line."""
    hunks = diff_hunks(lines)
    side = lambda file, lo, hi: hunks.select(F.col(file).alias("file"), F.greatest(F.lit(1), lo).alias("lo"), F.greatest(F.lit(1), F.col(lo), F.col(hi)).alias("hi"))
    return side("old_file", "old_lo", "old_hi").unionByName(side("file", "lo", "hi")).filter("file IS NOT NULL").distinct()


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, ratio) of a coverage report in JSON."""
    files = spark.read.option("multiLine", True).schema("files map<string, struct<summary: struct<percent_covered: double>>>").json(path)
    return files.select(F.explode("files").alias("file", "f")).select("file", (F.col("f.summary.percent_covered") / 100).alias("ratio"))


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, ratio) of a Cobertura report."""
    schema = "_filename string, `_line-rate` double"
    return spark.read.format("xml").option("rowTag", "class").schema(schema).load(path).select(F.col("_filename").alias("file"), F.col("_line-rate").alias("ratio"))


def match_suffix(report: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, ratio): report names matched to the indexed path that they equal, else to the one that alone ends in them or that they end in.

    Backslashes are slashes, and leading dots and slashes go.  Paths and names make their suffixes, which meet by equality.
    """

    def suffixes(df: DataFrame, name: str, *others: str) -> DataFrame:
        parts = F.split(name, "/")
        each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
        return df.select(name, *others, F.explode(each).alias("suffix"))

    plain = F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^[./]+", "")
    named = report.select(plain.alias("name"), "ratio")
    longer = suffixes(indexed, "path").join(named, F.col("suffix") == F.col("name")).select("name", "ratio", "path")
    shorter = suffixes(named, "name", "ratio").join(indexed, F.col("suffix") == F.col("path")).select("name", "ratio", "path")
    both = longer.unionByName(shorter).distinct()
    by = Window.partitionBy("name", "ratio")
    counted = both.withColumn("equal", F.col("name") == F.col("path")).withColumn("n", F.count("*").over(by)).withColumn("some", F.max("equal").over(by))
    return counted.filter(F.col("equal") | ~F.col("some") & (F.col("n") == 1)).select("path", "ratio")
