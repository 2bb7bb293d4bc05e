"""Sinks: change-only JSON, append-only logs, graph exports and notes."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.incremental import corpus_revision

#: Edges that a diagram shows at most: the limit of a picture.
DIAGRAM = 150


def write_changed(df: DataFrame, folder: str, name: str) -> bool:
    """Writes a table as JSON unless its content is what the folder's mark says was written last."""
    spark = df.sparkSession
    revision = corpus_revision(df, *sorted(df.columns)).first().revision
    mark = f"{folder}/{name}.revision"
    try:
        if spark.read.schema("revision string").json(mark).first().revision == revision:
            return False
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    df.select(*sorted(df.columns)).write.mode("overwrite").json(f"{folder}/{name}")
    spark.createDataFrame([(revision,)], "revision string").coalesce(1).write.mode("overwrite").json(mark)
    return True


def append_events(df: DataFrame, folder: str) -> None:
    """Adds rows to a log of JSON lines."""
    df.write.mode("append").json(folder)


def mermaid(edges: DataFrame) -> DataFrame:
    """(n, line) of a diagram, the first edges in order."""
    ordered = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).distinct().orderBy("a", "b").limit(DIAGRAM)
    lines = ordered.select(F.concat(F.lit("  "), F.regexp_replace("a", r"\W", "_"), F.lit('["'), "a", F.lit('"] --> '), F.regexp_replace("b", r"\W", "_"), F.lit('["'), "b", F.lit('"]')).alias("line"))
    return lines.sparkSession.createDataFrame([("graph LR",)], "line string").union(lines)


def dot(edges: DataFrame) -> DataFrame:
    """(line) of a DOT file's edges."""
    return edges.select(F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line")).distinct()


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of a GraphML file's nodes and edges."""
    def escaped(c):
        return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    n = nodes.select(F.concat(F.lit('<node id="'), escaped(F.col(nodes.columns[0])), F.lit('"/>')).alias("line"))
    return n.union(edges.select(F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"/>'))))


def html_page(title: str, payload: dict) -> str:
    """A page with a small payload inlined, safe within a script element."""
    data = json.dumps(payload, sort_keys=True).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><script type="application/json" id="graph">{data}</script>'


def notes(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(name, note): a Markdown note for each node with links to what it leads to."""
    links = edges.groupBy(F.col("src").alias(name)).agg(F.array_sort(F.collect_set(F.col("dst").cast("string"))).alias("to"))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col(name).cast("string")), F.array_join(F.transform(F.coalesce("to", F.array().cast("array<string>")), lambda t: F.concat(F.lit("- [["), t, F.lit("]]"))), "\n"))
    return nodes.select(name).join(links, name, "left").select(name, body.alias("note"))


def write_notes(df: DataFrame, name: str, folder: str) -> None:
    """A folder of notes for each name, by Spark's own writer."""
    df.withColumn("_name", F.regexp_replace(F.col(name).cast("string"), r"[^\w.-]", "_")).select("_name", F.col("note").alias("value")).write.mode("overwrite").partitionBy("_name").text(folder)
