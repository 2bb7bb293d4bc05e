"""A registry of extractors: named functions from parsed files to a relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import code

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(name: str):
    """Registers ``f(parsed)`` under a name of its own."""

    def register(f: Callable[[DataFrame], DataFrame]):
        if name in EXTRACTORS:
            raise ValueError(f"there is an extractor {name} already")
        EXTRACTORS[name] = f
        return f

    return register


def extract(parsed: DataFrame, *names: str) -> dict[str, DataFrame]:
    """What the named extractors, or all, make of parsed files; each relation is worked out when it is read."""
    if unknown := set(names) - set(EXTRACTORS):
        raise KeyError(f"no extractor {', '.join(sorted(unknown))}; there are {', '.join(sorted(EXTRACTORS))}")
    return {name: EXTRACTORS[name](parsed) for name in names or sorted(EXTRACTORS)}


@extractor("routes")
def routes(parsed: DataFrame) -> DataFrame:
    return code.routes(code.symbols(parsed))


@extractor("config_keys")
def config_keys(parsed: DataFrame) -> DataFrame:
    """(key, reads): environment keys with the places that read them."""
    reads = parsed.select("path", F.explode("env_reads").alias("r")).select("r.key", F.concat_ws(":", "path", F.col("r.line").cast("string")).alias("place"))
    return reads.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("reads"))


@extractor("entry_points")
def entry_points(parsed: DataFrame) -> DataFrame:
    """(kind, name): files that run as programs, and functions called main."""
    guarded = parsed.filter("has_main_guard").select(F.lit("guard").alias("kind"), F.col("path").alias("name"))
    mains = code.symbols(parsed).filter("name = 'main' AND kind = 'function'").select(F.lit("main").alias("kind"), F.concat_ws(":", "file", "qualname").alias("name"))
    return guarded.unionByName(mains)


@extractor("smells")
def smells(parsed: DataFrame) -> DataFrame:
    """(kind, n): how many smells of each kind there are."""
    return parsed.select(F.explode("smells.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
