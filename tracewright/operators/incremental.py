"""Incremental maintenance: what of a snapshot must be done again, and publishing generations."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reuse_hashes(listing: DataFrame, manifest: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The listing with the manifest's value where all keys agree, and ``read`` where there is none."""
    return listing.join(manifest.select(*keys, value), keys, "left").withColumn("read", F.col(value).isNull())


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots."""
    a, b = old.select(key, F.col(digest).alias("was")), new.select(key, F.col(digest).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, key, "full_outer").withColumn("change", kind).filter("change IS NOT NULL").select(key, "change")


def update(state: DataFrame, source: DataFrame, keys: list[str], derive) -> DataFrame:
    """The state for a new source: rows of unchanged keys are reused, the others derived, gone ones dropped."""
    kept = state.join(source.select(*keys), keys, "left_semi")
    fresh = derive(source.join(state.select(*keys), keys, "left_anti"))
    return kept.unionByName(fresh)


def multiset_delta(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, inserted) rows, repeats counted."""
    return old.exceptAll(new), new.exceptAll(old)


def corpus_revision(df: DataFrame, *columns: str) -> DataFrame:
    """(revision, n): a digest that does not depend on the order of rows, from sums of row hashes; no rows are gathered."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    text = F.concat_ws(":", F.coalesce(F.sum(row), F.lit(0)).cast("string"), F.coalesce(F.sum(row * F.pmod(F.xxhash64(*columns, F.lit(1)), F.lit(1_000_003))), F.lit(0)).cast("string"), F.count("*").cast("string"))
    return df.agg(F.sha2(text, 256).alias("revision"), F.count("*").alias("n"))


def publish(spark, tables: dict[str, DataFrame], folder: str) -> str:
    """Writes a generation of tables, and its manifest last: readers see the old generation or the whole new one."""
    name = f"gen-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    manifest = spark.createDataFrame([(name, json.dumps(sorted(tables)))], "generation string, tables string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return name


def current(spark, folder: str, table: str) -> DataFrame:
    """A table of the newest published generation."""
    name = spark.read.schema("generation string, tables string").json(f"{folder}/manifest").first().generation
    return spark.read.parquet(f"{folder}/{name}/{table}")


#: Seconds after which a lock counts as left behind, and between two tries to take one.
STALE_AFTER, POLL = 300.0, 0.1


class Busy(RuntimeError):
    """Another update holds the lock and did not give it back in time."""


class UpdateLock:
    """One update at a time of what lies in a folder of any file system that Spark writes to: a file that is made only if it is not there."""

    def __init__(self, spark, folder: str, wait: float = 10.0, stale_after: float = STALE_AFTER):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/update.lock")
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.wait, self.stale_after, self.token = wait, stale_after, uuid.uuid4().hex

    def _taken(self) -> bool:
        try:
            out = self.files.create(self.path, False)
        except Exception as e:  # noqa: BLE001  the file system's own error says that the file is there
            if self.files.exists(self.path):
                return False
            raise RuntimeError(f"no lock can be made at {self.path}") from e
        out.write(bytearray(self.token.encode()))
        out.close()
        return True

    def _left_behind(self) -> bool:
        try:
            return time.time() - self.files.getFileStatus(self.path).getModificationTime() / 1000 > self.stale_after
        except Exception:  # noqa: BLE001  it has just gone: the next try takes it
            return False

    def __enter__(self) -> UpdateLock:
        until = time.monotonic() + self.wait
        while not self._taken():
            if self._left_behind():
                self.files.delete(self.path, False)
            elif time.monotonic() >= until:
                raise Busy(f"another update holds {self.path}")
            else:
                time.sleep(POLL)
        return self

    def __exit__(self, *_) -> None:
        self.files.delete(self.path, False)
