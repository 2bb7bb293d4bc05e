"""What the two similarity joins share: candidate groups, their verification in blocks, and connected classes.

Keys are made in NumPy and go to the shuffle as packed blobs, so that a candidate index costs some 15 bytes a key and no
row.  All buckets that one item leads (as its smallest) make one group, whose members' contents meet in a task.  A group of
more than a chunk of members is cut into chunks, and each pair of chunks is a block of its own, so that no task holds an
unbounded group.  What a block hands on is linear in its members: links that span its classes and, where they are asked
for, counts of links.  Pairs are neither rows nor capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import checkpointed, release

KEYS = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
#: Bytes of input that a part of a candidate index or of its contents stands for at most.
PART_BYTES = 64 << 20
#: Into how many keys a group's rows are dealt where they meet the group's size.
SALTS = 16


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """The powers of ``GOLDEN`` and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, least: int = (1 << 20) + 1024):
        self.up = self.down = np.ones(1, np.uint64)
        self.least = least

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            size = max(n, self.least)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f)])) for f in (GOLDEN, INVERSE))
        return self.up[:n], self.down[:n]


def partitions(df: DataFrame) -> int:
    """Parts of an index: twice the shuffle's partitions, and more where the input's size asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark multiplies sizes through joins: beyond 2^56 it is no estimate
    return max(least, size // PART_BYTES) if size < 1 << 56 else least


def dealt(of: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (part, blob): the columns' values by part, one column's bytes after another's."""
    # numbers of 16 bits are sorted by their digits
    order = np.argsort(of.astype(np.uint16) if of.max(initial=0) < 1 << 16 else of, kind="stable")
    of, columns = of[order], [c[order] for c in columns]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    rows = [[], []]
    for a, b in zip(first, [*first, of.size][1:], strict=True):
        rows[0].append(int(of[a]))
        rows[1].append(b"".join(c[a:b].tobytes() for c in columns))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], schema=KEYS)


def collected(blobs: pa.ChunkedArray, types: list) -> list[np.ndarray]:
    """The columns that ``dealt`` packed, of all blobs of a part."""
    width, out = sum(np.dtype(t).itemsize for t in types), [[] for _ in types]
    for blob in blobs:
        raw = memoryview(blob.as_buffer())
        n, at = len(raw) // width, 0
        for column, t in zip(out, types, strict=True):
            column.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, types, strict=True)]


def runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the runs of equal rows."""
    new = np.zeros(sorted_columns[0].size, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff([*first, new.size])


def repeated(key: np.ndarray) -> np.ndarray:
    """Where the 32-bit keys are that occur more than once, in the order of the keys."""
    both = (key.astype(np.uint64) << np.uint64(32)) | np.arange(key.size, dtype=np.uint64)
    both.sort()
    high = both >> np.uint64(32)
    same = high[1:] == high[:-1]
    keep = np.zeros(key.size, bool)
    keep[1:] = same
    keep[:-1] |= same
    return (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contents(blobs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(id, packed): the compressed content of each wanted item; ``blobs`` are rows (part, blob) of items dealt out by id."""

    def pick(asked: pa.Table, table: pa.Table) -> pa.Table:
        ids, packed = wanted_rows(asked["id"].to_numpy(), table["blob"], 0, zstandard.ZstdCompressor(level=1).compress)
        release()
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["id", "packed"])

    asked = wanted.select("id").distinct().withColumn("part", F.pmod("id", F.lit(parts)).cast("int"))
    return asked.groupBy("part").cogroup(blobs.groupBy("part")).applyInArrow(pick, "id long, packed binary")


def pack_rows(ids: list[int], contents: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], names=["id", "content"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def wanted_rows(asked: np.ndarray, blobs: pa.ChunkedArray, shift: int, pack: Callable[[bytes], bytes]) -> tuple[list[int], list[bytes]]:
    """The (id, packed content) of packed rows, each id once, whose ids without their last ``shift`` bits are asked for."""
    asked, seen, ids, packed = np.unique(asked), set(), [], []
    for blob in blobs if asked.size else ():
        table = pa.ipc.open_stream(blob.as_buffer()).read_all()
        own = table["id"].to_numpy()
        for k in np.flatnonzero(np.isin(own >> shift, asked)).tolist():
            if (item := int(own[k])) not in seen:
                seen.add(item)
                ids.append(item)
                packed.append(pack(table["content"][k].as_py()))
    return ids, packed


def content_batches(ids: np.ndarray, contents: list[bytes], parts: int, shift: int = 0) -> pa.RecordBatch:
    """Rows (part, blob) of distinct items' contents, dealt out by id without its last ``shift`` bits."""
    _, at = np.unique(ids, return_index=True)
    of = np.mod(ids[at] >> shift, parts)
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    rows = [[], []]
    for a, b in zip(first, [*first[1:], of.size], strict=True):
        rows[0].append(int(of[a]))
        rows[1].append(pack_rows(ids[at[a:b]].tolist(), [contents[i] for i in at[a:b]]))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], schema=KEYS)


def with_contents(blobs: DataFrame, parts: int, shift: int) -> Callable[[DataFrame], DataFrame]:
    """A join of rows with the contents in ``blobs`` of the items whose ids, without their last ``shift`` bits, the rows have: rows of
    the whole ids, with ``packed``, the contents as they are.  They go straight to the rows; no table of them is kept."""

    def join(rows: DataFrame) -> DataFrame:
        names = rows.columns

        def attach(asked: pa.Table, table: pa.Table) -> pa.Table:
            ids, packed = wanted_rows(asked["id"].to_numpy(), table["blob"], shift, bytes)
            short = np.array(ids, np.int64) >> shift
            order = np.argsort(short, kind="stable")
            own = asked["id"].to_numpy()
            first, last = (np.searchsorted(short[order], own, side=side) for side in ("left", "right"))
            row = np.repeat(np.arange(own.size), last - first)
            at = order[np.repeat(first, last - first) + np.arange(row.size) - np.repeat(np.cumsum(last - first) - (last - first), last - first)]
            out = asked.select(names).take(pa.array(row))
            out = out.set_column(names.index("id"), "id", pa.array(np.array(ids, np.int64)[at]))
            out = out.append_column("packed", pa.array(packed, pa.binary()).take(pa.array(at)))
            release()
            return out

        asked = rows.withColumn("part", F.pmod("id", F.lit(parts)).cast("int"))
        spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", packed binary"
        return asked.groupBy("part").cogroup(blobs.groupBy("part")).applyInArrow(attach, spec)

    return join


def in_blocks(rows: DataFrame, join: Callable[[DataFrame], DataFrame], chunk: int, block_rows: int, kernel: Callable[[], Callable[[pa.Table], pa.Table]], schema: str) -> DataFrame:
    """What ``kernel()`` makes of each block of the rows (leader, id, ...), which ``join`` gives their items' ``packed`` contents.

    A block's table holds whole groups of up to ``chunk`` rows, about ``block_rows`` in all, or one chunk of a larger group, or two:
    there ``low`` and ``high`` differ, ``half`` says which chunk a row is of, and only pairs across them are the block's own.
    """
    blocks = max(1, rows.count() // block_rows)
    large = rows.groupBy("leader").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    large = large.select("leader", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    placed = salted.join(large, ["leader", "salt"], "left").drop("salt")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")
    # each row of a large group meets every chunk of it, its own one too
    met = placed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    block = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("leader"), F.lit(blocks))).otherwise(F.col("leader"))
    met = met.select(F.col("chunks").isNull().alias("small"), block.alias("block"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *rows.columns, (F.col("own") > F.col("other")).cast("int").alias("half"))

    def run(table: pa.Table) -> pa.Table:
        out = kernel()(table)
        release()
        return out

    return join(met).groupBy("small", "block", "low", "high").applyInArrow(run, schema)


def merged_groups(rows: DataFrame) -> DataFrame:
    """The rows (leader, id) with every group put into that of the smallest leader whose group its own leader is in.

    A family of similar items has a leader for each of its buckets; so it becomes few groups, and its pairs are compared once.
    """
    lower = checkpointed(rows.filter("id != leader").groupBy(F.col("id").alias("leader")).agg(F.min("leader").alias("lower")))
    return checkpointed(rows.join(lower, "leader", "left").select(F.coalesce("lower", "leader").alias("leader"), "id").distinct())


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the pairs (a, b) of items below n connect what those before them do not."""
    up, kept = list(range(n)), []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            kept.append(k)
    return kept


def classes(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked item is connected to, by alternating large and small stars."""
    edges = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct()
    before = None
    while True:
        # large star: a node's larger neighbours are hung on its smallest one; a hub has no smaller one, and no row here
        lower = checkpointed(edges.groupBy("high").agg(F.min("low").alias("m")))
        large = edges.join(lower.select(F.col("high").alias("low"), "m"), "low", "left").select(F.coalesce("m", "low").alias("low"), "high").distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(lowest, "high").filter("low != m").select(F.col("m").alias("low"), F.col("low").alias("high")).union(lowest.select(F.col("m").alias("low"), "high"))
        edges = checkpointed(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("root"))
        before = now
