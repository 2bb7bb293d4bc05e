"""Mixing sources to target weights, by DataFrame expressions only.

1. Each source's documents are packed, in the order of a hash bucket and then their id, into one stream of words cut
   into blocks of ``block`` words.  Offsets come from per-bucket sums, so that no task sees a whole source.
2. Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words; a
   target stops at ``cap`` times its source, the excess going to the others by weight.
3. Every source has as many slots as its target needs: whole passes over its blocks, then a part of one more whose
   last slot is cut to the word.  A pass visits the blocks in a pseudorandom permutation of its own: a block's slot is its
   rank by the hash of (seed, source, pass, index), found from counts by range of the hash and ranks within a range.
4. Slots are thrown on the output shards pseudorandomly and independently, so that the counts of each source over the
   shards are a multinomial draw whose total is exactly the source's target; within a shard, slots are ordered by hash.
5. Slots and blocks are joined by (source, index).

Joins of tables that grow with the input ask for a sort-merge join: their rows compress so well in the shuffle that Spark would
broadcast them.  The table of sources alone is left to be broadcast by its size.

Everything follows from hashes of the data and ``seed``: reruns agree, whatever the partitioning.

Defined results: null and empty texts have size 0 and are never taken; documents of size 0 alone make targets of 0.
A null source is a source.  Repeated rows are documents of their own.  Null ids are ids that sort first.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets that a source's documents are dealt to for packing: a source's share of one bucket is one task's work.
BUCKETS = 4096
#: Slots that one row stands for before they are made.
CHUNK = 4096
#: Ranges of the hashes by which a pass's blocks are ranked.
RANGES = 4096
#: A word with the white space after it, and at a text's start before it.
TOKEN = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def hash48(*parts: Column) -> Column:
    """A pseudorandom integer below 2^48 that any SQL engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary")), 1, 12), 16, 10).cast("long")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, keep_text: bool = False) -> DataFrame:
    """Rows as (doc_id, source, size, bucket), and a row's hash or nothing to tell equal ids apart."""
    text = F.col(text_col).cast("string")
    out = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.xxhash64(F.col(id_col).isNull(), F.col(source_col).isNull(), F.col(source_col).cast("string"), text) if keep_text else F.lit(0).cast("long")).alias("mark"),
        *([text.alias("text")] if keep_text else []),
    )
    return out.withColumn("bucket", (hash48(F.col("doc_id"), F.col("size")) % BUCKETS).cast("int"))


def source_targets(docs: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, sid, source_size, target): a row per source; the rows of this table are few whatever the input's size."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight)
    # a source stops at its cap if its cap per weight is at most what the sources that stop no earlier would get
    rising = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), "sid")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    limit = F.col("source_size") * F.lit(float(cap))
    poured = (
        ranked.withColumn("limit", limit)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stops", F.col("limit") * F.col("rest") <= F.col("budget") * F.col("weight"))
        .withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("sid"), (F.col("budget") / F.col("rest")).alias("level")))).over(everything)["level"])
    )
    return poured.select("source", "sid", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def packed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's numbers and ``start``, their first word's place in the source's stream; (sid, bucket, place) is a key."""
    named = docs.withColumn("no_source", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit("")))
    numbers = sources.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key"), "sid", "source_size", "target")
    dealt = named.join(numbers, ["no_source", "key"]).drop("no_source", "key")
    sums = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first"))
    order = Window.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "mark")
    return (
        dealt.join(starts.hint("merge"), ["sid", "bucket"])
        .withColumn("place", F.row_number().over(order))
        .withColumn("start", F.col("first") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("first")
    )


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, index, takes, shard, slot, place_hash): every slot of the mix, the block it takes and how many of its words."""
    n = F.col("n")
    plan = (
        sources.filter("source_size > 0")
        .select(
            "sid", "source_size",
            F.ceil(F.col("source_size") / block).cast("long").alias("n"),
            F.floor("target").cast("long").alias("words"),
        )
        .withColumn("passes", F.expr("words div source_size"))
        .withColumn("part", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("last", F.col("source_size") - (n - 1) * block)
        # a part pass meets the short last block at most once, and so needs at most one slot more
        .withColumn("count", F.col("passes") * n + F.when(F.col("part") > 0, F.least(n, F.ceil(F.col("part") / block).cast("long") + 1)).otherwise(0))
        .filter("count > 0")
    )
    shards = F.greatest(F.lit(1), F.ceil(F.sum("count").over(Window.partitionBy()) / shard_slots).cast("long"))
    chunks = plan.withColumn("shards", shards).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    blocks = (
        chunks.repartition("sid", "chunk")
        .withColumn("index", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(n, (F.col("chunk") + 1) * CHUNK) - 1)))
        .withColumn("pass", F.explode(F.expr("sequence(0L, passes - if(part > 0, 0, 1))")))
        .withColumn("drawn", hash48(F.lit(seed), F.col("sid"), F.col("pass"), F.col("index")))
        .withColumn("range", F.expr(f"drawn div {(1 << 48) // RANGES}"))
    )
    counts = blocks.groupBy("sid", "pass", "range").agg(F.count("*").alias("own"))
    earlier = Window.partitionBy("sid", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sid", "pass", "range", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("sid", "pass", "range").orderBy("drawn", "index"))
    ranked = blocks.join(starts.hint("merge"), ["sid", "pass", "range"]).withColumn("m", F.col("first") + rank - 1)
    # the short last block: a row for each source and pass
    short = ranked.filter("index = n - 1").select("sid", "pass", F.col("m").alias("at_last"))
    each = ranked.join(short, ["sid", "pass"])
    before = F.col("m") * block - F.when(F.col("m") > F.col("at_last"), block - F.col("last")).otherwise(0)
    whole = F.when(F.col("index") == n - 1, F.col("last")).otherwise(block)
    takes = F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(whole, F.greatest(F.lit(0), F.col("part") - before)))
    slot = F.col("pass") * n + F.col("m")
    thrown = hash48(F.lit(seed + 1), F.col("sid"), F.col("slot"))
    each = each.withColumn("slot", slot).withColumn("takes", takes.cast("long")).filter("takes > 0").withColumn("thrown", thrown)
    return each.select("sid", "index", "takes", (F.col("thrown") % F.col("shards")).alias("shard"), "slot", F.expr("thrown div shards").alias("place_hash"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """(sid, index, bucket, place, doc_id, begin, in_block, n): the part of each document that lies in each block."""
    cut = rows.filter("size > 0").select("sid", "bucket", "place", "doc_id", "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("index"))
    low, high = F.greatest("start", F.col("index") * block), F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    return cut.select("sid", "index", "bucket", "place", "doc_id", (low - F.col("start")).alias("begin"), (low - F.col("index") * block).alias("in_block"), (high - low).alias("n"))


def taken_pieces(rows: DataFrame, sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """Pieces joined with the slots that take them; ``n`` is what a slot takes of a piece."""
    cut = slots(sources, block, shard_slots, seed)
    return pieces(rows, block).join(cut.hint("merge"), ["sid", "index"]).withColumn("n", F.least("n", F.col("takes") - F.col("in_block"))).filter("n > 0")


def mix(
    df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, block: int = 128, shard_slots: int = 4096, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_shards): what the mix takes of each document, repeats counted, and on how
    many output shards the draw puts it."""
    docs = sized(df, id_col, text_col, source_col)
    sources = source_targets(docs, weights, share, cap)
    rows = packed(docs, sources)
    taken = taken_pieces(rows, sources, block, shard_slots, seed).groupBy("sid", "bucket", "place").agg(F.sum("n").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"))
    both = rows.join(taken.hint("merge"), ["sid", "bucket", "place"], "left")
    return both.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")))


def mixed_pieces(
    df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, block: int = 128, shard_slots: int = 4096, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(shard, place_hash, slot, sid, in_block, doc_id, begin, n_words, ends, text), a row for each piece of a slot's block.

    A piece's text has the white space of its document; ``begin`` is its first word's place there, and ``ends`` says that its
    last word is the document's.  Texts are shuffled once; a document meets all its pieces by the row's hash, and the equal
    rows of a document that is there several times, which are interchangeable, by number.
    """
    docs = sized(df, id_col, text_col, source_col, keep_text=True)
    bare = docs.drop("text")
    sources = source_targets(bare, weights, share, cap)
    nth = F.row_number().over(Window.partitionBy("sid", "bucket", "doc_id", "mark").orderBy("place"))
    rows = packed(bare, sources).withColumn("nth", nth)
    key = F.coalesce("doc_id", F.lit(0).cast("long")).alias("key")
    marks = rows.select("sid", "bucket", "place", key, "mark", "nth", "size")
    wanted = taken_pieces(rows, sources, block, shard_slots, seed).join(marks.hint("merge"), ["sid", "bucket", "place"])
    piece = F.struct("nth", "shard", "place_hash", "slot", "sid", "in_block", "begin", F.col("n").alias("n_words"), (F.col("begin") + F.col("n") == F.col("size")).alias("ends"))
    gathered = wanted.groupBy("key", "mark").agg(F.collect_list(piece).alias("pieces"))
    own = F.row_number().over(Window.partitionBy("key", "mark").orderBy("size")).alias("nth")
    texts = docs.select("doc_id", key, "mark", "size", "text").select("*", own)
    words = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    names = ("shard", "place_hash", "slot", "sid", "in_block", "begin", "n_words", "ends")

    def cut(w):
        # a text is split once, for all its pieces
        text = lambda p: F.array_join(F.slice(w, p["begin"].cast("int") + 1, p["n_words"].cast("int")), "")
        return F.transform(F.filter("pieces", lambda p: p["nth"] == F.col("nth")), lambda p: F.struct(*(p[c].alias(c) for c in names), text(p).alias("text")))

    each = texts.join(gathered.hint("merge"), ["key", "mark"]).select("doc_id", F.explode(F.flatten(F.transform(F.array(words), cut))).alias("p"))
    return each.select("doc_id", "p.*")


def mixed_blocks(df: DataFrame, **parameters) -> DataFrame:
    """The mixed text, a row for each slot: (shard, place_hash, sid, slot, doc_ids, n_words, text).

    Blocks have ``block`` words, but for the last one of a source's stream and the last one that its target takes.  A line feed
    parts documents.  Sorting a shard by (place_hash, sid, slot) gives its order.  Parameters are those of ``mixed_pieces``.
    """
    pieces = mixed_pieces(df, **parameters)
    text = F.concat("text", F.when(F.col("ends"), "\n").otherwise(""))
    held = pieces.groupBy("shard", "place_hash", "sid", "slot").agg(F.sort_array(F.collect_list(F.struct("in_block", "doc_id", text.alias("text")))).alias("held"), F.sum("n_words").alias("n_words"))
    return held.select("shard", "place_hash", "sid", "slot", F.col("held.doc_id").alias("doc_ids"), "n_words", F.array_join("held.text", "").alias("text"))


def mix_sql(table: str = "documents", block: int = 128, shard_slots: int = 4096, seed: int = 17) -> str:
    """DuckDB SQL for ``mix`` with its default parameters: the same hashes, offsets, targets, permutations and draws."""
    number = "CAST(('0x' || substr(md5({0}), 1, 12)) AS BIGINT)"
    return f"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
bucketed AS (SELECT *, {number.format("coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)")} % {BUCKETS} AS bucket FROM docs),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sources),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(sid - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS lim FROM ranked),
poured AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0.0::DOUBLE) AS budget,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS rest FROM weighed
  WINDOW b AS (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, lim * rest <= budget * weight AS stops FROM poured),
targets AS (
  SELECT source, sid, source_size, CASE WHEN stops THEN lim ELSE weight * (SELECT arg_min(budget / rest, (source_size / weight, sid)) FROM levelled WHERE NOT stops) END AS target FROM levelled),
placed AS (
  SELECT row_number() OVER () AS row, b.doc_id, b.size, b.bucket, t.sid, t.source_size, t.target FROM bucketed b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
started AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM placed),
plan AS (
  SELECT sid, source_size, (source_size + {block - 1}) // {block} AS n, CAST(floor(target) AS BIGINT) // source_size AS passes,
    CAST(floor(target) AS BIGINT) % source_size AS part, source_size - ((source_size + {block - 1}) // {block} - 1) * {block} AS last FROM targets WHERE source_size > 0),
counted AS (
  SELECT *, passes * n + CASE WHEN part > 0 THEN least(n, (part + {block - 1}) // {block} + 1) ELSE 0 END AS slots FROM plan),
blocks AS (
  SELECT *, unnest(range(0, n)) AS index FROM (
    SELECT *, unnest(range(0, passes + CASE WHEN part > 0 THEN 1 ELSE 0 END)) AS pass,
      greatest(1, (CAST(sum(slots) OVER () AS BIGINT) + {shard_slots - 1}) // {shard_slots}) AS shards FROM counted WHERE slots > 0)),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY sid, pass ORDER BY {number.format(f"'{seed}:' || CAST(sid AS VARCHAR) || ':' || CAST(pass AS VARCHAR) || ':' || CAST(index AS VARCHAR)")}, index) - 1 AS m FROM blocks),
placed_last AS (SELECT *, max(CASE WHEN index = n - 1 THEN m END) OVER (PARTITION BY sid, pass) AS at_last FROM turned),
takes AS (
  SELECT sid, index, {number.format(f"'{seed + 1}:' || CAST(sid AS VARCHAR) || ':' || CAST(pass * n + m AS VARCHAR)")} % shards AS shard,
    CASE WHEN pass < passes THEN whole ELSE least(whole, greatest(0, part - (m * {block} - CASE WHEN m > at_last THEN {block} - last ELSE 0 END))) END AS takes
  FROM (SELECT *, CASE WHEN index = n - 1 THEN last ELSE {block} END AS whole FROM placed_last)),
cut AS (SELECT row, sid, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS index FROM started WHERE size > 0),
pieces AS (
  SELECT row, sid, index, greatest(start, index * {block}) - index * {block} AS in_block, least(start + size, (index + 1) * {block}) - greatest(start, index * {block}) AS n FROM cut),
got AS (
  SELECT p.row, CAST(sum(least(p.n, t.takes - p.in_block)) AS BIGINT) AS taken, count(DISTINCT t.shard) AS n_shards
  FROM pieces p JOIN takes t ON p.sid = t.sid AND p.index = t.index AND t.takes > p.in_block GROUP BY p.row)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(g.taken, 0) AS taken, coalesce(g.n_shards, 0) AS n_shards FROM started s LEFT JOIN got g ON s.row = g.row
"""
