"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model trained on trusted text.

1. Trusted documents (by labels) give counts of character 4-grams; a tenth of them, by hash, is held out.  Counts are
   summed in each task, then by shard, where a shard holds all counts that meet in one probability.
2. Each block of documents asks the shards for the probabilities of its distinct 4-grams, and gets them back by block;
   questions of one shard are salted over several copies of its counts.  Documents meet their block's answers, and sum
   them to their perplexity.
3. For each language a quantile of the held-out documents' perplexities is the threshold, drawn towards the quantile over
   all languages by ``ENOUGH`` documents' worth of it.  The quantile of a small sample is too low: all thresholds are raised
   by an allowance that falls from ``TOLERANCE`` to 1 as held-out documents become many, at the same rate for all languages.
   It is held against the ``score``: the perplexity, short texts drawn towards the language's mean by ``PRIOR`` symbols' worth
   of it.

Labels are broadcast below ``BROADCAST_ROWS`` rows and joined by shuffle beyond.  The discounts and lowest-order counts
go to the driver: at most ``SYMBOLS + 12`` numbers a language.

Defined results: null and empty texts have no symbols, a null perplexity, and are kept; so is everything where no
trusted text exists.  A null language is a language.  A document labelled twice is trusted if any label says so and none
says otherwise.  Repeated rows are scored each.  ``classify`` ignores other columns; ``keep_good`` returns its input's, whatever
their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import ship

from . import kneser_ney as kn
from ._frames import checkpointed, release, releasing

#: Labelled rows up to which they are broadcast: 8 bytes each.
BROADCAST_ROWS = 4_000_000
#: Copies of each shard's counts that its questions are dealt to.
SALTS = 8
#: Consecutive ids that share a block of documents.
NEIGHBOURS = 512
#: Distinct n-grams that a task holds before it hands them on.
HELD_GRAMS = 1_000_000
#: All trusted text makes one model, so that mixed or mistagged languages are no fault of a text; thresholds are by language.
MODEL = 0
QUANTILE, TOLERANCE, PRIOR = 0.99, 1.5, 60
#: Held-out documents at which a language's own figures weigh half, and at which half of the tolerance is left.
ENOUGH = 20


def _squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.diff(array, prepend=array.dtype.type(0)).tobytes())


def _codes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint64), dtype=np.uint64)


def _numbers(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(array.tobytes())


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def marked(df: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``mark``: 1 for trusted text to train on, 2 for trusted text held out, else 0."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    trusted = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good").drop("good")
    if trusted.count() <= BROADCAST_ROWS:
        trusted = F.broadcast(trusted)
    mark = F.when(F.col("trusted_id").isNull(), 0).when(F.pmod(F.xxhash64("trusted_id"), F.lit(10)) == 0, 2).otherwise(1)
    return df.join(trusted, F.col(id_col) == F.col("trusted_id"), "left").withColumn("mark", mark).drop("trusted_id")


def shard_counts(df: DataFrame, text_col: str, shards: int) -> DataFrame:
    """(shard, codes, counts): the 4-gram counts of all of ``df``, one row a shard."""

    def partial(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for codes, counts in held.values():
                codes, counts = kn.merged(np.concatenate(codes), np.concatenate(counts))
                of = kn.shard_of(codes, shards)
                for s in np.unique(of):
                    yield int(s), _squeeze(codes[of == s]), _pack(counts[of == s])
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                grams, n = np.unique(kn.ngrams(text.as_py() or "", MODEL), return_counts=True)
                own = held.setdefault(0, [[], []])
                own[0].append(grams)
                own[1].append(n.astype(np.int64))
                size += grams.size
                if size > HELD_GRAMS:
                    codes, counts = kn.merged(np.concatenate(own[0]), np.concatenate(own[1]))
                    own[0], own[1], size = [codes], [counts], codes.size
                    if size > HELD_GRAMS // 2:
                        yield _batch(flush(), COUNTS)
                        size = 0
        if held:
            yield _batch(flush(), COUNTS)

    def total(table: pa.Table) -> pa.Table:
        codes = [_codes(b) for b in table["codes"].to_pylist()]
        counts = [_numbers(b, np.int64) for b in table["counts"].to_pylist()]
        codes, counts = kn.merged(np.concatenate(codes), np.concatenate(counts))
        return pa.Table.from_batches([_batch([(table["shard"][0].as_py(), _squeeze(codes), _pack(counts))], COUNTS)])

    spec = "shard int, codes binary, counts binary"
    return df.select(F.col(text_col).cast("string")).mapInArrow(releasing(partial), spec).groupBy("shard").applyInArrow(total, spec)


COUNTS = pa.schema([("shard", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
ASKED = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("block", pa.int64()), ("codes", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("logs", pa.binary())])
ROWS = pa.schema([("block", pa.int64()), ("rows", pa.binary())])


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def statistics(counts: DataFrame) -> kn.Statistics:
    """The sums over all shards that every probability needs."""

    def per_shard(batches):
        for batch in batches:
            for _, codes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = kn.Shard(_codes(codes), _numbers(n, np.int64)).statistics()
                yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "level": [k[1] for k in found], "j": [k[2] for k in found], "n": list(found.values())}, schema=pa.schema([("lang", pa.int64()), ("level", pa.int64()), ("j", pa.int64()), ("n", pa.int64())]))

    rows = counts.mapInArrow(per_shard, "lang long, level long, j long, n long").groupBy("lang", "level", "j").agg(F.sum("n").alias("n")).collect()
    return kn.Statistics({(r.lang, r.level, r.j): r.n for r in rows})


def scored(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, carry: bool) -> DataFrame:
    """doc_id, lang, n_symbols, nll, mark, each text's negative log-likelihood, and with ``carry`` the text and the input's k-th column as ``_k``."""
    ship(df.sparkSession)
    # the input's own columns go under numbers, so that no name of theirs meets one of these
    others = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(df.columns) if c != text_col] if carry else []
    own = [F.col(f"`{c}`").cast(kind).alias(name) for c, kind, name in ((id_col, "long", "doc_id"), (text_col, "string", "text"), (lang_col, "string", "lang"))]
    rows = marked(df.select(*own, *others), labels)
    shards = _partitions(df)
    blocks = 2 * shards
    counts = checkpointed(shard_counts(rows.filter("mark = 1"), "text", shards))
    known = df.sparkSession.sparkContext.broadcast(statistics(counts))

    def ask(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for block, codes in held.items():
                distinct = np.unique(np.concatenate(codes))
                of = kn.shard_of(distinct, shards)
                for s in np.unique(of):
                    yield int(s), block % SALTS, block, _squeeze(distinct[of == s])
            held.clear()

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.unique(kn.ngrams(text.as_py() or "", MODEL))
                held.setdefault(block, []).append(grams)
                size += grams.size
            if size > 2 * HELD_GRAMS:
                for block, codes in held.items():
                    held[block] = [np.unique(np.concatenate(codes))]
                size = sum(c[0].size for c in held.values())
                if size > HELD_GRAMS:
                    yield _batch(flush(), ASKED)
                    size = 0
        if held:
            yield _batch(flush(), ASKED)

    def answer(model: pa.Table, asked: pa.Table) -> pa.Table:
        codes = [_codes(b) for b in model["codes"].to_pylist()]
        numbers = [_numbers(b, np.int64) for b in model["counts"].to_pylist()]
        shard = kn.Shard(np.concatenate([np.zeros(0, np.uint64), *codes]), np.concatenate([np.zeros(0, np.int64), *numbers]))
        by_block: dict[int, list] = {}
        for block, blob in zip(asked["block"].to_pylist(), asked["codes"].to_pylist(), strict=True):
            by_block.setdefault(block, []).append(blob)
        out = []
        for block, blobs in by_block.items():
            wanted = np.unique(np.concatenate([_codes(b) for b in blobs]))
            out.append((block, _squeeze(wanted), _pack(kn.log_probabilities(shard, known.value, wanted).astype(np.float32))))
        release()
        return pa.Table.from_batches([_batch(out, ANSWERS)])

    def pack(batches):
        for batch in batches:
            of = batch.column(batch.num_columns - 1).to_numpy()
            batch = batch.select(batch.schema.names[:-1])
            order = np.argsort(of, kind="stable")
            bounds = np.flatnonzero(np.diff(of[order], prepend=-1))
            out = []
            for a, b in zip(bounds, [*bounds[1:], of.size], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.take(pa.array(order[a:b])))
                out.append((int(of[order[a]]), sink.getvalue().to_pybytes()))
            if out:
                yield _batch(out, ROWS)

    plain = [f for f in rows.schema.fields if carry or f.name != "text"]
    result = T.StructType([*plain, T.StructField("n_symbols", T.LongType()), T.StructField("nll", T.DoubleType())])

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        codes = np.concatenate([np.zeros(0, np.uint64), *(_codes(b) for b in answers["codes"].to_pylist())])
        logs = np.concatenate([np.zeros(0, np.float32), *(_numbers(b, np.float32) for b in answers["logs"].to_pylist())])
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order].astype(np.float64)
        out = []
        for blob in packed["rows"].to_pylist():
            table = pa.ipc.open_stream(blob).read_all()
            sizes, sums = [], []
            for text in table["text"].to_pylist():
                grams, n = np.unique(kn.ngrams(text or "", MODEL), return_counts=True)
                sizes.append(int(n.sum()))
                sums.append(round(-float((logs[np.searchsorted(codes, grams)] * n).sum()), 4) if grams.size else 0.0)
            table = table.select([f.name for f in plain])
            out.append(table.append_column("n_symbols", pa.array(sizes, pa.int64())).append_column("nll", pa.array(sums, pa.float64())))
        release()
        return pa.concat_tables(out)

    # neighbours in id order, which files tend to hold together, share a block and so ask for each n-gram once
    near_ids = F.floor(F.col("doc_id") / NEIGHBOURS)
    block = F.pmod(F.xxhash64(F.coalesce(near_ids, F.xxhash64("text"))), F.lit(blocks)).alias("block")
    copies = counts.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    asked = rows.select(block, "text").mapInArrow(releasing(ask), "shard int, salt int, block long, codes binary")
    answers = copies.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(answer, "block long, codes binary, logs binary")
    packed = rows.select("*", block).mapInArrow(releasing(pack), "block long, rows binary")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, result)


def judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, carry: bool) -> DataFrame:
    """What ``scored`` gives, with perplexity, score, threshold and keep."""
    scores = checkpointed(scored(df, labels, id_col, text_col, lang_col, carry))
    held = scores.filter("mark = 2 AND n_symbols > 0").select(F.col("lang").alias("held_lang"), "n_symbols", "nll")
    held = held.withColumn("no_lang", F.col("held_lang").isNull()).withColumn("held_lang", F.coalesce("held_lang", F.lit("")))
    mean = F.sum("nll") / F.sum("n_symbols")
    both = held.select("*", F.lit(True).alias("own")).unionByName(held.select(F.lit("").alias("held_lang"), "n_symbols", "nll", F.lit(False).alias("no_lang"), F.lit(False).alias("own")))
    keys = ["own", "no_lang", "held_lang"]
    means = both.groupBy(*keys).agg(F.round(mean, 6).alias("mean"), F.count("*").alias("held"))
    all_mean = means.filter("NOT own").select("mean").scalar()
    share = F.when(F.col("own"), F.col("held") / (F.col("held") + ENOUGH)).otherwise(1.0)
    means = means.withColumn("share", share).withColumn("mean", F.col("share") * F.col("mean") + (1 - F.col("share")) * all_mean)
    # the quantile over steps of a thousandth: exact on that grid, and its table has a bounded number of rows
    step = F.ceil((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n_symbols") + PRIOR) * 1000)
    bins = both.join(means, keys).groupBy(*keys, "mean", "held", "share", step.alias("step")).agg(F.count("*").alias("n"))
    rising = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    cuts = bins.withColumn("upto", F.sum("n").over(rising)).filter(F.col("upto") >= QUANTILE * F.col("held")).groupBy(*keys, "mean", "held", "share").agg((F.min("step") / 1000.0).alias("cut"))
    pooled = cuts.filter("NOT own")
    all_cut, all_held = pooled.select("cut").scalar(), pooled.select("held").scalar()
    own = cuts.filter("own").select("no_lang", "held_lang", F.col("mean").alias("own_mean"), F.col("cut").alias("own_cut"), "share")
    named = scores.withColumn("no_lang", F.col("lang").isNull()).withColumn("held_lang", F.coalesce("lang", F.lit("")))
    joined = named.join(own, ["no_lang", "held_lang"], "left").withColumn("own_mean", F.coalesce("own_mean", all_mean))
    joined = joined.withColumn("own_cut", F.coalesce(F.col("share") * F.col("own_cut") + (1 - F.col("share")) * all_cut, all_cut)).withColumn("all_held", all_held)
    drawn = F.when(F.col("n_symbols") > 0, (F.col("nll") + PRIOR * F.coalesce("own_mean", F.lit(0.0))) / (F.col("n_symbols") + PRIOR))
    threshold = F.exp("own_cut") * F.pow(F.lit(TOLERANCE), ENOUGH / (ENOUGH + F.col("all_held")))
    plain = F.when(F.col("n_symbols") > 0, F.exp(F.col("nll") / F.col("n_symbols")))
    kept = F.coalesce(F.exp(drawn) <= threshold, F.lit(True))
    return joined.select(*(c for c in scores.columns if c not in ("nll", "mark")), F.round(plain, 6).alias("perplexity"), F.round(F.exp(drawn), 6).alias("score"), F.round(threshold, 6).alias("threshold"), kept.alias("keep"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, score, threshold, keep): a document is kept if its score is at most its threshold."""
    return judged(df, labels, id_col, text_col, lang_col, False)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with its columns."""
    kept = judged(df, labels, id_col, text_col, lang_col, True).filter("keep")
    return kept.select(*((F.col("text").cast(df.schema[c].dataType) if c == text_col else F.col(f"_{k}")).alias(c) for k, c in enumerate(df.columns)))
