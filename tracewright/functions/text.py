"""Text columns: tokens, stems, term statistics and ranking formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import CAMEL

# The words that carry no search signal, and the stemmer's suffixes in the order they are tried.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with",
    "self", "cls", "none", "return", "returns", "def", "class", "py",
)
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ers", "er", "ed", "es", "s", "e")
#: The usual saturation and length weights of BM25.
K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def _cut(word: Column) -> Column:
    cut = word
    for suffix in reversed(SUFFIXES):
        put = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        cut = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 3), F.concat(put, F.lit("y")) if suffix == "ies" else put).otherwise(cut)
    return cut


def stem(word: Column) -> Column:
    """A light suffix stemmer over lower-case words; words with digits and short words stay."""
    # as the element of an array of one, the cut word is worked out once
    return F.transform(F.array(_cut(word)), lambda cut: _stem(word, cut))[0]


def _stem(word: Column, cut: Column) -> Column:
    last, before = F.substring(cut, -1, 1), F.substring(cut, F.length(cut) - 1, F.lit(1))
    folded = F.when((F.length(cut) > 3) & (last == before) & ~last.isin("l", "s", "z"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)
    plural = F.when(word.endswith("s") & ~(word.endswith("ss") | word.endswith("us") | word.endswith("is")), F.substring(word, 1, 3)).otherwise(word)
    return F.when(~word.rlike(r"^\p{L}+$"), word).when(F.length(word) == 4, plural).when(F.length(word) < 4, word).otherwise(folded)


def stem_sql(w: str) -> str:
    """``stem`` as DuckDB SQL over an expression."""
    tests = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= 3 THEN substr({w}, 1, length({w}) - {len(s)}){" || 'y'" if s == 'ies' else ''}" for s in SUFFIXES)
    cut = f"(CASE {tests} ELSE {w} END)"
    return (
        f"CASE WHEN NOT regexp_full_match({w}, '\\p{{L}}+') THEN {w} WHEN length({w}) = 4 THEN CASE WHEN {w} LIKE '%s' AND NOT ({w} LIKE '%ss' OR {w} LIKE '%us' OR {w} LIKE '%is') "
        f"THEN substr({w}, 1, 3) ELSE {w} END WHEN length({w}) < 4 THEN {w} "
        f"WHEN length({cut}) > 3 AND substr({cut}, length({cut}), 1) = substr({cut}, length({cut}) - 1, 1) AND substr({cut}, length({cut}), 1) NOT IN ('l', 's', 'z') "
        f"THEN substr({cut}, 1, length({cut}) - 1) ELSE {cut} END"
    )


def words(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, w), one row a word; underscores part words."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.translate(F.col(text_col), "_", " "), F.lit(f"({WORD})"), F.lit(1))).alias("w"))


CAMEL_EDGE = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]"


def word_tokens(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, token) of the rows (keys, w): stems of words and of the parts of ASCII camel-case words."""
    return _stemmed(words.select(*keys, F.lower("w").alias("t")), *keys).unionByName(part_tokens(words, *keys))


def part_tokens(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, token): stems of the parts of ASCII camel-case words of two parts or more."""
    camel = words.filter(F.col("w").rlike(CAMEL_EDGE) & F.col("w").rlike("^[A-Za-z0-9]+$"))
    parts = camel.select(*keys, F.regexp_extract_all("w", F.lit(f"({CAMEL})"), F.lit(1)).alias("p")).filter(F.size("p") > 1)
    return _stemmed(parts.select(*keys, F.explode("p").alias("t")).select(*keys, F.lower("t").alias("t")), *keys)


def _stemmed(low: DataFrame, *keys: str) -> DataFrame:
    # the cut word is a column of its own, so that it is worked out once and in generated code
    cut = low.filter(~F.col("t").isin(*STOPWORDS)).select(*keys, "t", _cut(F.col("t")).alias("_cut"))
    return cut.select(*keys, _stem(F.col("t"), F.col("_cut")).alias("token"))


def snake_tokens(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, token): whole snake-case names."""
    some = df.filter(F.contains(F.col(text_col), F.lit("_")))
    names = some.select(*keys, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1))).alias("t"))
    return names.filter(F.col("t").rlike("[^_]_+[^_]")).select(*keys, F.lower("t").alias("token"))


def tokens(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, token), one row a token: stems of words, stems of the parts of ASCII camel-case words, whole snake-case names."""
    # texts without an edge of camel case have no such word, and are not cut into words again
    some = df.filter(F.col(text_col).rlike(CAMEL_EDGE))
    low = words(df, text_col, *keys).select(*keys, F.lower("w").alias("t"))
    return _stemmed(low, *keys).unionByName(part_tokens(words(some, text_col, *keys), *keys)).unionByName(snake_tokens(df, text_col, *keys))


def term_frequencies(df: DataFrame, fields: dict[str, float], *keys: str) -> DataFrame:
    """(keys, term, tf): each field's tokens count its weight.

    Words are counted before they are stemmed, and each different word is stemmed once, however many rows have it.
    """
    counted = named = None
    for field, weight in fields.items():
        plain = words(df, field, *keys).filter(~F.col("w").isin(*STOPWORDS))
        own = plain.groupBy(*keys, "w").agg((F.count("*") * F.lit(float(weight))).alias("n"))
        names = snake_tokens(df, field, *keys).select(*keys, F.col("token").alias("term"), F.lit(float(weight)).alias("n"))
        counted, named = (own, names) if counted is None else (counted.unionByName(own), named.unionByName(names))
    stems = word_tokens(counted.select("w").distinct(), "w")
    parts = counted.join(stems, "w").select(*keys, F.col("token").alias("term"), "n").unionByName(named)
    return parts.groupBy(*keys, "term").agg(F.sum("n").alias("tf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, n_docs: Column, length: Column, average: Column) -> Column:
    norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(average, F.lit(1e-9))))
    return idf(n_docs, df) * norm


def register(spark) -> None:
    """The ranking formula and the stemmer as functions of SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tw_bm25(tf DOUBLE, df DOUBLE, n DOUBLE, len DOUBLE, avg DOUBLE) RETURNS DOUBLE "
        f"RETURN ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * ({K1}D + 1) / (tf + {K1}D * (1 - {B}D + {B}D * len / greatest(avg, 1e-9D)))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tw_half_life(age DOUBLE, half DOUBLE) RETURNS DOUBLE RETURN pow(0.5D, age / half)")
