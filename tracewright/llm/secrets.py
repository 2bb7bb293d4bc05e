"""Secret scans by zstandard novelty.

Base patterns (assignments to credential names, access keys, long hexadecimal runs) are exact and always reported.
Besides, every long token on the line of a sensitive word, or shortly after one, is measured: the bytes that it adds to the compressed form of its
surroundings, where the compressor is primed with a dictionary of the corpus's most frequent identifiers and the
surroundings themselves.  Words, paths and names that occur elsewhere cost next to nothing; tokens that cost nearly
as much as random ones are reported as ``novel`` spans.

The identifiers are counted over all documents; the dictionary takes the most frequent ones up to ``DICTIONARY``
bytes, a bound of its size on the driver and in each task.  Novel tokens are looked up among all other identifiers by a
join, and those that are one are not reported.

Defined results: a null or empty text has no spans.  Spans are in code points, end exclusive.  Candidates that a base
span touches are left to it.  Repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import checkpointed, id_and_text, map_documents, to_batch

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
ORDER = {k: i for i, k in enumerate(KINDS)}


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Credential names, ASCII letters in either case.
ASSIGN = re.compile(
    "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
# Fixed list of sensitive words that make a nearby token a candidate.
SENSITIVE = re.compile(r"(?:passw|secret|token|api[_ -]?key|credential|private[_ -]?key|auth|bearer|signature|access[_ -]?key|client[_ -]?id)", re.IGNORECASE)
#: One of these is in the lower case of any match of SENSITIVE.
SENSITIVE_HINTS = ("passw", "secret", "token", "api", "credential", "private", "auth", "bearer", "signature", "access", "client")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{10,}+")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{2,63}+(?=[\"']? ?[:=(])")

#: Code points after a sensitive word in which tokens are candidates beyond its line, and on either side of one that are its surroundings.
REACH, AROUND = 80, 1024
#: Bytes of the identifier dictionary, and identifiers of three letters and a space that fill it.
DICTIONARY = 32_768
IDENTIFIERS = DICTIONARY // 4
#: Compressed bytes that a token adds beyond ``SLACK``, which frames vary by, as a share of its own, from which it is called incompressible.
NOVELTY, SLACK = 0.85, 1
# Fixed text of ordinary words that every measured frame begins with.
PRIMER = (
    "value name config index count request response handler manager service default option parameter message content version number string object result "
    "error status update create delete select insert first second before after between there would about people other which their information available "
    "user group client server session cache buffer stream record field table column list item node the and for that with this from have are was not "
    "function return import class public static private include define package module interface "
)


def mixed(token: str) -> bool:
    """Whether a token has letters with digits, or changes case as no name does: plain long words are no candidates."""
    if any(c.isdigit() for c in token):
        return any(c.isalpha() for c in token)
    return sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(token, token[1:], strict=False)) >= 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Long tokens on a sensitive word's line or shortly after it that no base span touches; each once."""
    found: list[tuple[int, int]] = []
    low = text.lower()
    if not any(h in low for h in SENSITIVE_HINTS):
        return []
    areas: list[list[int]] = []
    for m in SENSITIVE.finditer(text):
        after = min(len(text), m.end() + REACH)
        if areas and m.start() < areas[-1][1]:
            start = areas[-1][0]
        else:
            start = text.rfind("\n", 0, m.start()) + 1
        if not areas or after > areas[-1][1]:
            line = text.find("\n", m.end())
            end = max(after, len(text) if line < 0 else line)
            if areas and start <= areas[-1][1]:
                areas[-1][1] = end
            else:
                areas.append([start, end])
    for a, b in areas:
        for c in CANDIDATE.finditer(text, a, b):
            end = c.end()
            if end == b:  # the token goes on beyond the reach
                end = CANDIDATE.match(text, c.start()).end()
            token = text[c.start() : end]
            rest = SENSITIVE.sub("", token)  # names of what is secret are none
            if (rest == token or CANDIDATE.fullmatch(rest)) and mixed(rest) and not any(x < end and c.start() < y for x, y, _ in base):
                found.append((c.start(), end))
    return list(dict.fromkeys(found))


class Novelty:
    """Marginal compressed sizes, given a dictionary of identifiers."""

    def __init__(self, identifiers: list[str]):
        words = " ".join(identifiers).encode()
        # the most frequent come last, so the rare end is cut, at a whole name
        self.words = words if len(words) <= DICTIONARY else words[-DICTIONARY:].partition(b" ")[2]

    def of(self, text: str, start: int, end: int) -> float:
        """The compressed bytes that the token adds to its surroundings, as a share of its own bytes.

        Both frames hold the surroundings behind ``PRIMER``, which is long enough for entropy coding: letters that are common
        there cost about half a byte, so that a long name of words that no dictionary has is cheaper than a random string.
        """
        before, after = PRIMER + text[max(0, start - AROUND) : start], " " + text[end : end + AROUND]
        token = text[start:end]
        primed = zstandard.ZstdCompressor(
            level=9, dict_data=zstandard.ZstdCompressionDict(self.words + b" " + PRIMER.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False
        )
        with_token, without = (len(primed.compress(x.encode("utf-8", "surrogatepass"))) for x in (before + token + after, before + after))
        return (with_token - without - SLACK) / max(1, len(token.encode("utf-8", "surrogatepass")))


def counted_identifiers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the names that are assigned to, called or keyed, counted over all documents, from two on."""
    source = id_and_text(df, id_col, text_col)
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(1):
                counts.update(IDENTIFIER.findall(text.as_py() or ""))
            if counts:
                yield to_batch(list(counts.items()), arrow)

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


def identifiers(counted: DataFrame) -> list[str]:
    """The most frequent names, the very first last; ties go by code point."""
    top = counted.orderBy(F.desc("n"), "word").limit(IDENTIFIERS).collect()
    # zstandard reaches the end of a dictionary most cheaply: the most frequent come last
    return [r.word for r in reversed(top)]


def find_secrets(df: DataFrame, words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all reported spans, and the number of added ones."""
    counted = checkpointed(counted_identifiers(df, id_col, text_col)) if words is None else None
    words = identifiers(counted) if words is None else words
    span = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("token", pa.string())])
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("found", pa.list_(span))])

    def joined(spans):
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def make():
        novelty = Novelty(words)

        def each(doc_id, text):
            base = base_spans(text) if text else []
            novel = [(a, b, "novel") for a, b in candidates(text, base) if novelty.of(text, a, b) >= NOVELTY] if text else []
            both = sorted(base + novel, key=lambda s: (s[0], ORDER[s[2]], s[1]))
            counts = [sum(s[2] == k for s in base) for k in BASE]
            found = [{"kind": k, "a": a, "b": b, "token": text[a:b] if k == "novel" else None} for a, b, k in both]
            return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), found

        return each

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,a:long,b:long,token:string>>"
    rows = map_documents(id_and_text(df, id_col, text_col), schema, make, arrow)
    if counted is not None:
        rows = _unknown(checkpointed(rows), counted)
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    novel = F.size(F.filter("found", lambda s: s["token"].isNotNull())).cast("long")
    return rows.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", spans.alias("spans"), novel.alias("n_novel"))


def _unknown(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` without the found tokens that are counted identifiers."""
    novel = F.exists("found", lambda s: s["token"].isNotNull())
    asked = rows.filter(novel).withColumn("row_key", F.xxhash64("doc_id", "found"))
    tokens = asked.select("row_key", F.explode("found.token").alias("word")).filter("word IS NOT NULL").distinct()
    known = tokens.join(counted, "word").groupBy("row_key").agg(F.collect_set("word").alias("known"))
    left = F.filter("found", lambda s: s["token"].isNull() | ~F.array_contains(F.coalesce("known", F.array().cast("array<string>")), s["token"]))
    return rows.filter(~novel).unionByName(asked.join(known, "row_key", "left").withColumn("found", left).drop("row_key", "known"))
