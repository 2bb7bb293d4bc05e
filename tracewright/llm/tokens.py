"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token is a doubly linked list of byte symbols; a heap gives the adjacent pair of the lowest rank, leftmost
first, which is merged until no ranked pair is left.  A pre-token's count is its bytes minus its merges, so that no
token ids are made.  The merge table is read once on the driver and broadcast: it is a parameter's file of a fixed
size (50,000 merges here), not data.

Defined results: a null or empty text has 0 bytes and 0 tokens.  Special strings inside a text count as one token
each, as the library has them by default.  Ties and repeated rows give equal rows; other input columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._frames import id_and_text, map_documents

SPACE = r"\t-\r \x85\xa0  -     　"
#: Byte-level pre-tokens: contractions, then runs of letters, numbers or other signs, then white space.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Texts of ASCII and Latin-1 letters only, in which a simpler pattern of the standard library finds the same pre-tokens.
UNUSUAL = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
USUAL = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: Pre-tokens whose counts a worker process remembers.
REMEMBERED = 600_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_kind(spec: dict) -> None:
    """Raises where a tokenizer file asks for what is not counted here: only plain byte-level pair merging is."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    wrong = [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    wrong += ["model.type"] * (model.get("type", "BPE") != "BPE")
    wrong += ["pre_tokenizer"] * ((before.get("type"), before.get("add_prefix_space", False), before.get("use_regex", True)) != ("ByteLevel", False, True))
    wrong += [f"added_tokens.{k}" for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if wrong:
        raise ValueError(f"not a plain byte-level tokenizer: {', '.join(sorted(set(wrong)))}")


def load_merges(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[str]]:
    """{(left, right): (rank, merged)} over symbol numbers, where 0 to 255 are bytes; and the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check_kind(spec)
    number: dict[str, int] = dict(byte_letters())
    table = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merged = number.setdefault(left + right, len(number))
        table[number[left], number[right]] = (rank, merged)
    return table, [t["content"] for t in spec.get("added_tokens", ())]


def count_symbols(word: bytes, merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols that are left of ``word`` when no adjacent pair has a rank."""
    symbols = list(word)
    n = len(symbols)
    if n < 2:
        return n
    nexts = list(range(1, n + 1))
    prevs = list(range(-1, n - 1))
    heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        if symbols[i] != a:
            continue
        j = nexts[i]
        if j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = merged, -1
        k = nexts[j]
        nexts[i] = k
        left -= 1
        if k < n:
            prevs[k] = i
            if found := merges.get((merged, symbols[k])):
                heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        h = prevs[i]
        if h >= 0 and (found := merges.get((symbols[h], merged))):
            heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return left


class _Counts(dict):
    """Counts by pre-token, made when first asked for and forgotten when there are too many."""

    def __init__(self, merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = count_symbols(word.encode(), self.merges)
        if len(word) <= 64:
            self[word] = n
        return n


#: Remembered counts by vocabulary, which the later tasks of a worker process find here.
_PROCESS: dict[str, _Counts] = {}


def token_counter(merges, specials: list[str], vocabulary: str | None = None):
    """A function from a text to its number of tokens; ``vocabulary`` names the counts to share in this process."""
    counts = _Counts(merges) if vocabulary is None else _PROCESS.setdefault(vocabulary, _Counts(merges))
    usual, unusual = USUAL.findall, regex.compile(PRETOKEN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def count(text: str) -> int:
        pieces, n = [text], 0
        if special and any(s in text for s in specials):
            pieces = special.split(text)
            n = len(pieces) - 1
        find = unusual if UNUSUAL.search(text) else usual
        return n + sum(sum(map(counts.__getitem__, find(p))) for p in pieces)

    return count


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    table = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer_path))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def make():
        count = token_counter(*table.value, tokenizer_path)

        def each(doc_id, text):
            n = count(text) if text else 0
            return doc_id, len((text or "").encode()), n, n > limit

        return each

    return map_documents(id_and_text(df, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, arrow)
