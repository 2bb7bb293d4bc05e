"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to one edit in ``LENGTH_PER_EDIT`` of its characters.  It is split into one piece more
than that, so that a match leaves a piece whole.  Rolling hashes of all text positions, in NumPy, find the pieces' first
characters; whole pieces are then compared, and the text around a hit is verified with Myers' bit-parallel edit
distance, whose best end decides.

Texts and items are compared in lower case with runs of white space as one space.  The items are broadcast in slices of
at most ``SLICE_CHARS`` characters: a benchmark beyond that takes a pass over the documents for each slice.

Defined results: null, empty and blank items and texts match nothing.  Items shorter than ``LENGTH_PER_EDIT`` must occur
exactly.  A document has one row for an item, of its fewest edits, the earliest end among equals.  Repeated items and
repeated documents give rows of their own.  Other columns are ignored; ``clean`` returns its input's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from ._frames import fresh, id_and_text, releasing

LENGTH_PER_EDIT = 20
SLICE_CHARS = 8 << 20
#: Lengths of the hashed piece beginnings; shorter pieces are searched for as they are.
GRAMS = (16, 8)
#: Characters of text that are hashed at once.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def edits_allowed(length: int) -> int:
    return length // LENGTH_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of an item cut into one piece more than its allowed edits, as even as can be."""
    n = edits_allowed(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def rolling(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` (a power of two) code points."""
    h = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    power, width = BASE, 1
    while width < size:
        if h.size <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & 0xFFFFFFFFFFFFFFFF, width * 2
    return h


def slot_of(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def best_end(masks: dict[str, int], length: int, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the pattern's best occurrence that ends in ``text``, if it takes at most ``most`` edits."""
    full, top = (1 << length) - 1, 1 << length - 1
    plus, minus, score, best = full, 0, length, None
    for at, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Index:
    """The pieces of a slice of items, and the search of texts for them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.short, self.masks = items, [], []
        self.starts: dict[int, dict[int, list[tuple[int, int, str]]]] = {g: {} for g in GRAMS}
        self.filters = {}
        for i, (_, text) in enumerate(items):
            masks: dict[str, int] = {}
            for at, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << at
            self.masks.append(masks)
            for offset, piece in pieces(text):
                gram = next((g for g in GRAMS if len(piece) >= g), 0)
                if gram:
                    h = int(rolling(_points(piece[:gram]), gram)[0])
                    self.starts[gram].setdefault(h, []).append((i, offset, piece))
                elif piece:
                    self.short.append((i, offset, piece))
        for gram, table in self.starts.items():
            if table:
                self.filters[gram] = np.zeros(1 << FILTER_BITS, dtype=bool)
                self.filters[gram][slot_of(np.array(list(table), dtype=np.uint64))] = True

    def hits(self, texts: list[str]) -> dict[tuple[int, int], set[int]]:
        """{(text, item): where the item would start} from whole pieces."""
        joined = "\n".join(texts)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        points, out = _points(joined), {}

        def found(at: int, entry) -> None:
            i, offset, piece = entry
            if joined.startswith(piece, at):
                t = int(np.searchsorted(starts, at, side="right")) - 1
                out.setdefault((t, i), set()).add(at - int(starts[t]) - offset)

        for gram, table in self.starts.items():
            if table:
                h = rolling(points, gram)
                for at in np.flatnonzero(self.filters[gram][slot_of(h)]):
                    for entry in table.get(int(h[at]), ()):
                        found(int(at), entry)
        for entry in self.short:
            at = joined.find(entry[2])
            while at >= 0:
                found(at, entry)
                at = joined.find(entry[2], at + 1)
        return out

    def matches(self, texts: list[str]):
        """(text's place, item id, edits, end) of every item found."""
        for (t, i), begins in self.hits(texts).items():
            item_id, item = self.items[i]
            most, best, done = edits_allowed(len(item)), None, -1
            for begin in sorted(begins):
                if begin + len(item) + most <= done:
                    continue
                low = max(0, begin - most)
                done = begin + len(item) + most
                got = best_end(self.masks[i], len(item), texts[t][low:done], most)
                if got and (best is None or (got[0], low + got[1]) < best):
                    best = (got[0], low + got[1])
            if best:
                yield t, item_id, *best


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


ROWS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("match_end", pa.int64())])


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, match_end): each item found in a document, with its edits and where it ends in the normalised text."""
    ship(df.sparkSession)
    docs, context = id_and_text(df, id_col, text_col), df.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    slices = max(1, -(-chars // SLICE_CHARS))

    def searched(part: DataFrame) -> DataFrame:
        known = context.broadcast([(r.item_id, text) for r in part.collect() if (text := normal(r.text))])

        def run(batches):
            index = Index(known.value)
            for batch in batches:
                ids, texts, size, rows = [], [], 0, []

                def flush():
                    for t, item, edits, end in index.matches(texts):
                        rows.append((ids[t], item, edits, end))

                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if text := normal(text.as_py() or ""):
                        ids.append(doc_id)
                        texts.append(text)
                        size += len(text)
                    if size > CHUNK:
                        flush()
                        ids, texts, size = [], [], 0
                if texts:
                    flush()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

        return docs.mapInArrow(releasing(run), "doc_id long, item_id long, edits int, match_end long")

    out = None
    for k in range(slices):
        one = searched(items if slices == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k))
        out = one if out is None else out.union(one)
    return out


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` in which no item is found."""
    gone = fresh(df, "gone_id")
    dropped = find_leaks(df, benchmark, id_col, text_col).select(F.col("doc_id").alias(gone)).distinct()
    return df.join(dropped, F.col(id_col).cast("long") == F.col(gone), "left_anti")
