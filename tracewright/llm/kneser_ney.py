"""Interpolated modified Kneser-Ney over character 4-grams, in NumPy, on sorted arrays of packed n-grams.

An n-gram of symbols c1 c2 c3 c4 and a language are one 64-bit number: 24 bits of the language's hash, then 10 bits for
each symbol.  All of a model's counts that meet in one probability share the language and c3, so that a model cut by
``shard_of`` answers queries of the same shard by itself; only the discounts and the lowest order's continuation
counts are sums over all shards.  They are at most ``len(symbols) + 12`` numbers a language.
"""

from __future__ import annotations

import zlib

import numpy as np

ORDER, BITS = 4, 10
SYMBOLS = 1 << BITS
MASK = np.uint64(SYMBOLS - 1)
#: Code points below this are symbols of their own; others share 256 symbols by their last 8 bits, 0 pads a text's start.
PLAIN = SYMBOLS - 256
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160], dtype=np.uint32)
SPACE = 32


def language_code(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode()) & 0xFFFFFF


def symbols(text: str) -> np.ndarray:
    """Symbols of a text; runs of white space are one space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = np.isin(points, SPACES) if points.size < 64 else (points <= 160) & _IS_SPACE[np.minimum(points, 160)]
    points = np.where(space, SPACE, np.where(points < PLAIN, points, PLAIN + (points & 255)))
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    return np.maximum(points[keep], 1).astype(np.uint64)


_IS_SPACE = np.isin(np.arange(161, dtype=np.uint32), SPACES)


def ngrams(text: str, lang: int) -> np.ndarray:
    """The packed n-gram that ends at each symbol of a text; the text's start is padded."""
    s = np.concatenate([np.zeros(ORDER - 1, np.uint64), symbols(text)])
    n = s.size - ORDER + 1
    out = np.full(max(0, n), np.uint64(lang << ORDER * BITS), dtype=np.uint64)
    for i in range(ORDER):
        out |= s[i : i + n] << np.uint64(BITS * (ORDER - 1 - i))
    return out


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By language and third symbol."""
    key = (codes >> np.uint64(ORDER * BITS)) << np.uint64(BITS) | codes >> np.uint64(BITS) & MASK
    key *= np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    if not codes.size:
        return codes, counts
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _lang(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(ORDER * BITS)).astype(np.int64)


def _shortened(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes of ``order`` symbols without their first one."""
    low = np.uint64((1 << BITS * (order - 1)) - 1)
    return (codes >> np.uint64(ORDER * BITS)) << np.uint64(ORDER * BITS) | codes & low


class Shard:
    """The counts of every order that a set of highest-order counts implies, and what each context's continuations sum to."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = {}
        level = merged(codes, counts)
        for order in range(ORDER, 1, -1):
            self.levels[order] = (*level, *self._contexts(*level))
            # a lower order counts the distinct symbols before an n-gram
            level = merged(_shortened(level[0], order), np.ones(level[0].size, np.int64))
        self.lowest = level

    @staticmethod
    def _contexts(codes, counts):
        context = codes & ~MASK
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if codes.size else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x.astype(np.int64), first) if codes.size else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        return context[first], np.stack(sums)

    def statistics(self) -> dict[tuple[int, int, int], int]:
        """{(language, order, j): n-grams with count j} for j from 1 to 4, and {(language, 1, symbol): continuation count}."""
        out: dict[tuple[int, int, int], int] = {}
        for order, (codes, counts, *_) in self.levels.items():
            langs = _lang(codes)
            for j in range(1, 5):
                for lang, n in zip(*np.unique(langs[counts == j], return_counts=True), strict=True):
                    out[int(lang), order, j] = int(n)
        for code, n in zip(*self.lowest, strict=True):
            out[int(code >> np.uint64(ORDER * BITS)), 1, int(code & MASK)] = int(n)
        return out


class Statistics:
    """Discounts by language and order, and the lowest order's probabilities."""

    def __init__(self, sums: dict[tuple[int, int, int], int]):
        self.discount, self.unigram = {}, {}
        for lang in {k[0] for k in sums}:
            for order in range(2, ORDER + 1):
                n1, n2, n3, n4 = (sums.get((lang, order, j), 0) for j in range(1, 5))
                y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
                self.discount[lang, order] = np.clip(d, [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])
            counts = np.zeros(SYMBOLS)
            for (of, order, symbol), n in sums.items():
                if of == lang and order == 1:
                    counts[symbol] = n
            seen, total = (counts > 0).sum(), counts.sum()
            d = min(0.75, total / max(1, seen) / 2)
            self.unigram[lang] = (np.maximum(counts - d, 0) + d * seen / SYMBOLS) / total if total else np.full(SYMBOLS, 1 / SYMBOLS)


def log_probabilities(shard: Shard, statistics: Statistics, codes: np.ndarray) -> np.ndarray:
    """Natural logarithms of p(c4 | c1 c2 c3) for codes whose shard this is; of an unknown language, of a uniform choice."""
    p = np.full(codes.size, 1 / SYMBOLS)
    langs = _lang(codes)
    for lang in np.unique(langs):
        if int(lang) in statistics.unigram:
            at = langs == lang
            p[at] = statistics.unigram[int(lang)][(codes[at] & MASK).astype(np.int64)]
    for order in range(2, ORDER + 1):
        grams, counts, contexts, sums = shard.levels[order]
        if not grams.size:
            continue
        asked = codes
        for k in range(ORDER, order, -1):
            asked = _shortened(asked, k)
        discounts = np.full((codes.size, 3), 0.5)
        for lang in np.unique(langs):
            if (int(lang), order) in statistics.discount:
                discounts[langs == lang] = statistics.discount[int(lang), order]
        i = np.minimum(np.searchsorted(grams, asked), grams.size - 1)
        c = np.where(grams[i] == asked, counts[i], 0)
        j = np.minimum(np.searchsorted(contexts, asked & ~MASK), contexts.size - 1)
        known = contexts[j] == asked & ~MASK
        total = np.where(known, sums[0][j], 1)
        less = np.where(c == 0, 0, np.where(c == 1, discounts[:, 0], np.where(c == 2, discounts[:, 1], discounts[:, 2])))
        spare = (discounts[:, 0] * sums[1][j] + discounts[:, 1] * sums[2][j] + discounts[:, 2] * sums[3][j]) / total
        p = np.where(known, (c - less) / total + spare * p, p)
    return np.log(p)
