"""Line deduplication by a segment-partition edit join.

Lines within ``allowed`` edits of each other belong together: none below ``SHORTEST_NEAR`` characters, one below
``SHORTEST_TWO``, then ``EDITS``, and one in ``SHARE`` characters from ``SHORTEST_SHARE``.  A line is split into one segment
more than the edits, so that a similar line holds one of the segments whole, at a place that the lengths bound.  Each
line indexes its segments under (length, segment number, segment) and probes, for every length that its partners may
have, the substrings at the places where their segments can be.  This finds every pair within ``EDITS``.  The probes
grow with the cube of the edits, so lines that may differ by more have MinHash keys of their character n-grams besides:
a pair at the full budget, its edits far apart, shares one with a chance of 0.88, nearer pairs with more.  Equal keys
make candidates; banded bit-parallel edit distance decides (``near``).  Of all occurrences of a class of lines, the
first one by (doc_id, line number) stays.

Defined results: lines are what is between line feeds, compared without surrounding white space; the shorter of two
lines sets the edits allowed.  Equal lines fall together at any length; blank lines are kept.  Null and empty texts have
nothing to drop.  Rows that repeat both id and text get the same result, as one document.  Null ids sort first.  Other
columns pass through ``dedup_lines``; ``duplicate_lines`` has its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from . import near
from ._frames import BATCH_BYTES, checkpointed, freed, fresh, releasing
from .near import GOLDEN, Powers, mix

EDITS, SHARE = 2, 20
#: Characters from which lines may differ by one edit, by ``EDITS``, and by one in ``SHARE`` characters.
SHORTEST_NEAR, SHORTEST_TWO, SHORTEST_SHARE = 16, 40, 80
#: Characters of an n-gram, and the trees and depth of their signatures.
GRAM, TREES, DEPTH = 6, 27, 4
#: How often n-grams are thrown at most, and of how many values one may be left empty.
ROUNDS, SPARE = 8, 8
#: Lines of a large group in a chunk, rows of small groups in a block, and characters of pairs whose distances are found at once.
CHUNK, BLOCK_ROWS, CELLS = 1024, 16384, 1 << 20
#: Slots that a line's runs of three characters are counted in, and pairs of lines whose counts are compared at once.
SLOTS, PAIRS = 512, 1 << 13
#: Up to how many lines of each group are held against the others at once, in the first waves and in all later ones.
WAVES = (1, 23, 32)
#: Pairs of lines from which a machine word a pair is faster than one pair after another.
LANES = 40
#: Characters of lines whose substrings are hashed at once: some 80 bytes of arrays for each.
KEY_CHARS = 1 << 20
#: Last bits of a line's number that the index leaves out; lines that share the rest share candidates.
SHORT = 23
#: Bits that the place of an n-gram in its line takes, later ones being alike.
PLACE = 24


def line_id(line: str) -> int:
    """The number of a line's text, below 2^63."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) >> 1


def allowed(length: int, edits: int = EDITS) -> int:
    """The edits by which a line of this length and a longer one may differ."""
    if length < SHORTEST_TWO:
        return min(1, edits) if length >= SHORTEST_NEAR else 0
    return max(edits, length // SHARE) if length >= SHORTEST_SHARE else edits


def segment_starts(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each of the edits + 1 segments of lines of the given lengths, the longer segments last."""
    n = edits + 1
    short = length // n
    longer = length - short * n
    out, at = [], np.zeros_like(length)
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at = at + size
    return out


class Hashes:
    """Hashes of any substrings of many lines, from one running sum over all of them."""

    def __init__(self, lines: list[str], powers: Powers):
        self.length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        self.start = np.cumsum(self.length) - self.length
        points = mix(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint64(1))
        up, self.down = powers(points.size + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * up[:-1], dtype=np.uint64)])

    def of(self, which: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
        a = self.start[which] + offset
        return mix((self.sums[a + size] - self.sums[a]) * self.down[a])

    def runs(self, size: int) -> np.ndarray:
        """Hashes of the substrings of one length at every place of the joined lines."""
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: max(self.sums.size - size, 0)])


def segment_keys(hashes: Hashes, of: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which line has each): the segments that the lines ``of`` index and the substrings that they probe."""
    own, keys, owners = hashes.length[of], [], []
    for less in range(edits + 1):
        length = own - less  # of the lines that are looked for
        for i, (start, size) in enumerate(segment_starts(length, edits)):
            low = np.maximum(np.maximum(start - i, start + less - (edits - i)), 0)
            high = np.minimum(np.minimum(start + i, start + less + (edits - i)), own - size)
            tag = mix(np.maximum(length, 0).astype(np.uint64) * np.uint64(64) + np.uint64(i + 1))
            for step in range(2 * edits + 1):
                at = low + step
                ok = np.flatnonzero((at <= high) & (size > 0))
                if ok.size:
                    keys.append(mix(hashes.of(of[ok], at[ok], size[ok]) + tag[ok]))
                    owners.append(of[ok])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def line_keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """``segment_keys`` of all of the lines."""
    return segment_keys(Hashes(lines, Powers(0)), np.arange(len(lines)), edits)


def sketch_keys(hashes: Hashes, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which line has each): a key a tree from the MinHash values of the n-grams of the lines ``of``.

    All n-grams are thrown on the values, of which each keeps its least hash; lines with many empty ones throw theirs again, and
    the few that are left take what another value has, the same one in every line.  A key also has the order in which its values'
    n-grams first come in the line: edits leave it as it is, while lines that share common n-grams by chance differ in it.
    """
    if not of.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bins, low = TREES * DEPTH, np.uint64(0xFFFFFFFF)
    last = (1 << PLACE) - 1
    count = hashes.length[of] - GRAM + 1
    owner = np.repeat(np.arange(of.size), count)
    at = _counting(count)
    grams = hashes.runs(GRAM)[np.repeat(hashes.start[of], count) + at]
    at = np.minimum(at, last).astype(np.uint64)
    least = np.full(of.size * bins, ~np.uint64(0))
    for again in range(ROUNDS):
        h = mix(grams + np.uint64(again)) if again else grams
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(least, owner * bins + place.astype(np.int64), (h & low | np.uint64(again << 32)) << np.uint64(PLACE) | at)
        empty = (least == ~np.uint64(0)).reshape(-1, bins)
        sparse = empty.sum(axis=1) > bins // SPARE
        if not sparse.any():
            break
        some = sparse[owner]
        grams, owner, at = grams[some], owner[some], at[some]
    least = least.reshape(-1, bins)
    line, value = np.nonzero(empty)
    for again in range(1, 64):
        if not line.size:
            break
        source = (mix(value.astype(np.uint64) * np.uint64(64) + np.uint64(again)) % np.uint64(bins)).astype(np.int64)
        full = ~empty[line, source]
        least[line[full], value[full]] = least[line[full], source[full]]
        line, value = line[~full], value[~full]
    least[line, value] = least[line].min(axis=1)
    values = least.reshape(-1, TREES, DEPTH)
    key, places = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), values.shape[:2]), values & np.uint64(last)
    for k in range(DEPTH):
        key = mix(key * GOLDEN + (values[:, :, k] >> np.uint64(PLACE)))
        for other in range(k):
            key = key * np.uint64(2) + (places[:, :, other] < places[:, :, k])
    return key.ravel(), np.repeat(of, TREES)


def join_keys(hashes: Hashes, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which line has each) of all segments that lines of any length index and probe."""
    length, few = hashes.length, min(1, edits)
    made = [
        # a partner's greater length still meets the short line's single edit
        segment_keys(hashes, np.flatnonzero((length >= SHORTEST_NEAR) & (length < SHORTEST_TWO + few)), few),
        segment_keys(hashes, np.flatnonzero(length >= SHORTEST_TWO), edits),
    ]
    return tuple(np.concatenate(c) for c in zip(*made, strict=True))


def similar(a: str, b: str, edits: int = EDITS) -> bool:
    return within(a, b, allowed(min(len(a), len(b)), edits))


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``; a band of 2 * edits + 1 rows, one bit each, follows the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > edits:
        return False
    if a == b:
        return True
    width = 2 * edits + 1
    band = (1 << width) - 1
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    plus, minus, distance = band << edits & band, 0, min(edits, m)
    for j in range(1, n + 1):
        shift = j - edits - 1
        r = rows.get(b[j - 1], 0)
        equal = (r >> shift if shift >= 0 else r << -shift) & band
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & band
        up, down = (minus | ~(diagonal | plus)) & band, diagonal & plus
        if j + edits <= m:  # the band's lowest row
            distance += not diagonal >> (width - 1) & 1
        else:  # the last row
            bit = m - j + edits
            distance += (up >> bit & 1) - (down >> bit & 1)
        if distance > 2 * edits + (n - m):
            return False
        diagonal >>= 1
        plus, minus = (down | ~(diagonal | up)) & band, diagonal & up
    return distance <= edits


def run_counts(lines: list[str]) -> np.ndarray:
    """How many runs of three characters each line has, by slot."""
    out = np.zeros((len(lines), SLOTS), np.int16 if max(map(len, lines), default=0) < 1 << 14 else np.int32)
    for start in range(0, len(lines), 1024):
        part = lines[start : start + 1024]
        points = np.frombuffer("\n".join([*part, "\n"]).encode("utf-32-le", "surrogatepass"), np.uint32)
        slot = ((points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA6B) + points[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(23)).astype(np.int64)
        of = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)) + 1)[: slot.size]
        inside = (points[:-2] != 10) & (points[1:-1] != 10) & (points[2:] != 10)
        out[start : start + 1024] = np.bincount((of * SLOTS + slot)[inside], minlength=len(part) * SLOTS).reshape(-1, SLOTS)
    return out


def may_be_within(counts: np.ndarray, a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether the counts of runs allow so few edits: each edit takes at most three runs away and brings three."""
    out = np.zeros(a.size, bool)
    for start in range(0, a.size, PAIRS):
        at = slice(start, start + PAIRS)
        more = counts[a[at]] - counts[b[at]]
        both, change = np.abs(more).sum(axis=1, dtype=np.int64), more.sum(axis=1, dtype=np.int64)
        out[at] = both + np.abs(change) <= 6 * edits[at]  # twice the larger one of what goes and what comes
    return out


def _same_ends(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items two arrays share."""
    n = min(a.size, b.size)
    if not n:
        return 0
    differ = a[:n] != b[:n]
    first = int(differ.argmax())
    return first if differ[first] else n


def within_many(points: list[np.ndarray], a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """``within`` for many pairs (a, b) of lines at once, each up to its own edits; lines are arrays of code points.

    Common beginnings and ends are cut off.  What is left goes through bands of one, two or four machine words, many pairs at a
    time; few pairs, and wider bands, are ``within``'s.
    """
    out = np.zeros(a.size, bool)
    todo, left, right = [], [], []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = points[i], points[j]
        if x.size > y.size:
            x, y = y, x
        if y.size - x.size > edits[k]:
            continue
        same = _same_ends(x, y)
        x, y = x[same:], y[same:]
        same = _same_ends(x[::-1], y[::-1])
        x, y = x[: x.size - same], y[: y.size - same]
        if y.size <= edits[k]:
            out[k] = True  # no more edits than characters are left
        else:
            todo.append(k)
            left.append(x)
            right.append(y)
    need = edits[np.array(todo, np.int64)]
    for words, least, most in ((1, 0, 31), (2, 32, 63), (4, 64, 127)):
        own = np.flatnonzero((need >= least) & (need <= most))
        if own.size < LANES:
            continue
        for at in _batches(own, right):
            distance = _banded([left[k] for k in at], [right[k] for k in at], words)
            for k, d in zip(at, distance, strict=True):
                out[todo[k]] = d <= need[k]
                todo[k] = -1
    for k, x, y in zip(todo, left, right, strict=True):
        if k >= 0:
            out[k] = within(x.tolist(), y.tolist(), int(edits[k]))
    return out


def _batches(own: np.ndarray, right: list[np.ndarray]):
    """The pairs by the longer line's length, as many at a time as ``CELLS`` allow."""
    length = np.fromiter((right[k].size for k in own), np.int64, own.size)
    order = np.argsort(length, kind="stable")
    start = 0
    while start < own.size:
        end = start + 1
        while end < own.size and (end - start + 1) * int(length[order[end]]) <= CELLS:
            end += 1
        yield own[order[start:end]].tolist()
        start = end


def _equalities(left: list[np.ndarray], right: list[np.ndarray], words: int) -> np.ndarray:
    """(place, word, pair): the bits of the band at each place of the right lines, set where the left line has the same symbol."""
    width, count = 64 * words, len(left)
    m, n = (np.fromiter((x.size for x in side), np.int64, count) for side in (left, right))
    every, symbol = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    kind = np.uint8 if every.size < 254 else np.uint32
    longest = int(n.max())
    a, b = np.full((count, longest + width), 255, kind), np.full((count, longest), 254, kind)
    a[np.repeat(np.arange(count), m), width // 2 - 1 + _counting(m)] = symbol[: m.sum()]
    b[np.repeat(np.arange(count), n), _counting(n)] = symbol[m.sum() :]
    out = np.empty((longest, words, count), np.uint64)
    step = max(1, (1 << 21) // (longest * width))
    for start in range(0, count, step):
        window = np.lib.stride_tricks.sliding_window_view(a[start : start + step], width, axis=1)[:, :longest]
        bits = np.packbits(window == b[start : start + step, :, None], axis=2, bitorder="little")
        out[:, :, start : start + step] = bits.view(np.uint64).transpose(1, 2, 0)
    return out


def _banded(left: list[np.ndarray], right: list[np.ndarray], words: int) -> np.ndarray:
    """Edit distances of pairs, none longer on the left, by the recurrence of ``within`` with a pair in each lane.

    A band is ``words`` machine words wide; up to half of that, less one, distances are exact, beyond it they are too large.
    """
    count, width = len(left), 64 * words
    band = width // 2 - 1
    below = width - 1 - band
    m, n = (np.fromiter((x.size for x in side), np.int64, count) for side in (left, right))
    equal = _equalities(left, right, words)
    one, top = np.uint64(1), np.uint64(63)
    start = ((1 << width) - 1 << band) & ((1 << width) - 1)
    plus = np.repeat(np.array([[start >> 64 * w & (1 << 64) - 1] for w in range(words)], np.uint64), count, axis=1)
    minus = np.zeros((words, count), np.uint64)
    distance, final, gone = np.minimum(below, m), np.zeros(count, np.int64), 0
    inner = int(m.min()) - below  # up to here every pair's lowest row is in the band's corner
    for j in range(1, int(n[-1]) + 1):
        if n[0] < j:
            done = int(np.searchsorted(n, j))  # shorter ones are
            final[gone : gone + done] = distance[:done]
            gone += done
            m, n, plus, minus, distance = m[done:], n[done:], plus[:, done:], minus[:, done:], distance[done:]
            inner = int(m.min()) - below
        e = equal[j - 1, :, gone:]
        total = e & plus
        total += plus
        if words > 1:
            carry = np.zeros(total.shape[1], bool)
            for w in range(1, words):
                carry = (total[w - 1] < plus[w - 1]) | carry & (total[w - 1] == plus[w - 1])
                total[w] += carry
        diagonal = total
        diagonal ^= plus
        diagonal |= e
        diagonal |= minus
        up = diagonal | plus
        np.invert(up, out=up)
        up |= minus
        down = diagonal & plus
        if j <= inner:
            distance += 1 - (diagonal[-1] >> top).astype(np.int64)
        else:
            bit = np.maximum(m - j + band, 0)
            word, bit = np.minimum(bit >> 6, words - 1), (bit & 63).astype(np.uint64)
            own = np.arange(word.size)
            last = (up[word, own] >> bit & one).astype(np.int64) - (down[word, own] >> bit & one).astype(np.int64)
            distance = distance + np.where(j + below <= m, 1 - (diagonal[-1] >> top).astype(np.int64), last)
        shifted = diagonal >> one
        if words > 1:
            shifted[:-1] |= diagonal[1:] << top
        minus = shifted & up
        np.bitwise_or(shifted, up, out=up)
        np.invert(up, out=up)
        up |= down
        plus = up
    final[gone:] = distance
    return np.where(final <= band, final, band + 1)


#: An index entry: 32 bits of the key and 40 of the line's number; those of signatures have the line's length, too.
ENTRY, LONGEST = [np.uint32, np.uint32, np.uint8], (1 << 16) - 1
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linker(edits: int):
    """The work on a block: links (a, b) that span its classes.  In each wave some lines of every group are held against all later
    lines of their group that are not of their class; counts of runs of characters come before distances."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table["id"].to_numpy(), table["half"].to_numpy(), table["leader"].to_numpy()))))
        ids, leader, half = (table[c].to_numpy() for c in ("id", "leader", "half"))
        across = table["low"][0] != table["high"][0]
        different, at, which = np.unique(ids, return_index=True, return_inverse=True)
        lines = [x.decode("utf-8", "surrogatepass") for x in table["packed"].take(pa.array(at)).to_pylist()]
        counts = run_counts(lines)
        points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in lines]
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        budget = np.fromiter((allowed(int(n), edits) for n in length), np.int64, len(lines))
        label = np.arange(different.size)  # of classes, by different line
        first, size = near.runs(leader)
        pivots = np.add.reduceat((half == 0).astype(np.int64), first) if across else size - 1
        links, done, wave = [], 0, 0
        while (on := pivots > done).any():
            first, size, pivots = first[on], size[on], pivots[on]
            upto = done + WAVES[min(wave, len(WAVES) - 1)]
            each = np.minimum(pivots, upto) - done
            a = np.repeat(first + done, each) + _counting(each)
            # a chunk's lines come first, so that those of the other one are behind all of them
            later = np.repeat(first + pivots, each) if across else a + 1
            n = np.repeat(first + size, each) - later
            a, b = np.repeat(a, n), np.repeat(later, n) + _counting(n)
            done, wave = upto, wave + 1
            x, y = which[a], which[b]
            some = (label[x] != label[y]) & (np.abs(length[x] - length[y]) <= np.minimum(budget[x], budget[y]))
            x, y = x[some], y[some]
            some = may_be_within(counts, x, y, np.minimum(budget[x], budget[y]))
            x, y = x[some], y[some]
            _, once = np.unique(np.minimum(x, y) * different.size + np.maximum(x, y), return_index=True)
            x, y = x[once], y[once]
            limit = np.minimum(budget[x], budget[y])
            ok = within_many(points, x, y, limit)
            for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    links.append((i, j))
        pairs = different[np.array(links, np.int64).reshape(-1, 2)]
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=LINKS)

    return run


def _counting(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the numbers, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def cut_by_length(key: np.ndarray, length: np.ndarray, edits: int) -> np.ndarray:
    """Numbers of what is left of the buckets of sorted rows (key, length) where they are cut at gaps wider than the edits allowed.

    Two lines within their edits are never cut apart, as all gaps between them are within the edits of the shorter one.
    """
    new = np.zeros(key.size, bool)
    new[1:] = (key[1:] != key[:-1]) | (length[1:] - length[:-1] > np.maximum(edits, length[:-1] // SHARE))
    return np.cumsum(new)


def stars(blobs: DataFrame, parts: int, edits: int = EDITS) -> DataFrame:
    """(leader, id) of all members of buckets with two members or more, the leader, a bucket's smallest id, among them.

    Parts below ``parts`` are of segments, whose keys have lengths in them; the others are of signatures, whose buckets are cut by length.
    """

    def run(part: tuple, table: pa.Table) -> pa.Table:
        signed = part[0].as_py() >= parts
        key, low, high, *length = near.collected(table["blob"], [*ENTRY, np.uint16] if signed else ENTRY)
        some = near.repeated(key)  # few keys are of two lines
        key, item = key[some], low[some].astype(np.int64) | high[some].astype(np.int64) << 32
        if signed:
            length = length[0][some].astype(np.int64)
            order = np.lexsort((length, key))
            key, item = cut_by_length(key[order], length[order], edits), item[order]
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        first, _ = near.runs(key, item)
        key, item = key[first], item[first]
        first, size = near.runs(key)
        many = np.repeat(size > 1, size)
        leader, item = np.repeat(item[first], size)[many], item[many]
        order = np.lexsort((item, leader))
        leader, item = leader[order], item[order]
        first, _ = near.runs(leader, item)
        out = pa.table({"leader": pa.array(leader[first]), "id": pa.array(item[first])})
        near.release()
        return out

    return blobs.groupBy("part").applyInArrow(run, "leader long, id long").distinct()


def _lines(text: str | None):
    """(number, text without surrounding white space) of the lines that are compared."""
    for k, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if line:
            yield k, line


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return df.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row_key"))


NUMBERS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("items", pa.list_(pa.int64()))])


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(row_key, dropped): the numbers, from 0, of the lines that each document loses; row_key is a hash of id and text."""
    ship(df.sparkSession)
    docs, parts = _rows(df, id_col, text_col), near.partitions(df)

    def distinct(batches, least, chars):
        """Distinct lines, about ``chars`` characters of them at a time."""
        lines: dict[int, str] = {}
        used = 0
        for batch in batches:
            for text in batch.column(1):
                for _, line in _lines(text.as_py()):
                    if len(line) >= least and (item := line_id(line)) not in lines:
                        lines[item] = line
                        used += len(line)
                if used > chars:
                    yield np.fromiter(lines, dtype=np.int64, count=len(lines)), list(lines.values())
                    lines, used = {}, 0
        if lines:
            yield np.fromiter(lines, dtype=np.int64, count=len(lines)), list(lines.values())

    def keys(batches):
        powers = Powers()
        for items, lines in distinct(batches, SHORTEST_NEAR, KEY_CHARS):
            hashes = Hashes(lines, powers)
            length = np.minimum(hashes.length, LONGEST).astype(np.uint16)
            for signed in (False, True):
                found, owners = sketch_keys(hashes, np.flatnonzero(hashes.length >= SHORTEST_SHARE)) if signed else join_keys(hashes, edits)
                of = ((found & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64) + parts * signed
                short = (items >> SHORT)[owners]
                entry = [(found >> np.uint64(32)).astype(np.uint32), short.astype(np.uint32), (short >> 32).astype(np.uint8)]
                yield near.dealt(of, [*entry, length[owners]] if signed else entry)

    def contents(batches):
        for items, lines in distinct(batches, SHORTEST_NEAR, BATCH_BYTES // 4):
            yield near.content_batches(items, [x.encode("utf-8", "surrogatepass") for x in lines], parts, SHORT)

    def numbers(batches):
        for batch in batches:
            rows, start, used = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                own = [line_id(x) if (x := line.strip()) else None for line in (text.as_py() or "").split("\n")]
                rows.append(own)
                used += 8 * len(own) + 32
                if used > BATCH_BYTES // 4 or k == batch.num_rows - 1:
                    columns = [batch.column(0).slice(start, len(rows)), batch.column(2).slice(start, len(rows)), pa.array(rows, NUMBERS.field("items").type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=NUMBERS)
                    rows, start, used = [], k + 1, 0

    found = near.merged_groups(checkpointed(stars(docs.mapInArrow(releasing(keys), "part int, blob binary"), parts, edits)))
    freed(df.sparkSession)  # the index goes before contents are dealt
    blobs = docs.mapInArrow(releasing(contents), "part int, blob binary")
    links = checkpointed(near.in_blocks(found, near.with_contents(blobs, parts, SHORT), CHUNK, BLOCK_ROWS, lambda: _linker(edits), "a long, b long"))
    freed(df.sparkSession)
    roots = near.classes(links).withColumnRenamed("id", "item")
    roots = roots.unionByName(roots.select("root", F.col("root").alias("item")).distinct())
    numbered = checkpointed(docs.mapInArrow(releasing(numbers), "doc_id long, row_key long, items array<long>"))
    each = numbered.select("doc_id", "row_key", F.posexplode("items").alias("line", "item")).filter("item IS NOT NULL")
    place = F.struct("doc_id", "row_key", "line")
    by_line = each.groupBy("item").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(roots, "item", "left").filter("n > 1 OR root IS NOT NULL")
    by_line = checkpointed(by_line.withColumn("root", F.coalesce("root", "item")))
    # tables of their own, so that adaptive execution can split a very large class and the occurrences of a very common line
    classes = checkpointed(by_line.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").select("root", "first"))
    kept = checkpointed(by_line.select("item", "root").join(classes, "root").select("item", "first"))
    freed(df.sparkSession)
    return each.join(kept, "item").filter(~place.eqNullSafe(F.col("first"))).groupBy("row_key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): the lines that each document loses."""
    rows = _rows(df, id_col, text_col).select("doc_id", "row_key", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    both = rows.join(dropped_lines(df, id_col, text_col, edits), "row_key", "left")
    return both.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``df`` without its dropped lines; documents of which only blank lines are left go."""
    lost_key, lost_lines = fresh(df, "lost_key"), fresh(df, "lost_lines")
    lost = dropped_lines(df, id_col, text_col, edits).withColumnsRenamed({"row_key": lost_key, "dropped": lost_lines})
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    both = df.join(lost, key == F.col(lost_key), "left")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(lost_lines, i)), "\n")
    text = F.when(F.col(lost_lines).isNull(), F.col(text_col)).otherwise(left)
    out = both.withColumn(text_col, text).filter(F.col(lost_lines).isNull() | (F.length(F.trim(F.regexp_replace(text_col, r"\s+", " "))) > 0))
    return out.select(*df.columns)
