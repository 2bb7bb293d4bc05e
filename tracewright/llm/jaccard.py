"""N-gram Jaccard join by a MinHash LSH forest.

Documents are sets of five-word shingles.  Equal texts are one item, however many documents have it.  An item's MinHash
signature is cut into the labels of a forest's trees.  A task that holds a part of a tree sorts its labels, which makes it a
prefix trie: the items below a node are a run of the sorted labels that share a prefix.  The first round searches nodes at
depth ``matched_depth + EXTRA``.  Every candidate pair is verified exactly (``near``), and the links' exact similarities tell
how many more there are: a link of similarity s is found at depth d with the chance p = 1 - (1 - s^d)^trees, so links stand
for the sum of 1/p.  While the recall so measured is below the target, prefixes are shortened, each round verifying only
pairs that no round before it had.  At ``matched_depth`` the chance at the threshold itself reaches the target; the search
goes no further up.

Defined results: words are runs of anything but space and control white space; texts of fewer than five words are one
shingle of all their words; null and empty texts and texts of white space have no shingles, are similar to nothing and
are classes of their own.  A class is named by its smallest doc_id; a row with a null id takes the class of its text, and
none if no document of the class has an id.  Items are told apart by 63-bit hashes of their texts (two of 10^9 different
texts share one with a chance of 0.05).  Repeated rows give repeated results.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from . import near
from ._frames import BATCH_BYTES, checkpointed, fresh, id_and_text, releasing
from .near import GOLDEN, Powers
from .near import mix as _mix

SHINGLE, THRESHOLD = 5, 0.8
TREES, RECALL = 63, 0.99999
#: Levels of a label, and how many of them the first round searches beyond the depth that reaches the target at the threshold.
DEPTH, EXTRA = 12, 2
#: Items of a large group in a chunk, rows of small groups in a block, and pairs of items that are looked at together.
CHUNK, BLOCK_ROWS, PAIRS = 512, 2048, 1 << 15
#: Bytes of text that are shingled at once.
PIECE = 1 << 20
STEP = np.uint64(0xD6E8FEB86659FD93)
EMPTY, LOW = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFF)
ENTRY = [np.uint32, np.uint8, np.uint16, np.int64]


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall."""
    while depth > 1 and found_chance(threshold, trees, depth) < recall:
        depth -= 1
    return depth


def found_chance(similarity, trees: int, depth: int):
    """The chance that a pair shares a node of this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def shingle_pieces(texts: list[bytes], powers: Powers):
    """The hashes of each text's shingles, in their order and with repeats, text after text."""
    start = 0
    while start < len(texts):
        end, used = start, 0
        while end < len(texts) and (end == start or used + len(texts[end]) <= PIECE):
            used += len(texts[end])
            end += 1
        yield from _shingles(texts[start:end], powers)
        start = end


def _shingles(texts: list[bytes], powers: Powers) -> list[np.ndarray]:
    """Words are hashed by differences of one running sum over all texts' bytes."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(raw.size + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[: raw.size], dtype=np.uint64)])
    words = _mix((sums[last] - sums[first]) * down[first])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    of = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(of, minlength=len(texts))
    n = max(words.size - SHINGLE + 1, 0)
    sums = np.full(n, np.uint64(SHINGLE))
    for k in range(SHINGLE):
        sums = sums * STEP + words[k : k + n]
    whole = of[:n] == of[words.size - n :]
    found = np.split(_mix(sums[whole]), np.cumsum(np.maximum(n_words - SHINGLE + 1, 0))[:-1])
    at = np.concatenate([[0], np.cumsum(n_words)])
    for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
        few = np.full(1, np.uint64(n_words[i]))
        for w in words[at[i] : at[i + 1]]:
            few = few * STEP + w
        found[i] = _mix(few)
    return found


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(_shingles([(text or "").encode("utf-8", "surrogatepass")], Powers())[0])


def signature(found: np.ndarray, bins: int) -> np.ndarray:
    """A set's MinHash values, two sets agreeing in each with the chance of their Jaccard similarity.

    Every value is not a pass of its own over the set (fast similarity sketching, Dahlgaard, Knudsen and Thorup 2017): in each
    round all members are thrown on the bins, a bin keeps the least hash of the first round that hits it, and rounds end when
    no bin is empty.  What ``bins`` rounds leave empty gets the least of a hash of its own.
    """
    least, start = np.full(bins, EMPTY), 0
    while start < bins:
        rounds = min(bins - start, max(1, -(-(8 if not start else 4) * bins // found.size)))
        at = np.arange(start, start + rounds, dtype=np.uint64)
        h = _mix(found + _mix((at + np.uint64(1)) * GOLDEN)[:, None])
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(least, place.ravel().astype(np.int64), ((at << np.uint64(32))[:, None] | (h & LOW)).ravel())
        start += rounds
        if (least != EMPTY).all():
            break
    empty = np.flatnonzero(least == EMPTY)  # of small sets only
    if empty.size:
        own = empty.astype(np.uint64) + np.uint64(bins)
        least[empty] = own << np.uint64(32) | (_mix(found + _mix((own + np.uint64(1)) * GOLDEN)[:, None]) & LOW).min(axis=1)
    return least


def labels(signatures: np.ndarray, trees: int, depth: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """For items (rows) and trees (columns): a hash of the first ``depth`` values of a label, and of ``extra`` more."""
    values = signatures.reshape(-1, trees, depth + extra)
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), values.shape[:2])
    for k in range(depth):
        key = _mix(key * GOLDEN + values[:, :, k])
    more = key
    for k in range(depth, depth + extra):
        more = _mix(more * GOLDEN + values[:, :, k])
    return key, (more >> np.uint64(48)).astype(np.uint16)


FOUND = pa.schema([("id", pa.int64()), ("tree", pa.int32()), ("near", pa.int64()), ("far", pa.int64()), ("crowd", pa.bool_()), ("split", pa.bool_())])


def trie_paths(blobs: DataFrame) -> DataFrame:
    """(id, tree, near, far, crowd, split) of all that share a node of a trie: the smallest item below the shallow node and below the
    deep one; whether the deep one holds others, too; whether the shallow one is split into several deep ones."""

    def walk(table: pa.Table) -> pa.Table:
        key, tree, more, item = near.collected(table["blob"], ENTRY)
        some = near.repeated(key)  # few labels meet another one
        key, tree, more, item = key[some], tree[some], more[some], item[some]
        order = np.lexsort((item, more, key, tree))
        key, tree, more, item = key[order], tree[order], more[order], item[order]
        first, _ = near.runs(tree, key, more, item)  # repeated rows of an item
        key, tree, more, item = key[first], tree[first], more[first], item[first]
        first, size = near.runs(tree, key)
        deep, deep_size = near.runs(tree, key, more)
        least = np.minimum.reduceat(item, first) if item.size else item
        children = np.add.reduceat(np.isin(np.arange(item.size), deep, assume_unique=True).astype(np.int64), first) if item.size else size
        many = np.repeat(size > 1, size)
        columns = [item, tree.astype(np.int32), np.repeat(least, size), np.repeat(item[deep], deep_size), np.repeat(deep_size > 1, deep_size), np.repeat(children > 1, size)]
        return pa.Table.from_arrays([pa.array(c[many], f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    def run(table: pa.Table) -> pa.Table:
        out = walk(table)
        near.release()
        return out

    return blobs.groupBy("part").applyInArrow(run, "id long, tree int, near long, far long, crowd boolean, split boolean")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of the sets: rare values pair by pair, common ones by products of 0-1 matrices."""
    n = len(sets)
    row = np.repeat(np.arange(n), [s.size for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    first = np.cumsum(times) - times
    common = max(24, n // 16)
    total = np.zeros(n * n)
    for c in range(2, common):
        at = first[times == c]
        if at.size:
            together = row[at[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            for start in range(0, at.size, max(1, (1 << 20) // i.size)):
                part = together[start : start + max(1, (1 << 20) // i.size)]
                total += np.bincount((part[:, i] * n + part[:, j]).ravel(), minlength=n * n)
    total = (total.reshape(n, n) + total.reshape(n, n).T).astype(np.float32)
    often = np.flatnonzero(times >= common)
    place = np.full(times.size, -1)
    place[often] = np.arange(often.size)
    place = place[column]
    row, place = row[place >= 0], place[place >= 0]  # sorted by column, and so by place
    for start in range(0, often.size, 2048):
        a, b = np.searchsorted(place, [start, start + 2048])
        held = np.zeros((n, min(2048, often.size - start)), np.float32)
        held[row[a:b], place[a:b] - start] = 1
        total += held @ held.T
    return total


def _paths(held: pa.ChunkedArray, field: str, own: np.ndarray, trees: int) -> np.ndarray:
    """The leaders by item (row) and tree (column); an item that has no company in a tree is its own one."""
    lists = held.combine_chunks()
    flat = lists.flatten()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out = np.repeat(own[:, None], trees, axis=1)
    out[of, flat.field("tree").to_numpy()] = flat.field(field).to_numpy()
    return out


def _candidates(group: np.ndarray, half: np.ndarray, across: bool, now: np.ndarray, before: np.ndarray | None, leader: np.ndarray):
    """Pairs (i, j) of rows of one group, those that meet first in a tree where this group's leader leads them, and never met before."""
    first, size = near.runs(group)
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        if n < 2:
            continue
        if across:
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(half[a : a + n] == 0), np.flatnonzero(half[a : a + n]), indexing="ij"))
        else:
            i, j = np.triu_indices(n, 1)
        for start in range(0, i.size, PAIRS):
            x, y = a + i[start : start + PAIRS], a + j[start : start + PAIRS]
            same = now[x] == now[y]
            tree = same.argmax(axis=1)
            own = same.any(axis=1) & (now[x, tree] == leader[a])
            if before is not None:
                own[own] = ~(before[x[own]] == before[y[own]]).any(axis=1)
            yield a, n, x[own], y[own]


RESULT = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("stands_for", pa.float64())])


def _verifier(threshold: float, trees: int, depth: int, field: str):
    """The work on a block: rows (id, other) of links that span its classes, rows (id, n, stands_for) of counts."""
    powers = Powers()

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        order = np.argsort(table["leader"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, leader, half = (table[c].to_numpy() for c in ("id", "leader", "half"))
        different, at, which = np.unique(ids, return_index=True, return_inverse=True)
        sets = [np.unique(s) for s in shingle_pieces([unpack(table["packed"][int(k)].as_py()) for k in at], powers)]
        now = _paths(table["held"], field, ids, trees)
        before = _paths(table["held"], "far", ids, trees) if field != "far" else None
        size = np.fromiter((s.size for s in sets), np.int64, len(sets))[which]
        low, high, share, crossed, of = [], [], [], None, None
        for a, n, x, y in _candidates(leader, half, table["low"][0] != table["high"][0], now, before, leader):
            ok = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            x, y = x[ok], y[ok]
            if x.size > 4 * n or of == a:  # most sets are in many pairs
                if of != a:
                    crossed, of = intersections([sets[w] for w in which[a : a + n]]), a
                both = crossed[x - a, y - a].astype(np.float64)
            else:
                both = np.array([np.intersect1d(sets[which[i]], sets[which[j]], assume_unique=True).size for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.float64)
            either = size[x] + size[y] - both
            ok = both >= threshold * either
            low.append(x[ok])
            high.append(y[ok])
            share.append(both[ok] / either[ok])
        x, y, share = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((low, np.int64), (high, np.int64), (share, np.float64)))
        kept = near.spanning(different.size, which[x], which[y])
        stands = 1 / found_chance(share, trees, depth)
        ends = np.concatenate([which[x], which[y]])
        n = np.bincount(ends, minlength=different.size)
        weight = np.bincount(ends, np.tile(stands / 2, 2), minlength=different.size)
        some = np.flatnonzero(n)
        columns = [
            pa.concat_arrays([pa.array(ids[x[kept]]), pa.array(different[some])]),
            pa.concat_arrays([pa.array(ids[y[kept]]), pa.nulls(some.size, pa.int64())]),
            pa.concat_arrays([pa.nulls(len(kept), pa.int64()), pa.array(n[some], pa.int64())]),
            pa.concat_arrays([pa.nulls(len(kept), pa.float64()), pa.array(weight[some], pa.float64())]),
        ]
        return pa.Table.from_arrays(columns, schema=RESULT)

    return run


def items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, item, text): equal texts are one item, a number below 2^63; texts without a word are none."""
    item = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.shiftrightunsigned(F.xxhash64("text"), 1))
    return id_and_text(df, id_col, text_col).select("doc_id", item.alias("item"), "text")


def links(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Of different texts (item, text): rows (id, other) of links that span the classes, and rows (id, n) of counts of links."""
    depth, parts = matched_depth(threshold, trees, DEPTH, recall), near.partitions(docs)
    bins, chunk = trees * (depth + EXTRA), CHUNK

    def keys(batches):
        powers = Powers()
        for batch in batches:
            every = batch.column(0).to_numpy()
            _, at = np.unique(every, return_index=True)
            for start in range(0, at.size, 2048):
                part = at[start : start + 2048]
                texts = (batch.column(1)[int(k)].as_buffer().to_pybytes() for k in part)
                made = np.stack([signature(s, bins) for s in _in_pieces(texts, powers)])
                key, more = labels(made, trees, depth, EXTRA)
                tree = np.broadcast_to(np.arange(trees, dtype=np.uint8), key.shape).ravel()
                key = key.ravel()
                of = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
                yield near.dealt(of, [(key >> np.uint64(32)).astype(np.uint32), tree, more.ravel(), np.repeat(every[part], trees)])

    def texts(batches):
        for batch in batches:
            ids, contents, used = [], [], 0
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(item)
                contents.append(text.as_buffer().to_pybytes())
                used += len(contents[-1])
                if used > BATCH_BYTES // 2:
                    yield near.content_batches(np.array(ids, np.int64), contents, parts)
                    ids, contents, used = [], [], 0
            if ids:
                yield near.content_batches(np.array(ids, np.int64), contents, parts)

    found = checkpointed(trie_paths(docs.mapInArrow(releasing(keys), "part int, blob binary")))
    packed = checkpointed(near.contents(docs.mapInArrow(releasing(texts), "part int, blob binary"), found, parts))
    held = checkpointed(found.groupBy("id").agg(F.collect_list(F.struct("tree", "near", "far", "crowd", "split")).alias("held")))
    made = None
    for level, field, met in ((depth + EXTRA, "far", "crowd"), (depth, "near", "split")):
        led = F.explode(F.expr(f"array_distinct(transform(filter(held, x -> x.{met}), x -> x.{field}))"))
        rows = held.select(led.alias("leader"), "id", F.expr("transform(held, x -> struct(x.tree, x.near, x.far))").alias("held"))

        def kernel(level=level, field=field):
            return _verifier(threshold, trees, level, field)

        new = checkpointed(near.in_blocks(rows, lambda met: met.join(packed, "id"), chunk, BLOCK_ROWS, kernel, "id long, other long, n long, stands_for double"))
        made = new if made is None else made.union(new)
        so_far = made.agg(F.sum("n").alias("n"), F.sum("stands_for").alias("all")).first()
        if so_far["n"] and so_far["n"] / 2 >= recall * so_far["all"]:
            break
    return made


def _in_pieces(texts, powers: Powers):
    """``shingle_pieces`` of an iterator, of which a piece at a time is held."""
    held, used = [], 0
    for text in texts:
        if held and used + len(text) > PIECE:
            yield from _shingles(held, powers)
            held, used = [], 0
        held.append(text)
        used += len(text)
    if held:
        yield from _shingles(held, powers)


def forest_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): each document's class, and with how many other texts its text is linked."""
    ship(df.sparkSession)
    named = items(df, id_col, text_col)
    made = links(named.filter("item IS NOT NULL").select("item", "text"), threshold, trees, recall)
    roots = near.classes(made.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = made.filter("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n_links"))
    texts = named.filter("item IS NOT NULL").groupBy("item").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    placed = texts.join(roots.withColumnRenamed("id", "item"), "item", "left").withColumn("root", F.coalesce("root", "item")).join(counts.withColumnRenamed("id", "item"), "item", "left")
    # classes of one document need no row
    placed = checkpointed(placed.filter("copies > 1 OR n_links IS NOT NULL").select("item", "root", "first_id", "n_links"))
    # a table of its own, so that adaptive execution can split a very large class
    smallest = checkpointed(placed.groupBy("root").agg(F.min("first_id").alias("class_id")))
    salt = F.explode(F.sequence(F.lit(0), F.lit(near.SALTS - 1))).alias("salt")
    known = placed.join(smallest, "root").select("item", "class_id", "n_links", salt)
    # a text may have a third of all rows
    docs = named.select("doc_id", "item", F.pmod(F.xxhash64("doc_id"), F.lit(near.SALTS)).cast("int").alias("salt"))
    return docs.join(known, ["item", "salt"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id names their class: one document of each group, the one with the smallest id.  A row with a
    null id stays if no other row of its class has one."""
    gone = fresh(df, "gone_id")
    dropped = forest_join(df, id_col, text_col).filter("class_id != doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return df.join(dropped, F.col(id_col).cast("long") == F.col(gone), "left_anti")
