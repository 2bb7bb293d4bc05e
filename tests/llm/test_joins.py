"""The joins, the classifier, mixing, licences and the pipeline: against brute force, held-out labels and SQL."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.compare import connect, same_rows
from tracewright.llm import decontaminate, jaccard, kneser_ney, licences, lines, mixing, near, quality, queries, stages
from tracewright.llm._frames import freed
from tracewright.llm.near import Powers

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(8)
    texts = [None, "", "   \n", "one two three", "one two three", "one  two three"]
    for _ in range(12):
        base = words(rnd, rnd.randrange(30, 160))
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            near_copy = list(base)
            for _ in range(rnd.randrange(3)):
                near_copy[rnd.randrange(len(near_copy))] = "changed"
            texts.append(" ".join(near_copy))
    shared = words(rnd, 60)
    texts += [" ".join(shared + words(rnd, 120)) for _ in range(25)]
    chain = words(rnd, 200)
    for k in range(5):  # each like the next, the ends unlike
        texts.append(" ".join([f"x{j}" for j in range(4 * k)] + chain[4 * k :]))
    return texts


def test_forest_join_equals_brute_force(spark, copies):
    df = spark.createDataFrame([(*r, "clash") for r in rows_of(copies)], COLUMNS + ", class_id string")
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in enumerate(copies)}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = jaccard.forest_join(df).collect()
    assert {r.doc_id: r.class_id for r in got} == roots(pairs, sets)
    linked = {x for a, b in pairs if copies[a] != copies[b] for x in (a, b)}
    assert {r.doc_id for r in got if r.n_links} <= linked
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == set(roots(pairs, sets).values())


@pytest.mark.parametrize("chunk", [4, 32, jaccard.CHUNK])
def test_every_link_of_a_class_counts(spark, monkeypatch, copies, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rnd = random.Random(3)
    base = words(rnd, 150)
    texts = copies + [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(5, 145, 7)] + [" ".join(base)] * 2
    sets = {t: set(jaccard.shingles(t).tolist()) for t in texts if t and t.strip()}
    links = Counter(x for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for x in (a, b))
    got = jaccard.forest_join(spark.createDataFrame(rows_of(texts), COLUMNS)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[t] for i, t in enumerate(texts)}


def test_forest_join_of_nothing(spark):
    assert jaccard.forest_join(spark.createDataFrame([], COLUMNS)).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in jaccard.forest_join(none).collect()) == [(0, 3), (1, 1), (2, 2), (3, 3)]


def test_depth_reaches_its_recall():
    assert jaccard.matched_depth(0.8, 63, 12, 0.99999) == 8
    assert jaccard.matched_depth(0.8, 4, 12, 0.999999) == 1


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_keys(edits):
    rnd = random.Random(edits)
    for _ in range(1500):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            q = rnd.randrange(len(b) + 1)
            b[q : q + rnd.randrange(2)] = rnd.choice(["", "a", "b", "c"])
        b = "".join(b)
        close = edit_distance(a, b) <= edits
        assert lines.within(a, b, edits) == close
        if close and a != b and min(len(a), len(b)) > edits:
            keys, owners = lines.line_keys([a, b], edits)
            assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(2)
    pool = [" ".join(words(rnd, rnd.randrange(10, 16))) for _ in range(25)] + ["short line", "tiny"]
    texts = [None, "", "\n\n"]
    for _ in range(40):
        picked = []
        for line in rnd.sample(pool, 3):
            for _ in range(rnd.randrange(3)):
                q = rnd.randrange(len(line))
                line = line[:q] + rnd.choice(["z", "", line[q] + "q"]) + line[q + 1 :]
            picked.append(line)
        texts.append("\n".join(picked))
    texts.append(texts[5])
    where = [(i, k, x) for i, t in enumerate(texts) for k, x in lines._lines(t)]
    distinct = sorted({x for *_, x in where})
    pairs = [(a, b) for a, b in itertools.combinations(distinct, 2) if min(len(a), len(b)) >= lines.SHORTEST_NEAR and edit_distance(a, b) <= lines.EDITS]
    root, first, dropped = roots(pairs, distinct), set(), defaultdict(list)
    for i, k, x in where:
        if root[x] in first:
            dropped[i].append(k)
        first.add(root[x])
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    got = {r.doc_id: r.dropped for r in lines.duplicate_lines(df).collect()}
    assert got == {i: ",".join(map(str, dropped[i])) for i in range(len(texts))}
    left = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for i, t in enumerate(texts):
        want = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in dropped[i])
        assert left.get(i) == (t if not dropped[i] else want if want.strip() else None)


def test_edits_grow_with_the_line(spark):
    rnd = random.Random(11)
    texts, expected = [], {}

    def family(line, edits):
        other = line
        for q in sorted(rnd.sample(range(len(line)), edits), reverse=True):
            other = other[:q] + rnd.choice(["#", ""]) + other[q + 1 :]
        texts.extend([line, other])
        expected[len(texts) - 2], expected[len(texts) - 1] = "", "0" if lines.similar(line, other) else ""
        return lines.similar(line, other)

    for _ in range(12):
        assert family(" ".join(words(rnd, 110, 5000))[:380], 11)  # 11 edits in 380 characters
        assert not family(" ".join(words(rnd, 110, 5000))[:380].replace(" ", "-"), 40)
        assert family(" ".join(words(rnd, 40, 5000))[:130], 3)
    texts += ["Are is anwh reenen.", "Are, is anwh reenen.", "Les.", "Les.", "Das."]  # one edit in 19; equal and short
    expected |= dict(zip(range(len(texts) - 5, len(texts)), ["", "0", "", "0", ""], strict=True))
    edge = "x" + " ".join(words(rnd, 20, 5000))[:38]  # 39 characters meet 40
    texts += [edge, edge[:20] + "#" + edge[20:]]
    expected |= {len(texts) - 2: "", len(texts) - 1: "0"}
    got = {r.doc_id: r.dropped for r in lines.duplicate_lines(spark.createDataFrame(rows_of(texts), COLUMNS)).collect()}
    assert got == expected


def test_wide_bands():
    rnd = random.Random(5)
    for _ in range(200):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(30, 90)))
        b = list(a)
        for _ in range(rnd.randint(0, 16)):
            q = rnd.randrange(len(b))
            b[q : q + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
        b, edits = "".join(b), rnd.randint(4, 12)
        assert lines.within(a, b, edits) == (edit_distance(a, b) <= edits)


def test_repeated_rows_are_one_document(spark):
    line = "a line of enough letters to be compared"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "\nother words in the second line")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in lines.duplicate_lines(df).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert lines.duplicate_lines(df.limit(0)).count() == 0


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    items = [" ".join(words(rnd, n, 60)) for n in (3, 8, 15, 30)] + ["w1", "", None, "Mixed CASE  item\nof words"]
    texts = [None, ""]
    for _ in range(60):
        item = list(rnd.choice([x for x in items if x]))
        for _ in range(rnd.randrange(10)):
            q = rnd.randrange(len(item))
            item[q : q + rnd.randrange(2)] = rnd.choice(["", "x", "7"])
        texts.append(" ".join(words(rnd, 10, 60)) + " " + "".join(item) + " " + " ".join(words(rnd, 10, 60)))
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            x = decontaminate.normal(x or "")
            if x and t and (e := least_edits(x, decontaminate.normal(t))) <= decontaminate.edits_allowed(len(x)):
                want[i, k] = e
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 200)
    assert {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 == decontaminate.find_leaks(docs.limit(0), bench).count()


def test_kneser_ney_is_a_distribution():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcd ") for _ in range(3000))
    codes, counts = np.unique(kneser_ney.ngrams(text, 5), return_counts=True)
    shard = kneser_ney.Shard(codes, counts)
    stats = kneser_ney.Statistics(shard.statistics())
    for context in (codes[0], codes[100], np.uint64(5 << 40 | 1 << 30 | 2 << 20 | 3 << 10)):
        every = (context & ~kneser_ney.MASK) | np.arange(kneser_ney.SYMBOLS, dtype=np.uint64)
        assert abs(np.exp(kneser_ney.log_probabilities(shard, stats, every)).sum() - 1) < 1e-9


def test_shards_give_what_one_model_gives():
    rnd = random.Random(2)
    codes, counts = np.unique(kneser_ney.ngrams("".join(rnd.choice("abcdef é") for _ in range(4000)), 9), return_counts=True)
    whole = kneser_ney.Shard(codes, counts)
    stats = kneser_ney.Statistics(whole.statistics())
    want = kneser_ney.log_probabilities(whole, stats, codes)
    of = kneser_ney.shard_of(codes, 5)
    sums: Counter = Counter()
    for s in range(5):
        part = kneser_ney.Shard(codes[of == s], counts[of == s])
        sums.update(part.statistics())
        assert np.allclose(kneser_ney.log_probabilities(part, stats, codes[of == s]), want[of == s])
    assert sums == Counter(whole.statistics())


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r.keep for r in quality.classify(docs, half).collect()}
    held = [r for r in labels.collect() if r.doc_id % 2]
    good = [got[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) == len(good) and sum(bad) <= 0.25 * len(bad)


def test_thresholds_do_not_jump_with_the_sample(spark, monkeypatch):
    """Languages of more and of fewer held-out documents than ENOUGH get quantiles that are drawn together, and no wider tolerance."""
    scores = [(i, la, 0 if i % 2 else 2, 1000, 1000.0 * (level + i % 7 / 100)) for la, n, level in (("a", 400, 1.0), ("b", 42, 1.3), ("c", 38, 1.3), ("d", 2, 1.3)) for i in range(n)]
    table = spark.createDataFrame(scores, "doc_id long, lang string, mark int, n_symbols long, nll double")
    monkeypatch.setattr(quality, "scored", lambda *_: table)
    rows = quality.classify(table, table).collect()
    cut = {r.lang: r.threshold for r in rows}
    allowance = 1.5 ** (20 / (20 + 241))
    assert cut["a"] <= np.exp(1.09) * allowance and abs(cut["b"] / cut["c"] - 1) < 0.01
    assert max(cut.values()) <= np.exp(1.37) * allowance
    assert all(r.keep for r in rows)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "a"), (2, "", "en", "b"), (None, "some text", "en", "c"), (4, "z" * 5000, "xx", "d")], "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 4 and all(r.keep for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_mix_reaches_its_targets(spark):
    texts = [None, "", "one", *(" ".join(["w"] * n) for n in (10, 300, 129, 128, 1, 999))] * 2
    rows = [(i, t, [None, "a", "b", "big"][i % 4]) for i, t in enumerate(texts)] + [(100 + i, "x " * 700, "big") for i in range(40)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) + 1
    by = defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), docs in by.items():
        assert sum(r.taken for r in docs) == int(target) and sum(r.size for r in docs) == size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5, "source")).collect()), key=str)
    pieces = mixing.mixed_blocks(df).collect()
    assert sum(p.n_words for p in pieces) == sum(r.taken for r in got) and all(len(p.text.split()) == p.n_words for p in pieces)
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.mixed_blocks(df.limit(0)).count()


def test_pieces_join_to_the_texts(spark):
    rnd = random.Random(9)
    texts = ["  lead\n\tand " + "".join(w + rnd.choice([" ", "\n", "\n\t", "  "]) for w in words(rnd, n)) for n in (3, 130, 700, 2000)] + ["one", " \n", None, ""]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s")] * 2 + [(None, texts[2], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(dict)
    for p in mixing.mixed_pieces(df, share=2.0).collect():  # at twice the words, every block is taken twice
        split = re.findall(mixing.TOKEN, texts[2 if p.doc_id is None else p.doc_id])
        assert p.text == "".join(split[p.begin : p.begin + p.n_words]) and p.ends == (p.begin + p.n_words == len(split))
        by[p.sid, p.doc_id][p.begin] = p.text
    assert set(by) == {(1, i) for i in range(5)} | {(2, None)}
    once = {k: "".join(v[b] for b in sorted(v)) for k, v in by.items() if k[1] != 1}  # the copies of 1 are cut in other places
    assert once == {(1, i): texts[i] for i in (0, 2, 3, 4)} | {(2, None): texts[2]}
    blocks = mixing.mixed_blocks(df, share=2.0).collect()
    assert all(len(b.text.split()) == b.n_words <= 128 and len(b.doc_ids) == len(set(b.doc_ids)) or 1 in b.doc_ids for b in blocks)
    assert sum(b.n_words for b in blocks) == 2 * sum(len((t or "").split()) for _, t, _ in rows)


def test_permutations_have_no_stride(spark):
    """Each pass takes every block once; neighbours are as far apart as chance puts them; shards get a multinomial draw."""
    sources = spark.createDataFrame([(1, 128 * 3000, 128.0 * 6000), (2, 128 * 1000, 128.0 * 1500)], "sid int, source_size long, target double")
    rows = mixing.slots(sources, 128, 64, 5).collect()
    for sid, n, passes in ((1, 3000, 2), (2, 1000, 1)):
        own = sorted((r.slot, r["index"]) for r in rows if r.sid == sid)
        assert [s for s, _ in own] == list(range(len(own)))
        orders = [[i for s, i in own if s // n == k] for k in range(passes + (sid == 2))]
        assert all(sorted(o) == list(range(n)) for o in orders[:passes]) and len(set(map(tuple, orders))) == len(orders)
        strides = Counter((b - a) % n for a, b in zip(orders[0], orders[0][1:]))
        assert max(strides.values()) <= 8
    assert len(rows) == 7500
    counts = Counter(r.shard for r in rows if r.sid == 2)
    assert len({r.shard for r in rows}) > 100 and 0.6 < np.var(list(counts.values())) / np.mean(list(counts.values())) < 1.5


def test_licences_inherit_from_the_nearest_directory(spark):
    rows = [
        (1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "/a/b/c/x.txt", "nothing here " * 50),
        (4, "/a/y.txt", "nothing here " * 50), (5, "/z/w.txt", None), (6, None, ""), (7, "/a/own.txt", "words " * 200 + "\nThis work is licensed under the GNU General Public License, version 3.\n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS licence", "2 AS dir")
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(df).collect()}
    assert got[1] == ("MIT", "notice") and got[3] == ("Apache-2.0", "directory:/a/b") and got[4] == ("MIT", "directory:/a")
    assert got[5] == got[6] == (None, "none") and got[7] == ("GPL-3.0", "notice")
    assert licences.scan(df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """# Copyright 2019 Some Body
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice,
#    this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
# 3. Neither the name of the copyright holder nor the names of its contributors
#    may be used to endorse or promote products derived from this software
#    without specific prior written permission.

import os
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */

int main() { return 0; }
"""


def test_licences_by_text_header_tag_and_directory(spark):
    code = "def f(x):\n    return x\n\n" * 40
    rows = [(1, "/a/LICENSE", MIT), (2, "/a/f.py", code), (3, "/b/g.py", BSD + code), (4, "/c/h.py", "# SPDX-License-Identifier: Apache-2.0\n" + code), (5, "/d/m.c", GPL), (6, "/e/x.py", code), (7, "/a/deep/er/f.py", code), (8, "/g/s.c", "// SPDX-License-Identifier: GPL-2.0-or-later\n" + code)]
    rows += [(i, f"/g/{i}.py", code) for i in range(20, 30)] + [rows[2]]
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "notice") and got[2] == ("MIT", "directory:/a") == got[7] and got[3] == ("BSD-3-Clause", "notice")
    assert got[4] == ("Apache-2.0", "notice") and got[5] == ("GPL-3.0", "notice") and got[6] == (None, "none") and got[8] == ("GPL-2.0", "notice")


def test_ties_of_licences_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "/a/x", "SPDX-License-Identifier: MIT OR ISC"), (2, "/a/x", "SPDX-License-Identifier: MIT OR ISC"), (3, "/b/x", "long " * 60_000)], "doc_id long, path string, text string")
    assert {r.doc_id: r.licence for r in licences.scan(df).collect()} == {1: "ISC", 2: "ISC", 3: None}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


def test_classes_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in near.classes(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    assert [f for _, f in corpus_pipeline.STAGES] == [stages.quality_filter, stages.line_dedup, stages.near_duplicates, stages.decontamination, stages.mixing_blocks]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.6 * docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, SF).filter("n_words > 0").count() > 0


def test_chance_candidates_of_lines_are_few():
    rnd = random.Random(31)
    shares = {"edited": 0, "turned": 0}
    for _ in range(40):
        a, b = (" ".join(words(rnd, 60, 5000))[:200] for _ in range(2))
        some = [a + b, "#" + a[:100] + "#" + a[101:] + b, b + a]
        keys = lines.sketch_keys(lines.Hashes(some, Powers(0)), np.arange(3))[0].reshape(3, -1)
        shares["edited"] += (keys[0] == keys[1]).mean() / 40
        shares["turned"] += (keys[0] == keys[2]).mean() / 40
    assert shares["edited"] > 0.7 and shares["turned"] < 0.25  # n-grams in another order are another key


def test_buckets_are_cut_where_lengths_are_too_far_apart():
    length = np.array([80, 84, 88, 100, 200, 210, 221, 233, 90])
    key = np.array([1] * 8 + [2])
    assert lines.cut_by_length(key, length, 2).tolist() == [0, 0, 0, 1, 2, 2, 3, 4, 5]
    rnd = random.Random(7)
    for _ in range(200):  # lines within their edits stay together
        length = np.sort(np.array([rnd.randrange(80, 400) for _ in range(12)]))
        cut = lines.cut_by_length(np.zeros(12, np.int64), length, 2)
        assert all(cut[i] == cut[j] for i, j in itertools.combinations(range(12), 2) if length[j] - length[i] <= lines.allowed(int(length[i])))


def test_line_dedup_leaves_no_shuffle_files(spark):
    rnd = random.Random(41)
    texts = ["\n".join(" ".join(words(rnd, 20)) for _ in range(4)) for _ in range(60)]
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return sum(str(x).startswith("shuffle_") for x in files.getAllBlocks().mkString("\n").split("\n"))

    freed(spark)
    time.sleep(2)
    before = held()
    lines.dropped_lines(spark.createDataFrame(rows_of(texts * 2), COLUMNS))
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
