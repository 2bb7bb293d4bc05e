"""Nulls, empty and long texts, repeats, empty tables and clashing columns; and plain versions of what is learned."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import decontaminate, jaccard, kneser_ney, licences, lines, media, mixing, pii, quality, queries, secrets, stages, tokens

SF = "/root/testdata/sf0.001"
NAMES = (
    "gone_id", "dropped_id", "class_id", "item", "root", "salt", "n_links", "lost_key", "lost_lines", "row_key", "dropped", "line", "first", "nll", "mark", "trusted_id", "block",
    "_block", "own_mean", "own_cut", "no_lang", "held_lang", "share", "n_symbols", "perplexity", "score", "threshold", "keep", "edits", "item_id", "size", "bucket", "sid", "place",
    "key", "nth", "pieces", "shard", "unit", "kind", "named", "plain", "found", "dir", "own", "spans", "payload", "n_bytes", "n_tokens", "features", "id", "_0", "_1",
)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n\t", say(40) + "\n" + say(30), say(200), "word " * 60_000, say(12) + " x" * 30, "é日本🙂\n" * 20]
    texts += [texts[4], texts[4] + " end", say(50) + "\n" + texts[3].split("\n")[1] + "\n" + say(20)] + [say(60) for _ in range(12)]
    return [(i, t, "en" if i % 5 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s1", 5), (None, None, None, None, None), (4, texts[4], "en", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.selectExpr("*", *(f"concat('own ', '{n}', doc_id) AS `{n}`" for n in NAMES)).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def values(df):
    return Counter(tuple(repr(v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_filters_pass_rows_through_whatever_their_columns(spark, docs, labels):
    bench = spark.createDataFrame([(1, "no such words in any text here"), (2, None), (2, ""), (1, "no such words in any text here")], "item_id long, text string")
    whole = values(docs)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and not values(kept) - whole
    single = jaccard.keep_one(docs)
    assert single.columns == docs.columns and not values(single) - whole
    left = {r.doc_id for r in single.select("doc_id").collect()}
    assert {0, 1, 2, 3, 4, 5} <= left and not {8, 9} & left
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and values(clean) == whole
    deduped = lines.dedup_lines(docs)
    assert deduped.columns == docs.columns
    at = docs.columns.index("text")
    assert not Counter(r[:at] + r[at + 1 :] for r in values(deduped).elements()) - Counter(r[:at] + r[at + 1 :] for r in whole.elements())


def test_results_do_not_depend_on_other_columns(spark, docs, labels):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    path = "concat('/d/', coalesce(lang, 'x'), '/f', doc_id) AS path"
    for run in (
        lambda d: lines.duplicate_lines(d), lambda d: mixing.mix(d), lambda d: licences.scan(d.selectExpr("*", path)), lambda d: tokens.token_counts(d, queries.tokenizer_path()),
        lambda d: media.media_features(d), lambda d: pii.find_personal_data(d), lambda d: secrets.find_secrets(d), lambda d: jaccard.forest_join(d),
    ):
        assert values(run(docs)) == values(run(plain))


def test_empty_tables_give_empty_results(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard.keep_one(none).count() == lines.dedup_lines(none).count() == quality.keep_good(none, labels).count() == mixing.mixed_blocks(none).count() == 0


def test_stages_take_nulls_and_extra_columns(spark, docs):
    """The classifier's labels and the benchmark are the small tables'; each stage works on what the one before it kept."""
    import corpus_pipeline

    kept = docs.select("doc_id", "text", "lang", "source", "n_chars", "mark", "item")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == kept.columns and not set(map(tuple, out.drop("text", "n_chars").collect())) - set(map(tuple, kept.drop("text", "n_chars").collect()))
        kept = out
    mixed = stages.mixing_blocks(spark, kept, SF).collect()
    assert mixed and {i for r in mixed for i in r.doc_ids} <= {r.doc_id for r in kept.select("doc_id").collect()}


def plain_kneser_ney(texts):
    """Probabilities of the last of four symbols, from dictionaries; written from the formula, without the module's arrays."""
    def grams(text):
        s = [0, 0, 0, *kneser_ney.symbols(text).tolist()]
        return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]

    level = {4: Counter(g for t in texts for g in grams(t))}
    for n in (3, 2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    discount, total, spread = {}, defaultdict(Counter), defaultdict(Counter)
    for n in (2, 3, 4):
        n1, n2, n3, n4 = (sum(c == j for c in level[n].values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        discount[n] = [min(max(x, low), high) for x, low, high in zip(d, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85))]
        for g, c in level[n].items():
            total[n][g[:-1]] += c
            spread[n][g[:-1]] += discount[n][min(c, 3) - 1]
    seen, everything = len(level[1]), sum(level[1].values())
    d = min(0.75, everything / seen / 2)

    def probability(g):
        p = (max(level[1][g[3:]] - d, 0) + d * seen / kneser_ney.SYMBOLS) / everything
        for n in (2, 3, 4):
            own, context = g[4 - n :], g[4 - n : 3]
            if total[n][context]:
                c = level[n][own]
                p = (c - discount[n][min(c, 3) - 1] if c else 0) / total[n][context] + spread[n][context] / total[n][context] * p
        return p

    def perplexity(text):
        found = grams(text or "")
        return math.exp(-sum(math.log(probability(g)) for g in found) / len(found)) if found else None

    return perplexity


def test_perplexities_equal_a_plain_model(spark, rows, labels):
    docs = spark.createDataFrame([r for r in rows if len(r[1] or "") < 5000], "doc_id long, text string, lang string, source string, n_chars long")
    trusted = [r.text for r in quality.marked(docs, labels).filter("mark = 1").collect() if r.text]
    perplexity = plain_kneser_ney(trusted)
    text = defaultdict(set)
    for i, t, *_ in docs.collect():
        text[i].add(t)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        want = [perplexity(t) for t in text[r.doc_id]]
        assert any(r.perplexity is None if w is None else r.perplexity is not None and abs(r.perplexity / w - 1) < 1e-4 for w in want)


def test_added_spans_equal_a_plain_run(spark):
    rnd = random.Random(5)
    parts = ["call my phone (212) 555-0187", "order invoice 111-111-1111", "SSN 219-09-9999", "part no 000-12-3456", "Dr. Anna Schmidt", "by Mr. Foo", "joe [at] mail [dot] com", "x [at] y.zz", "IBAN DE89 3704 0044 0532 0130 00", "GB00 AAAA 1111 2222", "mail a.b@c.com", "card 4111111111111111", "10.0.0.7"]
    texts = [None, "", *(" and ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    few = df.filter("doc_id < 60")
    counts = Counter((k, pii.votes(t, a, b, k)) for t in texts[:60] if t for base in [pii.base_spans(t)] for a, b, k in base + pii.loose_spans(t, base))
    assert max(counts.values()) <= pii.SAMPLE
    sample = [(k, pii.votes(t, a, b, k), pii.features(t, a, b, k)) for t in texts[:60] if t for base in [pii.base_spans(t)] for a, b, k in base + pii.loose_spans(t, base)]
    w = pii.train([(k, v, n) for (k, v), n in counts.items()], sample)
    assert np.allclose(pii.fit(few), w, atol=1e-6)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(few).collect()}
    for i, t in enumerate(texts[:60]):
        base = pii.base_spans(t) if t else []
        added = [s for s in (pii.loose_spans(t, base) if t else []) if pii.chance(w, pii.features(t, *s)) > 0.5]
        assert got[i] == pii.joined(sorted(base + added, key=lambda s: (s[0], pii.ORDER[s[2]], s[1])))


def test_novel_spans_equal_a_plain_run(spark):
    rnd = random.Random(8)
    word = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [None, "", "secret key: internationalizationconfigurationmanager9 ends"] + [f"the auth header {word(rnd.randint(8, 40), letters)} is set\nuser_name = {i}\nother {word(24, letters)} text" for i in range(40)] * 2
    names = ["user_name"]
    novelty = secrets.Novelty(names)
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        base = secrets.base_spans(t) if t else []
        novel = [(a, b, "novel") for a, b in (secrets.candidates(t, base) if t else []) if novelty.of(t, a, b) >= secrets.NOVELTY]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + novel, key=lambda s: (s[0], secrets.ORDER[s[2]], s[1])))
    assert got[2] == "" and sum("novel" in got[i] for i in range(3, 83)) > 60
