"""Personal data by weak supervision.

Patterns give candidate spans: the four base kinds (email, ip, card, phone), which are exact and always reported, and
looser kinds (national numbers, bank accounts, undelimited phones, spelt-out emails, titled names).  Six labelers vote on
every candidate: pattern checks, a gazetteer, cue words before it, counter-cues, its boundaries and its variety.  The
votes of all candidates of the corpus are counted by (kind, votes); expectation-maximisation over that table
estimates the reliability of each labeler and the share of true spans of each kind.  A logistic classifier of the span's own
shape and of the words around it is trained on the estimated labels; it has features that no labeler looks at, and decides
which of the looser candidates are reported.

The table of votes has at most ``len(KINDS) * 3 ** len(LABELERS)`` rows at any size of corpus.  The classifier is fitted on at
most ``SAMPLE`` candidates of each of those rows, those of the least hashes, weighed by what they stand for.  Only these
two tables go to the driver.

Defined results: a null or empty text has no spans.  A corpus without candidates trains nothing and reports base spans
alone.  Spans are in code points, end exclusive.  Repeated rows give equal rows and count as evidence once each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import checkpointed, id_and_text, map_documents, releasing, to_batch

BASE = ("email", "ip", "card", "phone")
LOOSE = ("national_id", "iban", "local_phone", "spelt_email", "name")
KINDS = BASE + LOOSE
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("check", "gazetteer", "cue", "counter_cue", "boundary", "variety")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried once, from its first digit: later starts in the run end alike
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TWO_DIGITS = re.compile(r"[0-9][0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOOSE_PATTERNS = {
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "spelt_email": re.compile(r"(?<=[A-Za-z0-9]) ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)?"),
}
# Fixed word lists of the gazetteer and context labelers.
TLDS = frozenset(
    "com org net edu gov mil int info biz io co ai app dev eu us ca mx br ar cl uk ie fr de at ch li nl be lu es pt it gr pl cz sk hu ro bg si hr rs dk se no fi is "
    "ee lv lt ua ru tr il za eg ng ke in pk cn jp kr tw hk sg my th vn id ph au nz example".split()
)
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy "
    "anthony mark paul steven andrew emma olivia anna maria jean marie pierre michel philippe nathalie isabelle nicolas julien camille hans peter klaus jürgen wolfgang karl "
    "julia sabine monika petra stefan andreas lukas leon jose juan antonio manuel carmen luis francisco dolores pilar javier carlos lucia sofia laura lucas giovanni giulia marco".split()
)
# Countries whose bank accounts have numbers of the international form.
COUNTRIES = frozenset(
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MT MU NL NO PK PL PS PT QA RO "
    "RS SA SE SI SK SM TN TR UA VG XK".split()
)
CUES = {
    "email": r"e-?mail|contact|write|reach|address|mailto", "ip": r"\bip\b|host|address|server|login|client", "card": r"card|visa|master|credit|payment|pay",
    "phone": r"phone|tel\b|call|mobile|fax|cell", "national_id": r"ssn|social|security|passport|identity", "iban": r"iban|bank|account|konto|compte|cuenta",
    "local_phone": r"phone|tel\b|call|mobile|fax|cell", "spelt_email": r"e-?mail|contact|write|reach|address", "name": r"dear|patient|signed|from|contact|by",
}
CUES = {k: re.compile(v, re.IGNORECASE) for k, v in CUES.items()}
COUNTER = re.compile(r"version|release|isbn|issn|order|invoice|part no|build|figure|table|chapter|section|serial", re.IGNORECASE)
#: Code points before a candidate that the context labelers read.
CONTEXT = 40
#: Candidates of each kind and ballot that the classifier is fitted on at most, slots that words are hashed to, and salts of the sample.
SAMPLE, SLOTS, SALTS = 64, 64, 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The (start, end, kind) of the base kinds, in order; each text position is read a bounded number of times."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of the other kinds that no base span touches."""
    out = []
    digits = TWO_DIGITS.search(text) is not None
    for kind, pattern in LOOSE_PATTERNS.items():
        # each pattern is tried only where a text has what any match needs
        if kind == "spelt_email" and not any(s in text for s in ("[at", "[AT", "(at", "(AT")):
            continue
        if kind == "name" and not any(s in text for s in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")):
            continue
        if kind in ("national_id", "iban", "local_phone") and not digits:
            continue
        for m in pattern.finditer(text):
            start = m.start()
            if kind == "spelt_email":
                while start > 0 and text[start - 1] in LOCAL:
                    start -= 1
            if not any(a < m.end() and start < b for a, b, _ in base):
                out.append((start, m.end(), kind))
    return out


def _iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """The labelers' votes on one candidate: 1 for, -1 against, 0 none."""
    value, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = NOT_DIGIT.sub("", value)
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        check = 1 if _iban_valid(value) else -1
    elif kind == "national_id":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "local_phone":  # neither area nor exchange starts with 0 or 1
        check = -1 if digits[0] in "01" or digits[3] in "01" else 1
    elif kind == "phone":
        check = 1 if 10 <= len(digits) <= 15 else -1
    else:
        check = 0
    if kind in ("email", "spelt_email"):
        gazetteer = 1 if re.split(r"[.\])\s]+", value.lower())[-1] in TLDS else -1
    elif kind == "name":
        gazetteer = 1 if any(w.lower() in GIVEN for w in value.split()[1:]) else 0
    elif kind == "iban":
        gazetteer = 1 if value[:2] in COUNTRIES else -1
    elif kind == "ip":
        gazetteer = -1 if value.split(".")[0].lstrip("0") in ("", "127") else 1
    else:
        gazetteer = 0
    cue = 1 if CUES[kind].search(before) else 0
    counter = -1 if COUNTER.search(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    boundary = -1 if left.isalnum() or right.isalnum() else 1
    variety = (0 if not digits else 1 if len(set(digits)) >= 4 else -1) if kind != "name" else 0
    return check, gazetteer, cue, counter, boundary, variety


def estimate(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted votes: (share of true spans by kind, labeler accuracies, each row's chance to be true).

    A labeler errs alike on true and false spans; beta priors (for accuracies, 8 right of 10 votes; for shares, 2 true
    of 4) keep every estimate inside (0, 1), so that unanimous or scarce votes are no special case.
    """
    kinds = np.array([ORDER[k] for k, _, _ in table])
    ballots = np.array([v for _, v, _ in table], dtype=float).reshape(len(table), len(LABELERS))
    weight = np.array([n for _, _, n in table], dtype=float)
    accuracy, share = np.full(len(LABELERS), 0.8), np.full(len(KINDS), 0.5)
    chance = np.full(len(table), 0.5)
    cast = ballots != 0
    for _ in range(rounds):
        odds = ballots @ np.log(accuracy / (1 - accuracy)) + np.log(share / (1 - share))[kinds]
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        agree = np.where(ballots > 0, chance[:, None], 1 - chance[:, None]) * cast
        accuracy = np.clip(((weight[:, None] * agree).sum(0) + 8) / ((weight[:, None] * cast).sum(0) + 10), 0.51, 0.99)
        total = np.bincount(kinds, weight, len(KINDS))
        share = (np.bincount(kinds, weight * chance, len(KINDS)) + 2) / (total + 4)
    return {k: float(share[i]) for k, i in ORDER.items()}, accuracy, chance


WORDS = re.compile(r"[^\W\d_]+")
#: Features: one, the kinds, 6 lengths, 6 numbers of digits, 5 numbers of signs, 4 cases, and words before, after and inside.
SIZE = 1 + len(KINDS) + 6 + 6 + 5 + 4 + 3 * SLOTS


def _slot(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % SLOTS


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Which of the classifier's features a span has: its kind, shape and words, and the words around it."""
    value = text[start:end]
    digits, signs = sum(c.isdigit() for c in value), sum(not c.isalnum() for c in value)
    case = 0 if value.islower() else 1 if value.isupper() else 2 if value.istitle() else 3
    at, out = 1, [0]
    for has, size in ((ORDER[kind], len(KINDS)), (min(len(value) // 6, 5), 6), (min((digits + 2) // 3, 5), 6), (min(signs, 4), 5), (case, 4)):
        out.append(at + has)
        at += size
    before = WORDS.findall(text[max(0, start - CONTEXT) : start])[-4:]
    after = WORDS.findall(text[end : end + CONTEXT])[:2]
    for words in (before, after, WORDS.findall(value)[:4]):
        out += {at + _slot(w) for w in words}
        at += SLOTS
    return sorted(out)


def chance(w: np.ndarray, found: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[found].sum(), -30, 30))))


def train(table: list[tuple[str, tuple[int, ...], int]], sample: list[tuple[str, tuple[int, ...], list[int]]], ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of the span classifier: ridge logistic regression on the estimated labels, by Newton's method.

    ``table`` counts (kind, ballot); ``sample`` has candidates as (kind, ballot, features), each standing for its share of the count.
    """
    w = np.zeros(SIZE)
    if not table or not sample:
        return w
    table = sorted(table)
    _, _, estimated = estimate(table)
    label = {(k, v): (float(p), n) for (k, v, n), p in zip(table, estimated, strict=True)}
    # equal candidates are one row
    rows = Counter((tuple(found), kind, ballot) for kind, ballot, found in sample)
    size = Counter()
    for (_, kind, ballot), n in rows.items():
        size[kind, ballot] += n
    x = np.zeros((len(rows), SIZE))
    target, weight = np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((found, kind, ballot), n) in enumerate(sorted(rows.items())):
        x[i, list(found)] = 1
        target[i], count = label[kind, ballot]
        weight[i] = n * count / size[kind, ballot]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(SIZE)
        w = w + np.linalg.solve(hessian, gradient)
    return w


VOTES = pa.schema([("kind", pa.string()), ("ballot", pa.string()), ("n", pa.int64()), ("mark", pa.int64()), ("features", pa.list_(pa.int32()))])


def vote_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, ballot, n, mark, features): each task's candidates of the least hashes, up to ``SAMPLE`` of a kind and ballot, the first
    of them with the number of all."""
    sample = SAMPLE

    def run(batches):
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            for text in batch.column(1):
                if not (text := text.as_py()):
                    continue
                base = base_spans(text)
                for a, b, kind in base + loose_spans(text, base):
                    own = held.setdefault((kind, ",".join(map(str, votes(text, a, b, kind)))), [0, []])
                    own[0] += 1
                    mark = zlib.crc32(text[max(0, a - CONTEXT) : b + CONTEXT].encode("utf-8", "surrogatepass"), a) << 31 ^ a
                    own[1].append((mark, tuple(features(text, a, b, kind))))
                    if len(own[1]) >= 2 * sample:
                        own[1] = sorted(own[1])[:sample]
        rows = [(kind, ballot, 0 if i else n, mark, list(found)) for (kind, ballot), (n, some) in held.items() for i, (mark, found) in enumerate(sorted(some)[:sample])]
        if rows:
            yield to_batch(rows, VOTES)

    return id_and_text(df, id_col, text_col).mapInArrow(releasing(run), "kind string, ballot string, n long, mark long, features array<int>")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The classifier trained on all of ``df``'s votes and a bounded sample of its candidates."""
    rows = checkpointed(vote_rows(df, id_col, text_col))
    table = [(r.kind, _ballot(r.ballot), r.n) for r in rows.groupBy("kind", "ballot").agg(F.sum("n").alias("n")).collect()]
    # a kind and ballot may have most of the candidates: its tasks' samples are thinned in salted groups first
    order = [F.col("mark"), F.col("features")]
    salted = Window.partitionBy("kind", "ballot", F.pmod(F.xxhash64("mark"), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("kind", "ballot").orderBy(*order)
    some = rows.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= SAMPLE).withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= SAMPLE)
    return train(table, [(r.kind, _ballot(r.ballot), list(r.features)) for r in some.select("kind", "ballot", "features").collect()])


def _ballot(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_personal_data(df: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all reported spans, and the number of added ones."""
    w = fit(df, id_col, text_col) if weights is None else weights
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def make():
        def each(doc_id, text):
            base = base_spans(text) if text else []
            added = [s for s in loose_spans(text, base) if chance(w, features(text, *s)) > cut] if text else []
            both = sorted(base + added, key=lambda s: (s[0], ORDER[s[2]], s[1]))
            counts = [sum(s[2] == k for s in base) for k in BASE]
            return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(added)

        return each

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_documents(id_and_text(df, id_col, text_col), schema, make, arrow)
