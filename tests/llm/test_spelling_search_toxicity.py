"""Spelling variants, ranked search and toxicity against brute force, held-out rows and awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from awardgrid.llm import queries, search, spelling, toxicity

DOCS = "doc_id long, text string"
CLASH = "__id string, word string, n string, run string, term string, row string, score string, segment string, best string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clashing(spark, rows):
    extra = tuple("x" for _ in CLASH.split(","))
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {CLASH}").repartition(3)


# ---- spelling variants --------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(rows, min_length=7, min_count=2, ratio=10, slips=False):
    number = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            if slips and doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            number[run] += 1
    n = {w: c for w, c in number.items() if len(w) >= min_length and c >= min_count}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


@pytest.fixture(scope="module")
def spelled():
    """Families of words around a few stems, all halves shared by many; chains of forms; letters beyond ASCII."""
    r = random.Random(11)
    letters = "abcéÀ÷x"
    words = []
    for stem in ("andersen", "abcabcabcabc", "éàüöéàü", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 300):
        family = {stem}
        for _ in range(60):
            w = list(r.choice(sorted(family)))
            k = r.randrange(len(w) + 1)
            w[k : k + r.choice((0, 1))] = r.choice(("", *letters))
            family.add("".join(w))
        words += [w for w in sorted(family) for _ in range(r.choice((1, 2, 3, 40)))]
    words += ["chained"] * 4 + ["chainedx"] * 70 + ["chainedxy"] * 1400
    r.shuffle(words)
    rows = [(i, r.choice((" ", ", ", "\n", "×3 ", "日")).join(words[k : k + 23])) for i, k in enumerate(range(0, len(words), 23))]
    return rows + [(900, None), (901, ""), (902, "short words 123"), (903, "UPPER" * 3 + " " + "UPPER" * 3), (None, "Nullwords nullwords nullwordz nullwordz"), rows[0], rows[0]]


def variants(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small,most", [(48, 10_000), (3, 10_000), (3, 12)])
def test_variants(spark, spelled, small, most, monkeypatch):
    """With tiny blocks nearly all are subdivided, in tasks and before them (where workers are forked later)."""
    monkeypatch.setattr(spelling, "SMALL", small)
    got = variants(spelling.group_variants(spark, clashing(spark, spelled), most=most))
    assert got == sorted(brute_variants(spelled), key=repr)
    assert sum(g[4] for g in got) > 500 and any(g[1] and g[1] != g[2] for g in got)


@pytest.mark.parametrize("small", [2, 5, 48])
def test_each_pair_counts_once(small, monkeypatch):
    monkeypatch.setattr(spelling, "SMALL", small)
    r = random.Random(5)
    for size in (7, 8, 11):
        words = sorted({"".join(r.choices("ab", k=size + r.randint(0, 1))) for _ in range(120)})
        found = Counter()
        for head, tail in ((size // 2, 0), (0, size - size // 2)):
            block = np.unique([w[:head] + w[len(w) - tail :] for w in words], return_inverse=True)[1]
            run = spelling._Run([w.encode() for w in words], np.ones(len(words), np.int64), block, size, head, tail)
            for a, b in run.found:
                found.update(zip(a.tolist(), b.tolist(), strict=True))
        pairs = {frozenset((words[a], words[b])) for a, b in found}
        assert len(pairs) == len(found) and set(found.values()) == {1}
        assert pairs == {frozenset((v, w)) for v in words for w in words if v < w and one_edit(v, w) and min(len(v), len(w)) == size}


def test_variants_with_slips(spark, spelled):
    got = variants(spelling.group_variants(spark, spark.createDataFrame(spelled, DOCS), edit=queries.slip))
    assert got == sorted(brute_variants(spelled, slips=True), key=repr)


def test_variants_of_nothing(spark):
    assert variants(spelling.group_variants(spark, spark.createDataFrame([], DOCS))) == []
    with pytest.raises(ValueError):
        spelling.group_variants(spark, spark.createDataFrame([], DOCS), ratio=1)


# ---- ranked search ------------------------------------------------------------------------------

def brute_search(rows, items, k):
    docs = [(i, Counter(TERM.findall(t.translate(LOW)))) for i, t in rows if t]
    docs = [(i, c) for i, c in docs if c]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOW)))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, p, None if none else i, -s) for p, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "x_y", "a-b", "MiXed"]
    rows = [(i * 7 % 501, " ".join(r.choices(words, [1 / (j + 1) for j in range(65)], k=r.randint(1, 60)))) for i in range(400)]
    rows += [(1000 + i, "copy w1 w2 été") for i in range(40)]  # ties: least ids first
    rows += [(None, "w1 w1 w1 null"), (None, "copy w1 w2 été"), (77, None), (78, ""), (79, "... !"), rows[0], rows[0], (2000, "w3 " * 5000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(45)]
    items += [(90, "copy"), (91, "w1 W1 w1"), (92, None), (93, "absent"), (94, ""), (None, "w5"), (90, "w2 w2")]
    return rows, items


def ranked(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{"k": 20}, {"k": 3, "segment": 50}, {"k": 500, "segment": 100}, {"k": 20, "segment": 90, "terms_of_index": 150, "terms_of_pass": 40}])
def test_search(spark, texts, options):
    """Exact for whatever sizes of segments, passes and results."""
    rows, items = texts
    got = ranked(search.rank_documents(spark, clashing(spark, rows), spark.createDataFrame(items, "item_id long, text string"), **options))
    assert got == brute_search(rows, items, options["k"])


def test_search_of_nothing(spark, texts):
    none, bench = spark.createDataFrame([], DOCS), "item_id long, text string"
    assert ranked(search.rank_documents(spark, none, spark.createDataFrame(texts[1], bench))) == []
    assert ranked(search.rank_documents(spark, spark.createDataFrame(texts[0], DOCS), spark.createDataFrame([], bench))) == []
    assert ranked(search.rank_documents(spark, spark.createDataFrame([(1, None)], DOCS), spark.createDataFrame([(1, "w1")], bench))) == []


def test_carries_and_descent():
    r = np.random.default_rng(4)
    numbers = r.integers(0, 1 << 20, (6, 3, 200))
    numbers[:, 0, 50:] = numbers[:, 0, 50:51]  # many equal sums
    numbers[:, 1] = 0
    total = np.zeros((24, 3, 4), np.uint64)
    for own in numbers:
        more = np.zeros((20, 3, 4), np.uint64)
        for i in range(3):
            at, packed = search._packed(np.arange(200), own[i], 20)
            more[:, i, at] = packed
        search.add(total, more)
    sums = numbers.sum(0)
    got = sum(np.unpackbits(total[b].view(np.uint8), axis=1, bitorder="little")[:, :200].astype(np.int64) << b for b in range(24))
    assert (got == sums).all()
    for k in (1, 7, 60, 300):
        sure, equal = search.highest(total, k)
        for i in range(3):
            some = sorted(sums[i][sums[i] > 0].tolist(), reverse=True)
            taken = search._places(sure[i])
            assert sorted(sums[i][taken].tolist(), reverse=True) == some[: len(taken)] and len(taken) <= k
            if len(taken) < min(k, len(some)):
                rest = search._places(equal[i])
                assert set(sums[i][rest].tolist()) == {some[len(taken)]} and len(taken) + len(rest) >= min(k, len(some))


# ---- toxicity -----------------------------------------------------------------------------------

def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def insults():
    r = random.Random(13)
    plain, bad = ["".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(300)], ["zwokkel", "zwokkig", "quirzon", "ÿxßqz"]
    rows, labels = [], []
    for i in range(1500):
        words = r.choices(plain, k=r.choice((20, 60, 300)))
        toxic = i % 6 == 0
        if toxic:
            words = [w if r.random() > 0.08 else r.choice(bad) for w in words] + [r.choice(bad)]
            r.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, insults):
    rows, labels = insults
    odd = [(9000, None), (9001, ""), (9002, "123 !!"), (None, "zwokkel " * 9), (9003, "quirzon " * 100_000), rows[0], rows[0]]
    known = spark.createDataFrame([*labels, (None, 1), (4, 0), (12, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(spark, clashing(spark, rows + odd), known).collect()
    assert len(out) == len(rows) + len(odd) and sum(r.doc_id == 0 for r in out) == 3
    by = {r.doc_id: r for r in out}
    assert all(by[i].held_out == held(i) for i, _ in rows) and not by[None].held_out
    own = [i for i, _ in rows if held(i)]
    assert np.mean([by[i].predicted == (i % 6 == 0) for i in own]) > 0.97
    assert by[9003].predicted == by[None].predicted == 1 and by[9000].predicted == 0 and by[9000].score == by[9001].score == by[9002].score
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)


def test_toxicity_without_negatives(spark, insults):
    """Only confirmed positives and unlabelled text, with the prior given: clean documents are left alone."""
    rows, labels = insults
    only = spark.createDataFrame([x for x in labels if x[1]], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity.score_toxicity(spark, spark.createDataFrame(rows, DOCS), only, prior=1 / 6).collect()}
    own = [i for i, _ in rows if held(i)]
    assert np.mean([by[i].predicted == (i % 6 == 0) for i in own]) > 0.95


def test_toxicity_ignores_held_out_labels(spark, insults):
    rows, labels = insults
    docs = spark.createDataFrame(rows, DOCS)
    scores = [[r.score for r in toxicity.score_toxicity(spark, docs, spark.createDataFrame([(i, 1 - y if flip and held(i) else y) for i, y in labels], "doc_id long, toxic int")).orderBy("doc_id").collect()] for flip in (False, True)]
    assert scores[0] == scores[1]


def test_toxicity_of_nothing(spark, insults):
    docs, none = spark.createDataFrame(insults[0][:20], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(spark, docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(spark, docs.limit(0), spark.createDataFrame(insults[1], none.schema)).collect() == []


def test_risk_is_not_negative():
    """Labels of a few positives cannot be learned by heart: with noise alone no text is called toxic."""
    r = np.random.default_rng(2)
    noise = lambda n: toxicity._Rows([(np.sort(r.choice(300, 12, False)), np.ones(12)) for _ in range(n)])
    w, b = toxicity.fit_pu(noise(60), noise(600), 300, prior=0.1)
    doc, feature, value = (fresh := noise(500)).take(np.arange(len(fresh)))
    assert np.mean(np.bincount(doc, w[feature] * value, 500) + b >= 0) < 0.15


def test_samples_of_toxicity_are_bounded(spark, insults):
    rows, labels = insults
    model = toxicity.learn_toxicity(spark, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), positives=60, unlabelled=200, features=40)
    assert 0 < len(model.weights) <= 40
    gone = spark.createDataFrame(rows, DOCS).where(F.col("doc_id") < 0)
    assert toxicity.learn_toxicity(spark, gone, spark.createDataFrame(labels, "doc_id long, toxic int")).window > 0
