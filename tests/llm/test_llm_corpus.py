"""Operators that compare documents with each other."""

import random

import numpy as np
import pytest
import zstandard
from llm_cases import (
    NO_ID, ascii_words, awkward, awkward_rows, distance, edited, plain_groups, plain_lines, plain_repeats, prose, sha,
)
from pyspark.sql import functions as F

from sheaf import session
from sheaf.llm import components, hashing, jaccard, lines, rounds, substrings, suffixes, toxicity
from sheaf.llm.common import stored
from sheaf.llm.queries import QUERIES


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def families(seed, groups=12, most=9):
    """Rows with copies, near copies, shared passages and repeated lines, in no order."""
    own, rows = random.Random(seed), []
    passages = [prose(1000 + seed * 10 + k, 25) for k in range(3)]
    for g in range(groups):
        base = "\n".join(prose(seed * 100 + g * 10 + k, own.randrange(5, 40)) for k in range(own.randrange(1, 5)))
        for _ in range(own.randrange(1, most)):
            text = edited(base, own.randrange(10**6), own.randrange(0, 4))
            if own.random() < 0.3:
                text += "\n" + own.choice(passages)
            rows.append(text)
    own.shuffle(rows)
    return list(enumerate(rows))


# hashing


def test_span_hashes_depend_on_content_only():
    data = b"abcabcabc" + bytes(range(256)) + b"abc"
    sums = hashing.prefix(np.frombuffer(data, np.uint8))
    starts = np.array([0, 3, 6, len(data) - 3, 1])
    out = hashing.span_hashes(sums, starts, starts + 3)
    assert len(set(out[:4].tolist())) == 1 and out[4] != out[0]
    windows = hashing.window_hashes(sums, 3)
    assert windows[0] == out[0] and len(windows) == len(data) - 2
    own = random.Random(1)
    texts = ["".join(own.choice("ab") for _ in range(12)).encode() for _ in range(3000)]
    packed = hashing.pack_words([[t] for t in texts])
    hashes = hashing.span_hashes(hashing.prefix(packed.buffer), packed.starts, packed.ends)
    assert len(set(hashes.tolist())) == len(set(texts))


def test_words_are_packed():
    packed = hashing.pack_words([[b"a", b"bc"], [], [b"d"], []])
    assert [packed.data[s:e] for s, e in zip(packed.starts, packed.ends)] == [b"a", b"bc", b"d"]
    assert packed.counts().tolist() == [2, 0, 1, 0] and packed.windows(2).tolist() == [0]
    assert hashing.pack_words([]).counts().tolist() == []
    assert hashing.runs(np.array([True, False, True, True]))[0].tolist() == [0, 2]


# components


@pytest.mark.parametrize("kept", [1_000_000, 5])
def test_components(spark, monkeypatch, kept):
    monkeypatch.setattr(components, "KEPT_NODES", kept)
    own = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(k, 500) for k in range(501, 600)]
    loose = [(own.randrange(1000, 1300), own.randrange(1000, 1300)) for _ in range(200)]
    edges = chain + star + loose + [(7, 7), (None, 3), (3, None), (160, 100)]
    own.shuffle(edges)
    forest = components.Forest()
    for a, b in edges:
        if a is not None and b is not None:
            forest.join(a, b)
    table = spark.createDataFrame(edges, "x long, y long").repartition(5)
    got = {r["node"]: r["component"] for r in components.components(table).collect()}
    assert got == {n: forest.root(n) for n in {x for e in edges if None not in e and e[0] != e[1] for x in e}}
    assert components.components(table.limit(0)).count() == 0


def test_stored_leaves_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    assert stored(spark.range(10).groupBy("id").count(), "t").count() == 10
    assert spark.conf.get(key, "false") == before


# 3


def named(docs, **options):
    return ordered(jaccard.named_components(docs, **options).select("doc_id", "n_shingles", "component_id").collect())


def test_groups_of_awkward_rows(spark):
    rows = awkward_rows()
    found, roots = plain_groups(rows)
    want = ordered((doc, n, least if n else doc) for (doc, _), (n, least) in zip(rows, found))
    docs = awkward(spark, rows)
    assert named(docs) == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    stay = {}
    for k, (doc, text) in enumerate(rows):
        own = (NO_ID if doc is None else doc, text or "")
        if not found[k][0]:
            stay[k] = own
        elif roots[k] not in stay or own[0] < stay[roots[k]][0]:
            stay[roots[k]] = own
    got = [(NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in stay.values())
    assert named(docs.limit(0)) == [] and jaccard.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed,block,buckets", [(1, jaccard.BLOCK, jaccard.BUCKET_SHINGLES), (2, 3, 200), (3, 2, 50)])
def test_groups_in_small_blocks_and_buckets(spark, seed, block, buckets):
    rows = families(seed)
    found, _ = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = named(docs, block=block, bucket_shingles=buckets)
    assert got == ordered((doc, n, least if n else doc) for (doc, _), (n, least) in zip(rows, found))


@pytest.mark.parametrize("percent", [80, 50, 95])
def test_trees_join_what_brute_force_joins(percent, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "FAN", 2)
    own = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        base = own.choice(5000, own.integers(1, 60), replace=False)
        for _ in range(own.integers(1, 5)):
            keep = base[own.random(len(base)) > own.choice([0.0, 0.05, 0.2])]
            more = own.integers(0, 5000, own.integers(0, 5))
            sets.append(np.unique(np.concatenate((keep, more, base[:1]))).astype(np.uint64))
    want, got, halves = components.Forest(), components.Forest(), components.Forest()
    for x in range(len(sets)):
        for y in range(x):
            if jaccard.linked(sets[x], sets[y], percent):
                want.join(x, y)
    tree = jaccard.Tree(list(range(len(sets))), sets, bits=256)
    jaccard.join_trees(tree, tree, got, percent)
    cut = len(sets) // 3  # two trees of different height
    a = jaccard.Tree(list(range(cut)), sets[:cut], bits=256)
    b = jaccard.Tree(list(range(cut, len(sets))), sets[cut:], bits=256)
    for x, y in ((a, a), (b, b), (a, b)):
        jaccard.join_trees(x, y, halves, percent)
    for forest in (got, halves):
        assert [forest.root(k) for k in range(len(sets))] == [want.root(k) for k in range(len(sets))]


# 5


def toxic_rows(spark, n=400):
    own = random.Random(5)
    bad = ["vile", "rotten", "awful"]
    rows, truth = [], []
    for k in range(n):
        words = prose(k, own.randrange(20, 80)).split()
        toxic = k % 5 == 0
        if toxic:
            for w in own.sample(bad, 2):
                words.insert(own.randrange(len(words)), w)
        rows.append((k, " ".join(words)))
        truth.append((k, int(k % 7 != 0), int(toxic)))
    return rows, truth


def test_chain_learns_the_words(spark):
    rows, truth = toxic_rows(spark)
    docs = awkward(spark, rows + [(None, "vile rotten"), (1000, None), (1001, ""), (1002, "a " * 50_000 + "vile, rotten"), (1003, "Vile!")])
    known = [t for t in truth if t[0] < 300] + [(None, 1, 1), (5000, 1, 1), (7, None, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, labels)
    assert set(chain[-1].words) <= {"vile", "rotten", "awful"} and len(chain[-1].earlier) == 1
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, chain).collect()}
    held = [(got[k], bool(t)) for k, _, t in truth if k >= 300]
    assert sum(a == b for a, b in held) >= 0.99 * len(held)
    assert got[None] and got[1002] and not got[1000] and not got[1001]
    clean = toxicity.drop_toxic(docs, chain)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not t for t in got.values())
    assert toxicity.toxicity(docs.limit(0), chain).count() == 0 and toxicity.drop_toxic(docs.limit(0), chain).count() == 0


def test_models_converge(spark):
    from pyspark.ml.linalg import Vectors

    own = random.Random(3)
    rows = []
    for _ in range(400):
        x = [float(own.random() < 0.5 / (1 + k % 9)) for k in range(60)]
        rows.append((Vectors.dense(x), int(sum(v * (k % 5 - 2) for k, v in enumerate(x)) + own.gauss(0, 1) > 0)))
    model = toxicity.fit(spark.createDataFrame(rows, ["x", "y"]), "y", "x")
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])
    w = model.coefficients.toArray()
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + model.intercept))) - y) / len(y) + 1e-3 * w * x.var(axis=0, ddof=1)
    assert model.summary.totalIterations < model.getMaxIter() and np.abs(slope).max() < 2e-4


def newton(x, y, penalty=1e-3):
    """Weights and intercept of a logistic regression whose penalty is on weights times deviations."""
    deviation = x.std(axis=0, ddof=1)
    z = np.column_stack((x[:, deviation > 0] / deviation[deviation > 0], np.ones(len(x))))
    ridge, w = np.full(z.shape[1], penalty), np.zeros(z.shape[1])
    ridge[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        bend = z.T @ (z * (p * (1 - p))[:, None]) / len(y) + np.diag(ridge)
        w = w - np.linalg.solve(bend, z.T @ (p - y) / len(y) + ridge * w)
    out = np.zeros(x.shape[1])
    out[deviation > 0] = w[:-1] / deviation[deviation > 0]
    return out, w[-1]


def test_chain_by_hand(spark):
    """The chain again in numpy: the second model sees what models of other folds say of a row."""
    own = random.Random(9)
    rows, truth = [], []
    for k in range(600):
        junk, toxic = own.random() < 0.4, own.random() < 0.3
        words = own.choices("calm river stone light".split(), k=6)
        words += [w for w, odds in (("spam", 0.7), ("offer", 0.5)) if own.random() < (odds if junk else 0.15)]
        words += [w for w, odds in (("vile", 0.6), ("rotten", 0.5), ("offer", 0.4)) if own.random() < (odds if toxic else 0.1)]
        rows.append((k, " ".join([*words, f"x{k}"])))
        truth.append((k, int(not junk), int(toxic), 7, 8, 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int, junk int, fold int, same int")
    names = ["junk", "toxic"]
    sample = toxicity.labelled_sample(docs, labels, toxicity.CATEGORIES, "doc_id", "text", 1000)
    vocabulary = toxicity.telling_words(sample, names, toxicity.WORDS_EACH)
    assert {"spam", "vile"} <= set(vocabulary)
    taught = sample.collect()
    assert len(taught) == len(rows)

    def bags(texts):
        return np.array([[float(w in toxicity.words_of(t)) for w in vocabulary] for t in texts])

    x, folds = bags([r["text"] for r in taught]), np.array([r["fold"] for r in taught])
    junk, toxic = (np.array([r[n] for r in taught]) for n in names)
    apart = np.zeros(len(x))
    for fold in set(folds.tolist()):
        w, b = newton(x[folds != fold], junk[folds != fold])
        apart[folds == fold] = 1 / (1 + np.exp(-(x[folds == fold] @ w + b)))
    w1, b1 = newton(x, junk)
    w2, b2 = newton(np.column_stack((x, apart)), toxic)
    z = bags([t for _, t in rows])
    first = 1 / (1 + np.exp(-(z @ w1 + b1)))
    last = 1 / (1 + np.exp(-(np.column_stack((z, first)) @ w2 + b2)))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, toxicity.train_chain(docs, labels)).collect()}
    assert max(abs(got[k]["p_junk"] - first[k]) for k, _ in rows) < 2e-3
    assert max(abs(got[k]["p_toxic"] - last[k]) for k, _ in rows) < 2e-3


def test_labels_in_part(spark):
    rows, truth = toxic_rows(spark)
    docs = awkward(spark, rows)
    # each row has one of the labels; most labelled ids have no document
    known = [(k, q, None) if k % 2 else (k, None, t) for k, q, t in truth] + [(k, 1, 0) for k in range(10_000, 20_000)]
    labels = spark.createDataFrame([*known, (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, toxicity.CATEGORIES, "doc_id", "text", 300)
    got = sample.agg(F.count("*"), F.count("junk"), F.count("toxic")).first()
    assert got[0] == min(300, len(rows)) and got[1] + got[2] == got[0] and got[1] and got[2]
    chain = toxicity.train_chain(docs, labels)
    assert {"vile", "rotten", "awful"} >= set(chain[-1].words) != set()
    found = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, chain).collect()}
    assert sum(found[k] == bool(t) for k, _, t in truth) >= 0.99 * len(truth)


def test_chain_without_enough_labels(spark):
    rows, truth = toxic_rows(spark, 20)
    docs = awkward(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(k, 1, 1) for k, _ in rows], "doc_id long, quality int, toxic int")
    torn = spark.createDataFrame([(k, 1, t) for k, _ in rows for t in (0, 1)], "doc_id long, quality int, toxic int")
    for labels, share in ((none, 0), (same, 20), (torn, 0)):
        chain = toxicity.train_chain(docs, labels)
        assert toxicity.toxicity(docs, chain).where("toxic").count() == share
    assert toxicity.train_chain(docs.limit(0), same)[-1].words == {}


# 6


def test_distance_is_within():
    own = random.Random(6)
    for _ in range(4000):
        a = [own.choice("abc") for _ in range(own.choice([0, 1, 2, 3, 8, 20, 70, 90]))]
        b = list(a)
        for _ in range(own.randrange(6)):
            at = own.randrange(len(b) + 1)
            b[at : at + own.randrange(2)] = [own.choice("abc")] * own.randrange(2)
        a, b = "".join(a), "".join(b)
        for limit in range(5):
            assert lines.within(a, b, limit) == (distance(a, b) <= limit), (a, b, limit)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_lines_within_reach_share_an_entry(edits):
    own = random.Random(edits)
    for _ in range(1500):
        a = [own.choice("ab") for _ in range(own.randrange(8, 30))]
        b = list(a)
        for _ in range(edits):
            at = own.randrange(len(b) + 1)
            b[at : at + own.randrange(2)] = [own.choice("ab")] * own.randrange(2)
        a, b = "".join(a), "".join(b)
        if min(len(a), len(b)) < 8 or distance(a, b) > edits:
            continue
        line, key, filed, _ = lines.line_entries([a, b], edits, 8)
        shorter = 0 if len(a) <= len(b) else 1
        assert set(key[(line == shorter) & filed].tolist()) & set(key[line != shorter].tolist()), (a, b)


def changed_line(own, line, edits, letters):
    line = list(line)
    for _ in range(edits):
        at = own.randrange(len(line) + 1)
        line[at : at + own.randrange(2)] = [own.choice(letters)] * own.randrange(2)
    return "".join(line)


def test_distances_side_by_side():
    own = random.Random(16)
    for limit in range(5):
        pairs = []
        for _ in range(1500):
            a = "".join(own.choice("abc") for _ in range(own.choice([0, 1, 2, 3, 8, 20, 70, 90])))
            pairs.append((a, changed_line(own, a, own.randrange(6), "abc")))
        texts = lines.Texts([t for pair in pairs for t in pair])
        got = texts.within(np.arange(0, 2 * len(pairs), 2), np.arange(1, 2 * len(pairs), 2), limit)
        assert got.tolist() == [distance(a, b) <= limit for a, b in pairs]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_parted_entries_still_meet(edits):
    """However often its entries are parted, a pair within reach keeps one that they share, filed by the shorter."""
    own = random.Random(edits)
    for _ in range((0, 150, 60, 12)[edits]):
        a = "".join(own.choice("ab") for _ in range(own.randrange(2 * edits + 1, 30)))
        b = changed_line(own, a, edits, "ab")
        if min(len(a), len(b)) <= 2 * edits or a == b or distance(a, b) > edits:
            continue
        texts = lines.Texts([a, b])
        entries, shorter = lines.line_entries(texts, edits, 2 * edits + 1, gaps=True), int(len(a) > len(b))
        ended = set()
        while len(entries.line):
            def keys(of, filed):
                return set(of.key[(of.line == shorter) & of.filed if filed else of.line != shorter].tolist())  # noqa: B023

            assert ended or keys(entries, True) & keys(entries, False), (a, b)
            entries, last = (lambda old: (lines.parted(texts, old)[0], old.at(np.flatnonzero(lines.parted(texts, old)[1]))))(entries)
            ended |= keys(last, True) & keys(last, False)
        assert ended, (a, b)


def template_lines(n):
    own = random.Random(n)
    return [f"Posted in category {own.randrange(10**9):09d} by user {own.randrange(10**9):09d} on a day" for _ in range(n)]


def test_lines_of_one_template_are_told_apart_by_their_entries(spark):
    """Lines that share most of their letters make fewer pairs than there are lines, not its square."""
    for n in (1000, 4000):
        own = sorted(set(template_lines(n)))
        entries = lines.line_entries(own, 2, 24)
        met = [entries.key[entries.line == k].view(np.int64).tolist() for k in range(len(own))]
        nodes = spark.createDataFrame([(k, t, m) for k, (t, m) in enumerate(zip(own, met))], "node long, text string, met array<bigint>")
        assert lines.pair_rows(nodes, 2, 24, 2_000, 50)[1] < n
        assert lines.line_links(nodes, 2, 24, 2_000, 50).count() == 0


def cut_rows(docs, **options):
    return ordered(lines.cut_lines(docs, **options).select("doc_id", "n_lines", "n_removed", "kept").collect())


def test_lines_of_awkward_rows(spark):
    rows = awkward_rows()
    docs, want = awkward(spark, rows), plain_lines(rows)
    got = cut_rows(docs)
    # which of the rows that share an id, or have none, comes first is not said; what they lose together is
    same = {doc for doc, _ in rows if sum(d == doc for d, _ in rows) > 1}
    assert [r for r in got if r[0] not in same] == ordered(w for w in want if w[0] not in same)
    assert sum(r[2] for r in got) == sum(w[2] for w in want)
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert kept.where("text is null").count() == sum(t is None for _, t in rows)
    assert ordered((r["doc_id"], r["text"] or "") for r in kept.collect()) == ordered((r[0], r[3]) for r in got)
    assert cut_rows(docs.limit(0)) == [] and lines.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed,pairs,entries,edits,least", [
    (1, lines.ENTRY_PAIRS, 1_000_000, 2, 24), (2, 4, 30, 2, 24), (3, 30, 100, 1, 24), (4, 2, 50, 0, 24), (5, 1, 500, 2, 5),
])
def test_lines_in_small_blocks_and_buckets(spark, seed, pairs, entries, edits, least):
    own, rows = random.Random(seed), []
    bases = [prose(seed * 50 + k, own.randrange(1 if least < 24 else 3, 9), 30) for k in range(12)]
    for doc in range(70):
        text = []
        for _ in range(own.randrange(1, 5)):
            line = list(own.choice(bases))
            for _ in range(own.randrange(4)):
                at = own.randrange(len(line))
                line[at : at + own.randrange(2)] = [own.choice("wx1")] * own.randrange(2)
            text.append("".join(line))
        rows.append((doc, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = cut_rows(docs, edits=edits, least=least, entry_pairs=pairs, block=3, bucket_entries=entries)
    assert got == ordered(plain_lines(rows, edits, least))


# 9 and 10


@pytest.mark.parametrize("length", [5, 13, 50])
def test_covers(length):
    modulus, cover = suffixes.cover_for(length)
    assert length - modulus + 1 > length // 2
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


def byte_digest(rows, length):
    out = []
    for (doc, text), gone in zip(rows, plain_repeats(rows, lambda t: (t or "").encode(), length)):
        data = (text or "").encode()
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g))))
    return ordered(out)


def suffix_rows(docs, **options):
    out = suffixes.suffix_dedup(docs, **options)
    return ordered(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def test_suffixes_of_awkward_rows(spark):
    rows = awkward_rows()
    docs = awkward(spark, rows)
    assert suffix_rows(docs) == byte_digest(rows, 50)
    assert suffix_rows(docs.limit(0)) == []


@pytest.mark.parametrize("seed,length,names", [(1, 50, 2_000), (2, 50, 500), (3, 12, 300), (4, 29, 10**6)])
def test_suffixes_in_small_buckets(spark, seed, length, names):
    rows = families(seed, groups=6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert suffix_rows(docs, length=length, bucket_names=names) == byte_digest(rows, length)


def word_digest(rows, window):
    out = []
    for (doc, text), gone in zip(rows, plain_repeats(rows, ascii_words, window)):
        words = ascii_words(text)
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return ordered(out)


def window_rows(docs, **options):
    return ordered(substrings.substring_dedup(docs, **options).select("doc_id", "n_words", "n_removed", "kept").collect())


def test_windows_of_awkward_rows(spark):
    rows = awkward_rows()
    docs = awkward(spark, rows)
    assert window_rows(docs) == word_digest(rows, 13)
    assert window_rows(docs.limit(0)) == []


@pytest.mark.parametrize("seed,window,minimiser,bucket", [(1, 13, 3, 2_000), (2, 13, 1, 500), (3, 5, 2, 10**9), (4, 3, 3, 300)])
def test_windows_in_small_buckets(spark, seed, window, minimiser, bucket):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert window_rows(docs, window=window, minimiser=minimiser, bucket_bytes=bucket) == word_digest(rows, window)


def test_large_buckets_are_sorted_in_slices(monkeypatch):
    rows = families(5, groups=8)
    sent = []
    for half in (rows[:20], rows[20:]):
        texts = [t.encode() for _, t in half]
        row = {"doc_ids": [k for k, _ in half], "lengths": [len(t) for t in texts], "texts": zstandard.compress(b"".join(texts))}
        sent += substrings.Windows(row, 13, 3, 1).send_strings()
    columns, counts = [s[1] for s in sent], [s[2] for s in sent]
    whole = substrings.meet_strings(columns, counts, 13)
    assert any(any(bits) for bits in whole)
    monkeypatch.setattr(substrings, "SORTED_WINDOWS", 50)
    assert substrings.meet_strings(columns, counts, 13) == whole


def test_strings_are_merged_in_slices(monkeypatch):
    own = random.Random(7)
    strings = ["".join(own.choice("ab") for _ in range(own.randrange(8, 13))) for _ in range(300)]
    rows = [
        [zstandard.compress("".join(part).encode()), suffixes.squeeze(np.array([len(s) for s in part], "u1")), suffixes.squeeze(np.array(ids, "<i8"))]
        for part, ids in ((strings[:150], range(150)), (strings[150:], range(100, 250)))
    ]
    whole = suffixes.meet_strings(rows, [150, 150], 8)
    monkeypatch.setattr(suffixes, "MERGED_STRINGS", 20)
    assert suffixes.meet_strings(rows, [150, 150], 8) == whole


def in_rounds(piece, length):
    """The masks of the one piece that there is, by rounds without Spark; the texts are hashed in the first two only."""
    def round_(send, meet, *replies):
        note, cells = None, []
        for bucket, data, n in getattr(piece(), send)(*replies):
            if bucket == rounds.OWN:
                note = data[0]
            else:
                cells.append({"bucket": bucket, "n": n, "reply": meet([data], [n])[0]})
        return note, cells

    alive = rounds.read_replies(round_("send_names", suffixes.meet_names)[1], "bits")
    note, cells = round_("send_refined", suffixes.meet_refined, alive)
    told = rounds.read_replies([*cells, {"bucket": -7, "n": 0, "reply": note}], "note and u1")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "prefix", None)
        strings = list(piece().send_strings(told))
    late = [{"bucket": b, "n": n, "reply": suffixes.meet_strings([data], [n], length)[0]} for b, data, n in strings]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "prefix", None)
        return piece().removed(told, rounds.read_replies(late, "<u4"))


def test_later_rounds_of_suffixes_hash_nothing():
    texts = [(i, t.encode()) for i, t in sorted(families(5, groups=4), key=str)]
    row = {"doc_ids": [i for i, _ in texts], "lengths": [len(t) for _, t in texts], "texts": zstandard.compress(b"".join(t for _, t in texts))}

    def piece():
        return suffixes.Piece(row, 12, 3)

    whole, gone = piece(), in_rounds(piece, 12)
    rows = [(i, t.decode()) for i, t in texts]
    for k, want in zip(range(len(rows)), plain_repeats(rows, lambda t: t.encode(), 12)):
        number = whole.row_text[k]
        if whole.row_id[k] == whole.owner[number]:
            assert list(gone[whole.starts[number] : whole.stops[number]]) == list(want)


def test_rows_of_a_suffix_piece_grow_slower_than_the_text():
    buckets = [suffixes.bucket_count(n * 10**8, suffixes.BUCKET_NAMES) for n in (0, 1, 10, 14)]
    assert buckets == [1, 64, 334, 467]  # 14: the names of 6 GB, once 934


def test_pairs_whose_first_bits_are_equal_are_told_apart():
    name = np.array([2, 1, 2, 1, 2, 2], np.uint64)
    for more in ([8, 9, 8, 9, 9, 8], [8 << 60, 9 << 60, 8 << 60, 1, 3, 8 << 60]):
        more = np.array(more, np.uint64)
        for names in (name, name << np.uint64(61)):
            order, new = suffixes.sort_pairs(names, more)
            pairs = [(int(names[k]), int(more[k])) for k in order]
            assert pairs == sorted(pairs) and [k == 0 or pairs[k] != pairs[k - 1] for k in range(6)] == new.tolist()


def test_short_rows_of_strings_are_hashed_together(monkeypatch):
    calls, real = [], suffixes.prefix
    monkeypatch.setattr(suffixes, "prefix", lambda *args: calls.append(1) or real(*args))
    row = [zstandard.compress(b"abcdefghij"), suffixes.squeeze(np.array([10], "u1"))]
    rows = [[*row, suffixes.squeeze(np.array([k], "<i8"))] for k in range(200)]
    found = [int(rounds.unsqueeze(r, "<u4")[0]) for r in suffixes.meet_strings(rows, [1] * 200, 8)]
    assert found == [0] + [0b111] * 199 and len(calls) == 2
    assert suffixes.batches(np.array([3, 5, 12, 13, 20]), 5) == [(0, 2), (2, 3), (3, 5)]


# all queries


def test_queries_that_have_sql(spark):
    import duckdb

    from sheaf.llm.queries import ORACLES

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert ordered(got.select(*columns).collect()) == ordered(want.fetchall()), name


def test_a_hub_is_split(spark, conf):
    """One node with most of the edges: its partition is read by several tasks, when its side is not broadcast."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64k", spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__shuffle__partitions="8",
    )
    edges = spark.range(1, 200_000).selectExpr("0L as a", "id as b").union(spark.range(200_000, 220_000).selectExpr("id as a", "id + 30000 as b"))
    edges = stored(edges.repartition(16), "hub")
    before, session.BROADCAST_ROWS = session.BROADCAST_ROWS, 0
    try:
        out = components.large_star(edges)
        assert out.collect() and "skewed" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        session.BROADCAST_ROWS = before
