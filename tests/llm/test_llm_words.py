"""Token counts, phrases and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from llm_cases import awkward, awkward_rows, distance

from sheaf.llm import counting, phrases, spelling


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def upper_to_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 12


SIGNS = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "ﬁ", "Ａ", "漢", "字", "🙂", "\x00", "</s>", "<s>", "<unk>", "1", "00", ".", "...", "'", "ß", "́"]


def awkward_texts():
    own = random.Random(4)
    out = ["".join(own.choice(SIGNS) for _ in range(own.randrange(60))) for _ in range(1500)]
    out += ["".join(chr(own.choice([own.randrange(1, 0x300), own.randrange(0x370, 0xD800), own.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(500)]
    out += ["a" * n for n in (1, 2, 3, 255, 256, 257, 5000)] + [" " * n for n in (1, 2, 15, 16, 17, 33, 300, 3000)]
    out += ["".join(own.choice("abcdefgh") for _ in range(n)) for n in (300, 30_000)] + ["漢字" * 4000, "abc漢" * 500, "", None, "▁", "a ", " a"]
    return out


def test_token_counts_are_those_of_the_library():
    own = counting.PieceBpe(counting.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=counting.default_path())
    texts = awkward_texts()
    assert own.count(texts) == [len(library.encode(t or "")) for t in texts]
    assert own.count(texts) == [len(library.encode(t or "")) for t in texts], "from the words kept"


def test_ranks_in_step_are_ranks_one_by_one(monkeypatch):
    own = counting.PieceBpe(counting.default_path())
    words = ["▁" + w for w in {w for t in awkward_texts() for w in (t or "").split()} if len(w) < 200]
    together = own.count_words(words)
    assert together == [own.count_one(own.symbols(np.array([ord(c) for c in w])).tolist()) for w in words]
    monkeypatch.setattr(counting, "SYMBOLS", 50)
    assert own.count_words(words) == together


def test_token_counts(spark, monkeypatch):
    rows = awkward_rows()
    library = sentencepiece.SentencePieceProcessor(model_file=counting.default_path())
    want = [(doc, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for doc, t in rows]
    assert ordered(counting.token_counts(awkward(spark), limit=100).collect()) == ordered(want)
    assert counting.token_counts(awkward(spark, [(1, "a")]).limit(0)).count() == 0
    monkeypatch.setattr(counting, "KEPT_WORDS", 3)
    own = counting.PieceBpe(counting.default_path())
    assert [own.count([t])[0] for _, t in rows * 2] == [n for _, _, n, _ in want * 2]


# 11


def plain_collocations(rows, often, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", upper_to_lower(text)):
            own = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(own)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(own[k : k + size])) for k in range(len(own) - size + 1))
    found = {key: n for key, n in counts.items() if n >= often and len(key[1]) > 1}
    out = {}
    for (lang, words), a in found.items():
        size = len(words)
        longer = (
            n for (other, w), n in found.items()
            if other == lang and len(w) > size and any(w[k : k + size] == words for k in range(len(w) - size + 1))
        )
        if any(100 * n >= 80 * a for n in longer):
            continue
        cuts = []
        for k in range(1, size):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, own in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1)
    ]


def phrase_rows():
    own = random.Random(3)
    words = ["the", "The", "a", "of", "new", "york", "times", "square", "é", " x", "b", "c", "zz"]
    rows = []
    for k in range(120):
        parts = [own.choice(words) if own.random() < 0.6 else "new york times" for _ in range(own.randrange(1, 60))]
        text = "".join(p + own.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "?!"]) for p in parts)
        rows.append((own.choice(["en", "en", "fr", None, "und"]), text))
    rows += [("en", None), ("fr", ""), (None, " \n"), ("xx", "one"), ("en", "a b " * 30_000), ("hot", "same words here. " * 500)]
    return rows + rows[:20]


def phrase_docs(spark, rows):
    docs = awkward(spark, [(k, t) for k, (_, t) in enumerate(rows)])
    langs = spark.createDataFrame([(k, lang) for k, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return docs.drop("lang").join(langs, "doc_id").withColumnsRenamed({"words": "phrase", "id": "n"})


@pytest.mark.parametrize("entries", [phrases.BUCKET_ENTRIES, 2_000])
@pytest.mark.parametrize("often, top", [(30, 2000), (2, 25)])
def test_collocations(spark, entries, often, top):
    rows = phrase_rows()
    got = phrases.collocations(phrase_docs(spark, rows), often=often, top=top, bucket_entries=entries)
    assert ordered(got.collect()) == ordered(plain_collocations(rows, often, 4, top))


def test_collocations_of_nothing(spark):
    assert phrases.collocations(phrase_docs(spark, [("en", "a b")]).limit(0)).count() == 0
    assert phrases.collocations(phrase_docs(spark, [("en", None), (None, "")])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_summaries_keep_what_is_frequent(seed):
    own = np.random.Generator(np.random.PCG64(seed))
    often = int(own.integers(2, 40))
    batches = []
    for _ in range(int(own.integers(1, 30))):
        keys, counts = np.unique((own.zipf(1.3, int(own.integers(1, 500))) % 3000).astype(np.uint32), return_counts=True)
        batches.append((keys, counts))
    total = Counter()
    for keys, counts in batches:
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    summary = phrases.summarise(batches, often)
    assert summary.capacity > sum(total.values()) / often - 1e-9 and len(summary.keys) <= summary.capacity
    assert {k for k, n in total.items() if n >= often} <= set(summary.frequent(often).tolist())
    assert all(n <= total[k] <= n + summary.taken for k, n in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_summaries_merge():
    one, two = phrases.Summary(10), phrases.Summary(10)
    one.add(np.arange(8, dtype=np.uint32), np.arange(1, 9))
    two.add(np.arange(4, 12, dtype=np.uint32), np.arange(8, 0, -1))
    one.add(two.keys, two.counts)
    assert len(one.keys) <= 10 and one.taken + two.taken <= 72 // 11


# 13


def plain_variants(rows, every):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = upper_to_lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in counts}
    best = {w: min(own, key=lambda v: (-counts[v], v)) for w, own in near.items() if own}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()]


def variant_rows():
    own = random.Random(5)
    stems = ["colour", "Color", "honour", "straße", "strasse", "ÉCOLE", "école", "ecole", "naïve", "naive", "abcde", "abced", "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = []
    for k in range(150):
        words = []
        for _ in range(own.randrange(1, 40)):
            word = own.choice(stems)
            for _ in range(own.choice([0, 0, 0, 1, 1, 2])):
                at = own.randrange(len(word))
                word = own.choice([word[:at] + word[at + 1 :], word[:at] + own.choice("aeßé") + word[at:], word[:at] + own.choice("oué") + word[at + 1 :]])
            words.append(word)
        rows.append((own.choice([k, k, -k, None]), "".join(w + own.choice([" ", ", ", "-", "\n", "9", "_", "œ"]) for w in words)))
    rows += [(1, None), (2, ""), (3, "x" * 700 + " " + "x" * 699), (None, "x" * 700 + " " + "x" * 699), (4, ("x" * 700 + " " + "x" * 699 + " ") * 2)]
    return rows + rows[:10] + [(5, "chained " * 3 + "chaineds " * 7 + "chainedss " * 15 + "chainedssa " * 31)]


@pytest.mark.parametrize("every", [None, 7])
@pytest.mark.parametrize("leaf", [4_000, 5])
def test_spelling_variants(spark, monkeypatch, every, leaf):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    rows = variant_rows()
    got = spelling.spelling_variants(awkward(spark, rows), every=every).collect()
    want = plain_variants(rows, every)
    assert len(want) > 100 and ordered(got) == ordered(want)
    assert every or {r["root"] for r in got if r["word"].startswith("chained")} == {"chainedssa"}


def test_spelling_variants_of_few_sampled_words(spark, monkeypatch):
    """Words that the first tree has not seen, and lengths it has no leaf for, are still all found."""
    monkeypatch.setattr(spelling, "LEAF_WORDS", 5)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 12)
    monkeypatch.setattr(spelling, "NODE_WORDS", 2)
    monkeypatch.setattr(spelling, "PAIRS", 7)
    monkeypatch.setattr(spelling, "KEPT_WORDS", 10)
    rows = variant_rows()
    assert ordered(spelling.spelling_variants(awkward(spark, rows)).collect()) == ordered(plain_variants(rows, None))


def test_spelling_variants_of_nothing(spark):
    assert spelling.spelling_variants(awkward(spark, [(1, "words words words")]).limit(0)).count() == 0
    assert spelling.spelling_variants(awkward(spark, [(1, None), (2, "one two")])).count() == 0


def test_forms_lead_to_the_root(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(37)]
    got = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r["root"] for r in got} == {"w37"} and len(got) == 37
