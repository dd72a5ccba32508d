"""Spelling variants among the words of a corpus, by k-d trees over letter counts.

A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least ``least``
letters and ``often`` occurrences. Two words are near if one inserted, deleted or replaced letter turns one into
the other. Such an edit changes letter counts by at most two: a replacement takes one letter and adds another,
an insertion adds one. A word's form is its near word of the most occurrences (ties: the smallest in the order of
code points) if that has at least twice as many as the word; its root is where forms lead in the end.

Letter counts are written as bits, one for each letter and count reached ("at least one e", "at least two e";
counts above what there are bits for, and letters that share bits, only make words look closer than they are).
In this form the box around some words is two masks: the bits all have and the bits any has. A first tree for
each length, split at such bits, is fitted on a bounded sample and deals all words to leaves; a word is filed in
its own leaf and sent to those leaves of its own length and of the next one whose boxes one edit can reach. The
task of a leaf builds a k-d tree over the words filed there, goes down it with all visitors at once, and compares
the letters, in order, of what is left. Of two words of one length the one from the leaf of the smaller number
visits the other, so each pair is found once. Pairs stay inside the task: what leaves it is, for each word, how
many near words it met there and the best of them.

Null and empty texts have no words; a null doc_id is written as nothing before the colon. Repeated rows count as
often as they are there. An empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import hand_back, pa_schema, pieces, query, stored, table

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Words that the first tree is fitted on, words to a leaf of it, its leaves at most, and different words that a task
# counts before it hands them on. The tree decides who does the work, not what is found.
SAMPLE_WORDS = 100_000
LEAF_WORDS = 4_000
LEAVES = 2_048
KEPT_WORDS = 200_000
# Words to a node of the inner tree that is not split, and pairs that are compared at a time.
NODE_WORDS = 32
PAIRS = 200_000
# Bits for each letter: of a to z for counts of one, two and three, of all others in shared ones.
LEVELS, SHARED = 3, 25

ONE = np.uint64(1)


# words


def changed(run: bytes, prefix: int, every: int) -> bytes:
    """A run of a document; of every so many one loses a letter. ``prefix``: the checksum up to the run."""
    sum_ = zlib.crc32(run, prefix)
    if sum_ % every:
        return run
    text = run.decode()
    at = sum_ % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, least: int, often: int, every: int | None, doc_id: str, text: str) -> DataFrame:
    """word and n, of words that are long and frequent enough."""
    types = pa_schema(docs.sparkSession, "word string, n long")

    def count(batches):
        counts: Counter[bytes] = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=types)

        for part in pieces(batches):
            for doc, data in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                own = Counter(run for run in RUNS.findall((data or b"").translate(LOWER).decode()) if len(run) >= least)
                prefix = zlib.crc32(f"{doc}:".encode())
                for run, n in own.items():
                    word = run.encode()
                    if every:
                        word = changed(word, prefix, every)
                        if len(run) == least and len(word) < len(run.encode()):
                            continue
                    counts[word] += n
            if len(counts) > KEPT_WORDS:
                yield batch()
                counts = Counter()
        yield batch()
        del counts
        hand_back()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(count, types_ddl(types)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def types_ddl(types: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in types)


# letter counts as bits


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words end to end, where each word starts, and how long it is."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.cumsum(lengths) - lengths, lengths


def count_bits(words: list[str]) -> np.ndarray:
    """The letter counts of each word as 128 bits."""
    points, _, lengths = letters(words)
    slot = np.where((points >= 97) & (points <= 122), points.astype(np.int64) - 97, 26 + points.astype(np.int64) % SHARED)
    counts = np.bincount(np.repeat(np.arange(len(words)), lengths) * (26 + SHARED) + slot, minlength=len(words) * (26 + SHARED))
    counts = counts.reshape(-1, 26 + SHARED)
    planes = [counts[:, :26] > level for level in range(LEVELS)] + [counts[:, 26:] > level for level in range(2)]
    bits = np.zeros((len(words), 128), np.uint8)
    flat = np.concatenate(planes, axis=1)
    bits[:, : flat.shape[1]] = flat
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def ones(x: np.ndarray) -> np.ndarray:
    """How many bits are set, over the last axis."""
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def reach(bits: np.ndarray, all_have: np.ndarray, any_has: np.ndarray, longer: int) -> np.ndarray:
    """Can one edit turn a word of these bits into one of the box, of as many letters or of one more?"""
    added = ones(all_have & ~bits)  # bits that the other word must have
    taken = ones(bits & ~any_has)
    return (added <= 1) & (taken <= (0 if longer else 1))


def best_bit(bits: np.ndarray) -> tuple[int, int] | None:
    """The bit that about half of the words have, as (number of the word, shift); None if all words are alike."""
    flat = np.unpackbits(bits.astype(">u8").view(np.uint8).reshape(len(bits), -1), axis=1).sum(0, dtype=np.int64)
    half = np.minimum(flat, len(bits) - flat)
    at = int(half.argmax())
    return (at // 64, 63 - at % 64) if half[at] else None


def has(bits: np.ndarray, bit: tuple[int, int]) -> np.ndarray:
    return (bits[:, bit[0]] >> np.uint64(bit[1])) & ONE == ONE


# the first tree


class Leaves:
    """The leaves of the first trees: for each length, boxes of bits that are set, or not set, along the splits."""

    def __init__(self, sample: list[str], words: int):
        want = max(1, min(LEAVES, -(-words // LEAF_WORDS)))
        size = max(1, -(-len(sample) // want))
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        number = 0
        for length, own in sorted(by_length.items()):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            stack = [(count_bits(own), np.zeros(2, np.uint64), np.full(2, ~np.uint64(0)))]
            while stack:
                bits, must, may = stack.pop()
                bit = best_bit(bits) if len(bits) > size else None
                if bit is None:
                    found.append((must, may))
                    continue
                side = has(bits, bit)
                mask = np.zeros(2, np.uint64)
                mask[bit[0]] = ONE << np.uint64(bit[1])
                stack += [(bits[side], must | mask, may), (bits[~side], must, may & ~mask)]
            self.boxes[length] = (np.arange(number, number + len(found)), *map(np.array, zip(*found)))
            number += len(found)
        self.count = number

    def of_length(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and boxes of the leaves for words of this length; without a sample of it, one leaf for all."""
        everything = np.array([-1 - length]), np.zeros((1, 2), np.uint64), np.full((1, 2), ~np.uint64(0))
        return self.boxes.get(length, everything)

    def deal(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, length of the words in the leaf, leaf, is it filed there) for all leaves that a word goes to."""
        bits = count_bits(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = []
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            leaf, must, may = self.of_length(length)
            home = np.empty(len(own), np.int64)
            for k in range(len(leaf)):
                inside = (ones(must[k] & ~bits[own]) == 0) & (ones(bits[own] & ~may[k]) == 0)
                home[inside] = leaf[k]
            out.append((own, home, np.ones(len(own), bool)))
            for k in range(len(leaf)):
                go = reach(bits[own], must[k], may[k], 0) & (home < leaf[k])
                out.append((own[go], np.full(go.sum(), leaf[k]), np.zeros(go.sum(), bool)))
            leaf, must, may = self.of_length(length + 1)
            for k in range(len(leaf)):
                go = reach(bits[own], must[k], may[k], 1)
                out.append((own[go], np.full(go.sum(), leaf[k]), np.zeros(go.sum(), bool)))
        return tuple(map(np.concatenate, zip(*out)))


# inside a leaf


def candidate_pairs(filed: np.ndarray, visitors: np.ndarray, longer: int):
    """Arrays of (visitor, filed word) that their letter counts do not keep apart, by a k-d tree over the filed words."""
    stack = [(np.arange(len(filed)), np.arange(len(visitors)))]
    while stack:
        own, guests = stack.pop()
        bits = filed[own]
        inside = reach(visitors[guests], np.bitwise_and.reduce(bits), np.bitwise_or.reduce(bits), longer)
        guests = guests[inside]
        if not len(guests):
            continue
        bit = best_bit(bits) if len(own) > NODE_WORDS else None
        if bit is not None:
            side = has(bits, bit)
            stack += [(own[side], guests), (own[~side], guests)]
            continue
        step = max(1, PAIRS // len(own))
        for at in range(0, len(guests), step):
            part = guests[at : at + step]
            mine, theirs = visitors[part][:, None, :], bits[None, :, :]
            close = (ones(theirs & ~mine) <= 1) & (ones(mine & ~theirs) <= (0 if longer else 1))
            i, j = np.nonzero(close)
            yield part[i], own[j]


def one_edit(points: np.ndarray, starts: np.ndarray, x: np.ndarray, y: np.ndarray, length: int, longer: int) -> np.ndarray:
    """For pairs of words x, y of ``length - longer`` and ``length`` letters: is it one edit, in order?"""
    out = np.zeros(len(x), bool)
    width = length - longer
    step = max(1, 4_000_000 // max(1, length))
    for low in range(0, len(x), step):
        a, b = starts[x[low : low + step], None] + np.arange(width), starts[y[low : low + step], None] + np.arange(width)
        same = points[a] == points[b]
        if not longer:
            out[low : low + step] = (~same).sum(1) == 1
            continue
        moved = points[a] == points[b + 1]
        # what is the same from the left, and from the right one place on, must cover the shorter word
        left = np.where(same.all(1), width, (~same).argmax(1))
        right = np.where(moved.all(1), width, (~moved[:, ::-1]).argmax(1))
        out[low : low + step] = left + right >= width
    return out


class Met:
    """For each word of a task: how many near words it met, and the best one."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = np.argsort(np.array(words, object), kind="stable") if words else np.empty(0, np.int64)
        self.by_name = np.empty(len(words), np.int64)
        self.by_name[order] = np.arange(len(words))
        self.n = n
        self.count = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1, np.int64)

    def add(self, word: np.ndarray, near: np.ndarray) -> None:
        if not len(word):
            return
        self.count += np.bincount(word, minlength=len(self.count))
        known = np.flatnonzero(self.best >= 0)
        word, near = np.concatenate((word, known)), np.concatenate((near, self.best[known]))
        order = np.lexsort((self.by_name[near], -self.n[near], word))
        first = order[np.concatenate(([True], np.diff(word[order]) != 0))]
        self.best[word[first]] = near[first]


def leaf_task(words: list[str], n: np.ndarray, filed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words met here, the best of them or -1) for words that are filed or met any."""
    met = Met(words, n)
    points, starts, lengths = letters(words)
    bits = count_bits(words)
    home = np.flatnonzero(filed)
    length = int(lengths[home[0]]) if len(home) else 0
    for longer, guests in ((0, np.flatnonzero(lengths == length)), (1, np.flatnonzero(lengths == length - 1))):
        if not len(home) or not len(guests):
            continue
        found_x, found_y, waiting = [], [], 0
        for i, j in candidate_pairs(bits[home], bits[guests], longer):
            x, y = guests[i], home[j]
            once = ~filed[x] | (x < y)  # of two words that are filed here, one visits the other
            x, y = x[once], y[once]
            near = one_edit(points, starts, x, y, length, longer)
            found_x.append(x[near])
            found_y.append(y[near])
            waiting += int(near.sum())
            if waiting > PAIRS:
                x, y = np.concatenate(found_x), np.concatenate(found_y)
                met.add(np.concatenate((x, y)), np.concatenate((y, x)))
                found_x, found_y, waiting = [], [], 0
        if waiting:
            x, y = np.concatenate(found_x), np.concatenate(found_y)
            met.add(np.concatenate((x, y)), np.concatenate((y, x)))
    told = np.flatnonzero(filed | (met.count > 0))
    return told, met.count[told], met.best[told]


# the whole


DEALT = "leaf long, word string, n long, filed boolean"
MET = "word string, n long, n_near long, near string, near_n long"


def near_words(counts: DataFrame) -> DataFrame:
    """word, n, n_near, near (the best near word) and near_n for a stored table of word and n."""
    spark = counts.sparkSession
    total = counts.count()
    drawn = counts.where(F.pmod(F.xxhash64("word"), F.lit(max(1, total))) < SAMPLE_WORDS).limit(2 * SAMPLE_WORDS)
    leaves = Leaves(sorted(row["word"] for row in drawn.select("word").toLocalIterator()), total)
    dealt, met = pa_schema(spark, DEALT), pa_schema(spark, MET)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                at, leaf, filed = leaves.deal(batch.column("word").to_pylist())
                columns = [pa.array(leaf), batch.column("word").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(filed)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, dealt)], schema=dealt)
        hand_back()

    def meet(group: pa.Table) -> pa.Table:
        words, n = group.column("word").to_pylist(), group.column("n").to_numpy()
        at, count, best = leaf_task(words, n, group.column("filed").to_numpy(zero_copy_only=False))
        none = best < 0
        near = pa.array(np.where(none, 0, best), mask=none)
        out = pa.table([group.column("word").take(pa.array(at)), pa.array(n[at]), pa.array(count), group.column("word").take(near), group.column("n").take(near)], names=met.names)
        hand_back()
        return out.cast(met)

    # a leaf is more work than its bytes say, so that the number of partitions is given
    parts = max(leaves.count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = counts.mapInArrow(deal, DEALT).repartition(parts, "leaf").groupBy("leaf").applyInArrow(meet, MET)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    out = out.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for a stored table of word and form: each round jumps twice as far as the one before.

    Occurrences double from word to form, so that there are no circles and a few rounds will do.
    """
    current = forms.select("word", F.col("form").alias("root"))
    while True:
        up = current.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = stored(current.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if not step.where("moved").head(1):
            return step.select("word", "root")
        current = step.select("word", "root")


def spelling_variants(
    docs: DataFrame, least: int = 5, often: int = 3, every: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, form (or null), root, n, n_near, form_n (or null).

    ``every``: of every so many pairs of document and run, by a checksum, one loses a letter, as if misspelt.
    """
    counts = stored(word_counts(docs, least, often, every, doc_id, text), "words")
    kept = F.col("near_n") >= 2 * F.col("n")
    near = stored(near_words(counts), "near_words").select("word", "n", "n_near", F.when(kept, F.col("near")).alias("form"), F.when(kept, F.col("near_n")).alias("form_n"))
    root = roots(near.where("form is not null"))
    out = near.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SPELLING_SQL = r"""
WITH RECURSIVE
bits(k, byte, c) AS (
  SELECT 0, b::BIGINT, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM range(256) r(b)
),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
),
messages AS (SELECT doc_id, run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS bytes FROM runs),
longest AS (SELECT max(octet_length(bytes)) AS k FROM messages),
shifted(k, byte, c) AS (
  SELECT k, byte, c FROM bits
  UNION ALL
  SELECT s.k + 1, s.byte, xor(s.c >> 8, b.c) FROM shifted s JOIN bits b ON b.byte = s.c & 255 WHERE s.k < (SELECT k FROM longest)
),
start(k, c) AS (
  SELECT 0::BIGINT, 4294967295
  UNION ALL
  SELECT s.k + 1, xor(s.c >> 8, b.c) FROM start s JOIN bits b ON b.byte = s.c & 255 WHERE s.k < (SELECT k FROM longest)
),
placed AS (
  SELECT doc_id, run, unnest(range(octet_length(bytes))) AS pos, octet_length(bytes) AS size, hex(bytes) AS digits FROM messages
),
sums AS (
  SELECT doc_id, run, any_value(size) AS size, bit_xor(s.c) AS c
  FROM placed JOIN shifted s ON s.k = size - 1 - pos AND s.byte = ('0x' || substr(digits, 2 * pos + 1, 2))::BIGINT
  GROUP BY doc_id, run
),
checks AS (
  SELECT r.doc_id, r.run, r.n, xor(xor(sums.c, s.c), 4294967295) AS h
  FROM runs r JOIN sums ON sums.run = r.run AND sums.doc_id IS NOT DISTINCT FROM r.doc_id JOIN start s ON s.k = sums.size
),
counts AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checks)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
gaps AS (SELECT DISTINCT word, n, pos, substr(word, 1, pos) || substr(word, pos + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM counts)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN counts b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN counts b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near COLLATE "binary") AS near, max(near_n) AS near_n FROM pairs GROUP BY word
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM counts LEFT JOIN best USING (word)
),
chain(word, pos, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form
)
SELECT f.word, f.form, c.pos AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"), every=97)
