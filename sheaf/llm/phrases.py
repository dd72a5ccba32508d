"""Phrase collocations, by Misra-Gries summaries over hash partitions and an exact second pass.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and
tabs. Languages are counted apart; a null one is ``und``. Candidates are phrases of two to ``longest`` words with
at least ``often`` occurrences (overlaps count). A cut of a candidate scores two million times its occurrences
over those of both parts together, rounded down; the lowest score of its cuts counts. A candidate goes if a longer
one that holds its words side by side has at least 80 % of its occurrences.

First pass: each piece of text counts its own words, later its own phrases, and sends the counts to hash
partitions. A partition merges them into a Misra-Gries summary: whenever there are more counters than its capacity,
which exceeds its mass divided by the threshold, the count of the first counter beyond it is taken off all. What
has been taken off in all stays below the threshold, so that whatever occurs as often as that keeps a counter, and
any with less than the threshold left, what was taken off included, is ruled out. Words go first; phrases are only
counted where all their words survive. Hashes may collide, by which too much survives, never too little.

Second pass: pieces give the survivors as text with their own counts, and Spark sums those exactly. All later
steps are joins and aggregates of the counts: a hot word is one row there, as it is counted piece by piece
before anything moves. In a piece, phrases are told apart by 64-bit hashes.

Null and empty texts have no words. Repeated rows count as often as they are there; ids are not read, nor any
other column. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import hand_back, map_pieces, pa_schema, query, stored, table, text_partitions
from sheaf.llm.hashing import mix, prefix, span_hashes
from sheaf.llm.rounds import LOW, Rounds, bucket_key, bucket_runs, piece_texts, read_replies, squeeze, unsqueeze

OFTEN = 30
LONGEST = 4
TOP = 2000
# Entries to a hash partition.
BUCKET_ENTRIES = 1_000_000

# What cuts a text into pieces, and what parts words.
CUTS = b".,;:!?\n\x0b\x0c\r"
BLANKS = re.compile(rb" {2,}")
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + CUTS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(CUTS))

PIECES = "piece string, langs array<string>, lengths array<bigint>, texts binary"
COUNTED = "lang string, words int, phrase string, n long"


def lang_pieces(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Texts with their languages, gathered into pieces, written once."""

    def gather(part):
        texts = [(t or b"") for t in part.column("text").to_pylist()]
        return {
            "piece": [uuid.uuid4().hex],
            "langs": [part.column("lang").to_pylist()],
            "lengths": [[len(t) for t in texts]],
            "texts": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))],
        }

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return stored(map_pieces(rows, gather, PIECES), "pieces")


class Phrases:
    """The words and phrases of a piece: places in a buffer in which words are parted by one space."""

    def __init__(self, row: dict, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        texts = [BLANKS.sub(b" ", text.translate(PLAIN)) for text in piece_texts(row)]
        data = b"\n".join([*texts, b""])
        self.buffer = np.frombuffer(data, np.uint8)
        inside = (self.buffer != 0x20) & (self.buffer != 0x0A)
        change = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        self.starts, self.ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        self.names = sorted(set(row["langs"]))
        number = {name: k for k, name in enumerate(self.names)}
        lang = np.array([number[name] for name in row["langs"]], np.int64)
        self.lang = np.repeat(lang, self.words_of_texts(texts))
        salts = [int(np.frombuffer(uuid.uuid5(uuid.NAMESPACE_OID, name).bytes[:8], "<u8")[0]) for name in self.names]
        self.salt = np.array(salts, np.uint64)[self.lang] if self.names else np.empty(0, np.uint64)
        self.segment = np.searchsorted(np.flatnonzero(self.buffer == 0x0A), self.starts)

    def words_of_texts(self, texts: list[bytes]) -> np.ndarray:
        first = np.cumsum([0, *(len(text) + 1 for text in texts)])
        return np.diff(np.searchsorted(self.starts, first))

    @cached_property
    def sums(self) -> np.ndarray:
        return prefix(self.buffer)

    def distinct(self, first: np.ndarray, words: np.ndarray):
        """Keys in order, counts, and of one occurrence its first word and its words, for phrases at these places."""
        last = first + words - 1
        hashes = mix(span_hashes(self.sums, self.starts[first], self.ends[last]) ^ self.salt[first])
        key = bucket_key(hashes, self.buckets)
        order = np.lexsort((hashes, key))
        new = np.concatenate(([True], np.diff(hashes[order]) != 0)) if len(order) else np.empty(0, bool)
        cuts = np.flatnonzero(new)
        one = order[cuts]
        return key[one], np.diff(np.append(cuts, len(order))), first[one], words[one]

    def marked(self, first: np.ndarray) -> np.ndarray:
        """For each word of the piece: does it equal one of those at these places?"""
        hashes = mix(span_hashes(self.sums, self.starts, self.ends) ^ self.salt)
        kept = np.sort(hashes[first])
        if not len(kept):
            return np.zeros(len(hashes), bool)
        return kept[np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)] == hashes

    @cached_property
    def single(self):
        return self.distinct(np.arange(len(self.starts)), np.ones(len(self.starts), np.int64))

    def phrases(self, often: np.ndarray):
        """The distinct phrases all of whose words survive."""
        ok = self.marked(self.single[2][often])
        places, sizes = [], []
        n = len(self.starts)
        whole = ok.copy()
        for size in range(2, self.longest + 1):
            if n < size:
                break
            whole = whole[: n - size + 1] & ok[size - 1 :] & (self.segment[: n - size + 1] == self.segment[size - 1 :])
            at = np.flatnonzero(whole)
            places.append(at)
            sizes.append(np.full(len(at), size))
        empty = np.empty(0, np.int64)
        return self.distinct(np.concatenate([empty, *places]), np.concatenate([empty, *sizes]))

    def send(self, key: np.ndarray, counts: np.ndarray):
        for bucket, low, high in bucket_runs(key):
            half = (key[low:high] & LOW).astype("<u4")
            yield bucket, [squeeze(np.diff(half, prepend=np.uint32(0))), squeeze(counts[low:high].astype("<u4"))], high - low

    def send_words(self):
        return self.send(*self.single[:2])

    def send_phrases(self, often: np.ndarray):
        return self.send(*self.phrases(often)[:2])

    def survivors(self, often: np.ndarray, good: np.ndarray) -> list[pa.Array]:
        """lang, words, phrase and n of what survives; the number of a language's words has a null phrase."""
        _, counts, first, words = (x[often] for x in self.single)
        _, counts2, first2, words2 = (x[good] for x in self.phrases(often))
        counts, first, words = np.concatenate((counts, counts2)), np.concatenate((first, first2)), np.concatenate((words, words2))
        begin, end = self.starts[first], self.ends[first + words - 1]
        offsets = np.concatenate(([0], np.cumsum(end - begin)))
        place = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(self.buffer[place]))
        totals = np.bincount(self.lang, minlength=len(self.names))
        used = np.flatnonzero(totals)
        lang = pa.DictionaryArray.from_arrays(pa.array(np.concatenate((self.lang[first], used)).astype("i4")), pa.array(self.names, pa.string()))
        nothing = np.zeros(len(used), np.int64)
        return [
            lang.dictionary_decode(),
            pa.array(np.concatenate((words, nothing)).astype("i4")),
            pa.concat_arrays([text.cast(pa.string()), pa.nulls(len(used), pa.string())]),
            pa.array(np.concatenate((counts, totals[used])).astype("i8")),
        ]


class Summary:
    """A Misra-Gries summary that takes counts by the batch; other summaries' counters are such a batch too.

    ``taken`` is what has been taken off every counter, at most: a key has occurred at least as often as its
    counter says, and at most ``taken`` times more.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts, self.taken = np.empty(0, np.uint32), np.empty(0, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        self.keys, self.counts = keys[order[first]], np.add.reduceat(counts[order], first)
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > off
            self.keys, self.counts, self.taken = self.keys[left], self.counts[left] - off, self.taken + off

    def frequent(self, often: int) -> np.ndarray:
        """The keys, in order, that may have occurred that often; none that has is missing."""
        return self.keys[self.counts + self.taken >= often]


def summarise(batches: list[tuple[np.ndarray, np.ndarray]], often: int) -> Summary:
    """The merged summary of batches of (keys, counts), of a capacity above their mass divided by ``often``."""
    summary = Summary(sum(int(counts.sum()) for _, counts in batches) // often + 1)
    waiting, size = [], 0
    for batch in [*batches, None]:
        if batch is not None:
            waiting.append(batch)
            size += len(batch[0])
        if waiting and (batch is None or size > summary.capacity):
            summary.add(*map(np.concatenate, zip(*waiting)))
            waiting, size = [], 0
    if summary.taken >= often:
        raise ArithmeticError("more was taken off than the capacity allows")
    return summary


def meet_counts(often: int):
    """Which entries may be frequent."""

    def meet(rows: list[list[bytes]], counts: list[int]) -> list[bytes]:
        batches = [(np.cumsum(unsqueeze(r[0], "<u4"), dtype=np.uint32), unsqueeze(r[1], "<u4").astype(np.int64)) for r in rows]
        kept = summarise(batches, often).frequent(often)
        if not len(kept):
            return [np.packbits(np.zeros(n, bool)).tobytes() for n in counts]
        return [np.packbits(kept[np.minimum(np.searchsorted(kept, keys), len(kept) - 1)] == keys).tobytes() for keys, _ in batches]

    return meet


def phrase_counts(docs: DataFrame, often: int = OFTEN, longest: int = LONGEST, lang: str = "lang", text: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """lang, words, phrase and n for all words and phrases of up to ``longest`` words with ``often`` occurrences.

    For each language there is a row of no words and a null phrase with the number of all its words.
    """
    _, total = text_partitions(docs, 1 << 30, text)
    buckets = max(1, -(-total // 5 // bucket_entries))
    rounds = Rounds(lang_pieces(docs, lang, text), lambda row: Phrases(row, buckets, longest), ("bits", "bits"))
    rounds.round("send_words", meet_counts(often), given=())
    rounds.round("send_phrases", meet_counts(often), given=(0,))
    types, make = pa_schema(docs.sparkSession, COUNTED), rounds.piece

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                columns = make(row).survivors(read_replies(row["reply0"], "bits"), read_replies(row["reply1"], "bits"))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types)], schema=types)
        hand_back()

    found = rounds.known((0, 1)).mapInArrow(count, COUNTED)
    found = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(found.where(F.col("phrase").isNull() | (F.col("n") >= often)), "phrase_counts")


def collocations(
    docs: DataFrame, often: int = OFTEN, longest: int = LONGEST, top: int = TOP, lang: str = "lang", text: str = "text",
    bucket_entries: int = BUCKET_ENTRIES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language.

    a, l and r are the occurrences of the phrase and of the two parts of the cut that counts; n is the number of
    all words of the language.
    """
    counts = phrase_counts(docs, often, longest, lang, text, bucket_entries)
    candidates = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    # the greatest count of a longer candidate around each phrase
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), size -> transform(sequence(1, words - size + 1), at -> array_join(slice(w, at, size), ' '))))"
    )
    around = candidates.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(stored(around, "around"), ["lang", "phrase"], "left")
    kept = kept.where("longer is null or 100 * cast(longer as decimal(19,0)) < 80 * cast(a as decimal(19,0))")

    parts = F.expr(
        "transform(sequence(1, words - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') as first, array_join(slice(w, k + 1, words - k), ' ') as rest))"
    )
    cuts = kept.select("lang", "phrase", "a", F.explode(parts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    named = counts.where("words >= 1")
    cuts = cuts.join(named.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(named.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # the score is at most a million: neither part has fewer occurrences than the phrase
    scored = cuts.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("phrase is null").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
parted AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parted),
occurrences AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, range(1, 5) ks(k) WHERE i + k - 1 <= len(w)
),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM parted GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
around AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) ss(s), range(1, 4) starts(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL
),
kept AS (SELECT c.* FROM candidates c LEFT JOIN around r USING (lang, phrase) WHERE r.longer IS NULL OR 100 * r.longer < 80 * c.a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
  FROM kept, range(1, 4) cs(cut) WHERE cut < k
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, (2000000 * c.a) // (h.f + t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM best
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""


@query("op11_phrase_collocations", COLLOCATION_SQL)
def op11_phrase_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))
