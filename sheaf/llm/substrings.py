"""Substring dedup over words: windows of consecutive words that an earlier document has are removed.

Super-k-mer partitioning: each window has a minimiser, the least hash among its runs of three words.
Consecutive windows with the same minimiser travel as one packed string to the bucket of that minimiser, so
a word is sent about three times instead of thirteen, and equal windows always meet. In a bucket the windows
are sorted by two 64-bit hashes of their words, and each learns whether a smaller doc_id has it; a bit for
each window goes back to the piece of text it came from.

Equal texts and equal strings of a piece are sent once, with their smallest doc_id, so a passage that a third
of all documents share costs a string for each piece, however often it is there. The number of buckets
follows the bytes of text, so that a bucket stays small; a bucket that is large all the same is sorted in
slices of the hash space.

Words lie between ASCII blanks. A null text has no words; a null doc_id counts as larger than any other, so
nothing is removed for its sake; rows with the same doc_id are not earlier than each other. Repeated rows get
equal results, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, table, text_partitions
from sheaf.llm.hashing import covered, pack_words, prefix, scan_words, span_hashes
from sheaf.llm.rounds import NO_ID, Rounds, piece_texts, squeeze, text_pieces, unsqueeze

WINDOW = 13
MINIMISER = 3
# Bytes of text to a bucket, and windows that are sorted at a time.
BUCKET_BYTES = 6_000_000
SORTED_WINDOWS = 1_500_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    reach, least = 1, values
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return least


def super_strings(packed, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows that share one."""
    at = packed.windows(window)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    sums = prefix(packed.buffer, 1)
    small = span_hashes(sums, packed.starts[: len(packed.starts) - minimiser + 1], packed.ends[minimiser - 1 :])
    least = sliding_min(small, window - minimiser + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[first]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each of the counts, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Windows:
    """Some documents' texts, and the distinct strings of windows in them, in the order they are sent."""

    def __init__(self, row: dict, window: int, minimiser: int, buckets: int):
        self.window, self.minimiser, self.buckets = window, minimiser, buckets
        self.doc_ids = row["doc_ids"]
        self.row_id = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)
        number: dict[bytes, int] = {}
        self.row_text = [number.setdefault(t, len(number)) for t in piece_texts(row)]
        self.owner = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(self.owner, self.row_text, self.row_id)
        self.texts = [t.split() for t in number]
        self.packed = pack_words(self.texts)

    @cached_property
    def places(self):
        """First word and number of windows of each string, sorted by bucket."""
        first, windows, least = super_strings(self.packed, self.window, self.minimiser)
        bucket = (least % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return first[order], windows[order], bucket[order]

    @cached_property
    def strings(self):
        """The distinct strings with their bucket, windows and smallest owner; and the one at each place."""
        first, windows, bucket = self.places
        starts, ends = self.packed.starts[first].tolist(), self.packed.ends[first + windows + self.window - 2].tolist()
        data, number = self.packed.data, {}
        which = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(starts, ends)), np.int64, len(first))
        _, at = np.unique(which, return_index=True)
        owner = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(owner, which, self.owner[self.packed.text[first]])
        return list(number), bucket[at], windows[at], owner, which

    def send_strings(self):
        strings, bucket, windows, owner, _ = self.strings
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        press = zstandard.ZstdCompressor(level=4).compress
        for low, high in zip(cuts, [*cuts[1:], len(strings)]):
            packed = press(b"\n".join(strings[low:high]) + b"\n")
            yield int(bucket[low]), [packed, squeeze(owner[low:high])], int(windows[low:high].sum())

    def removed(self, late: np.ndarray) -> np.ndarray:
        """Which words of the distinct texts go; ``late``: for each window sent, whether a smaller id has it."""
        first, windows, _ = self.places
        _, _, sizes, owner, which = self.strings
        begin = np.cumsum(sizes) - sizes
        again = self.owner[self.packed.text[first]] > owner[which]  # an earlier text here has the whole string
        hit = late[ranges(begin[which], windows)] | np.repeat(again, windows)
        at = ranges(first, windows)[hit]
        return covered(len(self.packed.starts), at, at + self.window)

    def cut(self, late: np.ndarray):
        """doc_id, words, removed ones, and those that stay joined by one space."""
        gone = self.removed(late)
        first = self.packed.first
        for doc, row_id, k in zip(self.doc_ids, self.row_id.tolist(), self.row_text):
            words, own = self.texts[k], gone[first[k] : first[k + 1]]
            if row_id > self.owner[k] and len(words) >= self.window:
                yield doc, len(words), len(words), ""
            else:
                n = int(own.sum())
                kept = [w for w, g in zip(words, own.tolist()) if not g] if n else words
                yield doc, len(words), n, b" ".join(kept).decode()


def earliest(first_hash: np.ndarray, second_hash: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The least owner among the entries that share both hashes."""
    order = np.argsort(first_hash, kind="stable")
    a, b = first_hash[order], second_hash[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((second_hash, first_hash))
        a, b = first_hash[order], second_hash[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    group = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(owner[order], group)
    out = np.empty_like(owner)
    out[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    return out


def meet_strings(rows: list[list[bytes]], counts: list[int], window: int) -> list[bytes]:
    """For each row sent, the bits of its windows that a smaller doc_id has too."""
    unpress = zstandard.ZstdDecompressor().decompress
    slices = max(1, -(-sum(counts) // SORTED_WINDOWS))
    late = [np.zeros(n, bool) for n in counts]
    for piece in range(slices):
        entries = []
        for k, row in enumerate(rows):
            words, owner = scan_words(unpress(row[0])), unsqueeze(row[1], "<i8")
            at = words.windows(window)
            one, two = (span_hashes(prefix(words.buffer, seed), words.starts[at], words.ends[at + window - 1]) for seed in (0, 1))
            mine = np.arange(len(at), dtype=np.int32)
            if slices > 1:
                mine = mine[one % np.uint64(slices) == piece]
            entries.append((one[mine], two[mine], owner[words.text[at[mine]]], np.full(len(mine), k, np.int32), mine))
        one, two, owner, row, place = map(np.concatenate, zip(*entries))
        if not len(one):
            continue
        hit = np.flatnonzero(earliest(one, two, owner) < owner)
        row, place = row[hit], place[hit]
        for k in np.unique(row).tolist():
            late[k][place[row == k]] = True
    return [np.packbits(bits).tobytes() for bits in late]


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", minimiser: int = MINIMISER,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space."""
    if not 1 <= minimiser <= window:
        raise ValueError("a minimiser has at least one word and no more than a window")
    buckets, _ = text_partitions(docs, bucket_bytes, text)
    rounds = Rounds(text_pieces(docs, doc_id, text), lambda row: Windows(row, window, minimiser, buckets), ("bits",))
    rounds.round("send_strings", lambda rows, counts: meet_strings(rows, counts, window))
    return rounds.each(lambda piece, replies: piece.cut(*replies), "doc_id long, n_words long, n_removed long, kept string")


SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), p as (
  select doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) as pos from d where len(words) >= {WINDOW}
), w as (
  select doc_id, pos, array_to_string(words[pos:pos + {WINDOW} - 1], ' ') as gram from p
), m as (
  select doc_id, pos, min(doc_id) over (partition by gram) < doc_id as late from w
), h as (
  select distinct doc_id, unnest(range(pos, pos + {WINDOW})) as k from m where late
), a as (
  select doc_id, words, unnest(range(1, len(words) + 1)) as k from d
), s as (
  select a.doc_id, string_agg(words[a.k], ' ' order by a.k) filter (h.k is null) as kept, count(h.k) as n_removed
  from a left join h on a.doc_id = h.doc_id and a.k = h.k group by a.doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s on d.doc_id = s.doc_id
"""


@query("op10_substring_dedup", SQL)
def op10_substring_dedup(spark, sf):
    out = substring_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
