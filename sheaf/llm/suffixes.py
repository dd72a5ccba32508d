"""Suffix-array dedup over bytes, by a distributed difference cover.

A difference cover D modulo v samples the suffixes that start at places in D modulo v. For any two places
there is a shift below v after which both are sampled, so equal strings of v - 1 + d bytes always share a
sampled place whose next d bytes are equal. With v = 21 and 50 bytes, d is 30. Three rounds follow, each
of them one shuffle by a name's hash, so that equal names lie side by side in a sorted bucket. Order is by hash
throughout: no suffix array and no lexicographic order is built.

1. The sampled suffixes are named by hashes of their first d bytes, and sorted by them. A name that one document alone has
   ends there: no string through that place repeats. All others stay.
2. Names are refined by all that strings of the wanted length through the place can reach (70 bytes, the
   name and what is left and right of it). Within a refined name, all but the smallest doc_id lose those
   strings. A name with one refinement is done. As matches count from 50 bytes on, names need not go deeper.
3. For names with several refinements the remaining suffixes, those of the places just before, are merged
   through their sampled neighbour: the hashes of their strings of 50 bytes are sorted, adjacent ones compared.

Texts travel as compressed pieces of some megabytes that are written once; what a round finds goes
back to its piece as a few bits per name. Texts are hashed and their samples sorted in the first two rounds only: a note of
a bit for each sample and four bytes for each that lives tells the piece's later rounds the rest. Equal texts and names inside a piece are sent once, with their
smallest doc_id, so a group of copies costs no more than one of them for each piece.

Matches never cross documents. A null or empty text has no bytes; a null doc_id counts as larger than any
other, rows with the same doc_id are not earlier than each other, and repeated rows get equal results. An
empty table gives an empty result; other columns are not read. A single text is treated in one task, whole,
with about sixty bytes of memory for each of its own.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, table, text_partitions
from sheaf.llm.hashing import mix, prefix, runs, span_hashes
from sheaf.llm.rounds import (
    LOW,
    NO_ID,
    OWN,
    Rounds,
    bucket_key,
    bucket_runs,
    compressor,
    decompressor,
    piece_texts,
    sort_keys,
    squeeze,
    text_pieces,
    unsqueeze,
)
from sheaf.llm.substrings import earliest

LENGTH = 50
# Perfect difference sets, by modulus.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
# Names to a bucket, on average; strings that are merged at a time, and hashed at a time.
BUCKET_NAMES = 1_500_000
MERGED_STRINGS = 150_000
HASHED_STRINGS = 30_000
# Bits of a window's hash that are sorted beside its place.
KEY_BITS = 40


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The cover of the largest modulus that leaves more than half of the length to the names."""
    if length < 5:
        raise ValueError("length is 5 or more")
    modulus = max(v for v in COVERS if 2 * (v - 1) < length)
    return modulus, COVERS[modulus]


def bucket_count(names: int, bucket_names: int) -> int:
    """Buckets of ``bucket_names`` names up to 64 of them, above that of up to twice as many: every piece has a row for each."""
    wide = -(-names // bucket_names)
    return max(1, min(wide, 64), -(-wide // 2))


class Piece:
    """Some documents' texts; what is sampled in them, in the order in which every round sends it."""

    def __init__(self, row: dict, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.modulus, self.cover = cover_for(length)
        self.depth = length - self.modulus + 1
        self.doc_ids = row["doc_ids"]
        ids = [NO_ID if i is None else i for i in self.doc_ids]
        number: dict[bytes, int] = {}
        self.row_text = [number.setdefault(t, len(number)) for t in piece_texts(row)]
        self.texts = list(number)
        self.row_id = np.array(ids, np.int64)
        self.owner = np.full(len(self.texts), NO_ID, np.int64)
        np.minimum.at(self.owner, self.row_text, self.row_id)
        self.data = b"".join(self.texts)
        self.buffer = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes

    @cached_property
    def places(self):
        """Text and place of each sampled suffix."""
        longest = int((self.stops - self.starts).max(initial=0))
        places = np.arange(longest)
        pattern = places[np.isin(places % self.modulus, self.cover)]
        long = np.flatnonzero(self.stops - self.starts >= self.length)
        upto = np.searchsorted(pattern, self.stops[long] - self.starts[long] - self.depth, side="right")
        at = np.concatenate([np.empty(0, np.int64), *(pattern[:n] + s for n, s in zip(upto.tolist(), self.starts[long].tolist()))])
        return np.repeat(long, upto), at

    @cached_property
    def sampled(self):
        """Hashes up to each byte; of the sampled suffixes, the order by key (bucket and low half of the name's hash), and the
        keys in it; the first of each distinct key."""
        _, at = self.places
        sums = prefix(self.buffer)
        order, key = sort_keys(bucket_key(span_hashes(sums, at, at + self.depth), self.buckets))
        return sums, order, key, np.flatnonzero(new_runs(key))

    def reach(self, text: np.ndarray, at: np.ndarray):
        """Start and end of what strings of the wanted length through a sampled place reach."""
        return np.maximum(at - (self.modulus - 1), self.starts[text]), np.minimum(at + self.length, self.stops[text])

    # what each round sends: (bucket, columns)

    def send_names(self):
        """Distinct names, and whether documents of the piece share them."""
        text, _ = self.places
        _, order, key, first = self.sampled
        shared = np.zeros(len(first), bool)
        again = np.flatnonzero(key[1:] == key[:-1])
        mixed = again[self.owner[text[order[again]]] != self.owner[text[order[again + 1]]]]
        shared[np.searchsorted(first, mixed, side="right") - 1] = True
        key = key[first]
        for bucket, low, high in bucket_runs(key):
            half = (key[low:high] & LOW).astype("<u4")
            yield bucket, [squeeze(np.diff(half, prepend=np.uint32(0))), np.packbits(shared[low:high]).tobytes()], high - low

    def send_refined(self, alive: np.ndarray):
        """Distinct refinements of the names that live. The note says which samples have which of them."""
        text, at = self.places
        sums, order, key, first = self.sampled
        sizes = np.diff(np.append(first, len(key)))
        live = np.repeat(alive, sizes)
        order, key, name = order[live], key[live], np.repeat(np.arange(int(alive.sum()), dtype=np.uint64), sizes[alive])
        if not len(order):
            return
        text, at = text[order], at[order]
        start, end = self.reach(text, at)
        more = mix(span_hashes(sums, start, end) + (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by, new = sort_pairs(name, more)
        first = np.flatnonzero(new)
        which = np.empty(len(self.places[1]), np.int64)
        which[order[by]] = np.cumsum(new) - 1
        there = np.zeros(len(which), bool)
        there[order] = True
        own = np.minimum.reduceat(self.owner[text[by]], first)
        key, more = key[by[first]], more[by[first]]
        runs_of = list(bucket_runs(key))
        yield OWN, [write_note(there, which[there], runs_of)], 0
        for bucket, low, high in runs_of:
            half = (key[low:high] & LOW).astype("<u4")
            yield bucket, [squeeze(np.diff(half, prepend=np.uint32(0))), squeeze(more[low:high]), squeeze(own[low:high])], high - low

    def refined(self, note: bytes | None):
        """Of the samples whose name lives: text, start and end of what strings through it reach, refinement; and the number
        of refinements by bucket. Nothing is hashed or sorted again."""
        if note is None:
            none = np.empty(0, np.int64)
            return none, none, none, none, none, none
        there, which, bucket, count = read_note(note)
        text, at = (x[there[: len(x)]] for x in self.places)
        return text, *self.reach(text, at), which, bucket, count

    def send_strings(self, refined: tuple):
        note, fate = refined
        text, start, end, which, bucket, count = self.refined(note)
        least = np.full(len(fate), NO_ID, np.int64)
        np.minimum.at(least, which, self.owner[text])
        sample = np.empty(len(fate), np.int64)
        sample[which] = np.arange(len(which))
        for bucket, high, n in zip(bucket.tolist(), np.cumsum(count).tolist(), count.tolist()):
            open_ = np.flatnonzero(fate[high - n : high] == OPEN) + high - n
            if not len(open_):
                continue
            low, top = start[sample[open_]], end[sample[open_]]
            strings = b"".join([self.data[a:b] for a, b in zip(low.tolist(), top.tolist())])
            yield bucket, [compressor(3).compress(strings), squeeze((top - low).astype("u1")), squeeze(least[open_])], len(open_)

    def removed(self, refined: tuple, late: np.ndarray) -> np.ndarray:
        """Which bytes of the distinct texts go; ``late``: for each string sent, the bits of its windows."""
        note, fate = refined
        text, start, end, which, _, _ = self.refined(note)
        every = np.uint32(0xFFFFFFFF)
        masks = np.zeros(len(fate), np.uint32)
        masks[fate == OPEN] = late
        masks[fate == LATE] = every
        own = self.owner[text]
        least = np.full(len(fate), NO_ID, np.int64)
        np.minimum.at(least, which, own)
        mask = masks[which]
        mask[own > least[which]] = every
        some = mask != 0
        mask, start, end = mask[some], start[some], end[some]
        hit = np.zeros(len(self.buffer) + 1, bool)
        for shift in range(self.modulus):
            there = (mask >> np.uint32(shift) & np.uint32(1)).astype(bool) & (start + shift + self.length <= end)
            hit[start[there] + shift] = True
        return marked(len(self.buffer), np.flatnonzero(hit), self.length)


def new_runs(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def sort_pairs(name: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by name and hash, and where in it a new pair begins.

    Names and the first bits of the hashes are sorted as one number; hashes that differ in later bits only, and names too
    large, are sorted in full.
    """
    bits = 62 - max(1, (len(name) - 1).bit_length()) - int(name.max()).bit_length()
    if bits > 0:
        order, both = sort_keys(name << np.uint64(bits) | more >> np.uint64(64 - bits))
        a, b, new = name[order], more[order], new_runs(both)
        if not ((b[1:] != b[:-1]) & ~new[1:]).any():
            return order, new
    order = np.lexsort((more, name))
    return order, new_runs(name[order]) | new_runs(more[order])


def write_note(there: np.ndarray, which: np.ndarray, runs_of: list[tuple[int, int, int]]) -> bytes:
    """Which samples live, their refinements, and the refinements sent to each bucket."""
    columns = [
        compressor(1).compress(np.packbits(there).tobytes()),
        squeeze(which.astype("<u4")),
        squeeze(np.array([b for b, _, _ in runs_of], "<u4")),
        squeeze(np.array([high - low for _, low, high in runs_of], "<u4")),
    ]
    return np.array([len(c) for c in columns], "<u4").tobytes() + b"".join(columns)


def read_note(note: bytes):
    ends = 16 + np.cumsum(np.frombuffer(note, "<u4", 4).astype(np.int64))
    there, which, bucket, count = (note[a:b] for a, b in zip([16, *ends[:-1].tolist()], ends.tolist()))
    there = np.unpackbits(np.frombuffer(decompressor().decompress(there), np.uint8)).astype(bool)
    return there, *(unsqueeze(x, "<u4").astype(np.int64) for x in (which, bucket, count))


def marked(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in the spans of one length that begin at sorted places."""
    change = np.zeros(n + 1, np.int8)
    if len(at):
        apart = np.flatnonzero(np.diff(at) > length)
        change[at[np.append(0, apart + 1)]] = 1
        change[at[np.append(apart, len(at) - 1)] + length] = -1
    return np.cumsum(change[:n], dtype=np.int8).view(bool)


DONE, LATE, OPEN = 0, 1, 2


def meet_names(rows: list[list[bytes]], counts: list[int]) -> list[bytes]:
    """Which names live: those in two pieces, or in two documents of one."""
    half = np.concatenate([np.cumsum(unsqueeze(r[0], "<u4"), dtype=np.uint32) for r in rows])
    shared = np.concatenate([np.unpackbits(np.frombuffer(r[1], np.uint8), count=n) for r, n in zip(rows, counts)]).astype(bool)
    order, half = sort_keys(half)
    same = half[1:] == half[:-1]
    alive = np.zeros(len(half), bool)
    alive[order[1:]] = same
    alive[order[:-1]] |= same
    # a name that one piece shares lives everywhere; there it has at least one neighbour or is alone
    alive |= shared
    ends = np.cumsum(counts)
    return [np.packbits(alive[e - n : e]).tobytes() for e, n in zip(ends, counts)]


def meet_refined(rows: list[list[bytes]], counts: list[int]) -> list[bytes]:
    half = np.concatenate([np.cumsum(unsqueeze(r[0], "<u4"), dtype=np.uint32) for r in rows])
    more = np.concatenate([unsqueeze(r[1], "<u8") for r in rows])
    own = np.concatenate([unsqueeze(r[2], "<i8") for r in rows])
    order, new = sort_pairs(half.astype(np.uint64), more)
    a, o = half[order], own[order]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(a)))
    least = np.repeat(np.minimum.reduceat(o, first), sizes)
    names = np.flatnonzero(new_runs(a))
    several = np.repeat(np.add.reduceat(new.astype(np.int64), names) > 1, np.diff(np.append(names, len(a))))
    fate = np.empty(len(a), np.uint8)
    fate[order] = np.where(o > least, LATE, np.where(several, OPEN, DONE))
    ends = np.cumsum(counts)
    return [squeeze(fate[e - n : e]) for e, n in zip(ends, counts)]


def meet_strings(rows: list[list[bytes]], counts: list[int], length: int) -> list[bytes]:
    """For each string, the bits of its windows that a smaller doc_id has too."""
    slices = max(1, -(-sum(counts) // MERGED_STRINGS))
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1], np.uint32)
    # Rows are short where there are many; they are hashed together.
    together = [rows[a:b] for a, b in batches(ends, HASHED_STRINGS)]

    def strings(part):
        return np.frombuffer(b"".join([decompressor().decompress(r[0]) for r in part]), np.uint8)

    for piece in range(slices):
        entries, skip = [], 0
        for part in together:
            sizes = np.concatenate([unsqueeze(r[1], "u1") for r in part]).astype(np.int64)
            windows = sizes - length + 1
            string = np.repeat(np.arange(len(sizes)), windows)
            offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = (np.cumsum(sizes) - sizes)[string] + offset
            one = span_hashes(prefix(strings(part)), at, at + length)
            if slices > 1:
                mine = one % np.uint64(slices) == piece
                one, string, offset, at = one[mine], string[mine], offset[mine], at[mine]
            entries.append((one, string + skip, offset.astype(np.uint32), at))
            skip += len(sizes)
        one, string, offset, _ = map(np.concatenate, zip(*entries))
        if not len(one):
            continue
        # The second hash is taken for windows that meet another only.
        order, key = sort_keys(one >> np.uint64(64 - KEY_BITS))
        same = key[1:] == key[:-1]
        meets = np.zeros(len(one), bool)
        meets[order[1:]] = same
        meets[order[:-1]] |= same
        parts = np.split(meets, np.cumsum([len(e[0]) for e in entries])[:-1])
        two = [span_hashes(prefix(strings(part), 1), e[3][m], e[3][m] + length) for part, e, m in zip(together, entries, parts)]
        del entries, order, key
        one, string, offset = one[meets], string[meets], offset[meets]
        own = np.concatenate([unsqueeze(r[2], "<i8") for r in rows])[string]
        late = np.flatnonzero(earliest(one, np.concatenate(two), own) < own)
        np.bitwise_or.at(out, string[late], np.uint32(1) << offset[late])
    return [squeeze(out[e - n : e]) for e, n in zip(ends, counts)]


def batches(ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """First and last rows, exclusive, of batches of consecutive ones, given the sums of their entries up to each."""
    cuts = np.flatnonzero(np.diff(ends // size, prepend=0)) + 1
    cuts = sorted({0, *cuts.tolist(), len(ends)})
    return list(zip(cuts[:-1], cuts[1:]))


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", bucket_names: int = BUCKET_NAMES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay."""
    modulus, cover = cover_for(length)
    _, total = text_partitions(docs, 1 << 30, text)
    buckets = bucket_count(total * len(cover) // modulus, bucket_names)
    rounds = Rounds(text_pieces(docs, doc_id, text), lambda row: Piece(row, length, buckets), ("bits", "note and u1", "<u4"))
    rounds.round("send_names", meet_names)
    rounds.round("send_refined", meet_refined, given=(0,))
    rounds.round("send_strings", lambda rows, counts: meet_strings(rows, counts, length), given=(1,))

    def cut(piece, replies):
        gone = piece.removed(*replies)
        for row, k in enumerate(piece.row_text):
            text = piece.texts[k]
            own = gone[piece.starts[k] : piece.stops[k]]
            if piece.row_id[row] > piece.owner[k] and len(text) >= length:
                own = np.ones(len(text), bool)
            n = int(own.sum())
            kept = np.frombuffer(text, np.uint8)[~own].tobytes() if n else text
            yield piece.doc_ids[row], len(text), n, len(runs(own)[0]) if n else 0, kept

    return rounds.each(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", given=(1, 2))


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark, sf):
    out = suffix_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
