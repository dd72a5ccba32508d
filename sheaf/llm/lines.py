"""Line dedup with an edit distance, by a segment-partition join.

Of lines that are equal or within ``edits`` edits of each other, directly or by way of others, the first one
in the order of doc_id and line stays; the others go. Lines shorter than ``least`` characters are compared
for equality only, lines of nothing but ASCII blanks always stay.

A line is cut into edits + 1 segments. At most ``edits`` edits leave one of them whole, so a line within
reach has that segment as a substring, at one of a few places that follow from both lengths. A line therefore
files its segments under (length, segment number, content), and looks up such substrings for all lengths it
can be matched with. One round tells pieces of text which of their lines met another line; only those are
sent, once for each distinct line, with the entries that met.

Pairs to be compared come from the entries alone: each entry pairs the lines filed under it with all that are
there. What lies before and after the matching segment are gaps, of which it is known how many edits they may
hold. An entry with many pairs is parted further: the widest gap is cut into segments as the line was, and the
lines file and look up these under longer keys, until few share a key or the gaps are too narrow to be cut.
Such last entries are dealt in blocks, by hash. Tasks take entries by their number of pairs, and verify all pairs
side by side with a banded bit-parallel edit distance.

A null text is an empty text; a null doc_id comes after all others. Rows with the same doc_id are told apart
by their texts, of repeated rows one is the first. Texts are treated whole. An empty table gives an empty
result; ``dedup_lines`` keeps all other columns as they are.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, hand_back, own_columns, query, row_key, stored, table, text_partitions
from sheaf.llm.components import EDGES, Forest, components, edge_table
from sheaf.llm.hashing import mix, prefix, prefix_of, span_hashes
from sheaf.llm.rounds import LOW, NO_ID, Rounds, bucket_key, bucket_runs, piece_texts, squeeze, text_pieces, unsqueeze

EDITS = 2
LEAST = 24
BLANKS = b" \t\n\x0b\x0c\r"
# Entries to a bucket; pairs, or rows, of an entry from which on it is parted; lines to a block of one that cannot
# be; pairs that a task verifies, all of them and at a time.
BUCKET_ENTRIES = 1_000_000
ENTRY_PAIRS = 500_000
ENTRY_ROWS = 20_000
BLOCK = 500
TASK_PAIRS = 500_000
STEP_PAIRS = 200_000


# the distance


def within(a: str, b: str, limit: int) -> bool:
    """Are two texts at most ``limit`` edits apart? ``limit`` is 31 at most.

    What both start and end with is left out. For the rest, the differences between neighbouring cells of a
    column of the edit table are kept as bits of a word that moves down one row with each column. Its top bit
    follows the lowest diagonal that a path of so few edits can reach, until that meets the last row; from
    there on the last row is followed.
    """
    if len(a) > len(b):
        a, b = b, a
    longer = len(b) - len(a)
    if longer > limit:
        return False
    start, n = 0, len(a)
    while start < n and a[start] == b[start]:
        start += 1
    while n > start and a[n - 1] == b[n - 1 + longer]:
        n -= 1
    a, b = a[start:n], b[start : n + longer]
    if not a:
        return True
    full, top = (1 << 64) - 1, 1 << 63
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = full & ~((1 << 63 - limit) - 1), 0
    cost = min(limit, len(a))
    for j, c in enumerate(b):
        shift = j + limit - 63
        own = places.get(c, 0)
        match = (own >> shift if shift > 0 else own << -shift) & full
        zero = (((match & up) + up) ^ up | match | down) & full
        plus = (down | ~(zero | up)) & full
        minus = zero & up
        if j < len(a) - limit:
            cost += not zero & top
            if cost > 2 * limit + longer:
                return False
        else:
            row = 62 + len(a) - limit - j
            if row >= 0:
                cost += (plus >> row & 1) - (minus >> row & 1)
        up = (minus | ~(zero >> 1 | plus)) & full
        down = zero >> 1 & plus
    return cost <= limit


def same_from(sums: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many characters are the same from places x and y on, or before them; by hashes of halves."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        half = (low[open_] + high[open_] + 1) // 2
        i, j = (x[open_], y[open_]) if not back else (x[open_] - half, y[open_] - half)
        same = span_hashes(sums, i, i + half) == span_hashes(sums, j, j + half)
        low[open_[same]] = half[same]
        high[open_[~same]] = half[~same] - 1
    return low


def within_all(points: np.ndarray, sums: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, limit: int) -> np.ndarray:
    """``within`` for pairs of texts, given by their places and lengths in an array of characters, side by side."""
    swap = nx > ny
    x, nx, y, ny = np.where(swap, y, x), np.where(swap, ny, nx), np.where(swap, x, y), np.where(swap, nx, ny)
    out = np.zeros(len(x), bool)
    pair = np.flatnonzero(ny - nx <= limit)
    start = same_from(sums, x[pair], y[pair], nx[pair])
    end = same_from(sums, (x + nx)[pair], (y + ny)[pair], nx[pair] - start, back=True)
    x, nx, y, ny = x[pair] + start, nx[pair] - start - end, y[pair] + start, ny[pair] - start - end
    out[pair[nx == 0]] = True
    pair, x, nx, y, ny = (c[nx > 0] for c in (pair, x, nx, y, ny))
    u = np.uint64
    full, top, one = u((1 << 64) - 1), u(63), u(1)
    up = np.full(len(pair), full & ~u((1 << 63 - limit) - 1))
    down, cost = np.zeros(len(pair), u), np.minimum(limit, nx)
    j = 0
    while len(pair):
        char = points[y + j]
        match = np.zeros(len(pair), u)
        for d in range(2 * limit + 1):  # rows of the band, from the lowest one up
            row = j + limit - d
            if row >= 0:
                inside = row < nx
                match |= (inside & (points[np.where(inside, x + row, 0)] == char)).astype(u) << u(63 - d)
        zero = ((match & up) + up) ^ up | match | down
        plus = down | ~(zero | up)
        minus = zero & up
        diagonal = j < nx - limit
        row = np.maximum(62 + nx - limit - j, 0).astype(u)
        last = ((plus >> row) & one).astype(np.int64) - ((minus >> row) & one).astype(np.int64)
        cost = cost + np.where(diagonal, (~zero >> top).astype(np.int64), np.where(62 + nx - limit - j >= 0, last, 0))
        up, down = minus | ~((zero >> one) | plus), (zero >> one) & plus
        j += 1
        ended = j >= ny
        out[pair[ended]] = cost[ended] <= limit
        live = ~ended & ~(diagonal & (cost > 2 * limit + ny - nx))
        if not live.all():
            pair, x, nx, y, ny, up, down, cost = (c[live] for c in (pair, x, nx, y, ny, up, down, cost))
    return out


# entries of the index


def segments(lengths: np.ndarray, edits: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a line's segment of that number starts, and how long it is; later ones take what is left over."""
    short, rest = lengths // (edits + 1), lengths % (edits + 1)
    plain = edits + 1 - rest
    return number * short + np.maximum(0, number - plain), short + (number >= plain)


class Texts:
    """Lines end to end, with hashes of all their parts."""

    def __init__(self, lines: list[str]):
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
        self.sums = prefix_of(mix(self.points.astype(np.uint64) + np.uint64(1)))

    def within(self, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
        """For pairs of lines: are they so few edits apart?"""
        return within_all(self.points, self.sums, self.starts[x], self.lengths[x], self.starts[y], self.lengths[y], limit)


class Entries(NamedTuple):
    """Entries of the index. Gaps: start and end in the line, edits it may hold, and its length in the filed line."""

    line: np.ndarray
    key: np.ndarray
    filed: np.ndarray
    gaps: np.ndarray | None

    def at(self, which: np.ndarray) -> Entries:
        return Entries(*(None if c is None else c[which] for c in self))


def line_entries(lines: list[str] | Texts, edits: int, least: int, gaps: bool = False) -> Entries:
    """All entries of lines of at least ``least`` characters."""
    texts = lines if isinstance(lines, Texts) else Texts(lines)
    lengths = texts.lengths
    line = np.flatnonzero(lengths >= least)
    out = []

    def add(which, length, number, start, move, size, filed):
        own = start + move
        begin = texts.starts[which] + own
        shape = (length * (edits + 1) + number).astype(np.uint64)
        sides = np.zeros((len(which), 2, 4), np.int32)
        if gaps:
            columns = (0, own, number, start), (own + size, lengths[which], edits - number, length - start - size)
            for side, column in enumerate(columns):
                for k, value in enumerate(column):
                    sides[:, side, k] = value
        key = mix(span_hashes(texts.sums, begin, begin + size) ^ mix(shape + np.uint64(7)))
        out.append((which, key, np.full(len(which), filed), sides))

    for shorter in range(edits + 1):
        for number in range(edits + 1):
            own = line[lengths[line] - shorter >= least]
            length = lengths[own] - shorter
            start, size = segments(length, edits, number)
            low = max(-number, shorter - (edits - number))
            high = min(number, shorter + (edits - number))
            for move in range(low, high + 1):
                if not shorter and not move:
                    add(own, length, number, start, move, size, True)
                    continue
                fits = (start + move >= 0) & (start + move + size <= lengths[own])
                add(own[fits], length[fits], number, start[fits], move, size[fits], False)
    line, key, filed, sides = map(np.concatenate, zip(*out))
    return Entries(line, key, filed, packed_gaps([sides], max(1, edits)) if gaps else None)


def packed_gaps(parts: list[np.ndarray], most: int) -> np.ndarray:
    """Gaps side by side, those without edits left out; at most so many hold any."""
    every = np.concatenate(parts, axis=1)
    order = np.argsort(every[:, :, 2] == 0, axis=1, kind="stable")
    out = np.zeros((len(every), most, 4), np.int32)
    every = np.take_along_axis(every, order[:, :, None], 1)[:, :most]
    out[:, : every.shape[1]] = np.where(every[:, :, 2:3] > 0, every, 0)
    return out


def parted(texts: Texts, entries: Entries) -> tuple[Entries, np.ndarray]:
    """Entries under longer keys, one gap cut into segments; and which entries have no gap that can be cut.

    Which gap that is follows from its edits and its length in the filed line, which all lines of a key agree on.
    """
    gaps = entries.gaps
    edits, wide = gaps[:, :, 2].astype(np.int64), gaps[:, :, 3].astype(np.int64)
    open_ = (edits > 0) & (wide > edits)
    last = ~open_.any(1)
    which = np.flatnonzero(~last)
    chosen = np.where(open_, wide, -1)[which].argmax(1)
    start, end, budget, length = (gaps[which, chosen, k].astype(np.int64) for k in range(4))
    rest = gaps[which].copy()
    rest[np.arange(len(which)), chosen] = 0
    longer = end - start - length
    line, key, filed = entries.line[which], entries.key[which], entries.filed[which]
    out = []
    for most in np.unique(budget).tolist():
        for more in np.unique(longer[budget == most]).tolist():
            own = np.flatnonzero((budget == most) & (longer == more))
            for number in range(most + 1):
                place, size = segments(length[own], most, number)
                for move in range(max(-number, more - (most - number)), min(number, more + (most - number)) + 1):
                    fits = (place + move >= 0) & (place + move + size <= (end - start)[own])
                    k, at, n = own[fits], (start[own] + place + move)[fits], size[fits]
                    begin = texts.starts[line[k]] + at
                    shape = mix(key[k] + ((chosen[k] * 64 + most) * 64 + number).astype(np.uint64))
                    sides = np.zeros((len(k), 2, 4), np.int32)
                    columns = (start[k], at, number, place[fits]), (at + n, end[k], most - number, length[k] - place[fits] - n)
                    for side, column in enumerate(columns):
                        for c, value in enumerate(column):
                            sides[:, side, c] = value
                    new = mix(span_hashes(texts.sums, begin, begin + n) ^ shape)
                    out.append((line[k], new, filed[k] if not move and not more else np.zeros(len(k), bool), rest[k], sides))
    if not out:
        return entries.at(np.empty(0, np.int64)), last
    line, key, filed, rest, sides = map(np.concatenate, zip(*out))
    return Entries(line, key, filed, packed_gaps([rest, sides], gaps.shape[1])), last


def line_nodes(lines: list[str]) -> np.ndarray:
    """A number for each line; equal lines have the same."""
    data = [line.encode() for line in lines]
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
    starts = np.concatenate(([0], ends[:-1]))
    hashes = span_hashes(prefix(np.frombuffer(b"".join(data), np.uint8)), starts, ends)
    return mix(hashes + (ends - starts).astype(np.uint64)).view(np.int64)


class Lines:
    """The lines of a piece; equal ones once."""

    def __init__(self, row: dict, buckets: int, edits: int, least: int):
        self.buckets, self.edits, self.least = buckets, edits, least
        self.doc_ids, self.keys = row["doc_ids"], row["keys"]
        self.parts = [t.decode().split("\n") for t in piece_texts(row)]
        number: dict[str, int] = {}
        first: list[tuple] = []  # the place of each line that comes first in this piece
        blank = BLANKS.decode()
        self.row_lines: list[list[int]] = []
        ids = [NO_ID if i is None else i for i in self.doc_ids]
        for row_number, (doc, key, parts) in enumerate(zip(ids, self.keys, self.parts)):
            own = []
            for at, part in enumerate(parts):
                if not part.strip(blank):
                    own.append(-1)
                    continue
                k = number.setdefault(part, len(first))
                place = (doc, key, row_number, at)
                if k == len(first):
                    first.append(place)
                elif place < first[k]:
                    first[k] = place
                own.append(k)
            self.row_lines.append(own)
        self.lines, self.first = list(number), first

    @cached_property
    def nodes(self) -> np.ndarray:
        return line_nodes(self.lines) if self.lines else np.empty(0, np.int64)

    @cached_property
    def line_order(self):
        key = bucket_key(self.nodes.view(np.uint64), self.buckets)
        order = np.argsort(key, kind="stable")
        return key[order], order

    def send_lines(self):
        key, order = self.line_order
        places = np.array(self.first, np.int64).reshape(-1, 4)[order]
        for bucket, low, high in bucket_runs(key):
            yield bucket, [squeeze(self.nodes[order[low:high]]), *(squeeze(places[low:high, c]) for c in (0, 1, 3))], high - low

    def here_first(self, reply: np.ndarray) -> np.ndarray:
        """For each line, whether no other piece has it earlier."""
        out = np.zeros(len(self.lines), bool)
        out[self.line_order[1]] = reply
        return out

    @cached_property
    def entries(self):
        if not self.lines:
            return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64))
        line, full, filed, _ = line_entries(self.lines, self.edits, self.least)
        key = bucket_key(full, self.buckets)
        order = np.lexsort((line, key))
        return line[order], key[order], filed[order], full[order]

    def send_entries(self):
        line, key, filed, _ = self.entries
        for bucket, low, high in bucket_runs(key):
            half = (key[low:high] & LOW).astype("<u4")
            own = self.nodes[line[low:high]]
            yield bucket, [squeeze(np.diff(half, prepend=np.uint32(0))), squeeze(own), np.packbits(filed[low:high]).tobytes()], high - low

    def near(self, met: np.ndarray):
        """node, place, entries that met another line, and text of the lines that have any."""
        line, _, _, full = self.entries
        line, full = line[met], full[met].view(np.int64)
        order = np.argsort(line, kind="stable")
        line, full = line[order], full[order]
        cuts = np.flatnonzero(np.diff(line, prepend=-1))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(line)]):
            k = int(line[low])
            doc, key, _, at = self.first[k]
            yield int(self.nodes[k]), doc, key, at, full[low:high], self.lines[k]

    def cut(self, reply: np.ndarray, losers: list[int] | None):
        """doc_id, key, lines, removed ones, those among them that equal no earlier one, and what stays."""
        first = self.here_first(reply)
        lost = np.isin(self.nodes, np.array(losers or [], np.int64))
        for row, (doc, key, parts, own) in enumerate(zip(self.doc_ids, self.keys, self.parts, self.row_lines)):
            kept, removed, near = [], 0, 0
            for at, (part, k) in enumerate(zip(parts, own)):
                here = k < 0 or (first[k] and self.first[k][2:] == (row, at))
                if here and (k < 0 or not lost[k]):
                    kept.append(part)
                else:
                    removed, near = removed + 1, near + bool(here)
            yield doc, key, sum(k >= 0 for k in own), removed, near, "\n".join(kept)


def meet_lines(rows: list[list[bytes]], counts: list[int]) -> list[bytes]:
    """Which of the places is the first one of its line."""
    node, doc, key, at = (np.concatenate([unsqueeze(r[c], "<i8") for r in rows]) for c in range(4))
    order = np.lexsort((at, key, doc, node))
    first = np.zeros(len(node), bool)
    first[order[np.concatenate(([True], np.diff(node[order]) != 0))]] = True
    ends = np.cumsum(counts)
    return [np.packbits(first[e - n : e]).tobytes() for e, n in zip(ends, counts)]


def meet_entries(rows: list[list[bytes]], counts: list[int]) -> list[bytes]:
    """Which entries meet one of another line, if any of them is filed."""
    half = np.concatenate([np.cumsum(unsqueeze(r[0], "<u4"), dtype=np.uint32) for r in rows])
    node = np.concatenate([unsqueeze(r[1], "<i8") for r in rows])
    filed = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=n) for r, n in zip(rows, counts)]).astype(bool)
    order = np.argsort(half)
    first = np.flatnonzero(np.concatenate(([True], np.diff(half[order]) != 0)))
    differ = np.minimum.reduceat(node[order], first) != np.maximum.reduceat(node[order], first)
    differ &= np.logical_or.reduceat(filed[order], first)
    met = np.empty(len(half), bool)
    met[order] = np.repeat(differ, np.diff(np.append(first, len(half))))
    ends = np.cumsum(counts)
    return [np.packbits(met[e - n : e]).tobytes() for e, n in zip(ends, counts)]


# pairs


def pairs_of(entry: np.ndarray, node: np.ndarray, filed: np.ndarray):
    """Arrays (x, y) of rows that share an entry, x filed there, in steps; rows come in the order of entries."""
    first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(entry)))
    group = np.repeat(np.arange(len(first)), size)
    x = np.flatnonzero(filed)
    many = size[group[x]]
    ends = np.cumsum(many)
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STEP_PAIRS, "right")))
        own, n = x[low:high], many[low:high]
        left = np.repeat(own, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[own]], n)
        keep = node[left] != node[right]
        yield left[keep], right[keep]
        low = high


def pair_task(rows: pa.Table, edits: int) -> pa.RecordBatch:
    """Stars over the lines of this task that are linked."""
    entry, node, filed = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("entry", "node", "filed"))
    order = np.lexsort((node, entry))
    entry, node, filed = entry[order], node[order], filed[order]
    name, first, local = np.unique(node, return_index=True, return_inverse=True)
    texts = Texts(rows.column("text").take(pa.array(order[first])).to_pylist())
    forest = Forest()
    for x, y in pairs_of(entry, local, filed):
        x, y = local[x], local[y]
        code = np.unique(np.minimum(x, y) * len(name) + np.maximum(x, y))
        x, y = code // len(name), code % len(name)
        near = np.abs(texts.lengths[x] - texts.lengths[y]) <= edits
        near[near] = texts.within(x[near], y[near], edits)
        for a, b in zip(name[x[near]].tolist(), name[y[near]].tolist()):
            forest.join(a, b)
    return edge_table(forest.stars())


ENTRY = "key long, node long, filed boolean, gaps binary, last boolean"


def entry_rows(nodes: DataFrame, edits: int, least: int) -> DataFrame:
    """The entries, of lines that met another one, that met."""

    def run(batches):
        for batch in batches:
            texts = Texts(batch.column("text").to_pylist())
            found = line_entries(texts, edits, least, gaps=True)
            met = np.unique(batch.column("met").flatten().to_numpy()).view(np.uint64)
            yield entry_batch(found.at(np.isin(found.key, met)), batch.column("node"), False)
        hand_back()

    return nodes.select("node", "text", "met").mapInArrow(run, ENTRY)


def entry_batch(entries: Entries, node: pa.Array, last: bool) -> pa.RecordBatch:
    gaps = entries.gaps
    width = gaps.shape[1] * 16
    flat = pa.py_buffer(np.ascontiguousarray(gaps).tobytes())
    columns = [
        pa.array(entries.key.view(np.int64)),
        node.take(pa.array(entries.line)),
        pa.array(entries.filed),
        pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(gaps), [None, flat]).cast(pa.binary()),
        pa.array(np.full(len(gaps), last)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["key", "node", "filed", "gaps", "last"])


def part_entries(rows: DataFrame) -> DataFrame:
    """The entries parted further; those that cannot be come back as they are, marked as the last ones."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                texts = Texts(batch.column("text").to_pylist())
                gaps = np.frombuffer(b"".join(batch.column("gaps").to_pylist()), np.int32).reshape(batch.num_rows, -1, 4)
                filed = batch.column("filed").to_numpy(zero_copy_only=False)
                own = Entries(np.arange(batch.num_rows), batch.column("key").to_numpy().view(np.uint64), filed, gaps)
                new, last = parted(texts, own)
                yield entry_batch(new, batch.column("node"), False)
                yield entry_batch(own.at(np.flatnonzero(last)), batch.column("node"), True)
        hand_back()

    return rows.select("key", "node", "filed", "gaps", "text").mapInArrow(run, ENTRY)


def pair_rows(nodes: DataFrame, edits: int, least: int, entry_pairs: int, block: int) -> tuple[DataFrame, int]:
    """entry, node and filed of all that is to be paired: each filed row with all of its entry; and how many pairs."""
    current = stored(entry_rows(nodes, edits, least), "entries")
    done, total = [], 0
    while True:
        size = current.groupBy("key").agg(F.sum(F.col("filed").cast("long")).alias("f"), F.count("*").alias("n"), F.max("last").alias("end"))
        size = stored(size.where("f >= 1 and n >= 2").withColumn("large", F.expr(f"f * n > {entry_pairs} or n > {ENTRY_ROWS}")), "entry_sizes")
        pairs, large = size.agg(F.sum(F.when(~F.col("large") | F.col("end"), F.col("f") * F.col("n"))), F.count(F.when(F.col("large"), 1))).first()
        total += pairs or 0
        sized = current.join(size, "key")
        done.append(sized.where("not large").select(F.col("key").alias("entry"), "node", "filed"))
        if not large:
            break
        blocks = sized.where("large and end").withColumns({
            "x": F.expr(f"pmod(xxhash64(node, 1), ceil(f / {block}))"), "y": F.expr(f"pmod(xxhash64(node, 2), ceil(n / {block}))"),
        })
        left = blocks.where("filed").select("key", "x", F.expr(f"explode(sequence(0, ceil(n / {block}) - 1))").alias("y"), "node", F.lit(True).alias("filed"))
        right = blocks.select("key", F.expr(f"explode(sequence(0, ceil(f / {block}) - 1))").alias("x"), "y", "node", F.lit(False).alias("filed"))
        done.append(left.unionByName(right).select(F.xxhash64("key", "x", "y").alias("entry"), "node", "filed"))
        open_ = sized.where("large and not end").select("key", "node", "filed", "gaps")
        current = stored(part_entries(open_.join(nodes.select("node", "text"), "node")), "entries")
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    return rows, total


def line_links(nodes: DataFrame, edits: int, least: int, entry_pairs: int = ENTRY_PAIRS, block: int = BLOCK) -> DataFrame:
    """Edges between lines of a stored table of node, text and met that have the components of all links."""
    rows, pairs = pair_rows(nodes, edits, least, entry_pairs, block)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))

    def link(group: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([pair_task(group, edits)])
        hand_back()
        return out

    rows = rows.join(nodes.select("node", "text"), "node").withColumn("task", F.pmod(F.xxhash64("entry"), F.lit(tasks)))
    # a task is more work than its bytes say, so that the number of partitions is given
    return rows.repartition(tasks, "task").groupBy("task").applyInArrow(link, EDGES)


NEAR = "piece string, node long, id long, key long, line long, met array<bigint>, text string"
CUT = "doc_id long, key long, n_lines long, n_removed long, n_near long, kept string"


def cut_lines(
    docs: DataFrame, edits: int = EDITS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text",
    bucket_entries: int = BUCKET_ENTRIES, entry_pairs: int = ENTRY_PAIRS, block: int = BLOCK,
) -> DataFrame:
    """doc_id, key (of the row), n_lines, n_removed, n_near and kept, the text without the lines that go.

    n_lines counts the lines that are not blank; n_near those of the removed ones that equal no earlier line.
    """
    if not 0 <= edits <= 31 or least <= 2 * edits:
        raise ValueError("edits is 0 to 31, and least is more than twice as many")
    _, total = text_partitions(docs, 1 << 30, text)
    buckets = max(1, -(-total // 32 // bucket_entries))
    rounds = Rounds(text_pieces(docs, doc_id, text), lambda row: Lines(row, buckets, edits, least), ("bits", "bits"))
    rounds.round("send_lines", meet_lines, given=())
    rounds.round("send_entries", meet_entries, given=())

    def near_lines(name, piece, replies):
        return ((name, *line) for line in piece.near(*replies))

    near = stored(rounds.each(near_lines, NEAR, named=True, given=(1,)), "near_lines")
    place = F.struct("id", "key", "line", "piece")
    nodes = near.groupBy("node").agg(F.first("text").alias("text"), F.first("met").alias("met"), F.min(place).alias("place"))
    nodes = stored(nodes, "line_nodes")
    links = stored(line_links(nodes, edits, least, entry_pairs, block), "links")
    linked = stored(components(links).join(nodes.select("node", "place"), "node"), "linked")
    first = linked.groupBy("component").agg(F.min("place").alias("first"))
    losers = linked.join(first, "component").where("place != first").select("node")
    marks = near.select("piece", "node").join(losers, "node").groupBy("piece").agg(F.collect_list("node").alias("more"))
    return rounds.each(lambda piece, replies: piece.cut(*replies), CUT, given=(0,), more=stored(marks, "marks"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines removed from its texts; every row stays, and a null text stays null."""
    names = fresh(docs, "line_key", "line_copy", "line_kept", "line_null")
    copies = Window.partitionBy(names[0]).orderBy(F.lit(1))
    cut = cut_lines(docs, doc_id=doc_id, text=text, **options).select(F.col("key").alias(names[0]), F.col("kept").alias(names[2]))
    cut = cut.withColumn(names[1], F.row_number().over(copies))
    rest = docs.withColumns({names[0]: row_key(doc_id, text), names[3]: F.col(text).isNull()}).drop(text)
    out = rest.withColumn(names[1], F.row_number().over(copies)).join(cut, names[:2])
    return out.withColumn(text, F.when(~F.col(names[3]), F.col(names[2]))).select(*own_columns(docs))


@query("op6_line_dedup")
def op6_line_dedup(spark, sf):
    out = cut_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept", 256).alias("kept_sha256"))
