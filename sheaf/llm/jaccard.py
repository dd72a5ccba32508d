"""N-gram Jaccard join of a whole corpus with itself, by signature trees.

A document's set is its distinct shingles of five words. Two documents link if their sets' Jaccard
similarity is 0.8 or more; the result is the connected component of every document. No link is lost:

1. How many sets have each shingle is counted over the whole corpus. A document with more than a fifth of
   its shingles to itself links with none. Equal sets are one node from here on.
2. Shingles are ordered from rare to common. Two linked sets share one of the first |set| - ceil(0.8 |set|)
   + 1 of each, so sets are hung on the smallest node that shares such a shingle. The components of these
   candidates are families; whatever links lies inside a family.
3. In a family, sets hang in signature trees. A node of the tree has the OR and the AND of the token bitmaps
   of its sets and the range of their sizes. A traversal of two trees at once leaves out pairs of nodes
   whose largest possible overlap is too small, and documents that are connected already; what is left is
   compared set by set. A large family is cut into blocks by size, the tree over its blocks is traversed
   first, and each pair of blocks that remains is a task of its own.

Lower-cased A-Z, words between ASCII blanks; with fewer words than five, the whole sequence is the one
shingle. A null text, or one without words, has an empty set and links with nothing. A row whose doc_id is
null has the smallest doc_id of the others in its component, or null; repeated rows and rows that share a
doc_id are separate rows that may link. An empty table gives an empty result, and other columns are not read.
Sets are sets of 64-bit hashes.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, hand_back, own_columns, pa_schema, query, row_key, stored, table, text_partitions
from sheaf.llm.components import EDGES, Forest, components, edge_table
from sheaf.llm.hashing import mix, pack_words, prefix, span_hashes
from sheaf.llm.rounds import LOW, NO_ID, Rounds, bucket_key, bucket_runs, piece_texts, squeeze, text_pieces, unsqueeze

SHINGLE = 5
# Links at 100 * intersection >= PERCENT * union.
PERCENT = 80
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# Shingles to a bucket when they are counted; sets to a block of a family, and to a task of small families.
BUCKET_SHINGLES = 2_000_000
BLOCK = 2_000
LEAF, FAN = 32, 8
BITS = 4_096


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    words = pack_words([t.translate(LOWER).split() for t in texts])
    counts = words.counts()
    out = [np.empty(0, np.uint64)] * len(texts)
    if not len(words.starts):
        return out
    sums = prefix(words.buffer)
    at = words.windows(size)
    hashes = span_hashes(sums, words.starts[at], words.ends[at + size - 1])
    cuts = np.searchsorted(words.text[at], np.arange(len(texts) + 1))
    for k, n in enumerate(counts.tolist()):
        if n >= size:
            out[k] = np.unique(hashes[cuts[k] : cuts[k + 1]])
        elif n:
            first = words.first[k]
            out[k] = span_hashes(sums, words.starts[[first]], words.ends[[first + n - 1]])
    return out


def set_number(hashes: np.ndarray) -> int:
    """A number for a set; equal sets have the same."""
    total = mix(mix(hashes).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))
    return int(total.view(np.int64)[0])


class Sets:
    """The sets of a piece; equal ones once."""

    def __init__(self, row: dict, buckets: int, percent: int):
        self.buckets, self.percent = buckets, percent
        self.doc_ids, self.keys = row["doc_ids"], row["keys"]
        number: dict[bytes, int] = {}
        of_text = [number.setdefault(t, len(number)) for t in piece_texts(row)]
        sets = shingle_sets(list(number))
        nodes = [set_number(s) if len(s) else None for s in sets]
        distinct: dict[int, int] = {}
        self.sets: list[np.ndarray] = []
        self.nodes: list[int] = []
        for node, own in zip(nodes, sets):
            if node is not None and node not in distinct:
                distinct[node] = len(self.sets)
                self.sets.append(own)
                self.nodes.append(node)
        self.row_set = [None if nodes[t] is None else distinct[nodes[t]] for t in of_text]

    @cached_property
    def entries(self):
        """All shingles' keys in order, and for each place in that order, set by set, where it came from."""
        flat = np.concatenate([np.empty(0, np.uint64), *self.sets])
        key = bucket_key(flat, self.buckets)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.empty(0, np.int64)
        return flat, key[order], order, first

    def send_shingles(self):
        _, key, _, first = self.entries
        times = np.diff(np.append(first, len(key))).astype("<u4")
        key = key[first]
        for bucket, low, high in bucket_runs(key):
            half = (key[low:high] & LOW).astype("<u4")
            yield bucket, [squeeze(np.diff(half, prepend=np.uint32(0))), squeeze(times[low:high])], high - low

    def candidates(self, times: np.ndarray):
        """For each set that may link: its number here, and its shingles from rare to common that may be shared."""
        flat, key, order, first = self.entries
        count = np.empty(len(flat), np.int64)
        count[order] = np.repeat(times, np.diff(np.append(first, len(key))))
        ends = np.cumsum([len(s) for s in self.sets])
        for k, end in enumerate(ends.tolist()):
            n = len(self.sets[k])
            shared = count[end - n : end]
            if 100 * np.count_nonzero(shared > 1) < self.percent * n:
                continue
            rare = np.lexsort((self.sets[k], shared))[: n - -(-self.percent * n // 100) + 1]
            rare = rare[shared[rare] > 1]
            if len(rare):
                yield k, self.sets[k][rare]


def meet_shingles(rows: list[list[bytes]], counts: list[int]) -> list[bytes]:
    """How many sets have each shingle."""
    half = np.concatenate([np.cumsum(unsqueeze(r[0], "<u4"), dtype=np.uint32) for r in rows])
    times = np.concatenate([unsqueeze(r[1], "<u4") for r in rows]).astype(np.int64)
    order = np.argsort(half)
    first = np.flatnonzero(np.concatenate(([True], np.diff(half[order]) != 0)))
    total = np.empty(len(half), np.int64)
    total[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.append(first, len(half))))
    total = np.minimum(total, (1 << 32) - 1).astype("<u4")
    ends = np.cumsum(counts)
    return [squeeze(total[e - n : e]) for e, n in zip(ends, counts)]


# signature trees


class Tree:
    """Sets in leaves of LEAF, FAN nodes to a node above. Sorted by size, then by smallest shingle."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], bits: int = BITS):
        order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(sets[k][0]), nodes[k]))
        self.nodes, self.sets = [nodes[k] for k in order], [sets[k] for k in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.marks = bitmaps(self.sets, bits)
        any_, all_, low, high = self.marks, self.marks, self.sizes, self.sizes
        self.levels = []
        width = LEAF
        while True:
            starts = np.arange(0, len(low), width)
            any_, all_ = np.bitwise_or.reduceat(any_, starts), np.bitwise_and.reduceat(all_, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((any_, all_, low, high))
            width = FAN
            if len(low) == 1:
                break


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    marks = np.zeros((len(sets), bits), bool)
    for k, own in enumerate(sets):
        marks[k, (own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, axis=1).view(np.uint64)


def may_link(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """May a set under a node of a link with one under a node of b? For all pairs of rows of (any, all, low, high).

    Tokens of one side whose bit no set of the other has are in no intersection, and every set has at least
    those bits that all sets of its node have. The largest possible overlap o must reach o >= t / (1 + t)
    times the sum of the sizes.
    """
    any_a, all_a, low_a, high_a = a
    any_b, all_b, low_b, high_b = b
    lost_a = np.bitwise_count(all_a[:, None] & ~any_b[None]).sum(-1, dtype=np.int64)
    lost_b = np.bitwise_count(all_b[None] & ~any_a[:, None]).sum(-1, dtype=np.int64)
    overlap = np.minimum(high_a[:, None] - lost_a, high_b[None] - lost_b)
    return (100 + percent) * overlap >= percent * (low_a[:, None] + low_b[None])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def join_trees(a: Tree, b: Tree, forest: Forest, percent: int) -> None:
    """Join in the forest whatever links between the two trees, or inside the one if they are the same."""
    same = a is b
    # the traversal goes down both sides at once; the lower tree waits at its root
    pairs = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while pairs:
        up, i, vp, j = pairs.pop()
        if up == 0 and vp == 0:
            join_leaves(a, i, b, j, forest, percent, same)
            continue
        down_a, down_b = up >= vp, vp >= up
        ii = np.arange(i * FAN, min((i + 1) * FAN, len(a.levels[up - 1][2]))) if down_a else np.array([i])
        jj = np.arange(j * FAN, min((j + 1) * FAN, len(b.levels[vp - 1][2]))) if down_b else np.array([j])
        up, vp = up - down_a, vp - down_b
        open_ = may_link(tuple(x[ii] for x in a.levels[up]), tuple(x[jj] for x in b.levels[vp]), percent)
        for m, n in zip(*np.nonzero(open_)):
            if not same or ii[m] <= jj[n]:
                pairs.append((up, int(ii[m]), vp, int(jj[n])))


def join_leaves(a: Tree, i: int, b: Tree, j: int, forest: Forest, percent: int, same: bool) -> None:
    ii, jj = range(i * LEAF, min((i + 1) * LEAF, len(a.sets))), range(j * LEAF, min((j + 1) * LEAF, len(b.sets)))
    roots_a, roots_b = [forest.root(a.nodes[k]) for k in ii], [forest.root(b.nodes[k]) for k in jj]
    if len({*roots_a, *roots_b}) == 1:
        return
    side = lambda t, r: (t.marks[r.start : r.stop], t.marks[r.start : r.stop], t.sizes[r.start : r.stop], t.sizes[r.start : r.stop])
    for m, n in zip(*np.nonzero(may_link(side(a, ii), side(b, jj), percent))):
        x, y = ii[m], jj[n]
        if same and x >= y:
            continue
        if forest.root(a.nodes[x]) != forest.root(b.nodes[y]) and linked(a.sets[x], b.sets[y], percent):
            forest.join(a.nodes[x], b.nodes[y])


def read_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def link_task(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Families, or one pair of a family's blocks (side 0 and 1; a block with itself has side 0 only)."""
    family = rows.column("family").to_numpy()
    side = rows.column("side").to_numpy()
    nodes = rows.column("node").to_numpy()
    sets = rows.column("shingles")
    forest = Forest()
    order = np.lexsort((nodes, side, family))
    cuts = np.flatnonzero(np.diff(family[order], prepend=family[order[0]] - 1)) if len(order) else []
    for low, high in zip(cuts, [*cuts[1:], len(order)]):
        trees = []
        for s in (0, 1):
            mine = order[low:high][side[order[low:high]] == s]
            if len(mine):
                trees.append(Tree(nodes[mine].tolist(), [read_set(sets[int(k)].as_py()) for k in mine]))
        join_trees(trees[0], trees[-1], forest, percent)
    return edge_table(forest.stars())


BLOCKS = "family long, block long, marks_any binary, marks_all binary, low long, high long"


def block_summary(rows: pa.Table) -> dict:
    sets = [read_set(s) for s in rows.column("shingles").to_pylist()]
    marks, sizes = bitmaps(sets, BITS), [len(s) for s in sets]
    return {
        "family": [rows.column("family")[0].as_py()],
        "block": [rows.column("block")[0].as_py()],
        "marks_any": [np.bitwise_or.reduce(marks).tobytes()],
        "marks_all": [np.bitwise_and.reduce(marks).tobytes()],
        "low": [min(sizes)],
        "high": [max(sizes)],
    }


def block_pairs(rows: pa.Table, percent: int) -> dict:
    """Pairs of a family's blocks that may have links between them; each block with itself, too."""
    read = lambda c: np.stack([np.frombuffer(m, np.uint64) for m in rows.column(c).to_pylist()])
    block = rows.column("block").to_numpy()
    side = read("marks_any"), read("marks_all"), rows.column("low").to_numpy(), rows.column("high").to_numpy()
    out: dict[str, list] = {"family": [], "x": [], "y": []}
    for k in range(len(block)):
        open_ = may_link(tuple(c[k : k + 1] for c in side), side, percent)[0]
        for other in block[open_ & (block >= block[k])].tolist():
            out["family"].append(rows.column("family")[0].as_py())
            out["x"].append(int(block[k]))
            out["y"].append(other)
    return out


def table_of(types: pa.Schema, columns: dict) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in types], schema=types)


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Sets that share one of their rare shingles, as edges to the smallest of them met so far.

    A shingle's sets are met in each partition first, so that a partition sends one row for a shingle.
    """

    def meet(batches, local: bool):
        forest = Forest()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        least = (np.empty(0, np.int64),) * 2
        for batch in batches:
            if local:
                lists = batch.column(1)
                shingle = lists.flatten().to_numpy()
                node = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            else:
                shingle, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kept.append((shingle, node))
            if sum(len(s) for s, _ in kept) > 2_000_000 or len(kept) > 200:
                least = merge([least, *kept], forest)
                kept = []
        least = merge([least, *kept], forest)
        a, b = forest.stars()
        n = len(least[0]) if local else 0
        columns = [np.concatenate((np.full(len(a), None, object), least[0][:n])), [*a, *least[1][:n].tolist()], [*b, *[None] * n]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "a", "b"])
        del forest, least, columns, a, b
        hand_back()

    def merge(parts, forest):
        shingle, node = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((node, shingle))
        shingle, node = shingle[order], node[order]
        new = np.concatenate(([True], shingle[1:] != shingle[:-1])) if len(shingle) else np.empty(0, bool)
        first = np.flatnonzero(new)
        root = np.repeat(node[first], np.diff(np.append(first, len(node))))
        far = root != node
        for x, y in np.unique(np.stack((root[far], node[far]), 1), axis=0).tolist():
            forest.join(x, y)
        return shingle[first], node[first]

    schema = "shingle long, a long, b long"
    near = stored(sets.select("node", "rare").mapInArrow(lambda b: meet(b, True), schema), "near")
    far = near.where("b is null").select("shingle", "a").repartition("shingle").mapInArrow(lambda b: meet(b, False), schema)
    return near.where("b is not null").select("a", "b").union(far.select("a", "b"))


def family_tasks(members: DataFrame, percent: int, block: int) -> DataFrame:
    """task, family, side, node, shingles: small families share tasks, large ones have a task for a pair of blocks."""
    spark = members.sparkSession
    sizes = stored(members.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    total, largest = sizes.agg(F.sum(F.when(F.col("n") <= block, F.col("n"))), F.max("n")).first()
    tasks = max(1, -(-(total or 0) // block))
    rows = members.join(sizes, "family")
    small = rows.where(F.col("n") <= block).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(tasks))).alias("task"), "family", F.lit(0).alias("side"), "node", "shingles"
    )
    if (largest or 0) <= block:
        return small
    by_size = Window.partitionBy("family").orderBy("size", "least", "node")
    large = rows.where(F.col("n") > block).withColumn("block", F.floor((F.row_number().over(by_size) - 1) / block))
    large = stored(large.select("family", "block", "node", "shingles"), "blocks")
    summary_types, pair_types = pa_schema(spark, BLOCKS), pa_schema(spark, "family long, x long, y long")
    summaries = large.groupBy("family", "block").applyInArrow(lambda t: table_of(summary_types, block_summary(t)), BLOCKS)
    pairs = summaries.groupBy("family").applyInArrow(lambda t: table_of(pair_types, block_pairs(t, percent)), "family long, x long, y long")
    pairs = stored(pairs, "pairs")
    sides = pairs.select("family", "x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).union(
        pairs.where("x < y").select("family", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side"))
    )
    paired = large.join(sides, ["family", "block"]).select(
        F.concat_ws(":", F.lit("l"), "family", "x", "y").alias("task"), "family", "side", "node", "shingles"
    )
    return small.union(paired)


SETS = "doc_id long, key long, n_shingles long, node long, rare array<bigint>, shingles binary"


def jaccard_groups(
    docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    bucket_shingles: int = BUCKET_SHINGLES, block: int = BLOCK,
) -> DataFrame:
    """doc_id, key (of the row), n_shingles, node (of its set) and component, the smallest node it is linked to."""
    spark = docs.sparkSession
    _, total = text_partitions(docs, 1 << 30, text)
    buckets = max(1, -(-total // 6 // bucket_shingles))
    rounds = Rounds(text_pieces(docs, doc_id, text), lambda row: Sets(row, buckets, percent), ("<u4",))
    rounds.round("send_shingles", meet_shingles)

    def emit(piece, replies):
        able = {k: rare for k, rare in piece.candidates(*replies)}
        told = set()
        for doc, key, k in zip(piece.doc_ids, piece.keys, piece.row_set):
            if k is None:
                yield doc, key, 0, None, None, None
            elif k in able and k not in told:
                told.add(k)
                yield doc, key, len(piece.sets[k]), piece.nodes[k], able[k].view(np.int64), piece.sets[k].astype("<u8").tobytes()
            else:
                yield doc, key, len(piece.sets[k]), piece.nodes[k], None, None

    rows = stored(rounds.each(emit, SETS), "sets")
    sets = rows.where("rare is not null")
    family = components(candidate_edges(sets)).withColumnRenamed("component", "family")
    one = sets.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("n_shingles").alias("size"), F.first(F.array_min("rare")).alias("least"))
    members = stored(one.join(family, "node"), "members")

    def link(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([link_task(group, percent)])

    links = stored(family_tasks(members, percent, block).groupBy("task").applyInArrow(link, EDGES), "links")
    labels = stored(components(links), "labels")
    return rows.select("doc_id", "key", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "key", "n_shingles", "node", F.coalesce("component", "node").alias("component")
    )


def named_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, key, n_shingles and component_id, the smallest doc_id of the row's component."""
    groups = stored(jaccard_groups(docs, **options), "groups")
    least = stored(groups.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return groups.join(least, "component", "left").select(
        "doc_id", "key", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, nulls last. Rows without words all stay."""
    groups = stored(jaccard_groups(docs, doc_id=doc_id, text=text, **options), "groups")
    first = groups.where("component is not null").groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key")).alias("f"))
    key, own_id, copy, single = fresh(docs, "set_key", "set_id", "set_copy", "set_single")
    last = F.lit(NO_ID)
    keyed = docs.withColumns({key: row_key(doc_id, text), own_id: F.coalesce(F.col(doc_id).cast("long"), last)})
    stay = first.select(F.col("f.key").alias(key), F.col("f.id").alias(own_id), F.lit(True).alias(single)).union(
        groups.where("component is null").select("key", F.coalesce("doc_id", last), F.lit(False)).distinct()
    )
    kept = keyed.join(stay, [key, own_id]).withColumn(copy, F.row_number().over(Window.partitionBy(key, own_id).orderBy(F.lit(1))))
    return kept.where(~F.col(single) | (F.col(copy) == 1)).select(*own_columns(docs))


SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words from documents
), p as (
  select doc_id, words, unnest(range(1, greatest(len(words) - {SHINGLE} + 1, 1) + 1)) as pos from d where len(words) > 0
), s as materialized (
  select distinct doc_id, hash(array_to_string(words[pos:pos + {SHINGLE} - 1], ' ')) as gram from p
), n as materialized (
  select doc_id, count(*) as n from s group by doc_id
), o as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2
), l as materialized (
  select x, y from o join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * shared >= {PERCENT} * (nx.n + ny.n - shared)
  union all
  select y, x from o join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * shared >= {PERCENT} * (nx.n + ny.n - shared)
), r as (
  select x as doc_id, x as near from l union select r.doc_id, l.y from r join l on r.near = l.x
), c as (
  select doc_id, min(near) as component_id from r group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from d left join n on d.doc_id = n.doc_id left join c on d.doc_id = c.doc_id
"""


@query("op3_ngram_jaccard", SQL)
def op3_ngram_jaccard(spark, sf):
    return named_components(table(spark, sf, "documents")).drop("key")
