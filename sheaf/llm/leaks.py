"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, hits verified word by word.

Texts are lower-cased (A-Z) and parted into words of letters, digits and characters beyond ASCII. A window is
ten consecutive words of an item; an item of fewer words, but not none, is one window. A word of a document
inside any occurrence of a window is hit.

A null or empty text has no words. Items without words have no windows; an item_id given twice counts once; a
null item_id counts as an item named by the empty string. Documents are treated row by row, whole, so repeated
rows get equal results; an empty table gives an empty result; only the named columns are read, and
``decontaminate`` keeps all others as they are.

The hash set goes to every task, so the benchmark is taken in blocks of a bounded number of windows. Spark builds
them as arrays, sorted hashes over packed words; the driver and a task hold one block. Beyond one block, the
documents are read once for each: what the blocks but the last find is written, by two hashes of the text, and
joined to the documents before the last step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, map_pieces, map_rows, own_columns, pa_schema, query, stored, table
from sheaf.llm.hashing import covered, pack_words, prefix, runs, scan_words, span_hashes
from sheaf.session import lookup_side

WINDOW = 10
# Windows of the benchmark that one hash set is made of: about 30 bytes each, and 32 MB for a filter before it.
BLOCK_WINDOWS = 4_000_000
# Windows of a part of a long item, and bytes of parts that are hashed at a time.
PART_WINDOWS = 10_000
CHUNK_BYTES = 2_000_000

WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))
WORD = re.compile(b"[" + re.escape(WORD_BYTES) + b"]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Grams(NamedTuple):
    """The windows of one length in one block: entries (window, item) in the order of the windows' hashes."""

    size: int
    hashes: np.ndarray  # uint64
    starts: np.ndarray  # uint32, of the window in data
    owners: np.ndarray  # uint32, the number of the item in names
    data: bytes  # words joined by one space, a line feed after each part
    names: list[str]
    seen: np.ndarray  # by the low bits of a hash: may it be there?


def slots(hashes: np.ndarray, seen: int) -> np.ndarray:
    return hashes & np.uint64(seen - 1)


def part_rows(item: str, text: str | None, window: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(item, size, n_windows, words) of an item's parts, which have each of its windows once."""
    words = words_of(text)
    size = min(window, len(words))
    for at in range(0, len(words) - size + 1 if size else 0, PART_WINDOWS):
        part = words[at : at + PART_WINDOWS + size - 1]
        yield item, size, len(part) - size + 1, b" ".join(part)


def entries(size: int, items: list[str], parts: list[bytes]) -> dict:
    """The columns of an index row, for parts of one size; an item's equal windows are one entry.

    Windows are told apart by 128 bits here; what a document is compared with are the words themselves.
    """
    names = sorted(set(items))
    number = {name: k for k, name in enumerate(names)}
    found, offset, at = [], 0, 0
    while at < len(parts):
        end, room = at + 1, CHUNK_BYTES - len(parts[at])
        while end < len(parts) and len(parts[end]) <= room:
            room -= len(parts[end])
            end += 1
        packed = scan_words(b"".join(p + b"\n" for p in parts[at:end]))
        first = packed.windows(size)
        starts, ends = packed.starts[first], packed.ends[first + size - 1]
        owner = np.array([number[i] for i in items[at:end]], np.uint32)[packed.text[first]]
        both = (span_hashes(prefix(packed.buffer, seed), starts, ends) for seed in (0, 1))
        found.append((*both, owner, (starts + offset).astype(np.uint32)))
        offset += len(packed.data)
        at = end
    hashes, others, owners, starts = (np.concatenate(column) for column in zip(*found))
    order = np.lexsort((owners, others, hashes))
    hashes, others, owners, starts = hashes[order], others[order], owners[order], starts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1]) | (owners[1:] != owners[:-1])
    columns = {"hashes": hashes, "starts": starts, "owners": owners}
    data = b"".join(p + b"\n" for p in parts)
    return {"size": size, "data": data, "names": names} | {c: v[new].tobytes() for c, v in columns.items()}


def grams_of(row: dict) -> Grams:
    hashes = np.frombuffer(row["hashes"], np.uint64)
    seen = np.zeros(1 << min(25, max(16, (64 * len(hashes)).bit_length())), bool)
    seen[slots(hashes, len(seen))] = True
    starts, owners = (np.frombuffer(row[c], np.uint32) for c in ("starts", "owners"))
    return Grams(row["size"], hashes, starts, owners, bytes(row["data"]), list(row["names"]), seen)


PARTS = "item string, size int, n_windows long, words binary"
INDEX = "block int, size int, hashes binary, starts binary, owners binary, data binary, names array<string>"


def index_blocks(
    benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text", block_windows: int = BLOCK_WINDOWS
) -> Iterator[list[Grams]]:
    """The index of the benchmark's windows, block by block of about ``block_windows``, each made in one task.

    A long item is cut into parts, which may lie in different blocks.
    """
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))

    def cut(part):
        made = [r for i, t in zip(part["item"].to_pylist(), part["text"].to_pylist()) for r in part_rows(i, t, window)]
        return dict(zip(("item", "size", "n_windows", "words"), zip(*made))) if made else None

    parts = stored(map_pieces(rows, cut, PARTS), "leak_parts")
    total = parts.agg(F.sum("n_windows")).first()[0] or 0
    blocks = -(-total // block_windows)
    types = pa_schema(benchmark.sparkSession, INDEX)

    def build(group):
        by_size: dict[int, tuple[list, list]] = {}
        for batch in group.to_batches():
            for item, size, words in zip(*(batch.column(c).to_pylist() for c in ("item", "size", "words"))):
                items, texts = by_size.setdefault(size, ([], []))
                items.append(item)
                texts.append(words)
        block = group.column("block")[0].as_py()
        made = [{"block": block} | entries(size, *own) for size, own in sorted(by_size.items())]
        return pa.Table.from_pylist(made, schema=types)

    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int").alias("block")
    index = None
    if blocks:
        index = parts.select("item", "size", "words", block).groupBy("block").applyInArrow(build, INDEX)
        if blocks > 1:
            index = stored(index, "leak_index")
    for k in range(blocks):
        yield [grams_of(row.asDict()) for row in index.where(F.col("block") == k).collect()]


def find(texts: list[str | None], index: list[Grams]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Per text: its number of words, the windows hit as [start, end) rows of word numbers, and the items."""
    packed = pack_words([words_of(t) for t in texts])
    spans: list[list] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    sums = prefix(packed.buffer) if index else None
    for grams in index:
        at = packed.windows(grams.size)
        if not len(at):
            continue
        hashes = span_hashes(sums, packed.starts[at], packed.ends[at + grams.size - 1])
        may = np.flatnonzero(grams.seen[slots(hashes, len(grams.seen))])
        at, hashes = at[may], hashes[may]
        low = np.searchsorted(grams.hashes, hashes, side="left")
        there = low < len(grams.hashes)
        there[there] = grams.hashes[low[there]] == hashes[there]
        at, low = at[there], low[there]
        high = np.searchsorted(grams.hashes, hashes[there], side="right")
        known: dict[tuple[int, bytes], bool] = {}
        for word, k, end in zip(at.tolist(), low.tolist(), high.tolist()):
            own = packed.data[packed.starts[word] : packed.ends[word + grams.size - 1]]
            text = int(packed.text[word])
            if (text, own) not in known:
                same = [e for e in range(k, end) if same_words(grams, e, own)]
                known[text, own] = bool(same)
                items[text].update(grams.names[grams.owners[e]] for e in same)
            if known[text, own]:
                start = word - int(packed.first[text])
                spans[text].append((start, start + grams.size))
    return packed.counts(), [np.array(s, np.int64).reshape(-1, 2) for s in spans], items


def same_words(grams: Grams, entry: int, own: bytes) -> bool:
    start = int(grams.starts[entry])
    end = start + len(own)
    return grams.data[start:end] == own and grams.data[end] in b" \n"


FOUND = "struct<n_words: bigint, hit_from: array<bigint>, hit_to: array<bigint>, items: array<string>>"


def found_in(texts: list[str | None], index: list[Grams], before: list[list[dict] | None]) -> list[dict]:
    """Per text what ``FOUND`` says, joined with what was found in it before."""
    out = []
    for (n, own, names), earlier in zip(zip(*find(texts, index)), before):
        for one in earlier or ():
            own = np.concatenate((own, np.array([one["hit_from"], one["hit_to"]], np.int64).T))
            names = names | set(one["items"])
        start, end = runs(covered(int(n), own[:, 0], own[:, 1])) if len(own) else ((), ())
        out.append({"n_words": int(n), "hit_from": list(map(int, start)), "hit_to": list(map(int, end)), "items": sorted(names)})
    return out


def hits_of(docs: DataFrame, text: str, index: Broadcast, block: int) -> DataFrame:
    """Two hashes of each text that has hits in a block, and what was found."""
    own = F.col("`" + text.replace("`", "``") + "`")
    keyed = docs.select(own.alias("text"), F.xxhash64(own).alias("a"), F.xxhash64(own, F.lit(1)).alias("b"))

    def search(part):
        texts = part["text"].to_pylist()
        found = found_in(texts, index.value, [None] * len(texts))
        hit = [k for k, one in enumerate(found) if one["items"]]
        columns = {c: part[c].take(pa.array(hit, pa.int64())) for c in ("a", "b")}
        return columns | {"found": [found[k] for k in hit]} if hit else None

    return map_pieces(keyed, search, f"a long, b long, found {FOUND}").withColumn("block", F.lit(block))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_windows: int = BLOCK_WINDOWS, name: str = "leak",
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct called ``name``: n_words, hit_from, hit_to, items.

    The spans are runs of hit words, [from, to) in word numbers.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    spark = docs.sparkSession
    index, hits = spark.sparkContext.broadcast([]), []
    for k, grams in enumerate(index_blocks(benchmark, window, item_id, item_text, block_windows)):
        if k:  # the block before this one is not the last
            hits.append(stored(hits_of(docs, text, index, k), "leak_hits"))
        index.destroy()
        index = spark.sparkContext.broadcast(grams)
    out = docs.withColumn(name, F.lit(None).cast(f"array<{FOUND}>"))
    if hits:
        out = with_earlier(docs, text, name, reduce(DataFrame.unionAll, hits))
    at = docs.columns.index(text)
    kind = pa_schema(spark, f"leak {FOUND}").field(0).type

    def search(part, index=index):
        return [*part.columns[:-1], pa.array(found_in(part.column(at).to_pylist(), index.value, part.columns[-1].to_pylist()), kind)]

    return map_rows(out, search, docs.withColumn(name, F.lit(None).cast(FOUND)))


def with_earlier(docs: DataFrame, text: str, name: str, hits: DataFrame) -> DataFrame:
    """``docs`` and what earlier blocks found in a row's text, if anything."""
    once = hits.dropDuplicates(["a", "b", "block"]).groupBy("a", "b").agg(F.collect_list("found").alias("found"))
    a, b, found = fresh(docs, "leak_a", "leak_b", "leak_found")
    own = F.col("`" + text.replace("`", "``") + "`")
    keyed = docs.withColumns({a: F.xxhash64(own), b: F.xxhash64(own, F.lit(1))})
    joined = keyed.join(lookup_side(once.toDF(a, b, found)), [a, b], "left")
    return joined.select(*own_columns(docs), F.col(found).alias(name))


def without_spans(text: str, hit_from: list[int], hit_to: list[int]) -> str:
    """The text without its runs of hit words; what stood around a run stays, with one space in its place."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data.translate(NORMAL))]
    kept, last = [], 0
    for start, end in zip(hit_from, hit_to):
        kept.append(data[last : words[start][0]])
        last = words[end - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are hit, or (``remove="spans"``) without the runs of words hit."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    (name,) = fresh(docs, "leak")
    found = find_leaks(docs, benchmark, text=text, name=name, **options)
    if remove == "documents":
        return found.where(F.size(F.col(name)["items"]) == 0).drop(name)
    at = docs.columns.index(text)

    def cut(part):
        texts = [
            without_spans(t, leak["hit_from"], leak["hit_to"]) if t and leak["hit_from"] else t
            for t, leak in zip(part.column(at).to_pylist(), part.columns[-1].to_pylist())
        ]
        columns = part.columns[:-1]
        columns[at] = pa.array(texts, pa.string())
        return columns

    return map_rows(found, cut, docs)


def leak_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = dict(docs.dtypes)["doc_id"]
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", "leak")

    def digest(part):
        leaks = part.column("leak").to_pylist()
        hit = [sum(leak["hit_to"]) - sum(leak["hit_from"]) for leak in leaks]
        return {
            "doc_id": part.column("doc_id"),
            "n_words": [leak["n_words"] for leak in leaks],
            "n_hit": hit,
            "n_items": [len(leak["items"]) for leak in leaks],
            "items_sha256": [hashlib.sha256(",".join(sorted(leak["items"])).encode()).hexdigest() for leak in leaks],
            "contaminated": [n > 0 for n in hit],
        }

    return map_pieces(found, digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), i as (
  select item, least({WINDOW}, len(words)) as size, words, unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) as pos
  from b where len(words) > 0
), g as (
  select distinct item, size, words[pos:pos + size - 1] as gram from i
), s as (
  select distinct size from g
), p as (
  select doc_id, size, words, unnest(range(1, len(words) - size + 2)) as pos from d, s where len(words) >= size
), w as (
  select doc_id, size, pos, words[pos:pos + size - 1] as gram from p
), h as (
  select doc_id, w.size, pos, item from w join g on w.size = g.size and w.gram = g.gram
), n as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as k from h) group by doc_id
), t as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item from h) group by doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.doc_id = n.doc_id left join t on d.doc_id = t.doc_id
"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark, sf):
    return leak_digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
