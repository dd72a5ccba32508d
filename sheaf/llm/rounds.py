"""Rounds in which pieces of text send columns to buckets and get an answer for each entry.

Documents are gathered into pieces of some megabytes, written once under a name of their own. In a round each
piece sends, for every bucket of a hash space, its entries for that bucket as a few compressed columns; one
shuffle brings a bucket's entries together, and the answers go back to the pieces with a join on their names.
Thus a corpus-wide count or comparison of many small things moves a few bytes for each, in few rows.

A piece may send itself a note, to bucket ``OWN``: what it worked out in a round and needs in later ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import hand_back, map_pieces, pa_schema, row_key, stored

NO_ID = (1 << 63) - 1
LOW = np.uint64(0xFFFFFFFF)
# The bucket of a note.
OWN = -1

# Made once in a process: a context takes longer to make than a short column to compress.
compressor = lru_cache(lambda level: zstandard.ZstdCompressor(level=level))
decompressor = lru_cache(lambda: zstandard.ZstdDecompressor())


def squeeze(values: np.ndarray) -> bytes:
    """Compressed byte by byte: all first bytes, then all second ones."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return compressor(1).compress(planes.tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(decompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1)


def bucket_key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash in the high half, the low half of the hash in the other."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & LOW)


def sort_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of unsigned keys, and the keys in it.

    Keys and places that fit side by side into 64 bits are sorted as one number, in a third of the time.
    """
    width = max(1, (len(key) - 1).bit_length())
    if len(key) and int(key.max()).bit_length() + width <= 64:
        both = key.astype(np.uint64) << np.uint64(width) | np.arange(len(key), dtype=np.uint64)
        both.sort()
        return (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def bucket_runs(key: np.ndarray):
    """(bucket, low, high) of each run of sorted keys in one bucket."""
    bucket = (key >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(key)])


PIECES = "piece string, doc_ids array<bigint>, keys array<bigint>, lengths array<bigint>, texts binary"
SENT = "bucket int, piece string, n int, data array<binary>"
REPLY = "piece string, bucket int, n int, reply binary"


def text_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows gathered into pieces, written once; a piece keeps its name from then on."""

    def gather(part):
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        return {
            "piece": [uuid.uuid4().hex],
            "doc_ids": [part.column("doc_id").to_pylist()],
            "keys": [part.column("key").to_pylist()],
            "lengths": [[len(t) for t in texts]],
            "texts": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))],
        }

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return stored(map_pieces(rows, gather, PIECES), "pieces")


def piece_texts(row: dict) -> list[bytes]:
    data = decompressor().decompress(row["texts"])
    ends = np.cumsum(row["lengths"]).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def read_replies(cells: list[dict] | None, kind: str):
    """A round's replies to a piece, in the order in which it sent; of a kind "note and ..", (note or None, replies)."""
    if kind.startswith("note and "):
        note = next((c["reply"] for c in cells or [] if c["bucket"] < 0), None)
        return note, read_replies([c for c in cells or [] if c["bucket"] >= 0], kind.removeprefix("note and "))
    parts = [np.empty(0, bool if kind == "bits" else kind)]
    for cell in sorted(cells or [], key=lambda c: c["bucket"]):
        if kind == "bits":
            parts.append(np.unpackbits(np.frombuffer(cell["reply"], np.uint8), count=cell["n"]).astype(bool))
        else:
            parts.append(unsqueeze(cell["reply"], kind))
    return np.concatenate(parts)


class Rounds:
    """``piece`` makes what does the work from a row of ``pieces``; ``kinds``: what each round's replies are."""

    def __init__(self, pieces: DataFrame, piece: Callable[[dict], object], kinds: tuple[str, ...]):
        self.pieces, self.piece, self.kinds = pieces, piece, kinds
        self.replies: list[DataFrame] = []

    def known(self, given: tuple[int, ...]) -> DataFrame:
        """The pieces with the replies of these rounds; joined in one way, however few replies there are."""
        out = self.pieces
        for k in given:
            reply = self.replies[k]
            lists = reply.groupBy("piece").agg(F.collect_list(F.struct("bucket", "n", "reply")).alias(f"reply{k}"))
            out = out.join(lists.hint("merge"), "piece", "left")
        return out

    def each(self, fn, schema: str, named: bool = False, given: tuple[int, ...] | None = None, more: DataFrame | None = None) -> DataFrame:
        """fn(piece, replies), with its name before them if ``named``, gives rows as tuples.

        ``given`` are the rounds whose replies it wants, all so far by default; ``more``, with the columns
        piece and more, adds what it has for a piece, or None, to them.
        """
        types = pa_schema(self.pieces.sparkSession, schema)
        given = tuple(range(len(self.replies))) if given is None else given
        make, kinds = self.piece, [(k, self.kinds[k]) for k in given]

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    replies = [read_replies(row[f"reply{i}"], kind) for i, kind in kinds]
                    replies += [row["more"]] if wants_more else []
                    rows = list(fn(*([row["piece"]] if named else []), make(row), replies))
                    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
                    yield pa.RecordBatch.from_arrays(columns, schema=types)
                    del replies, rows, columns
            hand_back()

        known, wants_more = self.known(given), more is not None
        return (known.join(more.hint("merge"), "piece", "left") if wants_more else known).mapInArrow(run, schema)

    def round(self, send: str, meet: Callable[[list, list], list[bytes]], given: tuple[int, ...] | None = None) -> None:
        """Shuffle what pieces send by bucket, let it meet there, and write the replies.

        ``send`` names a method of the piece that takes the replies so far and gives (bucket, columns,
        entries), or (OWN, [note], 0); ``meet`` takes the columns and numbers of entries of all pieces and gives their replies.
        """
        types = pa_schema(self.pieces.sparkSession, REPLY)

        def reply(group: pa.Table) -> pa.Table:
            rows = group.to_pydict()
            found = [note for (note,) in rows["data"]] if rows["bucket"][0] < 0 else meet(rows["data"], rows["n"])
            hand_back()
            return pa.table([pa.array(c, f.type) for c, f in zip((rows["piece"], rows["bucket"], rows["n"], found), types)], schema=types)

        def sent(name, piece, replies):
            for bucket, data, n in getattr(piece, send)(*replies):
                # Notes are dealt like buckets; those of two pieces may share one.
                yield bucket if bucket != OWN else -1 - (zlib.crc32(name.encode()) >> 1), name, n, data

        out = self.each(sent, SENT, named=True, given=given).groupBy("bucket").applyInArrow(reply, REPLY)
        self.replies.append(stored(out, "replies"))
