"""Token counts for a sentencepiece BPE vocabulary, by rank-synchronous merging of arrays.

No piece of the vocabulary has a blank after another character, so no merge crosses such a place, and a text
falls into pre-tokens that can be merged one by one: a word with the blanks before it. The pre-tokens that a
batch of texts has for the first time are laid side by side in one ragged array of symbols. In each step every
pre-token looks for the lowest rank among its pairs of neighbours and joins all pairs of that rank, from left to
right, until no pair is left; then the symbols are counted. Characters that the vocabulary does not have count
one token for each of their bytes.

Joining all pairs of a rank at once is what joining them one after another gives, unless a join makes a pair of
a lower or the same rank. Then, and for pre-tokens of more than ``LONGEST`` characters that no impossible pair of
characters cuts, the pairs are joined one by one.

A null or empty text has no tokens and no bytes. Texts are taken whole, one row at a time; repeated rows get
equal results, an empty table an empty one, and other columns are not read. The file of the vocabulary must be
readable under the same path on every executor, as any installed package is.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import map_pieces, query, table

# Fixed value: what stands for a blank in pieces.
BLANK = "▁"
PRE_TOKENS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NEVER = np.int64(1) << 40
# Characters of a pre-token that is merged in arrays, symbols that are merged at a time, and pre-tokens whose
# counts a Python worker keeps twice over: of two such generations, the older one is forgotten.
LONGEST = 256
SYMBOLS = 400_000
KEPT_WORDS = 300_000
# Pre-tokens above this length are not worth keeping.
KEPT_LENGTH = 64


class PieceBpe:
    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = library
        size = library.get_piece_size()
        if any(map(library.is_unused, range(size))):
            raise ValueError("pieces that must be taken apart again are not supported")
        own = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        names = [library.id_to_piece(i) for i in own]
        if any(re.search(f"[^{BLANK}]{BLANK}", name) for name in names):
            raise ValueError("a piece has a blank after another character")
        if library.normalize("a") != BLANK + "a":
            raise ValueError("texts must get a blank before their first word")
        self.bytes_fall_back = any(map(library.is_byte, range(size)))
        # symbols: the pieces, then characters that only parts of pieces have, then unknown ones by their bytes
        self.symbol = {name: k for k, name in enumerate(names)}
        for name in names:
            for char in name:
                self.symbol.setdefault(char, len(self.symbol))
        self.unknown = len(self.symbol)
        self.cost = np.ones(self.unknown + 5, np.int64)
        if self.bytes_fall_back:
            for char, k in self.symbol.items():
                if k >= len(names):
                    self.cost[k] = len(char.encode())
            self.cost[self.unknown :] = np.arange(5)
        order = {score: rank for rank, score in enumerate(sorted({library.get_score(i) for i in own}, reverse=True))}
        rank_of = {name: order[library.get_score(i)] for i, name in zip(own, names)}
        pairs = {}
        for name in names:
            for cut in range(1, len(name)):
                a, b = self.symbol.get(name[:cut]), self.symbol.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * self.unknown + b] = (rank_of[name], self.symbol[name])
        self.pairs = pairs
        self.codes = np.array(sorted(pairs), np.int64)
        self.ranks, self.joined = np.array([pairs[c] for c in self.codes.tolist()], np.int64).reshape(-1, 2).T.copy()
        chars = [(ord(char), k) for char, k in self.symbol.items() if len(char) == 1]
        self.of_char = np.full(max(c for c, _ in chars) + 2, -1, np.int64)
        for c, k in chars:
            self.of_char[c] = k
        together = {ord(a) << 32 | ord(b) for name in names for a, b in zip(name, name[1:])}
        self.together = np.array(sorted(together), np.int64)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    # one by one

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """The symbol of each character."""
        found = self.of_char[np.minimum(points, len(self.of_char) - 1)]
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        return np.where(found >= 0, found, self.unknown + size)

    def count_one(self, symbols: list[int]) -> int:
        """Join the pair of the lowest rank, the leftmost one among equals, until there is none."""
        n, base = len(symbols), self.unknown
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(at):
            if at >= 0 and after[at] < n:
                a, b = symbols[at], symbols[after[at]]
                if a < base and b < base and (rule := self.pairs.get(a * base + b)):
                    heap.append((rule[0], at, a, b, rule[1])) if at < building else heapq.heappush(heap, (rule[0], at, a, b, rule[1]))

        building = n
        for at in range(n - 1):
            offer(at)
        building = -1
        heapq.heapify(heap)
        while heap:
            _, at, a, b, new = heapq.heappop(heap)
            other = after[at]
            if symbols[at] != a or other >= n or symbols[other] != b:
                continue
            symbols[at], symbols[other] = new, -1
            after[at] = after[other]
            if after[other] < n:
                before[after[other]] = at
            offer(before[at])
            offer(at)
        return int(self.cost[[s for s in symbols if s >= 0]].sum())

    # side by side

    def pair_at(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair of two symbols, NEVER if they cannot be joined, and what they give."""
        code = np.where((a < self.unknown) & (b < self.unknown), a * self.unknown + b, -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER), self.joined[at]

    def count_arrays(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each of these sequences, laid end to end; and which must be joined one by one instead."""
        out = np.zeros(len(lengths), np.int64)
        unsafe = np.zeros(len(lengths), bool)
        own = np.repeat(np.arange(len(lengths)), lengths)
        rank, new = np.full(len(own), NEVER), np.zeros(len(own), np.int64)
        rank[:-1], new[:-1] = self.pair_at(symbols[:-1], symbols[1:])
        rank[:-1][own[1:] != own[:-1]] = NEVER
        while len(own):
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sizes = np.diff(np.append(starts, len(own)))
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == NEVER
            if ended.any():
                gone = np.repeat(ended, sizes)
                out += np.bincount(own[gone], self.cost[symbols[gone]], len(out)).astype(np.int64)
                symbols, own, rank, new = (x[~gone] for x in (symbols, own, rank, new))
                sizes, lowest = sizes[~ended], lowest[~ended]
                if not len(own):
                    break
            chosen = rank == np.repeat(lowest, sizes)
            # of pairs that overlap every second one, from the left
            place = np.arange(len(own))
            first = np.maximum.accumulate(np.where(chosen & ~np.concatenate(([False], chosen[:-1])), place, 0))
            at = np.flatnonzero(chosen & ((place - first) % 2 == 0))
            symbols[at] = new[at]
            keep = np.ones(len(own), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, own, rank, new = symbols[keep], own[keep], rank[keep], new[keep]
            touched = np.zeros(len(own), bool)
            touched[moved[at]] = True
            touched[:-1] |= touched[1:]
            at = np.flatnonzero(touched)
            lowest = np.repeat(lowest, sizes)[keep]
            right = np.minimum(at + 1, len(own) - 1)
            rank[at], new[at] = self.pair_at(symbols[at], symbols[right])
            rank[at[(right == at) | (own[right] != own[at])]] = NEVER
            unsafe[own[at[rank[at] <= lowest[at]]]] = True
        return out, unsafe

    def cut(self, points: np.ndarray) -> np.ndarray:
        """Where the parts of a long pre-token start: between characters that no piece has side by side."""
        pair = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.together, pair), len(self.together) - 1)
        return np.concatenate(([0], np.flatnonzero(self.together[at] != pair) + 1))

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out = np.zeros(len(words), np.int64)
        low = 0
        while low < len(order):
            high, total = low, 0
            while high < len(order) and (high == low or total + len(words[order[high]]) <= SYMBOLS):
                total += len(words[order[high]])
                high += 1
            out[order[low:high]] = self.count_batch([words[k] for k in order[low:high]])
            low = high
        return out.tolist()

    def count_batch(self, words: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        word = np.arange(len(words))
        long_ones = np.flatnonzero(lengths > LONGEST)
        if len(long_ones):
            cuts = {k: self.cut(points[starts[k] : starts[k] + lengths[k]]) for k in long_ones.tolist()}
            parts = [cuts.get(k, (0,)) for k in range(len(words))]
            word = np.repeat(word, [len(p) for p in parts])
            starts = starts[word] + np.concatenate([np.asarray(p, np.int64) for p in parts])
            lengths = np.diff(np.append(starts, len(points)))
        symbols = self.symbols(points)
        one_by_one = lengths > LONGEST
        counts = np.zeros(len(lengths), np.int64)
        short = np.flatnonzero(~one_by_one)
        counts[short], unsafe = self.count_arrays(symbols[np.repeat(~one_by_one, lengths)], lengths[short])
        one_by_one[short[unsafe]] = True
        for k in np.flatnonzero(one_by_one).tolist():
            counts[k] = self.count_one(symbols[starts[k] : starts[k] + lengths[k]].tolist())
        return np.bincount(word, counts, len(words)).astype(np.int64)

    # texts

    def words(self, text: str | None) -> list[str]:
        """The pre-tokens of a text, those with one blank without it; a blank alone is the empty string."""
        normal = self.library.normalize(text) if text else ""
        if BLANK + BLANK not in normal:
            return normal.split(BLANK)[1:]
        return [w[1:] if w[:2] != BLANK + BLANK else w for w in PRE_TOKENS.findall(normal)]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        parted = list(map(self.words, texts))
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for word in set().union(*parted).difference(young):
            if word in old:
                young[word] = old[word]
            else:
                missing.append(word)
        full = [word if word[:1] == BLANK else BLANK + word for word in missing]
        young.update(zip(missing, self.count_words(full)))
        out = [sum(map(young.__getitem__, words)) for words in parted]
        for word in missing:
            if len(word) > KEPT_LENGTH:
                del young[word]
        return out


@lru_cache(maxsize=1)
def piece_bpe(path: str) -> PieceBpe:
    """The vocabulary and the counts kept, for the time of a task."""
    return PieceBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, and over_limit: has a text more than ``limit`` tokens?"""
    path = path or default_path()
    kind = dict(docs.dtypes)[doc_id]

    def count(part):
        texts = part.column("text").to_pylist()
        tokens = piece_bpe(path).count(texts)
        return {
            "doc_id": part.column("doc_id"),
            "n_bytes": part.column("n_bytes"),
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return map_pieces(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", piece_bpe.cache_clear)


@query("op12_token_counts")
def op12_token_counts(spark, sf):
    return token_counts(table(spark, sf, "documents"))
