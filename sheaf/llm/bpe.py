"""BPE encoding and decoding by speculation and verification, for vocabularies with word ends.

A text is normalised and parted into words, and the ids of a word are kept, so that a repeated word costs
one look-up. For words not seen yet, greedy longest match proposes tokens for all of them in one scan. A proposal is the exact encoding if every token encodes to itself
and no merge rule crosses the border of any two neighbours, which is checked for all distinct neighbours at
once with arrays. Only words that fail are merged rule by rule.

A null or empty text has no tokens and decodes to the empty text. Texts are taken whole, one row at a time;
repeated rows get equal results, an empty table an empty one, and other columns are not read. The files of
the vocabulary must be readable under the same path on every executor, as any installed package is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm.common import map_pieces, query, table

# Words whose ids a Python worker keeps twice over: of two such generations, the older one is forgotten.
KEPT_WORDS = 150_000
# Up to U+024F, Python and the vocabulary's own normaliser know the same letters and blanks but for these
# four; texts that have others once they are lower-cased go through the latter.
FOREIGN = re.compile("[^\x00-\x1b\x20-\u024f]")
# Stands for the end of a word inside this module; a private-use character that byte-level text cannot hold.
END = "\ue000"
NEVER = np.int64(1) << 40
# Longer words are merged one by one, with a heap; shorter ones side by side, in a matrix.
MATRIX_WORD = 32

# The file's own pattern for words, for texts of those characters. All letters and all numbers there.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾"
WORDS = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def cut_bytes(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids as bytes, cut into runs of so many."""
    data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [data[start:end] for start, end in zip([0, *ends[:-1]], ends)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        suffix = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.id_of = {
            (t[: -len(suffix)] + END if t.endswith(suffix) and len(t) > len(suffix) else t): i for t, i in model["vocab"].items()
        }
        self.letters = dict(enumerate(byte_letters()))
        self.symbol = np.full((2, 0x200), -1, np.int64)  # of a letter inside a word, of one at its end
        for letter in self.letters.values():
            self.symbol[:, ord(letter)] = self.id_of[letter], self.id_of[letter + END]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

        size = max(self.tokens) + 1
        self.rank = np.full(size, -1, np.int64)  # when a token comes to be; -1 for single letters
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        plain = {t: i for i, t in self.tokens.items()}
        for at, (a, b) in enumerate(model["merges"]):
            new = plain[a + b]
            if self.rank[new] >= 0 or max(self.rank[plain[a]], self.rank[plain[b]]) >= at:
                raise ValueError("the merge rules do not give each token in one way")
            self.rules[plain[a], plain[b]] = at, new
            self.rank[new], self.left[new], self.right[new] = at, plain[a], plain[b]
        self.pair_codes = np.sort(np.array([a * size + b for a, b in self.rules], np.int64))
        by_code = {a * size + b: at for (a, b), (at, _) in self.rules.items()}
        self.pair_ranks = np.array([by_code[c] for c in self.pair_codes.tolist()], np.int64)
        self.result = np.array([plain[a + b] for a, b in model["merges"]], np.int64)
        self.size = size
        self.stable = np.full(size, -1, np.int8)  # does a token encode to itself? -1: not known yet
        self.scan = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.scan.add_word(token, i << 16 | len(token))
        self.scan.make_automaton()

    # words

    def words(self, text: str) -> list[str]:
        """The words of a text as they are kept: as they are, or with END in the letters that stand for bytes."""
        lowered = unicodedata.normalize("NFC", text).lower()
        if not FOREIGN.search(lowered):
            return WORDS.findall(lowered)
        normal = self.library.normalizer.normalize_str(text)
        return [w + END for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def spelled(self, word: str) -> str:
        """A word in the letters that stand for its bytes, with END."""
        if word[-1] == END:
            return word
        return (word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)) + END

    # exact merging

    def merge(self, word: str) -> list[int]:
        """Apply the rules to one word, lowest rank first and leftmost first among equals."""
        symbols = [self.id_of[c] for c in word[:-2]] + [self.id_of[word[-2:]]] if word.endswith(END) else [self.id_of[c] for c in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(at):
            if at >= 0 and after[at] < n and (rule := self.rules.get((symbols[at], symbols[after[at]]))):
                heapq.heappush(heap, (rule[0], at, rule[1]))

        for at in range(n - 1):
            offer(at)
        while heap:
            rank, at, new = heapq.heappop(heap)
            other = after[at]
            if symbols[at] < 0 or other >= n or self.rules.get((symbols[at], symbols[other])) != (rank, new):
                continue
            symbols[at], symbols[other] = new, -1
            after[at] = after[other]
            if after[other] < n:
                before[after[other]] = at
            offer(before[at])
            offer(at)
        return [s for s in symbols if s >= 0]

    def rule_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the rule that joins a and b, NEVER where there is none."""
        code = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NEVER)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """merge() of many words, as bytes; the short ones go through the rules side by side, a row each."""
        out: list = [None if len(w) <= MATRIX_WORD + 1 else as_bytes(self.merge(w)) for w in words]
        short = sorted((k for k, ids in enumerate(out) if ids is None), key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            for k, ids in zip(part, self.merge_rows([words[k] for k in part])):
                out[k] = ids
        return out

    def merge_rows(self, words: list[str]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(lengths.max())
        letters = np.zeros((n, width), np.int64)
        row = np.repeat(np.arange(n), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters[row, place] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        final = np.zeros_like(letters)
        final[:, :-1] = letters[:, 1:] == ord(END)
        real = (letters != 0) & (letters != ord(END))
        rows = np.where(real, self.symbol[final, np.where(real, letters, 0x21)], -1)
        ranks = np.full((n, width), NEVER)
        ranks[:, :-1] = self.rule_ranks(rows[:, :-1], rows[:, 1:])
        done = np.full_like(rows, -1)
        live, column = np.arange(n), np.arange(width)
        while len(live):
            line = np.arange(len(live))
            first = ranks.argmin(1)  # the leftmost of the lowest
            rank = ranks[line, first]
            ended = rank == NEVER
            if ended.any():
                done[live[ended]] = rows[ended]
                live, rows, ranks, first, rank = (x[~ended] for x in (live, rows, ranks, first, rank))
                line = np.arange(len(live))
                if not len(live):
                    break
            shift = np.minimum(column + (column > first[:, None]), width - 1)
            rows = np.take_along_axis(rows, shift, 1)
            rows[:, -1] = -1
            rows[line, first] = self.result[rank]
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= first[:, None]), width - 1), 1)
            ranks[:, -1] = NEVER
            ranks[line, first] = self.rule_ranks(rows[line, first], rows[line, np.minimum(first + 1, width - 1)])
            inner = first > 0
            i, j = line[inner], first[inner]
            ranks[i, j - 1] = self.rule_ranks(rows[i, j - 1], rows[i, j])
        filled = done >= 0
        return cut_bytes(done[filled], filled.sum(1))

    # verification

    def crossing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For neighbours x, y: does a merge rule join a symbol at the end of x with one at the start of y?

        Such symbols are the tokens down the right edge of x and the left edge of y; each lives from its own
        rank to that of the token it goes into. A rule joins two of them if both live at its rank. At the
        same rank the left one is used up first, the right one is not.
        """
        x, y = x.copy(), y.copy()
        crossed = np.zeros(len(x), bool)
        open_ = np.arange(len(x))
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(open_):
            a, b = x[open_], y[open_]
            rule = self.rule_ranks(a, b)
            joined = (rule < until_x[open_]) & (rule <= until_y[open_])
            crossed[open_[joined]] = True
            ended = joined | ((self.rank[a] < 0) & (self.rank[b] < 0))
            open_, a, b = open_[~ended], a[~ended], b[~ended]
            # go down the side that came to be later
            down_x = self.rank[a] >= self.rank[b]
            i, j = open_[down_x], open_[~down_x]
            until_x[i] = self.rank[x[i]]
            x[i] = self.right[x[i]]
            until_y[j] = self.rank[y[j]]
            y[j] = self.left[y[j]]
        return crossed

    def stands(self, ids: np.ndarray) -> np.ndarray:
        """Does each token encode to itself?"""
        for i in np.unique(ids[self.stable[ids] < 0]).tolist():
            token = self.tokens[i]
            own = next(t for t in (token, token[:-4] + END) if self.id_of.get(t) == i)
            self.stable[i] = self.merge(own) == [i]
        return self.stable[ids] == 1

    def propose(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        ends = np.cumsum([len(w) for w in words])
        last, found = np.fromiter(chain.from_iterable(self.scan.iter_long("".join(words))), np.int64).reshape(-1, 2).T
        ids, length, stop = found >> 16, found & 0xFFFF, last + 1
        # a word is covered if its tokens lie inside it, side by side
        word = np.searchsorted(ends, stop, side="left")
        inside = stop - length >= np.where(word > 0, ends[word - 1], 0)
        covered = np.bincount(word[inside], length[inside], len(words)) == np.diff(ends, prepend=0)
        good = covered & (np.bincount(word[~inside], minlength=len(words)) == 0)
        # of those, each token must be stable and no pair crossed
        good[word[~self.stands(ids)]] = False
        near = np.flatnonzero((word[1:] == word[:-1]) & good[word[1:]])
        pairs, which = np.unique(ids[near] * self.size + ids[near + 1], return_inverse=True)
        bad = self.crossing(pairs // self.size, pairs % self.size)[which]
        good[word[near[bad]]] = False
        out = cut_bytes(ids, np.bincount(word, minlength=len(words)))
        failing = np.flatnonzero(~good).tolist()
        for k, merged in zip(failing, self.merge_all([words[k] for k in failing])):
            out[k] = merged
        return out

    # texts

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all these words, kept for later texts."""
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        known = {}
        missing = []
        for word in words:
            ids = self.young.get(word) or self.old.get(word)
            if ids is None:
                missing.append(word)
            else:
                known[word] = ids
        if missing:
            known.update(zip(missing, self.propose([self.spelled(w) for w in missing])))
        self.young.update(known)
        return known

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = self.special_parts.split if self.special_parts else lambda text: [text]
        # every second part is a special token
        parted = [[part if k % 2 else self.words(part) for k, part in enumerate(split(text or ""))] for text in texts]
        of = self.learn(set().union(*(words for parts in parted for words in parts[::2]))).__getitem__
        special = {t: as_bytes([i]) for t, i in self.special.items()}
        return [
            np.frombuffer(b"".join(special[part] if k % 2 else b"".join(map(of, part)) for k, part in enumerate(parts)), "<u4")
            for parts in parted
        ]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The file names no decoder: tokens are joined by a space, special ones included."""
        name = self.tokens.__getitem__
        return [" ".join(map(name, row.tolist())) for row in ids]


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """The vocabulary and the words kept, for the time of a task."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, an array of long."""
    path = path or default_path()
    kind = dict(docs.dtypes)[doc_id]

    def encode(part):
        ids = word_bpe(path).encode(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "ids": [row.astype("i8") for row in ids]}

    return map_pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), encode, f"doc_id {kind}, ids array<bigint>", word_bpe.cache_clear)


def bpe_decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text; null ids give the empty text."""
    path = path or default_path()
    kind = dict(encoded.dtypes)[doc_id]

    def decode(part):
        rows = [np.asarray(row or [], "u4") for row in part.column("ids").to_pylist()]
        return {"doc_id": part.column("doc_id"), "text": word_bpe(path).decode(rows)}

    return map_pieces(encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), decode, f"doc_id {kind}, text string", word_bpe.cache_clear)


def bpe_digest(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass, without moving the ids through Spark."""
    path = path or default_path()
    kind = dict(docs.dtypes)[doc_id]

    def digest(part):
        bpe = word_bpe(path)
        ids = bpe.encode(part.column("text").to_pylist())
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": [len(row) for row in ids],
            "ids_sha256": [hashlib.sha256(row.tobytes()).hexdigest() for row in ids],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids)],
        }

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), digest, schema, word_bpe.cache_clear)


@query("op4_bpe")
def op4_bpe(spark, sf):
    return bpe_digest(table(spark, sf, "documents"))
