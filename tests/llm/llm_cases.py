"""Documents with everything that is awkward, and plain versions of the operators to compare with."""

import hashlib
import random
import re

from pyspark.sql import functions as F

NO_ID = 1 << 62
BLANK = " \t\n\x0b\x0c\r"


def prose(seed, words, alphabet=400):
    own = random.Random(seed)
    return " ".join(f"w{own.randrange(alphabet)}x{own.randrange(9)}" for _ in range(words))


def edited(text, seed, edits):
    own, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[own.randrange(len(words))] = f"new{own.randrange(999)}"
    return " ".join(words)


def awkward_rows():
    base, other, shared = prose(1, 120), prose(2, 150), prose(3, 30)
    rows = [
        (10, base), (11, base), (12, edited(base, 5, 2)), (13, edited(base, 6, 1)), (5, base.upper()),
        (20, other), (20, other), (21, edited(other, 7, 3)), (22, other + " " + shared), (23, prose(8, 80) + " " + shared),
        (30, None), (31, ""), (32, " \n\t "), (None, base), (None, None), (None, prose(9, 60)),
        (40, prose(10, 30_000)), (41, "a" * 200_000), (42, "ab " * 20_000), (43, "x\n" * 300),
        (50, "One short line\nOne short line\n" + shared), (51, "é" * 60 + " ü " + "é" * 60), (52, "ü" + "é" * 60),
        (60, "four words of text"), (61, "Four WORDS of text"), (62, "four words of"), (62, prose(11, 40)),
        (70, "this is a line of more than twenty characters\nsecond"), (71, "this is a line of more then twenty characters\nthird"),
        (72, "this is a line of more them twenty charactrs\nthird"), (73, "\n\nthird\n"), (9, prose(12, 20) + "  \x1c" + shared),
    ]
    return rows


EXTRA = ("key", "id", "piece", "node", "leak", "spans", "line_key", "set_key", "bucket", "family", "words", "from", "odd.name")


def awkward(spark, rows=None):
    """The rows with nulls and clashing names in other columns."""
    rows = awkward_rows() if rows is None else rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit(c) for c in EXTRA})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def number(doc_id):
    return NO_ID if doc_id is None else doc_id


def ascii_words(text):
    return (text or "").encode().split()


def lower(data):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def plain_repeats(rows, unit, size):
    """For each row: which places lie in a window that a row with a smaller id has. unit: text -> sequence."""
    first = {}
    for doc, text in rows:
        own = unit(text)
        for k in range(len(own) - size + 1):
            gram = tuple(own[k : k + size])
            first[gram] = min(first.get(gram, NO_ID * 2), number(doc))
    out = []
    for doc, text in rows:
        own = unit(text)
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            if first[tuple(own[k : k + size])] < number(doc):
                gone[k : k + size] = [True] * size
        out.append(gone)
    return out


def plain_leaks(rows, items, size=10):
    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    words = lambda t: pattern.findall(lower((t or "").encode()))
    grams = {}
    for item, text in items:
        own = words(text)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            grams.setdefault(tuple(own[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for _, text in rows:
        own, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(own) - n + 1):
                if (names := grams.get(tuple(own[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((len(own), len(hit), sorted(found)))
    return out


def shingles(text, size=5):
    words = lower((text or "").encode()).split()
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def plain_groups(rows, percent=80):
    """For each row, its number of shingles and the smallest id of its component."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                up[root(x)] = root(y)
    least = {}
    for x, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(x)] = min(least.get(root(x), NO_ID), doc)
    return [(len(sets[x]), least.get(root(x))) for x in range(len(rows))], [root(x) for x in range(len(rows))]


def distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y)))
        above = row
    return above[-1]


def plain_lines(rows, edits=2, least=24, near=None):
    """(doc_id, lines, removed, kept text) of each row; ``near`` tells whether two lines are within reach."""
    near = near or (lambda a, b: len(a) < 1000 and distance(a, b) <= edits)
    order = sorted(range(len(rows)), key=lambda k: number(rows[k][0]))
    lines = {line for _, t in rows for line in (t or "").split("\n") if line.strip(BLANK)}
    long = sorted(line for line in lines if len(line) >= least)
    up = {line: line for line in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(long):
        for b in long[:x]:
            if abs(len(a) - len(b)) <= edits and root(a) != root(b) and near(a, b):
                up[root(a)] = root(b)
    seen, out = set(), [None] * len(rows)
    for k in order:
        kept, n, gone = [], 0, 0
        for line in (rows[k][1] or "").split("\n"):
            if not line.strip(BLANK):
                kept.append(line)
                continue
            n += 1
            if root(line) in seen:
                gone += 1
            else:
                seen.add(root(line))
                kept.append(line)
        out[k] = (rows[k][0], n, gone, "\n".join(kept))
    return out
