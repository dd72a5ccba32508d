"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a sample; rules then run in the order of rejections
per second, and a document leaves at the first rule that rejects it. The order changes the work, never
the verdict: a document is kept if and only if no rule rejects it.

A null text is an empty text. Rows are judged one by one: repeated rows get the same verdict, an empty
table gives an empty result, and only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import map_pieces, query, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


class Features:
    """What rules look at, computed when first asked for. Words lie between ASCII blanks."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split parts at the six ASCII blanks and at nothing else
        return self.text.encode().split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 5-word windows that the text has twice or more, the first of them included."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) == len(windows):
            return 0
        times, covered, until = Counter(windows), 0, 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                covered += at + 5 - max(at, until)
                until = at + 5
        return covered


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Features], bool]


RULES = (
    Rule("few_words", lambda f: len(f.words) < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * len(f.words)),
    Rule("word_length", lambda f: not 2 * len(f.words) <= f.word_chars <= 20 * len(f.words)),
    Rule("symbols", lambda f: 10 * f.n_symbols > len(f.words)),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
)
BASE = RULES[:2]


def cascade_order(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2_000, seed: int = 7
) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of about ``sample_rows`` rows, twice as many at most.

    Rules that reject nothing there come last, the cheapest first. An empty sample leaves the order as it is.
    """
    rows = docs.count()
    if not rows:
        return rules
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / rows), seed).limit(2 * sample_rows)

    def measure(part):
        names, rejected, spent = [], [], []
        texts = part.column("text").to_pylist()
        for rule in rules:
            began = time.perf_counter_ns()
            rejected.append(sum(rule.rejects(Features(t)) for t in texts))
            spent.append(time.perf_counter_ns() - began)
            names.append(rule.name)
        return {"rule": names, "rejected": rejected, "nanos": spent}

    measured = map_pieces(sample, measure, "rule string, rejected long, nanos long")
    found = {r["rule"]: r for r in measured.groupBy("rule").agg(F.sum("rejected").alias("n"), F.sum("nanos").alias("t")).collect()}
    if not found:
        return rules

    def rank(rule):
        n, t = found[rule.name]["n"], max(1, found[rule.name]["t"])
        return -n / t, t

    return tuple(sorted(rules, key=rank))


def quality_cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = 2_000,
    stats: bool = False,
) -> DataFrame:
    """doc_id, kept, rejected_by (the first rule in the cascade's order that rejects, else null).

    ``stats=True`` adds the counts behind the rules, computed for every document, and ``base_failed``.
    """
    order = cascade_order(docs, rules, text, sample_rows)
    base = {rule.name for rule in BASE}

    def judge(part):
        out = {"doc_id": part.column("doc_id"), "kept": [], "rejected_by": []}
        if stats:
            out |= {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
        for value in part.column("text").to_pylist():
            seen = Features(value)
            if stats:
                out["n_words"].append(len(seen.words))
                for name in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                    out[name].append(getattr(seen, name))
                out["base_failed"].append(any(rule.rejects(seen) for rule in BASE))
            if stats and out["base_failed"][-1]:
                by = next((rule.name for rule in order if rule.name in base and rule.rejects(seen)), BASE[0].name)
                out["kept"].append(False)
            else:
                by = next((rule.name for rule in order if rule.rejects(seen)), None)
                out["kept"].append(by is None)
            out["rejected_by"].append(by)
        return out

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, kept boolean, rejected_by string"
    if stats:
        schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    return map_pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), judge, schema)


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), w as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from d
), g as (
  select doc_id, t, words, lines, unnest(range(1, greatest(len(words) - 3, 1))) as pos from w where len(words) >= 5
), c as (
  select doc_id, pos, count(*) over (partition by doc_id, words[pos:pos + 4]) as times from g
), r as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(pos, pos + 5)) as p from c where times > 1) group by doc_id
), s as (
  select w.doc_id, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines
  from w left join r on w.doc_id = r.doc_id
), b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars >= 2 * n_words and word_chars <= 20 * n_words
         and 10 * n_symbols <= n_words and 2 * n_dup_lines <= n_lines as kept
from b
"""


@query("op8_quality_rules", SQL)
def op8_quality_rules(spark, sf):
    return quality_cascade(table(spark, sf, "documents"), stats=True).drop("rejected_by")
