"""Toxicity by a classifier chain over the label columns.

Categories are predicted one after the other by linear models over the words a text has; each model also sees
the probabilities of the categories before it. For training, those are out-of-fold predictions, so that a
later model learns from errors like those it will meet, not from fits to its own rows.

The chain is trained on a sample of at most ``sample_rows`` labelled rows, drawn evenly by a hash of their id.
Equal texts count once there. Its words are those that tell most about each category, ``words_each`` at most,
and only such as tell more than the best of so many words would by chance (likelihood ratio). Scoring goes
through all documents in one narrow pass with the words and weights, whose number is bounded, in hand.

A null or empty text has no words and gets what the intercepts give. Labels that no document has take no place
in the sample; ids whose labels contradict each other are left out. A row trains the categories whose label it has. Without any labelled
row, or without both values of a category among them, its probability is that value for all (0 if unknown).
Repeated rows get equal results, an empty table an empty result; other columns are not read, and
``drop_toxic`` keeps them as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import map_pieces, map_rows, query, stored, table

SAMPLE_ROWS = 20_000
WORDS_EACH = 400
FOLDS = 3
ITERATIONS = 300  # a bound; models converge before it
WORD = re.compile(r"[^\W\d_]+")


class Category(NamedTuple):
    """A binary category: its name, and the SQL expression over the label columns that gives it."""

    name: str
    truth: str


# The order of the chain. The last one is the verdict.
CATEGORIES = (Category("junk", "quality = 0"), Category("toxic", "toxic = 1"))


class Link(NamedTuple):
    """One model: weights of words, of the categories before it, and the intercept."""

    name: str
    words: dict[str, float]
    earlier: tuple[float, ...]
    intercept: float


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...], doc_id: str, text: str, rows: int) -> DataFrame:
    """text, fold and a column 0/1 (null if unknown) for each category; written, as it is read many times."""
    names = [c.name for c in categories]
    truth = labels.select(F.col("doc_id").alias("id"), *(F.expr(c.truth).cast("int").alias(c.name) for c in categories))
    truth = truth.dropna(subset=["id"]).dropna("all", subset=names)
    agreed = truth.groupBy("id").agg(*(F.min(n).alias(n) for n in names), *(F.max(n).alias(f"most_{n}") for n in names))
    agreed = agreed.where(" and ".join(f"{n} <=> most_{n}" for n in names)).select("id", *names)
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    agreed = agreed.join(own.select("id"), "id", "left_semi")
    # bounded by the number of rows that are asked for, hence small enough to go to every task
    drawn = agreed.orderBy(F.xxhash64("id"), "id").limit(rows)
    found = own.join(F.broadcast(drawn), "id").withColumn("same", F.xxhash64("text"))
    found = found.groupBy("same").agg(F.first("text").alias("text"), F.min("id").alias("id"), *(F.min(n).alias(n) for n in names))
    found = found.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)))
    return stored(found.select("text", "fold", *names), "labelled")


def telling_words(sample: DataFrame, names: list[str], each: int) -> list[str]:
    """The words whose texts differ most from the rest in each category, by likelihood ratio over the whole sample."""

    def count(part):
        total: Counter[str] = Counter()
        positive: list[Counter[str]] = [Counter() for _ in names]
        unknown: list[Counter[str]] = [Counter() for _ in names]
        truth = [part.column(n).to_pylist() for n in names]
        for k, text in enumerate(part.column("text").to_pylist()):
            words = words_of(text)
            total.update(words)
            for own, counter, without in zip(truth, positive, unknown):
                if own[k] is None:
                    without.update(words)
                elif own[k]:
                    counter.update(words)
        out = {"word": list(total), "n": list(total.values())}
        for c, p, u in zip(names, positive, unknown):
            out |= {f"n_{c}": [p[w] for w in total], f"known_{c}": [n - u[w] for w, n in total.items()]}
        return out

    schema = "word string, n long, " + ", ".join(f"n_{c} long, known_{c} long" for c in names)
    counts = map_pieces(sample.select("text", *names), count, schema).groupBy("word").agg(
        F.sum("n").alias("n"), *(F.sum(f"{x}_{c}").alias(f"{x}_{c}") for c in names for x in ("n", "known"))
    )
    counts = stored(counts.where("n > 1"), "words")
    sums = sample.agg(*(F.count(c).alias(f"rows_{c}") for c in names), *(F.sum(c).alias(c) for c in names)).first()
    # so much evidence one word in so many has by chance, and a margin
    least = 2 * (math.log(max(1, counts.count())) + 2)
    out: dict[str, None] = {}
    for c in names:
        rows, positive = float(sums[f"rows_{c}"]), float(sums[c] or 0)
        if not 0 < positive < rows:
            continue
        evidence = F.lit(0.0)
        n = F.col(f"known_{c}")
        for seen, share in ((F.col(f"n_{c}"), positive / rows), (n - F.col(f"n_{c}"), 1 - positive / rows)):
            evidence += F.when(seen > 0, 2 * seen * F.log(seen / (n * share))).otherwise(0.0)
        best = counts.select("word", evidence.alias("evidence")).where(F.col("evidence") > least)
        out.update(dict.fromkeys(r["word"] for r in best.orderBy(F.desc("evidence"), "word").limit(each).collect()))
    return list(out)


def fit(train: DataFrame, name: str, features: str):
    from pyspark.ml.classification import LogisticRegression  # here, as tasks need none of it

    return LogisticRegression(featuresCol=features, labelCol=name, regParam=1e-3, maxIter=ITERATIONS, probabilityCol="p", predictionCol="guess").fit(train)


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, doc_id: str = "doc_id",
    text: str = "text", sample_rows: int = SAMPLE_ROWS, words_each: int = WORDS_EACH,
) -> list[Link]:
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [c.name for c in categories]
    sample = labelled_sample(docs, labels, categories, doc_id, text, sample_rows)
    vocabulary = telling_words(sample, names, words_each)
    known = sample.agg(*(F.count(n).alias(f"rows_{n}") for n in names), *(F.sum(n).alias(n) for n in names)).first()
    chosen = set(vocabulary)

    def present(part):
        words = [sorted(words_of(t) & chosen) for t in part.column("text").to_pylist()]
        return {"words": words, "fold": part.column("fold")} | {n: part.column(n) for n in names}

    schema = "words array<string>, fold long, " + ", ".join(f"{n} int" for n in names)
    rows = stored(map_pieces(sample, present, schema), "train")
    if vocabulary:
        rows = CountVectorizerModel.from_vocabulary(vocabulary, "words", "bag", 1.0).setBinary(True).transform(rows)

    chain: list[Link] = []
    earlier: list[str] = []
    for at, name in enumerate(names):
        positive = known[name] or 0
        if not vocabulary or positive in (0, known[f"rows_{name}"]):
            certain = 40.0 if positive else -40.0
            chain.append(Link(name, {}, (0.0,) * at, certain))
            rows = rows.withColumn(f"p_{name}", F.lit(1.0 if positive else 0.0))
        else:
            rows = VectorAssembler(inputCols=["bag", *earlier], outputCol=f"x_{name}").transform(rows)
            labelled = rows.where(F.col(name).isNotNull())
            model = fit(labelled, name, f"x_{name}")
            weights = model.coefficients.toArray().tolist()
            words = {w: v for w, v in zip(vocabulary, weights) if v}
            chain.append(Link(name, words, tuple(weights[len(vocabulary) :]), model.intercept))
            if at + 1 < len(names):  # what the next models train on
                parts = []
                for fold in range(FOLDS):
                    own = fit(labelled.where(F.col("fold") != fold), name, f"x_{name}").transform(rows.where(F.col("fold") == fold))
                    parts.append(own.withColumn(f"p_{name}", vector_to_array("p")[1]).select(*rows.columns, f"p_{name}"))
                rows = parts[0].union(parts[1])
                for part in parts[2:]:
                    rows = rows.union(part)
        earlier.append(f"p_{name}")
    return chain


def score(text: str | None, chain: list[Link], vocabulary: frozenset[str]) -> list[float]:
    """The probability of each category, in the order of the chain."""
    words = words_of(text) & vocabulary
    out: list[float] = []
    for link in chain:
        total = link.intercept + sum(link.words.get(w, 0.0) for w in sorted(words))
        total += sum(w * p for w, p in zip(link.earlier, out))
        out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, total)))))
    return out


def vocabulary_of(chain: list[Link]) -> frozenset[str]:
    return frozenset(w for link in chain for w in link.words)


def toxicity(docs: DataFrame, chain: list[Link], doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the probability of each category (four digits) and ``toxic``: the last one reaches the threshold."""
    vocabulary = vocabulary_of(chain)

    def rate(part):
        scores = [score(t, chain, vocabulary) for t in part.column("text").to_pylist()]
        out = {f"p_{link.name}": [round(s[k], 4) for s in scores] for k, link in enumerate(chain)}
        return out | {"doc_id": part.column("doc_id"), "toxic": [s[-1] >= threshold for s in scores]}

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, " + ", ".join(f"p_{link.name} double" for link in chain) + ", toxic boolean"
    return map_pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rate, schema)


def drop_toxic(docs: DataFrame, chain: list[Link], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents the chain does not call toxic, with all their columns."""
    vocabulary, at = vocabulary_of(chain), docs.columns.index(text)

    def clean(part):
        return pa.array([score(t, chain, vocabulary)[-1] < threshold for t in part.column(at).to_pylist()], pa.bool_())

    return map_rows(docs, clean)


@query("op5_toxicity")
def op5_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity(docs, train_chain(docs, table(spark, sf, "labels")))
