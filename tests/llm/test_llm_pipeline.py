"""The pipeline, stage by stage, each held against a plain version on its own input."""

import importlib
import sys
from pathlib import Path

import numpy as np
import pytest
from llm_cases import NO_ID, awkward, awkward_rows, number, plain_groups, plain_leaks, plain_lines, sha
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from sheaf.llm import bpe, lines, toxicity  # noqa: E402
from sheaf.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module", params=["given", "awkward"])
def stages(request, spark, tmp_path_factory):
    """For each stage its name, what it got and what it gave, both written and read again."""
    docs = table(spark, SF, "documents") if request.param == "given" else awkward(spark)
    folder, out = tmp_path_factory.mktemp("stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        out[name] = docs, made
        docs = made
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]
    for name, (docs, made) in list(stages.items())[:-1]:
        assert made.dtypes == docs.dtypes, name


def test_toxicity(spark, stages):
    docs, made = stages["toxicity"]
    chain = toxicity.train_chain(docs, table(spark, SF, "labels"))
    verdicts = toxicity.toxicity(docs, chain)
    clean = ordered(r[:1] for r in verdicts.where("not toxic").collect())
    assert ordered(r[:1] for r in pairs(made)) == clean


def test_line_dedup(stages):
    docs, made = stages["line_dedup"]
    before, after = pairs(docs), pairs(made)
    want = plain_lines(before, near=lambda a, b: lines.within(a, b, lines.EDITS))
    single = {d for d, _ in before if sum(x == d for x, _ in before) == 1}
    assert ordered((d, t or "") for d, t in after if d in single) == ordered((w[0], w[3]) for w in want if w[0] in single)
    assert len(after) == len(before)
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in made.collect())


def test_ngram_jaccard(stages):
    docs, made = stages["ngram_jaccard"]
    rows = pairs(docs)
    found, roots = plain_groups(rows)
    first = {}
    for k, (doc, _) in enumerate(rows):
        if found[k][0]:
            first[roots[k]] = min(first.get(roots[k], NO_ID), number(doc))
    want = list(first.values()) + [number(d) for k, (d, _) in enumerate(rows) if not found[k][0]]
    assert sorted(number(d) for d, _ in pairs(made)) == sorted(want)


def test_decontamination(spark, stages):
    docs, made = stages["decontamination"]
    rows = pairs(docs)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = [r for r, (_, hit, _) in zip(rows, plain_leaks(rows, items)) if not hit]
    assert ordered(pairs(made)) == ordered(clean)


def test_tokens(stages):
    docs, made = stages["bpe"]
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for doc, text in pairs(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert ordered(made.collect()) == ordered(want)


def test_run_is_the_stages(spark, stages):
    docs, made = stages["bpe"]
    if "source" in docs.columns and "odd.name" not in docs.columns:
        assert ordered(corpus_pipeline.run(spark, SF).collect()) == ordered(made.collect())


def test_empty_tables(spark):
    docs = awkward(spark, awkward_rows()[:3]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_entry_registers_the_queries():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
