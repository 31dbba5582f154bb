"""Every stage of the pipeline on what its predecessor kept, against the brute force of the operators' tests."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyweave.session import stage_table

from .test_fertility import brute as base
from .test_jaccard import brute as components
from .test_line_templates import brute as lines
from .test_mixing import WORD, expected as targets
from .test_packing import check as packed, expected as ids


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = stage_table(f(spark, docs, sf_dir), "test")
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_names(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[1:-1])


def test_quality_keeps_no_failed_document(stages):
    before, after = dict(rows(stages[0])), dict(rows(stages[1]))
    assert set(after.items()) <= set(before.items())
    passed = {d for d, t in before.items() if not base(t)[-1]}
    assert set(after) <= passed and len(after) > 0.6 * len(passed)


def test_lines_are_those_of_the_tree_or_copies(stages):
    before, after = dict(rows(stages[1])), dict(rows(stages[2]))
    assert set(before) == set(after)
    by_hand = dict(lines(list(before.items())))
    for d, text in after.items():
        # what goes is a part of what the tree by hand drops, which does not spare copies of documents
        assert not Counter(by_hand[d].split("\n")) - Counter(text.split("\n")) and not Counter(text.split("\n")) - Counter(before[d].split("\n"))
    assert any(after[d] != before[d] for d in after)
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text != before[r.doc_id])


def test_one_document_of_each_component(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {c for _, n, c in components(before) if n} | {d for d, t in before if not re.search(r"[^\x20\x09-\x0D]", t or "")}
    assert sorted(d for d, _ in after) == sorted(want) and dict(after).items() <= dict(before).items()


def test_mixture_is_near_its_targets(stages):
    before = [(r.doc_id, r.source, r.text) for r in stages[3].collect()]
    taken, most = Counter(), Counter()
    for r in stages[4].collect():
        taken[r.source] += len(WORD.findall(r.text))
        most[r.doc_id] += 1
    sizes, target = targets(before)
    longest = {s: max(len(WORD.findall(t or "")) for _, x, t in before if x == s) for s in sizes}
    assert max(most.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)


def test_packing_holds_every_id(stages):
    by_doc = {}
    for d, t in rows(stages[4]):
        by_doc.setdefault(d, []).append(t)
    once = {d: t[0] for d, t in by_doc.items() if len(t) == 1}
    got = stages[5].collect()
    want = dict(zip(once, ids(list(once.values()))))
    total = sum(len(x) * len(by_doc[d]) for d, x in zip(by_doc, ids([t[0] for t in by_doc.values()])))
    assert sum(r.length for r in got) == total
    packed_rows = [r for r in got if r.doc_id in want]
    for d, x in want.items():
        assert sum(r.length for r in packed_rows if r.doc_id == d) == len(x)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and set(corpus_pipeline.run(spark, sf_dir).columns) == set(stages[-1].columns)


def test_odd_rows(spark, sf_dir):
    odd = [(None, None, None, None, 0, 1, "a"), (1, "", "en", "s", 0, 2, "b"), (1, None, "en", "s", 0, 3, "c"), (2, "\n\n", "xx", None, 2, 4, "d"), (2, "short", "en", "s", 5, 4, "d")]
    odd += [(i, " ".join(f"w{j}x{i % 7}" for j in range(60 + i % 7)), "en", "s" if i % 2 else None, 9, i, "k") for i in range(3, 60)] * 2
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, document string"
    for data in (odd, []):
        docs = spark.createDataFrame(data, names).withColumns({c: F.lit("clash") for c in ("k_id", "w_id", "w_n", "a.b", "h1", "pattern")})
        for name, f in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage_table(f(spark, docs, sf_dir), "odd")
            assert docs.columns == columns or name == "packing"
        assert (docs.count() > 0) == bool(data)
