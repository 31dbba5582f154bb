import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyweave.llm import line_templates
from skyweave.llm.line_templates import _bitmap, _held, drop_recurring_lines
from skyweave.llm.queries import QUERIES

SPACE = re.compile("[\x20\x09-\x0d]+")


def tokens(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in SPACE.split(line) if w)


def signature(text):
    w = [x for x in SPACE.split(text)]
    return {tuple(w[i : i + 3]) for i in range(len(w))}


def brute(rows, depth=3, least=3, share=0.75, constants=3):
    """The tree over distinct texts, without the rule on signatures."""
    texts = defaultdict(list)
    for d, t in rows:
        if t is not None:
            texts[t].append(d if d is not None else 1 << 62)
    leaf, support = defaultdict(set), defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            w = tokens(line)
            if w:
                leaf[len(w), w[:depth]].add((w, t))
                for i, x in enumerate(w):
                    support[len(w), w[:depth], i, x].add(t)
    by_form = defaultdict(set)
    for held in leaf.values():
        for w, t in held:
            by_form[w].add(t)
    weight = defaultdict(int)
    for w, held in by_form.items():
        for i, x in enumerate(w):
            weight[len(w), w[:depth], i, x] += len(held)

    def template(w):
        if len(w) > depth and len({f for f, _ in leaf[len(w), w[:depth]]}) > 1 and len(leaf[len(w), w[:depth]]) >= least:
            mask = tuple(x if x != "<*>" and weight[len(w), w[:depth], i, x] >= least else None for i, x in enumerate(w))
            n = sum(x is not None for x in mask)
            if n >= share * len(w):
                return ("wide", len(w), w[:depth], mask), n
        n = sum(x != "<*>" for x in w)
        return (("exact", w), n) if len(by_form[w]) >= least and n >= share * len(w) else (None, 0)

    places = defaultdict(list)
    for t, ids in texts.items():
        for i, line in enumerate(t.split("\n")):
            w = tokens(line)
            if w:
                name, n = template(w)
                if name and n >= constants:
                    places[name].append((t, i))
    gone = defaultdict(set)
    for held in places.values():
        if len({t for t, _ in held}) >= least:
            first = min((min(texts[t]), k, i) for k, (t, i) in enumerate(held))
            for k, (t, i) in enumerate(held):
                if k != first[1]:
                    gone[t].add(i)
    return [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[t])) for d, t in rows]


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for d in range(60):
        lines = [" ".join(f"{r.choice('abcdefgh')}{''.join(r.choices('klmnop', k=5))}" for _ in range(r.randint(3, 12))) for _ in range(r.randint(2, 6))]
        if d % 2:
            lines.insert(r.randint(0, 2), f"session {r.randrange(10**6)} of user u{d} was closed by the remote host")
        if d % 3 == 0:
            lines.append(f"the page was written by {r.choice(['ann', 'bob', 'cyd', 'dee'])}{''.join(r.choices('xyz', k=6))} for our readers everywhere in town")
        if d % 5 == 0:
            lines += ["All rights reserved.", "one two", "", " \t"]
        if d % 7 == 0:
            lines.append(f"{r.random()} {r.random()} end")
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_the_tree_by_hand(spark, seed):
    rows = corpus(seed) + [(100, None), (101, ""), (102, corpus(seed)[5][1]), (5, corpus(seed)[5][1]), (None, corpus(seed)[8][1] + "\nlast line here")]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id int, text string, line_no int, gone string").repartition(3)
    got = drop_recurring_lines(df)
    assert got.select("document.*").columns == df.columns
    want = brute(rows)
    assert sorted(map(str, ((r.document.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert sum(t != u for (_, t), (_, u) in zip(rows, want)) > 30


def test_copies_are_left_alone(spark):
    r = random.Random(3)
    base = [[f"w{''.join(r.choices('abcdef', k=6))}" for _ in range(10)] for _ in range(12)]
    copies = []
    for d in range(40):
        lines = [list(x) for x in base]
        lines[r.randrange(12)][r.randrange(10)] = f"edit{''.join(r.choices('abcdef', k=6))}"
        copies.append((d, "\n".join(" ".join(x) for x in lines)))
    copies += [(100 + d, copies[0][1]) for d in range(50)]
    got = drop_recurring_lines(spark.createDataFrame(copies, "doc_id int, text string")).collect()
    assert all(x.text == x.document.text and x.n_dropped == 0 for x in got)


def word(r):
    return "".join(r.choices("abcdefghij", k=7))


def test_a_hot_copy_group_does_not_save_a_line(spark):
    r = random.Random(5)
    line = "subscribe to our letter for more of this"
    base = [[word(r) for _ in range(10)] for _ in range(12)]
    rows = []
    for d in range(300):
        lines = [list(x) for x in base]
        lines[r.randrange(12)][r.randrange(10)] = word(r)
        rows.append((d, "\n".join([*(" ".join(x) for x in lines), line])))
    rows += [(1000 + d, "\n".join([*(" ".join(word(r) for _ in range(9)) for _ in range(8)), line])) for d in range(40)]
    got = {x.document.doc_id: x for x in drop_recurring_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    # the first occurrence stays; the lines of the copies' own document stay in all of them
    assert all(x.n_dropped == (d > 0) and (line in x.text) == (d == 0) for d, x in got.items())


@pytest.mark.parametrize("passage, own", [(60, 60), (60, 30), (60, 15)])
def test_short_documents_around_a_passage(spark, passage, own):
    r = random.Random(6)
    shared = " ".join(word(r) for _ in range(passage))
    for _ in range(2):
        rows = [(d, shared + "\n" + " ".join(word(r) for _ in range(own))) for d in range(30)]
        got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()
        assert sum(x.n_dropped for x in got) == 29


def test_only_texts_that_stand_for_a_form_are_cut_again(spark, monkeypatch):
    cut, split = [], line_templates._split

    def counted(docs, columns, minima=False):
        cut.append(docs.where("text is not null").count())
        return split(docs, columns, minima)

    monkeypatch.setattr(line_templates, "_split", counted)
    r = random.Random(8)
    rows = [(d, " ".join(word(r) for _ in range(9)) + "\n" + " ".join(word(r) for _ in range(5))) for d in range(200)]
    rows += [(500 + d, f"the page was written by {word(r)} for our readers everywhere in town\n" + " ".join(word(r) for _ in range(12))) for d in range(10)]
    got = drop_recurring_lines(spark.createDataFrame(rows + [(900, None)], "doc_id int, text string")).collect()
    assert sum(x.n_dropped for x in got) == 9 and all(x.n_dropped == 0 for x in got if x.document.doc_id in (500, 900) or x.document.doc_id < 500)
    # one text holds each of the ten forms of the template; two bits of 2^23 may clash
    assert cut[0] == 210 and 10 <= cut[1] <= 11


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_line_templates"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and sum(r.n_dropped for r in rows) > 0
    for r in rows:
        old = docs[r.doc_id].split("\n")
        assert r.n_lines == len(old) and r.n_lines - r.n_dropped == (len(r.text.split("\n")) if r.n_dropped < r.n_lines else 0)


def test_empty_table_and_bits(spark):
    assert drop_recurring_lines(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    df = spark.range(-3000, 3000, 7).select(F.xxhash64("id").alias("x"))
    bits = _bitmap(df, "x")
    words = spark.range(1).select(bits.alias("b")).first()["b"]
    assert df.where(~_held(bits, "x")).count() == 0 and sum((b & (1 << 64) - 1).bit_count() for b in words) == df.select(F.expr(f"x & {(1 << 23) - 1}")).distinct().count()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op2_line_templates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
