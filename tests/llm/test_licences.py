import random
import re

import pytest
from pyspark.sql import functions as F

from skyweave.llm.licences import FAMILIES, TEMPLATES, _grams, calibrate, fit, grams, paragraphs, scan
from skyweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def classifier(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), sample=1500)


def test_held_out_notices(spark, classifier):
    """Sentences in surroundings and spellings that were not learnt, and texts without a licence."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 97 = 5")
    filler = [r.body for r in paragraphs(docs.select("text")).where("length(body) between 40 and 400").orderBy("body").limit(400).collect()]
    filler = [f for f in filler if not re.search("licen|copyright|reserved", f, re.I)]
    r, rows, want = random.Random(8), [], {}
    listed = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    for i, body in enumerate(filler):
        if i % 2:
            family, text = listed[i // 2 % len(listed)]
            text = r.choice([text, text.upper(), text.replace(" ", "  "), f"{text} "])
            rows.append((i, f"{filler[i - 1]}\n{r.choice(['', 'Note: ', '(c) 2019 '])}{text}"))
            want[i, 1] = family
        else:
            rows.append((i, body))
    got = {(x.doc_id, x.paragraph): x.family for x in scan(spark.createDataFrame(rows, "doc_id int, text string"), classifier).collect()}
    right = sum(got.get(k) == f for k, f in want.items())
    assert right >= 0.9 * len(want) and len(set(got) - set(want)) <= 0.01 * len(rows)


def test_query_finds_the_notices(spark, sf_dir):
    docs = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(d, i) for d, ls in docs.items() for i, line in enumerate(ls) if re.search("licensed under|released under|rights reserved", line, re.I)}
    got = {(r.doc_id, r.paragraph) for r in QUERIES["op4_licences"](spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 2


def test_odd_rows(spark, classifier):
    rows = [(1, None), (2, ""), (None, "x\nReleased under the MIT License."), (3, "\n\n"), (4, "All rights reserved.\n" * 2), (4, "All rights reserved.\n" * 2), (5, "word " * 50000), (6, "Licensed under the Licence of the moon, version 9.")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("family", F.lit("clash")).withColumn("body", F.lit(1))
    got = sorted((x.doc_id or 0, x.paragraph, x.family) for x in scan(df, classifier).collect())
    assert [g for g in got if g[0] != 6] == [(0, 1, "MIT"), *[(4, i, "proprietary") for i in (0, 0, 1, 1)]]
    assert all(g[2] == "unknown" for g in got if g[0] == 6)
    assert scan(df.limit(0), classifier).count() == 0


def test_grams_are_the_same_in_both_forms(spark):
    texts = [t for ts in TEMPLATES.values() for t in ts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grams(F.col("t")).alias("g")).collect()
    for r in got:
        words = re.findall("[a-z0-9]+", r.t.lower())
        assert set(_grams(r.t)) <= set(r.g) and set(r.g) - set(_grams(r.t)) <= {words[-1]}


def test_calibration():
    raw = [(0, [4.0, 0.0])] * 90 + [(1, [0.0, 4.0])] * 90 + [(0, [0.0, 1.0])] * 10
    temperature, threshold = calibrate(raw, 0.99)
    assert 0.25 <= temperature <= 10 and threshold > 0.5
    assert calibrate([], 0.9) == (1.0, 0.5) and len(FAMILIES) == len(TEMPLATES) + 1


def test_no_python_in_the_plan(spark, classifier, sf_dir):
    plan = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), classifier)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|InPandas|CartesianProduct|NestedLoop", plan)
