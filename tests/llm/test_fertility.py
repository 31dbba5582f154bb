import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from skyweave.llm.fertility import SCRIPTS, _measure, _script, bands, duplicate_lines, judge, measure, quality_rules
from skyweave.llm.queries import QUERIES, vocabularies
from skyweave.session import stage_table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_query_base(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_fertility"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id].text)
        assert not (r.kept and r.base_failed)


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_fertility"](spark, sf).collect()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    caps = [r.kept for r in rows if texts[r.doc_id].count("!!") > 0.2 * max(1, r.n_words) and r.n_words > 30]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.99 and np.mean(caps) == 0 and np.mean(bad) < 0.3


ODD = [None, "", " \n\t", "one", "a b c d e " * 40, "x" * 200_000, "\U0001f642 中文 " * 8, "d\x1cd d d \u0085", "l 1\nl 1\n l 1\n\n\n", "w%d " * 3]


def test_odd_rows_match_brute_force(spark):
    texts = ODD + [" ".join(random.Random(i).choices("ab", k=30 + i)) for i in range(20)]
    rows = [(i if i else None, t, None if i % 2 else "xx-Y", 5.0, "clash") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, n_words double, document string")
    got = quality_rules(df, **vocabularies(), carry=["doc_id", "n_words"]).collect()
    assert len(got) == 2 * len(texts)
    model = sentencepiece.SentencePieceProcessor(model_file=vocabularies()["pieces"])
    for r in got:
        text = texts[r.document.doc_id or 0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        assert r.document.n_words == 5.0
        ids = [i for w in WORD.findall(text or "") for i in model.encode(w)]
        share = [n / len(ids) for n in Counter(ids).values()]
        assert r.n_tokens == len(ids) and r.entropy == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-9)
        if ids:
            assert r.fallback_share == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
    assert quality_rules(df.limit(0), **vocabularies(), carry=["doc_id"]).count() == 0
    assert {r.language for r in got} >= {"xx", "none", "Latin"}


def test_whole_documents_are_carried(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = stage_table(measure(docs, **vocabularies(), carry=docs.columns), "m")
    assert m.select("document.*").exceptAll(docs).count() == 0 and m.count() == docs.count()
    assert judge(m).where("kept").count() > 100
    assert bands(m, least=5).count() > 3


def test_a_sparse_class_has_the_band_of_its_language_script_or_all(spark):
    rows = [(i, "de", 100 + i % 20, 4.0 + i % 5 / 10, 5.0 + i % 5 / 10, 0.0, 6.0 + i % 5 / 10) for i in range(40)]
    odd = [(100, "de", 9000, 4.2, 5.2, 0.0, 6.2), (101, "de", 9000, 1.0, 1.0, 0.9, 0.5), (102, "xx", 100, 4.2, 5.2, 0.0, 6.2), (103, "xx", 100, 1.0, 1.0, 0.9, 0.5)]
    odd += [(200 + i, ("zh", "ja")[i % 2], 100 + i, 1.0 + i % 5 / 10, 1.0 + i % 5 / 10, 0.3, 6.0) for i in range(30)] + [(300, "ko", 50, 9.0, 9.0, 0.0, 1.0)]
    df = spark.createDataFrame([(*r[:2], "Han" if r[0] >= 200 else "Latin", 50, 0, *r[2:]) for r in rows + odd], "document int, language string, script string, n_words bigint, n_repeat_words bigint, n_tokens bigint, chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy double")
    kept = {r.document: r.kept for r in judge(df).collect()}
    assert len(kept) == 75 and sorted(d for d, k in kept.items() if not k) == [101, 103, 300]


def test_lines():
    assert duplicate_lines("a\n\n\na\n a\n \n") == 1


def test_script_is_that_of_most_letters_and_texts_are_searched_twice_at_most(spark):
    letters = {"Latin": "aZéßłǅẞﬀⅣªºK", "Cyrillic": "дЖѣ", "Greek": "αΩἀ", "Arabic": "عل", "Hebrew": "של", "Devanagari": "कख", "Han": "漢字𠀀", "Hangul": "한글", "": " \n.,1µ×÷—“😀かไ\u0301"}
    r = random.Random(3)
    rows = [(None, "none"), ("", "none"), ("1 — 😀", "none"), ("かไ", "none")]
    for _ in range(400):
        some = [r.choice(list(letters)) for _ in range(r.randint(1, 3))] + [r.choice(["Latin", ""])]
        picks = [r.choice(some) for _ in range(r.randint(1, 12))]
        count = {k: picks.count(k) for k in SCRIPTS}
        best = max(count, key=lambda k: (count[k], -SCRIPTS.index(k)))
        rows.append(("".join(r.choice(letters[k]) for k in picks), best if count[best] else "none"))
    df = spark.createDataFrame(rows, "text string, want string").select("text", "want", _script().alias("got"))
    assert [x for x in df.collect() if x.got != x.want] == []
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text") <= 2


def test_memory_does_not_follow_the_batch():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(400)]
    names = pa.array([""] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(len(texts)))], names=["doc_id"]), names, names, pa.array(texts)], names=["document", "language", "script", "t"])
    run = _measure(**vocabularies())
    sum(out.num_rows for out in run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        assert batch.nbytes > 4 << 20 and sum(out.num_rows for out in run(iter([batch]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()
