"""Token counts against the library itself."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyweave.llm.queries import QUERIES
from skyweave.llm.token_counts import TokenCounter, blocks, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_equals_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert [r.doc_id for r in rows] == [*docs] and [r.n_tokens for r in rows] == library(docs.values())
    assert all(r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert sum(r.n_whole for r in rows) > 0 and sum(r.n_merged for r in rows) > 0


def test_odd_rows(spark):
    texts = [None, "", "  \n\t ", "It's <|endoftext|>we'LL<|startoftext|>", "<|ENDOFTEXT|>", "É É Kİ\x1cx\u0085y ſ'S", "word, " * 90_000, "x" * 300_000, "é" * 70_000, "a b"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(9, "a b")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n_tokens", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in count_tokens(df, PATH, limit=4).collect()))
    want = [(i or 0, n, len((t or "").encode()), n > 4) for (i, t), n in zip(rows, library([t for _, t in rows]))]
    assert got == sorted(want)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_proven_strings_are_single_tokens_of_the_library():
    some = sorted(COUNTER.proven_ascii)[::50]
    assert library(some) == [1] * len(some)
    assert len(COUNTER.proven_ascii) > 30_000


def test_every_character_between_letters():
    marks = [chr(i) for i in range(0x2000)] + [chr(i) for i in range(0x2000, 0x110000, 37) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}B1 {c} {c}{c}'s" for c in marks]
    assert [COUNTER.count(t)[2] for t in texts] == library(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAéÉé \n\t\x0b\x1c'sStTrRvVlLmMdD09½<|>endoftxra ßİΣς中\U0001f600.,-"), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text)[2] == library([text])[0]


def test_blocks_lose_nothing_but_breaks():
    text = "ab cd\nef" * 50
    assert "".join(blocks(text, 7)).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert max(map(len, blocks(text, 7))) < 16


def test_other_files(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library_ = TokenCounter(path), Tokenizer.from_file(path)
    for text in ["Hello  world, it's 2024 \n\n x<|endoftext|>y", "žluťoučký kůň   ", ""]:
        assert counter.count(text)[2] == len(library_.encode(text, add_special_tokens=False).ids)
    other = tmp_path / "x.json"
    other.write_text('{"model": {"type": "WordLevel"}, "pre_tokenizer": null}')
    with pytest.raises(ValueError):
        TokenCounter(str(other))
