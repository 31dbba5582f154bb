import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyweave.llm.id_coder import BLOCK, decode_blocks, encode_blocks, id_files, rank_ids, read_ids, read_segment, write_ids, write_segment
from skyweave.llm.queries import QUERIES
from skyweave.llm.words import WordIds, text_slices
from skyweave.session import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 30))
def test_round_trip(ids, times):
    x = np.array(ids * times, dtype=np.uint32)[: 3 * BLOCK]
    assert (decode_blocks(encode_blocks(x), len(x)) == x).all()


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7])
def test_block_borders_and_distributions(n):
    rng = np.random.default_rng(n)
    for x in (rng.integers(0, 65536, n), rng.zipf(1.3, n) % 65536, np.zeros(n), np.arange(n) % 7, np.full(n, 65535)):
        x = x.astype(np.uint32)
        blocks = encode_blocks(x)
        assert (decode_blocks(blocks, n) == x).all()
        # each block is coded alone
        if n > BLOCK:
            assert blocks[1] == encode_blocks(x[BLOCK : 2 * BLOCK])[0]
    assert sum(map(len, encode_blocks((np.arange(n) % 7).astype(np.uint32)))) <= 0.15 * n + 12 * (n // BLOCK + 1)


def test_segments_keep_nulls_and_report_damage():
    ids = np.random.default_rng(1).integers(0, 4_000_000_000, 5000, dtype=np.uint32)
    raw = write_segment([-5, None, 7, 7], np.array([10, 0, 4000, 990]), ids)
    docs, lengths, back = read_segment(raw)
    assert docs == [-5, None, 7, 7] and lengths.tolist() == [10, 0, 4000, 990] and (back == ids).all()
    for at in (5, 60, 200, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            read_segment(bytes(bad))
    assert read_segment(write_segment([], np.zeros(0), np.zeros(0, np.uint32)))[0] == []


def test_ranks():
    by_rank, ranks = rank_ids(np.array([9, 4, 9, 4, 7], np.uint32))
    assert by_rank.tolist() == [4, 9, 7] and by_rank[ranks].tolist() == [9, 4, 9, 4, 7]


def expected(rows):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in rows], add_special_tokens=False)]


def encoded(table, texts):
    (_, _, data, offsets), = text_slices(pa.array(texts))
    ids, borders = table.encode(data, offsets, 1)
    return [ids[a:b].tolist() for a, b in zip(borders, borders[1:])]


def test_runs_of_letters_go_to_the_model_alone():
    table, sent = WordIds(PATH), []

    class Recorded:
        def __getattr__(self, name):
            return getattr(WordIds(PATH).tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return Tokenizer.from_file(PATH).encode_batch_fast(texts, **options)

    table.tokenizer = Recorded()
    texts = ["Plain words, Éclairs ÜBER straße ÿ", "naïve x 12"]
    assert encoded(table, texts) == expected(texts)
    assert sorted(table.separator.join(sent).split(table.separator)) == [",", "12"]


def test_words_as_the_library_splits_them():
    r = random.Random(7)
    letters = "aB'sS tT9.,!<|>éÉßẞñÿŸ×÷ªº中\u0301\u0308Σς İ\n\t\r\x0b%#&*()x0  'llre"
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)] + ["", " ", " \n lead", "trail \n", "E\u0301x", "<|startoftext|>A<|ENDOFTEXT|>"]
    assert encoded(WordIds(PATH), texts) == expected(texts)


def test_wide_and_narrow_ids_are_ranked_alike():
    x = np.random.default_rng(2).zipf(1.5, 3_000_000) % 50_000
    by_rank, ranks = rank_ids(x.astype(np.uint32))
    wide, same = rank_ids((x + (1 << 31)).astype(np.uint32))
    assert ranks.dtype == np.uint16 and (ranks == same).all() and (by_rank == wide - (1 << 31)).all() and (by_rank[ranks] == x).all()


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op6_id_files"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    start = 0
    for d, ids in zip(docs, expected([d.text for d in docs])):
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_rows(spark):
    rows = [(5, "five"), (None, None), (3, ""), (3, "three and more"), (3, "three and more"), (-1, "x " * 30000), (9, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("part", F.lit("clash")).repartition(4)
    path = shared_path(spark, "odd")
    write_ids(df, path, PATH)
    got = read_ids(id_files(df, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -1, 3, 3, 3, 5, 9]
    want = sorted(zip([(d is not None, d or 0) for d, _ in rows], expected([t for _, t in rows])))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    path = shared_path(spark, "none")
    write_ids(df.limit(0), path, PATH)
    assert read_ids(id_files(df, path)).count() == 0


def test_few_segments_of_many_blocks(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('a', id % 7, ' '), 50) AS text").repartition(5)
    path = shared_path(spark, "few")
    write_ids(df, path, PATH)
    most = int(spark.conf.get("spark.sql.shuffle.partitions")) // 2
    assert 1 <= id_files(df, path).count() <= max(1, most)
    got = read_ids(id_files(df, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(4000)) and [r.start for r in got[:2]] == [0, got[0].n_tokens]
