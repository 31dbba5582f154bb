"""Packing against the contract and a brute-force choice of levels."""

import os
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyweave.llm.packing import SLICE_BYTES, Packer, pack_documents
from skyweave.llm.queries import QUERIES
from skyweave.llm.words import lean, text_slices, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(1, "alpha beta"), (2, None), (3, ""), (4, "word, " * 9000), (4, "word, " * 9000), (None, "no id <|endoftext|> É É Kİ\x1cx\u0085y"), (5, "  \n\n ")]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, want_by_doc, window=2048):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert set(by_doc) == set(want_by_doc)
    for doc, ids in want_by_doc.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return by_seq


def test_query_holds_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], expected([d.text for d in docs])))
    by_seq = check(QUERIES["op1_packing"](spark, sf_dir).collect(), want)
    assert len(by_seq) * 2048 - sum(map(len, want.values())) < 2048


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("start", F.lit("clash")).coalesce(1)
    rows = pack_documents(df, PATH, window=64).collect()
    want = expected([t for _, t in ROWS])
    assert sum(len(r.ids) for r in rows) == 4 * sum(map(len, want))
    assert sorted((r.doc_id, r.ids) for r in rows if r.doc_id == 2) == [(2, np.array([1], "<u4").tobytes())]
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + len(r.ids) // 4
    assert sum(v < 64 for v in fill.values()) <= 1
    again = pack_documents(df, PATH, window=64).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_choice_is_the_least_sum_of_squares(seed):
    rng, w = np.random.default_rng(seed), 20
    p = Packer(w)
    for _ in range(400):
        size = int(rng.integers(1, w))
        best = None
        for h in [0, *[h for h in range(1, w - size + 1) if p.levels[h]]]:
            n = p.levels.copy()
            n[h] -= h > 0
            n[h + size] += h + size < w
            key = (int((n[1:w] ** 2).sum()), -h)
            best = min(best or (key, h), (key, h))
        assert p.choose(size) == best[1]
        p.add((0, 0, np.zeros(size, np.uint32), size))


def test_encoding_holds_little_beside_a_large_batch():
    r = np.random.default_rng(5)
    words = np.char.add("w", r.integers(0, 20_000, 1_000_000).astype(str))
    texts = [" ".join(w) for w in np.array_split(words, 100)] * 4
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    table = word_ids(PATH)
    tracemalloc.start()
    try:
        for _, _, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
            table.encode(data, offsets, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 19 MB, slices of 4 MB took 76 MB
    assert peak < 40 << 20


def test_a_task_gives_back_what_it_freed():
    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    pinned = []

    def run(batches):
        held = [np.ones(12_000) for _ in range(3000)]
        # what is above the rest keeps the heap from shrinking by itself
        pinned.append(held.pop())
        held.clear()
        yield from batches

    before = resident()
    assert list(lean(run)(iter("ab"))) == ["a", "b"]
    assert resident() - before < 100 << 20
