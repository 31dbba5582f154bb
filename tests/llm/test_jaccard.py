import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import jaccard_join
from skyweave.llm.jaccard_join import BITS, Sets, _boundary_pairs, _describe, components, drop_near_duplicates, extra, jaccard_components, needed, prefix
from skyweave.llm.queries import ORACLE_SQL, QUERIES
from skyweave.llm.words import text_slices
from tests.oracle_check import compare, connect
import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest id reachable, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for k in s:
            where.setdefault(k, []).append(i)
    done = set()
    for group in where.values():
        for x, i in enumerate(group):
            for j in group[x + 1 :]:
                if (i, j) not in done:
                    done.add((i, j))
                    c = len(sets[i] & sets[j])
                    if 100 * c >= 75 * len(sets[i] | sets[j]):
                        up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((((d is None, d or 0), len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash")).repartition(3)
    return sorted((((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect()), key=str)


def family(r, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, edits)):
            k = r.random()
            i = r.randrange(len(w))
            if k < 0.5:
                w[i] = f"x{r.randrange(10**6)}"
            elif k < 0.75:
                del w[i : i + r.randint(1, 4)]
            else:
                w[i:i] = [f"y{r.randrange(30)}"] * r.randint(1, 3)
            w = w or ["z"]
        out.append(" ".join(w))
    return out


def corpus(seed):
    r = random.Random(seed)
    shared = [f"p{i}" for i in range(60)]
    texts = []
    for f in range(10):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice([3, 6, 12, 40, 90, 200]))]
        if f % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = shared
        texts += family(r, words, r.choice([1, 2, 8, 25]), r.choice([1, 4, 9]))
    texts += [" ".join(shared + [f"s{i}"]) for i in range(6)] + family(r, shared, 12, 3)
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 200, 6)]
    texts += ["", " \t", "One two", "one TWO", "a b c d e", "a b c d", "é É"] + texts[:5]
    r.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[0]), (None, "only here and no other place"), (3, texts[4]), (7, None)]


@pytest.mark.parametrize("seed,nearest", [(1, 2), (2, 0), (3, 1)])
def test_components_match_all_pairs(spark, seed, nearest):
    rows = corpus(seed)
    assert run(spark, rows, nearest=nearest) == brute(rows)


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op9_jaccard"](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).execute(ORACLE_SQL["op9_jaccard"]).df()) is None


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_paths_and_stars(spark):
    r = random.Random(7)
    names = [f"{i:03d}".encode() for i in range(120)]
    r.shuffle(names)
    edges = list(zip(names[:60], names[1:60])) + [(names[60], n) for n in names[61:]]
    got = {bytes(x.node): bytes(x.comp) for x in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == dict.fromkeys(names[:60], min(names[:60])) | dict.fromkeys(names[60:], min(names[60:]))


@pytest.mark.parametrize("seed", range(4))
def test_bound_of_the_boundary(seed):
    r = np.random.default_rng(seed)
    for _ in range(300):
        a = int(r.integers(1, 80))
        b = int(r.integers(-(-a * 75 // 100), a * 100 // 75 + 1))
        most = min(a, b)
        least = next((o for o in range(1, most + 1) if 100 * o >= 75 * (a + b - o)), None)
        if least is None:
            continue
        o = int(r.integers(least, most + 1))
        v = r.permutation(1000)[: a + b - o]
        x, y = np.sort(v[:a]), np.sort(np.concatenate((v[:o], v[a:])))
        for own, other in ((x, y), (y, x)):
            n = np.array([len(own), len(other)])
            q, k = prefix(n, 75), extra(needed(n, 75))[0]
            assert len(set(own[: q[0]]) & set(other[: q[1]])) >= k


def test_sets_are_the_distinct_shingles():
    texts = ["a b c d e f a b c d e f", None, "", "A  b\x0bC", "x" * 5000 + " y", "\U0001f642 b c d e"]
    (_, _, data, offsets), = text_slices(pa.array(texts))
    assert Sets(data, offsets, 5).size.tolist() == [len(shingles(t)) for t in texts]


def test_a_family_is_not_paired_with_itself(spark):
    """Members of a family of near copies that cannot be linked do not meet, and no linked pair is lost."""
    r = random.Random(5)
    sets = []
    for _ in range(400):
        held = list(range(146))
        for _ in range(r.choice([1, 2, 3, 6, 7, 8])):
            i = r.randrange(146)
            held[max(0, i - 4) : i + 1] = [r.getrandbits(62) + 1000 for _ in held[max(0, i - 4) : i + 1]]
        sets.append(set(held[: 146 - r.choice([0, 0, 0, 20, 36])]))
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 75 * len(a | b)}
    rows = [(f"{i:03d}".encode(), len(s), f"c{i:03d}".encode(), sorted(s)) for i, s in enumerate(sets)]
    rest = spark.createDataFrame(rows, "node binary, n bigint, comp binary, shingles array<bigint>")
    pairs = _boundary_pairs(rest, spark.createDataFrame([], "a binary, b binary, d double"), 75).collect()
    got = {tuple(sorted((int(bytes(p.a)), int(bytes(p.b))), reverse=True)) for p in pairs}
    assert linked and linked <= got and len(got) == len(pairs) < 2 * len(linked) + 400


def test_memory_does_not_follow_the_batch():
    r = random.Random(4)
    texts = pa.array([" ".join(f"{r.getrandbits(20):x}" for _ in range(2000)) for _ in range(400)])
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, texts], names=["doc_id", "h1", "h2", "text"])
    tracemalloc.start()
    try:
        assert texts.nbytes > 4 << 20 and sum(out.num_rows for out in _describe(5)(iter([batch]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 120 << 20
    finally:
        tracemalloc.stop()


def test_bitmaps_may_hold_everything(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(jaccard_join, "bitmap", lambda df, column: np.full(BITS >> 6, 2**64 - 1, np.uint64))
    assert run(spark, rows) == brute(rows)


def test_shuffle_files_go_with_each_stored_table(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle")}

    docs = spark.createDataFrame(corpus(5), "doc_id bigint, text string")
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    jaccard_components(docs)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_whole_rows_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} " * 9) for i in range(40)] + [(None, "none")] * 2, "doc_id int, text string")
    out = drop_near_duplicates(docs)
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)", plan)
    assert sum("document#" in x for x in inputs) <= 1 < len(inputs)
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["0", "1", "2", "None"]
