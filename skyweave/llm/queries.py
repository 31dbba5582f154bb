"""Registered queries of the operators over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.session import shared_path

from .fertility import quality_rules
from .hard_negatives import mine
from .id_coder import id_files, read_ids, write_ids
from .jaccard_join import jaccard_components
from .licences import scan
from .line_templates import drop_recurring_lines
from .merkle import build_manifest
from .mixing import mix
from .packing import pack_documents
from .page_diff import extract_pages
from .shards import shard_documents
from .token_counts import count_tokens
from .topk import top_k

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_digest(df: DataFrame) -> DataFrame:
    """``length`` and ``ids_crc32`` in place of the ids."""
    return df.withColumn("length", (F.octet_length("ids") / 4).cast("bigint")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return id_digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query(
    "op10_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
    )
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


@query("op7_page_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_shared")


def vocabularies() -> dict[str, str]:
    """The public vocabularies of the quality rules."""
    return {"pieces": public_tokenizers.path("piece_bpe_32k.model"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query("op3_fertility")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility and verdict of every document."""
    judged = quality_rules(table(spark, sf_dir, "documents"), **vocabularies(), carry=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("document.doc_id", *counts, "base_failed", "kept", "language", "n_tokens", "chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 3 : 1 : 2 by source, 150 % of all words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op9_jaccard",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents
    ), s AS (
      SELECT doc_id, v, CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
        ELSE list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) END AS h FROM w
    ), n AS (SELECT doc_id, CAST(len(h) AS BIGINT) AS n_shingles FROM s),
    e AS (SELECT doc_id, unnest(h) AS k FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
    r AS (SELECT doc_id, doc_id AS o FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o)
    SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under shingle similarity of 0.75."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_line_templates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines of templates that recur across documents."""
    found = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("document.doc_id", "text", "n_lines", "n_dropped")


@query("op4_licences")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    return scan(table(spark, sf_dir, "documents")).drop("body")


@query("op6_id_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as coded id files and read back."""
    path = shared_path(spark, "id-files")
    docs = table(spark, sf_dir, "documents")
    write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(id_files(docs, path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op12_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
    ), p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), n AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    )
    SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the five nearest positives of every row whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(table(spark, sf_dir, "embeddings").withColumn("label", label), anchors=F.col("vec_id") % 50 == 0)
    return found.drop("place")


@query(
    "op13_merkle_manifest",
    """
    WITH RECURSIVE f AS (
      SELECT doc_id, source, text,
        concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
          coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
        -- crc32 of the decimal id: per byte eight shifts, 3988292384 = 0xEDB88320
        list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS c
      FROM documents
    ), l AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(c, 4294967295) % 5 = 0
          THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
      FROM f
    ), o AS (
      SELECT *, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l
    ), v AS (
      SELECT tree, 0 AS level, place, n, leaf AS h FROM o
      UNION ALL
      SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM v WHERE n > 1 GROUP BY tree, level, place // 16, n
    ), s AS (
      SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM v WHERE n = 1
    ), w AS (
      SELECT 0 AS level, place, n, h FROM s
      UNION ALL
      SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM w WHERE n > 1 GROUP BY level, place // 16, n
    ), x AS (
      SELECT tree, level, place,
        coalesce(string_agg(h, '' ORDER BY place) OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(h, '' ORDER BY place) OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
      FROM (SELECT tree, level, place, h FROM v UNION ALL SELECT '' AS tree, level, place, h FROM w)
    ), p AS (
      SELECT doc_id, leaf, tree, 0 AS level, place, n, coalesce(changed, leaf) AS h, '' AS q FROM o
      UNION ALL
      SELECT doc_id, leaf, p.tree, p.level + 1, p.place // 16, (n + 15) // 16, sha256(a || h || b), q || a || b FROM p JOIN x ON x.tree = p.tree AND x.level = p.level AND x.place = p.place WHERE n > 1
    ), t AS (
      SELECT doc_id, leaf, s.h AS subroot, 0 AS level, s.place, s.n, p.h, q FROM p JOIN s ON s.tree = p.tree WHERE p.n = 1
      UNION ALL
      SELECT doc_id, leaf, subroot, t.level + 1, t.place // 16, (n + 15) // 16, sha256(a || h || b), q || a || b FROM t JOIN x ON x.tree = '' AND x.level = t.level AND x.place = t.place WHERE n > 1
    )
    SELECT doc_id, leaf, subroot, w.h AS root, sha256(q) AS proof_sha256, t.h AS folded_root, t.h = w.h AS verified FROM t, w WHERE t.n = 1 AND w.n = 1
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered fifth folds to."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    met = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower).otherwise(F.col("text"))
    proved = build_manifest(table(spark, sf_dir, "documents"), found={"text": met}).prove()
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
