"""Quality rules on tokeniser fertility: how public vocabularies cut a text."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.session import stage_table

from .words import find_words, hash_words, lean, mix, text_slices, worker_table

SYMBOLS = "#*$%&|<>"
# The measures hold some 50 bytes for each byte of a slice, besides the vocabularies.
SLICE_BYTES = 1 << 20
MEASURES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")
LEVELS = (["language", "size_class"], ["language"], ["script"], [])
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hangul")
_KINDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_piece", pa.float64()), ("chars_per_byte_token", pa.float64()), ("fallback_share", pa.float64()), ("entropy", pa.float64())]


class Vocabularies:
    """Pieces of each distinct word under a SentencePiece model with byte fallback and a byte-level BPE, remembered by hash."""

    def __init__(self, pieces: str, ranks: str, pattern: str, keep: int = 500_000):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pointer, self.flat, self.bytes_ = np.zeros(1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int32)

    def rows_of(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each sorted distinct key; starts and ends: one occurrence of each."""
        if len(self.keys) > self.keep:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.empty(len(keys), np.int64)
        out[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            pieces = self.model.encode(words, num_threads=1)
            # a word inside a text follows a space; the first one of a text counts alike
            self.bytes_ = np.concatenate((self.bytes_, np.fromiter((len(self.bpe.encode_ordinary(" " + w)) for w in words), np.int32, len(words))))
            out[new] = len(self.pointer) - 1 + np.arange(len(new))
            self.pointer = np.concatenate((self.pointer, self.pointer[-1] + np.cumsum([len(p) for p in pieces])))
            self.flat = np.concatenate((self.flat, np.fromiter((i for p in pieces for i in p), np.uint16)))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.keys, self.rows = merged[order], np.concatenate((self.rows, out[new]))[order]
        return out


def _vocabularies(pieces: str, ranks: str, pattern: str) -> Vocabularies:
    return worker_table(f"fertility:{pieces}:{ranks}", lambda: Vocabularies(pieces, ranks, pattern))


def repeated_words(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5) -> np.ndarray:
    """Words of each row in windows of ``width`` words that the row holds at least twice."""
    n = len(hashes)
    if n < width:
        return np.zeros(n_rows, np.int64)
    last = n - width + 1
    window = mix(row[:last].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        window = mix(window ^ hashes[k : k + last]) if k == 0 else mix(window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + last])
    whole = np.flatnonzero(row[:last] == row[width - 1 :])
    window = window[whole]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = np.zeros(len(ordered) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice = whole[order[same[:-1] | same[1:]]]
    cover = np.zeros(n + 1, np.int64)
    cover[twice] += 1
    cover[twice + width] -= 1
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n_rows)


def duplicate_lines(text: str, white: str = " \t\n\x0b\x0c\r") -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(white)]
    return len(lines) - len(set(lines))


def _entropy(ids: np.ndarray, row: np.ndarray, n_rows: int, per_row: np.ndarray) -> np.ndarray:
    """Bits per token of the distribution of ids within each row."""
    pairs = np.sort((row.astype(np.uint64) << np.uint64(16)) | ids)
    if not len(pairs):
        return np.zeros(n_rows)
    edge = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    count = np.diff(np.append(edge, len(pairs))).astype(np.float64)
    owner = (pairs[edge] >> np.uint64(16)).astype(np.int64)
    share = count / per_row[owner]
    return np.bincount(owner, weights=-share * np.log2(share), minlength=n_rows)


def _measure(pieces: str, ranks: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabularies(pieces, ranks, pattern)
        symbol = np.zeros(256, dtype=bool)
        symbol[list(SYMBOLS.encode())] = True
        for batch in batches:
            names = batch.schema.names
            document = batch.column(names.index("document"))
            text = batch.column(names.index("t")) if "t" in names else document.field("text")
            for a, b, data, offsets in text_slices(text, SLICE_BYTES):
                n = b - a
                sizes = np.diff(offsets)
                starts, ends, row = find_words(data, offsets)
                hashes = hash_words(data, starts, ends)
                code_points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                n_words = np.bincount(row, minlength=n)
                chars = np.bincount(row, weights=code_points[ends] - code_points[starts], minlength=n).astype(np.int64)
                marks = np.concatenate(([0], np.cumsum(symbol[data])))
                symbols = marks[offsets[1:]] - marks[offsets[:-1]]
                texts = [t or "" for t in text.slice(a, n).to_pylist()]
                lines = np.fromiter(map(duplicate_lines, texts), np.int64, n)
                keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                words = known.rows_of(keys, data, starts[first], ends[first])[inverse]
                counts = known.pointer[words + 1] - known.pointer[words]
                tokens = np.bincount(row, weights=counts, minlength=n).astype(np.int64)
                before = np.cumsum(counts) - counts
                ids = known.flat[np.repeat(known.pointer[words] - before, counts) + np.arange(int(counts.sum()))]
                owner = np.repeat(row, counts)
                some = np.maximum(tokens, 1)
                coarse = np.maximum(np.bincount(row, weights=known.bytes_[words], minlength=n), 1)
                fallback = np.bincount(owner, weights=known.byte[ids], minlength=n) / some
                columns = [n_words, chars, symbols, lines, repeated_words(hashes, row, n), tokens, chars / some, chars / coarse, fallback, _entropy(ids, owner, n, some)]
                arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, _KINDS)]
                language, script = (batch.column(names.index(k)).slice(a, n) for k in ("language", "script"))
                yield pa.RecordBatch.from_arrays([document.slice(a, n), language, script, *arrays], names=["document", "language", "script", *[k for k, _ in _KINDS]])

    return run


def _script() -> Column:
    """The script that most letters are of."""
    # all letters of this block are Latin, so that one search leaves of most texts nothing that could be of another script
    rest = F.regexp_replace("text", "[\\x00-\\x{24F}]+", "")
    names = F.array(*[F.lit(name) for name in SCRIPTS])
    others = "[" + "".join(f"\\p{{Is{name}}}" for name in SCRIPTS if name != "Latin") + "]"
    latin = F.when(F.col("text").rlike("\\p{IsLatin}"), F.lit("Latin"))

    def most(t: Column) -> Column:
        letters = F.array(*[F.char_length(F.regexp_replace(F.col("text") if name == "Latin" else t, f"[^\\p{{Is{name}}}]+", "")) for name in SCRIPTS])
        return F.get(F.transform(F.array(letters), lambda n: F.get(names, F.array_position(n, F.array_max(n)).cast("int") - 1)), F.lit(0))

    # by a transform each text is searched once for each script
    found = F.transform(F.array(rest), lambda t: F.when(t.rlike(others), most(t)).otherwise(latin))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("none"))


def _language() -> Column:
    """Two-letter language code in lower case (at most 676 of them), null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), "^([a-zA-Z]{2})(?:$|[-_])", 1)), F.lit(""))


def measure(docs: DataFrame, pieces: str, ranks: str, pattern: str, carry: list[str]) -> DataFrame:
    """``document`` (a struct of the columns ``carry``), ``language`` (without a code the script), ``script`` and the measures of every text.

    Words are runs other than U+0020 and U+0009 to U+000D; each is cut by itself. ``chars_per_piece`` (code points per
    SentencePiece token), ``chars_per_byte_token`` (per byte-level BPE token), ``fallback_share`` (tokens that are single
    bytes) and ``entropy`` (bits per token within the text). Null text: no words. A text without tokens measures 0.
    """
    columns = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("document"), _language().alias("code"), _script().alias("script")]
    if "text" not in carry:
        columns.append(F.col("text").alias("t"))
    rows = docs.select(*columns).withColumn("language", F.coalesce("code", "script")).drop("code")
    schema = T.StructType([rows.schema["document"], T.StructField("language", T.StringType()), T.StructField("script", T.StringType()), *[T.StructField(n, T.LongType() if pa.types.is_integer(t) else T.DoubleType()) for n, t in _KINDS]])
    return rows.mapInArrow(lean(_measure(pieces, ranks, pattern)), schema)


def _size() -> Column:
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bands(measured: DataFrame, reach: float = 3.0, floor: float = 0.02, least: int = 20) -> DataFrame:
    """Rejection bands of every measure per language and size class (power of two of the token count).

    Median of all documents that pass the base rules, and ``reach`` times the distance of their quartiles on either side, at least
    ``floor`` of the median (of 1 for the fallback share). A class of fewer than ``least`` documents has no band of its own: ``level``
    0 are the bands of language and size class, 1 of languages, 2 of scripts and 3 of all documents, however few. Quartiles are
    exact over measures on a grid of 0.001, so that partial counts, not documents, meet in a group.
    """
    quartiles = [F.percentile(F.round(m, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(m) for m in MEASURES]
    good = measured.where(~base_failed()).withColumn("size_class", _size())
    groups = None
    for i, keys in enumerate(LEVELS):
        level = good.groupBy(*keys).agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= (least if keys else 1))
        level = level.select(F.lit(i).alias("level"), *[F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in (("language", "string"), ("script", "string"), ("size_class", "int"))], *MEASURES)
        groups = level if groups is None else groups.union(level)

    def reach_of(m: str) -> Column:
        q = F.col(m)
        return reach * F.greatest(q[2] - q[0], F.lit(floor) if m == "fallback_share" else floor * q[1])

    return groups.select("level", "language", "script", "size_class", *[F.struct((F.col(m)[1] - reach_of(m)).alias("low"), (F.col(m)[1] + reach_of(m)).alias("high")).alias(f"{m}_band") for m in MEASURES])


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.

    ``measured`` should be stored: it is read by each level of the bands. A document takes the band of its language and size class,
    else of its language, its script, all documents. The bands are at most 676 languages and 8 scripts by 48 size classes, and are broadcast.
    """
    found = stage_table(bands(measured), "fertility-bands")
    limits = [f"{m}_band" for m in MEASURES]
    at = measured.withColumn("size_class", _size())
    for i, keys in enumerate(LEVELS):
        at = at.join(F.broadcast(found.where(F.col("level") == i).select(*keys, *[F.col(c).alias(f"{c}_{i}") for c in limits])), keys or None, "left")
    kept = ~base_failed()
    for m, c in zip(MEASURES, limits):
        band = F.coalesce(*[F.col(f"{c}_{i}") for i in range(len(LEVELS))])
        # the band of all exists wherever a document passes the base rules
        kept = kept & F.coalesce(F.col(m).between(band["low"], band["high"]), F.lit(False))
    return at.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("size_class", "script", *[f"{c}_{i}" for c in limits for i in range(len(LEVELS))])


def quality_rules(docs: DataFrame, pieces: str, ranks: str, pattern: str, carry: list[str]) -> DataFrame:
    """Every document with its measures, ``base_failed`` and ``kept``.

    ``docs``: ``text``, ``lang`` and the columns ``carry``, which come back as the struct ``document`` and so cannot clash.
    A document is kept if it passes the base rules and every measure lies in the band of its language (without a
    two-letter code: its script) and size class; a class of fewer than 20 documents takes the band of the language,
    a language of fewer that of the script, and a script of fewer that of all documents. Null or empty text: no words, fails the base
    rules. Repeated rows: judged each. An empty table gives no rows. The measured table is stored in the shared folder.
    """
    return judge(stage_table(measure(docs, pieces, ranks, pattern, carry), "fertility"))
