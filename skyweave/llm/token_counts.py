"""Token counts by whole-token shortcut: pre-tokens that are proven single tokens are counted, only the rest is merged."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import worker_table

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_whole bigint, n_merged bigint"
_BREAK = re.compile("[ \n]")
# The split rule of the word vocabulary, on ASCII text in lower case.
_ASCII_RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0da-z0-9]+")
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (chr(256 + i) for i in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


def blocks(text: str, most: int = 1 << 18) -> Iterator[str]:
    """The text in blocks of about ``most`` characters, cut where a space or line feed stands."""
    at = 0
    while len(text) - at > most:
        found = _BREAK.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class TokenCounter:
    """Counts of a byte-level BPE file.

    When it is built, every vocabulary string that may end a pre-token is merged once by the file's own model; those that
    come out as one token are ``proven``. A pre-token among them counts as one without being merged. What is
    left is merged; short ones are remembered, at most ``keep`` of them. ASCII text is split by a compiled rule, words
    with other characters by the file's own normaliser and splitter.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], str(spec["pre_tokenizer"])
        if model["type"] != "BPE" or "ByteLevel" not in steps:
            raise ValueError("token counts take a byte-level BPE file")
        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that depend on their surroundings are not supported")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        end = model.get("end_of_word_suffix") or ""
        merge = self.tokenizer.model.tokenize
        strings = [v[: len(v) - len(end)] for v in model["vocab"] if v.endswith(end)]
        self.proven = frozenset(s for s in strings if s and len(merge(s)) == 1)
        self.by_rule = bool(end) and _WORD_RULE in _patterns(spec["pre_tokenizer"]) and "Lowercase" in str(spec["normalizer"])
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.to_letters = {b: letters[b] for b in range(128)}
        self.proven_ascii = frozenset("".join(chr(back[c]) for c in s) for s in self.proven if all(back.get(c, 128) < 128 for c in s))
        self.merged: dict[str, int] = {}
        self.words: dict[str, tuple[int, int, int]] = {}

    def _merge(self, pre: str) -> int:
        """Tokens of a pre-token in the byte alphabet."""
        n = self.merged.get(pre)
        if n is None:
            n = len(self.tokenizer.model.tokenize(pre))
            if len(pre) <= 64:
                if len(self.merged) >= self.keep:
                    self.merged.clear()
                self.merged[pre] = n
        return n

    def _ascii(self, text: str) -> tuple[int, int, int]:
        pre = _ASCII_RULE.findall(text.lower())
        proven = self.proven_ascii
        rest = [p for p in pre if p not in proven]
        return len(pre) - len(rest), len(rest), sum(self._merge(p.translate(self.to_letters)) for p in rest)

    def _other(self, text: str) -> tuple[int, int, int]:
        """The file's own steps, for text without special tokens."""
        t = self.tokenizer
        plain = t.normalizer.normalize_str(text) if t.normalizer else text
        pre = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(plain)]
        rest = [p for p in pre if p not in self.proven]
        return len(pre) - len(rest), len(rest), sum(map(self._merge, rest))

    def _word(self, word: str) -> tuple[int, int, int]:
        found = self.words.get(word)
        if found is None:
            found = self._other(word)
            if len(word) <= 64:
                if len(self.words) >= self.keep:
                    self.words.clear()
                self.words[word] = found
        return found

    def count(self, text: str) -> tuple[int, int, int]:
        """(pre-tokens counted whole, pre-tokens merged, tokens of all)."""
        whole = merged = tokens = 0

        def add(found: tuple[int, int, int]) -> None:
            nonlocal whole, merged, tokens
            whole += found[0]
            merged += found[1]
            tokens += found[0] + found[2]

        if any(s in text for s in self.special):
            tokens += len(self.cut.findall(text))
            parts = self.cut.split(text)
        else:
            parts = [text]
        for part in parts:
            if not self.by_rule:
                add(self._other(part))
                continue
            for block in blocks(part):
                if block.isascii():
                    add(self._ascii(block))
                    continue
                # the file's rule drops spaces and line feeds and joins nothing over them
                words = [w for line in block.split("\n") for w in line.split(" ")]
                add(self._ascii(" ".join(w for w in words if w.isascii())))
                for w in words:
                    if not w.isascii():
                        add(self._word(w))
        return whole, merged, tokens


def _patterns(step: dict) -> list[str]:
    if step["type"] == "Sequence":
        return [p for s in step["pretokenizers"] for p in _patterns(s)]
    return [step["pattern"]["Regex"]] if step["type"] == "Split" and "Regex" in step["pattern"] and step["invert"] else []


def _count(path: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_table(f"counts:{path}", lambda: TokenCounter(path))
        for batch in batches:
            texts = batch.column(1)
            found = [counter.count(texts[i].as_py() or "") for i in range(batch.num_rows)]
            whole, merged, tokens = (pa.array(c, pa.int64()) for c in zip(*found)) if found else (pa.array([], pa.int64()),) * 3
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            columns = [batch.column(0), sizes, tokens, pc.greater(tokens, limit), whole, merged]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole", "n_merged"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text under a byte-level BPE file of the ``tokenizers`` library.

    Counts are the library's own without added special tokens; the strings of special tokens inside a text count as one token
    each, as by its default. ``n_whole``: pre-tokens counted by the shortcut, ``n_merged``: the others. One pass
    over the rows where they lie, no shuffle; a task holds the vocabulary, a block of 262,144 characters at a time beside the
    text itself, and bounded tables of merged words.

    Null text: empty, 0 tokens. Null ``doc_id``: kept. Repeated rows: counted each. Other columns are not read. An
    empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_count(vocabulary, limit), SCHEMA)
