"""Words of whole text columns as numpy arrays, and ids of public word tokenizers.

A column of an Arrow batch is one block of bytes with row offsets, so that words, their hashes and their
ids come from a few passes over the block. Blocks are cut at row borders near ``SLICE_BYTES``: memory is bounded
by that figure, or by a single text beyond it.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
# White space that ends a word in the contracts: U+0020 and U+0009 to U+000D.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_ROW = 64


def _table(white: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(white)] = True
    return out


def _random_rows() -> np.ndarray:
    """64 x 256 odd 64-bit numbers from a fixed seed, the same on every executor."""
    return np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, size=_ROW * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_HASH_ROWS = _random_rows()
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b",.!?;:%&$#*()")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        stop = min(stop, n)
        yield at, stop, raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def _begins(data: np.ndarray, offsets: np.ndarray, white: bytes, at_marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte whether it is in a word and whether it begins one; the bytes after which a mark cuts."""
    inside = ~_table(white)[data]
    first = np.zeros(len(data), dtype=bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) if at_marks else np.zeros(0, np.int64)
    first[cut + 1] = True
    first &= inside
    return inside, first, cut


def find_words(data: np.ndarray, offsets: np.ndarray, white: bytes = WHITE, at_marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it is in. at_marks: also cut between an ASCII letter and a mark."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside, first, cut = _begins(data, offsets, white, at_marks)
    border = offsets[:-1][offsets[:-1] < len(data)]
    last = np.zeros(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[border[border > 0] - 1] = True
    last[cut] = True
    last &= inside
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hash of every word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    where = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
    place = where - np.repeat(starts, lengths)
    values = _HASH_ROWS[((place & (_ROW - 1)) << 8) | data[where]]
    if int(lengths.max()) > _ROW:
        far = np.flatnonzero(place >= _ROW)
        powers = np.cumprod(np.full(int(lengths.max()) // _ROW + 1, _STEP, np.uint64))
        values[far] *= powers[(place[far] >> 6) - 1]
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _STEP)


class WordIds:
    """Ids of a tokenizer that drops white space, word by word, each distinct word encoded once.

    Text is split at U+0020 and U+000A, which such a tokenizer never keeps and never joins over, and between an ASCII
    letter and a following mark, where its pattern always ends a word. ASCII words are lower-cased first, as the tokenizer
    does. What is left is encoded by the library itself. ``separator`` is a special token of the file: it parts
    the words of one call. At most ``keep`` words are remembered.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>", keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        if self.separator_id is None:
            raise ValueError(f"{separator} is no token of {path}")
        self.keep = keep
        self.model = self.tokenizer.model
        self._learn_letters()
        self._clear()

    def _learn_letters(self) -> None:
        """What the model sees of a letter, where the file makes any run of letters one pre-token letter by letter, else nothing.

        Asked of the file's own normalizer and pre-tokenizer; precomposed Latin letters only, which nothing composes with.
        """
        letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if chr(c).isalpha()]
        cut, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer

        def seen(text: str) -> str | None:
            pieces = cut.pre_tokenize_str(normal.normalize_str(text) if normal is not None else text) if cut is not None else []
            return pieces[0][0] if len(pieces) == 1 else None

        alone = [seen(c) for c in letters]
        run = "".join(letters)
        special = any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        proven = not special and all(alone) and all(seen(x) == "".join(map(str, (alone if x is run else alone[::-1]))) for x in (run, run[::-1]))
        self.seen = {ord(c): x for c, x in zip(letters, alone)} if proven else {}
        self.letters = re.compile(f"[{run}]+" if proven else "(?!)")

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.pointer = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of distinct words."""
        run, seen, model = self.letters.fullmatch, self.seen, self.model
        # runs of letters need neither normalizer nor pattern: the file's model merges them at once
        parts: list[list[int] | None] = [[t.id for t in model.tokenize(w.translate(seen))] if run(w) else None for w in words]
        rest = [i for i, p in enumerate(parts) if p is None]
        for i in [i for i in rest if "<|" in words[i]]:
            parts[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
        rest = [i for i in rest if parts[i] is None]
        groups = [rest[i : i + 256] for i in range(0, len(rest), 256)]
        coded = self.tokenizer.encode_batch_fast([self.separator.join([words[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, c in zip(groups, coded):
            ids = c.ids
            at = np.flatnonzero(np.array(ids, dtype=np.uint32) == self.separator_id).tolist()
            if len(at) != len(group) - 1:
                raise RuntimeError("the tokenizer did not keep its separator")
            for i, a, b in zip(group, [-1, *at], [*at, len(ids)]):
                parts[i] = ids[a + 1 : b]
        return np.fromiter(chain.from_iterable(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    def _rows_of(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row in the table of each of the sorted distinct ``keys``; starts and ends: one occurrence of each."""
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
            ids, n = self._encode_new([raw[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            first = len(self.pointer) - 1
            out[new] = first + np.arange(len(new))
            self.flat = np.concatenate((self.flat, ids))
            self.pointer = np.concatenate((self.pointer, self.pointer[-1] + np.cumsum(n)))
            self.keys, self.rows = np.insert(self.keys, at[new], keys[new]), np.insert(self.rows, at[new], out[new])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the border of each row in them."""
        n_rows = len(offsets) - 1
        tail = 0 if end_id is None else 1
        starts = np.flatnonzero(_begins(data, offsets, b" \n", True)[1]) if len(data) else np.zeros(0, np.int64)
        if not len(starts):
            return np.full(n_rows * tail, end_id or 0, np.uint32), np.arange(n_rows + 1, dtype=np.int64) * tail
        # words with the white space behind them lie end to end, so that Arrow finds the equal ones; the rest is done once for each
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        _, edges, raw = words.dictionary.buffers()
        distinct = np.frombuffer(raw, np.uint8)[: np.frombuffer(edges, np.int64)[len(words.dictionary)]]
        first, last, _ = find_words(distinct, np.frombuffer(edges, np.int64)[: len(words.dictionary) + 1], b" \n")
        # "<" may begin a special token, which counts in its own case; beyond ASCII lower-casing belongs after composing
        odd = np.logical_or.reduceat((distinct >= 128) | (distinct == ord("<")), first)
        distinct = np.where(np.repeat(odd, np.diff(np.append(first, len(distinct)))), distinct, _LOWER[distinct])
        keys, one, inverse = np.unique(hash_words(distinct, first, last), return_index=True, return_inverse=True)
        rows = self._rows_of(keys, distinct, first[one], last[one])[inverse][words.indices.to_numpy()]
        counts = self.pointer[rows + 1] - self.pointer[rows]
        before = np.concatenate(([0], np.cumsum(counts)))
        borders = before[np.searchsorted(starts, offsets)] + np.arange(n_rows + 1) * tail
        ids = self.flat[np.repeat(self.pointer[rows] - before[:-1], counts) + np.arange(before[-1])]
        if not tail:
            return ids, borders
        out = np.full(int(borders[-1]), end_id, np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[borders[1:] - 1] = False
        out[keep] = ids
        return out, borders


def give_back() -> None:
    """What the process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the GNU C library keeps it else
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task; at its end the worker gives back what it has freed.

    Workers outlive their tasks, and an executor holds the memory of all of them beside its own.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def worker_table(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept as long as the Python worker lives or until another key is asked for.

    Functions sent by value bring no globals that last, so it is held by a module. One table at a time: a worker that goes on
    to another operator must not hold the tables of all of them.
    """
    held = sys.modules.setdefault("skyweave_worker_table", types.ModuleType("skyweave_worker_table")).__dict__
    if held.get("key") != key:
        held["key"] = held["table"] = None
        held["key"], held["table"] = key, make()
    return held["table"]


def word_ids(path: str) -> WordIds:
    """The worker's table of a tokenizer file; results do not depend on it."""
    return worker_table(f"ids:{path}", lambda: WordIds(path))
