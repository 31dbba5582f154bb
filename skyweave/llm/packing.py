"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import lean, text_slices, word_ids

# Encoding holds some 20 bytes for each byte of a slice.
SLICE_BYTES = 1 << 20
SCHEMA = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Open windows by fill level.

    ``levels[h]`` counts the open windows filled up to h. A piece goes to the level (0 opens a window) after which the
    sum of squared counts of partly filled levels is least; among equals to the fullest. A window that is full
    leaves. ``finish`` pours the emptiest open windows into the room of the fullest, so that at most one window of the
    stream stays short.
    """

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """The fill level a piece of ``size`` ids goes to."""
        w, n = self.window, self.levels
        after = n[size : w + 1]
        cost = 2 * (after - n[: w - size + 1]) + 2
        cost[0] = 2 * n[size] + 1
        cost[w - size] = 1 - 2 * n[w - size]
        if size == w:
            return 0
        usable = n[: w - size + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return w - size - int(np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> list | None:
        """Place a piece; its window if that is now full."""
        size = len(piece[2])
        level = self.choose(size)
        held = []
        if level:
            held = self.open[level].pop()
            self.levels[level] -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        self.open[level + size].append(held)
        self.levels[level + size] += 1
        return None

    def finish(self) -> Iterator[list]:
        """The windows that are still open, poured together."""
        left = [(level, held) for level in range(self.window, 0, -1) for held in self.open[level]]
        while left:
            level, held = left.pop(0)
            room = self.window - level
            while room and left:
                _, donor = left[-1]
                doc, start, ids, total = donor.pop()
                if len(ids) > room:
                    donor.append((doc, start, ids[: len(ids) - room], total))
                    start, ids = start + len(ids) - room, ids[len(ids) - room :]
                    left[-1] = (left[-1][0] - room, donor)
                else:
                    left[-1] = (left[-1][0] - len(ids), donor)
                held.append((doc, start, ids, total))
                room -= len(ids)
                if not donor:
                    left.pop()
            yield held


def _pack(tokenizer: str, window: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        table, packer = word_ids(tokenizer), Packer(window)
        out: list[tuple] = []
        held_bytes, sequence = 0, 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out), _ARROW)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        def close(pieces: list) -> int:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, ids.tobytes(), total, base + sequence, at))
                at += len(ids)
            sequence += 1
            return 4 * at

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, _, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                flat, borders = table.encode(data, offsets, end_id)
                for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
                    ids, doc = flat[a:b], doc_ids[first + k]
                    whole = (b - a) // window * window
                    for s in range(0, whole, window):
                        held_bytes += close([(doc, s, ids[s : s + window], b - a)])
                    if whole < b - a:
                        # a copy: a slice would keep the whole batch in memory while its window is open
                        full = packer.add((doc, whole, ids[whole:].copy(), b - a))
                        if full:
                            held_bytes += close(full)
                    if held_bytes > 4 << 20:
                        yield flush()
                        held_bytes = 0
        for pieces in packer.finish():
            held_bytes += close(pieces)
            if held_bytes > 4 << 20:
                yield flush()
                held_bytes = 0
        if out:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack whole documents into windows of ``window`` ids; a row per piece with its ids (little-endian 32 bit).

    Every partition is one stream: it is tokenised and packed in one pass without a shuffle, holding only
    the open windows. Full windows of a long text are windows of their own, its rest is an item for the packer; at the end
    of the stream open windows are poured together, which cuts some documents and leaves at most one short window per
    partition. ``sequence_id`` holds the partition in its upper bits; a task that runs again gives the same rows.

    Null and empty text: the end id alone. Null ``doc_id``: kept. Repeated rows: packed each. Other columns are not
    read. An empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(lean(_pack(tokenizer, window, end_id)), SCHEMA)
