"""Token-id files under an adaptive context-mixing range coder, in blocks that stand alone.

A segment's header ranks its ids by frequency. The model of a block, reset at the block's start, has two predictors that name an id
each: order 2 (the id that last followed these two ids) and order 1 (that last followed this one). The coded symbol says which of them is
right, or else the class of the next id's rank, which is the order-0 prediction; the place in the class follows in plain bits. The
distribution of the symbol is a mixture of three adaptive ones, in contexts of order 2, 1 and 0; the one that has predicted best of late
counts twice. All arithmetic is on integers, so that every machine decodes alike.

Blocks do not depend on each other, so numpy codes many of them in step: one operation handles one id of each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import text_slices, word_ids

MAGIC, VERSION = b"IDCM", 2
# A step costs much the same for few lanes as for many: a segment holds as many as memory allows.
BLOCK, LANES = 2048, 8192
# Encoding holds some 20 bytes for each byte of a slice.
SLICE_BYTES = 1 << 20
CHUNK = 1 << 20
SYMBOLS, TOTAL, FLOOR = 8, 1 << 14, 24
# Symbols 0 and 1: order 2, order 1. Symbols 2 to 7: classes of ranks, by first rank and bits.
WIDTH = np.array([3, 5, 7, 9, 11, 16], dtype=np.uint64)
FIRST = np.concatenate(([0], np.cumsum(2 ** WIDTH[:-1].astype(np.int64))))
# The same by symbol: the predicted ids take no plain bits.
_PLAIN = np.concatenate((np.zeros(2, np.uint64), WIDTH))
_BASE = np.concatenate((np.zeros(2, np.uint32), FIRST.astype(np.uint32)))
_CLASS = (np.searchsorted(FIRST, np.arange(1 << 16), "right") + 1).astype(np.uint8)
# Upper ends of the symbols' shares, the last one always the total. An update moves them towards those that give all but a floor to the symbol seen.
_K = np.arange(1, SYMBOLS + 1)
_TARGET = np.where(_K[None, :] <= np.arange(SYMBOLS)[:, None], _K[None, :] * FLOOR, TOTAL - (SYMBOLS - _K[None, :]) * FLOOR).astype(np.int16).view(np.complex128).ravel()
_START = (_K * (TOTAL // SYMBOLS)).astype(np.int16)
_LOG = np.array([0, *[v.bit_length() * 16 + ((v << 4 >> v.bit_length() - 1) & 15) for v in range(1, TOTAL + 1)]], dtype=np.int16) * np.int16(16)
_BITS = 16
_MASK = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_SLOTS = np.array([[11], [10]])
_CONTEXT = np.array([[1], [3]], dtype=np.uint32)
_ONES = np.uint64(0x0101010101010101)
# Of a slot by how sure it is, and 8 more where it was right: whether it stays, and what is added then.
_STAYS = np.arange(16) >= 2
_SURER = np.array([0, 0, *[-((s + 1) >> 1) for s in range(2, 8)], *[1] * 7, 0]).astype(np.uint32)


class Model:
    """State of the model of ``lanes`` blocks. A predictor's slot holds a rank and, in its last three bits, how sure it is.

    Order 2 and order 1 are the two rows of one array wherever both take the same step. An empty slot holds a rank that no id has.
    """

    def __init__(self, lanes: int):
        place = np.arange(lanes)
        self.slots = np.full(lanes * int((1 << _SLOTS).sum()), 0xFFFFFFF8, np.uint32)
        self.first_slot = (place << _SLOTS) + np.array([[0], [lanes << int(_SLOTS[0, 0])]])
        self.last, self.before, self.symbol = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.intp)
        # a context's distribution is eight 16-bit numbers; as one record it is read and written at once
        self.cdf, self.cdf0 = (np.tile(_START, n).view(np.complex128) for n in (lanes * 80, lanes))
        self.first_row = np.stack((place * 16, lanes * 16 + place * 64))
        self.held = np.empty(3 * lanes, np.complex128)
        # a zero in front, so that the share of a row's first symbol begins at the end before it: a row ends at 65,536, which is 0 in 16 bits
        self.ends = np.zeros(lanes * SYMBOLS + 1, np.uint16)
        self.score = np.zeros(3 * lanes, np.int16)
        self.flat = place * SYMBOLS
        self.place = place

    def predict(self, n: int) -> np.ndarray:
        """The mixed distribution of the symbol of the first n lanes (upper ends in 65,536ths, the last one 0 for all of them)."""
        last = self.last[:n]
        key = last * np.uint32(2654435761)
        self.at = at = np.empty((2, n), np.intp)
        at[0] = (key ^ self.before[:n] * np.uint32(2246822519)) >> np.uint32(32 - _SLOTS[0, 0])
        at[1] = key >> np.uint32(32 - _SLOTS[1, 0])
        at += self.first_slot[:, :n]
        self.v = v = self.slots.take(at)
        self.s, self.p = v & np.uint32(7), v >> np.uint32(3)
        self.row = row = self.first_row[:, :n] + (self.s << _CONTEXT)
        row[0] += self.p[0] == self.p[1]
        row[1] += self.symbol[:n]
        held = self.held[: 3 * n]
        self.cdf.take(row, out=held[: 2 * n].reshape(2, n), mode="clip")
        held[2 * n :] = self.cdf0[:n]
        self.c = held.view(np.int16)
        two, one, none = self.score.reshape(3, -1)[:, :n]
        best = (two < np.maximum(one, none)) * (2 * n - n * (one >= none)) + self.place[:n]
        c = held.view(np.uint16).reshape(3, n * SYMBOLS)
        mixed = self.ends[1 : n * SYMBOLS + 1]
        np.add(held.take(best).view(np.uint16), c[0], out=mixed)
        mixed += c[1]
        mixed += c[2]
        return mixed.reshape(n, SYMBOLS)

    def interval(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each symbol's share."""
        self.seen = at = self.flat[: len(symbol)] + symbol
        low = self.ends.take(at)
        return low, self.ends.take(at + 1) - low

    def learn(self, ranks: np.ndarray, right: np.ndarray, symbol: np.ndarray) -> None:
        """``right``: which of the two predictors named the rank."""
        n, c = len(ranks), self.c
        at = (self.seen + np.arange(0, 3 * n * SYMBOLS, n * SYMBOLS)[:, None]).ravel()
        # the total is 0 in these bits, so that the first symbol's share begins at the end before it
        width = (c.take(at) - c.take(at - 1)) & np.int16(TOTAL - 1)
        score = self.score.reshape(3, -1)[:, :n]
        score += (_LOG.take(width).reshape(3, n) - score) >> 4
        c = c.reshape(3, n * SYMBOLS)
        c += (_TARGET.take(symbol).view(np.int16) - c) >> 4
        held = self.held[: 3 * n]
        self.cdf[self.row.ravel()] = held[: 2 * n]
        self.cdf0[:n] = held[2 * n :]
        # right: surer; wrong: half as sure, and replaced once that is not enough
        how = (right << np.uint32(3)) + self.s
        self.slots[self.at] = np.where(_STAYS.take(how), self.v + _SURER.take(how), (ranks << np.uint32(3)) + np.uint32(1))
        self.before[:n] = self.last[:n]
        self.last[:n] = ranks
        self.symbol[:n] = symbol


def _shift(low: np.ndarray, range_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose range has shrunk to 32 bits, and their ``low``: a range over a border of its upper half is cut there."""
    go = np.flatnonzero(range_ <= _MASK)
    lo, rg = low.take(go), range_.take(go)
    over = (lo ^ (lo + rg - np.uint64(1))) > _MASK
    range_[go] = np.where(over, (np.uint64(0) - lo) & _MASK, rg) << _32
    low[go] = lo << _32
    return go, lo >> _32


def encode_blocks(ranks: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` ranks (below 65,536), each coded alone; the last one may be shorter."""
    lanes = -(-len(ranks) // BLOCK)
    table = np.zeros((BLOCK, lanes), np.uint16)
    full = len(ranks) // BLOCK
    table[:, :full] = ranks[: full * BLOCK].reshape(full, BLOCK).T
    table[: len(ranks) - full * BLOCK, full:] = ranks[full * BLOCK :, None]
    tail = len(ranks) - (lanes - 1) * BLOCK
    model = Model(lanes)
    low, range_ = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    # a step adds 32 bits at most, the end 64
    size = BLOCK + 4
    out, begin = np.zeros(lanes * size, np.uint32), np.arange(lanes) * size
    used = begin.copy()
    for t in range(BLOCK if lanes > 1 else tail * lanes):
        n = lanes if t < tail else lanes - 1
        now = table[t, :n].astype(np.uint32)
        model.predict(n)
        right = model.p == now
        symbol = _CLASS.take(now)
        np.copyto(symbol, 1, where=right[1])
        np.copyto(symbol, 0, where=right[0])
        symbol = symbol.astype(np.intp)
        start, width = model.interval(symbol)
        lo, rg = low[:n], range_[:n]
        unit = rg >> np.uint64(_BITS)
        lo += unit * start
        np.multiply(unit, width, out=rg)
        rg >>= _PLAIN.take(symbol)
        lo += rg * ((now - _BASE.take(symbol)) * (symbol > 1)).astype(np.uint32)
        go, word = _shift(lo, rg)
        to = used.take(go)
        out[to] = word
        used[go] = to + 1
        model.learn(now, right, symbol)
    for _ in range(2):
        out[used] = low >> _32
        used += 1
        low <<= _32
    return [out[a:b].astype("<u4").tobytes() for a, b in zip(begin.tolist(), used.tolist())]


def decode_blocks(blocks: list[bytes], total: int) -> np.ndarray:
    """The ranks of ``encode_blocks``."""
    lanes = len(blocks)
    if lanes != -(-total // BLOCK):
        raise ValueError("blocks are missing")
    tail = total - (lanes - 1) * BLOCK
    # all blocks' words end to end, two zeros behind for what a block reads beyond its end
    words = np.frombuffer(b"".join([*blocks, bytes(8)]), "<u4")
    used = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blocks])))[:-1].astype(np.intp)
    table = np.zeros((BLOCK, lanes), np.uint16)
    model = Model(lanes)
    low, range_ = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    code = (words[used].astype(np.uint64) << _32) | words[used + 1]
    used += 2
    for t in range(BLOCK if lanes > 1 else tail * lanes):
        n = lanes if t < tail else lanes - 1
        mixed = model.predict(n)
        lo, rg, cd = low[:n], range_[:n], code[:n]
        unit = rg >> np.uint64(_BITS)
        left = cd - lo
        place = np.minimum(left // unit, np.uint64((1 << _BITS) - 1)).astype(np.uint16)
        # ends at or below the place, the last one (0) aside, counted by bytes
        passed = (mixed <= place[:, None]).view(np.uint64).ravel()
        symbol = ((passed * _ONES) >> np.uint64(56)).astype(np.intp)
        symbol -= 1
        start, width = model.interval(symbol)
        start = unit * start
        lo += start
        left -= start
        np.multiply(unit, width, out=rg)
        bits = _PLAIN.take(symbol)
        rg >>= bits
        place = np.minimum(left // rg, (np.uint64(1) << bits) - np.uint64(1))
        lo += rg * place
        now = _BASE.take(symbol) + place.astype(np.uint32)
        np.copyto(now, model.p[1], where=symbol == 1)
        np.copyto(now, model.p[0], where=symbol == 0)
        table[t, :n] = now
        go, _ = _shift(lo, rg)
        at = used.take(go)
        code[go] = (cd.take(go) << _32) | words.take(at, mode="clip")
        used[go] = at + 1
        model.learn(now, model.p == now, symbol)
    return table.T.ravel()[:total]


def _each(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table.take(at)``, by chunks: an index takes 64 bits while it is used."""
    out = np.empty(len(at), table.dtype)
    for i in range(0, len(at), CHUNK):
        out[i : i + CHUNK] = table.take(at[i : i + CHUNK])
    return out


def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, the most frequent first (ties: the smaller), and each id's place among them."""
    if len(ids) and (top := int(ids.max())) < CHUNK:
        # ids of a vocabulary are counted in place, wider ones are sorted
        at, count = ids, sum(np.bincount(ids[i : i + CHUNK], minlength=top + 1) for i in range(0, len(ids), CHUNK))
        distinct = values = np.flatnonzero(count)
        count = count[distinct]
    else:
        distinct, at, count = np.unique(ids, return_inverse=True, return_counts=True)
        values = np.arange(len(distinct))
    if len(distinct) > 1 << 16:
        raise ValueError("more than 65,536 distinct ids in a segment")
    order = np.lexsort((distinct, -count))
    place = np.zeros(int(values[-1]) + 1 if len(values) else 0, np.uint16)
    place[values[order]] = np.arange(len(order))
    return distinct[order].astype(np.uint32), _each(place, at)


_HEAD = "<4sHIQQII"


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header and document table under one checksum, then the blocks, each under its own.

    Little-endian. Header: magic, version, ids per block, documents, ids, blocks, distinct ids. Table: a byte per document that
    is 0 for a null doc_id, the doc_ids (64 bit), the numbers of ids (64 bit), the distinct ids by rank (32 bit), then per block its bytes
    and crc32 (32 bit each). crc32 of all that. Blocks.
    """
    total = len(ids)
    by_rank, ranks = rank_ids(ids)
    del ids
    blocks = encode_blocks(ranks)
    head = struct.pack(_HEAD, MAGIC, VERSION, BLOCK, len(doc_ids), total, len(blocks), len(by_rank))
    head += bytes(d is not None for d in doc_ids)
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<i8").tobytes() + by_rank.astype("<u4").tobytes()
    head += np.array([[len(b), zlib.crc32(b)] for b in blocks], "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def read_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and ids of a segment; ValueError where a checksum fails."""
    fixed = struct.calcsize(_HEAD)
    magic, version, block, docs, total, count, distinct = struct.unpack(_HEAD, raw[:fixed])
    if (magic, version, block) != (MAGIC, VERSION, BLOCK):
        raise ValueError("no id file of this version")
    end = fixed + 17 * docs + 4 * distinct + 8 * count
    if zlib.crc32(raw[:end]) != struct.unpack("<I", raw[end : end + 4])[0]:
        raise ValueError("the header is damaged")
    known, at = raw[fixed : fixed + docs], fixed + docs
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    lengths = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    by_rank = np.frombuffer(raw, "<u4", distinct, at + 16 * docs)
    blocks, at = [], end + 4
    for i, (size, crc) in enumerate(np.frombuffer(raw, "<u4", 2 * count, end - 8 * count).reshape(-1, 2).tolist()):
        blocks.append(raw[at : at + size])
        at += size
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {i} is damaged")
    return [d if k else None for d, k in zip(doc_ids, known)], lengths, _each(by_rank, decode_blocks(blocks, total))


_FILE = "part bigint, first bigint, n_docs bigint, n_ids bigint, segment binary"
_DOCS = "part bigint, doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _encode(tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part = word_ids(tokenizer), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = first = 0

        def joined() -> np.ndarray:
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            held.clear()
            return ids

        def flush() -> pa.RecordBatch:
            nonlocal size, first
            raw = write_segment(doc_ids, np.array(lengths, np.int64), joined())
            batch = pa.RecordBatch.from_pydict({"part": [part], "first": [first], "n_docs": [len(doc_ids)], "n_ids": [size], "segment": pa.array([raw], pa.binary())})
            first += size
            size = 0
            for x in (doc_ids, lengths):
                x.clear()
            return batch

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                ids, borders = table.encode(data, offsets, end_id)
                at = 0
                while at < b - a:
                    room = borders[at] + LANES * BLOCK - size
                    stop = max(at + 1, int(np.searchsorted(borders, room, "right")) - 1)
                    doc_ids += names[a + at : a + stop]
                    lengths += np.diff(borders[at : stop + 1]).tolist()
                    held.append(ids[borders[at] : borders[stop]].copy())
                    size += int(borders[stop] - borders[at])
                    at = stop
                    if size >= LANES * BLOCK * 0.9:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            doc_ids, lengths, ids = read_segment(row["segment"])
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for s in range(0, len(doc_ids), 2000):
                some = slice(s, s + 2000)
                own = [bytes(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends[some].tolist(), lengths[some].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"part": [row["part"]] * len(own), "doc_id": pa.array(doc_ids[some], pa.int64()), "start": pa.array(row["first"] + ends[some] - lengths[some]), "n_tokens": pa.array(lengths[some]), "ids": pa.array(own, pa.binary())}
                )


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode all documents, each with the end id, in ascending ``doc_id`` order into id files at ``path``.

    Documents are dealt to range partitions by id (and text, for repeated ids), sorted, tokenised and coded in segments of at most
    about sixteen million ids; there are half as many partitions as a shuffle has, because segments of more blocks are coded with less
    work an id. A file is a Parquet table of segments, so that any store Spark writes to will do. Null text: the end id alone. Null
    ``doc_id``: first. Repeated rows: written each. Other columns are not read.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id), _FILE).write.parquet(path)


def read_ids(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian 32 bit) of a table of segments.

    Every checksum is verified. The ids before a partition are a running sum over one row per partition.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = docs.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = docs.select("part", "first", "segment").mapInArrow(_decode, _DOCS)
    return found.join(F.broadcast(base), F.col("part") == F.col("of")).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def id_files(docs: DataFrame, path: str) -> DataFrame:
    """The table of segments at ``path``."""
    return docs.sparkSession.read.schema(_FILE).parquet(path)
