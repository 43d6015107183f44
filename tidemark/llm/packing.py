"""Best-fit packing of token sequences with a swap-based local search.

Documents become pieces of at most ``size`` tokens. Pieces of full length are sequences already.
The others, at most one of a document, are dealt into blocks of a few thousand by a hash; a block is
packed by best fit in descending order, and then a local search moves a document, or exchanges one
for one or two for one between underfull bins, as long as any such step raises the sum of squared
fills. It starts from the emptiest bins, so that they empty, and ends at the least possible number of
bins or where no bin can give anything. A block wastes about one bin at most, so blocks of thousands
of pieces keep close to the lower bound at any size.

A block is packed with its tokens: ``write_sequences`` stores whole sequences, each with its tokens
in order and the list of its pieces, and ``digest`` reads them back.

Defined results: a null or empty text is one piece of the end id; repeated rows are packed each; a
null ``doc_id`` stays null; of steps that move equally many tokens the first in order of bins is
taken, so equal pieces give equal packings; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, slices, small_batches
from .tokens import word_ids

SIZE = 2048
END_ID = 0
#: Mean number of pieces in a block; full pieces come in groups of 512.
BLOCK_PIECES = 4096
FULL_SHIFT = 9
#: Sequences of an Arrow batch that leaves a block.
OUT_ROWS = 256
PIECES = "uid long, doc_id long, piece int, start long, tokens binary"
SEQUENCES = "sequence_id long, tokens array<int>, pieces array<struct<doc_id: long, piece: int, start: long, offset: int, length: int>>"


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``(uid, doc_id, piece, start, tokens)``: the pieces of every document with their ids as little-endian 32-bit bytes."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = word_ids(tokenizer_path), TaskContext.get().partitionId() << 36
        for some in slices(batches):
            ids = [encoder.encode(x) + end for x in some.column(1).to_pylist()]
            doc, piece, start, part = [], [], [], []
            for d, x in enumerate(ids):
                n = len(x) // 4
                for p, s in enumerate(range(0, n, size)):
                    doc.append(d)
                    piece.append(p)
                    start.append(s)
                    part.append(x[4 * s : 4 * (s + size)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(doc))), some.column(0).take(pa.array(doc, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(part, pa.binary())],
                names=["uid", "doc_id", "piece", "start", "tokens"],
            )
            uid += len(doc)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices by best fit in descending order of length."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = size - lengths[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= lengths[i]
        if left:
            insort(room, (left, b))
    return bins


class _Bin:
    """One bin's distinct lengths and distinct sums of two, each with pieces that have it."""

    def __init__(self, members: list[int], lengths: list[int]):
        self.members = members
        self.ones: dict[int, tuple[int, ...]] = {}
        self.twos: dict[int, tuple[int, ...]] = {}
        groups: dict[int, list[int]] = {}
        for i in sorted(members):
            self.ones.setdefault(lengths[i], (i,))
            groups.setdefault(lengths[i], []).append(i)
        first = sorted(groups)
        for n, a in enumerate(first):
            if len(groups[a]) > 1:
                self.twos.setdefault(2 * a, tuple(groups[a][:2]))
            for b in first[n + 1 :]:
                self.twos.setdefault(a + b, (groups[a][0], groups[b][0]))
        self.arrays = np.array([*self.ones], dtype=np.int32), np.array([*self.twos], dtype=np.int32)


class _Search:
    """The bins of a block and what the steps between them need, kept up to date in slots of bins."""

    SLOT = 64

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins = [_Bin(b, lengths) for b in bins]
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int32)
        self.now = 1
        self.changed, self.checked = np.ones(len(bins), dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
        self.slots: list[tuple[np.ndarray, ...] | None] = [None] * -(-len(bins) // self.SLOT)

    def flat(self) -> list[np.ndarray]:
        """(lengths, their bins, sums of two, their bins) of all bins."""
        for k, slot in enumerate(self.slots):
            if slot is None:
                some = [b.arrays for b in self.bins[k * self.SLOT : (k + 1) * self.SLOT]]
                self.slots[k] = tuple(
                    x for n in (0, 1) for x in (np.concatenate([a[n] for a in some]), k * self.SLOT + np.repeat(np.arange(len(some)), [len(a[n]) for a in some])))
        return [np.concatenate(x) for x in zip(*self.slots, strict=True)]

    def put(self, k: int, members: list[int], gain: int) -> None:
        self.bins[k] = _Bin(members, self.lengths)
        self.fill[k] += gain
        self.changed[k] = self.now
        self.slots[k // self.SLOT] = None

    def step(self, at: int) -> bool:
        """Take the most tokens that one step can from bin ``at`` to a fuller or equal bin, if there is any.

        Moving ``t`` tokens from a bin of fill f to one of fill g >= f raises the sum of squares by
        2t(g - f + t) > 0. If this bin had none before, only bins changed since are looked at.
        """
        source, f = self.bins[at], self.fill[at]
        usable = (self.fill >= f) & (self.fill < self.size)
        if self.changed[at] <= self.checked[at]:
            usable &= self.changed > self.checked[at]
        usable[at] = False
        self.checked[at] = self.now
        if not usable.any():
            return False
        room = np.where(usable, self.size - self.fill, -1)
        one, one_bin, two, two_bin = self.flat()
        singles, pairs = source.arrays
        out = np.concatenate([singles, pairs])
        found = [_best(out, np.zeros(len(room), dtype=np.int32), room), _best(out, one, room[one_bin]), _best(singles, two, room[two_bin])]
        kind = max((0, 1, 2), key=lambda k: found[k][0])
        gain, o, b = found[kind]
        if not gain:
            return False
        k = int((np.arange(len(room)), one_bin, two_bin)[kind][b])
        given = (source.ones if o < len(singles) else source.twos)[int(out[o])]
        taken = () if not kind else self.bins[k].ones[int(one[b])] if kind == 1 else self.bins[k].twos[int(two[b])]
        self.now += 1
        target = self.bins[k]
        self.put(at, [i for i in source.members if i not in given] + list(taken), -gain)
        self.put(k, [i for i in target.members if i not in taken] + list(given), gain)
        return True


def _best(out: np.ndarray, back: np.ndarray, room: np.ndarray) -> tuple[int, int, int]:
    """(gain, place of out, place of back) of the largest positive out - back that has room; gain 0: none."""
    if not len(out) or not len(back):
        return 0, 0, 0
    gain = out[:, None] - back
    gain[gain > room] = 0
    o, b = divmod(int(gain.argmax()), len(back))
    return max(int(gain[o, b]), 0), o, b


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: best fit, then local search.

    In each round every underfull bin, the emptiest first, gives what it can; rounds end when no bin
    gave anything, or at the lower bound.
    """
    first = best_fit(lengths, size)
    least = -(-sum(lengths) // size)
    if len(first) <= least:
        return first
    search = _Search(first, lengths, size)
    live, gave = len(first), True
    while gave and live > least:
        gave = False
        for at in np.argsort(search.fill, kind="stable").tolist():
            while 0 < search.fill[at] < size and search.step(at):
                gave = True
            if not search.fill[at]:
                live = int((search.fill > 0).sum())
                if live <= least:
                    break
    return [b.members for b in search.bins if b.members]


def _pack_block(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sequences of one block of pieces, in batches of few rows."""
    table = pa.Table.from_batches(list(batches))
    table = table.take(np.argsort(table["uid"].to_numpy(), kind="stable")).combine_chunks()
    block, uid = int(table["block"][0].as_py()), table["uid"].to_numpy()
    lengths = pc.binary_length(table["tokens"]).to_numpy().astype(np.int64) // 4
    if block < 0:
        bins, names = [[k] for k in range(len(uid))], -1 - uid
    else:
        bins = pack(lengths.tolist(), size)
        names = np.arange(len(bins), dtype=np.int64) + (block << 32)
    for k in range(0, len(bins), OUT_ROWS):
        some = bins[k : k + OUT_ROWS]
        members = np.array([i for b in some for i in b], dtype=np.int64)
        counts = np.r_[0, np.cumsum([len(b) for b in some])]
        sizes = lengths[members]
        upto = np.r_[0, np.cumsum(sizes)]
        offset = upto[:-1] - np.repeat(upto[counts[:-1]], np.diff(counts))
        part = table.take(members)
        pieces = pa.StructArray.from_arrays(
            [part["doc_id"].combine_chunks(), part["piece"].combine_chunks(), part["start"].combine_chunks(), pa.array(offset.astype(np.int32)), pa.array(sizes.astype(np.int32))],
            names=["doc_id", "piece", "start", "offset", "length"])
        values = pa.array(np.frombuffer(b"".join(part["tokens"].to_pylist()), dtype="<i4"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[k : k + OUT_ROWS]), pa.ListArray.from_arrays(pa.array(upto[counts].astype(np.int32)), values), pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pieces)],
            names=["sequence_id", "tokens", "pieces"])


def sequences(pieces: DataFrame, rows: int, size: int = SIZE, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``(sequence_id, tokens, pieces)`` of the pieces of ``rows`` documents, packed block by block."""
    blocks = max(1, round(rows / block_pieces))
    short = F.octet_length("tokens") < 4 * size
    dealt = pieces.withColumn("block", F.when(short, F.pmod(F.xxhash64("uid"), F.lit(blocks))).otherwise(-1 - F.shiftright("uid", FULL_SHIFT)))

    def pack_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack_block(batches, size)

    return dealt.groupBy("block").applyInArrow(pack_block, SEQUENCES)


def write_sequences(docs: DataFrame, path: str, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> None:
    """Pack the whole texts of ``docs`` and store the sequences with their tokens at ``path``."""
    packed = sequences(cut_pieces(docs, tokenizer_path, size, end_id), docs.count(), size)
    packed.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEQUENCES).parquet(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        tokens, pieces = batch.column(1), batch.column(2)
        base = tokens.offsets.to_numpy()[:-1].astype(np.int64)
        counts = np.diff(pieces.offsets.to_numpy())
        view = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        doc, piece, start, offset, length = pieces.flatten().flatten()
        begin = np.repeat(base, counts) + offset.to_numpy()
        crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.to_numpy().tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [doc, piece, start, length.cast(pa.int64()), pa.array(crc, pa.int64()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts))), offset.cast(pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of stored sequences, from their tokens."""
    return small_batches(read_sequences(spark, path)).mapInArrow(
        _sums, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
