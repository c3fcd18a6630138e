"""Best-fit packing of documents into sequences of fixed capacity, with certified repacking.

Documents become token pieces; only one longer than the capacity is cut.  The lengths are dealt over partitions of
bounded size, each packed by best-fit decreasing.  Dual feasible functions give a lower bound on the sequences a
partition needs.  A partition that reaches its bound without waste keeps its sequences; the others release their
sequences with free room, whose pieces are dealt anew over fewer partitions and packed again, until one partition
is left or nothing is released.

Null texts are empty documents and hold the end token only.  Repeated rows and null ids are pieces of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encoders import Tokenizer, encoder
from weftline.llm.tasks import binary_rows, chunks, ranges, ship, texts_of
from weftline.runtime import materialize, scratch_path, write_table

PARTITION_PIECES = 50_000  # pieces that one task packs
MAX_ROUNDS = 12            # the pieces shrink by a large factor per round; what is left then keeps its place
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def _pieces(tokenizer: Tokenizer, capacity: int, end: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for chunk in chunks(batches):
            ids, sizes = tool.encode(texts_of(chunk))
            if end is not None:
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end))
                sizes = sizes + 1
            count = np.maximum(-(-sizes // capacity), 1)
            piece = ranges(np.zeros(len(count), np.int64), count)
            start = piece * capacity
            length = np.minimum(np.repeat(sizes, count) - start, capacity)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id").take(pa.array(np.repeat(np.arange(len(count)), count))),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    binary_rows(ids, length),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return cut


def token_pieces(docs: DataFrame, tokenizer: Tokenizer, capacity: int, end: int | None) -> DataFrame:
    """(key, doc_id, piece, start, length, ids) written once; ``ids`` are little-endian unsigned 32-bit integers."""
    spark = ship(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _pieces(tokenizer, capacity, end), PIECE_SCHEMA
    )
    path = scratch_path(spark, "pieces")
    keyed = cut.withColumn("key", F.monotonically_increasing_id())  # stable, since it is written with the pieces
    keyed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(keyed.schema).parquet(path)


def bound(lengths: np.ndarray, capacity: int) -> float:
    """Lower bound on the number of bins from dual feasible functions, not rounded up.

    A dual feasible function maps lengths so that whatever fits a bin still does; the mapped total over the
    capacity is then a bound.  Used are the identity, the threshold family (large items count as a full bin, small
    ones as nothing) and the rounding family of Fekete and Schepers.
    """
    x = lengths.astype(np.int64)
    if not len(x):
        return 0.0
    best = x.sum() / capacity
    counts = np.bincount(x, minlength=capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    small = np.unique(x[(x > 0) & (x <= capacity // 2)])
    if len(small):
        large = number[-1] - number[capacity - small]
        middle = total[capacity - small] - total[small - 1]
        best = max(best, float((large + middle / capacity).max()))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        best = max(best, float(np.where(whole, k * x, (k + 1) * x // capacity * capacity).sum() / (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item, given in descending order of length, and the free room of every bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    open_bins: dict[int, list[int]] = {}  # bins by free room
    rooms = 0                             # bit r is set when a bin with free room r exists
    for i, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[left].pop()
            if not open_bins[left]:
                rooms ^= 1 << left
        else:
            left, chosen = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = chosen, capacity - left
        left -= length
        room[chosen] = left
        if left:
            same = open_bins.setdefault(left, [])
            if not same:
                rooms |= 1 << left
            same.append(chosen)
    return bins, offsets, np.array(room, np.int64)


_PLACED = "key bigint, length bigint, sequence_id bigint, offset bigint, certified boolean, released boolean"


def _packed(capacity: int, round_no: int):
    def pack(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        key, length = table.column("key").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((key, -length))
        key, length = key[order], length[order]
        bins, offsets, room = best_fit_decreasing(length, capacity)
        needed = bound(length, capacity)
        certified = len(room) == int(np.ceil(needed - 1e-9))
        # a certified bin count that still holds free room may go down when the partition shares its rest
        released = (room[bins] > 0) & (len(room) - needed > 1e-9)
        if released.any() and certified:
            # only the waste counts: the emptiest bins that hold nearly all of it
            emptiest = np.argsort(-room, kind="stable")
            share = np.cumsum(room[emptiest]) - room[emptiest]
            kept = np.zeros(len(room), bool)
            kept[emptiest[share > 0.98 * room.sum()]] = True
            released &= ~kept[bins]
        number = (round_no << 56) | (part << 24)
        return pa.table(
            {
                "key": pa.array(key),
                "length": pa.array(length),
                "sequence_id": pa.array(number + bins),
                "offset": pa.array(offsets),
                "certified": pa.array(np.full(len(key), certified)),
                "released": pa.array(released),
            }
        )

    return pack


def pack(lengths: DataFrame, capacity: int, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """(key, sequence_id, offset, certified) for the rows (key, length) of a written table, 1 <= length <= capacity.

    Every round is written, so a lost executor repeats one partition of one round.  A partition holds about
    ``partition_pieces`` random pieces whatever the documents look like.
    """
    spark = ship(lengths.sparkSession)
    rest = lengths.select("key", "length")
    settled: list[DataFrame] = []
    before = None
    for round_no in range(MAX_ROUNDS):
        count = rest.count()
        parts = max(1, -(-count // partition_pieces))
        last = parts == 1 or round_no == MAX_ROUNDS - 1 or (before is not None and parts >= before)
        dealt = rest.withColumn("_part", F.pmod(F.xxhash64(F.lit(round_no), "key"), F.lit(parts)))
        placed = write_table(
            dealt.groupBy("_part").applyInArrow(_packed(capacity, round_no), _PLACED), scratch_path(spark, "packed")
        )
        if last:
            settled.append(placed)
            break
        settled.append(placed.where("not released"))
        rest, before = placed.where("released").select("key", "length"), parts
        if rest.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("key", "sequence_id", "offset", "certified")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """The columns of the written ``pieces`` with the sequence and the offset of each."""
    return pieces.join(pack(pieces, capacity), "key")


def packed_documents(docs: DataFrame, tokenizer: Tokenizer, capacity: int, end: int) -> DataFrame:
    """Pieces of all documents with checksum, sequence and place; the ids stay in the written table of pieces."""
    pieces = token_pieces(docs, tokenizer, capacity, end)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity).drop("key")
