"""Bounded-space online packing of token ids into sequences.

Each partition of the input keeps at most `windows` open sequences. What a document has beyond whole sequences goes to
the open sequence that it fits best; if none fits and all are open, the fullest is emitted. With fill, which is the default and departs from the
method's plain form, it's filled with the head of the piece first, so that it needs no padding; without, it's emitted as it is. At the end of a partition its open sequences are merged into full ones, which leaves less than one
sequence; the leftovers of MERGE partitions are then merged in the same way. So the sequences of a task never depend on
another task's, memory is `windows` sequences, and at most one sequence for each MERGE partitions is padded.

A null or empty text has no ids but the end id, so it still takes one place. Repeated rows are packed one by one, a null
doc_id stays null. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stored, table
from .tokens import SLICE, tokens_of

WINDOWS, LENGTH, MERGE = 32, 1024, 64
#: First sequence_id of merged leftovers; those of partition p start at p << 36.
MERGED = 1 << 62

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part int"
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("part", pa.int32())])


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids as bytes); emit(pieces) gets each sequence that is full."""

    def __init__(self, emit: Callable[[list], None], length: int, windows: int, fill: bool = True):
        self.emit, self.length, self.windows, self.fill = emit, length, windows, fill
        self.open: list[tuple[int, list]] = []  # (free places, pieces)

    def add(self, doc_id, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        whole = len(ids) // 4 // self.length * self.length
        for at in range(0, whole, self.length):
            self.emit([(doc_id, start + at, total, ids[4 * at : 4 * (at + self.length)])])
        if len(ids) > 4 * whole:
            self._place((doc_id, start + whole, total, ids[4 * whole :]))

    def _place(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        fits = [k for k, (free, _) in enumerate(self.open) if free >= n]
        if fits:
            self._into(min(fits, key=lambda k: self.open[k][0]), piece)
        elif len(self.open) < self.windows:
            self.open.append((self.length, []))
            self._into(len(self.open) - 1, piece)
        else:
            k = min(range(len(self.open)), key=lambda k: self.open[k][0])
            free, pieces = self.open[k]
            if self.fill:
                self._into(k, (*piece[:3], piece[3][: 4 * free]))
                self._place((piece[0], piece[1] + free, piece[2], piece[3][4 * free :]))
            else:
                self.emit(pieces)
                self.open[k] = (self.length, [])
                self._into(k, piece)

    def _into(self, k: int, piece: tuple) -> None:
        free, pieces = self.open[k]
        pieces.append(piece)
        free -= len(piece[3]) // 4
        if free:
            self.open[k] = (free, pieces)
        else:
            self.emit(pieces)
            self.open[k] = self.open[-1]
            self.open.pop()

    def finish(self) -> list:
        """Merge what is open, fullest first; returns the pieces of the last sequence, which isn't full."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]
        self.open, now, free = [], [], self.length
        for doc_id, start, total, ids in rest:
            if len(ids) // 4 >= free:
                self.emit([*now, (doc_id, start, total, ids[: 4 * free])])
                start, ids, now, free = start + free, ids[4 * free :], [], self.length
            if ids:
                now.append((doc_id, start, total, ids))
                free -= len(ids) // 4
        return now


class Rows:
    """Columns of SCHEMA, filled sequence by sequence."""

    def __init__(self, first_id: int, part: int, keep_ids: bool):
        self.next, self.part, self.keep, self.cols = first_id, part, keep_ids, [[] for _ in SCHEMA]

    def sequence(self, pieces: list, leftover: bool = False) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            for c, v in zip(self.cols, (doc_id, start, n, zlib.crc32(ids), total, None if leftover else self.next, offset, ids if leftover or self.keep else None, self.part)):
                c.append(v)
            offset += n
        self.next += bool(pieces) and not leftover

    def batch(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t.type) for c, t in zip(self.cols, SCHEMA)], schema=SCHEMA)
        self.cols = [[] for _ in SCHEMA]
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, windows: int = WINDOWS, keep_ids: bool = True, fill: bool = True, most: int = SLICE) -> DataFrame:
    """One row for each piece of each document; ids: its token ids as little-endian unsigned 32-bit integers, if kept. most: bytes of text that are encoded at once."""
    end = end_id.to_bytes(4, "little")

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = tokens_of(tokenizer), TaskContext.get().partitionId()
        rows = Rows(part << 36, part, keep_ids)
        packer = Packer(rows.sequence, length, windows, fill)
        for b in batches:
            for lo, found in tokens.slices(b["text"], most):
                for doc_id, ids in zip(b["doc_id"].slice(lo, len(found)).to_pylist(), found):
                    packer.add(doc_id, ids.astype("<u4").tobytes() + end)
                yield rows.batch()
        rows.sequence(packer.finish(), leftover=True)
        yield rows.batch()

    def merge(key: tuple[pa.Scalar, ...], leftovers: pa.Table) -> pa.Table:
        rows = Rows(MERGED + (key[0].as_py() << 32), -1, keep_ids)
        packer = Packer(rows.sequence, length, 1)
        pieces = sorted(leftovers.select(SCHEMA.names).to_pylist(), key=lambda r: (r["part"], r["offset"]))
        packer.open = [(length, [(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in pieces])]
        rows.sequence(packer.finish())
        return pa.Table.from_batches([rows.batch()])

    first = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(partition), PIECE))
    merged = first.where("sequence_id is null").withColumn("g", F.floor(F.col("part") / MERGE)).groupBy("g").applyInArrow(merge, PIECE)
    return first.where("sequence_id is not null").unionByName(merged).drop("part")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False).drop("ids")


QUERIES = {"op7_pack": op7_pack}
ORACLES: dict[str, str] = {}
