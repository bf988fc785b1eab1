"""Token-id files of patched frame-of-reference blocks.

A file is a row of block records and a footer. All integers are little-endian.

    block:   uint32 minimum, uint8 width, uint8 0, uint16 exceptions, uint16 ids (BLOCK or fewer), uint16 0, then the
             low `width` bits of (id - minimum), packed, then for each exception uint16 place and uint32 (id - minimum)
    footer:  for each block uint64 start in the file and uint64 ids before it; for each document int64 doc_id, uint64 ids
             before it and uint8 whether doc_id is null; then uint64 blocks, uint64 documents, uint64 ids, 8 bytes MAGIC

Spark's text writer puts "\n" after every 64 blocks or so and after the footer; the index leaves them out.

The width of a block is the one that holds PERCENTILE of its ids, or a larger one if that makes the block smaller. The writer
is Spark's own, so files go to any Hadoop path and a lost task leaves nothing behind; they are read through binaryFile.

Documents are written in ascending doc_id order: null first, rows with the same doc_id in an order that the text's hash
decides. A null or empty text has only the end id. An empty table gives no documents. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh_path, table
from .tokens import tokens_of

BLOCK, PERCENTILE, MAGIC = 4096, 95, b"BNCLPFR1"
HEAD = struct.Struct("<IBBHHH")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    values = (ids - np.uint32(low)).astype(np.uint32)
    widths = np.frexp(values.astype(np.float64))[1]  # bits that each value needs
    count = np.bincount(widths, minlength=33)
    above = len(values) - np.cumsum(count)
    least = int(np.searchsorted(np.cumsum(count), len(values) * PERCENTILE / 100))
    width = min(range(least, 33), key=lambda b: (-(-len(values) * b // 8) + 6 * int(above[b]), b))
    odd = np.flatnonzero(widths > width)
    body = pack_bits(values & np.uint32((1 << width) - 1), width) if width else b""
    tail = b"".join(struct.pack("<HI", int(i), int(values[i])) for i in odd)
    return HEAD.pack(low, width, 0, len(odd), len(values), 0) + body + tail


def decode_block(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    """The ids of the block at a place, and the place after it."""
    low, width, _, odd, n, _ = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = -(-n * width // 8)
    values = unpack_bits(np.frombuffer(data, np.uint8, size, at), n, width)
    at += size
    for _ in range(odd):
        i, v = struct.unpack_from("<HI", data, at)
        values[i] = v
        at += 6
    return values + np.uint32(low), at


class Writer:
    """The bytes of one file as text rows, each of which ends with the writer's newline: add() documents, then finish()."""

    def __init__(self):
        self.size = self.n = self.held = 0
        self.starts, self.docs, self.buffer = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes:
        self.docs.append((doc_id or 0, self.n + self.held, doc_id is None))
        self.buffer.append(ids)
        self.held += len(ids)
        return self._blocks(self.held // BLOCK * BLOCK) if self.held >= 64 * BLOCK else b""

    def _blocks(self, upto: int) -> bytes:
        ids, out = np.concatenate(self.buffer), []
        for at in range(0, upto, BLOCK):
            block = ids[at : min(at + BLOCK, upto)]
            self.starts.append((self.size, self.n))
            out.append(encode_block(block))
            self.size += len(out[-1])
            self.n += len(block)
        self.buffer, self.held = [ids[upto:]], len(ids) - upto
        self.size += 1
        return b"".join(out)

    def finish(self) -> bytes:
        out = self._blocks(self.held) if self.held else b""
        index = np.array(self.starts, "<u8").tobytes()
        docs = b"".join(struct.pack("<qQB", *d) for d in self.docs)
        return out + index + docs + struct.pack("<QQQ", len(self.starts), len(self.docs), self.n) + MAGIC


def documents(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, ids before it and ids of each document in a file, decoded block by block."""
    data = data[:-1]
    if data[-8:] != MAGIC:
        raise ValueError("not a token-id file")
    blocks, docs, n = struct.unpack_from("<QQQ", data, len(data) - 32)
    at = len(data) - 32 - 17 * docs
    entries = list(struct.iter_unpack("<qQB", data[at : at + 17 * docs]))
    starts = np.frombuffer(data, "<u8", 2 * blocks, at - 16 * blocks).reshape(-1, 2)
    held, first, k = np.zeros(0, np.uint32), 0, 0
    for (doc_id, start, null), end in zip(entries, [*(e[1] for e in entries[1:]), n]):
        parts = [held[start - first :]]
        first += len(held) - len(parts[0])
        have = first + len(parts[0])
        while have < end:
            ids, _ = decode_block(data, int(starts[k][0]))
            parts.append(ids)
            have, k = have + len(ids), k + 1
        held = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield None if null else doc_id, start, held[start - first : end - first]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Files of the ids of docs (doc_id, text) at a path, in ascending doc_id order of file names and in each file."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, writer = tokens_of(tokenizer), np.array([end_id], np.uint32), Writer()
        row = lambda x: pa.record_batch([pa.array([x], pa.binary())], ["value"])
        for b in batches:
            for lo, found in tokens.slices(b["text"]):
                for doc_id, ids in zip(b["doc_id"].slice(lo, len(found)).to_pylist(), found):
                    if out := writer.add(doc_id, np.append(ids, end)):
                        yield row(out)
        if writer.docs:
            yield row(writer.finish())

    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(partition, "value binary").select(F.col("value").cast("string")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, start in the file, n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"]):
                cols: list[list] = [[], [], [], []]
                for doc_id, start, ids in documents(content.as_py()):
                    for c, v in zip(cols, (doc_id, start, len(ids), ids.astype("<u4").tobytes())):
                        c.append(v)
                    if len(cols[0]) >= 4096:
                        yield rows(file, cols)
                        cols = [[], [], [], []]
                yield rows(file, cols)

    def rows(file, cols):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array([file] * len(cols[0]), pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["file", "doc_id", "start", "n_tokens", "ids"])

    # one file at a time, for each holds a whole partition
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(decode, "file string, doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark)
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    read = cut(read_ids(spark, path).select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row for each file, that is for each partition that was written; names hold the partition's number, padded to five digits at least
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = F.coalesce(F.sum("n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read.join(files.select("file", before.alias("base")), "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op6_token_files": op6_token_files}
ORACLES: dict[str, str] = {}
