"""FASTQ files as a data source.

A record may span lines and a quality line may begin with `@`, so a file can't be split; each is one partition, streamed. Files are
gzip or zlib if they begin with its magic number, whatever their names. A path is what Python can open on every executor, or a URI of a
file system that pyarrow knows (hdfs://, s3://, gs://, file://). Any number of files, or of pairs of files, is one scan.
"""

from __future__ import annotations

import glob
import io
import json
import os
import zlib
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 50_000


class Inflated(io.RawIOBase):
    """The plain bytes of a zlib, gzip or raw DEFLATE stream, read block by block. mode: `zlib`, `gzip`, `deflate`, or `auto` for the first two."""

    WINDOW = {"deflate": -15, "zlib": 15, "gzip": 31, "auto": 47}

    def __init__(self, source: BinaryIO, mode: str = "auto", block: int = 65536):
        self.source, self.mode, self.block, self.engine, self.rest = source, mode, block, zlib.decompressobj(self.WINDOW[mode]), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest:
            data = (self.engine.unconsumed_tail or self.engine.unused_data) if not self.engine.eof else self.engine.unused_data
            if self.engine.eof and (data or (data := self.source.read(self.block))):  # another member follows
                self.engine = zlib.decompressobj(self.WINDOW[self.mode])
            data = data or self.source.read(self.block)
            if not data:
                if not self.engine.eof:
                    raise ValueError("premature end of the compressed stream")
                return 0
            self.rest = self.engine.decompress(data, self.block)
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def plain(data: bytes | BinaryIO, mode: str | None = None) -> BinaryIO:
    """A reader of the plain bytes of a buffer or a stream: mode as in Inflated; None finds gzip and zlib by how they begin."""
    source = io.BufferedReader(io.BytesIO(data)) if isinstance(data, bytes) else data if hasattr(data, "peek") else io.BufferedReader(data)
    if mode is None:
        head = source.peek(2)[:2]
        if head != b"\x1f\x8b" and not (len(head) == 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0):
            return source
    return io.BufferedReader(Inflated(source, mode or "auto"), 1 << 16)


def opened(path: str) -> BinaryIO:
    try:
        if "://" in path:
            system, name = fs.FileSystem.from_uri(path)
            f = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 16)
        else:
            f = open(path, "rb", buffering=1 << 16)
    except OSError:
        raise ValueError(f"failed to open file at '{path}'") from None
    return plain(f)


def parse(f: BinaryIO) -> Iterator[tuple[str, str]]:
    """name and sequence of each record."""
    number, line = 0, f.readline()

    def following() -> bytes:
        nonlocal number
        out = f.readline()
        number += 1
        if not out:
            raise ValueError(f"premature end of the file at line {number}")
        return out

    while line:
        start = number + 1
        if not line.startswith(b"@"):
            raise ValueError(f"read name should start with '@' (starting line {start})")
        if not line.endswith(b"\n"):
            raise ValueError(f"premature end of the file at line {start}")
        name = (line[1:].split(maxsplit=1) or [b""])[0] if line[1:2].strip() else b""
        sequence = b""
        while not (line := following()).startswith(b"+"):
            sequence += line.removesuffix(b"\n")
        if not line.endswith(b"\n"):
            raise ValueError(f"premature end of the file at line {number + 1}")
        quality, got = b"", False
        while not got or len(quality) < len(sequence):
            line = f.readline()
            number += 1
            if not line:
                if len(quality) < len(sequence):
                    raise ValueError(f"non-equal lengths for quality and sequence strings (starting line {start})")
                break
            quality, got = quality + line.removesuffix(b"\n"), True
        if len(quality) != len(sequence):
            raise ValueError(f"non-equal lengths for quality and sequence strings (starting line {start})")
        yield name.decode("latin-1"), sequence.decode("latin-1")
        line = f.readline()
        number += 1


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class _File(InputPartition):
    def __init__(self, paths: list[str], sample: str | None):
        self.paths, self.sample = paths, sample


class _Reader(DataSourceReader):
    def __init__(self, files: list[_File]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return self.files

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        names = ("seq",) if len(partition.paths) == 1 else ("seq1", "seq2")
        fields = [("path", pa.string()), ("read_id", pa.int64()), ("name", pa.string()), *((n, pa.string()) for n in names)]
        schema = pa.schema(fields + ([("sample", pa.string())] if partition.sample is not None else []))
        own = () if partition.sample is None else (partition.sample,)
        rows: list[tuple] = []
        files = [opened(p) for p in partition.paths]
        try:
            scans, i = [parse(f) for f in files], 0
            while True:
                reads = [next(s, None) for s in scans]
                if None in reads:
                    if any(r is not None for r in reads):
                        raise ValueError("different number of reads in paired FASTQ files")
                    break
                rows.append((partition.paths[0], i, reads[0][0], *(r[1] for r in reads), *own))
                i += 1
                if len(rows) == BATCH:
                    yield _columns(rows, schema)
                    rows = []
            if rows:
                yield _columns(rows, schema)
        finally:
            for f in files:
                f.close()


def _listed(path: str) -> list[str]:
    """The files of a path, which may be a pattern or a folder of parts."""
    if "://" not in path and os.path.isdir(path):
        return sorted(e.path for e in os.scandir(path) if e.name[0] not in "._" and e.is_file())
    return [path] if "://" in path or os.path.exists(path) else sorted(glob.glob(path)) or [path]


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path), where path may be a pattern; option mate: the path of the second mates.

    Options paths, mates and samples: JSON lists, for many files in one scan; samples adds a column `sample`.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        mates = "mate" in self.options or "mates" in self.options
        return "path string, read_id long, name string, " + ("seq1 string, seq2 string" if mates else "seq string") + (", sample string" if "samples" in self.options else "")

    def reader(self, schema) -> DataSourceReader:
        given = {k: json.loads(self.options[k]) for k in ("paths", "mates", "samples") if k in self.options}
        if "paths" not in given:
            path = self.options["path"]
            return _Reader([_File([path, self.options["mate"]], None)] if "mate" in self.options else [_File([p], None) for p in _listed(path)])
        samples = given.get("samples") or [None] * len(given["paths"])
        if "mates" in given:
            parts = [(_listed(p), _listed(m), s) for p, m, s in zip(given["paths"], given["mates"], samples, strict=True)]
            if any(len(a) != len(b) for a, b, _ in parts):
                raise ValueError("different number of paired FASTQ files")
            return _Reader([_File([*ab], s) for a, b, s in parts for ab in zip(a, b)])
        return _Reader([_File([f], s) for p, s in zip(given["paths"], samples, strict=True) for f in _listed(p)])


def _scan(spark: SparkSession, **lists: list[str] | None) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").options(**{k: json.dumps(v) for k, v in lists.items() if v is not None}).load()


def read_fastq(spark: SparkSession, path: str | Sequence[str], samples: Sequence[str] | None = None) -> DataFrame:
    """path, read_id (ordinal in the file), name and seq of every read, and sample where there are samples, one for each path."""
    return _scan(spark, paths=[path] if isinstance(path, str) else list(path), samples=list(samples) if samples is not None else None)


def read_fastq_pairs(spark: SparkSession, path: str | Sequence[str], mate: str | Sequence[str], samples: Sequence[str] | None = None) -> DataFrame:
    """path, read_id, name, seq1 and seq2, and perhaps sample, of two files, or two lists of files, read in lock-step."""
    return _scan(spark, paths=[path] if isinstance(path, str) else list(path), mates=[mate] if isinstance(mate, str) else list(mate), samples=list(samples) if samples is not None else None)


def write_fastq(reads: DataFrame, path: str, compression: str | None = None) -> None:
    """reads (name, seq) as text files of FASTQ records of four lines, with qualities of I."""
    text = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    reads.select(text).write.text(path, **({"compression": compression} if compression else {}))


def compressed(data: bytes, mode: str = "gzip", level: int = 6) -> bytes:
    """data as one gzip, zlib or raw DEFLATE stream."""
    engine = zlib.compressobj(level, zlib.DEFLATED, Inflated.WINDOW[mode])
    return engine.compress(data) + engine.flush()
