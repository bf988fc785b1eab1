"""FASTQ in and out."""

from .fastq import FastqSource, parse, read_fastq, read_fastq_pairs, write_fastq

__all__ = ["FastqSource", "parse", "read_fastq", "read_fastq_pairs", "write_fastq"]
