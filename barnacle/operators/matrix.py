"""Barcode by sample matrices, and the combination of count tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.fastq import read_fastq, read_fastq_pairs
from . import counters


@dataclass
class CountMatrix:
    """counts: long, a row for each row and sample; row_data: keys; col_data: a row for each sample."""

    counts: DataFrame
    row_data: DataFrame
    col_data: DataFrame
    keys: list[str]

    def wide(self, samples: Sequence[str] | None = None) -> DataFrame:
        """One column for each sample, zero where a row has no count."""
        names = list(samples) if samples is not None else [r["sample"] for r in self.col_data.select("sample").orderBy("sample").collect()]
        return self.counts.groupBy(*self.keys).pivot("sample", names).agg(F.sum("counts")).fillna(0, names)


def unique_names(paths: Sequence[str]) -> list[str]:
    """Base names, made unique by numbers."""
    seen: dict[str, int] = {}
    out = []
    for p in paths:
        n = os.path.basename(p)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
    return out


def matrix_of(result: counters.CountResult, keys: list[str], nmapped: bool) -> CountMatrix:
    """From a result with samples; rows that some samples lack are zero in these."""
    samples = result.metadata.select("sample")
    counted = result.table.groupBy("sample", *keys).agg(F.sum("counts").alias("n"))
    # the keys of any sample, each with every sample: that is the matrix
    rows = counted.select(*keys).distinct()
    every = rows.crossJoin(samples.withColumnRenamed("sample", "s"))
    counted = counted.withColumnsRenamed({k: f"k_{k}" for k in keys})
    same = F.expr(" AND ".join([f"`{k}` <=> `k_{k}`" for k in keys] + ["s = sample"]))
    counts = every.join(counted, same, "left").select(*keys, F.col("s").alias("sample"), F.coalesce("n", F.lit(0)).cast("long").alias("counts"))
    cols = result.metadata
    if nmapped:
        cols = cols.join(result.table.groupBy("sample").agg(F.sum("counts").cast("long").alias("nmapped")), "sample", "left").fillna(0, ["nmapped"])
    return CountMatrix(counts, rows, cols, keys)


def _named_rows(m: CountMatrix) -> CountMatrix:
    """m with row_data in the order of its keys and the names BARCODE_1, BARCODE_2, ...

    Numbers run over the whole, so one task gives them, to rows of the distinct combinations alone.
    """
    number = F.row_number().over(Window.orderBy(*m.keys))
    return CountMatrix(m.counts, m.row_data.withColumn("name", F.concat(F.lit("BARCODE_"), number.cast("string"))), m.col_data, m.keys)


def _reads(spark: SparkSession, files: Sequence) -> tuple[DataFrame, DataFrame]:
    """All reads with their sample, in one scan of all files, and each sample's paths."""
    paired = bool(files) and not isinstance(files[0], str)
    names = unique_names([f[0] if paired else f for f in files])
    columns = "sample string, paths1 string, paths2 string" if paired else "sample string, paths string"
    paths = spark.createDataFrame([(n, *(f if paired else [f])) for f, n in zip(files, names)], columns)
    reads = read_fastq_pairs(spark, [f[0] for f in files], [f[1] for f in files], names) if paired else read_fastq(spark, list(files), names)
    return reads, paths


def _matrix(count: Callable, spark: SparkSession, files: Sequence, keys: list[str], nmapped: bool, *args, **options) -> CountMatrix:
    if not files:
        raise ValueError("no files")
    reads, paths = _reads(spark, files)
    return _gathered(count(reads, *args, **options), paths, keys, nmapped)


def _gathered(result: counters.CountResult, paths: DataFrame, keys: list[str], nmapped: bool) -> CountMatrix:
    # a file without reads is a sample of its own all the same
    totals = [c for c in result.metadata.columns if c != "sample"]
    metadata = paths.join(result.metadata, "sample", "left").fillna(0, totals)
    return matrix_of(counters.CountResult(result.table, metadata), keys, nmapped)


def matrix_of_single(spark: SparkSession, files: Sequence[str], choices, **options) -> CountMatrix:
    return _matrix(counters.count_single, spark, files, ["idx", "choices"], True, choices, **options)


def matrix_of_combo(spark: SparkSession, files: Sequence[str], template: str, choices, **options) -> CountMatrix:
    return _named_rows(_matrix(counters.count_combo, spark, files, ["combinations"], True, template, choices, **options))


def matrix_of_combo_paired(spark: SparkSession, files: Sequence[tuple[str, str]], choices, **options) -> CountMatrix:
    return _named_rows(_matrix(counters.count_combo_paired, spark, files, ["combinations"], False, choices, **options))


def _dual(count: Callable, spark: SparkSession, files: Sequence, choices, *args, include_invalid: bool = False, **options) -> CountMatrix:
    """Rows are those of choices, with their names if they have any. include_invalid: the combinations that any file has or that are valid,
    each once, with `valid`, which tells whether choices have it."""
    frame = isinstance(choices, DataFrame)
    every = [c for c in (choices.columns if frame else choices) if c != "idx"]
    if not include_invalid:
        return _matrix(count, spark, files, ["idx", *every], False, choices, *args, **options)
    names = [c for c in every if c != "name"]
    reads, paths = _reads(spark, files)
    # each branch would parse the files for itself
    m = _gathered(count(reads, choices, *args, include_invalid=True, kept=True, **options), paths, names, False)
    valid = (choices if frame else spark.createDataFrame(list(zip(*choices.values())), ", ".join(f"`{n}` string" for n in names))).select(*(F.col(n).cast("string") for n in names)).distinct().withColumn("valid", F.lit(True))
    flagged = lambda df: df.join(valid, names, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return CountMatrix(flagged(m.counts), flagged(m.row_data), m.col_data, [*names, "valid"])


def matrix_of_dual(spark: SparkSession, files: Sequence[str], choices, template: str, **options) -> CountMatrix:
    return _dual(counters.count_dual, spark, files, choices, template, **options)


def matrix_of_dual_paired(spark: SparkSession, files: Sequence[tuple[str, str]], choices, **options) -> CountMatrix:
    return _dual(counters.count_dual_paired, spark, files, choices, **options)


def matrix_of_random(spark: SparkSession, files: Sequence[str], template: str, **options) -> CountMatrix:
    return _matrix(counters.count_random, spark, files, ["sequences"], True, template, **options)


def combine_combo_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each combination of any table (combinations, counts), sorted, with a column of counts for each table.

    Tables are read once, for the check; their counts stay cached, on disk where memory is short, until the session's end or clearCache().
    """
    if not tables:
        raise ValueError("no tables")
    every = None
    for name, t in tables.items():
        t = t.select("combinations", F.col("counts").cast("long"), F.lit(name).alias("origin"))
        every = t if every is None else every.unionByName(t)
    every = every.groupBy("origin", "combinations").agg(F.sum("counts").alias("counts"), F.count("*").alias("rows")).persist()
    if every.where("rows > 1").limit(1).count():
        every.unpersist()
        raise ValueError("barcode combinations should be unique within each DataFrame in 'tables'")
    names = list(tables)
    return every.groupBy("combinations").pivot("origin", names).agg(F.sum("counts")).fillna(0, names).orderBy("combinations")
