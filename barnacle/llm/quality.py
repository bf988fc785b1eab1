"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees learn labels.quality from a bounded sample of labelled documents, SAMPLE at most, chosen by a hash of their id; only the text's
statistics are inputs. More symbols, repeated lines, repeated words and capitals never raise a document's score.

Null and empty texts have no words and fail the base rules. Repeated rows and null doc_ids stay separate rows. Without
labels of both kinds the base rules alone decide. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed, stored, table, words
from .gbt import Trees

SAMPLE, KEEP_AT, WINDOW = 20_000, 0.5, 3
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"

#: Name and direction of each feature: -1 where a larger value must not raise the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "mark_share": -1, "stop_share": 0, "distinct_share": 0, "top_share": 0, "line_words": 0, "wide_share": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def repeated_words(ws: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(ws) <= WINDOW:
        return 0
    h = np.fromiter(map(hash, ws), np.int64, len(ws)).astype(np.uint64)
    n = len(h) - WINDOW + 1
    code = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        code += h[i : i + n] * _ODD[i]
        code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    hit = np.zeros(len(h) + 1, np.int64)
    again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    np.add.at(hit, again, 1)
    np.add.at(hit, again + WINDOW, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The values of COUNTS and FEATURES."""
    text = text or ""
    ws = words(text)
    n, chars = len(ws), len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = repeated_words(ws)
    raw = text.encode("utf-8", "surrogatepass")
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, wide = b[65:91].sum(), b[48:58].sum(), b[128:].sum()
    size, count = max(1, len(raw)), Counter(ws)
    ratio = lambda a, d: float(a) / max(1, d)
    features = [np.log1p(n), ratio(chars, n), ratio(symbols, size), ratio(dup, lines), ratio(repeat, n), ratio(upper, size), ratio(digit, size), ratio(b[33], size), ratio(b[46], n), ratio(len(count), n), ratio(max(count.values(), default=0), n), ratio(n, lines), ratio(wide, size)]
    return [n, chars, symbols, dup, repeat], features


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [statistics(t.as_py()) for t in b["text"]]
        counts = [pa.array([c[i] for c, _ in found], pa.int64()) for i in range(len(COUNTS))]
        yield pa.record_batch([b["doc_id"], *counts, pa.array([f for _, f in found], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "features"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, features and base_failed of every row of docs (doc_id, text)."""
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = least_hashed(stats.select("doc_id", "features").join(known, "doc_id"), "doc_id", sample).toPandas()
    if rows["quality"].nunique() < 2:
        return None
    return Trees(list(FEATURES.values())).fit(np.stack(rows["features"]), rows["quality"].to_numpy(float))


def _keep(trees: Trees | None) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["features"].flatten().to_numpy().reshape(-1, len(FEATURES))
            score = trees.predict(x) if trees else np.ones(len(x))
            failed = b["base_failed"].to_numpy(zero_copy_only=False)
            yield pa.record_batch([b["doc_id"], *(b[c] for c in COUNTS), b["base_failed"], pa.array(~failed & (score >= KEEP_AT)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return partition


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score of every row of docs (doc_id, text)."""
    stats = stored(measured(docs))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return stats.mapInArrow(_keep(train(stats, labels, sample)), schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
