"""Toxicity by compression distance: windows of a text compressed with a zstandard dictionary of ordinary text, and with
one of toxic text in front of the same.

Both dictionaries are trained by the library, from a bounded sample of labelled rows: at most SAMPLE documents of each label, chosen by a hash of their id.
The ordinary one is trained on the windows of ordinary documents. Most of a toxic document is ordinary as well, so the toxic one is trained on what the ordinary
documents don't explain: the windows of a single word in toxic documents that no ordinary document of the sample has. Each counts once for each different pair of neighbours, and only if LEAST
documents add such a pair, so the rare words of a document with many copies don't count as frequent. A window's gain is the number of bytes that the toxic
dictionary saves. As the ordinary dictionary is part of both, other windows gain little. A logistic regression on a document's three largest gains, fitted to
labelled documents that the dictionaries have not seen, gives the score; its constant is lowered until no more than a share CLEAN of the ordinary ones reach
TOXIC_AT. Of toxic dictionaries of SIZES bytes the one that then finds most toxic documents is taken.

Windows cover whole texts. Null and empty texts, and texts without words, have no window and the score of no gain. A table
without labels of both kinds gives every row the score 0. Rows with a null doc_id are scored like others and aren't
held out. Rows with equal texts have equal scores.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, least_hashed, table, words

#: Documents of a label for the dictionaries, and as many again at most for calibration.
SAMPLE = 1500
WINDOW, ORDINARY, SIZES, LEAST, TOXIC_AT, CLEAN = 16, 32768, (512, 1024, 2048), 5, 0.7, 0.02
BOUND = float(np.log(TOXIC_AT / (1 - TOXIC_AT)))
#: The trainer's segments and the strings that it counts, and how many single words it gets in a sample.
SEGMENT, COUNTED, TOGETHER = 12, 6, 2
PARAMETERS = {"strategy": Z.STRATEGY_LAZY2, "min_match": 4, "window_log": 18, "hash_log": 16, "chain_log": 17, "search_log": 6}


def windows(text: str | None, n: int = WINDOW) -> list[bytes]:
    x = [w.lower() for w in words(text)]
    return [b" " + b" ".join(x[i : i + n]) + b" " for i in range(0, len(x), n)]


def trained(size: int, samples: list[bytes], **options) -> bytes:
    """The library's dictionary for samples, in an order of our own; of too little text for one, the text itself."""
    samples = list(samples)
    random.Random(0).shuffle(samples)
    try:
        return Z.train_dictionary(size, samples, **options).as_bytes()
    except Z.ZstdError:
        return b"".join(samples)[-size:]


def ordinary_dictionary(ordinary: list[str]) -> bytes:
    return trained(ORDINARY, [w for t in ordinary for w in windows(t)])


def unexplained(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The words of toxic texts that ordinary ones don't have, once for each different pair of neighbours; only those that LEAST
    texts add a pair to."""
    known = {w.lower() for t in ordinary for w in words(t)}
    seen: set[tuple[bytes, bytes, bytes]] = set()
    texts: Counter = Counter()
    for t in toxic:
        ws = [b"", *(w.lower() for w in words(t)), b""]
        new = {c for c in zip(ws, ws[1:], ws[2:]) if c[1] not in known} - seen
        seen |= new
        texts.update({w for _, w, _ in new})
    return [b" " + w + b" " for _, w, _ in sorted(seen) if texts[w] >= LEAST]


def toxic_dictionary(each: list[bytes], size: int) -> bytes:
    each = list(each)
    random.Random(1).shuffle(each)
    return trained(size, [b"".join(each[i : i + TOGETHER]) for i in range(0, len(each), TOGETHER)], k=SEGMENT, d=COUNTED)


class Gains:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = [self._compressor(x) for x in (ordinary, toxic + ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> Z.ZstdCompressor:
        p = Z.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **PARAMETERS)
        d = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return Z.ZstdCompressor(dict_data=d, compression_params=p)

    def features(self, text: str | None) -> list[float]:
        """The three largest gains."""
        plain, toxic = self.pair
        g = sorted((len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)), reverse=True)
        return [float(max(0, x)) for x in (*g[:3], 0, 0, 0)][:3]


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float], mean: list[float], scale: list[float]):
        self.parts, self.weights, self.mean, self.scale = (toxic, ordinary), np.array(weights), np.array(mean), np.array(scale)
        self.gains: Gains | None = None

    def __getstate__(self):
        return self.__dict__ | {"gains": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.gains is None:
            self.gains = Gains(*self.parts)
        x = (np.array([self.gains.features(t) for t in texts]).reshape(-1, len(self.mean)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the constant first), mean and scale of a logistic regression in which both labels weigh the same and no gain lowers the score."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(3000):
        e = (1 / (1 + np.exp(-(b + z @ w))) - y) * share
        b -= 2 * e.sum()
        w = np.maximum(w - 2 * (z.T @ e + 1e-4 * w), 0)
    return np.append(b, w), mean, scale


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Half of each list for the dictionaries, the rest for the thresholds."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    plain, each = ordinary_dictionary(ordinary[::2]), unexplained(toxic[::2], ordinary[::2])
    y = np.repeat([1.0, 0.0], [len(toxic[1::2]), len(ordinary[1::2])])
    best: tuple[float, Model] | None = None
    for size in SIZES:
        made = toxic_dictionary(each, size)
        gains = Gains(made, plain)
        x = np.array([gains.features(t) for t in (*toxic[1::2], *ordinary[1::2])])
        weights, mean, scale = regression(x, y)
        logit = (x - mean) / scale @ weights[1:]
        # at most a share CLEAN of the ordinary documents may come out as toxic
        weights[0] = min(weights[0], BOUND - 1e-9 - np.quantile(logit[y == 0], 1 - CLEAN))
        found = (logit[y == 1] + weights[0] >= BOUND).mean()
        if best is None or found > best[0]:
            best = found, Model(made, plain, list(weights), list(mean), list(scale))
    return best[1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From labels (doc_id, toxic) that aren't held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = [least_hashed(known.where(F.col("toxic") == k), "doc_id", 2 * sample) for k in (1, 0)]
    # at most 4 * sample ids, and one text for each
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: r["doc_id"])
    random.Random(0).shuffle(rows)
    return fit(*([r["text"] for r in rows if r["toxic"] == k] for k in (1, 0)))


def _score(model: Model | None) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(b["text"].to_pylist()) if model else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "text"), pa.array(scores, pa.float64())], [*(c for c in b.schema.names if c != "text"), "score"])

    return partition


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row of docs (doc_id, text)."""
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_score(model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay."""
    kept, names = docs.columns, docs.schema.names

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(b.column(names.index("text")).to_pylist()) if model else np.zeros(len(b))
            yield b.filter(pa.array(scores < TOXIC_AT))

    return docs.mapInArrow(lean(partition), docs.schema).select(*kept)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
