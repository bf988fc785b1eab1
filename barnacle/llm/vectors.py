"""Embedding near-duplicates by collision counting on one-dimensional projections.

Each vector is projected on COUNTED random directions. On each of these a pair collides if one's projection lies in a window that is centred on the other's and as wide
as the difference of two vectors at the threshold has standard deviations (WIDTH). A pair at the threshold collides in two thirds of the projections, two random vectors in
a sixth. A pair is verified by cosine in double precision if it collides at least as often as calibrate() found to keep RECALL of
the pairs at the threshold; that number depends on the threshold alone, for random directions see nothing of two vectors but their angle, so no sample
of the data is needed, and it drops nearly all other pairs.

One-dimensional windows alone would compare a fixed share of all pairs, so what is counted against what is settled before: each vector enters the lists of the TOP of
DIRECTIONS further directions in which it is most extreme, on the side of its sign. Near vectors are extreme in the same directions, others rarely are. Lists are the same at
every size of the table; one longer than BLOCK is compared in blocks, whole, so their length costs time, never links. A pair is handled in its first
common list, so it counts once.

Equal vectors are one node with a number of copies. Blocks return sums of links and a spanning forest, never pairs.

Vectors that are null, zero, empty, or hold null or non-finite components link with nothing, and vectors of different lengths don't
link. Rows with a null vec_id link with nothing and have a null component_id. Rows with equal vec_id are separate vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join, stored, table
from .graph import components
from .neardup import forest

TOP, DIRECTIONS, BLOCK = 8, 2048, 512
COUNTED, WIDTH, RECALL = 64, 1.0, 0.9995


@lru_cache(maxsize=8)
def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng((dim, n)).standard_normal((dim, n)).astype(np.float32)


def strongest(unit: np.ndarray, n: int = DIRECTIONS) -> np.ndarray:
    """The lists (2 * direction + side) that each row enters."""
    p = unit.astype(np.float32) @ directions(unit.shape[1], n)
    top = np.argpartition(-np.abs(p), TOP, axis=1)[:, :TOP]
    return (2 * top + (np.take_along_axis(p, top, axis=1) < 0)).astype(np.int32)


def projections(unit: np.ndarray) -> np.ndarray:
    """A row for each direction in which collisions are counted."""
    return np.ascontiguousarray((unit.astype(np.float32) @ directions(unit.shape[1], COUNTED)).T)


def window(cosine: float) -> float:
    """Half the width of a window."""
    return WIDTH * (2 - 2 * cosine) ** 0.5


def collisions(a: np.ndarray, b: np.ndarray, w: float) -> np.ndarray:
    """In how many projections each column of a collides with each of b."""
    count = np.zeros((a.shape[1], b.shape[1]), np.int8)
    for x, y in zip(a, b):
        count += np.abs(x[:, None] - y[None, :]) <= w
    return count


@lru_cache(maxsize=32)
def calibrate(cosine: float, recall: float = RECALL, trials: int = 100_000) -> int:
    """The largest number of collisions that this share of pairs at the threshold reach: their differences are normal in each projection."""
    d = np.random.default_rng(0).standard_normal((trials, COUNTED), np.float32) * (2 - 2 * cosine) ** 0.5
    return max(1, int(np.quantile((np.abs(d) <= window(cosine)).sum(axis=1), 1 - recall, method="lower")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as doubles, scaled to length 1; null where it can't link."""
    for b in batches:
        fp, unit = [], []
        for v in b["embedding"].to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            size = np.abs(x).max(initial=0)
            if not size or not np.isfinite(size):
                fp.append(None)
                unit.append(None)
                continue
            fp.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            x = x / size  # else the squares of very large or small components leave the range
            unit.append((x / np.linalg.norm(x)).astype("<f8").tobytes())
        yield pa.record_batch([b["vec_id"], pa.array(fp, pa.binary()), pa.array(unit, pa.binary())], ["vec_id", "fp", "unit"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each list that a vector enters."""
    for b in batches:
        units, fps, copies = b["unit"].to_pylist(), b["fp"].to_pylist(), b["copies"].to_pylist()
        for size in sorted({len(u) for u in units}):
            at = [i for i, u in enumerate(units) if len(u) == size]
            for lo in range(0, len(at), 1000):
                part = at[lo : lo + 1000]
                lists = strongest(np.frombuffer(b"".join(units[i] for i in part), "<f8").reshape(len(part), -1))
                rows = np.repeat(part, lists.shape[1])
                pick = lambda c, t: pa.array([c[i] for i in rows], t)
                tops = [x.tobytes() for x in lists.astype("<i4") for _ in range(lists.shape[1])]
                yield pa.record_batch(
                    [pa.array(np.full(len(rows), size // 8, np.int32)), pa.array(lists.ravel()), pick(fps, pa.binary()), pick(copies, pa.int64()), pick(units, pa.binary()), pa.array(tops, pa.binary())],
                    ["dim", "list", "fp", "copies", "unit", "tops"],
                )


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each run with one key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        k = np.stack([b[c].to_numpy() for c in key], axis=1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(b)]
        for lo, hi in zip(edges, edges[1:]):
            if last is not None and tuple(k[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _count(cosine: float) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, least = window(cosine), calibrate(cosine)
        for t in _runs(batches, ["dim", "list", "p", "q"]):
            this, p, q = (t[c][0].as_py() for c in ("list", "p", "q"))
            if len(t) < 2:
                continue
            side, copies = t["b"].to_numpy(), t["copies"].to_numpy()
            unit, tops = (np.frombuffer(b"".join(t[c].to_pylist()), k).reshape(len(t), -1) for c, k in (("unit", "<f8"), ("tops", "<i4")))
            one, two = np.flatnonzero(side == p), np.flatnonzero(side == q)
            near, found = projections(unit), []
            for lo in range(0, len(one), BLOCK):
                rows = one[lo : lo + BLOCK]
                for start in range(0, len(two), BLOCK):
                    columns = two[start : start + BLOCK]
                    a, b = np.nonzero(collisions(near[:, rows], near[:, columns], w) >= least)
                    a, b = rows[a], columns[b]
                    if p == q:
                        a, b = a[a < b], b[a < b]
                    ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                    a, b = a[ok], b[ok]
                    for at in range(0, len(a), 20_000):
                        x, y = tops[a[at : at + 20_000]], tops[b[at : at + 20_000]]
                        common = (x[:, :, None] == y[:, None, :]).any(axis=2)
                        first = np.where(common, x, np.iinfo(np.int32).max).min(axis=1) == this
                        found.append((a[at : at + 20_000][first], b[at : at + 20_000][first]))
            a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 2
            if len(a):
                links = np.zeros(len(t), np.int64)
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                fps = t["fp"].to_pylist()
                edges = forest(a.tolist(), b.tolist())
                some = np.flatnonzero(links)
                yield pa.record_batch(
                    [pa.array([fps[k] for k in some] + [fps[x] for x, _ in edges], pa.binary()), pa.array([None] * len(some) + [fps[y] for _, y in edges], pa.binary()), pa.array(links[some].tolist() + [0] * len(edges), pa.int64())],
                    ["a", "b", "links"],
                )

    return partition


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    rows = stored(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_read, "vec_id long, fp binary, unit binary"))
    usable = rows.where("fp is not null and vec_id is not null")
    nodes = stored(usable.groupBy("fp").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    lists = nodes.select("fp", "copies", "unit").mapInArrow(_lists, "dim int, list int, fp binary, copies long, unit binary, tops binary")
    lists = stored(lists)
    sizes = lists.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    b, j = F.pmod(F.xxhash64("fp"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = lists.join(sizes, ["dim", "list"]).withColumn("b", b).withColumn("j", j).withColumn("p", F.least("b", "j")).withColumn("q", F.greatest("b", "j")).drop("j", "blocks")
    found = stored(spread.repartition("dim", "list", "p", "q").sortWithinPartitions("dim", "list", "p", "q").mapInArrow(_count(cosine), "a binary, b binary, links long"))
    links = found.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "fp")
    known = nodes.select("fp", "copies", "least").join(labels, "fp", "left").join(links, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    known = cut(known)
    # the label of a large component has its nodes in several tasks
    heavy = heavy_keys(known, ["label"], known.count())
    known = spread_join(known, known.groupBy("label").agg(F.min("least").alias("component_id")), ["label"], heavy, "fp")
    known = known.select("fp", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("fp")).alias("fp")).join(known, "fp", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_near_vectors": op10_near_vectors}
ORACLES = {
    "op10_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE a.s > 0 AND b.s > 0 AND isfinite(a.s) AND isfinite(b.s)
  AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), k AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT n.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, n.vec_id = c.component_id AS kept
FROM n JOIN c ON c.a = n.vec_id LEFT JOIN k ON k.a = n.vec_id"""
}
