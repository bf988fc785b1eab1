"""MinHash near-duplicates: fast similarity sketches, banding, and exact checks on whole shingle sets.

Documents with equal shingle sets are one node from the start. Nodes that agree in a band of ROWS sketch coordinates share
a bucket; with 32 bands of 4 a pair at the threshold shares none with probability 5e-8. The least node of a bucket leads it, and the nodes of
all buckets with one leader are its group.

A group is checked on whole sets: all members against the leader first. What that links is joined to components, and only members outside their leader's
component are then checked against all members, in blocks of BLOCK. A group of copies costs one check for each of its texts. No buckets,
groups or pairs are left out. Pairs are never collected or emitted: a block gives a spanning forest of its links.

Null and empty texts, and texts without words, have an empty set and no links. Rows with a null doc_id have no links, a null
component_id, and are kept. Repeated rows have the same component and the same kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_keys, lean, spread_join, stored, table, words
from .graph import components
from .sketch import SIZE, fingerprint, shingles, sketch

ROWS, BLOCK = 4, 256


def elements(text: str | None, k: int) -> np.ndarray:
    """The shingle set of a text; bytes.lower() changes A-Z only."""
    return shingles([w.lower() for w in words(text)], k)


def _sketched(k: int) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, sk = [], [], []
            for t in b["text"]:
                e = elements(t.as_py(), k)
                n.append(len(e))
                fp.append(fingerprint(e) if len(e) else None)
                sk.append(sketch(e).astype("<u4").tobytes() if len(e) else None)
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "fp", "sketch"])

    return partition


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Key and rows of each run of rows with one key, of batches sorted by it."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[c] for c in key)
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append(r)
    if rows:
        yield now, rows


def _sets(k: int) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets = [], []
            for fp, t in zip(b["fp"].to_pylist(), b["text"]):
                e = elements(t.as_py(), k)
                if len(e) and fingerprint(e) == fp:
                    fps.append(fp)
                    sets.append(e.astype("<u8").tobytes())
            yield pa.record_batch([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["fp", "elements"])

    return partition


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _with_leader(percent: int) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, np.zeros(0, np.uint64)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for leader, salt, fp, e in zip(*(b[c].to_pylist() for c in ("leader", "salt", "fp", "elements"))):
                e = np.frombuffer(e, "<u8")
                if leader == fp:  # sorted before the members
                    key, first = (leader, salt), e
                elif key == (leader, salt):
                    for c, v in zip(out, (leader, fp, linked(first, e, percent))):
                        c.append(v)
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], ["leader", "fp", "linked"])

    return partition


def block_links(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of xs is linked with each of ys."""
    every = np.unique(np.concatenate([*xs, *ys]))
    common = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(every), 8192):  # columns of the membership matrices
        part = every[at : at + 8192]
        x, y = (np.zeros((len(s), len(part)), np.float32) for s in (xs, ys))
        for m, s in ((x, xs), (y, ys)):
            for i, e in enumerate(s):
                lo, hi = np.searchsorted(e, part[0]), np.searchsorted(e, part[-1], "right")
                m[i, np.searchsorted(part, e[lo:hi])] = 1
        common += x @ y.T
    common = common.astype(np.int64)
    sizes = np.array([len(e) for e in xs])[:, None] + np.array([len(e) for e in ys])[None, :]
    return 100 * common >= percent * (sizes - common)


def forest(a: list, b: list) -> list[tuple]:
    """Of the edges a[i], b[i], those that join two trees."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a, b):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            out.append((x, y))
    return out


def _in_blocks(percent: int) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["leader", "p", "q"]):
            xs, ys = [r for r in rows if r["side"]], [r for r in rows if not r["side"]]
            if xs and ys:
                found = block_links(*([np.frombuffer(r["elements"], "<u8") for r in s] for s in (xs, ys)), percent)
                i, j = np.nonzero(found)
                kept = forest([xs[k]["fp"] for k in i], [ys[k]["fp"] for k in j])
                yield pa.record_batch([pa.array([e[k] for e in kept], pa.binary()) for k in (0, 1)], ["a", "b"])

    return partition


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stored(docs.mapInArrow(lean(_sketched(k)), "doc_id long, n_shingles long, fp binary, sketch binary"))
    usable = rows.where("fp is not null and doc_id is not null")
    nodes = stored(usable.groupBy("fp").agg(F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")))
    width = 4 * ROWS
    bands = nodes.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(SIZE // ROWS)))).alias("bucket"))
    leaders = bands.groupBy("bucket").agg(F.min("fp").alias("leader"), F.max("fp").alias("last")).where("leader < last").select("bucket", "leader")
    near = stored(bands.join(leaders, "bucket").where("fp > leader").select("leader", "fp").distinct())

    sizes = near.groupBy("leader").agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("blocks"))
    members = near.select("fp").unionByName(near.select(F.col("leader").alias("fp"))).distinct()
    one = nodes.join(members, "fp", "left_semi").select("fp", F.col("least").alias("doc_id"))
    sets = stored(one.join(docs, "doc_id").mapInArrow(lean(_sets(k)), "fp binary, elements binary").dropDuplicates(["fp"]))
    # a leader with very many members has them in several tasks
    heavy = heavy_keys(near, ["leader"], near.count())
    with_leader = lambda df, one, how="inner": spread_join(df, one, ["leader"], heavy, "fp", how)
    salted = with_leader(near, sizes).select("leader", "fp", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("salt"), F.lit(1).alias("member"))
    salted = salted.unionByName(sizes.select("leader", F.col("leader").alias("fp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("member")))
    first = salted.join(sets, "fp").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member").mapInArrow(lean(_with_leader(percent)), "leader binary, fp binary, linked boolean")
    first = stored(first)

    labels = components(first.where("linked").select(F.col("leader").alias("a"), F.col("fp").alias("b")))
    # members outside their leader's component, against all members
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    tagged = with_leader(first.join(label("fp"), "fp", "left"), label("leader"), "left")
    tagged = stored(tagged.select("leader", "fp", (F.coalesce("fp_label", "fp") != F.coalesce("leader_label", "leader")).alias("odd")))
    count = tagged.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs"), F.ceil(F.count_if("odd") / BLOCK).cast("int").alias("ps"), F.count("*").alias("n")).where("ps > 0 and n > 1")
    block = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xs = with_leader(tagged.where("odd"), count).select("leader", "fp", block("ps").alias("p"), upto("qs").alias("q"), F.lit(True).alias("side"))
    ys = with_leader(tagged, count).select("leader", "fp", block("qs").alias("q"), upto("ps").alias("p"), F.lit(False).alias("side"))
    blocks = xs.unionByName(ys).join(sets, "fp").repartition("leader", "p", "q").sortWithinPartitions("leader", "p", "q")
    more = blocks.mapInArrow(lean(_in_blocks(percent)), "a binary, b binary")
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    known = nodes.select("fp", "least").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(least, "label").select("fp", "component_id")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(known, "fp", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLES = {
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""
}
