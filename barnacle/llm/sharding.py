"""Vector bin packing: documents into shards with bytes, tokens and rows balanced jointly.

Equal texts form a group, which stays in one shard. Only a group that no shard has room for, because it has more than 1 / n_shards of any of the
three totals, is split, into parts by a hash of its doc_ids. Groups are placed one after another, largest first, in the shard with the highest dot
product between the group and the shard's residual capacity.

Groups with more than 1 / HEAVY of any total come first; at most 3 * HEAVY of them can exist, so they are placed on the driver whatever the size of the input.
All others are dealt by a hash to sections of SECTION groups or so. A task places the groups of a section, with the section's share of
the capacity that the heavy groups have left, so no task needs to know another's choices and what one section leaves uneven is the size of its smallest groups.
Slots follow the order of doc_id within a shard: rows are sorted by ranges, and each range's first slots follow from the counts of the ranges before.

Null texts are a group of their own with size 1, no tokens and crc 0, apart from empty texts, which have the same size and crc.
Rows with a repeated or null doc_id each get a slot of their own; such rows of one text go to one part. Ties in size are settled by the groups' hashes.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, table

HEAVY, SECTION, PIECES = 4096, 20_000, 4
DIMS = ("bytes", "tokens", "rows")
KEY = ["h", "text_crc32", "size"]


def place(share: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shard of each row of share (a column for each dimension), in sections of the totals; residual, a row for each shard, is lowered."""
    out = np.zeros(len(share), np.int32)
    for i in np.argsort(-share.max(axis=1, initial=0), kind="stable"):
        out[i] = best = int(np.argmax(residual @ (weights * share[i])))
        residual[best] -= share[i]
    return out


def vector_shards(docs: DataFrame, n_shards: int = 8, law: str = "bytes", heavy: int = HEAVY, section: int = SECTION) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text); law names the dimension that weighs most."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = cut(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("text", F.col("text").isNull()).alias("h"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = cut(rows.groupBy(*KEY).agg(*sums))
    found = groups.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS)).first()
    total = np.array([max(found[d], 1) for d in DIMS], float)
    weights = np.array([1.0 if d == law else 0.25 for d in DIMS])
    share = F.greatest(*(F.col(d) / F.lit(t) for d, t in zip(DIMS, total.tolist())))
    # at most 3 * heavy groups have such a share
    big = groups.where(share > 1 / heavy).select(*KEY, F.when(share > 1 / n_shards, F.ceil(share * n_shards * PIECES)).otherwise(1).cast("int").alias("parts")).collect()
    big = F.broadcast(spark.createDataFrame([tuple(r) for r in big], "h long, text_crc32 long, size long, parts int"))
    tagged = rows.join(big, KEY, "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    items = sorted(tuple(r) for r in tagged.where("parts is not null").groupBy(*KEY, "part").agg(*sums).collect())
    residual = np.full((n_shards, len(DIMS)), 1 / n_shards)
    shares = np.array([r[-3:] for r in items], float).reshape(-1, len(DIMS)) / total
    shard = place(shares, residual, weights)
    chosen = F.broadcast(spark.createDataFrame([(*r[:4], int(s)) for r, s in zip(items, shard)], "h long, text_crc32 long, size long, part int, shard int"))
    rest = np.maximum(1 - shares.sum(axis=0), 1e-12)

    def place_section(t: pa.Table) -> pa.Table:
        t = t.sort_by([(k, "ascending") for k in KEY])
        own = np.stack([t[d].to_numpy() for d in DIMS], axis=1).astype(float) / total
        # the section's part of what is left; equal shards are taken in an order of the section's own, so that sections don't all favour the first
        turn = np.random.default_rng(t["section"][0].as_py()).permutation(n_shards)
        at = turn[place(own, (residual * (own.sum(axis=0) / rest))[turn], weights)]
        return t.select(KEY).append_column("shard", pa.array(at.astype(np.int32)))

    sections = max(1, -(-found["n"] // section))
    light = groups.where(share <= 1 / heavy).withColumn("section", F.pmod(F.xxhash64("h", "size"), F.lit(sections)))
    plan = light.groupBy("section").applyInArrow(place_section, "h long, text_crc32 long, size long, shard int")
    columns = ["doc_id", "size", "text_crc32", "h", "shard"]
    placed = tagged.where("parts is not null").join(chosen, [*KEY, "part"]).select(*columns)
    placed = placed.unionByName(tagged.where("parts is null").join(plan, KEY).select(*columns))
    # slots: a row's place in its range of rows, after what the ranges before have of its shard
    order = ["shard", "doc_id", "h"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select(*columns, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    firsts = ranged.groupBy("shard", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select("shard", "range", "first", F.coalesce(before, F.lit(0)).alias("base"))
    return ranged.join(firsts, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at") - F.col("first")).alias("slot"))


def op9_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_vector_shards": op9_vector_shards}
ORACLES: dict[str, str] = {}
