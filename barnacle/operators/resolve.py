"""Nearest barcode of each variable region, by pigeonhole seeds.

With at most k substitutions, all but k of a barcode's parts are found unchanged. So candidates come from an equi-join on
the expansions of each choice of these and are then compared whole; with k = 0 that is one hash join. There are k + 1 parts or, for a pool that fills much
of its space, more, so that seeds stay rare. Where a barcode has two segments with caps of their own, a
seed has parts of each. Equal barcodes are one candidate. Barcodes with too many expansions are compared by mask with all regions of their pool; usually there are none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, product
from math import comb, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import WORD, nibbles, word
from .pool import Pool, expanded

#: d and idx in one BIGINT: the least of such numbers is that of the lowest idx at the least distance.
IDX = 1 << 40


#: What a seed costs, in comparisons of a region and a candidate; and the most parts of a segment beyond k.
SEED, PARTS = 4, 8


def _kept(length: int, k: int, parts: int, start: int) -> list[list[tuple[int, int]]]:
    """The places of each choice of all but k parts of a segment."""
    each = [(start + length * i // parts, start + length * (i + 1) // parts) for i in range(parts)]
    return [list(c) for c in combinations(each, parts - k)]


def seed_places(pool: Pool, caps: Sequence[int]) -> list[list[tuple[int, int]]] | None:
    """The pieces of each seed: all but some parts of each segment; None if a segment may change as a whole.

    There are as many parts as cost least, were barcodes random; the same are found with any number.
    """
    if any(length and k >= length for length, k in zip(pool.segments, caps)):
        return None
    segments = [(length, k if length else 0) for length, k in zip(pool.segments, caps)]

    def cost(parts: tuple[int, ...]) -> float:
        unchanged = sum(length * (m - k) / m for (length, k), m in zip(segments, parts))
        return prod(comb(m, k) for (_, k), m in zip(segments, parts)) * (SEED + pool.size * 4.0**-unchanged)

    parts = min(product(*(range(k + 1, max(min(length, k + PARTS), k + 1) + 1) for length, k in segments)), key=cost)
    at, out = 0, [[]]
    for (length, k), m in zip(segments, parts):
        out, at = [[*o, *p] for o in out for p in _kept(length, k, m, at)], at + length
    return out


def _seeds(c: Column, places: list[list[tuple[int, int]]], expand: bool) -> Column:
    """part number and sequence of each seed."""
    whole = [F.concat(*(F.substring(c, a + 1, b - a) for a, b in ps)) for ps in places]
    if expand:
        numbered = lambda i: lambda s: F.struct(F.lit(i).alias("part"), s.alias("seed"))
        return F.flatten(F.array(*(F.transform(expanded(w), numbered(i)) for i, w in enumerate(whole))))
    return F.array(*(F.struct(F.lit(i).alias("part"), w.alias("seed")) for i, w in enumerate(whole)))


def _words(digits: Column, pools: Sequence[Pool]) -> Column:
    """Digits as a BIGINT for each word of each segment of the row's pool."""
    out = F.lit(None).cast("array<bigint>")
    for n, pool in enumerate(pools):
        at, each = 0, []
        for length in pool.segments:
            each += [word(digits, at + i, min(WORD, length - i)) for i in range(0, length, WORD)]
            at += length
        out = F.when(F.col("pool") == n, F.array(*each).cast("array<bigint>")).otherwise(out)
    return out


def within(rows: DataFrame, pools: Sequence[Pool], caps: Sequence[Sequence[int]]) -> DataFrame:
    """rows (pool: the number of one of pools; v; c: mismatches so far in each segment) with d, low and high of the barcodes that are within the caps
    of every segment, low and high being the lowest and highest idx of equal barcodes; a pair may come more than once."""
    seeds, barcodes, wild = F.lit(None).cast("array<struct<part:int,seed:string>>"), [], []
    for n, (pool, cap) in enumerate(zip(pools, caps)):
        places, tagged = seed_places(pool, cap), pool.different.withColumn("pool", F.lit(n))
        tagged = tagged.select("pool", "low", "high", _words(F.col("masks"), pools).alias("masks"), "barcode", "wild")
        if places is None:
            wild.append(tagged)
            continue
        seeds = F.when(F.col("pool") == n, _seeds(F.col("v"), places, False)).otherwise(seeds)
        barcodes.append(tagged.where("not wild").select("pool", "low", "high", "masks", F.explode(_seeds(F.col("barcode"), places, True)).alias("s")).select("pool", "low", "high", "masks", "s.*"))
        if pool.wild:
            wild.append(tagged.where("wild"))
    rows = rows.withColumn("digits", nibbles(F.col("v"))).withColumn("digits", _words(F.col("digits"), pools))
    found = []
    if barcodes:
        asked = rows.withColumn("s", F.explode(seeds)).select(*rows.columns, "s.*")
        found.append(asked.join(reduce(DataFrame.unionByName, barcodes), ["pool", "part", "seed"]).drop("part", "seed"))
    if wild:
        found.append(rows.join(reduce(DataFrame.unionByName, wild).drop("barcode", "wild"), "pool"))
    near = reduce(DataFrame.unionByName, (f.select(*rows.columns, "low", "high", "masks") for f in found))
    d, ok = F.lit(None).cast("int"), F.lit(False)
    for n, (pool, cap) in enumerate(zip(pools, caps)):
        at, each = 0, []
        for length in pool.segments:
            words = range(at, at := at + -(-length // WORD))
            same = (F.bit_count(F.get("digits", F.lit(i)).bitwiseAND(F.get("masks", F.lit(i)))) for i in words)
            each.append(reduce(Column.__sub__, same, F.lit(length)).cast("int"))
        fits = reduce(Column.__and__, (F.col("c")[i] + e <= k for i, (e, k) in enumerate(zip(each, cap))))
        here = F.col("pool") == n
        d, ok = F.when(here, sum(each[1:], each[0])).otherwise(d), F.when(here, fits).otherwise(ok)
    return near.withColumn("d", d).where(ok).drop("digits", "masks")


def nearest(near: DataFrame, keys: list[str], policy: Column) -> DataFrame:
    """Of near (keys, low, high, d): the idx at the least d, and that d; of several at it the lowest (policy `first`), the highest (`last`) or none."""
    packed = lambda x: F.min(F.col("d").cast("long") * IDX + x)
    at = near.groupBy(*keys).agg(packed(F.col("low")).alias("low"), packed(IDX - 1 - F.col("high")).alias("high"))
    low, high = F.pmod("low", F.lit(IDX)), IDX - 1 - F.pmod("high", F.lit(IDX))
    idx = F.when((policy == "first") | (low == high), low).when(policy == "last", high)
    return at.select(*keys, idx.alias("idx"), F.floor(F.col("low") / IDX).cast("int").alias("d")).where("idx is not null")
